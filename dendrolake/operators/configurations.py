"""Experiment configurations put to a model's operators: base(model, operator, spec, position, attributes map)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.plan import Dialect, plan

# Fixed value: the family of operators that can't make single proposals, which timed chains need.
UNTIMED = "slice."


def _over(base: str, new: str):
    """The entries of one map, and of another in their place."""
    return F.expr(f"map_concat(map_filter({base}, (k, v) -> NOT coalesce(map_contains_key({new}, k), false)), coalesce({new}, map()))")


def apply_configurations(base: DataFrame, configs: DataFrame, removed: DataFrame, changed: DataFrame, added: DataFrame, untimed: str = UNTIMED) -> DataFrame:
    """config, place, operator, spec, attributes of the operators of each configuration, in order. configs: config, model; removed: config, operator; changed:
    config, operator, attributes (set, or set anew); added: config, template, operator, attributes, nth: copies of operators as they are by then, put right
    after them, later ones first. Operators whose spec begins with `untimed` are left out of all. Raises where a configuration names an operator that isn't there."""
    usable = base.where(~F.coalesce(F.col("spec").startswith(untimed), F.lit(False)))
    whole = configs.join(usable, "model")
    for what, names in (("removes", removed.select("config", "operator")), ("changes", changed.select("config", "operator")), ("copies", added.select("config", F.col("template").alias("operator")))):
        there = whole if what == "removes" else whole.join(removed.select("config", "operator"), ["config", "operator"], "left_anti") if what == "copies" else whole
        odd = names.join(there.select("config", "operator"), ["config", "operator"], "left_anti").head(1)
        if odd:
            raise ValueError(f"configuration {odd[0].config!r} {what} the operator {odd[0].operator!r}, which it doesn't have")
    kept = whole.join(removed.select("config", "operator").distinct(), ["config", "operator"], "left_anti")
    now = kept.join(changed.select("config", "operator", F.col("attributes").alias("new")), ["config", "operator"], "left").select("config", "operator", "spec", "position", _over("attributes", "new").alias("attributes"), F.lit(0).alias("later"))
    copies = added.select("config", F.col("template").alias("operator"), F.col("operator").alias("copy"), F.col("attributes").alias("new"), "nth").join(now, ["config", "operator"]).select(
        "config", F.col("copy").alias("operator"), "spec", "position", _over("attributes", "new").alias("attributes"), (F.lit(1_000_000_000) - F.col("nth")).cast("int").alias("later")
    )
    place = F.row_number().over(Window.partitionBy("config").orderBy("position", "later"))
    return now.unionByName(copies).select("config", place.alias("place"), "operator", "spec", "attributes")


def operator_mixes(operators: DataFrame, given: list[str] = ()) -> DataFrame:
    """mix, operator, weight: each operator alone, all with their own weights (`baseline`), and mixes given as `name=operator:weight,operator:weight`, which come in the
    place of others of their name. operators: operator, weight. Raises where a mix isn't written so, or names an operator that isn't there."""
    alone = operators.select(F.col("operator").alias("mix"), "operator", F.lit(1.0).alias("weight"))
    own = operators.select(F.lit("baseline").alias("mix"), "operator", F.col("weight").cast("double").alias("weight"))
    named = operators.sparkSession.createDataFrame([(x,) for x in given], "said string")
    parts = named.select("said", F.substring_index("said", "=", 1).alias("mix"), F.explode_outer(F.split(F.expr("substring(said, instr(said, '=') + 1)"), ",")).alias("part"))
    told = parts.select("said", "mix", F.substring_index("part", ":", 1).alias("operator"), F.substring_index("part", ":", -1).try_cast("double").alias("weight"))
    odd = told.join(operators.select("operator", F.lit(True).alias("there")), "operator", "left").where("there IS NULL OR weight IS NULL OR NOT said RLIKE '^[^=]+=[^=]+$'").head(1)
    if odd:
        raise ValueError(f"{odd[0].said!r} isn't a mix of operators that are there")
    rest = alone.unionByName(own).join(told.select("mix").distinct(), "mix", "left_anti")
    return rest.unionByName(told.select("mix", "operator", "weight"))


def attributes_text(column: str = "attributes"):
    """A map as text, keys in order."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e.key, F.lit("="), e.value)), ",")


def applied_text() -> str:
    """The same for a second engine, attribute by attribute; over the views base_operator, base_attribute, configuration, removed_operator, changed_attribute and
    added_operator, added_attribute. Attributes as text."""
    return """WITH kept AS (SELECT c.config, b.operator, b.spec, b.position FROM configuration c JOIN base_operator b ON b.model = c.model AND b.spec NOT LIKE 'slice.%'
        LEFT JOIN removed_operator r ON r.config = c.config AND r.operator = b.operator WHERE r.operator IS NULL),
      own AS (SELECT k.config, k.operator, a.key, a.value FROM kept k JOIN base_attribute a ON a.operator = k.operator LEFT JOIN changed_attribute x ON x.config = k.config AND x.operator = k.operator AND x.key = a.key WHERE x.key IS NULL
        UNION ALL SELECT k.config, k.operator, x.key, x.value FROM kept k JOIN changed_attribute x ON x.config = k.config AND x.operator = k.operator),
      copies AS (SELECT a.config, a.operator, k.operator AS template, k.spec, k.position, a.nth FROM added_operator a JOIN kept k ON k.config = a.config AND k.operator = a.template),
      theirs AS (SELECT c.config, c.operator, o.key, o.value FROM copies c JOIN own o ON o.config = c.config AND o.operator = c.template LEFT JOIN added_attribute x ON x.config = c.config AND x.operator = c.operator AND x.key = o.key WHERE x.key IS NULL
        UNION ALL SELECT x.config, x.operator, x.key, x.value FROM added_attribute x),
      texts AS (SELECT config, operator, string_agg(concat(key, '=', value), ',' ORDER BY key) AS attributes FROM (SELECT * FROM own UNION ALL SELECT * FROM theirs) z GROUP BY ALL),
      lists AS (SELECT config, operator, spec, position, 0 AS later FROM kept UNION ALL SELECT config, operator, spec, position, 1000000000 - nth FROM copies)
      SELECT l.config, row_number() OVER (PARTITION BY l.config ORDER BY l.position, l.later) AS place, l.operator, l.spec, coalesce(t.attributes, '') AS attributes FROM lists l LEFT JOIN texts t ON t.config = l.config AND t.operator = l.operator"""


# Keys of settings, the condition that their value keeps, and what a breach is called.
RANGES = [
    ("windowProbability", "value >= 0 AND value < 1", "at least 0 and below 1"), ("sortingErrorProbability", "value > 0 AND value < 0.5", "above 0 and below 0.5"),
    ("maxLevels", "value >= 0", "not negative"), ("maxSites", "value >= 1", "positive"), ("pseudoCount", "value >= 0", "not negative"), ("missingWeight", "value >= 0", "not negative"),
]
SUMS = [(("fullExplorationProbability", "sortedExplorationProbability"), "total > 1", "at most 1 together")]


@plan("settings")
def setting_violations(d: Dialect) -> str:
    """Settings of configurations, settings(config, key, value), that are out of their range, and sums of settings that are; values that aren't numbers break every rule."""
    number = "value IS NULL OR isnan(value)"
    one = [f"SELECT config, key, value, '{said}' AS wanted FROM {{settings}} WHERE key = '{key}' AND ({number} OR NOT ({holds}))" for key, holds, said in RANGES]
    many = [
        f"SELECT config, '{'+'.join(keys)}', total, '{said}' FROM (SELECT config, sum(value) AS total FROM {{settings}} WHERE key IN ({', '.join(map(repr, keys))}) GROUP BY config) t WHERE {broken}"
        for keys, broken, said in SUMS
    ]
    return " UNION ALL ".join(one + many)


def checked_settings(settings: DataFrame) -> DataFrame:
    """The settings, if none is out of its range; else raises, naming one."""
    odd = setting_violations(settings=settings).orderBy("config", "key").head(1)
    if odd:
        raise ValueError(f"{odd[0].key} of {odd[0].config!r} is {odd[0].value}, but must be {odd[0].wanted}")
    return settings
