"""Writers of sequence files, timings, templates and summary tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 10_000


def write_timing(totals: dict[str, object], rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Operator rows as one text table, the totals as `# key=value` lines before its head. rows: one for each operator."""
    head = [f"# {k}={v}" for k, v in totals.items()] + [",".join(rows.columns)]
    lines = rows.sparkSession.createDataFrame([(-1, i, x) for i, x in enumerate(head)], "part int, nth long, value string")
    # a sort in one partition: an operator has one row
    body = rows.select(F.lit(0).alias("part"), F.monotonically_increasing_id().alias("nth"), F.concat_ws(",", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in rows.columns)).alias("value"))
    lines.unionByName(body).coalesce(1).sortWithinPartitions("part", "nth").select("value").write.mode("overwrite" if overwrite else "ignore").text(path)


def write_fasta(taxa: DataFrame, path: str, overwrite: bool = False) -> None:
    """taxa(header, sequence) as text files; existing results stay unless told otherwise."""
    taxa.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("sequence")).alias("value")).write.mode("overwrite" if overwrite else "ignore").text(path)


def write_table(df: DataFrame, path: str, kind: str = "csv", overwrite: bool = False) -> None:
    writer = df.write.mode("overwrite" if overwrite else "ignore")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def render_template(template: str, values: dict[str, str]) -> str:
    """Fill the placeholders {{NAME}} in one pass, so that inserted text is never filled again."""
    return re.sub(r"\{\{(\w+)\}\}", lambda m: values[m.group(1)], template)


def as_table(df: DataFrame, style: str = "markdown") -> str:
    """A small result as text: n/a for null, four decimals. Its rows go to the driver; raises beyond MOST_ROWS."""
    def cell(x):
        return "n/a" if x is None or x != x else f"{x:.4f}" if isinstance(x, float) else str(x)

    rows = [list(map(cell, r)) for r in df.limit(MOST_ROWS + 1).collect()]
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a table of more than {MOST_ROWS} rows is no text to read: write it")
    if style == "markdown":
        return "\n".join("| " + " | ".join(r) + " |" for r in [df.columns, ["---"] * len(df.columns), *rows])
    return "#table(columns: %d,\n%s\n)" % (len(df.columns), ",\n".join("  " + ", ".join(f"[{c}]" for c in r) for r in [df.columns, *rows]))
