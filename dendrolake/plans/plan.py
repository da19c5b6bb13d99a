"""A plan is a SQL text over named domain tables. Called with DataFrames it returns a DataFrame; the same
text, in another dialect, lets a second engine check the result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Dialect:
    """The few spellings in which Spark SQL and ANSI-like engines differ."""

    spark: bool

    def listagg(self, value: str, sep: str, order: str) -> str:
        return f"listagg({value}, '{sep}') WITHIN GROUP (ORDER BY {order})" if self.spark else f"string_agg({value}, '{sep}' ORDER BY {order})"

    def collect(self, value: str, order: str) -> str:
        """An ordered array of a text value, as one text."""
        return self.listagg(f"CAST({value} AS {self.text})", ",", order)

    @property
    def text(self) -> str:
        return "STRING" if self.spark else "VARCHAR"

    def idiv(self, a: str, b: str) -> str:
        return f"(({a}) div ({b}))" if self.spark else f"(({a}) // ({b}))"

    def series(self, lo: str, hi: str, name: str, source: str, keep: str) -> str:
        """Rows of `source` with its columns `keep`, once for every number lo..hi as `name`."""
        if self.spark:
            return f"SELECT {keep}, explode(sequence(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT))) AS {name} FROM {source}"
        return f"SELECT {keep}, unnest(range(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT) + 1)) AS {name} FROM {source}"

    def extract(self, value: str, pattern: str, group: int) -> str:
        return f"regexp_extract({value}, r'{pattern}', {group})" if self.spark else f"regexp_extract({value}, '{pattern}', {group})"

    def replace_all(self, value: str, pattern: str, new: str) -> str:
        return f"regexp_replace({value}, r'{pattern}', '{new}')" if self.spark else f"regexp_replace({value}, '{pattern}', '{new}', 'g')"

    def days(self, later: str, earlier: str) -> str:
        return f"CAST(datediff({later}, {earlier}) AS BIGINT)" if self.spark else f"datediff('day', {earlier}, {later})"

    def plus_days(self, date: str, n: str) -> str:
        return f"date_add({date}, CAST({n} AS INT))" if self.spark else f"CAST({date} + CAST({n} AS INTEGER) AS DATE)"

    def iso(self, date: str) -> str:
        return f"date_format({date}, 'yyyy-MM-dd')" if self.spark else f"strftime({date}, '%Y-%m-%d')"

    def hash32(self, value: str) -> str:
        """32 bits of MD5 as a number: a draw that depends on the value alone."""
        return f"CAST(conv(substring(md5({value}), 1, 8), 16, 10) AS BIGINT)" if self.spark else f"CAST('0x' || substr(md5({value}), 1, 8) AS BIGINT)"

    def expm1(self, value: str) -> str:
        """exp(value) - 1, without cancellation where the engine can."""
        return f"expm1({value})" if self.spark else f"(exp({value}) - 1)"

    def merge(self, *names: str) -> str:
        """A hint that these are met by merging, for what packed files make look small enough to be sent to every executor. Another engine needs none."""
        return f"/*+ MERGE({', '.join(names)}) */ " if self.spark else ""

    def lines(self, source: str, key: str, text: str, sep: str = "chr(10)") -> str:
        """(key, line_no, line): the parts of a text, in order."""
        if self.spark:
            return f"SELECT {key}, CAST(line_no AS BIGINT) AS line_no, line FROM (SELECT {key}, split({text}, concat('\\\\Q', {sep}, '\\\\E'), -1) AS parts FROM {source}) s LATERAL VIEW posexplode(parts) p AS line_no, line"
        return f"SELECT {key}, CAST(generate_subscripts(parts, 1) - 1 AS BIGINT) AS line_no, unnest(parts) AS line FROM (SELECT {key}, string_split({text}, {sep}) AS parts FROM {source}) s"


SPARK, ANSI = Dialect(True), Dialect(False)


@dataclass(frozen=True)
class Plan:
    name: str
    tables: tuple[str, ...]
    text: Callable[[Dialect], str]

    def __call__(self, **tables: DataFrame) -> DataFrame:
        missing = set(self.tables) - set(tables)
        if missing:
            raise ValueError(f"{self.name} needs the tables {', '.join(sorted(missing))}")
        session = next(iter(tables.values())).sparkSession
        return session.sql(self.text(SPARK), **{name: tables[name] for name in self.tables})

    def given(self, **parameters) -> Plan:
        """The same plan with other values of its parameters."""
        return replace(self, text=partial(self.text, **parameters))


def plan(*tables: str):
    """Make a Plan of a function that returns its text in a dialect."""

    def wrap(text: Callable[[Dialect], str]) -> Plan:
        return Plan(text.__name__, tables, text)

    return wrap
