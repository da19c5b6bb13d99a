"""Cutting the lineage of what a loop builds step by step: tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Files as large as their rows, for tables whose size must be told from their files.
PLAIN = {"compression": "none", "parquet.enable.dictionary": "false"}


def _path(session: SparkSession, label: str) -> str | None:
    folder = session.conf.get("spark.checkpoint.dir", None) or session.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not session.sparkContext.master.startswith("local"):
            return None
        folder = f"file://{tempfile.gettempdir()}/dendrolake-levels"  # one machine has all
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def _written(df: DataFrame, label: str, *partitions: str, **options: str) -> DataFrame:
    path = _path(df.sparkSession, label)
    if not path:
        return df
    writer = df.write.options(**options)
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def cut(df: DataFrame) -> DataFrame:
    """df as a table in that folder (spark.checkpoint.dir), so that later steps neither plan nor compute it again. Without such a folder a
    local session has a temporary one, and on a cluster df is as it is."""
    return _written(df, "cut")


def sized(df: DataFrame) -> DataFrame:
    """The same, with files as large as the rows are in memory. For narrow tables of regular values, such as numbered nodes: packed files would make them
    look small enough to be sent to every executor."""
    return _written(df, "cut", **PLAIN)


class Pieces:
    """A table made piece by piece, with the columns of the first: each can be read once it is there, and all of them as one scan."""

    def __init__(self):
        self.parts: list[DataFrame] = []
        self.paths: list[str] = []

    def add(self, df: DataFrame) -> DataFrame:
        session = df.sparkSession
        if self.parts:
            df = df.select(*(df[f.name].cast(f.dataType).alias(f.name) for f in self.parts[0].schema))
        path = _path(session, "piece")
        if path:
            df.write.parquet(path)
            self.paths.append(path)
            df = session.read.schema(df.schema).parquet(path)
        self.parts.append(df)
        return df

    def table(self) -> DataFrame:
        if self.paths:
            return self.parts[0].sparkSession.read.schema(self.parts[0].schema).parquet(*self.paths)
        out = self.parts[0]
        for x in self.parts[1:]:
            out = out.unionByName(x)
        return out


def by_level(df: DataFrame, column: str) -> DataFrame:
    """The same with a part for each value of column, so that reading one value reads its rows alone."""
    return _written(df, "levels", column)
