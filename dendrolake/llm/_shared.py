"""Small helpers shared by the operators: scratch tables, source paths, word splitting."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of the result contracts, as a Java/RE2 class.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Spark's own setting for removing shuffle files when the query that made them ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Only a local session, as in tests, may do without: there one machine has all."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/dendrolake-scratch"


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, label: str, tidy: bool = False):
        """tidy: let Spark remove the shuffle files of each write, which nobody reads again; otherwise they stay until the
        driver happens to collect its garbage."""
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def cut(self, df: DataFrame, name: str, partitions: tuple[str, ...] = ()) -> DataFrame:
        """Write df and return a DataFrame that reads it back."""
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true" if self.tidy else before)
        try:
            writer = df.write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(*partitions) if partitions else writer).parquet(self.path(name))
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _at(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self, *names: str) -> None:
        """Delete tables that later steps no longer read."""
        for path, store in map(self._at, names):
            store.delete(path, True)

    def make(self, name: str) -> None:
        path, store = self._at(name)
        store.mkdirs(path)

    def move(self, name: str, to: str) -> bool:
        """Rename a folder; False where there is none."""
        (path, store), (target, _) = self._at(name), self._at(to)
        return store.exists(path) and store.rename(path, target)


def columns(df: DataFrame) -> list:
    """All columns, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text"):
    """Number of maximal runs of characters that aren't ASCII white space; null counts 0."""
    return F.expr(f"regexp_count(coalesce(`{column}`, ''), '[^\\\\x20\\\\x09-\\\\x0D]+')").cast("long")
