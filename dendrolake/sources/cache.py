"""Results of files, kept until the file or the settings change."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class ResultCache:
    """A folder of tables, one for each source, analysis and settings, named by the source's path and a digest of its last change, length and
    settings. A hit reads the table and no source. A result is written under a name of its own and then renamed, so that nobody reads half
    of one; results of earlier versions of the source go when a new one is there."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _state(self, source: str) -> list:
        """Path, last change and length of a file; of all files below for a folder."""
        path, store = self._at(source)
        status = store.getFileStatus(path)
        if not status.isDirectory():
            return [status.getPath().toString(), status.getModificationTime(), status.getLen()]
        files, found = store.listFiles(path, True), []
        while files.hasNext():
            f = files.next()
            found.append([f.getPath().toString(), f.getModificationTime(), f.getLen()])
        return [status.getPath().toString(), *sorted(found)]

    def names(self, source: str, analysis: str, settings: dict) -> tuple[str, str]:
        """The name of a source's analysis under its settings, whatever its version, and of this version of it."""
        state = self._state(source)
        digest = [hashlib.sha256(json.dumps(x, sort_keys=True, default=str).encode()).hexdigest()[:32] for x in ([state[0], analysis, settings], state)]
        return digest[0], f"{digest[0]}-{digest[1]}"

    def get(self, source: str, analysis: Callable[..., DataFrame], **settings) -> DataFrame:
        """analysis(spark, source, **settings), or its result from before."""
        family, name = self.names(source, f"{analysis.__module__}.{analysis.__qualname__}", settings)
        done, store = self._at(f"{self.folder}/{name}")
        if not store.exists(done):
            part = f"{self.folder}/part-{uuid.uuid4().hex}"
            analysis(self.spark, source, **settings).write.parquet(part)
            written, _ = self._at(part)
            if not store.rename(written, done):
                store.delete(written, True)  # another run was faster
            for x in store.listStatus(self._at(self.folder)[0]):
                if x.getPath().getName().startswith(f"{family}-") and x.getPath().getName() != name:
                    store.delete(x.getPath(), True)
        return self.spark.read.parquet(f"{self.folder}/{name}")
