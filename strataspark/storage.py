"""Tables that cut lineage: Parquet below the shared folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold while a table is written: its shuffle files go with its end, as nothing reads
#: them afterwards, and Arrow batches stay small, as texts may be long.
_SETTINGS = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",
}
#: Folders made here, by application.
_OWN: dict[str, str] = {}


#: Writers under way in each session, and what the settings were before the first of them.
_WRITERS: dict[int, tuple[int, dict[str, str | None]]] = {}
_LOCK = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a folder of our own if all runs on this machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            _OWN[application] = tempfile.mkdtemp(prefix="strataspark-")
        configured = _OWN[application]
    return configured.rstrip("/")


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Holds the settings for tables being written; threads that write in one session at a time share them."""
    conf, key = spark.conf, id(spark)
    with _LOCK:
        n, before = _WRITERS.get(key, (0, None))
        if before is None:
            before = {k: conf.get(k, None) for k in _SETTINGS}
            for k, v in _SETTINGS.items():
                conf.set(k, v)
        _WRITERS[key] = n + 1, before
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITERS[key]
            if n > 1:
                _WRITERS[key] = n - 1, before
            else:
                del _WRITERS[key]
                for k, v in before.items():
                    conf.unset(k) if v is None else conf.set(k, v)


class Workspace:
    """Names, writes and drops the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table (executor loss then costs a reread only)."""
        path = self.path(name)
        with writing(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.workspace_path = path
        return out

    def buckets(self, df: DataFrame, name: str, key: str, count: int) -> str:
        """Write ``df`` in ``count`` buckets by ``key``, each one file sorted by it; the name of the new catalog table."""
        table = f"{name}_{uuid.uuid4().hex}"
        with writing(self.spark):
            df.repartition(count, key).write.bucketBy(count, key).sortBy(key).option("path", self.path(name)).format("parquet").saveAsTable(table)
        return table

    def drop_buckets(self, table: str) -> None:
        """Delete a table that ``buckets`` wrote."""
        frame = self.spark.table(table)
        files = frame.inputFiles()
        self.spark.sql(f"drop table {table}")
        if files:
            frame.workspace_path = files[0].rsplit("/", 1)[0]
            self.drop(frame)

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.workspace_path)
            path.getFileSystem(conf).delete(path, True)
