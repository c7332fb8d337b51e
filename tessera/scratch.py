"""Tables between steps, in the folder that all machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder that the driver and all executors can reach.

    It lies in ``spark.checkpoint.dir``. Where that setting is missing, a machine-local
    temporary folder is taken and set if the master is local, and else a ValueError raised."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or "local-cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str, compression: str = "zstd") -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    return _written(df, shared_dir(df.sparkSession, purpose), compression)


def _written(df: DataFrame, path: str, compression: str) -> DataFrame:
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables in the shared folder that are deleted once their last reader has run."""

    def __init__(self) -> None:
        self._held: list[tuple[DataFrame, str]] = []

    def stored(self, df: DataFrame, purpose: str, compression: str = "zstd") -> DataFrame:
        path = shared_dir(df.sparkSession, purpose)
        table = _written(df, path, compression)
        self._held.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these tables; without any, all."""
        gone = lambda table: not tables or any(table is t for t in tables)
        for table, path in self._held:
            if gone(table):
                where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
        self._held = [(t, path) for t, path in self._held if not gone(t)]
