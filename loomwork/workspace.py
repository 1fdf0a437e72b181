"""Shared scratch space: written tables that cut lineage and survive lost executors.

Everything goes below the folder named by ``spark.checkpoint.dir``, which all
executors see.  Only a local session without that setting (as in tests) gets a
temporary folder of its own.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder for written tables; a local session without the setting gets its own."""
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="loomwork-")
        atexit.register(shutil.rmtree, _own, ignore_errors=True)
    return _own


class Workspace:
    """One operator run's folder below the shared root."""

    def __init__(self, spark: SparkSession, name: str, codec: str = "snappy"):
        self.spark, self.codec = spark, codec
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def at(self, name: str) -> str:
        return f"{self.path}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return the written table."""
        df.write.mode("overwrite").option("compression", self.codec).parquet(self.at(name))
        return self.load(name, df)

    def load(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.at(name))

    def drop(self, *names: str) -> None:
        """Delete intermediate tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.at(name))
            path.getFileSystem(conf).delete(path, True)
