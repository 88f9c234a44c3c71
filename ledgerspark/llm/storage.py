"""Tables written to the folder that the cluster shares, to cut lineage and to read a result more than once."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of this machine only where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='ledgerspark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


class Scratch:
    """Intermediate tables of one operator call. finish() writes the result and deletes the others."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_folder(spark)}/ledgerspark-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """df written as Parquet and read again. Losing an executor later does not lose it."""
        path = f"{self.base}/{len(self.paths)}"
        if not self.paths:  # where the operator fails, what it wrote goes too
            atexit.register(_forget, self.spark, self.base)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        """A folder for files that tasks write themselves; it goes when Python ends."""
        atexit.register(_forget, self.spark, self.base)
        return f"{self.base}/{name}"

    def drop(self) -> None:
        """Deletes every table kept so far."""
        for path in self.paths:
            _delete(self.spark, path)
        self.paths = []

    def leave(self, df: DataFrame) -> DataFrame:
        """The result as a plan that still reads tables kept here, for results as large as the texts; they go when Python ends."""
        atexit.register(_forget, self.spark, self.base)
        return df

    def finish(self, df: DataFrame) -> DataFrame:
        """The result as a written table; the intermediate tables go. The result goes when Python ends."""
        path = f"{self.base}/result"
        df.write.parquet(path)
        self.drop()
        atexit.register(_forget, self.spark, self.base)
        return self.spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _forget(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        _delete(spark, path)
