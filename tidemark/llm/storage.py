"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only for a local master without one, where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    found = found or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Rows of a table of ids and numbers (some 100 bytes each) that one task may hold.
ONE_TASK = 50_000


#: Bytes of one batch of texts on its way to Python, where the session has Spark's own limit (64 MB).
BATCH, SPARKS_BATCH = "4194304b", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Texts are passed to Python in smaller batches than Spark's: a worker's memory follows the batch.

    Plans run after they are made, so the session keeps the setting; one that was set to another size stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == SPARKS_BATCH:
        spark.conf.set(name, BATCH)


@contextmanager
def batches_of(spark: SparkSession, size: str) -> Iterator[None]:
    """Plans that run inside pass at most about ``size`` bytes to Python at a time; the session's own limit comes back after."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, own)


class Scratch:
    """Tables written once and read again: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
        self.made = 0
        small_batches(spark)

    def put(self, df: DataFrame, compression: str | None = None) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Remove tables that no later plan reads."""
        for table in tables:
            if path := getattr(table, "_scratch_path", None):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


    def gather(self, df: DataFrame) -> DataFrame:
        """``put``, but a table of at most ``ONE_TASK`` rows comes back as one partition, so that the steps on it need no shuffle."""
        out = self.put(df)
        if out.count() > ONE_TASK:
            return out
        one = out.coalesce(1)
        one._scratch_path = out._scratch_path
        return one

    def sweep(self) -> None:
        """Let Spark remove the shuffle files of plans that have ended: it does so once the driver has collected them."""
        self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
