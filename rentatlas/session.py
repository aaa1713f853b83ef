"""Session settings the jobs rely on, and lineage cuts to shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Only settings a cluster may not already carry; sizes stay with the cluster.
REQUIRED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Generated methods beyond this size are never compiled to machine code by the JVM; the wide
    # listing projections then run faster outside whole-stage code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


@contextmanager
def required_conf(spark: SparkSession) -> Iterator[SparkSession]:
    """The settings above for the time of a job; the caller's own come back afterwards."""
    before = {key: spark.conf.get(key, None) for key in REQUIRED_CONF}
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    try:
        yield spark
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    A machine-local folder is only used where nothing is configured and the master is local.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="rentatlas-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


class Staging:
    """Tables written to the shared folder for the time of a job, and removed with it.

    Everything downstream of a staged table starts from files, so a lost executor costs only its
    own tasks.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = os.path.join(shared_dir(spark), f"rentatlas-{uuid.uuid4().hex}")

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *error: object) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def stage(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> DataFrame:
        path = os.path.join(self.root, name)
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
