"""Tables in the folder that the cluster shares, where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh name in the folder of spark.checkpoint.dir; in one of our own only where none is named and one machine is all there is."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        at = "file://" + tempfile.mkdtemp(prefix="moodweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


#: Tables of fewer bytes are left as they are read; larger ones than this a core have parts enough for all.
LEAST_SPREAD, MOST_SPREAD = 4 << 20, 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """A table of few files dealt to all cores, as a file may be one row group, which one task reads; others as they are.

    Only what is small beside the cluster's memory is ever shuffled for this, so it costs nothing at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(2 * cores) if LEAST_SPREAD <= size < cores * MOST_SPREAD and len(df.inputFiles()) < cores else df


def settle(df: DataFrame, label: str) -> DataFrame:
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, row_bytes: int = 64) -> bool:
    """Whether df's rows, of about row_bytes each, stay within the size up to which Spark broadcasts by itself."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(limit[-1:], 1)
    most = int(limit.rstrip("kmg")) * unit // row_bytes
    return most > 0 and df.limit(most + 1).count() <= most
