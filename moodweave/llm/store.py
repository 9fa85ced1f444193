"""Reading inputs, and cutting lineage through the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..storage import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of few files is dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where none is named and one machine holds driver and executors."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        named = "file://" + tempfile.mkdtemp(prefix="moodweave-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


#: Bytes of a batch that goes to a Python worker, where the session leaves Spark's default of 64 MB.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let batches be bounded by few bytes: texts pass through the JVM's and the worker's memory several times over, and a batch of
    ten thousand of them would be held in each."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, "64m").lower().rstrip("b") in ("67108864", "64m"):
        spark.conf.set(name, str(BATCH_BYTES))


#: Rows that Parquet is decoded in at a time, where the session leaves Spark's default of 4,096.
BATCH_ROWS = 256


def short_reads(spark: SparkSession) -> None:
    """Let Parquet be decoded a few rows at a time: the texts of a batch fill one array of the JVM, which is doubled as it grows, and
    these arrays make an executor's heap grow far beyond what is in use."""
    name = "spark.sql.parquet.columnarReaderBatchSize"
    if spark.conf.get(name, "4096") == "4096":
        spark.conf.set(name, str(BATCH_ROWS))


_made: list[tuple[str, str]] = []


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and the planner knows the true size."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    _made.append((spark.sparkContext.applicationId, path))
    return out


def sweep(spark: SparkSession) -> int:
    """Remove all tables that this application has settled; results that still read them must have been written or collected."""
    mine = [p for app, p in _made if app == spark.sparkContext.applicationId]
    for path in mine:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made[:] = [x for x in _made if x[1] not in mine]
    return len(mine)


def is_small(df: DataFrame, row_bytes: int = 48) -> bool:
    """Whether df's rows, of about row_bytes each, stay within the size up to which Spark broadcasts by itself."""
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760").lower().removesuffix("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(limit[-1:], 1)
    most = int(limit.rstrip("kmg")) * unit // row_bytes
    return most > 0 and df.limit(most + 1).count() <= most


def discard(df: DataFrame) -> None:
    """Remove a settled table that nothing will read again."""
    path = getattr(df, "_settled_at", None)
    if path:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df (in any case) has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
