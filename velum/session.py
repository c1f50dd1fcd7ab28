"""Session helpers: shared scratch folder, spreading of inputs with few splits, top rows."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
SPREAD_TASKS = "spark.velum.spreadTasks"
_MADE: list[str] = []
_LOCAL: list[str] = []


def local_session(cpus: str | int = 8, app: str = "velum", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config(SPREAD_TASKS, str(cpus) if str(cpus).isdigit() else "0")
        # Do not record a Python stack trace for every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Only a local master without that setting gets a folder of this machine, which goes when the process
    ends. Session settings are never changed.
    """
    root = spark.conf.get(CHECKPOINT_DIR, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="velum-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``scratch_root``; ``release`` removes all of them."""
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Remove every scratch folder of this process, once the results that read them have been used."""
    while _MADE:
        remove(spark, _MADE.pop())


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder with all that is in it; one that is not there does no harm."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()).exists(at)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a result once and read it back: later steps do not repeat the work behind it,
    and a lost executor costs files to be read again instead of a scan.

    Callers select the columns that later steps need before, and no detected value unless it is one of them.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition an input that comes in fewer splits than there are cores.

    One small file has one row group and would be scanned by a single task. Whoever runs on such files
    says so by ``spark.velum.spreadTasks``; without that setting nothing is moved, whatever its size.
    """
    tasks = int(df.sparkSession.conf.get(SPREAD_TASKS, "0"))
    if df.isStreaming or tasks < 2:
        return df
    return df.repartition(tasks, *keys)  # round robin without keys


def top_n(df: DataFrame, order: Sequence[Column], n: int, slices: int = 512) -> DataFrame:
    """The first ``n`` rows in ``order``, which must be total for a reproducible result.

    Tasks are grouped into ``slices`` that are cut to ``n`` rows each (every task cuts its own rows before
    that shuffle as well), so the last step sees ``slices * n`` rows however large the table is.
    """
    position = F.row_number().over(Window.partitionBy("__slice").orderBy(*order))
    df = (
        df.withColumn("__slice", F.spark_partition_id() % slices)
        .withColumn("__position", position)
        .filter(F.col("__position") <= n)
        .drop("__slice", "__position")
    )
    return df.orderBy(*order).limit(n)
