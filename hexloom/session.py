"""Session settings and the shared folder in which lineage is cut."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the session comes from outside."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("hexloom")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_written: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_paths: set[str] = set()
_local: list[str] = []


def _shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a local master may do without it, and gets a temporary folder."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="hexloom-checkpoint-"))
            atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
        folder = _local[0]
    return folder.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below the shared one."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written as a table to the shared folder and read from there.

    A written table has its true size in later plans. A checkpoint keeps the estimate
    of the plan that made it, which iterations multiply until planning never ends.
    """
    spark = df.sparkSession
    path = f"{_shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    _paths.add(path)
    return out


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over all cores, several tasks each: few bytes that many rows or much work come from, which would else be read or merged into one task."""
    context = df.sparkSession.sparkContext
    return df.repartition(max(4 * context.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *keys)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    _paths.discard(path)


def release(*frames: DataFrame) -> None:
    """Deletes the tables of ``frames`` that ``cut_lineage`` returned, once nothing reads them any more."""
    for df in frames:
        _delete(df.sparkSession, _written.pop(df))


def clean_up(spark: SparkSession) -> int:
    """Deletes all tables that ``cut_lineage`` has written and ``release`` has not; call it once no result reads them any more. Their number."""
    gone = sorted(_paths)
    for path in gone:
        _delete(spark, path)
    return len(gone)


#: Rows of an Arrow batch: texts of any length stand in one, and the executor and its Python worker both hold it.
BATCH_ROWS = 1024


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on sends at most ``BATCH_ROWS`` rows to Python at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df
