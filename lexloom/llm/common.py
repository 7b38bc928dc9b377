"""What the corpus operators share: tables in the shared folder and input columns."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders for sessions that name none (tests on one machine), by application id.
_OWN: dict[str, str] = {}

#: Folders of this process's operator calls, for release().
_ROOTS: list[str] = []

#: Whether a finished query's shuffle files are deleted at once.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of a batch of rows on its way to Python, and Spark's setting for it.
BATCH_BYTES = 1 << 21
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

#: ASCII letters only, as the contracts ask; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Only a session without that setting (a test on one machine) gets a folder of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        folder = tempfile.mkdtemp(prefix="lexloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = f"file://{folder}"
    return _OWN[app]


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends rows to Python in batches of about BATCH_BYTES, a longer row alone; a lower bound stays.

    A batch is held whole, several times over, by the executor's JVM outside its heap and by the worker; Spark's own bound is far above
    what a task of ordinary size reads.  The bound is the session's, since Spark reads it when a plan runs, which may be the caller's doing.
    """
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


class Workspace:
    """Tables that one operator call writes to cut lineage; they outlive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lexloom-{name}-{uuid.uuid4().hex[:12]}"
        _ROOTS.append(self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet and reads it back, so that nothing upstream runs twice.

        Its shuffles are done with once it is written; Spark is told to delete their files then, and not at some later collection.
        """
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(_CLEANUP, None)
        conf.set(_CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Removes a table that no pending plan reads any more."""
        _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Removes what operator calls of this process have written; their results must have been used by then."""
    while _ROOTS:
        _delete(spark, _ROOTS.pop())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def whole_text(text: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
