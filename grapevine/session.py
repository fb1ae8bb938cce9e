"""Session settings and the shared folder for tables that a run writes on its way."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(
    master: str | None = None, shuffle_partitions: int | None = None, memory: str = "12g"
) -> SparkSession:
    """A session with the settings the library is tuned for; on a cluster pass no master.

    ``memory`` is for a local session, where the driver does all the work; on a cluster the
    submitting command sets memory.
    """
    builder = SparkSession.builder.appName("grapevine")
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", memory)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS_A_BATCH = 1000


def use_small_batches(spark: SparkSession) -> None:
    """From now on Spark hands at most ``TEXTS_A_BATCH`` rows at a time to Python.

    Ten thousand texts, Spark's own number, are some 50 MB: an executor holds them outside its heap on the way to
    a worker and back, for every task, and keeps a part of that memory. A smaller number that is set stays.
    """
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= TEXTS_A_BATCH:
        spark.conf.set(ARROW_ROWS, str(TEXTS_A_BATCH))


_trial: list[str] = []


def use_trial_folder(spark: SparkSession) -> None:
    """For tests and trials on one machine: a temporary folder, removed at exit, where no shared one is set."""
    if spark.conf.get("spark.checkpoint.dir", None) or _trial:
        return
    if not spark.conf.get("spark.master", "").startswith("local["):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
    _trial.append(tempfile.mkdtemp(prefix="grapevine-"))
    atexit.register(shutil.rmtree, _trial[0], ignore_errors=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    It is required, because a machine's own disk is lost with the machine; only
    ``use_trial_folder`` stands in for it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or next(iter(_trial), None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")


class Workspace:
    """Tables written by one run under its own subfolder of the shared folder.

    ``keep`` cuts the lineage of a frame that several later steps read: the steps then scan
    only the columns they need, the optimizer knows the true size, and a lost executor
    costs a re-read instead of a recomputation.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = f"{(folder or shared_folder(spark)).rstrip('/')}/grapevine-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def keep(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """The written frame. ``files``, for a table known to be small, is the number of files it is dealt over
        in place of one for each partition: a file costs a task, and on a local disk two processes for its mode."""
        path = self.path(f"{name}-{uuid.uuid4().hex[:8]}")
        df = df.repartition(files) if files else df
        df.write.mode("errorifexists").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
