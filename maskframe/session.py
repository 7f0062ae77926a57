"""Session settings for local runs, shared folders and checkpoints.

On a cluster bring your own session: nothing in the package needs special
settings beyond adaptive execution, which Spark turns on by default.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_PARTS_A_CORE = 4
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that a part holds at least, where a table of few rows is read in few parts.
_ROWS_A_PART = 20_000


def local_session(app: str = "maskframe", cpus: str | None = None, memory: str = "8g") -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    session = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8" if not cpus.isdigit() else cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # Big expressions are built call by call; call-site capture doubles that.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # One machine: its temporary folder is shared by all that run here.
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="maskframe-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.maskframe.scan.partitions", cpus if cpus.isdigit() else "8")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the cluster, for work that is bound by the CPU.

    A file can't be read by more tasks than it has row groups, so a table in a
    few files would keep a few cores busy, whatever its size.  It is dealt into
    a few parts for each core, not many: a task first prepares the expressions
    of a scan, which takes it about a second.  A table in that many files stays
    as it is.  The setting ``spark.maskframe.scan.partitions`` names another number.
    """
    session = df.sparkSession
    wanted = session.conf.get("spark.maskframe.scan.partitions", None)
    if wanted:
        return df.repartition(int(wanted))
    parts = _PARTS_A_CORE * session.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= parts else df.repartition(parts)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read and write: ``spark.checkpoint.dir``,
    or where that is unset a folder in the session's warehouse, shared as well."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_maskframe").rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files a job writes and reads again, removed when the session's Python ends."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(discard, spark, folder)
    return folder


def stored_in(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to a scratch folder and read back, and the folder, to `discard` once nothing reads it any more."""
    folder = scratch_folder(df.sparkSession, name)
    with without_leftovers(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.parquet(folder), folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a scratch folder and read back: for what several steps read and is dear to compute."""
    return stored_in(df, name)[0]


def remove_folder(spark: SparkSession, folder: str) -> bool:
    """Remove a folder through Spark's file systems; whether it was there."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a scratch folder; one that is gone is no error."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    with contextlib.suppress(Py4JError, OSError):  # at the end of a program the JVM may be gone already
        remove_folder(spark, folder)


@contextlib.contextmanager
def without_leftovers(spark: SparkSession) -> Iterator[None]:
    """Queries made in here drop their shuffle files as soon as they have run; else these lie on the
    disks until the driver happens to collect its garbage, those of all steps of a job together."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage through a reliable checkpoint in `shared_folder`."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    with without_leftovers(df.sparkSession):
        once = df.select("*")  # a query of its own: ``df`` may run again and then needs its files
    return once.checkpoint()


def in_few_parts(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, in no more parts than two for each core or one for every so many rows.

    A table read by several steps would start as many tasks in each as the
    shuffle that made it had, and each of them leaves its files.
    """
    parts = 2 * df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(parts, -(-rows // _ROWS_A_PART)))


def packed(df: DataFrame) -> DataFrame:
    """`materialise`, for narrow rows that several steps read: their number decides in how many parts."""
    rows = materialise(df)
    return in_few_parts(rows, rows.count())
