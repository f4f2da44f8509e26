"""Sessions, input tables and tables kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import os
import pathlib
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used where a session on one machine, as in tests, names no spark.checkpoint.dir.
LOCAL_CHECKPOINT_DIR = "/tmp/strandmill-checkpoints"

_shipped: set[str] = set()

#: Folders of kept tables, with their session and what tells whether a plan still reads them.
_kept: dict[str, tuple[SparkSession, object]] = {}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session on this machine, for tests, the bench and the command line."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("strandmill")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # finding the caller of each expression takes longer than small queries
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str, tasks: int = 0) -> DataFrame:
    """One of the test tables; Catalyst prunes its columns and pushes filters into the scan.

    ``tasks``: rows of a table with fewer splits than this are dealt round robin to so
    many partitions, for work that is slow by row, as tokenizing is.  A table of more
    splits is read as it lies, never shuffled.
    """
    ship(spark)
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return found.repartition(tasks) if tasks and found.rdd.getNumPartitions() < tasks else found


def ship(spark: SparkSession) -> None:
    """Lets the session's Python workers import this package, wherever the driver found it; once a session.

    Local workers are told its folder; executors elsewhere get it as an archive from the driver.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    package = pathlib.Path(__file__).resolve().parent.parent
    context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(package.parent), context.environment.get("PYTHONPATH")]))
    if not on_one_machine(spark):
        folder = tempfile.mkdtemp(prefix=package.name)  # the driver's own; executors fetch the file from it
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = f"{folder}/{package.name}.zip"
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
            for path in sorted(package.rglob("*.py")):
                z.write(path, path.relative_to(package.parent))
        context.addPyFile(archive)


def on_one_machine(spark: SparkSession) -> bool:
    """Whether the session's tasks run in the driver's process."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    A session on one machine that names none gets a local folder; on a cluster that is
    an error, as each executor would write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not on_one_machine(spark):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or LOCAL_CHECKPOINT_DIR).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/strandmill-{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once into the shared folder and reads it back.

    Cuts lineage in a way that survives the loss of executors, and gives every later
    reader the same rows.  For its life see tend().
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return tend(df.sparkSession.read.schema(df.schema).parquet(path), path)


def tend(df: DataFrame, path: str) -> DataFrame:
    """``df``, which reads ``path``; the folder goes when no plan reads it any more.

    That is seen when the next table is kept, as with checkpoints that Spark cleans.
    scratch() removes tables at once, and the end of the driver's Python all.
    """
    sweep()
    spark = df.sparkSession
    relation = df._jdf.queryExecution().analyzed().relation()  # all plans that read the table hold this object
    if not _kept:
        atexit.register(_forget_all)
    _kept[path] = (spark, spark.sparkContext._jvm.java.lang.ref.WeakReference(relation))
    return df


def sweep() -> None:
    """Removes kept tables that no plan reads any more."""
    for path, (_, relation) in list(_kept.items()):
        try:
            gone = relation.get() is None
        except Exception:
            gone = True  # its session has ended
        if gone:
            forget(path)


@contextmanager
def scratch() -> Iterator[None]:
    """Removes the tables kept inside the block at its end; results must be written or collected inside."""
    before = set(_kept)
    try:
        yield
    finally:
        for path in set(_kept) - before:
            forget(path)


def forget(path: str) -> None:
    """Removes a kept table."""
    spark, _ = _kept.pop(path, (None, None))
    if spark is not None:
        remove(spark, path)


def _forget_all() -> None:
    for path in list(_kept):
        forget(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder with all it holds."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:
        pass  # the session has ended; the folder's owner clears it
