"""Session helpers: a local session for tests, and tables that cut lineage in a folder all executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, weakref.ref] = {}
_shipped: set[str] = set()


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine; an existing session is returned unchanged."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("COOTIDE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and the master is this machine, a temporary one.

    On several machines such a folder would lose data silently, so there it raises instead.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        else:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = "file://" + tempfile.mkdtemp(prefix="cootide-")
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _remove(path: str) -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, *, lean: bool = False, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The result has no lineage beyond files every executor can read, so a lost executor costs only the tasks it
    ran, and later plans see true sizes. ``release`` drops the files early; the rest goes at exit. ``lean`` compresses
    more and deletes the shuffle files of ``df`` once it is written, ``by`` gives each value of a column its own folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cootide-{uuid.uuid4().hex}"
    if lean:
        before = spark.conf.get(_DROP_SHUFFLES)
        spark.conf.set(_DROP_SHUFFLES, "true")
        try:
            writer = df.write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(by) if by else writer).parquet(path)
        finally:
            spark.conf.set(_DROP_SHUFFLES, before)
    else:
        (df.write.mode("overwrite").partitionBy(by) if by else df.write.mode("overwrite")).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[path] = weakref.ref(spark)
    out._cootide_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a materialized DataFrame that no later plan reads."""
    path = getattr(df, "_cootide_path", None)
    if path and _written.pop(path, None) is not None:
        _remove(path)


@atexit.register
def _release_all() -> None:
    for path in list(_written):
        try:
            _remove(path)
        except Exception:  # the session may be gone already
            pass
    _written.clear()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, unless their Python path holds it already."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if sc.applicationId in _shipped or home in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.getcwd() == home:
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="cootide-"), "cootide"), "zip", home, "cootide")
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
