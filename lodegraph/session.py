"""Sessions: settings for tests and benches, and this package on the workers."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch for Python, so that long texts don't add up; set only where the session leaves it open.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Partitions that rows are shuffled to before Spark joins small ones, and up to what size it does, where the session leaves that open:
#: one for each ``SHARE`` bytes of a table, and 8 MB, as sorts of rows hold twenty times what is shuffled.
INITIAL, SHARE, MOST = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", 2 << 20, 4096
JOINED, JOINED_SIZE = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m"
#: Whether Spark removes what was shuffled for a table once that table is written.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_shipped: set[str] = set()
_dealt: dict[str, int] = {}


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: it is sent to them once for an application."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(4 << 20))
    app, home = spark.sparkContext.applicationId, Path(__file__).parent
    if app in _shipped or not home.is_dir():
        return
    _shipped.add(app)
    target = Path(tempfile.mkdtemp()) / f"{home.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    spark.sparkContext.addPyFile(str(target))


def deal(spark: SparkSession, path: str) -> None:
    """Let shuffles have more partitions as the table at ``path`` grows, so that the rows of a task, which it sorts, don't grow with it.

    A partition for each ``SHARE`` bytes of the files, never fewer than the session says; small ones are joined by Spark at run time.
    """
    if spark.conf.get(JOINED, None) is None:
        spark.conf.set(JOINED, JOINED_SIZE)
    app, told = spark.sparkContext.applicationId, spark.conf.get(INITIAL, None)
    if told is not None and int(told) != _dealt.get(app):
        return
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    n = max(min(size // SHARE, MOST), int(told or 0))
    if n > max(int(told or 0), int(spark.conf.get("spark.sql.shuffle.partitions"))):
        _dealt[app] = n
        spark.conf.set(INITIAL, str(n))


def local(cpus: int = 8, memory: str = "20g") -> SparkSession:
    """A local session for benches."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("lodegraph")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: ``spark.checkpoint.dir``. Where that is unset, a local master gets a local folder,
    and any other an error, as executors elsewhere could not read what one of them wrote."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        told = spark.conf.get("spark.checkpoint.dir", None)
        if told is None and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors see")
        sc.setCheckpointDir(told or tempfile.mkdtemp())
    return sc.getCheckpointDir()


@contextmanager
def cleaned(spark: SparkSession):
    """What is shuffled for tables that are written in here is removed once they are: they are read from then on, and nothing reads the
    shuffles again. Spark would leave them on disk until the driver collects garbage."""
    told = spark.conf.get(CLEANED, None)
    spark.conf.set(CLEANED, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANED) if told is None else spark.conf.set(CLEANED, told)


def kept(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` computed once, its rows read back from a new table in the shared folder, and where that is.

    Tables are Parquet: a checkpoint keeps rows as serialized objects, not compressed and not by column.
    """
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and forget how: its rows are kept in the shared folder, which outlives executors."""
    return kept(df)[0]


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables that ``kept`` has made, once nothing reads them any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
