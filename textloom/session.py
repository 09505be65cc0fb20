"""Session defaults, shared scratch tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings used for sessions that this package opens itself; a session that is handed in keeps its own.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}

#: Rows of one 8-byte key that may be broadcast (about 64 MB in a hash relation); above it a shuffle join is used.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Bytes of a row group of scratch tables, so that no task that reads them back has to take a large file whole.
SCRATCH_BLOCK = 16 << 20


def open_session(app: str = "textloom", master: str | None = None, partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = DEFAULTS | {"spark.sql.shuffle.partitions": str(partitions)} | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, so that they need no installation of it."""
    context = spark.sparkContext
    if getattr(context, "_textloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="textloom-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = Path(folder) / "textloom.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as file:
        for path in sorted(root.rglob("*.py")):
            file.write(path, Path(root.name) / path.relative_to(root))
    context.addPyFile(str(archive))
    context._textloom_shipped = True


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``. Where that is unset, a local session, whose
    executors are this machine, gets a folder of its own; a cluster is refused, as executors could not read each other's
    disks."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
        atexit.register(shutil.rmtree, folder[len("file://"):], ignore_errors=True)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage is cut and a lost executor loses nothing."""
    path = f"{scratch_dir(df.sparkSession)}/textloom/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("parquet.block.size", SCRATCH_BLOCK).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many tasks as there are cores where it has fewer, as a small file is one task however much work its
    rows are; else as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_enough(df: DataFrame, limit: int = BROADCAST_ROWS, limit_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``limit`` rows, counting no further than one row past the limit, and at most
    ``limit_bytes`` by its schema's row size, texts and arrays as Spark reckons them."""
    count = df.limit(limit + 1).count()
    width = int(df._jdf.schema().defaultSize()) + 8
    return count <= limit and count * width <= limit_bytes


def join_checked(left: DataFrame, right: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join that broadcasts ``right`` only after its size was checked, else leaves the choice to Spark."""
    return left.join(F.broadcast(right) if small_enough(right, limit) else right, on, how)
