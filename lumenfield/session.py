"""Session helpers: one place for session defaults, the shared folder and shipping of the package to workers."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", **extra: str) -> SparkSession:
    """A local session with the defaults the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumenfield")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``; only where that is unset, as in tests, a local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = known.get() if known.isDefined() else None
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="lumenfield-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is removed when the application ends, or by ``release``."""
    context = spark.sparkContext
    folder = getattr(context, "_lumenfield_folder", None)
    if not folder:
        folder = f"{shared_folder(spark).rstrip('/')}/lumenfield-{context.applicationId}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        context._lumenfield_folder = folder
    return folder


def release(spark: SparkSession) -> None:
    """Remove all tables ``written`` so far; no data frame made of them may be read afterwards."""
    context = spark.sparkContext
    if getattr(context, "_lumenfield_folder", None):
        path = context._jvm.org.apache.hadoop.fs.Path(context._lumenfield_folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as a table into the shared folder and read that table.

    Unlike a cached or locally checkpointed frame the table survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table is broadcast up to this many bytes of files and rows; what is beyond is shuffled.
BROADCAST_BYTES = 16 << 20
BROADCAST_ROWS = 200_000


def sized(table: DataFrame) -> DataFrame:
    """A written table, hinted for broadcast if the bytes of its files and its counted rows allow that."""
    spark = table.sparkSession
    bytes_ = 0
    for name in table.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        bytes_ += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
        if bytes_ > BROADCAST_BYTES:
            return table
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, also where the driver found it through ``sys.path`` alone."""
    context = spark.sparkContext
    if getattr(context, "_lumenfield_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            archive.write(path, str(path.relative_to(PACKAGE.parent)))
    target = os.path.join(tempfile.mkdtemp(prefix="lumenfield-"), "lumenfield.zip")
    Path(target).write_bytes(buffer.getvalue())
    context.addPyFile(target)  # served by the driver to every executor
    context._lumenfield_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
