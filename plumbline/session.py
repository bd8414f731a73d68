"""Session helpers: local sessions for tests, and lineage cuts on shared storage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.config import LOOKUP_BYTES, LOOKUP_ROWS

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, app: str = "plumbline") -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PLUMBLINE_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only where nothing is configured and the master is local is a temporary
    folder used; on a cluster a machine-local folder would be lost with its
    executor, so that case is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = _file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Parquet rather than ``checkpoint()`` because later passes read few columns.
    A lost executor only costs a re-read: the lineage starts at the files.  The
    shuffle files of the job go with it; the table goes with ``release`` or when
    the driver ends, whichever is first.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    fs, at = _file_system(spark, path)
    kept = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    except Exception:
        fs.delete(at, True)
        raise
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these tables, when nothing reads it any more."""
    for t in tables:
        if path := getattr(t, "_scratch", None):
            release_path(t.sparkSession, path)


def release_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_path`` has named."""
    fs, at = _file_system(spark, path)
    fs.delete(at, True)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def bounded(df: DataFrame, limit: int = LOOKUP_ROWS, most_bytes: int = LOOKUP_BYTES) -> tuple[DataFrame, bool]:
    """``(df, True)`` as a local relation when it has at most ``limit`` rows of ``most_bytes`` in all.

    Where a column's values have no fixed width, rows and bytes are counted before
    any row reaches the driver, so the ``True`` case is a proven bound and safe to
    broadcast; otherwise the input comes back untouched.
    """
    wide = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    if wide:
        size = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in wide), F.lit(0).cast("long"))
        facts = df.limit(limit + 1).agg(F.count(F.lit(1)).alias("rows"), F.sum(size).alias("bytes")).first()
        if facts["rows"] > limit or (facts["bytes"] or 0) > most_bytes:
            return df, False
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True
