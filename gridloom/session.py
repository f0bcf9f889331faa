"""Session settings and tables staged in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def local_session(cpus: int = 8, partitions: int = 8, app: str = "gridloom") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where that is unset and all executors are on this machine."""
    place = spark.conf.get("spark.checkpoint.dir", "")
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


#: With it, a query's shuffle files go when the query has ended; without, when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_deleted(spark: SparkSession):
    """What is written here is read from its files afterwards, so its shuffles have served."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def _file_system(df: DataFrame, path: str):
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()), where


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridloom-{name}-{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


EACH, LEAST = 4 << 20, 12  # bytes of staged tables to a task; tasks


def stored(*tables: DataFrame | None) -> int:
    """Bytes of staged tables; 0 for others."""
    total = 0
    for df in tables:
        if path := getattr(df, "staged_at", None):
            store, where = _file_system(df, path)
            total += store.getContentSummary(where).getLength()
    return total


def fewer(df: DataFrame, size: int) -> DataFrame:
    """df in no more partitions than its size in bytes is worth: shuffles of small tables by many partitions are mostly tasks without rows."""
    return df.coalesce(max(LEAST, -(-size // EACH)))


def unstaged(*tables: DataFrame | None) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "staged_at", None)
        if path:
            store, where = _file_system(df, path)
            store.delete(where, True)


#: Files whose names are broadcast to number rows by their place in them.
MOST_FILES = 200_000


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df with a number of each row, which rows keep whatever their ids are, also when a task runs again.

    Rows of Parquet files that df reads as they are have it from their file and their place in it; any others,
    and those of very many files, are staged with one."""
    if df._jdf.queryExecution().analyzed().nodeName().startswith("LogicalRelation"):
        rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
        files = staged(rows.select("_file").distinct().withColumn("_no", F.row_number().over(Window.orderBy("_file"))), "files")
        if files.count() <= MOST_FILES:
            return rows.join(F.broadcast(files), "_file").withColumn(name, F.col("_no") * F.lit(1 << 40) + F.col("_place")).select(*df.columns, name)
    return staged(df.withColumn(name, F.monotonically_increasing_id()), "numbered")
