"""Session defaults and reliable materialisation."""
from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own settings."""
    n = 8 if cores == "*" else int(cores)
    return (
        SparkSession.builder.master(f"local[{cores}]").appName("edgeloom")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def plan_by_memory(spark: SparkSession) -> None:
    """Let Spark take written tables for eight times their files, as far as the session leaves this at its default.

    Files are compressed: without it a join side of some million rows passes for small and is sent whole through the driver.  Sides that turn out
    small at run time are still broadcast.
    """
    if float(spark.conf.get("spark.sql.sources.fileCompressionFactor", "1.0")) == 1.0:
        spark.conf.set("spark.sql.sources.fileCompressionFactor", "8.0")


def bound_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Let Spark hand whole texts to Python by at most ``rows`` at a time, as far as the session leaves this at its default of 10,000.

    A batch stands once outside the JVM's heap and twice in the Python worker, which the texts of 10,000 rows do not fit well.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) == 10_000:
        spark.conf.set(name, str(rows))


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder as Spark names it, with scheme and authority."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """Folder that survives a lost executor: the one the cluster names, a temp folder only in local mode.

    One folder a session: calling again gives the same one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if named:
        if current is None or not current.startswith(_qualified(spark, named) + "/"):
            context.setCheckpointDir(named)
    elif current is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    The table outlives lost executors, is read column by column, and carries its true size, so later
    joins are planned on facts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that ``materialize`` wrote, once all that reads them is written itself; anything else is left alone."""
    for table in tables:
        path = getattr(table, "table_path", None)
        if path is not None:
            spark = table.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
