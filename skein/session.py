"""Session helpers: building a session, loading the star tables, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "skein") -> SparkSession:
    """Session with the settings the library assumes (AQE on, UTC, no UI).

    On a cluster the master and partition count come from spark-submit; the
    defaults here are for local runs and tests.
    """
    master = master or os.environ.get("SKEIN_MASTER", "local[8]")
    parts = shuffle_partitions or int(os.environ.get("SKEIN_SHUFFLE_PARTITIONS", "8"))
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SKEIN_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one stored table (parquet; filters and projections push down)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazy attribute access to the stored tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return read_table(self.spark, self.sf_dir, name)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    A cluster names it in ``spark.checkpoint.dir``; we only choose our own
    folder when the session has none (local runs and tests).
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not conf and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not conf:
        conf = tempfile.mkdtemp(prefix="skein-ckpt-")
        spark.conf.set("spark.checkpoint.dir", conf)
    spark.sparkContext.setCheckpointDir(conf)
    return spark.sparkContext.getCheckpointDir() or conf


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Lineage cut as Parquet in the shared checkpoint folder: compressed, and of known size, so that the planner
    broadcasts a small result."""
    spark, schema = df.sparkSession, df.schema
    path = f"{checkpoint_dir(spark)}/skein-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def by_key(df: DataFrame, *cols: str, rows_per_part: int | None = None) -> DataFrame:
    """Hash-partition by ``cols`` into the session's shuffle-partition count.

    With ``rows_per_part`` the rows are counted first and more partitions are
    taken where that many rows a partition ask for it.

    An explicit count keeps AQE from coalescing the exchange into a few tasks
    (the per-key window work after it is CPU-bound); on a cluster the count is
    whatever ``spark.sql.shuffle.partitions`` says.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    if rows_per_part:
        n = max(n, -(-df.count() // rows_per_part))
    return df.repartition(n, *cols)
