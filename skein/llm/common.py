"""Shared helpers of the training-data operators: inputs, scratch folders, row identities, partition counts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One stored table; only Spark opens the path, so any Hadoop file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: ``spark.checkpoint.dir`` of the session, or its context's checkpoint folder.

    Only on a local master that names none (local runs and tests) a folder of our own is set; elsewhere that is an error.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not conf:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="skein-shared-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Lineage cut: write ``df`` as Parquet under the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have (Spark tells names apart without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows, unless the session says otherwise: texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, "1000")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, doc_id, text): null text is empty; rid identifies the row by id and content.

    Other columns of the input are left behind, so clashing names cannot matter. Fully repeated rows
    share a rid and get the same result; rows that share an id but not the text stay apart.
    """
    base = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file, from ``SKEIN_TOKENIZERS`` or the installed package."""
    root = os.environ.get("SKEIN_TOKENIZERS")
    if root:
        return os.path.join(root, name)
    import public_tokenizers
    return public_tokenizers.path(name)
