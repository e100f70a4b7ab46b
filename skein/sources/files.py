"""File sources and sinks of the dialogue and evaluation formats.

Readers declare their schema up front (no inference pass over 100 TB of JSON)
and keep every step a DataFrame operation. The one place that needs an order
the text source does not expose -- "line i of file A pairs with line i of file
B" (S5) -- numbers lines with ``zipWithIndex`` over the file's splits, which
is distributed and keeps file order.
"""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from skein.functions import ordered
from skein.session import checkpoint_dir

# ---- schemas of the stored formats ----
TURN_SCHEMA = T.StructType([
    T.StructField("goal", T.StringType()), T.StructField("utterances", T.ArrayType(T.StringType())),
    T.StructField("question", T.StringType()), T.StructField("query", T.StringType()),
    T.StructField("db_id", T.StringType()), T.StructField("turn_idx", T.LongType()),
])
UTTERANCE = T.StructType([T.StructField("utterance", T.StringType()), T.StructField("query", T.StringType())])
INTERACTION_SCHEMA = T.StructType([
    T.StructField("database_id", T.StringType()), T.StructField("interaction_id", T.LongType()),
    T.StructField("final", UTTERANCE), T.StructField("interaction", T.ArrayType(UTTERANCE)),
])
QUESTION_SCHEMA = T.StructType([
    T.StructField("db_id", T.StringType()), T.StructField("question", T.StringType()),
    T.StructField("query", T.StringType()),
])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never a machine-local temp dir)."""
    return os.path.join(checkpoint_dir(spark), "skein-io", f"{name}-{uuid.uuid4().hex}")


# -------------------------------------------------------------------- S2

def write_interactions(df: DataFrame, path: str, per_file: int = 512) -> None:
    """Fixture writer: JSON arrays of interaction records, at most ~``per_file`` records per file.

    Records are grouped by a hash bucket whose count grows with the data, so
    no file (and no task) holds an unbounded group.
    """
    n = df.count()
    nb = max(1, math.ceil(n / per_file))
    rec = F.to_json(F.struct("database_id", "interaction_id", "final", "interaction"))
    g = df.select(F.pmod(F.xxhash64("interaction_id"), F.lit(nb)).alias("b"), rec.alias("r")).groupBy("b").agg(
        F.concat(F.lit("["), F.array_join(F.collect_list("r"), ",\n"), F.lit("]")).alias("value"))
    g.write.partitionBy("b").mode("overwrite").text(path)


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Files holding one JSON array of dialogues -> one row per interaction."""
    return spark.read.schema(INTERACTION_SCHEMA).json(path, multiLine=True).drop("b")


# -------------------------------------------------------------------- S3

def read_questions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """S3: single-turn question files -> turn rows with ``turn_idx = 0`` and ``goal = query``."""
    q = spark.read.schema(QUESTION_SCHEMA).json(paths)
    return q.select(F.col("query").alias("goal"), F.array("question").alias("utterances"), "question", "query",
                    "db_id", F.lit(0).cast("long").alias("turn_idx"))


# ---------------------------------------------------------------- S4, S10

def write_turns_jsonl(df: DataFrame, path: str) -> None:
    """Append one JSON line per turn (history prefix included in ``utterances``)."""
    df.select(*[f.name for f in TURN_SCHEMA.fields]).write.mode("append").json(path)


def read_turns_jsonl(spark: SparkSession, glob: str) -> DataFrame:
    """Every shard of turn lines under ``glob``."""
    return spark.read.schema(TURN_SCHEMA).json(glob)


# -------------------------------------------------------------------- S5

def _numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    # part files in name order = the writer's partition order; lines keep file order across splits
    files = sorted(spark.read.text(path).inputFiles())
    rdd = spark.sparkContext.textFile(",".join(files)).zipWithIndex()
    return spark.createDataFrame(rdd, f"{name} string, line long")


def read_pairs_tsv(spark: SparkSession, gold_path: str, pred_path: str) -> DataFrame:
    """Gold ``sql<TAB>db`` lines and predictions zipped by line.

    Blank lines are dropped first (on both files), then the i-th remaining
    lines pair up; extra lines of the longer file have no partner (inner join).
    """
    def kept(p, name):
        x = _numbered_lines(spark, p, name).filter(F.trim(F.col(name)) != "")
        # renumber after dropping blanks: a global ordinal in file order, by chunks of lines
        x = ordered.global_ordinal(x, F.floor(F.col("line") / 65536), [F.col("line")], "idx")
        return x.select((F.col("idx") - 1).alias("idx"), name)
    g = kept(gold_path, "g")
    g = g.select("idx", F.substring_index("g", "\t", 1).alias("gold"),
                 F.when(F.instr("g", "\t") > 0, F.substring_index("g", "\t", -1)).alias("db_id"))
    p = kept(pred_path, "pred")
    return g.join(p, "idx").select(F.col("idx").cast("long"), "gold", "db_id", "pred")


# ---------------------------------------------------------------- S6, S11

def write_predictions(df: DataFrame, path: str, group: str, order: str, text: str) -> None:
    """One prediction per line, a blank line between dialogues (failed prediction = empty line)."""
    lines = F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t"))))
    blocks = df.groupBy(group).agg(lines.alias("l")).select(
        group, F.array_join(F.transform("l", lambda s: s["t"]), "\n").alias("value"))
    blocks.orderBy(group).select("value").write.mode("overwrite").option("lineSep", "\n\n").text(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks separated by blank lines -> (block, pos, line).

    A last block without a trailing blank line is kept (the reference drops
    it). ``block`` is the block's first line (blocks carry no id of their own).
    """
    b = spark.read.option("lineSep", "\n\n").text(path).filter(F.col("value") != "")
    b = b.select(F.split(F.regexp_replace("value", "^\n+|\n+$", ""), "\n").alias("ls"))
    return b.select(F.element_at("ls", 1).alias("block"), F.posexplode("ls").alias("pos", "line"))


# ------------------------------------------------------------------- S9

def table_head(df: DataFrame, table: str, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by ``key`` as per-column value lists (top-k, no global sort)."""
    head = df.orderBy(key).limit(n)
    cols = list(df.columns)
    kv = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(c).alias("column_name"),
                                      F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)]))
    x = head.select(F.col(key).alias("_k"), kv.alias("e"))
    g = x.groupBy("e.ord", "e.column_name").agg(F.array_sort(F.collect_list(F.struct("_k", "e.v"))).alias("l"))
    return g.select(F.lit(table).alias("table_name"), "column_name",
                    F.array_join(F.transform("l", lambda s: F.coalesce(s["v"], F.lit("NULL"))), " | ").alias("vals"))


# ---------------------------------------------------------------- S12, S13

def write_examples_json(df: DataFrame, path: str) -> None:
    """Built examples as JSON lines."""
    df.write.mode("overwrite").json(path)


def stage(spark: SparkSession, df_fn, path: str) -> DataFrame:
    """Compute a stage once and reload it when present (a written table cuts the lineage)."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:  # not there yet
        df_fn().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
