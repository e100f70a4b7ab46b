"""Dialogue, dataset-preparation and selection operators (D1-D42 subset, T7, T10).

Turns are rows keyed by (conv_id, turn_idx); everything per dialogue is a
window partitioned by ``conv_id`` (one shuffle on the conversation key, then
sorts inside partitions). Order across the whole data set goes through the
chunked prefix helpers of ``skein.functions.ordered``, never through a
window without PARTITION BY.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.functions import ordered

_UNB, _UNF = Window.unboundedPreceding, Window.unboundedFollowing


def _per_conv(order="turn_idx"):
    return Window.partitionBy("conv_id").orderBy(order)


def interactions(turns: DataFrame) -> DataFrame:
    """Nested interaction record per dialogue: (conv_id, db_id, final{utterance, query}, interaction[])."""
    g = turns.groupBy("conv_id", "db_id").agg(
        F.array_sort(F.collect_list(F.struct("turn_idx", F.col("question").alias("utterance"), "query")))
        .alias("items"))
    inter = F.transform("items", lambda s: F.struct(s["utterance"].alias("utterance"), s["query"].alias("query")))
    return g.select("conv_id", "db_id", F.element_at(inter, -1).alias("final"), inter.alias("interaction"))


def flatten_turns(inter: DataFrame) -> DataFrame:
    """Interaction -> one row per turn, position kept."""
    x = inter.select("conv_id", "db_id", "final", F.posexplode("interaction").alias("turn_idx", "t"))
    return x.select("conv_id", "db_id", F.col("turn_idx").cast("long"), F.col("t.utterance").alias("utterance"),
                    F.col("t.query").alias("query"), F.col("final.query").alias("goal"))


def goal_row(flat: DataFrame) -> DataFrame:
    """Add the final question/query of each dialogue as an extra row with turn_idx = -1."""
    last = flat.groupBy("conv_id", "db_id").agg(F.max_by(F.struct("utterance", "query", "goal"), "turn_idx").alias("l"))
    extra = last.select("conv_id", "db_id", F.lit(-1).cast("long").alias("turn_idx"), "l.utterance", "l.query", "l.goal")
    return flat.unionByName(extra)


def utterance_history(flat: DataFrame, split_pipe: bool = False) -> DataFrame:
    """D3: utterances up to and including this turn (array ``utterances``)."""
    u = F.col("utterance")
    piece = F.transform(F.split(u, r"\|"), lambda s: F.trim(s)) if split_pipe else F.array(u)
    w = _per_conv().rowsBetween(_UNB, 0)
    return flat.withColumn("utterances", F.flatten(F.collect_list(piece).over(w)))


def contexts(turns: DataFrame, schema: DataFrame) -> DataFrame:
    """Per turn goal, earlier questions and queries newest first joined by ' / ', target.

    The last turn's target gets `` <s>``; schema strings come from C8 (one row
    per database, joined by db_id -- metadata sized, broadcast).
    """
    w = _per_conv()
    is_last = F.lead("turn_idx").over(w).isNull()
    x = turns.withColumn("target", F.when(is_last, F.concat(F.trim("question"), F.lit(" <s>")))
                         .otherwise(F.trim("question")))
    before = w.rowsBetween(_UNB, -1)
    x = x.withColumn("prev_q", F.reverse(F.collect_list("target").over(before))) \
        .withColumn("prev_s", F.reverse(F.collect_list("query").over(before)))
    sch = schema.select("db_id", F.regexp_replace("schema", r"^[ |]+", "").alias("schema"))
    return x.join(sch, "db_id", "left").select(
        "conv_id", "turn_idx", "goal", F.array_join("prev_q", " / ").alias("question"),
        F.array_join("prev_s", " / ").alias("query"), "target", "schema")


def model_input(hist: DataFrame, schema: DataFrame, prefix: str = "") -> DataFrame:
    """Prefix + last utterance + schema + `` || `` + older utterances newest first."""
    sch = schema.select("db_id", F.trim("schema").alias("schema"))
    x = hist.join(sch, "db_id", "left")
    older = F.reverse(F.slice("utterances", 1, F.size("utterances") - 1))
    tail = F.when(F.size("utterances") > 1, F.concat(F.lit(" || "), F.array_join(F.transform(older, F.trim), " | "))) \
        .otherwise(F.lit(""))
    text = F.concat(F.lit(prefix), F.trim(F.element_at("utterances", -1)), F.lit(" "), F.col("schema"), tail)
    return x.select("conv_id", "turn_idx", text.alias("input"))


NORM_PATTERN = r"""["']?\w+["']?|[^\w]"""


def normalize_case(q) -> Column:
    """Lower-case words not touching a quote, squeeze spaces, `` , `` -> ``, ``."""
    q = F.col(q) if isinstance(q, str) else q
    parts = F.regexp_extract_all(q, F.lit(NORM_PATTERN), 0)
    low = F.transform(parts, lambda p: F.when(p.rlike("""^["']|["']$"""), p).otherwise(F.lower(p)))
    s = F.regexp_replace(F.trim(F.array_join(low, "")), r"\s+", " ")
    return F.replace(s, F.lit(" , "), F.lit(", "))


def target(df: DataFrame, with_db_id: bool = True) -> DataFrame:
    """``db | normalised query`` (or the normalised query alone)."""
    t = F.concat("db_id", F.lit(" | "), normalize_case("query")) if with_db_id else normalize_case("query")
    return df.withColumn("target", t)


def strip_db_id(col) -> Column:
    """Text after the first ``|``, trimmed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(c, r"^[^|]*\|", ""))


def sql2text_pair(ctx: DataFrame) -> DataFrame:
    """``goal | questions | queries | schema`` and the target, lower-cased."""
    context = F.concat_ws(" | ", F.trim("goal"), F.trim("question"), F.trim("query"), F.trim("schema"))
    return ctx.select("conv_id", "turn_idx", F.lower(context).alias("context"), F.lower("target").alias("target"))


def stop_marker(df: DataFrame, col: str = "target") -> DataFrame:
    """An utterance ending in ``<s>`` is the last turn; the marker is cut off."""
    ends = F.col(col).endswith("<s>")
    return df.withColumn("is_last", ends).withColumn(
        col, F.when(ends, F.trim(F.expr(f"substring({col}, 1, length({col}) - 3)"))).otherwise(F.col(col)))


def split_utterances(col) -> Column:
    """Split on ``/`` or ``|``, flatten, keep order."""
    c = F.col(col) if isinstance(col, str) else col
    return F.filter(F.transform(F.split(c, r"[/|]"), F.trim), lambda s: s != "")


def sessionize(rows: DataFrame, order_key: str, turn_col: str, chunk_size: int = 4096) -> DataFrame:
    """In a flat stream ordered by ``order_key``, a new dialogue starts when the turn does not increase.

    ``lag`` over the global order is computed inside chunks of the key; a
    chunk's first row takes the previous chunk's last turn from the (small)
    chunk table. Rows with turn -1 are skipped; a missing turn counts as 0.
    """
    x = rows.filter(F.coalesce(F.col(turn_col), F.lit(0)) != -1) \
        .withColumn("_t", F.coalesce(F.col(turn_col), F.lit(0))) \
        .withColumn("_chunk", F.floor(F.col(order_key) / chunk_size))
    last = x.groupBy("_chunk").agg(F.max_by("_t", order_key).alias("_last"))
    last = last.withColumn("_prev_last", F.lag("_last").over(Window.orderBy("_chunk")))
    x = x.join(last.select("_chunk", "_prev_last"), "_chunk")
    prev = F.coalesce(F.lag("_t").over(Window.partitionBy("_chunk").orderBy(order_key)), F.col("_prev_last"))
    x = x.withColumn("_reset", F.when(prev.isNull() | (F.col("_t") <= prev), 1).otherwise(0))
    x = ordered.running_sum(x.drop("_prev_last"), F.col("_chunk"), [F.col(order_key)], F.col("_reset"), "session")
    return x.drop("_t", "_reset", "_chunk")
