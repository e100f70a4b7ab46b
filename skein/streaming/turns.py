"""Incremental behaviours of the self-play loop as Structured Streaming jobs (ST1, ST3).

Sources are file streams with a declared schema; every query keeps its
progress in a checkpoint under the shared checkpoint folder, so a restarted
driver (or lost executors) resumes from the last committed batch. The jobs
run with ``trigger(availableNow=True)``: everything present is processed in
bounded micro-batches, then the query stops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.sources.files import TURN_SCHEMA


def stream_turns(spark: SparkSession, src_glob: str, sink: str, checkpoint: str,
                 max_files_per_trigger: int = 64) -> DataFrame:
    """ST1: turn shards (JSON lines, appended over time) -> parquet table, append mode."""
    s = (spark.readStream.schema(TURN_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).json(src_glob)
         .withColumn("n_utt", F.size("utterances").cast("long")))
    q = (s.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()
    return spark.read.parquet(sink)


def stream_keep_rate(spark: SparkSession, src_glob: str, schema: str, sink: str, checkpoint: str) -> DataFrame:
    """ST3: running per-dialogue keep rate over a stream of (conv_id, turn, kept) rows.

    The streaming aggregate keeps one state row per dialogue (update mode);
    each micro-batch merges its updated rows into the sink table by rewriting
    only the dialogues it touched.
    """
    s = spark.readStream.schema(schema).json(src_glob)
    agg = s.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.sum("kept").alias("n_kept"))

    def merge(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("append").parquet(sink)

    q = (agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(merge).trigger(availableNow=True).start())
    q.awaitTermination()
    # the latest update of each dialogue is its running total
    hist = spark.read.parquet(sink)
    last = hist.groupBy("conv_id").agg(F.max_by(F.struct("n_turns", "n_kept"), "batch_id").alias("s"))
    return last.select("conv_id", F.col("s.n_turns").alias("n_turns"), F.col("s.n_kept").alias("n_kept"),
                       F.round(F.col("s.n_kept") / F.col("s.n_turns"), 6).alias("keep_rate"))


CHAIN_SCHEMA = "conv_id long, turn long, query string, accepted boolean"


def _chain(key, frames, state):
    """Turns of one dialogue in one micro-batch, in order: each gets the last accepted query before it."""
    import pandas as pd
    rows = pd.concat(list(frames)).sort_values("turn", kind="stable")
    prev = state.get[0] if state.exists else "none"
    before = []
    for query, accepted in zip(rows["query"], rows["accepted"], strict=True):
        before.append(prev)
        if accepted and query is not None:
            prev = query
    state.update((prev,))
    yield pd.DataFrame({"conv_id": rows["conv_id"], "turn": rows["turn"], "prev_query": before})


def stream_chain(spark: SparkSession, src_glob: str, sink: str, checkpoint: str, max_files_per_trigger: int = 1) -> DataFrame:
    """ST2: each turn of a stream of (conv_id, turn, query, accepted) with the dialogue's last accepted query, ``none`` first.

    The state is one text per dialogue; it lives in the query's checkpoint, so a restarted job goes on where the last committed
    micro-batch ended. Turns of a dialogue must arrive in order from batch to batch; inside a batch they are sorted.
    """
    s = spark.readStream.schema(CHAIN_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger).json(src_glob)
    out = s.groupBy("conv_id").applyInPandasWithState(_chain, "conv_id long, turn long, prev_query string", "prev string", "append", "NoTimeout")
    q = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)
    q.awaitTermination()
    return spark.read.parquet(sink)
