"""Ingestion state as folds over events: document status, interrupted runs, resume, dead letters, shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERRUPTED = "Interrupted before completion"
STATUS_COLUMNS = ("doc_id", "status", "attempt_count", "chunk_count", "last_error")


def fold_status(events: DataFrame, key: str = "doc_id", order: str = "seq") -> DataFrame:
    """`key`, status, attempt_count, chunk_count, last_error after all events (`key`, `order`, event, chunks, error).

    processing adds an attempt and keeps the rest; done sets chunks and clears the error; failed sets the error.
    A last value in order is `max_by` with the order as key, which combines on the map side: however many events
    a document has, no window and no list is needed.
    """
    done, failed = F.col("event") == "done", F.col("event") == "failed"
    e = events.where(F.col("event").isin("processing", "done", "failed") & F.col(key).isNotNull())
    g = e.groupBy(key).agg(
        F.max_by("event", order).alias("status"),
        F.count_if(F.col("event") == "processing").alias("attempt_count"),
        F.max_by(F.when(done, F.coalesce("chunks", F.lit(0))), F.when(done, F.col(order))).alias("chunk_count"),
        F.max_by(F.when(failed, F.col("error")), F.when(failed, F.col(order))).alias("_error"),
        F.max(F.when(done, F.col(order))).alias("_done"),
        F.max(F.when(failed, F.col(order))).alias("_failed"),
    )
    error = F.when(F.col("_done").isNull() | (F.col("_failed") > F.col("_done")), F.col("_error"))
    return g.select(key, "status", "attempt_count", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"), error.alias("last_error"))


def recover_interrupted(status: DataFrame) -> DataFrame:
    """Documents still in processing count as failed; an error they have stays."""
    stuck = F.col("status") == "processing"
    return status.withColumn("last_error", F.when(stuck, F.coalesce("last_error", F.lit(INTERRUPTED))).otherwise(F.col("last_error"))).withColumn(
        "status", F.when(stuck, "failed").otherwise(F.col("status"))
    )


def to_resume(content: DataFrame, status: DataFrame, key: str) -> DataFrame:
    """Content that is not done: failed, interrupted and unseen documents."""
    return content.join(status.where("status = 'done'").select(key), key, "left_anti")


def status_counts(status: DataFrame) -> DataFrame:
    return status.groupBy("status").agg(F.count("*").alias("n"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunks"))


def done_without_chunks(status: DataFrame, key: str, top: int = 50) -> DataFrame:
    """The first `top` documents that are done and have no chunk, by number of the id; ids that are no numbers come last."""
    return status.where("status = 'done' AND chunk_count = 0").orderBy(F.expr(f"try_cast({key} AS BIGINT)").asc_nulls_last(), key).limit(top)


def dead_letters(df: DataFrame, key: str, error: Column) -> DataFrame:
    """One JSON record for each row with an error: id, error and the row reduced to its id."""
    return df.withColumn("error", error).where("error IS NOT NULL").select(F.col(key), "error", F.to_json(F.struct(F.col(key), "error", F.struct(F.col(key).alias("id")).alias("row"))).alias("record"))


def shards(df: DataFrame, order: str, size: int, parts: int = 256) -> DataFrame:
    """Rows with shard (from 0) of exactly `size` rows in the order of a numeric column; the last may be shorter.

    Rows are ranked within ranges of the order, and the ranges' counts, at most `parts` plus one, give the offsets:
    no window over the whole table.
    """
    lo, hi = df.agg(F.min(order), F.max(order)).first()
    if lo is None:
        return df.withColumn("shard", F.lit(0).cast("long"))
    width = max(1, -(-(hi - lo + 1) // parts))
    ranged = df.withColumn("_p", F.floor((F.col(order) - lo) / width).cast("long"))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = counts.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(order)) - 1
    ranked = ranged.withColumn("_r", own).join(F.broadcast(offsets), "_p")
    return ranked.withColumn("shard", F.floor((F.col("_r") + F.col("_o")) / F.lit(max(1, size))).cast("long")).drop("_p", "_r", "_o")


def run_counts(outcomes: DataFrame) -> DataFrame:
    """seen, processed, skipped, failed, chunks of a run, from one row a document (outcome, chunks)."""
    n = lambda s: F.count_if(F.col("outcome") == s).alias(s)
    return outcomes.agg(F.count("*").alias("seen"), n("processed"), n("skipped"), n("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"))
