"""Documents and digests as streams; the work is the batch operators'."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieveline.operators import guard, leak, profile
from sieveline.sources.stages import insert_new
from sieveline.streaming.sinks import write_batches


def guard_stream(documents: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Incoming (doc_id, text, hidden_text) through the guard: what goes on, and what goes to review."""
    guarded = guard.guard(documents)
    return write_batches(
        guarded,
        {
            "doc_text": lambda b: b.filter(~F.col("unparseable")),
            "needs_review": lambda b: b.filter("unparseable").select("doc_id", F.lit("R").alias("tier"), F.lit("unparseable").alias("tier_reason")),
        },
        root,
        checkpoint,
    )


def redact_stream(extracts: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Incoming extracts through redaction and the leak audit; a leaking profile is not stored."""
    audited = leak.audit(profile.build_profiles(extracts))
    leaking = F.size("leaks") > 0
    return write_batches(
        audited,
        {
            "profiles": lambda b: b.filter(~leaking).select("doc_id", "profile", "profile_text", "counts"),
            "needs_review": lambda b: b.filter(leaking).select("doc_id", F.lit("R").alias("tier"), F.lit("redaction_leak").alias("tier_reason"), "leaks"),
        },
        root,
        checkpoint,
    )


def append_once(rows: DataFrame, path: str, key: str = "idempotency_key") -> None:
    """Append rows whose key the table does not hold: a digest is written once a day, however often it is asked for."""
    spark = rows.sparkSession
    try:
        there = spark.read.parquet(path).select(key)
    except AnalysisException:
        there = rows.limit(0).select(key)
    insert_new(there, rows, [key]).write.mode("append").parquet(path)


def digest_trigger(ticks: DataFrame, make_digest, path: str, checkpoint: str) -> StreamingQuery:
    """One digest per pool and day, asked for by any number of ticks."""

    def write(batch: DataFrame, _: int) -> None:
        if batch.limit(1).count():
            append_once(make_digest(batch.sparkSession), path)

    return (
        ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
