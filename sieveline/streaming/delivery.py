"""Delivery events: at least once, out of order, some not ours."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sieveline import schemas
from sieveline.operators import outbox
from sieveline.streaming.sinks import write_batches


def read_events(spark: SparkSession, folder: str, file_format: str = "json") -> DataFrame:
    return spark.readStream.schema(schemas.DELIVERY_EVENT).format(file_format).load(folder)


def _rise(keep_us: int):
    """Furthest status per e-mail; what is known of one is forgotten ``keep_us`` after its last event."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rank, last = state.get if state.exists else (-1, 0)
        best = None
        for batch in batches:
            for row in zip(-batch["rank"], batch["at_us"], batch["event_id"], batch["status"]):
                last = max(last, row[1])
                if -row[0] > rank and (best is None or row < best):
                    best = row
        if best is not None:
            rank = int(-best[0])
            yield pd.DataFrame({"provider_id": [key[0]], "status": [best[3]], "rank": [rank]})
        state.update((rank, int(last)))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (int(last) + keep_us) // 1000))

    return step


def statuses(events: DataFrame, delay: str = "1 day", keep_days: float = 30) -> DataFrame:
    """(provider_id, status, rank) whenever an e-mail's status rises; late and repeated events do no harm.

    An e-mail that nothing is heard of for ``keep_days`` leaves the state, so the state holds the e-mails of some
    weeks, however long the stream runs. Should an event come even later, its row may be lower than an
    earlier one: of several rows of an e-mail the highest rank is its status.
    """
    known = events.withColumn("status", outbox.event_status(F.col("type"))).filter(
        F.col("status").isNotNull() & F.col("provider_id").isNotNull() & F.col("at").isNotNull()
    )
    slim = known.select("provider_id", "status", outbox.status_rank(F.col("status")).cast("int").alias("rank"), "at", F.unix_micros("at").alias("at_us"), F.coalesce("event_id", F.lit("")).alias("event_id"))
    return slim.withWatermark("at", delay).groupBy("provider_id").applyInPandasWithState(
        _rise(int(keep_days * 86_400_000_000)), "provider_id string, status string, rank int", "rank int, last_us long", "update", GroupStateTimeout.EventTimeTimeout
    )


def run_statuses(events: DataFrame, emails: DataFrame, root: str, checkpoint: str, delay: str = "1 day", keep_days: float = 30) -> StreamingQuery:
    """Two tables per batch: e-mails whose status moves forward, and evaluations that get the bounce flag.

    ``emails`` is the outbox as it was when the stream began; the row of an e-mail with the highest rank is its status.
    """

    def forward(batch: DataFrame) -> DataFrame:
        ours = emails.select("email_id", "evaluation_id", "provider_id", F.col("status").alias("old_status"))
        moved = ours.join(batch, "provider_id").filter(
            outbox.status_rank(F.col("status")) > outbox.status_rank(F.col("old_status"))
        )
        return moved.select("email_id", "evaluation_id", "status", "rank")

    def bounced(batch: DataFrame) -> DataFrame:
        return forward(batch).filter((F.col("status") == "bounced") & F.col("evaluation_id").isNotNull()).select(
            F.col("evaluation_id").alias("doc_id"), F.lit("BOUNCED").alias("flag")
        ).distinct()

    parts = {"statuses": forward, "flags": bounced}
    return write_batches(statuses(events, delay, keep_days), parts, root, checkpoint, output_mode="update", stored=True)


def run_complaints(events: DataFrame, emails: DataFrame, root: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Complaints about our e-mails as audit entries, one per event; statuses are left alone."""
    complaints = (
        events.filter(F.col("type") == "email.complained")
        .withWatermark("at", delay)
        .dropDuplicatesWithinWatermark(["event_id"])
        .join(emails.select("provider_id", "email_id"), "provider_id")
        .select(F.lit("provider").alias("actor"), F.lit("email.complained").alias("action"), F.col("email_id").alias("target_id"), "at")
    )
    return write_batches(complaints, {"audit": lambda batch: batch}, root, checkpoint)
