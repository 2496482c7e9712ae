"""Timers on event time: e-mails that fall due, nudges after quiet days.

A timer is set by a ``set`` row and stopped by a ``stop`` row (an undo, a booking). It fires once the
watermark has passed it, so a stop that happened in time counts even when it arrives late. A stop at the
very moment the timer falls due wins; one after it is too late.

What would forbid sending is joined in the same state: a ``guard`` row says at which moment a key was refused
(``reason``) or free again (no reason). A timer that fires asks for the newest such row up to the moment it falls due,
so an address that bounces after the planning stops the e-mail even if nobody undid it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, outcome string, due_at timestamp, reason string"
STATE = "due_us long, stop_us long, done boolean, seen_us array<long>, reasons array<string>"


def _micros(moment) -> int:
    return pd.Timestamp(moment).value // 1000


def _newest(facts: list[tuple], due: int | None) -> list[tuple]:
    """Facts that may still decide: all until the timer is set, then the newest that isn't after it."""
    facts = sorted(set(facts), key=lambda f: (f[0], f[1] or ""))
    return facts if due is None else [f for f in facts if f[0] <= due][-1:]


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    due, stop, done, seen, reasons = state.get if state.exists else (None, None, False, [], [])
    facts = list(zip(seen, reasons))

    def keep(over: bool) -> None:
        held = [] if over else _newest(facts, due)
        state.update((due, stop, over, [f[0] for f in held], [f[1] for f in held]))

    def fire(outcome: str, reason: str | None) -> pd.DataFrame:
        keep(True)
        return pd.DataFrame({"key": [key[0]], "outcome": [outcome], "due_at": [pd.Timestamp(due * 1000)], "reason": [reason]})

    if state.hasTimedOut:
        refused = next((reason for _, reason in _newest(facts, due)), None)
        yield fire("stopped" if refused else "released", refused)
        return
    for batch in batches:
        for op, at, due_at, reason in zip(batch["op"], batch["at"], batch["due_at"], batch["reason"]):
            if op == "set" and due is None:
                due = _micros(due_at)
            elif op == "stop":
                # A stop that overtook its timer is remembered until the timer is set.
                stop = _micros(at) if stop is None else min(stop, _micros(at))
            elif op == "guard":
                facts.append((_micros(at), reason if isinstance(reason, str) and reason else None))
    if due is not None and not done and stop is not None and stop <= due:
        yield fire("stopped", None)
        return
    keep(done)
    if due is not None and not done:
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, due // 1000))


def run_timers(rows: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(key, op, at, due_at, reason if there is one) stream → (key, outcome, due_at, reason): released or stopped, once per key."""
    reason = F.col("reason") if "reason" in rows.columns else F.lit(None).cast("string")
    return (
        rows.select("key", "op", "at", "due_at", reason.alias("reason"))
        .withWatermark("at", delay)
        .groupBy("key")
        .applyInPandasWithState(_step, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


def outbox_rows(plans: DataFrame, undos: DataFrame) -> DataFrame:
    """Timer rows of planned e-mails and of the undos that stop them."""
    sets = plans.select(
        F.col("idempotency_key").alias("key"), F.lit("set").alias("op"), F.col("planned_at").alias("at"), F.col("scheduled_at").alias("due_at")
    )
    stops = undos.select(
        F.col("idempotency_key").alias("key"), F.lit("stop").alias("op"), F.col("undone_at").alias("at"),
        F.lit(None).cast("timestamp").alias("due_at"),
    )
    return sets.unionByName(stops)


def guard_rows(facts: DataFrame) -> DataFrame:
    """Timer rows of what is found about a planned e-mail: (idempotency_key, seen_at, refusal), null when it may go."""
    return facts.select(
        F.col("idempotency_key").alias("key"), F.lit("guard").alias("op"), F.col("seen_at").alias("at"),
        F.lit(None).cast("timestamp").alias("due_at"), F.col("refusal").alias("reason"),
    )


def bounce_facts(events: DataFrame, outbox_keys: DataFrame) -> DataFrame:
    """Delivery events that close an address, as facts about every e-mail planned to it.

    ``outbox_keys`` holds (address_id, provider_id or null, idempotency_key): whatever bounced or was complained of
    at an address refuses all that is planned for it.
    """
    closing = events.filter(F.col("type").isin("email.bounced", "email.complained")).select("provider_id", F.col("at").alias("seen_at"))
    sent = outbox_keys.filter(F.col("provider_id").isNotNull()).select("provider_id", "address_id")
    planned = outbox_keys.filter(F.col("provider_id").isNull()).select("address_id", "idempotency_key")
    found = closing.join(sent, "provider_id").join(planned, "address_id")
    return found.select("idempotency_key", "seen_at", F.lit("no_contact").alias("refusal"))


def nudge_rows(invites: DataFrame, bookings: DataFrame, days: Column) -> DataFrame:
    """Timer rows of invitations (due after the pool's quiet days) and of the bookings that stop them."""
    sets = invites.select(
        F.col("decision_id").cast("string").alias("key"), F.lit("set").alias("op"), F.col("invited_at").alias("at"),
        (F.col("invited_at") + F.make_dt_interval(days)).alias("due_at"),
    )
    stops = bookings.select(
        F.col("decision_id").cast("string").alias("key"), F.lit("stop").alias("op"), F.col("booked_at").alias("at"),
        F.lit(None).cast("timestamp").alias("due_at"),
    )
    return sets.unionByName(stops)
