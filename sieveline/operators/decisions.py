"""The human gate as a command log: which commands were taken, which refused and why.

Commands: advance, hold, decline (decisions, named by their ``seq``); booked, interviewed, offer, withdrawn (moves);
undo; release (the waiting e-mail is claimed by the sender, or the undo window of a person without an address
closes); fail (its sending failed). The last three may name a decision (``target``); without one they mean the latest
that is active, that is, taken and not undone.

An evaluation's active decisions are a stack. Only the top may be undone, and only while its e-mail waits or
has failed or its window is open; then the one below is the latest again, with its own e-mail or window. A decision
whose e-mail could not be scheduled (refusal ``not_scheduled``) is rolled back at once.

Commands are dealt by evaluation and sorted there by Spark, which spills; a task then reads them as a stream and holds
the active decisions of one evaluation, never its log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import dates
from sieveline.functions.text import clean_line, clean_note

#: Phases in which a decision may be undone.
OPEN = ("scheduled", "failed", "window")


class Standing:
    """Where an evaluation stands: its pipeline status and its active decisions, the latest last."""

    __slots__ = ("status", "active")

    def __init__(self, status: str = "scored", active: list[list] | None = None):
        self.status = status
        self.active = active or []  # [decision, action, status before, phase]

    def named(self, target) -> list | None:
        """The active decision meant; the latest where none is named."""
        if target is None:
            return self.active[-1] if self.active else None
        return next((d for d in reversed(self.active) if d[0] == target), None)

    def apply(self, command: str, seq, target=None, no_contact: bool = False, refusal: str | None = None) -> str | None:
        """Take the command, or give the reason why not."""
        if command in fixed.ACTIONS:
            if no_contact and refusal == "not_scheduled":
                refusal = None
            if refusal == "not_finished":
                return refusal
            if self.status not in fixed.DECISION_MOVES[command]:
                return "illegal_move"
            if self.active and self.active[-1][3] == "scheduled":
                return "email_in_flight"
            if refusal:
                return refusal
            self.active.append([seq, command, self.status, "window" if no_contact else "scheduled"])
            self.status = fixed.ACTION_STATUS[command]
            return None
        if command in fixed.STATUS_MOVES:
            if self.status not in fixed.STATUS_MOVES[command]:
                return "illegal_move"
            self.status = command
            return None
        decision = self.named(target)
        if command == "undo":
            if decision is None:
                return "not_found"
            if decision is not self.active[-1]:
                return "too_late"
            if decision[3] not in OPEN:
                return "already_sent" if decision[3] == "gone" else "too_late"
            self.active.pop()
            if self.status == fixed.ACTION_STATUS[decision[1]]:
                self.status = decision[2]
            return None
        after = {"release": {"scheduled": "gone", "window": "closed"}, "fail": {"scheduled": "failed"}}.get(command, {})
        if decision is None or decision[3] not in after:
            return "nothing_waiting"
        decision[3] = after[decision[3]]
        return None


def static_refusal() -> Column:
    """What is wrong with a decision before its history is looked at; null when nothing is.

    Needs status, role_applied, role_title, command, hold_until, at, has_booking_link and no_contact.
    A hold date is compared with the UTC date.
    """
    deciding = F.col("command").isin(*fixed.ACTIONS)
    return (
        F.when(deciding & ~F.coalesce(F.col("status").isin("scored", "needs_review"), F.lit(False)), "not_finished")
        .when(deciding & (F.col("role_applied") == "NOT_SURE") & F.col("role_title").isNull(), "role_title_missing")
        .when((F.col("command") == "hold") & (F.col("hold_until") <= F.to_date("at")), "hold_date_not_future")
        .when((F.col("command") == "advance") & ~F.col("no_contact") & ~F.col("has_booking_link"), "no_booking_link")
    )


def default_hold(config_days: Column, at: Column) -> Column:
    """The date a hold runs to when none is given."""
    return F.to_date(dates.minutes_after(at, config_days * 1440))


def clean_decision_text(commands: DataFrame) -> DataFrame:
    """The approved invite line (else the drafted one) and the reason, in the form they are kept."""
    line = clean_line(F.coalesce("invite_line", "drafted_line", F.lit("")), 300)
    return commands.withColumns(
        {"invite_line_final": F.when(F.col("command") == "advance", line), "reason": clean_note(F.col("reason"), 500)}
    )


def _replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verdicts on commands that come sorted by evaluation and seq."""
    key, state = None, Standing()
    for batch in batches:
        reasons, statuses, depths = [], [], []
        columns = [batch.column(c).to_pylist() for c in ("evaluation_id", "seq", "command", "refusal", "no_contact", "target")]
        for evaluation, seq, command, refusal, contact, target in zip(*columns):
            if evaluation != key:
                key, state = evaluation, Standing()
            reasons.append(state.apply(command, seq, target, bool(contact), refusal))
            statuses.append(state.status)
            depths.append(len(state.active))
        verdicts = [pa.array([r is None for r in reasons], pa.bool_()), pa.array(reasons, pa.string()), pa.array(statuses, pa.string()), pa.array(depths, pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("evaluation_id", "seq", "command")), *verdicts],
            names=["evaluation_id", "seq", "command", "accepted", "reason", "status_after", "n_active"],
        )


def fold(commands: DataFrame) -> DataFrame:
    """(evaluation_id, seq, command, refusal, no_contact, target if there is one) → every command with its verdict.

    ``seq`` orders the commands of an evaluation, is unique in it and names its decisions; ``refusal`` is static_refusal.
    """
    kinds = dict(commands.dtypes)
    target = F.col("target") if "target" in kinds else F.lit(None)
    rows = commands.select("evaluation_id", "seq", "command", "refusal", "no_contact", target.cast(kinds["seq"]).alias("target"))
    ordered = rows.repartition("evaluation_id").sortWithinPartitions("evaluation_id", "seq")
    return ordered.mapInArrow(
        _replay,
        f"evaluation_id {kinds['evaluation_id']}, seq {kinds['seq']}, command string, accepted boolean, reason string, status_after string, n_active long",
    )


def current_status(folded: DataFrame) -> DataFrame:
    """Pipeline status of each evaluation after its last command."""
    return folded.groupBy("evaluation_id").agg(
        F.max_by("status_after", "seq").alias("pipeline_status"),
        F.count_if("accepted").alias("n_accepted"),
        F.count_if(~F.col("accepted")).alias("n_refused"),
    )


def allowed_moves(spark) -> DataFrame:
    """The allowed moves as rows (command, from_status, to_status)."""
    rows = [(a, f, fixed.ACTION_STATUS[a]) for a, sources in fixed.DECISION_MOVES.items() for f in sources]
    rows += [(to, f, to) for to, sources in fixed.STATUS_MOVES.items() for f in sources]
    return spark.createDataFrame(rows, "command string, from_status string, to_status string")


def lock_times(pools: DataFrame, decisions: DataFrame, evaluations: DataFrame) -> DataFrame:
    """When each pool was locked: by its first decision, undone ones included. A lock is never lifted."""
    first = (
        decisions.join(evaluations.select(F.col("doc_id").alias("evaluation_id"), "pool_id"), "evaluation_id")
        .groupBy("pool_id")
        .agg(F.min("decided_at").alias("first_decided_at"))
    )
    return pools.join(first, "pool_id", "left").withColumn("locked_at", F.coalesce("locked_at", "first_decided_at"))


def undo_window_ends(decided_at: Column, delay_minutes: Column, email_id: Column) -> Column:
    """End of the undo window of a decision that has no e-mail."""
    return F.when(email_id.isNull(), dates.minutes_after(decided_at, delay_minutes))
