"""E-mails as rows: planning, guards, what is due, delivery statuses, nudges, wording. Nothing is sent here."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import dates, text as tx
from sieveline.sources.stages import insert_new


def delay_minutes(kind: Column, advance: Column, hold: Column, decline: Column) -> Column:
    return F.when(kind == "advance", advance).when(kind == "hold", hold).when(kind == "decline", decline).otherwise(0.0)


def refusal(at_send_time: bool) -> Column:
    """Why an e-mail of ``kind`` must not go out; null when it may.

    Needs kind, decision_id, undone_at, action, pipeline_status, email, no_contact and, before
    scheduling, invite_status. A decision that does not exist shows as a null decision_id.
    """
    nudge = F.col("kind") == "nudge"
    invited = F.lit(True) if at_send_time else F.coalesce(F.col("invite_status").isin("sent", "delivered"), F.lit(False))
    return (
        F.when(F.col("decision_id").isNull(), "no_decision")
        .when(F.col("undone_at").isNotNull(), "decision_undone")
        .when(nudge & (F.col("action") != "advance"), "wrong_kind")
        .when(nudge & ~F.col("pipeline_status").eqNullSafe(F.lit("advanced")), "not_eligible")
        .when(nudge & ~invited, "not_eligible")
        .when(~nudge & (F.col("action") != F.col("kind")), "wrong_kind")
        .when(F.coalesce(F.col("email"), F.lit("")).eqNullSafe(F.lit("")) | F.col("no_contact"), "no_contact")
    )


def guard(
    wishes: DataFrame, decisions: DataFrame, evaluations: DataFrame, candidates: DataFrame, emails: DataFrame | None = None,
    at_send_time: bool = False,
) -> DataFrame:
    """``refusal`` for every (asked_decision_id, kind) wish. Left joins, so a missing decision shows."""
    d = decisions.select("decision_id", "evaluation_id", "action", "undone_at", "hold_until", "invite_line_final", "decided_at")
    ev = evaluations.select(
        F.col("doc_id").alias("evaluation_id"), "candidate_id", "pool_id", "pipeline_status", "role_applied", "role_title_final"
    )
    who = candidates.select("candidate_id", "display_name", "email", "no_contact", "legacy", "eligibility")
    joined = (
        wishes.join(d, wishes["asked_decision_id"] == d["decision_id"], "left").join(ev, "evaluation_id", "left").join(who, "candidate_id", "left")
    )
    if emails is not None:
        invites = emails.filter(F.col("kind") == "advance").select(
            F.col("decision_id").alias("asked_decision_id"), F.col("status").alias("invite_status")
        )
        joined = joined.join(invites, "asked_decision_id", "left")
    else:
        joined = joined.withColumn("invite_status", F.lit(None).cast("string"))
    return joined.withColumn("refusal", refusal(at_send_time))


def plan(guarded: DataFrame, emails: DataFrame, configs: DataFrame, now: Column | None = None) -> DataFrame:
    """New outbox rows for wishes that may go out: one per key, none where the key is taken.

    The clock starts at the decision unless ``now`` is given.
    """
    allowed = guarded.filter(F.col("refusal").isNull()).join(
        configs.select("pool_id", "delay_advance", "delay_hold", "delay_decline"), "pool_id"
    )
    delay = delay_minutes(F.col("kind"), F.col("delay_advance"), F.col("delay_hold"), F.col("delay_decline"))
    rows = allowed.select(
        F.concat_ws(":", F.col("asked_decision_id").cast("string"), "kind").alias("idempotency_key"),
        F.col("asked_decision_id").alias("decision_id"),
        "evaluation_id", "kind",
        dates.minutes_after(now if now is not None else F.col("decided_at"), delay).alias("scheduled_at"),
        F.lit("scheduled").alias("status"),
    )
    return insert_new(emails, rows, ["idempotency_key"])


def is_due(now: Column) -> Column:
    """Scheduled and come, or claimed more than ten minutes ago and never handed over."""
    stuck = dates.minutes_after(now, F.lit(-fixed.STUCK_MINUTES))
    return ((F.col("status") == "scheduled") & (F.col("scheduled_at") <= now)) | (
        (F.col("status") == "pending") & F.col("provider_id").isNull() & (F.col("scheduled_at") < stuck)
    )


def due_emails(emails: DataFrame, now: Column, *, limit: int | None) -> DataFrame:
    """The batch to send, oldest first; with no limit, everything due."""
    due = emails.filter(F.col("decision_id").isNotNull() & is_due(now)).orderBy("scheduled_at", "email_id")
    return due.limit(limit) if limit else due


def claim(due: DataFrame, now: Column) -> DataFrame:
    """Claimed rows: the attempt time replaces the planned one, which the nudge clock then reads."""
    return due.withColumns({"status": F.lit("pending"), "scheduled_at": now})


def after_attempt(claimed: DataFrame, now: Column) -> DataFrame:
    """Next status from (refusal, provider_status_code, new_provider_id) of an attempt.

    Refused at send time: cancelled. Rate limits, outages and a key in flight: again in five minutes.
    Other errors: failed.
    """
    code = F.coalesce(F.col("provider_status_code"), F.lit(0))
    retry = (code == 429) | (code == 409) | (code >= 500)
    sent = F.col("refusal").isNull() & F.col("new_provider_id").isNotNull()
    status = F.when(F.col("refusal").isNotNull(), "cancelled").when(sent, "sent").when(retry, "scheduled").otherwise("failed")
    return claimed.withColumns(
        {
            "status": status,
            "scheduled_at": F.when(F.col("refusal").isNull() & ~sent & retry, dates.minutes_after(now, F.lit(5))).otherwise(F.col("scheduled_at")),
            "provider_id": F.when(sent, F.col("new_provider_id")).otherwise(F.col("provider_id")),
        }
    )


def retry_due(evaluations: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Documents that may be taken up: queued and come, or processing with an expired lease; oldest first."""
    expired = F.timestamp_micros(dates.micros(now) - fixed.LEASE_SECONDS * 1_000_000)
    due = evaluations.filter(
        ((F.col("status") == "queued") & (F.col("next_attempt_at").isNull() | (F.col("next_attempt_at") <= now)))
        | ((F.col("status") == "processing") & (F.col("claimed_at") < expired))
    ).orderBy("created_at", "doc_id")
    return due.limit(limit) if limit else due


def in_flight(emails: DataFrame) -> DataFrame:
    """Evaluations with an e-mail still waiting to send."""
    waiting = emails.filter(F.col("status").isin("pending", "scheduled") & F.col("evaluation_id").isNotNull())
    return waiting.groupBy("evaluation_id").agg(F.count(F.lit(1)).alias("n_in_flight"))


def gone_emails(emails: DataFrame) -> DataFrame:
    """Decisions whose e-mail can no longer be stopped."""
    gone = emails.filter(F.col("status").isin("pending", "sent", "delivered", "bounced") & F.col("decision_id").isNotNull())
    return gone.groupBy("decision_id").agg(F.count(F.lit(1)).alias("n_gone"))


def cancel(emails: DataFrame, undone: DataFrame) -> DataFrame:
    """The e-mails of undone decisions that were still ours to stop, as cancelled rows."""
    ours = emails.filter(F.col("status").isin("scheduled", "failed") & F.col("provider_id").isNull())
    return ours.join(undone.select("decision_id").distinct(), "decision_id", "left_semi").withColumn("status", F.lit("cancelled"))


# ---- delivery ----


def status_rank(status: Column) -> Column:
    ladder = F.when(F.lit(False), F.lit(-1))
    for name, rank in fixed.STATUS_RANK.items():
        ladder = ladder.when(status == name, rank)
    return ladder


def event_status(kind: Column) -> Column:
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, status in fixed.EVENT_STATUS.items():
        ladder = ladder.when(kind == name, status)
    return ladder


def reduce_statuses(events: DataFrame, keys: list[str], arrival: list[Column]) -> DataFrame:
    """Furthest status per key; of equals the first to arrive. (keys, status) rows, statuses unranked.

    One mergeable maximum: late, repeated and unordered events change nothing, and a key with very many
    events is reduced before it is shuffled.
    """
    first = F.min_by("status", F.struct((-status_rank(F.col("status"))).alias("r"), *arrival)).alias("status")
    return events.groupBy(*keys).agg(first)


def apply_events(emails: DataFrame, events: DataFrame) -> DataFrame:
    """E-mails whose status moves forward, with the new status. Complaints and unknown ids change nothing."""
    known = events.withColumn("status", event_status(F.col("type"))).filter(F.col("status").isNotNull())
    reduced = reduce_statuses(known, ["provider_id"], [F.col("at"), F.col("event_id")])
    joined = emails.filter(F.col("provider_id").isNotNull()).join(reduced.withColumnRenamed("status", "new_status"), "provider_id")
    forward = joined.filter(status_rank(F.col("new_status")) > status_rank(F.col("status")))
    return forward.withColumn("status", F.col("new_status")).select(*emails.columns)


def sync_statuses(emails: DataFrame, snapshot: DataFrame, now: Column) -> DataFrame:
    """Sent e-mails the provider knows more about, ten minutes after the attempt."""
    quiet = emails.filter(
        (F.col("status") == "sent") & F.col("provider_id").isNotNull()
        & (F.col("scheduled_at") < dates.minutes_after(now, F.lit(-fixed.STUCK_MINUTES)))
    )
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, status in fixed.PROVIDER_STATUS.items():
        ladder = ladder.when(F.col("last_event") == name, status)
    news = snapshot.select("provider_id", ladder.alias("new_status")).filter(F.col("new_status").isNotNull())
    return quiet.join(news, "provider_id").withColumn("status", F.col("new_status")).select(*emails.columns)


def add_flag(flags: Column, flag: str) -> Column:
    return F.array_union(flags, F.array(F.lit(flag)))


def flag_bounces(evaluations: DataFrame, emails: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Evaluations that get the bounce flag: one of their e-mails bounced and the flag is not there yet."""
    bounced = emails.filter(F.col("status") == "bounced").select(F.col("evaluation_id").alias(id_col))
    return (
        evaluations.filter(~F.array_contains("flags", "BOUNCED"))
        .join(bounced, id_col, "left_semi")
        .withColumn("flags", add_flag(F.col("flags"), "BOUNCED"))
    )


def nudges(decisions: DataFrame, evaluations: DataFrame, emails: DataFrame, configs: DataFrame, now: Column) -> DataFrame:
    """Decisions to nudge: advanced and not booked, invite out for the pool's days, none nudged before."""
    invites = emails.filter((F.col("kind") == "advance") & F.col("status").isin("sent", "delivered")).select(
        "decision_id", F.coalesce("scheduled_at", "created_at").alias("invited_at")
    )
    before = emails.filter(F.col("kind") == "nudge").select("decision_id")
    waiting = evaluations.filter(F.col("pipeline_status") == "advanced").select(F.col("doc_id").alias("evaluation_id"), "pool_id")
    return (
        decisions.filter((F.col("action") == "advance") & F.col("undone_at").isNull())
        .join(invites, "decision_id")
        .join(waiting, "evaluation_id")
        .join(configs.select("pool_id", "nudge_after_days"), "pool_id")
        .filter(dates.older_than(F.col("invited_at"), F.col("nudge_after_days"), now))
        .join(before, "decision_id", "left_anti")
        .select(F.col("decision_id").alias("asked_decision_id"), F.lit("nudge").alias("kind"), "evaluation_id", "invited_at")
    )


# ---- wording ----


def render(guarded: DataFrame, house: dict[str, str]) -> DataFrame:
    """Subject, text and html of each e-mail, from fixed wording. The approved invite line is the only
    text written by a model, and it appears in advances alone.

    ``house``: company, signature, short_name, booking_url, footer, legacy_opening, relocation_question.
    """
    role = F.coalesce("role_title_final", F.when(F.col("role_applied") == "SPM", "SPM").otherwise("PM"))
    title = F.when(role == "SPM", fixed.ROLE_TITLE_TEXT["SPM"]).otherwise(fixed.ROLE_TITLE_TEXT["PM"])

    values = {name: F.lit(text) for name, text in house.items()} | {
        "title": title,
        "opening": F.when(F.coalesce("legacy", F.lit(False)), house["legacy_opening"]).otherwise(""),
        "invite": F.coalesce(F.concat(F.lit(" "), F.nullif(tx.js_trim(F.col("invite_line_final")), F.lit(""))), F.lit("")),
        "ask": F.when(F.col("eligibility") == "unstated", house["relocation_question"]),
        "hold_until": dates.long_date(F.col("hold_until")),
        "first_name": F.coalesce(tx.first_name(F.col("display_name")), F.lit("there")),
    }

    def filled(template: str) -> Column:
        """The template with its fields; null where a field is."""
        parts = re.split(r"\{(\w+)\}", template)
        return F.concat(*[values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)])

    subjects = {kind: filled(subject) for kind, (subject, _) in fixed.LETTERS.items()}
    paragraphs = {kind: F.array(*[filled(t) for t in texts]) for kind, (_, texts) in fixed.LETTERS.items()}

    def by_kind(options: dict[str, Column]) -> Column:
        ladder = F.when(F.col("kind") == "advance", options["advance"])
        for kind in ("decline", "hold", "nudge"):
            ladder = ladder.when(F.col("kind") == kind, options[kind])
        return ladder

    out = guarded.withColumns({"subject": by_kind(subjects), "_paragraphs": F.array_compact(by_kind(paragraphs))})
    html = F.array_join(
        F.transform(
            "_paragraphs", lambda p: F.concat(F.lit("<p>"), F.replace(tx.html_escape(p), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))
        ),
        "\n",
    )
    style = '<div style="font-family:Arial,sans-serif;font-size:15px;line-height:1.5;color:#18181b">'
    return out.withColumns(
        {"text": F.array_join("_paragraphs", "\n\n"), "html": F.concat(F.lit(style), html, F.lit("</div>"))}
    ).drop("_paragraphs")


def attempt_outcomes(attempts: DataFrame, now: Column | None = None) -> DataFrame:
    """Where each document's processing stands after its last attempt.

    ``attempts`` hold (doc_id, attempt, result, at, tier): result is ok, invalid, transient or error.
    Transient failures have their own budget and do not use up the real attempts.
    """
    last = F.max_by(F.struct("result", "at", "tier"), F.struct("at", "attempt"))
    reduced = attempts.groupBy("doc_id").agg(
        last.alias("last"),
        F.count_if(F.col("result") == "transient").alias("transient_retries"),
        F.count_if(F.col("result") != "transient").alias("real_attempts"),
    )
    result = F.col("last.result")
    outcome = (
        F.when((result == "ok") & (F.col("last.tier") == "R"), "needs_review")
        .when(result == "ok", "scored")
        .when(result == "invalid", "needs_review")
        .when(result == "transient", F.when(F.col("transient_retries") > fixed.MAX_TRANSIENT_RETRIES, "failed").otherwise("requeued"))
        .when(F.col("real_attempts") >= fixed.MAX_ATTEMPTS, "failed")
        .otherwise("requeued")
    )
    wait = F.when(result == "transient", dates.backoff_seconds(F.col("transient_retries"))).otherwise(F.lit(fixed.RETRY_SECONDS))
    next_at = F.timestamp_micros(dates.micros(F.col("last.at")) + wait * F.lit(1_000_000).cast("bigint"))
    out = reduced.withColumn("outcome", outcome)
    return out.select(
        "doc_id", "outcome", "transient_retries", "real_attempts",
        F.when(F.col("outcome") == "requeued", next_at).alias("next_attempt_at"),
    )
