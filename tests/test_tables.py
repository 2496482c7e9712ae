import datetime as dt
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sieveline import config as cfg
from sieveline import fixed, session
from sieveline.operators import calibration, combine, decisions, experience, identity, outbox, rank, reports, retention, skew, validity
from sieveline.sources import files, model_outputs, stages

T0 = dt.datetime(2026, 10, 1, 9, 0)


def at(minute):
    return T0 + dt.timedelta(minutes=minute)


def ts(minute):
    return F.lit(at(minute).isoformat(sep=" ")).cast("timestamp")


# ---- numbers ----


def test_median_and_totals(spark):
    rows = [("a", i, s) for i, s in enumerate([3, 1, 2])] + [("b", i, s) for i, s in enumerate([4, 3, 3])] + [("c", 0, 0), ("c", 1, 4)] + [("d", i, s) for i, s in enumerate([1, 2, 3, 4, 0, 2, 2])]
    df = spark.createDataFrame(rows, "doc_id string, run_ix int, score int")
    got = {r.doc_id: r for r in combine.combine_dims(df, ["doc_id"], F.col("run_ix"), ["run_ix"], with_scores=True).collect()}
    assert (got["a"].score, got["b"].score, got["b"].run_ix, got["c"].score) == (2, 3, 1, 4)
    assert got["a"].run_scores == [3, 1, 2] and got["c"].spread == 4
    assert got["d"].run_scores == [1, 2, 3, 4, 0, 2, 2] and got["d"].n_runs == 7
    cores = [((4, 4, 4, 4, 3, 3), 95), ((4, 3, 3, 3, 3, 2), 80), ((2, 2, 2, 2, 1, 3), 50), ((0, 2, 2, 2, 3, 0), 32.5)]
    wide = spark.createDataFrame([(*s, None, None, float(want)) for s, want in cores], "s_d1 int, s_d2 int, s_d3 int, s_d4 int, s_d5 int, s_d6 int, s_d8 int, s_d9 int, want double")
    assert all(r.want == r.got for r in wide.select("want", rank.weighted_total("CORE", cfg.literal(fixed.DEFAULT_CONFIG)).alias("got")).collect())


def test_bands_and_years(spark):
    pm = {0.0: 0, 0.25: 1, 1.5: 2, 2.0: 3, 4.0: 2, 6.0: 1}
    spm = {0.0: 0, 3.75: 1, 4.0: 2, 5.0: 3, 8.0: 2, 10.0: 1}
    no = F.lit(False)
    for role, cases in (("PM", pm), ("SPM", spm)):
        df = spark.createDataFrame(list(cases.items()), "y double, want int")
        assert all(r.want == r.got for r in df.select("want", experience.band_score(role, F.col("y"), no, no, no).alias("got")).collect())
    spans = [("a", 0, 23, 1.0), ("a", 12, 35, 0.5), ("b", 0, 6, 1.0), ("c", 0, 99, 0.0)]
    got = experience.years_from_spans(spark.createDataFrame(spans, "doc_id string, first int, last int, rate double"), ["doc_id"])
    assert {r.doc_id: r.years for r in got.collect()} == {"a": 2.5, "b": 0.5}


def test_votes(spark):
    cases = [((2, 1, 0, 0), 0, "PM"), ((1, 1, 0, 0), 1, "OTHER"), ((0, 0, 0, 0), 3, "OTHER"), ((1, 2, 0, 0), 0, "PRODUCT_OWNING"), ((1, 0, 0, 0), 2, "OTHER")]
    df = spark.createDataFrame([(*n, m, w) for n, m, w in cases], "a int, b int, c int, d int, m int, want string")
    counts = dict(zip(fixed.ROLE_TYPES, [F.col(c) for c in "abcd"]))
    assert all(r.want == r.got for r in df.select("want", combine.vote(counts, F.col("m"), "OTHER").alias("got")).collect())
    types = [("d", r, 0, 1, t, q, ok) for r, t, q, ok in [(0, "PM", "x", False), (1, "PM", "y", True), (2, "OTHER", None, False)]]
    types += [("d", r, 1, 2, "PM", "z", False) for r in range(3)] + [("d", 0, 2, 1, "OTHER", None, False)]
    frame = spark.createDataFrame(types, "doc_id string, run_ix int, position int, role_index int, type string, quote string, quote_ok boolean")
    roles = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "doc_id string, role_index int")
    runs = spark.createDataFrame([("d", 3)], "doc_id string, n_runs int")
    got = {r.role_index: (r.type, r.quote) for r in combine.vote_role_types(frame, roles, runs).collect()}
    assert got == {1: ("PM", "y"), 2: ("OTHER", None), 3: ("OTHER", None)}


def test_reuse_limit(spark):
    dims = [("d", d, s, [("q", p)], ["q"], "high", w) for d, s, p, w in [("D1", 2, False, 20.0), ("D2", 4, False, 15.0), ("D3", 2, True, 15.0), ("D4", 2, False, 15.0)]]
    frame = spark.createDataFrame(dims, "doc_id string, dim string, score int, evidence array<struct<quote:string,primary:boolean>>, quote_norms array<string>, confidence string, weight double")
    index = spark.createDataFrame([("d", [("b1", "a q b")])], "doc_id string, bullets array<struct<id:string,norm:string>>")
    got = {r.dim: r for r in combine.apply_reuse_limit(frame, index, ["doc_id"]).collect()}
    assert {d: r.confidence for d, r in got.items()} == {"D1": "low", "D2": "high", "D3": "high", "D4": "low"}
    assert "b1 already supports D3 and D2" in got["D1"].reuse_note and got["D2"].score == 4


# ---- skew ----


def test_hot_keys(spark):
    rows = spark.range(30_000).select(
        F.col("id").alias("doc_id"), F.lit("p").alias("pool_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 5000).cast("string"))).alias("record_key")
    )
    links = identity.link_groups(rows, "doc_id")
    assert links.count() == 30_000
    assert links.filter("record_key = 'hot'").agg(F.min("n_linked"), F.max("link_head")).first() == (9_999, 0)
    ranked = skew.positions(rows, ["record_key"], [F.col("doc_id") % 7, F.col("doc_id")])
    plain = rows.withColumn("want", F.row_number().over(Window.partitionBy("record_key").orderBy(F.col("doc_id") % 7, "doc_id")))
    assert ranked.join(plain.select("doc_id", "want"), "doc_id").filter("position <> want").count() == 0


def test_pages_of_a_huge_group(spark):
    rows = spark.range(30_000).select(F.col("id").alias("candidate_id"), F.lit("p").alias("pool_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 9_000)).alias("record_key"))
    odd = spark.createDataFrame([(-1, None, "hot"), (-2, "p", "alone"), (None, "p", "hot"), (-3, "p", "two"), (-4, "p", "two")], "candidate_id long, pool_id string, record_key string")
    links = session.materialise(identity.link_groups(rows.unionByName(odd)))
    pages = session.materialise(identity.link_pages(links, page_rows=64))
    keyed = {}
    for r in links.filter("n_linked > 0 AND pool_id IS NOT NULL AND candidate_id IS NOT NULL").collect():
        keyed.setdefault(r.link_head, []).append(r.candidate_id)
    found = {(r.link_head, r.page): r.members for r in pages.collect()}
    assert found == {(head, at // 64): sorted(ids)[at:at + 64] for head, ids in keyed.items() for at in range(0, len(ids), 64)}
    hot = keyed[0]
    assert len(hot) == 10_000 and sorted(hot) == [i for p in range(157) for i in found[0, p]]
    everyone = rows.select("candidate_id", F.lit(0).alias("page"))
    assert identity.linked_on_page(links, pages, everyone.filter("candidate_id % 3 = 0")).count() == 10_000 * 64 - 64
    asked = spark.createDataFrame([(3, 156), (3, 156), (3, 157), (3, -1), (-1, 0), (-2, 0), (-3, 0), (-9, 0), (None, 0), (3, None)], "candidate_id long, page int")
    got = sorted(tuple(r) for r in identity.linked_on_page(links, pages, asked).collect())
    assert got == [(-3, 0, 1, -4), *[(3, 156, 157, i) for i in sorted(hot)[156 * 64:]]]
    none = links.limit(0)
    assert identity.link_pages(none).count() == 0 and identity.linked_on_page(none, identity.link_pages(none), asked).count() == 0


def test_pages_of_open_applications(spark):
    who = spark.createDataFrame([(i, "p", "k") for i in range(7)] + [(7, "p", "z"), (8, None, "n"), (9, None, "n")], "candidate_id long, pool_id string, record_key string")
    links = session.materialise(identity.link_groups(who))
    applied = [(0, "PM", "hold"), (1, "PM", None), (1, None, "hold"), (1, "SPM", "declined"), (2, "PM", "withdrawn"), (3, "PM", "hold"), (3, "PM", "hold"), (5, None, None), (7, "PM", None), (8, "PM", None), (9, "PM", None)]
    ev = spark.createDataFrame(applied, "candidate_id long, role_applied string, pipeline_status string")
    pages = identity.open_pages(links, ev, page_rows=4)
    order = [(0, "PM", "hold"), (1, None, "hold"), (1, "PM", None), (3, "PM", "hold"), (3, "PM", "hold"), (5, None, None)]
    assert {(r.page, r.n_pages): [tuple(m) for m in r.members] for r in pages.collect()} == {(0, 2): order[:4], (1, 2): order[4:]}
    asked = spark.createDataFrame([(2, 0), (3, 1), (1, 0), (7, 0), (8, 0), (2, 2)], "candidate_id long, page int")
    got = identity.open_applications_on_page(links, pages, asked).collect()
    want = [(2, 0, 2, *m) for m in order[:4]] + [(3, 1, 2, *order[5])] + [(1, 0, 2, *m) for m in order[:4] if m[0] != 1]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert identity.open_pages(links, ev.limit(0)).count() == 0


def plain_fold(rows):
    """Verdicts by keeping every decision with its fate, as a table of decisions would."""
    out, now = [], {}
    legal = {**fixed.DECISION_MOVES, **fixed.STATUS_MOVES}
    for ev, seq, command, refusal, contact, target in sorted(rows, key=lambda r: (r[0], r[1])):
        status, made = now.setdefault(ev, ["scored", []])
        active = [d for d in made if not d["undone"]]
        meant = next((d for d in active if d["id"] == target), None) if target is not None else active[-1] if active else None
        reason = None
        if command in fixed.ACTIONS:
            late = refusal if not (contact and refusal == "not_scheduled") else None
            reason = "not_finished" if refusal == "not_finished" else "illegal_move" if status not in legal[command] else "email_in_flight" if any(d["mail"] == "scheduled" for d in active) else late
            if reason is None:
                made.append({"id": seq, "action": command, "before": status, "mail": None if contact else "scheduled", "open": True, "undone": False})
                status = fixed.ACTION_STATUS[command]
        elif command in fixed.STATUS_MOVES:
            reason = None if status in legal[command] else "illegal_move"
            status = status if reason else command
        elif command == "undo":
            if meant is None or meant is not active[-1]:
                reason = "not_found" if meant is None else "too_late"
            elif meant["mail"] == "sent" or (meant["mail"] is None and not meant["open"]):
                reason = "already_sent" if meant["mail"] else "too_late"
            else:
                meant["undone"] = True
                status = meant["before"] if status == fixed.ACTION_STATUS[meant["action"]] else status
        elif meant is None or not (meant["mail"] == "scheduled" or (command == "release" and meant["mail"] is None and meant["open"])):
            reason = "nothing_waiting"
        elif meant["mail"] is None:
            meant["open"] = False
        else:
            meant["mail"] = "sent" if command == "release" else "failed"
        now[ev][0] = status
        out.append((ev, seq, command, reason is None, reason, status, sum(not d["undone"] for d in made)))
    return out


LOG = "evaluation_id string, seq long, command string, refusal string, no_contact boolean, target long"


def random_log(seed, lengths):
    import random

    pick = random.Random(seed)
    words = ["advance", "hold", "hold", "hold", "decline", "booked", "interviewed", "offer", "withdrawn", "undo", "undo", "undo", "release", "fail", "fail"]
    refusals = [None] * 12 + ["not_finished", "not_scheduled", "role_title_missing"]
    rows = []
    for ev, n in lengths.items():
        for i in range(n):
            command = pick.choice(words)
            target = pick.choice([None, None, i - 1, i - 2, i - 5]) if command in ("undo", "release", "fail") else None
            rows.append((ev, i, command, pick.choice(refusals) if command in fixed.ACTIONS else None, pick.random() < 0.2 if ev != "p" else True, target))
    return rows


def test_logs_of_any_length(spark):
    rows = random_log(1, {"hot": 6_000, "p": 500, **{f"e{k}": k % 9 for k in range(300)}})
    deep = ["hold", "fail", "hold", "fail", "undo"]
    rows += [("deep", i, deep[i % 5] if i < 500 else "undo", None, False, None) for i in range(700)]
    found = [tuple(r) for r in decisions.fold(spark.createDataFrame(rows, LOG).repartition(5)).collect()]
    assert sorted(found, key=repr) == sorted(plain_fold(rows), key=repr)
    assert {r[4] for r in found} >= {"not_found", "too_late", "already_sent", "email_in_flight", "illegal_move", "nothing_waiting", "not_scheduled"}
    assert max(r[6] for r in found) > 20
    assert decisions.fold(spark.createDataFrame([], LOG)).count() == 0


# ---- decisions ----


def verdicts(spark, *commands, no_contact=False):
    """Commands as words or (word, refusal, target)."""
    words = [(c, None, None) if isinstance(c, str) else (*c, None)[:3] for c in commands]
    rows = [("e", i, c, refusal, no_contact, target) for i, (c, refusal, target) in enumerate(words)]
    return [(r.reason, r.status_after) for r in decisions.fold(spark.createDataFrame(rows, LOG)).orderBy("seq").collect()]


def test_decisions(spark):
    assert verdicts(spark, "advance", "decline", "release", "decline") == [(None, "advanced"), ("email_in_flight", "advanced"), (None, "advanced"), (None, "declined")]
    assert verdicts(spark, "offer", "decline", "release", "advance") == [("illegal_move", "scored"), (None, "declined"), (None, "declined"), ("illegal_move", "declined")]
    assert verdicts(spark, "decline", "undo", "advance", "undo", "undo") == [(None, "declined"), (None, "scored"), (None, "advanced"), (None, "scored"), ("not_found", "scored")]
    assert verdicts(spark, "advance", "release", "undo") == [(None, "advanced"), (None, "advanced"), ("already_sent", "advanced")]
    assert verdicts(spark, "advance", "booked", "undo") == [(None, "advanced"), (None, "booked"), (None, "booked")]
    assert verdicts(spark, ("advance", "role_title_missing"), "hold", "fail", "undo") == [("role_title_missing", "scored"), (None, "hold"), (None, "hold"), (None, "scored")]
    assert verdicts(spark, "hold", "release", "undo", no_contact=True)[-1] == ("too_late", "hold")


def test_undo_goes_down_the_stack(spark):
    assert verdicts(spark, "hold", "fail", "hold", "undo", "undo", "undo") == [*[(None, "hold")] * 4, (None, "scored"), ("not_found", "scored")]
    # By id: only the latest active decision may go; one that was undone, refused or never made isn't found.
    named = verdicts(spark, "hold", "fail", "advance", ("undo", None, 0), ("undo", None, 2), ("undo", None, 2), ("undo", None, 99), ("undo", None, 0))
    assert [r for r, _ in named[3:]] == ["too_late", None, "not_found", "not_found", None] and named[-1] == (None, "scored")
    # Each decision keeps its own window.
    assert [r for r, _ in verdicts(spark, "hold", "hold", ("release", None, 0), "undo", "undo", no_contact=True)] == [None, None, None, None, "too_late"]
    # What could not be scheduled is rolled back; a person without an address has nothing to schedule.
    assert verdicts(spark, ("advance", "not_scheduled"), "undo") == [("not_scheduled", "scored"), ("not_found", "scored")]
    assert verdicts(spark, ("advance", "not_scheduled"), no_contact=True) == [(None, "advanced")]


def test_static_refusals(spark):
    rows = [("queued", "PM", None, "hold", "2026-10-22"), ("scored", "NOT_SURE", None, "decline", None), ("scored", "PM", None, "hold", "2026-10-01"), ("scored", "PM", None, "advance", None), ("scored", "PM", None, "undo", None)]
    df = spark.createDataFrame(rows, "status string, role_applied string, role_title string, command string, h string").select(
        "*", F.col("h").cast("date").alias("hold_until"), ts(0).alias("at"), F.lit(False).alias("no_contact"), F.lit(False).alias("has_booking_link")
    )
    assert [r[0] for r in df.select(decisions.static_refusal()).collect()] == ["not_finished", "role_title_missing", "hold_date_not_future", "no_booking_link", None]


# ---- outbox ----

MAIL = "email_id string, decision_id string, evaluation_id string, kind string, provider_id string, status string, scheduled_at timestamp, created_at timestamp"


def test_due_and_stuck(spark):
    df = spark.createDataFrame([("s", "d", "e", "decline", None, "scheduled", at(1440), T0), ("p", "d", "e", "decline", None, "pending", at(1440), T0), ("g", None, None, "digest", None, "scheduled", at(0), T0)], MAIL)
    due = lambda m: sorted(r.email_id for r in outbox.due_emails(df, ts(m), limit=25).collect())
    assert (due(1439), due(1440), due(1445), due(1451)) == ([], ["s"], ["s"], ["p", "s"])
    tried = spark.createDataFrame([("a", None, 429, None), ("b", None, 422, None), ("c", None, None, "re_1"), ("d", "no_contact", None, None)], "email_id string, refusal string, provider_status_code int, new_provider_id string").select(
        "*", F.lit("pending").alias("status"), ts(1440).alias("scheduled_at"), F.lit(None).cast("string").alias("provider_id")
    )
    got = {r.email_id: (r.status, r.scheduled_at) for r in outbox.after_attempt(tried, ts(1440)).collect()}
    assert got == {"a": ("scheduled", at(1445)), "b": ("failed", at(1440)), "c": ("sent", at(1440)), "d": ("cancelled", at(1440))}


def test_plan_twice_is_once(spark):
    decided = spark.createDataFrame([(k, k, k, None, None, "", T0) for k in ("advance", "hold", "decline")], "decision_id string, evaluation_id string, action string, undone_at timestamp, hold_until date, invite_line_final string, decided_at timestamp")
    ev = spark.createDataFrame([(k, k, "p", "scored", "PM", "PM") for k in ("advance", "hold", "decline")], "doc_id string, candidate_id string, pool_id string, pipeline_status string, role_applied string, role_title_final string")
    who = spark.createDataFrame([(k, "PRIYA x", "a@b.c", False, False, "unstated") for k in ("advance", "hold", "decline")], "candidate_id string, display_name string, email string, no_contact boolean, legacy boolean, eligibility string")
    wishes = spark.createDataFrame([(k, k) for k in ("advance", "hold", "decline")] + [("none", "hold"), ("advance", "decline")], "asked_decision_id string, kind string")
    guarded = outbox.guard(wishes, decided, ev, who)
    assert {(r.asked_decision_id, r.kind): r.refusal for r in guarded.collect() if r.refusal} == {("none", "hold"): "no_decision", ("advance", "decline"): "wrong_kind"}
    empty = spark.createDataFrame([], "idempotency_key string")
    configs = cfg.config_frame(spark, {"p": fixed.DEFAULT_CONFIG})
    first = outbox.plan(guarded, empty, configs)
    assert {r.kind: r.scheduled_at for r in first.collect()} == {"advance": at(10), "hold": at(10), "decline": at(1440)}
    assert outbox.plan(guarded, first, configs).count() == 0


def test_letters(spark):
    from sieveline.plans.table_bindings import HOUSE

    row = ("PRIYA x", "SPM", "PM", True, " Loved <it> ", dt.date(2026, 10, 22), "unstated")
    df = spark.createDataFrame([(k, *row) for k in ("advance", "hold", "nudge")], "kind string, display_name string, role_title_final string, role_applied string, legacy boolean, invite_line_final string, hold_until date, eligibility string")
    got = {r.kind: r for r in outbox.render(df, HOUSE).collect()}
    assert got["advance"].subject == "Next step: Senior Product Manager at the company"
    assert got["advance"].text.startswith("Hi Priya,\n\nSorry for the wait. Thanks for applying for the Senior Product Manager role at the company. Loved <it>\n\n")
    assert "Loved &lt;it&gt;" in got["advance"].html and "it,<br>The hiring team" in got["advance"].html and "Would you consider relocating?" in got["advance"].text
    assert "by 22 October 2026." in got["hold"].text and "Loved" not in got["hold"].text and got["nudge"].text.startswith("Hi Priya, just checking")


def test_events_forward_only(spark):
    mails = spark.createDataFrame([("m", "d", "e", "advance", "p", "sent", T0, T0), ("n", "d2", "e2", "advance", "q", "delivered", T0, T0)], MAIL)
    events = [("1", "p", "email.bounced", at(3)), ("2", "p", "email.sent", at(4)), ("3", "p", "email.failed", at(5)), ("4", "q", "email.sent", at(1)), ("5", "q", "email.complained", at(2))]
    got = outbox.apply_events(mails, spark.createDataFrame(events, "event_id string, provider_id string, type string, at timestamp")).collect()
    assert [(r.email_id, r.status) for r in got] == [("m", "bounced")]


def test_nudges(spark):
    day = 1440
    decided = spark.createDataFrame([("d", "e", "advance", None)], "decision_id string, evaluation_id string, action string, undone_at timestamp")
    ev = spark.createDataFrame([("e", "p", "advanced")], "doc_id string, pool_id string, pipeline_status string")
    mails = spark.createDataFrame([("m", "d", "e", "advance", "p", "sent", at(0), T0)], MAIL)
    configs = cfg.config_frame(spark, {"p": fixed.DEFAULT_CONFIG})
    count = lambda m, sent=mails: outbox.nudges(decided, ev, sent, configs, ts(m)).count()
    assert (count(2 * day), count(4 * day)) == (0, 1)
    again = mails.unionByName(spark.createDataFrame([("n", "d", "e", "nudge", "p2", "sent", at(4 * day), T0)], MAIL))
    assert count(5 * day, again) == 0


# ---- reports ----


def test_sections_and_fit(spark):
    rows = [
        ("a", "scored", "A", 70.0, 60.0, [], 3), ("b", "scored", "A", 80.0, 60.0, ["WILDCARD"], 2), ("c", "scored", "B", 60.0, 70.0, ["WILDCARD"], 1), ("d", "needs_review", "R", 90.0, 0.0, [], 5),
        ("e", "needs_review", "R", 10.0, 0.0, [], 4), ("f", "queued", None, None, None, [], 0), ("g", "scored", "B", 60.0, 69.9, [], 6),
    ]
    df = spark.createDataFrame([(i, s, t, p, q, f, at(m), "PM", "PM") for i, s, t, p, q, f, m in rows], "doc_id string, status string, tier string, pm_total double, spm_total double, flags array<string>, created_at timestamp, role_applied string, role_used string")
    got = reports.shortlist_sections(df).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.section, r.section_rank)):
        by.setdefault(r.section, []).append(r.doc_id)
    assert by == {"A": ["b", "a"], "B": ["c", "g"], "R": ["e", "d"], "WILDCARD": ["b", "c"], "IN_PROGRESS": ["f"]}
    assert {r.doc_id: r.better_fit for r in got if r.section == "B"} == {"c": "SPM", "g": None}


def test_digest(spark):
    rows = [("a", "p", "scored", "scored", None, at(-3000), "Asha", []), ("b", "p", "scored", "hold", T0, T0, "Bo", []), ("c", "p", "scored", "interviewed", T0, T0, "Cy", ["BOUNCED"]), ("d", "p", "scored", "advanced", T0, T0, "Di", [])]
    df = spark.createDataFrame(rows, "doc_id string, pool_id string, status string, pipeline_status string, pipeline_status_at timestamp, created_at timestamp, name string, flags array<string>")
    holds = spark.createDataFrame([("b", "hold", None, dt.date(2026, 10, 1)), ("a", "hold", None, dt.date(2026, 9, 1))], "evaluation_id string, action string, undone_at timestamp, hold_until date")
    mails = spark.createDataFrame([("m", "x", "d", "nudge", "p", "delivered", T0, T0)], MAIL)
    items = reports.digest_items(df, holds, mails, F.lit("2026-10-01").cast("date"))
    frame = cfg.config_frame(spark, {"p": fixed.DEFAULT_CONFIG})
    out = reports.digest_parts(reports.digest_counts(df, ts(0), ["pool_id"]), reports.digest_lists(items), frame, ts(0), "https://app").orderBy("line", "position").collect()
    assert {(r.idempotency_key, r.subject) for r in out} == {("digest:2026-10-01", "Hiring: 1 waiting · 13 weeks to target")}
    assert "".join(r.text for r in out) == (
        "Holds due today: decide again on Bo.\n\n- Waiting for your decision: 1 (oldest 2 days): https://app/shortlist\n- Holds due today: 1 (Bo)\n- Interviewed, no next step: 1 (Cy)\n"
        "- Advanced, not booked (nudged): 1 (Di (nudged))\n- Bounced emails: 1 (Cy)\n- Pipeline: Advanced 1 · Booked 0 · Interviewed 1 · Offer 0"
    )


def test_a_digest_names_everybody(spark):
    people = spark.range(1_001).select(F.lit("p").alias("pool_id"), F.lit("holds_due").alias("section"), F.format_string("d%05d", "id").alias("doc_id"), F.format_string("N%d", "id").alias("name"))
    counts = spark.createDataFrame([("p", 0, 0, 0, 0, 0, 0)], "pool_id string, n_waiting long, oldest_days int, n_advanced long, n_booked long, n_interviewed long, n_offer long")
    parts = reports.digest_parts(counts, reports.digest_lists(people), cfg.config_frame(spark, {"p": fixed.DEFAULT_CONFIG}), ts(0), "https://app").orderBy("line", "position").collect()
    names = ", ".join(f"N{k}" for k in range(1_001))
    text = "".join(r.text for r in parts)
    assert text.startswith(f"Holds due today: decide again on {names}.\n\n- Waiting") and f"- Holds due today: 1001 ({names})\n- Interviewed, no next step: 0\n" in text


def test_evidence_pack(spark):
    ranked = spark.createDataFrame([("d", "PM", "A", 70.25, 10.0, 55.55, ["VERIFY_CLAIM", "LEGACY"], 3, 1)], "doc_id string, role_used string, tier string, pm_total double, spm_total double, core_score double, flags array<string>, d7_pm int, d7_spm int")
    dims = spark.createDataFrame([("d", "D2", 3, "present", "high", "r", [("q", True)], False), ("d", "D1", 0, "weak", "low", "r", [("bad", True)], True), ("d", "D9", 1, "weak", "low", "r", [], False)], "doc_id string, dim string, score int, evidence_status string, confidence string, rationale string, evidence array<struct<quote:string,primary:boolean>>, quote_mismatch boolean")
    pack = json.loads(reports.evidence_pack(ranked, dims, fixed.DEFAULT_CONFIG).first().evidence)
    assert (pack["total"], pack["core_score"], [f["flag"] for f in pack["flags"]], pack["experience_fit"]["weight"]) == (70.3, 55.6, ["VERIFY_CLAIM"], 15)
    assert [(d["dimension"], d["verified_quotes"], d["weight"]) for d in pack["dimensions"]] == [("D1", [], 20), ("D2", ["q"], 15)]


# ---- retention, calibration, validity, sources ----


def test_retention(spark):
    pools = spark.createDataFrame([("p", T0), ("q", None)], "pool_id string, closed_at timestamp")
    who = spark.createDataFrame([("c", "Asha", "a@b.c", ["u"], None), ("k", "Bo", None, [], None)], "candidate_id string, display_name string, email string, urls array<string>, deleted_at timestamp")
    dims = "array<struct<dim:string,score:int,run_scores:array<int>,evidence_status:string,confidence:string,quote_mismatch:boolean,rationale:string>>"
    ev = spark.createDataFrame([("e", "c", "p", "f.pdf", "text", [("D1", 3, [3, 3, 3], "present", "high", False, "words")]), ("e2", "k", "q", "g.pdf", "text", [])], f"doc_id string, candidate_id string, pool_id string, file_path string, redacted_profile_text string, dims {dims}")
    configs = cfg.config_frame(spark, {"p": fixed.DEFAULT_CONFIG, "q": fixed.DEFAULT_CONFIG})
    due = lambda d, people=who: retention.due_candidates(ev, people, pools, configs, ts(d * 1440))
    assert (due(179).count(), due(181).count()) == (0, 1)
    purged = retention.purge_candidates(who, due(181), ts(181 * 1440))
    assert due(182, purged).count() == 0
    row = {r.candidate_id: r for r in purged.collect()}
    assert (row["c"].display_name, row["c"].urls, row["k"].display_name) == (None, [], "Bo")
    kept = {r.doc_id: r for r in retention.purge_evaluations(ev, due(181)).collect()}
    assert kept["e"].redacted_profile_text is None and kept["e"].dims is None and kept["e2"].redacted_profile_text == "text"
    assert kept["e"].dims_numbers[0].asDict() == {"dim": "D1", "score": 3, "run_scores": [3, 3, 3], "evidence_status": "present", "confidence": "high", "quote_mismatch": False}
    assert [r.file_path for r in retention.files_to_delete(due(181)).collect()] == ["f.pdf"]


def test_calibration_and_regression(spark, tmp_path):
    body = {"_comment": "x", "hires": [{"file": f, "label": lab, "joined": "2022-07-01", "reference": {**{f"D{i}": 2 for i in range(1, 7)}, "core": 50.0}} for f, lab in (("a", "Exceeds"), ("b", "Meets"), ("c", "Below"))]}
    (tmp_path / "labels.json").write_text(json.dumps(body, indent=1))
    labels = files.load_labels(spark, str(tmp_path / "labels.json"))
    cores = lambda *c: spark.createDataFrame(list(zip("abc", c)), "doc_id string, core_score double")
    good, tie, gap = (calibration.verdict(labels, cores(*c)).first() for c in ((80.0, 50.0, 30.0), (50.0, 50.0, 1.0), (80.0, None, 1.0)))
    assert (good.passed, good.margin, tie.passed, gap.passed) == (True, 30.0, False, False)
    diffs = calibration.dimension_differences(labels, spark.createDataFrame([("a", "D1", 4), ("a", "D2", 2)], "doc_id string, dim string, score int"))
    assert [(r.doc_id, r.dim, r.got, r.reference_score) for r in diffs.collect()] == [("a", "D1", 4, 2)]
    want = spark.createDataFrame([("x", "A", [], ["W"], []), ("y", "D", ["R"], [], ["W"]), ("z", "A", [], [], [])], "doc_id string, tier string, also_acceptable array<string>, flags array<string>, not_flags array<string>")
    ranked = spark.createDataFrame([("x", "B", ["W"]), ("y", "R", ["W"])], "doc_id string, tier string, flags array<string>")
    got = {r.doc_id: (r.tier_ok, r.missing, r.unexpected, r.passed) for r in calibration.regression(want, ranked).collect()}
    assert got == {"x": (True, [], [], True), "y": (True, [], ["W"], False), "z": (False, [], [], False)}


def test_validity(spark):
    dim = {"score": 3, "evidence_status": "present", "evidence": [], "confidence": "high", "rationale": "r"}
    good = {"dimensions": {d: dim for d in fixed.SCORED_DIMS}, "d7_qualifiers": {q: {"value": False, "quote": None} for q in fixed.QUALIFIERS}, "role_types": []}
    bad = {**good, "dimensions": {**good["dimensions"], "D1": {**dim, "score": 9}}, "role_types": [{"role_index": 0, "type": "CEO", "quote": None}]}
    short = {**good, "dimensions": {d: dim for d in fixed.SCORED_DIMS[:-1]}}
    raw = [("g", 0, json.dumps(good)), ("b", 0, json.dumps(bad)), ("s", 0, json.dumps(short)), ("n", 0, "not json")]
    runs = model_outputs.parse_runs(spark.createDataFrame(raw, "doc_id string, run_ix int, payload string"))
    got = {r.doc_id: set(r.problems) for r in validity.run_problems(runs).collect()}
    assert got["g"] == set() and got["b"] == {"score_range", "role_index", "role_type"} and got["s"] == {"all_dimensions"} and "parsed" in got["n"]
    assert {r.doc_id for r in validity.invalid_documents(runs).collect()} == {"b", "s", "n"}
    briefs = model_outputs.read_briefs(spark.createDataFrame([(json.dumps({"why_ranked_here": "ok", "top_strengths": ["a", "b", "c"], "top_gaps": [], "interview_probes": ["p", "Any career break?", "q"], "invite_line": "Your score was high", "what_would_change_this_score": "x"}),)], "payload string"))
    assert validity.brief_problems(briefs).first().problems == []
    assert validity.brief_topics(briefs).first().topics == ["probe 2 touches a forbidden topic", "invite_line touches a forbidden topic"]
    clean = validity.sanitise_briefs(briefs).first()
    assert (clean.interview_probes, clean.invite_line, clean.removed) == (["p", "q"], "", ["probe", "invite_line"])
    configs = {"ok": fixed.DEFAULT_CONFIG, "bad": {**fixed.DEFAULT_CONFIG, "tiers": {"A": 50, "B": 55, "C": 40}, "runsPerCv": 4, "weights": {**fixed.DEFAULT_CONFIG["weights"], "PM": {"D1": 31, "D8": 69}}}}
    assert {(r.pool_id, r.rule) for r in validity.config_problems(cfg.config_frame(spark, configs)).collect()} == {("bad", "tiers_descend"), ("bad", "runs_three_or_five")}
    assert {(r.pool_id, r.role, r.rule) for r in validity.weight_problems(cfg.weight_rows(spark, configs)).collect()} == {("bad", "PM", r) for r in ("unknown_dimension", "weight_range", "all_dimensions")}


def test_files_and_stages(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.docx").write_bytes(b"PK\x03\x04rest")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-1.7")
    (tmp_path / "in" / "c.pdf").write_bytes(b"hello")
    kinds = files.read_binary(spark, str(tmp_path / "in")).select(F.substring_index("path", "/", -1).alias("n"), files.file_kind(F.col("content")).alias("k"))
    assert {r.n: r.k for r in kinds.collect()} == {"a.docx": "docx", "b.pdf": "pdf", "c.pdf": None}
    pool, doc = "0" * 8 + "-0000-0000-0000-" + "0" * 12, "1" * 8 + "-0000-0000-0000-" + "1" * 12
    rows = [(f"{pool}/{doc}.pdf", 10, "x.PDF", "PM", False)] * 2 + [(f"{pool}/{doc}.docx", 10, "x.docx", "PM", False), ("odd/path.pdf", 10, "x.pdf", "PM", False), (f"{pool}/{doc[:-1]}2.pdf", 11 * 2**20, "x.pdf", "PM", False)]
    up = spark.createDataFrame(rows, "path string, length bigint, file_name string, role_applied string, legacy boolean")
    known = spark.createDataFrame([(f"{pool}/{doc}.docx",)], "file_path string")
    pools = spark.createDataFrame([(pool, None)], "pool_id string, closed_at timestamp")
    assert [r.file_path for r in files.intake(up, known, pools).collect()] == [f"{pool}/{doc}.pdf"]
    (tmp_path / "terms.txt").write_text("# comment\n Mumbai \n\nNew Delhi\n")
    assert [r.term for r in files.load_terms(spark, str(tmp_path / "terms.txt")).collect()] == ["Mumbai", "New Delhi"]
    root = str(tmp_path / "stages")
    with pytest.raises(FileNotFoundError):
        stages.read_stage(spark, root, "t")
    for n in (3, 5):
        stages.write_stage(spark.range(n).withColumn("pool_id", F.lit("p")), root, "t", "pool_id")
    assert (stages.current_version(spark, root, "t"), stages.read_stage(spark, root, "t").count()) == (2, 5)


def test_links_and_locks(spark):
    who = spark.createDataFrame([("a", "p", "k"), ("b", "p", "k"), ("c", "p", "k"), ("x", "q", "k"), ("n", "p", "z")], "candidate_id string, pool_id string, record_key string")
    links = identity.link_groups(who)
    assert {r.candidate_id: r.n_linked for r in links.collect()} == {"a": 2, "b": 2, "c": 2, "x": 0, "n": 0}
    ev = spark.createDataFrame([("a", "PM", None), ("b", "SPM", "declined"), ("c", "PM", "hold")], "candidate_id string, role_applied string, pipeline_status string")
    asked = spark.createDataFrame([("a",), ("n",)], "candidate_id string")
    assert [(r.candidate_id, r.linked_id) for r in identity.open_applications(links, asked, ev).collect()] == [("a", "c")]
    pools = spark.createDataFrame([("p", None), ("q", at(-5))], "pool_id string, locked_at timestamp")
    made = spark.createDataFrame([("e1", at(9)), ("e1", at(3))], "evaluation_id string, decided_at timestamp")
    locked = decisions.lock_times(pools, made, spark.createDataFrame([("e1", "p")], "doc_id string, pool_id string"))
    assert {r.pool_id: r.locked_at for r in locked.collect()} == {"p": at(3), "q": at(-5)}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_run_is_parsed_once_for_its_parts(spark, tmp_path):
    from sieveline.plans import output_bindings

    quote = {"quote": "q", "primary": True}
    full = {
        "dimensions": {"D1": {"score": 3, "evidence": [quote, quote]}, "D2": {"score": None, "evidence": None}, "D3": None, "other": {"score": 1}},
        "d7_qualifiers": {"built_from_zero": {"value": True, "quote": None}, "odd": {"value": None, "quote": "q"}, "none": {}, "null": None},
        "role_types": [{"role_index": 2, "type": "PM", "quote": "q"}, None, {"type": None}],
    }
    raw = [("a", 0, json.dumps(full)), ("a", 1, json.dumps({**full, "dimensions": None})), ("b", 0, "not json"), ("c", 0, None), ("d", 0, "{}"), (None, 0, json.dumps(full))]
    runs = model_outputs.parse_runs(spark.createDataFrame(raw, "doc_id string, run_ix int, payload string"))
    rows = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    dims = model_outputs.run_dims(runs).selectExpr("doc_id", "run_ix", "'dimension'", "dim", "bigint(score)", "bigint(size(evidence))")
    asked = model_outputs.run_qualifiers(runs).filter("quote is not null or value is not null")
    asked = asked.selectExpr("doc_id", "run_ix", "'qualifier'", "qualifier", "bigint(coalesce(int(value), 0))", "bigint(quote is not null)")
    roles = model_outputs.run_role_types(runs).selectExpr("doc_id", "run_ix", "'role'", "type", "bigint(role_index)", "bigint(quote is not null)")
    parts = model_outputs.run_parts(runs)
    assert rows(parts) == rows(dims.union(asked).union(roles)) and parts.count() == 21
    line = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame([(1, 2, 3, 1, 30.0, 0.01, 0.02, "A", T0), (1, 3, 4, 7, 9.0, 0.08, 0.07, "N", T0)], line).write.parquet(f"{tmp_path}/lineitem.parquet")
    opened = output_bindings.run_rows(spark, str(tmp_path))
    assert plan(opened).count("from_json") == 1
    got = {(r.part, r.name): (r.n, r.total, r.quotes) for r in opened.collect()}
    assert (got["dimension", "D1"], got["dimension", "D9"], got["qualifier", "built_from_zero"]) == ((2, 2, 7), (1, 2, 3), (2, 1, 2))
    assert (got["qualifier", "senior_pm_layer_above"], got["role", "PM"], got["role", "OTHER"]) == ((1, 0, 0), (2, 6, 2), (2, 4, 2))


def test_runs_are_checked_as_they_are_rendered(spark, tmp_path):
    from sieveline.plans import output_bindings

    row = (1, 5, 3, 1, 30.0, 0.03, 0.01, "A", dt.datetime(1994, 1, 1))
    odd = [(2, None, -1, 7, None, 0.05, 0.03, None, None), (3, 17, 4, 2, 1.0, 0.0, 0.06, "N", None), (None, 22, None, None, 50.0, None, None, "R", dt.datetime(1999, 1, 1)), (4, 5, 3, 2, 30.0, 0.03, 0.01, "R", dt.datetime(1999, 1, 1))]
    names = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_shipdate timestamp"
    spark.createDataFrame([row, *odd], names).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.doc_id: r.payload for r in output_bindings.scoring_payloads(spark, str(tmp_path)).collect()}
    quotes = [{"quote": f"quote {i}", "primary": i == 1} for i in (1, 2, 3)]
    dim = {"score": 2, "evidence_status": "absent", "evidence": quotes, "confidence": "high", "rationale": "because it says so"}
    asked = {"built_from_zero": {"value": True, "quote": "q"}, "early_stage_exposure": {"value": True, "quote": "q"}, "senior_pm_layer_above": {"value": False}}
    roles = [{"role_index": 0, "type": "CEO", "quote": "q"}, {"role_index": 2, "type": "OTHER", "quote": "r"}]
    compact = lambda x: json.dumps(x, separators=(",", ":"))
    assert got[1] == compact({"dimensions": {d: dim for d in fixed.SCORED_DIMS}, "d7_qualifiers": asked, "role_types": roles})
    assert json.loads(got[2])["dimensions"]["D1"] == {"evidence_status": "present", "confidence": "high"} and "D9" not in json.loads(got[2])["dimensions"]
    assert got[3] == '{"dimensions":{"D1":{"score":0,"evidence'
    assert json.loads(got[None])["dimensions"]["D1"] == {"score": 7, "evidence_status": "present", "evidence": [], "confidence": "sure", "rationale": "because it says so"}
    assert json.loads(got[None])["role_types"][0] == {"type": "PM", "quote": "q"} and "senior_pm_layer_above" not in json.loads(got[None])["d7_qualifiers"]
    bad, named = output_bindings.invalid_outputs(spark, str(tmp_path)), output_bindings.run_problems(spark, str(tmp_path))
    assert sorted(str(r.doc_id) for r in bad.collect()) == ["1", "2", "3", "None"]
    assert {r.problem for r in named.collect() if r.doc_id == 1} == {"role_index", "role_type"} and not [r for r in named.collect() if r.doc_id == 4]
    for checked in (bad, named):
        assert plan(checked).count("from_json") == 1 and all("lineitem" in f for f in checked.inputFiles())
    cores = spark.sparkContext.defaultParallelism
    assert output_bindings.scoring_payloads(spark, str(tmp_path)).rdd.getNumPartitions() == 4 * cores
    dealt = spark.range(99).coalesce(1)
    assert [skew.spread(dealt, "id", **asked).rdd.getNumPartitions() for asked in ({}, {"per_core": 3})] == [cores, 3 * cores]
