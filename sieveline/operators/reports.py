"""What the reader of a pool sees: rows, shortlist, pipeline, evidence pack, digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import dates
from sieveline.operators.skew import join_per_key, latest_per_key, positions


def display_name(name: Column, file_name: Column, doc_id: Column) -> Column:
    return F.coalesce(name, file_name, F.concat(F.lit("CV "), F.substring(doc_id, 1, 8)))


def pool_rows(evaluations: DataFrame, candidates: DataFrame, emails: DataFrame, pool_id: str | None = None) -> DataFrame:
    """Evaluations with their person and the newest e-mail each was sent."""
    rows = evaluations if pool_id is None else evaluations.filter(F.col("pool_id") == pool_id)
    people = candidates.select("candidate_id", "display_name", "file_name", "no_contact")
    last = latest_per_key(
        emails.filter(F.col("evaluation_id").isNotNull()), ["evaluation_id"], [F.col("created_at"), F.col("email_id")],
        ["kind", "status", "created_at"],
    ).select(
        F.col("evaluation_id").alias("doc_id"), F.struct("kind", "status", F.col("created_at").alias("at")).alias("last_email")
    )
    joined = rows.join(people, "candidate_id").join(last, "doc_id", "left")
    return joined.withColumn("name", display_name(F.col("display_name"), F.col("file_name"), F.col("doc_id"))).drop(
        "display_name", "file_name"
    )


def used_role() -> Column:
    return F.coalesce("role_used", F.when(F.col("role_applied") == "SPM", "SPM").otherwise("PM"))


def ranked_total() -> Column:
    """The total the tier was computed on."""
    return F.coalesce(F.when(used_role() == "PM", F.col("pm_total")).otherwise(F.col("spm_total")), F.lit(0.0))


def better_fit() -> Column:
    """The other role when its total is ten points or more above."""
    ahead = F.col("spm_total") - F.col("pm_total")
    return F.when((used_role() == "PM") & (ahead >= fixed.BETTER_FIT_POINTS), "SPM").when(
        (used_role() == "SPM") & (-ahead >= fixed.BETTER_FIT_POINTS), "PM"
    )


def shortlist_filter(rows: DataFrame, role: str = "", tier: str = "", name_part: str = "") -> DataFrame:
    """Empty parameters filter nothing; the name test ignores case."""
    if role:
        rows = rows.filter(F.col("role_applied") == role)
    if tier:
        rows = rows.filter(F.col("tier") == tier)
    wanted = name_part.strip().lower()
    return rows.filter(F.contains(F.lower("name"), F.lit(wanted))) if wanted else rows


def sections_of() -> Column:
    """Sections a row is listed in: its tier and, with the flag, the wildcards; or in progress."""
    done = F.col("status").isin("scored", "needs_review") & F.col("tier").isNotNull()
    wild = F.when(F.array_contains("flags", "WILDCARD"), F.lit("WILDCARD"))
    return (
        F.when(done, F.array_compact(F.array(F.col("tier"), wild)))
        .when(F.col("status").isin("queued", "processing", "failed"), F.array(F.lit("IN_PROGRESS")))
        .otherwise(F.array().cast("array<string>"))
    )


def shortlist_sections(rows: DataFrame, keys: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """Rows per section with their place: by total downwards, then oldest first; review rows oldest first."""
    listed = rows.withColumns({"ranked_total": ranked_total(), "better_fit": better_fit()})
    listed = listed.withColumn("section", F.explode(sections_of()))
    by_total = F.when(F.col("section").isin("R", "IN_PROGRESS"), 0.0).otherwise(-F.col("ranked_total"))
    return positions(
        listed, [*(keys or []), "section"], [by_total, F.col("created_at"), F.col(id_col)], out="section_rank"
    )


def progress_chip() -> Column:
    """State of a document in words; ``prepared`` tells a redacted profile exists."""
    return (
        F.when((F.col("status") == "queued") & F.col("prepared"), "redacted · waiting to be scored")
        .when(F.col("status").isin("queued", "processing", "failed"), F.col("status"))
        .when(F.col("status") == "scored", F.concat(F.lit("scored · tier "), F.coalesce("tier", F.lit("null"))))
        .when(
            F.col("status") == "needs_review", F.concat(F.lit("needs review · "), F.coalesce("tier_reason", F.lit("null")))
        )
    )


def upload_list(evaluations: DataFrame, candidates: DataFrame, pool_id: str) -> DataFrame:
    """Newest first; whether a profile exists is told, its text is not."""
    prepared = F.coalesce(F.length("redacted_profile_text") > 0, F.lit(False))
    rows = evaluations.filter(F.col("pool_id") == pool_id).withColumn("prepared", prepared)
    joined = rows.join(candidates.select("candidate_id", "file_name"), "candidate_id").withColumn("chip", progress_chip())
    return joined.select(
        "doc_id", "file_name", "role_applied", "status", "prepared", "tier", "tier_reason", "flags", "last_error", "created_at", "chip"
    ).orderBy(F.desc("created_at"), "doc_id")


def pipeline_rank(status: Column) -> Column:
    order = F.array(*[F.lit(s) for s in fixed.PIPELINE_ORDER])
    at = F.array_position(order, F.coalesce(status, F.lit("")))
    return F.when(at == 0, 99).otherwise(at - 1).cast("int")


def pipeline_table(rows: DataFrame, now: Column, id_col: str = "doc_id") -> DataFrame:
    """Everyone, furthest along first, longest in status first: one range-partitioned sort."""
    out = rows.withColumns(
        {
            "status_rank": pipeline_rank(F.col("pipeline_status")),
            "days_in_status": dates.whole_days(F.col("pipeline_status_at"), now),
            "shown_status": F.coalesce("pipeline_status", "status"),
        }
    )
    return out.orderBy("status_rank", F.desc(F.coalesce("days_in_status", F.lit(0))), id_col)


def pipeline_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        *[F.count_if(F.col("pipeline_status") == s).alias(f"n_{s}") for s in fixed.PIPELINE_STATUSES]
    )


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """The newest decision of each evaluation that was not undone."""
    active = decisions.filter(F.col("undone_at").isNull())
    columns = [c for c in decisions.columns if c not in ("evaluation_id", "undone_at")]
    return latest_per_key(active, ["evaluation_id"], [F.col("decided_at"), F.col("decision_id")], columns)


def newest_pool(pools: DataFrame) -> DataFrame:
    return pools.orderBy(F.desc("created_at"), "pool_id").limit(1)


def open_pools(pools: DataFrame) -> DataFrame:
    return pools.filter(F.col("closed_at").isNull()).agg(F.count(F.lit(1)).alias("n_open"))


def calibration_gate(pools: DataFrame, calibrations: DataFrame, model_id: str) -> DataFrame:
    """Pools whose rubric, configuration and model passed a calibration."""
    passed = calibrations.filter(F.col("passed") & (F.col("model_id") == model_id)).select("rubric_hash", "config_hash")
    return pools.join(passed, ["rubric_hash", "config_hash"], "left_semi")


def decision_overrides(decisions: DataFrame) -> DataFrame:
    """How often the active decision agrees with the tier recommended at the time: A advance, C hold, D decline."""
    agreed = F.when(F.col("recommended_tier") == "A", F.col("action") == "advance").when(
        F.col("recommended_tier") == "C", F.col("action") == "hold"
    ).when(F.col("recommended_tier") == "D", F.col("action") == "decline")
    return (
        latest_decisions(decisions)
        .withColumn("agreed", agreed)
        .groupBy("recommended_tier")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("agreed").alias("n_agreed"), F.avg(F.col("agreed").cast("int")).alias("agreement"))
    )


def in_words(keys: Column, table: dict[str, str]) -> Column:
    """Each key replaced by its text, or kept when there is none."""
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.transform(keys, lambda k: F.coalesce(F.element_at(lookup, k), k))


def reason_text(tier_reason: Column) -> Column:
    return F.array_join(in_words(F.split(tier_reason, ", "), fixed.TIER_REASON_TEXT), " ")


def evidence_pack(ranked: DataFrame, dims: DataFrame, config: dict) -> DataFrame:
    """JSON pack per document for the brief: verified quotes only, totals to one decimal.

    ``dims`` hold at most one row per dimension, so a document's list is eight long at the most.
    """
    names = F.create_map(*[F.lit(x) for pair in fixed.DIM_NAMES.items() for x in pair])
    weight_of = {
        role: F.create_map(*[F.lit(x) for d, w in config["weights"][role].items() for x in (d, w)])
        for role in fixed.ROLE_TITLES
    }
    order = F.array(*[F.lit(d) for d in fixed.SCORED_DIMS])
    role_of = ranked.select("doc_id", "role_used")
    weight = F.when(F.col("role_used") == "PM", F.element_at(weight_of["PM"], F.col("dim"))).otherwise(
        F.element_at(weight_of["SPM"], F.col("dim"))
    )
    counted = F.when(F.col("role_used") == "PM", F.col("dim").isin(*fixed.COUNTED_DIMS["PM"])).otherwise(True)
    nothing = F.array().cast("array<string>")
    entry = F.struct(
        F.array_position(order, F.col("dim")).alias("_at"),
        F.col("dim").alias("dimension"),
        F.element_at(names, F.col("dim")).alias("name"),
        weight.alias("weight"),
        "score", "evidence_status", "confidence",
        F.when(F.col("quote_mismatch"), nothing).otherwise(F.transform("evidence", lambda e: e["quote"])).alias("verified_quotes"),
        F.when(F.col("quote_mismatch"), F.lit(fixed.QUOTE_NOT_FOUND)).otherwise(F.col("rationale")).alias("rationale"),
    )
    packed = (
        dims.join(role_of, "doc_id")
        .filter(counted)
        .groupBy("doc_id")
        .agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e.dropFields("_at")).alias("dimensions"))
    )
    as_pm = F.col("role_used") == "PM"
    flags = F.filter("flags", lambda f: ~f.isin("LEGACY", "NO_CONTACT"))
    flag_texts = F.create_map(*[F.lit(x) for pair in fixed.FLAG_TEXT.items() for x in pair])
    pack = F.struct(
        F.when(as_pm, fixed.ROLE_TITLE_TEXT["PM"]).otherwise(fixed.ROLE_TITLE_TEXT["SPM"]).alias("role"),
        "tier",
        dates.half_up(F.when(as_pm, F.col("pm_total")).otherwise(F.col("spm_total")), 1).alias("total"),
        dates.half_up(F.col("core_score"), 1).alias("core_score"),
        F.transform(
            flags, lambda f: F.struct(f.alias("flag"), F.coalesce(F.element_at(flag_texts, f), f).alias("meaning"))
        ).alias("flags"),
        F.struct(
            F.lit("D7").alias("dimension"), F.lit(fixed.DIM_NAMES["D7"]).alias("name"),
            F.when(as_pm, F.col("d7_pm")).otherwise(F.col("d7_spm")).alias("score"),
            F.when(as_pm, config["weights"]["PM"]["D7"]).otherwise(config["weights"]["SPM"]["D7"]).alias("weight"),
        ).alias("experience_fit"),
        "dimensions",
    )
    return ranked.join(packed, "doc_id").select("doc_id", F.to_json(pack).alias("evidence"))


# ---- daily digest ----


def digest_counts(rows: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """One row per pool: waiting, oldest wait in days, pipeline counts."""
    waiting = F.col("status").isin("scored", "needs_review") & (F.coalesce("pipeline_status", F.lit("scored")) == "scored")
    days = dates.whole_days(F.coalesce("pipeline_status_at", "created_at"), now)
    return rows.groupBy(*keys).agg(
        F.count_if(waiting).alias("n_waiting"),
        F.greatest(F.coalesce(F.max(F.when(waiting, days)), F.lit(0)), F.lit(0)).alias("oldest_days"),
        *[F.count_if(F.col("pipeline_status") == s).alias(f"n_{s}") for s in ("advanced", "booked", "interviewed", "offer")],
    )


def digest_items(rows: DataFrame, decisions: DataFrame, emails: DataFrame, today: Column) -> DataFrame:
    """(pool_id, section, doc_id, name): holds due, interviewed with no next step, not booked, bounced.

    Sections are rows, not lists: a section may hold any number of names. A hold is listed under the
    pool its evaluation is in.
    """
    due = (
        decisions.filter(
            (F.col("action") == "hold") & F.col("undone_at").isNull() & (F.col("hold_until") <= today)
        )
        .select(F.col("evaluation_id").alias("doc_id"))
        .distinct()
        .withColumn("hold_due", F.lit(True))
    )
    nudged = (
        emails.filter((F.col("kind") == "nudge") & F.col("status").isin("sent", "delivered"))
        .select(F.col("evaluation_id").alias("doc_id"))
        .distinct()
        .withColumn("nudged", F.lit(True))
    )
    joined = rows.join(due, "doc_id", "left").join(nudged, "doc_id", "left")
    status = F.col("pipeline_status")
    suffix = F.when(F.col("nudged"), " (nudged)").otherwise("")
    entries = F.array_compact(
        F.array(
            F.when(F.col("hold_due") & (status == "hold"), F.struct(F.lit("holds_due").alias("section"), F.col("name").alias("name"))),
            F.when(status == "interviewed", F.struct(F.lit("interviewed").alias("section"), F.col("name").alias("name"))),
            F.when(status == "advanced", F.struct(F.lit("not_booked").alias("section"), F.concat("name", suffix).alias("name"))),
            F.when(F.array_contains("flags", "BOUNCED"), F.struct(F.lit("bounced").alias("section"), F.col("name").alias("name"))),
        )
    )
    return joined.select("pool_id", "doc_id", F.inline(entries)).select("pool_id", "section", "doc_id", "name")


def digest_lists(items: DataFrame) -> DataFrame:
    """(pool_id, section, n, position, name): every name in its place in its list, however long the list."""
    keys = ["pool_id", "section"]
    placed = positions(items, keys, [F.col("doc_id"), F.col("name")])
    counts = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return join_per_key(placed, counts, keys, "n").select("pool_id", "section", "n", "position", "name")


def digest_parts(counts: DataFrame, lists: DataFrame, configs: DataFrame, now: Column, dashboard_url: str) -> DataFrame:
    """One message per pool in parts: (pool_id, idempotency_key, subject, line, position, text).

    The texts of a pool's parts in the order of line and position are its message; a list of names has
    one part per name, so no list is put together in one task. The key keeps a message to one a day.
    """
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("0"))
    joined = counts.join(configs.select("pool_id", "offer_target_date"), "pool_id")
    joined = joined.withColumn("weeks_left", dates.weeks_left(F.col("offer_target_date"), now))
    sizes = lists.filter("position = 1").groupBy("pool_id").pivot("section", list(fixed.DIGEST_LISTS)).agg(F.max("n"))
    heads = joined.join(sizes, "pool_id", "left").select(
        "pool_id", *joined.columns[1:], *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in fixed.DIGEST_LISTS]
    )
    parts = [
        (1, F.lit(0), F.concat(*[F.lit(p) if p[0] != "{" else F.lit(dashboard_url) if p == "{url}" else cell(p[1:-1]) for p in fixed.DIGEST_WAITING])),
        (6, F.lit(0), F.concat(*[F.lit(p) if p[0] != "{" else cell(p[1:-1]) for p in fixed.DIGEST_PIPELINE])),
    ]
    for line, (section, label) in enumerate(fixed.DIGEST_LISTS.items(), start=2):
        size = F.col(section)
        parts.append((line, F.lit(0), F.concat(F.lit(label), size.cast("string"), F.when(size > 0, " (").otherwise("\n"))))
        parts.append((line, size + 1, F.when(size > 0, F.lit(")\n"))))
    due = F.col("holds_due")
    parts += [(0, F.lit(0), F.when(due > 0, F.lit(fixed.DIGEST_LEAD[0]))), (0, due + 1, F.when(due > 0, F.lit(fixed.DIGEST_LEAD[1])))]
    entries = F.array(*[F.struct(F.lit(line).alias("line"), position.cast("bigint").alias("position"), text.alias("text")) for line, position, text in parts])
    key = F.concat(F.lit("digest:"), dates.local_date(now).cast("string")).alias("idempotency_key")
    subject = F.concat(F.lit("Hiring: "), cell("n_waiting"), F.lit(" waiting · "), cell("weeks_left"), F.lit(" weeks to target")).alias("subject")
    frame = heads.select("pool_id", key, subject, F.inline(F.filter(entries, lambda e: e["text"].isNotNull())))
    lines = F.create_map(*[x for k, s in enumerate(fixed.DIGEST_LISTS, start=2) for x in (F.lit(s), F.lit(k))])
    name = F.concat(F.when(F.col("position") > 1, ", ").otherwise(""), F.col("name"))
    # The names of due holds stand in their list and in the lead.
    places = F.when(F.col("section") == "holds_due", F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.try_element_at(lines, F.col("section"))))
    names = lists.select("pool_id", F.explode(places).alias("line"), "position", name.alias("text"))
    named = names.join(heads.select("pool_id", key, subject), "pool_id").select(*frame.columns)
    return frame.unionByName(named)
