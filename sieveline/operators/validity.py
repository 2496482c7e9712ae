"""Validity reports: rows that break a rule are named, never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions.bind import bind
from sieveline.functions.patterns import matches
from sieveline.functions.text import token_count


def named(rules: dict[str, Column]) -> Column:
    """Names of the broken rules; a rule that cannot be told counts as broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(n)) for n, ok in rules.items()]))


def _member(column: str, domain: list[str], nullable: bool = False) -> Column:
    ok = F.col(column).isin(*domain)
    return F.col(column).isNull() | ok if nullable else ok


def evaluation_rules() -> dict[str, Column]:
    return {
        "needs_review_is_tier_r": (F.col("status") != "needs_review") | F.col("tier").eqNullSafe(F.lit("R")),
        "status_domain": _member("status", fixed.EVAL_STATUSES),
        "role_applied_domain": _member("role_applied", fixed.ROLES_APPLIED),
        "tier_domain": _member("tier", fixed.TIERS, nullable=True),
        "pipeline_status_domain": _member("pipeline_status", fixed.PIPELINE_STATUSES, nullable=True),
    }


def email_rules() -> dict[str, Column]:
    return {
        "decision_unless_digest": (F.col("kind") == "digest") == F.col("decision_id").isNull(),
        "kind_domain": _member("kind", fixed.EMAIL_KINDS),
        "email_status_domain": _member("status", fixed.EMAIL_STATUSES),
    }


def decision_rules() -> dict[str, Column]:
    return {
        "action_domain": _member("action", fixed.ACTIONS),
        "prev_status_domain": _member("prev_pipeline_status", fixed.PIPELINE_STATUSES),
        "tier_domain": _member("recommended_tier", fixed.TIERS, nullable=True),
    }


def violations(rows: DataFrame, rules: dict[str, Column], id_col: str) -> DataFrame:
    """(id, rule) for every broken rule."""
    return rows.select(id_col, F.explode(named(rules)).alias("rule"))


def violation_counts(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n) with every rule listed, in one pass over the rows."""
    counts = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"r{i}") for i, ok in enumerate(rules.values())]
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"r{i}").alias("n")) for i, n in enumerate(rules)])
    return rows.agg(*counts).select(F.inline(pairs))


def run_problems(runs: DataFrame) -> DataFrame:
    """Scoring runs with the rules they break; a run with any goes to review as invalid output."""

    def rules(run: Column) -> dict[str, Column]:
        dims = run["dimensions"]

        def every(test) -> Column:
            return F.forall(F.map_values(dims), test)

        return {
            "parsed": run.isNotNull() & dims.isNotNull(),
            "all_dimensions": F.size(F.array_except(F.array(*[F.lit(d) for d in fixed.SCORED_DIMS]), F.map_keys(dims))) == 0,
            "score_range": every(lambda d: F.coalesce(d["score"].between(0, 4), F.lit(False))),
            "evidence_status": every(lambda d: F.coalesce(d["evidence_status"].isin(*fixed.EVIDENCE_STATUSES), F.lit(False))),
            "confidence": every(lambda d: F.coalesce(d["confidence"].isin(*fixed.CONFIDENCES), F.lit(False))),
            "evidence_count": every(lambda d: F.coalesce(F.size(d["evidence"]) <= fixed.MAX_EVIDENCE, F.lit(False))),
            "evidence_shape": every(
                lambda d: F.forall(d["evidence"], lambda e: e["quote"].isNotNull() & e["primary"].isNotNull())
            ),
            "rationale": every(lambda d: d["rationale"].isNotNull()),
            "qualifiers": F.forall(
                F.array(*[F.lit(q) for q in fixed.QUALIFIERS]),
                lambda q: F.coalesce(F.element_at(run["d7_qualifiers"], q)["value"].isNotNull(), F.lit(False)),
            ),
            "role_index": F.forall(run["role_types"], lambda t: F.coalesce(t["role_index"] >= 1, F.lit(False))),
            "role_type": F.forall(run["role_types"], lambda t: F.coalesce(t["type"].isin(*fixed.ROLE_TYPES), F.lit(False))),
        }

    # The run is parsed once, however many rules read it.
    return runs.withColumn("problems", bind(F.col("run"), lambda run: named(rules(run))))


def invalid_documents(runs: DataFrame) -> DataFrame:
    """Documents with a run that is not valid: tier R, reason invalid_output."""
    bad = run_problems(runs).groupBy("doc_id").agg(F.bool_or(F.size("problems") > 0).alias("bad"))
    return bad.filter("bad").select("doc_id", F.lit("R").alias("tier"), F.lit("invalid_output").alias("tier_reason"))


def brief_problems(briefs: DataFrame) -> DataFrame:
    filled = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))) > 0
    each_filled = lambda c: F.forall(c, lambda t: F.length(t) > 0)
    rules = {
        "why_words": filled("why_ranked_here") & (token_count(F.col("why_ranked_here")) <= 60),
        "three_strengths": (F.size("top_strengths") == 3) & each_filled("top_strengths"),
        "gaps": F.col("top_gaps").isNotNull() & (F.size("top_gaps") <= 3) & each_filled("top_gaps"),
        "probes": F.size("interview_probes").between(3, 5) & each_filled("interview_probes"),
        "invite_words": filled("invite_line") & (token_count(F.col("invite_line")) <= 30),
        "one_change": filled("what_would_change_this_score"),
    }
    return briefs.withColumn("problems", named(rules))


def forbidden(text: Column) -> Column:
    return matches(text, fixed.BRIEF_FORBIDDEN_PATTERN)


def forbidden_invite(text: Column) -> Column:
    return forbidden(text) | matches(text, fixed.INVITE_FORBIDDEN_PATTERN)


def brief_topics(briefs: DataFrame) -> DataFrame:
    """Which parts of a brief touch a topic it must not."""
    probes = F.transform(
        F.filter(
            F.transform("interview_probes", lambda p, i: F.struct(p.alias("text"), (i + 1).alias("at"))),
            lambda p: forbidden(p["text"]),
        ),
        lambda p: F.concat(F.lit("probe "), p["at"].cast("string"), F.lit(" touches a forbidden topic")),
    )
    rest = F.array_compact(
        F.array(
            F.when(forbidden_invite(F.col("invite_line")), F.lit("invite_line touches a forbidden topic")),
            F.when(forbidden(F.col("why_ranked_here")), F.lit("why_ranked_here touches a forbidden topic")),
        )
    )
    return briefs.withColumn("topics", F.concat(probes, rest))


def sanitise_briefs(briefs: DataFrame) -> DataFrame:
    """Forbidden probes dropped, a forbidden line blanked; ``removed`` names what went."""
    bad_probes = F.transform(F.filter("interview_probes", forbidden), lambda _: F.lit("probe"))
    bad_invite, bad_why = forbidden_invite(F.col("invite_line")), forbidden(F.col("why_ranked_here"))
    removed = F.concat(
        bad_probes,
        F.array_compact(F.array(F.when(bad_invite, F.lit("invite_line")), F.when(bad_why, F.lit("why_ranked_here")))),
    )
    return briefs.withColumns(
        {
            "removed": removed,
            "interview_probes": F.filter("interview_probes", lambda p: ~forbidden(p)),
            "invite_line": F.when(bad_invite, "").otherwise(F.col("invite_line")),
            "why_ranked_here": F.when(bad_why, "").otherwise(F.col("why_ranked_here")),
        }
    )


def weight_problems(weights: DataFrame, key: str = "pool_id") -> DataFrame:
    """(key, role, rule) for weights out of range, sums other than 100, unknown and missing dimensions."""
    spark = weights.sparkSession
    known = spark.createDataFrame(
        [(r, d) for r, dims in fixed.WEIGHT_DIMS.items() for d in dims], "role string, dim string"
    )
    marked = weights.join(F.broadcast(known.withColumn("_known", F.lit(True))), ["role", "dim"], "left")
    whole = F.col("weight") == F.floor("weight")
    n_dims = F.coalesce(*[F.when(F.col("role") == r, len(d)) for r, d in fixed.WEIGHT_DIMS.items()], F.lit(0))
    per_role = marked.groupBy(key, "role").agg(
        F.count_if(F.col("_known").isNull()).alias("unknown"),
        F.count_if(~F.coalesce(F.col("weight").between(0, 30) & whole, F.lit(False))).alias("out_of_range"),
        F.sum("weight").alias("total"),
        F.countDistinct(F.when(F.col("_known"), F.col("dim"))).alias("seen"),
    )
    rules = {
        "unknown_dimension": F.col("unknown") == 0,
        "weight_range": F.col("out_of_range") == 0,
        "sum_100": F.col("total") == 100,
        "all_dimensions": F.col("seen") == n_dims,
    }
    return per_role.select(key, "role", F.explode(named(rules)).alias("rule"))


def config_problems(configs: DataFrame, key: str = "pool_id") -> DataFrame:
    """(key, rule) for pool settings outside their ranges (frame of config_frame columns)."""
    whole_from_one = lambda c: (F.col(c) >= 1) & (F.col(c) == F.floor(c))
    rules = {
        "tiers_descend": (F.col("tier_a") > F.col("tier_b")) & (F.col("tier_b") > F.col("tier_c")),
        "runs_three_or_five": F.col("runs_per_doc").isin(3, 5),
        "pm_floor": F.col("pm_floor") >= 0,
        "spm_floor": F.col("spm_floor") >= 0,
        "unstable_spread": whole_from_one("unstable_spread"),
        "hold_default_days": whole_from_one("hold_default_days"),
        "nudge_after_days": whole_from_one("nudge_after_days"),
        "retention_days": whole_from_one("retention_days"),
        "delays": (F.col("delay_advance") >= 1) & (F.col("delay_hold") >= 1) & (F.col("delay_decline") >= 1),
        "offer_target_date": F.col("offer_target_date").isNotNull(),
    }
    return configs.select(key, F.explode(named(rules)).alias("rule"))


def unknown_config_keys(configs: DataFrame, payload: Column, key: str = "pool_id") -> DataFrame:
    """(key, path) of every key in a configuration's JSON that no configuration has, at any level."""

    def levels(value: dict, path: str) -> list[tuple[str, list[str]]]:
        inner = [x for name, part in value.items() if isinstance(part, dict) for x in levels(part, f"{path}.{name}")]
        return [(path, list(value)), *inner]

    def strangers(path: str, known: list[str]) -> Column:
        keys = F.coalesce(F.json_object_keys(F.get_json_object(payload, path)), F.array().cast("array<string>"))
        before = F.lit(path[2:] + "." if path != "$" else "")
        return F.transform(F.filter(keys, lambda k: ~k.isin(known)), lambda k: F.concat(before, k))

    found = [strangers(path, known) for path, known in levels(fixed.DEFAULT_CONFIG, "$")]
    return configs.select(key, F.explode(F.concat(*found)).alias("path"))


def config_edits(edits: DataFrame, pools: DataFrame, first_decisions: DataFrame) -> DataFrame:
    """Verdict on each wish to change a pool's configuration: locked, closed, unchanged or accepted."""
    lock = F.least(F.coalesce("locked_at", "first_decided_at"), F.coalesce("first_decided_at", "locked_at"))
    joined = edits.join(pools, "pool_id").join(first_decisions, "pool_id", "left")
    verdict = (
        F.when(lock <= F.col("edited_at"), "locked")
        .when(F.col("closed_at") <= F.col("edited_at"), "closed")
        .when(F.col("new_hash") == F.col("config_hash"), "unchanged")
        .otherwise("accepted")
    )
    return joined.select(*edits.columns, verdict.alias("verdict"))
