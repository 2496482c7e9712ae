"""Totals, tier and flags. Pure: the same combined runs and configuration give the same rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.operators.experience import band_score


def _is(dims: list[str]) -> Column:
    return F.col("dim").isin(*dims)


def document_row(final_dims: DataFrame, keys: list[str]) -> DataFrame:
    """One row per document: its scores side by side and, per role, what the rules count.

    All states are numbers, so the aggregation hashes and merges before the shuffle.
    """
    scores = [F.max(F.when(F.col("dim") == d, F.col("score"))).alias(f"s_{d}".lower()) for d in fixed.SCORED_DIMS]
    counts = []
    evidenced = F.col("evidence_status").isin("present", "weak") & (F.col("confidence") != "low")
    for role, dims in fixed.COUNTED_DIMS.items():
        low = role.lower()
        counts += [
            F.count_if(_is(dims) & F.col("quote_mismatch")).alias(f"mismatches_{low}"),
            F.count_if(_is(dims) & (F.col("evidence_status") == "absent")).alias(f"absent_{low}"),
            F.count_if(_is(dims) & evidenced).alias(f"evidenced_{low}"),
            F.count_if(_is(dims) & (F.col("score") == 4)).alias(f"fours_{low}"),
            F.max(F.when(_is(dims), F.col("spread"))).alias(f"spread_{low}"),
        ]
    return final_dims.groupBy(*keys).agg(*scores, *counts)


def weighted_total(role: str, config: dict[str, Column], d7: Column | None = None) -> Column:
    """Sum of score/4 times weight; a missing score counts nothing."""
    total = F.lit(0.0)
    for dim in fixed.WEIGHT_DIMS[role]:
        score = d7 if dim == "D7" else F.col(f"s_{dim}".lower())
        if score is not None:
            total = total + F.coalesce(score, F.lit(0)) / 4.0 * config[f"w_{role}_{dim}".lower()]
    return total


def _listed(*conditions: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in conditions]))


def rank_rows(rows: DataFrame, config: dict[str, Column]) -> DataFrame:
    """Rank result columns for document rows that carry role_applied, years, unparseable_dates, the three
    qualifiers and copies_reference."""
    years = F.col("pm_relevant_years")
    quals = [F.coalesce(q, F.lit(False)) for q in fixed.QUALIFIERS]
    out = rows.withColumns({f"d7_{r.lower()}": band_score(r, years, *quals) for r in fixed.ROLE_TITLES})
    out = out.withColumns(
        {
            "pm_total": weighted_total("PM", config, F.col("d7_pm")),
            "spm_total": weighted_total("SPM", config, F.col("d7_spm")),
            "core_score": weighted_total("CORE", config),
        }
    )
    best = F.when(F.col("spm_total") > F.col("pm_total"), "SPM").otherwise("PM")
    out = out.withColumn("best_fit_role", best)
    out = out.withColumn(
        "role_used", F.when(F.col("role_applied") == "NOT_SURE", F.col("best_fit_role")).otherwise(F.col("role_applied"))
    )
    as_pm = F.col("role_used") == "PM"
    pick = lambda name: F.when(as_pm, F.col(f"{name}_pm")).otherwise(F.col(f"{name}_spm"))
    floor = F.when(as_pm, config["pm_floor"]).otherwise(config["spm_floor"])
    total = F.when(as_pm, F.col("pm_total")).otherwise(F.col("spm_total"))
    out = out.withColumns(
        {
            "_total": total,
            "_mismatches": pick("mismatches"),
            "_unstable": F.coalesce(pick("spread") >= config["unstable_spread"], F.lit(False)),
            "_below": (floor > 0) & (years < floor),
            "_d7": pick("d7"),
        }
    )
    score = lambda d: F.coalesce(F.col(f"s_{d}"), F.lit(0))
    applied = F.col("role_applied")
    flags = _listed(
        ((score("d1") <= 2) & (score("d2") >= 3) & (score("d3") >= 3) & (score("d4") >= 3), "WILDCARD"),
        (pick("fours") > 0, "VERIFY_CLAIM"),
        (F.col("_mismatches") > 0, "QUOTE_MISMATCH"),
        (F.col("_unstable"), "UNSTABLE_SCORE"),
        (F.coalesce("copies_reference", F.lit(False)), "INTEGRITY_CHECK"),
        (F.col("_below"), "BELOW_EXPERIENCE_BAND"),
        ((applied == "PM") & (years > 5) & (score("d3") >= 3), "CONSIDER_SPM"),
        ((applied == "SPM") & (years < 4), "CONSIDER_PM"),
        ((applied == "SPM") & (years > 10), "LEVEL_CHECK"),
    )
    review = _listed(
        (F.coalesce("unparseable_dates", F.lit(False)), "unparseable_dates"),
        (F.col("_unstable"), "unstable_score"),
        (F.col("_mismatches") >= 3, "quote_mismatch"),
        (pick("absent") >= 3, "absent_evidence"),
    )
    out = out.withColumns({"flags": flags, "_review": review})
    by_total = (
        F.when(F.size("_review") > 0, "R")
        .when(F.col("_total") < config["tier_c"], F.when(pick("evidenced") >= 4, "D").otherwise("R"))
        .when(F.col("_total") >= config["tier_a"], "A")
        .when(F.col("_total") >= config["tier_b"], "B")
        .otherwise("C")
    )
    out = out.withColumn("_tier", by_total)
    caps = _listed(
        (F.col("_below") & as_pm, "capped_pm_experience_floor"),
        (F.col("_below") & ~as_pm, "capped_spm_experience_floor"),
        (config["band_strict"] & (F.col("_d7") <= 2), "capped_experience_band"),
        (config["d1_gate"] & (score("d1") < 2), "capped_d1_gate"),
    )
    nothing = F.array().cast("array<string>")
    reasons = (
        F.when(F.size("_review") > 0, F.col("_review"))
        .when(F.col("_tier") == "R", F.array(F.lit("insufficient_evidence")))
        .when(F.col("_tier") == "A", caps)
        .otherwise(nothing)
    )
    out = out.withColumn("_reasons", reasons)
    out = out.withColumns(
        {
            "tier": F.when((F.col("_tier") == "A") & (F.size("_reasons") > 0), "B").otherwise(F.col("_tier")),
            "tier_reason": F.nullif(F.array_join("_reasons", ", "), F.lit("")),
        }
    )
    hidden = [c for c in out.columns if c.startswith("_")]
    return out.drop(*hidden)


def merge_flags(old: Column, ranked: Column) -> Column:
    """Flags that ranking does not set stay; ranking's own are replaced."""
    keep = F.array_except(old, F.array(*[F.lit(f) for f in fixed.RANK_FLAGS]))
    return F.array_union(keep, ranked)


def eval_status(tier: Column) -> Column:
    return F.when(tier == "R", "needs_review").otherwise("scored")
