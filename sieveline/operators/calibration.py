"""The calibration gate and the regression compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import fixed

TOP_LABEL = "Exceeds"


def verdict(labels: DataFrame, ranked: DataFrame, core: str = "core_score", label: str = "label", top: object = TOP_LABEL) -> DataFrame:
    """One row: complete and the lowest top-labelled core above the highest of the others; the margin.

    A label without a result counts as missing, and a missing result fails the gate.
    """
    joined = labels.join(ranked.select("doc_id", core), "doc_id", "left")
    is_top = F.col(label) == F.lit(top)
    out = joined.agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_and(F.col(core).isNotNull()).alias("complete"),
        F.min(F.when(is_top, F.col(core))).alias("min_top"),
        F.max(F.when(~is_top, F.col(core))).alias("max_others"),
    )
    passed = F.coalesce(F.col("complete") & (F.col("min_top") > F.col("max_others")), F.lit(False))
    return out.withColumns({"margin": F.col("min_top") - F.col("max_others"), "passed": passed})


def dimension_differences(labels: DataFrame, dims: DataFrame) -> DataFrame:
    """(doc_id, label, dim, got, reference) where a combined score is not the reference one."""
    core_dims = fixed.COUNTED_DIMS["PM"]
    expected = labels.select(
        "doc_id", "label",
        F.inline(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"reference.{d}").alias("reference_score")) for d in core_dims])),
    )
    got = dims.select("doc_id", "dim", F.col("score").alias("got"), *[c for c in ("run_scores",) if c in dims.columns])
    return expected.join(got, ["doc_id", "dim"]).filter(F.col("got") != F.col("reference_score"))


def tier_close(expected: Column, got: Column, also: Column | None = None) -> Column:
    """Within one tier; R must be exactly R; listed alternates pass."""
    order = F.array(*[F.lit(t) for t in ("A", "B", "C", "D")])
    near = F.abs(F.array_position(order, expected) - F.array_position(order, got)) <= 1
    ok = F.when((expected == "R") | (got == "R"), expected == got).otherwise(near)
    return ok if also is None else ok | F.coalesce(F.array_contains(also, got), F.lit(False))


def regression(expected: DataFrame, ranked: DataFrame) -> DataFrame:
    """Expected against actual per case: tier within tolerance, missing and unexpected flags.

    ``expected``: (doc_id, tier, also_acceptable, flags, not_flags). A case with no result counts as R.
    """
    e = expected.select(
        "doc_id", F.col("tier").alias("expected_tier"), "also_acceptable", F.col("flags").alias("expected_flags"), "not_flags"
    )
    none = F.array().cast("array<string>")
    joined = e.join(ranked.select("doc_id", "tier", "flags"), "doc_id", "left").withColumns(
        {"tier": F.coalesce("tier", F.lit("R")), "flags": F.coalesce("flags", none)}
    )
    out = joined.withColumns(
        {
            "tier_ok": tier_close(F.col("expected_tier"), F.col("tier"), F.col("also_acceptable")),
            "missing": F.array_except(F.coalesce("expected_flags", none), F.col("flags")),
            "unexpected": F.array_intersect(F.coalesce("not_flags", none), F.col("flags")),
        }
    )
    return out.withColumn("passed", F.col("tier_ok") & (F.size("missing") == 0) & (F.size("unexpected") == 0))
