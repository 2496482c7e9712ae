"""Years of relevant experience: months counted once, at their best rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import dates


def rate_of(role_type: Column) -> Column:
    """Share of a month a role of this type counts for."""
    ladder = F.when(F.lit(False), F.lit(0.0))
    for name, rate in fixed.ROLE_TYPE_RATE.items():
        ladder = ladder.when(role_type == name, F.lit(rate))
    return F.coalesce(ladder, F.lit(0.0))


def quarter_years(months: Column) -> Column:
    """Months as years, rounded half up to quarters."""
    return F.floor(months / 12 * 4 + 0.5) / 4


def years_from_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last, rate) → years per key.

    A span opens into its months; the best rate per month is taken before the months are added, and
    both steps merge before they shuffle.
    """
    months = spans.filter("rate > 0").select(*keys, "rate", F.explode(F.sequence("first", "last")).alias("month"))
    best = months.groupBy(*keys, "month").agg(F.max("rate").alias("rate"))
    return best.groupBy(*keys).agg(quarter_years(F.sum("rate")).alias("years"))


def profile_roles(profiles: DataFrame) -> DataFrame:
    """One row per role of a profile with the span of the role it was made from."""
    roles = profiles.select("doc_id", "as_of", F.col("roles").alias("_source"), F.explode("profile.roles").alias("r"))
    source = F.get("_source", F.col("r.source_index"))
    return roles.select(
        "doc_id",
        F.col("r.index").alias("role_index"),
        dates.role_span(source["start_raw"], source["end_raw"], F.col("as_of")).alias("span"),
    )


def compute_experience(profiles: DataFrame, voted: DataFrame) -> DataFrame:
    """Years, roles with their rates, and whether a counted role had dates nobody can read."""
    roles = profile_roles(profiles).join(voted, ["doc_id", "role_index"], "left").select(
        "doc_id", "role_index", "span", F.coalesce("type", F.lit("OTHER")).alias("type"), "quote"
    )
    rated = roles.withColumn("rate", rate_of(F.col("type")))
    years = years_from_spans(
        rated.filter(F.col("span").isNotNull()).select("doc_id", "span.first", "span.last", "rate"), ["doc_id"]
    )
    summary = rated.groupBy("doc_id").agg(
        F.bool_or((F.col("rate") > 0) & F.col("span").isNull()).alias("unparseable_dates"),
        F.array_sort(
            F.collect_list(F.struct("role_index", "type", F.col("span.months").alias("months"), "rate", "quote"))
        ).alias("roles"),
    )
    everyone = profiles.select("doc_id")
    return (
        everyone.join(summary, "doc_id", "left")
        .join(years, "doc_id", "left")
        .select(
            "doc_id",
            F.coalesce("years", F.lit(0.0)).alias("pm_relevant_years"),
            F.coalesce("roles", F.array().cast(dict(summary.dtypes)["roles"])).alias("roles"),
            F.coalesce("unparseable_dates", F.lit(False)).alias("unparseable_dates"),
        )
    )


def band_score(role: str, years: Column, built_from_zero: Column, early_stage: Column, senior_above: Column) -> Column:
    """Experience-fit score from half-open bands; the qualifiers lift 3 to 4 in the middle band."""
    low, start, end, top = fixed.YEARS_BANDS[role]
    lifted = built_from_zero if role == "PM" else ~senior_above & early_stage
    return (
        F.when(years <= 0, 0)
        .when(years < low, 1)
        .when(years < start, 2)
        .when(years < end, F.when(lifted, 4).otherwise(3))
        .when(years < top, 2)
        .otherwise(1)
    )
