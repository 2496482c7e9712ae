"""Repeated scoring runs become one result: medians, votes, the reuse limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline import fixed


def _counts_by_score() -> list[Column]:
    return [F.count_if(F.col("score") == s).alias(f"_n{s}") for s in range(5)]


def median_from_counts(counts: list[Column]) -> Column:
    """The value at position floor(n/2) of the sorted scores, from how often each score occurs."""
    total = sum(counts[1:], counts[0])
    ladder, seen = None, F.lit(0)
    for score, count in enumerate(counts):
        seen = seen + count
        reached = seen > F.floor(total / 2)
        ladder = F.when(reached, score) if ladder is None else ladder.when(reached, score)
    return ladder.cast("int")


def combine_dims(
    checked: DataFrame, keys: list[str], order: Column, carry: list[str], with_scores: bool = False
) -> DataFrame:
    """One row per document and dimension from its checked runs.

    Scores are 0..4, so a group is summed up by five counters and, per score, the earliest run: the
    state is the same size however many runs there are, and it is merged before the shuffle. ``order``
    is the run order; ``carry`` the columns taken from the earliest run whose score is the median.
    ``with_scores`` adds the scores of all runs in the order of ``run_ix``: a list as long as a document
    has runs, which is for runs that are few.
    """
    earliest = [
        F.min_by(F.when(F.col("score") == s, F.struct(*carry)), F.when(F.col("score") == s, order)).alias(f"_e{s}")
        for s in range(5)
    ]
    vector = []
    if with_scores:
        runs = F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("run_ix", "score"))))
        vector = [F.transform(runs, lambda r: r["score"]).alias("run_scores")]
    grouped = checked.groupBy(*keys).agg(
        *_counts_by_score(), *earliest, (F.max("score") - F.min("score")).alias("spread"),
        F.count("score").alias("n_runs"), *vector,
    )
    median = median_from_counts([F.col(f"_n{s}") for s in range(5)])
    chosen = F.get(F.array(*[F.col(f"_e{s}") for s in range(5)]), F.col("score"))
    out = grouped.withColumn("score", median).withColumn("_chosen", chosen)
    return out.select(*keys, "score", "spread", "n_runs", *(["run_scores"] if with_scores else []), "_chosen.*")


def vote(counts: dict[str, Column], missing: Column, tie_value: str) -> Column:
    """Winner of a categorical vote; a tie of the top two, or no vote, gives ``tie_value``.

    ``missing`` votes count for ``tie_value``.
    """
    pairs = F.array(
        *[
            F.struct((-(n + missing if value == tie_value else n)).alias("n"), F.lit(value).alias("value"))
            for value, n in counts.items()
        ]
    )
    ranked = F.array_sort(pairs)
    top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
    return F.when((top["n"] == 0) | (top["n"] == second["n"]), tie_value).otherwise(top["value"])


def vote_role_types(role_types: DataFrame, roles: DataFrame, runs: DataFrame) -> DataFrame:
    """Voted type of every profile role. ``role_types`` carry quote_ok; ``roles`` (doc_id, role_index);
    ``runs`` (doc_id, n_runs). A run's first answer for a role counts, later ones do not."""
    first = (
        role_types.groupBy("doc_id", "role_index", "run_ix")
        .agg(F.min_by(F.struct("type", "quote", "quote_ok"), F.col("position")).alias("v"))
        .select("doc_id", "role_index", "run_ix", "v.*")
    )
    owning = ["PM", "PRODUCT_OWNING"]
    votes = first.groupBy("doc_id", "role_index").agg(
        *[F.count_if(F.col("type") == t).alias(f"_n_{t}") for t in fixed.ROLE_TYPES],
        *[
            F.min_by(
                F.when((F.col("type") == t) & F.col("quote_ok"), F.col("quote")),
                F.when((F.col("type") == t) & F.col("quote_ok"), F.col("run_ix")),
            ).alias(f"_q_{t}")
            for t in owning
        ],
    )
    all_roles = roles.join(runs, "doc_id").join(votes, ["doc_id", "role_index"], "left")
    counts = {t: F.coalesce(f"_n_{t}", F.lit(0)) for t in fixed.ROLE_TYPES}
    missing = F.col("n_runs") - sum(list(counts.values())[1:], list(counts.values())[0])
    winner = vote(counts, missing, "OTHER")
    quote = F.when(winner == "PM", F.col("_q_PM")).when(winner == "PRODUCT_OWNING", F.col("_q_PRODUCT_OWNING"))
    kind = F.when(winner.isin(*owning) & quote.isNull(), "OTHER").otherwise(winner)
    return all_roles.select("doc_id", "role_index", kind.alias("type"), quote.alias("quote"))


def strict_majority(value: Column, quote_ok: Column, of: Column) -> Column:
    """More than half say yes, and one of those who do has a verified quote (an aggregate)."""
    return (F.count_if(value) * 2 > of) & F.coalesce(F.bool_or(value & quote_ok), F.lit(False))


def vote_qualifiers(qualifiers: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per document with a column per qualifier."""
    q = qualifiers.join(runs, "doc_id")
    aggs = [
        strict_majority(
            F.coalesce((F.col("qualifier") == name) & F.col("value"), F.lit(False)), F.col("quote_ok"), F.max("n_runs")
        ).alias(name)
        for name in fixed.QUALIFIERS
    ]
    return q.groupBy("doc_id").agg(*aggs)


def reuse_order() -> list[Column]:
    """Which uses of a bullet are kept first: primary, higher score, higher weight, earlier dimension."""
    dims = F.array(*[F.lit(d) for d in fixed.SCORED_DIMS])
    return [F.desc("primary"), F.desc("score"), F.desc("weight"), F.array_position(dims, F.col("dim")).asc()]


def limit_reuse(uses: DataFrame, keys: list[str], bullet: str) -> DataFrame:
    """Rank of each use of a bullet, the two kept dimensions, and whether this use is past the limit.

    ``uses`` hold one row per (keys, bullet, dim), so a bullet has as many rows as there are dimensions.
    """
    by_bullet = Window.partitionBy(*keys, bullet)
    ranked = uses.withColumn("use_rank", F.row_number().over(by_bullet.orderBy(*reuse_order())))
    kept = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("use_rank") <= 2, F.struct("use_rank", "dim"))).over(by_bullet)),
        lambda u: u["dim"],
    )
    return ranked.withColumns({"kept_dims": kept, "over_limit": F.col("use_rank") > 2})


def bullet_uses(final_dims: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bullet, dim) rows: a bullet counts once per dimension, with the primary flag of the first
    quote in it. Quotes shorter than three characters still use up their bullets."""
    joined = final_dims.join(index.select(*keys, "bullets"), keys)
    hits = F.flatten(
        F.transform(
            "quote_norms",
            lambda q, qi: F.transform(
                F.filter("bullets", lambda b: F.contains(b["norm"], q)),
                lambda b: F.struct(
                    b["id"].alias("bullet"),
                    qi.alias("quote_at"),
                    F.array_position(F.transform("bullets", lambda x: x["id"]), b["id"]).alias("bullet_at"),
                    F.get("evidence", qi)["primary"].alias("primary"),
                ),
            ),
        )
    )
    exploded = joined.select(*keys, "dim", "score", "weight", F.explode(hits).alias("hit")).select(
        *keys, "dim", "score", "weight", "hit.*"
    )
    firsts = exploded.groupBy(*keys, "bullet", "dim").agg(
        F.max("score").alias("score"),
        F.max("weight").alias("weight"),
        F.min(F.struct("quote_at", "bullet_at", "primary")).alias("first"),
    )
    return firsts.select(*keys, "bullet", "dim", "score", "weight", "first.*")


def apply_reuse_limit(final_dims: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """Confidence drops to low, with a note, for uses past the second. Scores stay.

    ``final_dims`` carry the weight of their dimension for the role applied for.
    """
    uses = limit_reuse(bullet_uses(final_dims, index, keys), keys, "bullet")
    dims = F.array(*[F.lit(d) for d in fixed.SCORED_DIMS])
    # Bullets are taken in the order they are first met; the last one that drops a use names it.
    met = F.struct(F.array_position(dims, F.col("dim")).alias("dim_at"), "quote_at", "bullet_at")
    first_met = F.min(met).over(Window.partitionBy(*keys, "bullet"))
    over = uses.withColumn("_met", first_met).filter("over_limit")
    note = F.concat(
        F.lit(fixed.REUSE_NOTE[0]), F.col("bullet"), F.lit(fixed.REUSE_NOTE[1]), F.array_join("kept_dims", fixed.REUSE_NOTE[2]), F.lit(fixed.REUSE_NOTE[3])
    )
    notes = over.groupBy(*keys, "dim").agg(F.max_by(note, F.col("_met")).alias("reuse_note"))
    joined = final_dims.join(notes, [*keys, "dim"], "left")
    return joined.withColumn(
        "confidence", F.when(F.col("reuse_note").isNotNull(), "low").otherwise(F.col("confidence"))
    )
