"""From stored runs to ranks: the whole scoring plan, and its re-run under other configurations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline import config as cfg
from sieveline import fixed
from sieveline.operators import combine, evidence, experience, rank

CARRY = ["evidence_status", "confidence", "rationale", "evidence", "quote_norms", "quote_mismatch", "capped"]


def combined_runs(run_dims: DataFrame, index: DataFrame) -> DataFrame:
    checked = evidence.check_runs(run_dims, index).withColumnRenamed("quote_failed", "quote_mismatch")
    return combine.combine_dims(checked, ["doc_id", "dim"], F.col("run_ix"), CARRY, with_scores=True)


def score_documents(
    profiles: DataFrame, applications: DataFrame, run_dims: DataFrame, run_qualifiers: DataFrame,
    run_role_types: DataFrame, reference: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """What ranking needs and no configuration changes: (combined dimensions, document facts).

    ``profiles`` come from build_profiles; ``applications`` hold (doc_id, role_applied, ...). Both
    results are worth writing as stage tables: a re-rank starts from them.
    """
    index = evidence.index_profiles(profiles.select("doc_id", "profile_text"))
    runs = run_dims.groupBy("doc_id").agg((F.max("run_ix") + 1).alias("n_runs"))
    final_dims = combined_runs(run_dims, index)

    checked_quals = evidence.check_quotes(run_qualifiers, index)
    quals = combine.vote_qualifiers(checked_quals, runs)
    checked_types = evidence.check_quotes(run_role_types, index)
    role_rows = profiles.select("doc_id", F.explode("profile.roles").alias("r")).select("doc_id", F.col("r.index").alias("role_index"))
    voted = combine.vote_role_types(checked_types, role_rows, runs)
    years = experience.compute_experience(profiles, voted)

    facts = applications.join(years, "doc_id").join(quals, "doc_id", "left")
    if reference is not None:
        copies = evidence.flag_copies(profiles, reference).withColumn("copies_reference", F.lit(True))
        facts = facts.join(copies, "doc_id", "left")
    else:
        facts = facts.withColumn("copies_reference", F.lit(False))
    facts = facts.withColumn("copies_reference", F.coalesce("copies_reference", F.lit(False)))
    bullets = index.select("doc_id", "bullets")
    return final_dims, facts.join(bullets, "doc_id")


def rank_documents(
    final_dims: DataFrame, facts: DataFrame, config: dict | None = None, configs: DataFrame | None = None,
    key: str = "pool_id",
) -> tuple[DataFrame, DataFrame]:
    """(rank result, dimensions after the reuse limit).

    One ``config`` becomes literals. ``configs`` (from config_frame) is joined on ``key``, which
    ``facts`` carries, one configuration per pool.
    """
    many = configs is not None
    columns = cfg.from_frame() if many else cfg.literal(config or fixed.DEFAULT_CONFIG)
    keys = ["doc_id", key] if many else ["doc_id"]
    if many:
        facts = facts.join(configs, key)
    guess = F.when(F.col("role_applied") == "SPM", "SPM").otherwise("PM")
    needed = [c for c in columns if c.startswith("w_")] if many else []
    asked = facts.select(*keys, guess.alias("_guess"), *needed)
    weighted = final_dims.join(asked, "doc_id").withColumn("weight", cfg.weight_of(columns, F.col("_guess"), F.col("dim")))
    weighted = weighted.drop("_guess", *needed)
    limited = combine.apply_reuse_limit(weighted, facts.select(*keys, "bullets"), keys)
    rows = rank.document_row(limited, keys).join(facts.drop("bullets"), keys)
    return rank.rank_rows(rows, columns), limited


def what_if(final_dims: DataFrame, facts: DataFrame, configs: dict[str, dict]) -> DataFrame:
    """Every document ranked under every one of a few configurations, in one job over the stored runs."""
    names = F.array(*[F.lit(n) for n in configs])
    fanned = facts.withColumn("config_id", F.explode(names))
    frame = cfg.config_frame(final_dims.sparkSession, configs, key="config_id")
    return rank_documents(final_dims, fanned, configs=frame, key="config_id")[0]


def rescore(evaluations: DataFrame, final_dims: DataFrame, facts: DataFrame, configs: DataFrame) -> DataFrame:
    """New ranks for finished evaluations, from their stored runs, under their pools' configurations.

    Flags that ranking does not set survive; status follows the tier. Rows that were never scored
    are not part of the result.
    """
    done = evaluations.filter(F.col("status").isin("scored", "needs_review"))
    ranked, _ = rank_documents(final_dims, facts, configs=configs)
    new = ranked.select(
        "doc_id", "config_hash", "pm_total", "spm_total", "core_score", "best_fit_role", "role_used",
        "tier", "tier_reason", F.col("flags").alias("_rank_flags"),
    )
    kept = [c for c in done.columns if c == "doc_id" or c not in new.columns]
    joined = done.select(*kept).join(new, "doc_id")
    return joined.withColumns(
        {"flags": rank.merge_flags(F.col("flags"), F.col("_rank_flags")), "status": rank.eval_status(F.col("tier"))}
    ).drop("_rank_flags")
