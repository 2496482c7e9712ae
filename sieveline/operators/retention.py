"""Retention: identity and document text go, numbers stay. Running it again changes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import dates


def due_candidates(evaluations: DataFrame, candidates: DataFrame, pools: DataFrame, configs: DataFrame, now: Column) -> DataFrame:
    """(doc_id, candidate_id, file_path) of pools closed for their retention days and not purged yet."""
    closed = pools.filter(F.col("closed_at").isNotNull()).join(configs.select("pool_id", "retention_days"), "pool_id")
    over = closed.filter(dates.older_than(F.col("closed_at"), F.col("retention_days"), now)).select("pool_id")
    kept = candidates.filter(F.col("deleted_at").isNull()).select("candidate_id")
    return (
        evaluations.select("doc_id", "candidate_id", "pool_id", "file_path")
        .join(over, "pool_id", "left_semi")
        .join(kept, "candidate_id", "left_semi")
        .select("doc_id", "candidate_id", "file_path")
    )


def files_to_delete(due: DataFrame) -> DataFrame:
    return due.filter(F.col("file_path").isNotNull()).select("file_path")


def strip_dims(dims: Column) -> Column:
    """Numbers of the combined dimensions: an allow-list, so a new text field is gone by default."""
    return F.transform(
        dims,
        lambda d: F.struct(
            *[d[c].alias(c) for c in ("dim", "score", "run_scores", "evidence_status", "confidence", "quote_mismatch")]
        ),
    )


def strip_runs(runs: Column) -> Column:
    return F.transform(
        runs, lambda r: F.struct(*[r[c].alias(c) for c in ("run_ix", "dim", "score", "evidence_status", "confidence")])
    )


def strip_experience(experience: Column) -> Column:
    roles = F.transform(
        experience["roles"], lambda r: F.struct(*[r[c].alias(c) for c in ("role_index", "type", "months", "rate")])
    )
    return F.when(
        experience.isNotNull(), F.struct(experience["pm_relevant_years"].alias("pm_relevant_years"), roles.alias("roles"))
    )


def _mark(rows: DataFrame, due: DataFrame, key: str, renamed: str | None = None) -> DataFrame:
    hits = due.select(F.col(key).alias(renamed or key)).distinct().withColumn("_purge", F.lit(True))
    return rows.join(hits, renamed or key, "left").withColumn("_purge", F.coalesce("_purge", F.lit(False)))


def _clear(rows: DataFrame, columns: list[str], empty_arrays: list[str] = ()) -> dict[str, Column]:
    types = dict(rows.dtypes)
    purge = F.col("_purge")
    out = {c: F.when(~purge, F.col(c)) for c in columns if c in types}
    out |= {c: F.when(purge, F.array().cast(types[c])).otherwise(F.col(c)) for c in empty_arrays if c in types}
    return out


def purge_candidates(candidates: DataFrame, due: DataFrame, now: Column) -> DataFrame:
    marked = _mark(candidates, due, "candidate_id")
    texts = ["display_name", "email", "phone", "file_name", "record_key", "extractor_json", "parse_log_json", "link_head"]
    out = marked.withColumns(_clear(marked, texts, ["urls", "linked_candidate_ids"]))
    return out.withColumn("deleted_at", F.when(F.col("_purge"), now).otherwise(F.col("deleted_at"))).drop("_purge")


def purge_evaluations(evaluations: DataFrame, due: DataFrame) -> DataFrame:
    """Texts nulled; nested results cut down to their numbers for everyone, so the schema stays one."""
    marked = _mark(evaluations, due, "doc_id")
    out = marked.withColumns(
        _clear(marked, ["file_path", "redacted_profile_text", "redacted_profile_json", "brief_json", "last_error"])
    )
    nested = {"dims": strip_dims, "runs": strip_runs, "experience": strip_experience}
    have = dict(out.dtypes)
    stripped = {f"{c}_numbers": strip(F.col(c)) for c, strip in nested.items() if c in have}
    out = out.withColumns(stripped)
    return out.withColumns({c: F.when(~F.col("_purge"), F.col(c)) for c in nested if c in have}).drop("_purge")


def purge_decisions(decisions: DataFrame, due: DataFrame) -> DataFrame:
    marked = _mark(decisions, due, "doc_id", "evaluation_id")
    return marked.withColumns(_clear(marked, ["reason", "invite_line_final"])).drop("_purge")
