"""From texts and extracts to redacted profiles: guard, fidelity, redaction, leak audit, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.functions.hashing import text_hash
from sieveline.operators import fidelity, guard, leak, profile
from sieveline.operators.identity import first_email
from sieveline.term_lists import INSTITUTIONS, PLACES

EXTRACT_COLUMNS = ["identity", "roles", "education", "summary_raw", "skills_raw", "relocation_statement"]


def prepare(
    documents: DataFrame, attempts: DataFrame, places: list[str] = PLACES, institutions: list[str] = INSTITUTIONS
) -> DataFrame:
    """One row per document with its verdict: unparseable, extraction_fidelity, redaction_leak or ok.

    ``documents``: (doc_id, as_of, text, hidden_text, legacy); ``attempts``: (doc_id, attempt, extract
    columns), attempts numbered from 1. Each stage sees only the documents the one before let through,
    and a leaking profile is not part of the result.
    """
    guarded = guard.guard(documents.select("doc_id", "text", "hidden_text"))
    facts = guarded.join(documents.select("doc_id", "as_of", "legacy"), "doc_id")
    readable = facts.filter(~F.col("unparseable")).select("doc_id", "as_of", "text")

    checked = fidelity.check_fidelity(readable.join(attempts.select("doc_id", "attempt", *EXTRACT_COLUMNS), "doc_id"))
    chosen = fidelity.chosen_attempt(checked.select("doc_id", "as_of", "attempt", *EXTRACT_COLUMNS, "fidelity"))

    faithful = chosen.filter("fidelity.ok").select("doc_id", "as_of", *EXTRACT_COLUMNS)
    audited = leak.audit(profile.build_profiles(faithful, places, institutions))
    profiles = audited.select(
        "doc_id", "counts", "leaks", *[F.when(F.size("leaks") == 0, F.col(c)).alias(c) for c in ("profile", "profile_text")]
    )

    no_email = F.col("identity").isNotNull() & first_email(F.col("identity.emails")).isNull()
    out = facts.join(chosen.select("doc_id", "identity", "fidelity"), "doc_id", "left").join(profiles, "doc_id", "left")
    out = out.withColumn("verdict", fidelity.verdict(F.col("unparseable"), F.col("fidelity.ok"), F.col("leaks")))
    passed = F.col("verdict") == "ok"
    flags = F.array_compact(
        F.array(
            F.when(F.col("legacy"), F.lit("LEGACY")),
            F.when(F.col("integrity_check"), F.lit("INTEGRITY_CHECK")),
            F.when(no_email, F.lit("NO_CONTACT")),
        )
    )
    return out.select(
        "doc_id", "verdict", F.when(~passed, F.lit("R")).alias("tier"), F.when(~passed, F.col("verdict")).alias("tier_reason"),
        flags.alias("flags"), "word_count", F.transform("injection_lines", lambda r: r["pattern"]).alias("injection_patterns"),
        F.size("hidden_text").alias("hidden_runs"), "fidelity", "leaks", "counts", "profile", "profile_text",
        F.when(passed, text_hash(F.col("text"))).alias("visible_text_hash"),
    )
