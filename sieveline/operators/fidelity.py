"""Does the extract say what the document says? Every bullet word for word, and most of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import text as tx
from sieveline.functions.bind import bind
from sieveline.functions.dates import half_up


def check_fidelity(docs: DataFrame) -> DataFrame:
    """Adds ``fidelity`` struct(ok, bullets_total, bullets_missing, coverage) to text + extract rows."""
    bullets = F.flatten(F.transform("roles", lambda r: r["bullets"]))
    fields = F.concat(
        F.flatten(
            F.transform(
                "roles",
                lambda r: F.array(
                    r["title"], r["company_raw"],
                    F.coalesce(r["start_raw"], F.lit("")), F.coalesce(r["end_raw"], F.lit("")),
                ),
            )
        ),
        F.array(F.coalesce("summary_raw", F.lit(""))),
        F.col("skills_raw"),
    )
    strip = lambda texts: F.transform(texts, tx.strip_glyph)
    # NFKC is the one step outside the JVM: each text crosses once.
    prepared = docs.withColumns(
        {"_text": tx.nfkc(F.col("text")), "_bullets": tx.nfkc_each(strip(bullets)), "_fields": tx.nfkc_each(strip(fields))}
    ).withColumns(
        {
            "_haystack": tx.plain_normal(F.col("_text")),
            "_bullets": F.filter(F.transform("_bullets", tx.plain_normal), lambda b: b != ""),
            "_fields": F.transform("_fields", tx.plain_normal),
        }
    )
    who = F.col("identity")
    names = F.filter(F.concat(F.array(who["name"]), who["emails"], who["phones"], who["urls"]), lambda v: v.isNotNull() & (v != ""))
    prepared = prepared.withColumn("_identity", F.transform(names, F.lower))
    # Raw and normalised lines side by side: normalising never adds or drops a line end.
    lines = F.arrays_zip(F.split("text", "\n").alias("raw"), F.split("_text", "\n").alias("folded"))
    free = F.filter(lines, lambda line: ~F.exists("_identity", lambda i: F.contains(F.lower(line["raw"]), i)))
    total = lambda texts: F.aggregate(texts, F.lit(0), lambda acc, t: acc + F.length(t))
    prepared = prepared.withColumns(
        {
            "_said": total(F.col("_bullets")) + total(F.col("_fields")),
            "_free": total(F.transform(free, lambda line: tx.plain_normal(line["folded"]))),
            "_missing": bind(
                F.col("_haystack"), lambda text: F.size(F.filter("_bullets", lambda b: ~F.contains(text, b)))
            ),
        }
    )
    coverage = F.when(F.col("_free") == 0, 0.0).otherwise(F.least(F.lit(1.0), F.col("_said") / F.col("_free")))
    ok = (F.size("_bullets") > 0) & (F.col("_missing") == 0) & (coverage >= fixed.MIN_COVERAGE)
    result = F.struct(
        ok.alias("ok"),
        F.size("_bullets").alias("bullets_total"),
        F.col("_missing").alias("bullets_missing"),
        half_up(coverage, 3).alias("coverage"),
    )
    return prepared.select(*docs.columns, result.alias("fidelity"))


def chosen_attempt(attempts: DataFrame, tries: int = 2) -> DataFrame:
    """One extract per document: the first faithful one of its first two attempts, else the last of them.

    Attempts are numbered from 1; a third or later one was never asked for.
    """
    order = F.struct((~F.col("fidelity.ok")).alias("unfaithful"), F.when(F.col("fidelity.ok"), F.col("attempt")).otherwise(-F.col("attempt")).alias("at"))
    columns = [c for c in attempts.columns if c != "doc_id"]
    return (
        attempts.filter(F.col("attempt") <= tries)
        .groupBy("doc_id")
        .agg(F.min_by(F.struct(*columns), order).alias("_best"))
        .select("doc_id", "_best.*")
    )


def verdict(unparseable: Column, fidelity_ok: Column, leaks: Column) -> Column:
    """Where a prepared document goes: the first stage that stopped it, or ok."""
    return (
        F.when(unparseable, "unparseable")
        .when(~F.coalesce(fidelity_ok, F.lit(False)), "extraction_fidelity")
        .when(F.size(F.coalesce(leaks, F.array().cast("array<string>"))) > 0, "redaction_leak")
        .otherwise("ok")
    )
