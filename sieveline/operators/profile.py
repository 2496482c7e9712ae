"""The redacted profile of a document: built and rendered from its extract, row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import dates, text as tx
from sieveline.operators import redact
from sieveline.term_lists import INSTITUTIONS, PLACES

TEXTS = "array<string>"


def ordered_roles(roles: Column, as_of: Column) -> Column:
    """Roles most recent first: latest end, then latest start, then as written; unread dates last."""
    dated = F.transform(
        roles,
        lambda r, i: F.struct(
            i.alias("source_index"), r.alias("role"), dates.role_span(r["start_raw"], r["end_raw"], as_of).alias("span")
        ),
    )
    keyed = F.transform(
        dated,
        lambda d: F.struct(
            F.coalesce(-d["span"]["last"], F.lit(2**31 - 1)).alias("by_end"),
            F.coalesce(-d["span"]["first"], F.lit(2**31 - 1)).alias("by_start"),
            d["source_index"].alias("source_index"),
            d["role"].alias("role"),
            d["span"].alias("span"),
        ),
    )
    return F.array_sort(keyed)


def _filled(texts: Column) -> Column:
    return F.filter(texts, lambda t: t != "")


def _units(unit_texts: Column) -> Column:
    """struct(text, reason) of each unit."""
    return F.transform(unit_texts, lambda u: F.struct(u.alias("text"), redact.drop_reason(u).alias("reason")))


def _kept(units: Column) -> Column:
    return F.transform(F.filter(units, lambda u: u["reason"].isNull()), lambda u: u["text"])


def build_profiles(
    extracts: DataFrame, places: list[str] = PLACES, institutions: list[str] = INSTITUTIONS
) -> DataFrame:
    """(doc_id, as_of, extract fields) → terms, redaction counts, profile json and profile text."""
    none = F.array().cast(TEXTS)
    arrays = lambda c: F.coalesce(F.col(c), none)
    base = extracts.withColumns(
        {
            "_roles": ordered_roles(F.col("roles"), F.col("as_of")),
            "terms": redact.build_terms(F.col("identity"), F.col("roles"), F.col("education")),
            "_summary": _units(F.coalesce(tx.sentences(F.col("summary_raw")), none)),
            "_skills": _units(arrays("skills_raw")),
        }
    )
    role_units = F.transform(
        "_roles", lambda r: _units(F.transform(r["role"]["bullets"], tx.strip_glyph))
    )
    cert_units = F.transform("education", lambda e: _units(e["certifications"]))
    base = base.withColumns({"_bullets": role_units, "_certs": cert_units})

    # Every text to clean, section by section, as one array of arrays: each goes through the same pass.
    stripped = F.transform(
        F.filter("_skills", lambda u: u["reason"].isNull() | (u["reason"] == "language")),
        lambda u: redact.strip_languages(u["text"]),
    )
    sections = F.concat(
        F.array(
            _kept(F.col("_summary")),
            F.filter(stripped, lambda s: s.isNotNull()),
            F.transform("_roles", lambda r: r["role"]["company_descriptor"]),
            F.transform("_roles", lambda r: r["role"]["title"]),
            F.transform("education", lambda e: e["degree_field"]),
        ),
        F.transform("_bullets", _kept),
        F.transform("_certs", _kept),
    )
    base = base.withColumn("_raw", sections)
    everything = F.array_join(F.flatten("_raw"), "\n")
    base = base.withColumn("_haystack", redact.comparable(everything))
    base = base.withColumn(
        "_terms", redact.prepare_terms(F.col("terms"), F.col("_haystack"), places, institutions)
    )
    base = base.withColumn("_marked", F.transform("_raw", lambda section: redact.mark_identity(section, F.col("_terms"))))
    base = base.withColumn(
        "_final", F.transform("_marked", lambda section: F.transform(section, redact.mark_academic))
    )
    base = base.withColumn("_clean", F.transform("_final", lambda section: F.transform(section, redact.unmark)))

    all_units = F.concat(
        F.col("_summary"),
        F.filter("_skills", lambda u: ~F.coalesce(u["reason"] == "language", F.lit(False))),
        F.flatten("_bullets"),
        F.flatten("_certs"),
    )
    base = base.withColumns({"_units": all_units, "_flat": F.flatten("_marked"), "_flat_final": F.flatten("_final")})

    def dropped(*reasons: str) -> Column:
        return F.size(F.filter("_units", lambda u: F.coalesce(u["reason"].isin(*reasons), F.lit(False))))

    skill_languages = F.aggregate(
        F.filter("_skills", lambda u: u["reason"].isNull() | (u["reason"] == "language")),
        F.lit(0),
        lambda acc, u: acc + redact.language_count(u["text"]),
    )
    counted = {
        "gap_units": dropped("gap"),
        "personal_units": dropped("personal", "relocation"),
        "languages": dropped("language") + skill_languages,
        "academic": redact.count_mark(F.col("_flat_final"), redact.MARKS["academic"]),
    }
    counts = F.struct(
        *[
            counted.get(name, redact.count_mark(F.col("_flat"), redact.MARKS.get(name, ""))).alias(name)
            for name in redact.COUNTERS
        ]
    )

    at = lambda i: F.get(F.col("_clean"), F.lit(i))
    n_roles = F.size("_roles")
    roles = F.transform(
        "_roles",
        lambda r, i: F.struct(
            (i + 1).alias("index"),
            r["source_index"].alias("source_index"),
            F.coalesce(F.nullif(F.get(at(2), i), F.lit("")), F.lit("company")).alias("descriptor"),
            F.get(at(3), i).alias("title"),
            r["span"]["months"].alias("months"),
            dates.duration_text(r["span"]["months"]).alias("duration"),
            _filled(F.get(F.col("_clean"), i + 5)).alias("bullets"),
        ),
    )
    education = F.transform(
        "education",
        lambda e, i: F.struct(
            F.nullif(F.get(at(4), i), F.lit("")).alias("degree"),
            _filled(F.get(F.col("_clean"), i + 5 + n_roles)).alias("certifications"),
        ),
    )
    profile = F.struct(
        F.nullif(F.array_join(_filled(at(0)), " "), F.lit("")).alias("summary"),
        _filled(at(1)).alias("skills"),
        roles.alias("roles"),
        education.alias("education"),
    )
    out = base.select("doc_id", "as_of", "roles", "terms", counts.alias("counts"), profile.alias("profile"))
    return out.withColumn("profile_text", render_profile(F.col("profile")))


def render_profile(profile: Column) -> Column:
    """The tagged plain text the scoring runs are given, and quotes are checked against."""
    none = F.array().cast(TEXTS)
    summary = F.when(profile["summary"].isNotNull(), F.array(F.lit("[SUMMARY]"), profile["summary"], F.lit(""))).otherwise(none)
    skills = F.when(
        F.size(profile["skills"]) > 0, F.array(F.lit("[SKILLS]"), F.array_join(profile["skills"], " · "), F.lit(""))
    ).otherwise(none)

    def role_lines(role: Column) -> Column:
        number, first = role["index"].cast("string"), role["index"] == 1
        head = F.concat(F.lit("[ROLE "), number, F.when(first, F.lit(" · most recent")).otherwise(""), F.lit("]"))
        line = F.concat(
            F.lit("Role "), number, F.when(first, F.lit(" (most recent)")).otherwise(""), F.lit(": "),
            F.concat_ws(" · ", role["descriptor"], role["title"], role["duration"]),
        )
        bullets = F.transform(role["bullets"], lambda b: F.concat(F.lit("- "), b))
        return F.concat(F.array(head, line), bullets, F.array(F.lit("")))

    shown = F.filter(profile["education"], lambda e: e["degree"].isNotNull() | (F.size(e["certifications"]) > 0))

    def education_lines(entry: Column) -> Column:
        degree = F.when(
            entry["degree"].isNotNull(), F.array(F.concat(F.lit("[DEGREE: "), entry["degree"], F.lit("]")))
        ).otherwise(none)
        return F.concat(degree, F.transform(entry["certifications"], lambda c: F.concat(F.lit("Certification: "), c)))

    education = F.when(
        F.size(shown) > 0,
        F.concat(F.array(F.lit("[EDUCATION]")), F.flatten(F.transform(shown, education_lines)), F.array(F.lit(""))),
    ).otherwise(none)
    lines = F.concat(summary, skills, F.flatten(F.transform(profile["roles"], role_lines)), education)
    return F.concat(tx.js_trim(F.array_join(lines, "\n")), F.lit("\n"))
