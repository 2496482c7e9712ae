"""Every score quotes its document: profile index, quote checks, copied reference text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import text as tx
from sieveline.functions.patterns import SPACES
from sieveline.operators.skew import broadcast_if_small

# A line that opens a section: its name becomes a mark the text is split on.
SECTION_MARK, NAME_MARK = chr(0xE100), chr(0xE101)
HEADER = rf"(?m)^[{SPACES}&&[^\n]]*\[(SUMMARY|SKILLS|EDUCATION|ROLE (?:[0-9]+))[^\]\n]*\][{SPACES}&&[^\n]]*$"


def index_profiles(profiles: DataFrame) -> DataFrame:
    """(doc_id, profile_text) → normalised text, sections (name, norm), bullets (id, norm), in the row.

    Lines before the first header belong to no section. Section and bullet texts go through NFKC
    together, in one crossing to Python.
    """
    marked = F.regexp_replace("profile_text", HEADER, SECTION_MARK + "$1" + NAME_MARK)
    parts = F.split(marked, SECTION_MARK)
    bodies = F.transform(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))),
        lambda p: F.struct(
            F.regexp_replace(F.substring_index(p, NAME_MARK, 1), " [0-9]+$", "").alias("name"),
            F.element_at(F.split(p, NAME_MARK), 2).alias("body"),
        ),
    )
    split = profiles.withColumn("_bodies", bodies)
    bullet_lines = F.filter(
        F.flatten(F.transform("_bodies", lambda b: F.split(b["body"], "\n"))), lambda line: F.startswith(line, F.lit("- "))
    )
    split = split.withColumn("_lines", F.transform(bullet_lines, lambda line: F.substr(line, F.lit(3))))
    folded = split.withColumn(
        "_norm",
        tx.normal_each(F.concat(F.array("profile_text"), F.transform("_bodies", lambda b: b["body"]), F.col("_lines"))),
    )
    n_sections = F.size("_bodies")
    return folded.select(
        *profiles.columns,
        F.get("_norm", F.lit(0)).alias("norm"),
        F.transform(
            "_bodies", lambda b, i: F.struct(b["name"].alias("name"), F.get("_norm", i + 1).alias("norm"))
        ).alias("sections"),
        F.transform(
            "_lines",
            lambda _, i: F.struct(
                F.concat(F.lit("b"), (i + 1).cast("string")).alias("id"), F.get("_norm", i + 1 + n_sections).alias("norm")
            ),
        ).alias("bullets"),
    )


def found(norm: Column, quote_norm: Column) -> Column:
    """A quote counts from three characters up, word for word in the profile."""
    return (F.length(quote_norm) >= 3) & F.contains(norm, quote_norm)


def only_capped_sections(sections: Column, quote_norms: Column) -> Column:
    """Every quote has a home and all its homes are headline, skill-list or education sections."""
    capped = lambda s: s["name"].isin(*fixed.CAPPED_SECTIONS)

    def homes_capped(quote: Column) -> Column:
        homes = F.filter(sections, lambda s: F.contains(s["norm"], quote))
        return (F.size(homes) > 0) & F.forall(homes, capped)

    return F.forall(quote_norms, homes_capped)


def apply_quote_rules(bad_quote: Column, n_quotes: Column, capped_only: Column) -> dict[str, Column]:
    """Score, confidence, quote_failed and capped of one run's dimension after its checks."""
    score, absent = F.col("score"), F.col("evidence_status") == "absent"
    failed = bad_quote | ((score >= 2) & (n_quotes == 0))
    after_absent = F.when(absent, F.least(score, F.lit(1))).otherwise(score)
    cap = (after_absent > 1) & (n_quotes > 0) & capped_only
    return {
        "score": F.when(failed, 0).when(cap, 1).otherwise(after_absent).cast("int"),
        "confidence": F.when(failed | absent, "low").otherwise(F.col("confidence")),
        "quote_failed": failed,
        "capped": ~failed & cap,
    }


def check_runs(run_dims: DataFrame, index: DataFrame) -> DataFrame:
    """Per-run evidence checks. One join on the document; the quotes of a row are tested in the row."""
    quotes = run_dims.withColumn(
        "_quotes", tx.normal_each(F.transform("evidence", lambda e: e["quote"]))
    )
    joined = quotes.join(index.select("doc_id", "norm", "sections"), "doc_id")
    bad = F.exists("_quotes", lambda q: ~found(F.col("norm"), q))
    rules = apply_quote_rules(bad, F.size("_quotes"), only_capped_sections(F.col("sections"), F.col("_quotes")))
    return joined.withColumns(rules).drop("norm", "sections").withColumnRenamed("_quotes", "quote_norms")


def check_quotes(rows: DataFrame, index: DataFrame, quote_col: str = "quote") -> DataFrame:
    """``quote_ok`` for rows holding one quote each (qualifiers, role types)."""
    normed = rows.withColumn("_q", tx.normal(F.col(quote_col)))
    joined = normed.join(index.select("doc_id", "norm"), "doc_id")
    ok = F.coalesce(found(F.col("norm"), F.col("_q")), F.lit(False)) & (F.coalesce(quote_col, F.lit("")) != "")
    return joined.withColumn("quote_ok", ok).drop("norm", "_q")


def shingle_rows(texts: DataFrame, id_cols: list[str], text_col: str, n: int = fixed.SHINGLE_WORDS) -> DataFrame:
    """Distinct word runs of each text as rows, with a 64-bit hash to join on."""
    runs = F.array_distinct(tx.shingles(tx.plain_words(F.col(text_col)), n))
    return texts.select(*id_cols, F.explode(runs).alias("shingle")).withColumn("h", F.xxhash64("shingle"))


def copied_texts(
    texts: DataFrame, reference: DataFrame, id_cols: list[str], text_col: str = "text", n: int = fixed.SHINGLE_WORDS
) -> DataFrame:
    """Ids of the texts that share a run of n words with the reference texts.

    The reference runs are deduplicated and, when counted to be small, sent to the texts, so the texts
    are never shuffled; the hash finds candidates and the words themselves decide.
    """
    known = shingle_rows(reference, [], text_col, n).distinct()
    hits = shingle_rows(texts, id_cols, text_col, n).join(broadcast_if_small(known), ["h", "shingle"], "left_semi")
    return hits.select(*id_cols).distinct()


def flag_copies(profiles: DataFrame, reference: DataFrame) -> DataFrame:
    """Documents with a bullet that repeats the reference wording."""
    bullets = profiles.select("doc_id", F.explode(F.flatten(F.transform("profile.roles", lambda r: r["bullets"]))).alias("text"))
    return copied_texts(bullets, reference, ["doc_id"])
