"""Parse guard: hidden text out, instruction lines out, thin documents marked.

Line work stays inside the row, so no document is ever exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import text as tx
from sieveline.functions.patterns import any_of, jvm


def near_white(color: Column) -> Column:
    """Every channel of a six-digit colour at F0 or above."""
    channels = [F.conv(F.substring(color, at, 2), 16, 10).cast("int") >= 240 for at in (1, 3, 5)]
    return F.when(color.rlike("(?i)^[0-9a-f]{6}$"), channels[0] & channels[1] & channels[2]).otherwise(False)


def split_hidden(runs: DataFrame) -> DataFrame:
    """Visible text and hidden passages per document, from a table of styled runs.

    Header, body, footer in reading order; a hidden passage is the hidden text of one paragraph. The
    group is one document, and its runs are put together paragraph by paragraph first.
    """
    part_rank = F.when(F.col("part") == "header", 0).when(F.col("part") == "body", 1).otherwise(2)
    hidden = F.coalesce("vanish", F.lit(False)) | near_white(F.coalesce("color", F.lit("")))
    ordered = lambda items: F.array_join(F.transform(F.array_sort(items), lambda r: r["text"]), "")
    paragraphs = (
        runs.select("doc_id", part_rank.alias("part_rank"), "para", "run", "text", hidden.alias("hidden"))
        .groupBy("doc_id", "part_rank", "para")
        .agg(
            F.collect_list(F.when(~F.col("hidden"), F.struct("run", "text"))).alias("shown"),
            F.collect_list(F.when(F.col("hidden"), F.struct("run", "text"))).alias("unseen"),
        )
        .select(
            "doc_id", "part_rank", "para",
            ordered(F.col("shown")).alias("shown"), tx.js_trim(ordered(F.col("unseen"))).alias("unseen"),
        )
    )
    per_document = paragraphs.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("part_rank", "para", "shown", "unseen"))).alias("paras")
    )

    def part_text(rank: int) -> Column:
        lines = F.transform(F.filter("paras", lambda p: p["part_rank"] == rank), lambda p: p["shown"])
        return F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n")

    parts = F.filter(F.array(*[part_text(r) for r in (0, 1, 2)]), lambda p: tx.js_trim(p) != "")
    return per_document.select(
        "doc_id",
        tx.js_trim(F.array_join(parts, "\n")).alias("text"),
        F.filter(F.transform("paras", lambda p: p["unseen"]), lambda u: u != "").alias("hidden_text"),
    )


# Markup that a reader of a page never sees, and tags that end a line.
UNSEEN_MARKUP = [
    r"(?is)<!--.*?-->",
    r"(?is)<script\b[^>]*>.*?</script\s*>",
    r"(?is)<style\b[^>]*>.*?</style\s*>",
    r"(?is)<head\b[^>]*>.*?</head\s*>",
]
LINE_TAGS = r"(?i)<(?:br|/p|/div|/h[1-6]|/li|/tr|/title)\b[^>]*>"


def visible_html(html: Column) -> Column:
    """Text a reader of the page sees: unseen markup out, line tags kept as line ends, entities decoded."""
    out = html
    for pattern in UNSEEN_MARKUP:
        out = F.regexp_replace(out, pattern, "")
    out = F.regexp_replace(F.regexp_replace(out, LINE_TAGS, "\n"), "<[^>]*>", "")
    return tx.decode_entities(out)


def injection_id(line: Column, patterns: list[tuple[str, str]] = fixed.INJECTION_PATTERNS) -> Column:
    """Name of the first pattern the line matches, else null."""
    ladder = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, pattern in patterns:
        ladder = ladder.when(line.rlike(jvm(pattern, ignore_case=True)), F.lit(name))
    return ladder


def scan_lines(text: Column, patterns: list[tuple[str, str]] = fixed.INJECTION_PATTERNS) -> tuple[Column, Column]:
    """(text without instruction lines, array of removed (pattern, line)).

    One combined pattern is run over the whole text first (a line that matches makes its text match),
    so only the few texts that hold such a line are ever split.
    """
    combined = any_of([p for _, p in patterns])
    suspect = text.rlike(combined)
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda line: ~line.rlike(combined)), "\n")
    removed = F.transform(
        F.filter(lines, lambda line: line.rlike(combined)),
        lambda line: F.struct(injection_id(line, patterns).alias("pattern"), line.alias("line")),
    )
    nothing = F.array().cast("array<struct<pattern:string,line:string>>")
    return F.when(suspect, kept).otherwise(text), F.when(suspect, removed).otherwise(nothing)


def guard(docs: DataFrame, patterns: list[tuple[str, str]] = fixed.INJECTION_PATTERNS) -> DataFrame:
    """``doc_text`` from (doc_id, text, hidden_text); a null text is a file that could not be read."""
    kept, removed = scan_lines(F.coalesce("text", F.lit("")), patterns)
    hidden = F.coalesce(F.col("hidden_text"), F.array().cast("array<string>"))
    return (
        docs.withColumns({"hidden_text": hidden, "clean": kept, "injection_lines": removed})
        .withColumn("word_count", tx.word_count(F.col("clean")))
        .select(
            "doc_id",
            F.col("clean").alias("text"),
            "word_count",
            "hidden_text",
            "injection_lines",
            ((F.size("hidden_text") > 0) | (F.size("injection_lines") > 0)).alias("integrity_check"),
            (F.col("word_count") < fixed.MIN_WORDS).alias("unparseable"),
        )
    )
