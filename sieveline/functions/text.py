"""Text expressions. All run inside the JVM except NFKC, which Spark does not have (Arrow batches)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.functions.bind import bind
from sieveline.functions.patterns import SPACES, jvm

# Characters that compare equal after normalisation.
SINGLE_QUOTES, DOUBLE_QUOTES, DASHES = "‘’‚‛′", "“”„‟″", "‐‑‒–—―−"
ODD_SPACES = " " + "".join(chr(c) for c in range(0x2000, 0x200C)) + "  　"
BULLET_GLYPHS = r"^[\s\-–—•▪◦●○■□►▸·*‣⁃]+"


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_each(lists: pd.Series) -> pd.Series:
    def fold(text):
        return text if text is None or text.isascii() else unicodedata.normalize("NFKC", text)

    return lists.map(lambda items: None if items is None else [fold(t) for t in items])


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one blank; ends trimmed."""
    return F.trim(F.regexp_replace(text, f"[{SPACES}]+", " "))


def js_trim(text: Column) -> Column:
    # Away from the text's start a run is only tried from its first character, so a long run inside a text is passed once.
    return F.regexp_replace(text, f"^[{SPACES}]+|[{SPACES}](?<![{SPACES}]{{2}})[{SPACES}]*+$", "")


def plain_normal(text: Column) -> Column:
    """Quotes, dashes, ellipsis and spaces folded; for text that is NFKC already."""
    same = F.translate(
        text,
        SINGLE_QUOTES + DOUBLE_QUOTES + DASHES + ODD_SPACES,
        "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "-" * len(DASHES) + " " * len(ODD_SPACES),
    )
    return squeeze(F.replace(same, F.lit("…"), F.lit("...")))


def normal(text: Column) -> Column:
    """The form in which two spellings of the same text compare equal."""
    return plain_normal(nfkc(text))


def normal_each(texts: Column) -> Column:
    return F.transform(nfkc_each(texts), plain_normal)


def strip_glyph(text: Column) -> Column:
    """A bullet without its leading glyph."""
    return F.regexp_replace(text, jvm(BULLET_GLYPHS), "")


def words(text: Column) -> Column:
    """Blank-separated tokens, none empty."""
    return F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Tokens that hold a letter or a digit."""
    return F.regexp_count(text, F.lit(f"[\\p{{L}}\\p{{N}}][^{SPACES}]*"))


def token_count(text: Column) -> Column:
    return F.size(words(text))


def sentences(text: Column) -> Column:
    parts = F.split(text, f"(?<=[.!?])[{SPACES}]+(?=[A-Z\\d\"'(])|\\n+")
    return F.filter(F.transform(parts, js_trim), lambda s: s != "")


def plain_words(text: Column) -> Column:
    """Lower-case words with punctuation read as blanks."""
    return words(F.regexp_replace(F.lower(text), f"[^\\p{{L}}\\p{{N}}{SPACES}]", " "))


def shingles(word_list: Column, n: int) -> Column:
    """Every run of n words, joined by blanks; empty when there are fewer."""

    def runs(listed: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(listed) - (n - 1))
        made = F.transform(starts, lambda i: F.array_join(F.slice(listed, i, n), " "))
        return F.when(F.size(listed) >= n, made).otherwise(F.array().cast("array<string>"))

    return bind(word_list, runs)


def decode_entities(text: Column) -> Column:
    """Numeric references (hexadecimal first), then the five named ones, the ampersand last."""

    def replace_refs(value: Column, pattern: str, code) -> Column:
        coded = F.transform(
            F.array_distinct(F.regexp_extract_all(value, F.lit(pattern), F.lit(0))),
            lambda r: F.struct((code(r) == 38).alias("ampersand"), code(r).alias("code"), r.alias("ref")),
        )
        return F.aggregate(
            F.array_sort(coded),
            value,
            lambda acc, r: F.replace(acc, r["ref"], F.decode(F.unhex(F.lpad(F.hex(r["code"]), 8, "0")), "UTF-32")),
        )

    def hexadecimal(ref: Column) -> Column:
        return F.conv(F.regexp_extract(ref, "(?i)x([0-9a-f]+);", 1), 16, 10).cast("bigint")

    def decimal(ref: Column) -> Column:
        return F.regexp_extract(ref, r"(\d+)", 1).cast("bigint")

    def numeric(value: Column) -> Column:
        first = replace_refs(value, "(?i)&#x[0-9a-f]{1,6};", hexadecimal)
        return bind(first, lambda v: replace_refs(v, r"&#\d{1,7};", decimal))

    # Most texts hold no numeric reference and skip both passes.
    out = bind(text, lambda v: F.when(F.contains(v, F.lit("&#")), numeric(v)).otherwise(v))
    for entity, char in [("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def html_escape(text: Column) -> Column:
    out = text
    for char, entity in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]:
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


def first_name(display_name: Column) -> Column:
    """First token in title case; null when it holds no letter."""
    first = F.element_at(F.split(js_trim(display_name), f"[{SPACES}]+"), 1)
    return F.when(
        first.rlike(r"\p{L}"), F.concat(F.upper(F.substring(first, 1, 1)), F.lower(F.substr(first, F.lit(2))))
    )


def clean_line(text: Column, limit: int) -> Column:
    """One line of free text, cut at the length the column holds."""
    return F.left(squeeze(text), F.lit(limit))


def clean_note(text: Column, limit: int) -> Column:
    """Trimmed free text, cut at the length the column holds; empty becomes null."""
    return F.nullif(F.left(js_trim(text), F.lit(limit)), F.lit(""))
