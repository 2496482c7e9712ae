"""Patterns in the JVM dialect, and small helpers to apply them to columns.

The patterns of ``fixed`` read ``\\b`` and ``\\w`` as ASCII and ``\\s`` as any Unicode space. The JVM
reads ``\\b`` as Unicode and ``\\s`` as ASCII, so both are spelled out here.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
WORD_START, WORD_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# White space as one character class: the controls, every separator of Unicode, the zero-width mark. Kept to
# three tests per character; spelled out as ranges it is several times slower.
SPACES = r"\t\n\x0B\f\r\p{Z}\x{feff}"
TERM_LEFT, TERM_RIGHT = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"

# Pieces of the patterns of ``fixed``, and forms that match the same in the JVM but give nothing back. The JVM repeats a
# group of varying length by recursion: some thousand rounds (a page of numbers, a table's bars) overflow the task's
# stack, and Spark ends the executor for it. A possessive repeat is a loop. What it may not give back is told before:
# ten digits in runs that may end the match; a start inside a run that an earlier start would have taken too is passed.
FLAT = {
    r"[\w.+%-]+@[\w-]+(\.[\w-]+)+": r"(?:(?<![\w.+%-])|\G)[\w.+%-]++@[\w-]++(?:\.[\w-]++)++",
    r"(?:[\w-]+\.)+": r"(?<![\w-])(?<![\w-]\.)(?:[\w-]++\.)++",
    r"\d(?:[\s\-().]*\d){9,}(?![\w%])": r"(?=\d(?:[\s\-().]*+\d){9}\d*+(?![\w%]))\d++(?:[\s\-().]++\d++(?![\w%]))*+",
    r"\s*[:#]?\s*\d+": r"\s*+(?:[:#]\s*+)?\d+",
    r"\s*[:\-]?\s*\d+": r"\s*+(?:[:\-]\s*+)?\d+",
    r"\s+([,.;:)])": r"(?<!\s)\s++([,.;:)])",
    r"\s*[·|,](?:\s*[·|,])+\s*": r"(?<!\s)\s*+[·|,](?:\s*+[·|,])++\s*+",
    r"[\s·|,]+$": r"(?<![\s·|,])[\s·|,]++$",
}


def opens(first: str) -> str:
    """Put before a pattern that can only match from one of these characters: others are passed with one cheap test."""
    return f"(?=[{first}])"


def _edge(following: str) -> str:
    """The cheap side of a word edge where what follows tells which side it is."""
    if re.match(r"\((?:\?:)?\w|\w|\\d", following):
        return WORD_START
    if re.match(r"$|[)|. ']|\(\?[!=]|\[\^|\\[.s]", following):
        return WORD_END
    return EDGE


def jvm(pattern: str, ignore_case: bool = False, unicode_case: bool = False) -> str:
    """The same pattern for the JVM's regular expressions."""
    for piece, flat in FLAT.items():
        pattern = pattern.replace(piece, flat)
    out, in_class, i = [], False, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            if pair == r"\b" and not in_class:
                pair = _edge(pattern[i + 2 :])
            elif pair == r"\s":
                pair = SPACES if in_class else f"[{SPACES}]"
            elif pair == r"\S" and not in_class:
                pair = f"[^{SPACES}]"
            out.append(pair)
            i += 2
            continue
        if char == "[":
            in_class = True
        elif char == "]":
            in_class = False
        out.append(char)
        i += 1
    flags = "(?iu)" if unicode_case else "(?i)" if ignore_case else ""
    return flags + "".join(out)


def _alternatives(pattern: str) -> list[str]:
    """The pattern cut at its outermost bars."""
    parts, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        char = pattern[i]
        if char == "\\":
            i += 1
        elif in_class:
            in_class = char != "]"
        elif char == "[":
            in_class = True
        elif char in "()":
            depth += 1 if char == "(" else -1
        elif char == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def any_of(patterns: list[str], ignore_case: bool = True) -> str:
    """One pattern that matches where any of the given ones does.

    Alternatives that open at a word's start share one look behind, so most places of a text are
    passed with a single test. Only for finding: which alternative matched is not told.
    """
    alternatives = [a for p in patterns for a in _alternatives(p)]
    at_start = [a[2:] for a in alternatives if a.startswith("\\b") and _edge(a[2:]) == WORD_START]
    others = [a for a in alternatives if not (a.startswith("\\b") and _edge(a[2:]) == WORD_START)]
    parts = [jvm(a) for a in others]
    if at_start:
        parts.append(WORD_START + "(?:" + "|".join(jvm(a) for a in at_start) + ")")
    return ("(?i)" if ignore_case else "") + "|".join(parts)


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return text.rlike(any_of([pattern], ignore_case))


def term_pattern(term: Column) -> Column:
    """Whole-word, whitespace-flexible pattern of a term column; acronyms keep their case."""
    trimmed = F.trim(term)
    body = F.regexp_replace(
        F.regexp_replace(trimmed, r"[.*+?^${}()|\[\]\\]", r"\\$0"), f"[{SPACES}]+", F.lit(f"[{SPACES}]+".replace("\\", "\\\\"))
    )
    case = F.when(trimmed.rlike("^[A-Z]{2,6}s?$"), F.lit("")).otherwise(F.lit("(?iu)"))
    return F.concat(case, F.lit(TERM_LEFT), body, F.lit(TERM_RIGHT))
