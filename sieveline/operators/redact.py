"""Redaction of one document's texts, inside the row.

Texts are handled as arrays (bullets, sentences, skills …) next to the document's own term lists, so
a document is redacted where it lies: no explode, no shuffle, no Python. Every replacement leaves a
private-use mark, one per counter; the marks are counted, then rendered.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import text as tx
from sieveline.functions.bind import bind, text_list
from sieveline.functions.patterns import SPACES, WORD_START, any_of, jvm, matches, opens, term_pattern
from sieveline.term_lists import GENERIC_COMPANY_WORDS, INSTITUTIONS, LANGUAGES, PLACES

# What each counter's private-use mark is rendered as; silent marks leave nothing.
SHOWN = {
    "emails": "[CANDIDATE]", "urls": "[CANDIDATE]", "phones": "[CANDIDATE]", "names": "[CANDIDATE]",
    "institutions": "[INSTITUTION]", "companies": "[COMPANY]", "locations": "[LOCATION]",
    "referees": "[REFEREE]", "dates": "[DATE]", "honorifics": "", "pronouns": "", "academic": "",
}
MARKS = {name: chr(0xE000 + at) for at, name in enumerate(SHOWN)}
COUNTERS = [
    "emails", "urls", "phones", "names", "companies", "institutions", "locations", "honorifics", "pronouns",
    "dates", "academic", "gap_units", "personal_units", "languages",
]
LANGUAGE_WORD = r"\b(?:" + "|".join(LANGUAGES) + r")\b"


# ---- terms of a document ----


def name_terms(name: Column) -> Column:
    full = tx.squeeze(name)
    parts = F.filter(F.split(full, r"[\s.\-]+"), lambda p: F.length(p) >= 3)
    return F.when(
        name.isNotNull() & (full != ""), F.array_distinct(F.concat(F.array(full), parts))
    ).otherwise(F.array().cast("array<string>"))


def company_terms(raw: Column) -> Column:
    """The cleaned company name, and the words before the first one that only describes it."""
    none = F.array().cast("array<string>")
    generic = text_list(GENERIC_COMPANY_WORDS)

    def lead(parts: Column) -> Column:
        flags = F.transform(parts, lambda w: F.array_contains(generic, F.replace(F.lower(w), F.lit("."), F.lit(""))))
        at = F.array_position(flags, F.lit(True)).cast("int")
        kept = bind(at, lambda n: F.when(n > 0, F.slice(parts, F.lit(1), n - 1)).otherwise(parts))
        return F.regexp_replace(F.array_join(kept, " "), "[.,]+$", "")

    def terms(cleaned: Column) -> Column:
        usable = (cleaned != "") & ~cleaned.rlike(jvm(fixed.NOT_A_COMPANY_PATTERN, True))
        both = F.array(cleaned, bind(F.split(cleaned, " "), lead))
        return F.when(usable, F.array_distinct(F.filter(both, lambda t: F.length(t) >= 3))).otherwise(none)

    cleaned = tx.squeeze(F.regexp_replace(F.regexp_replace(raw, r"\(.*?\)", " "), r"[,|].*$", ""))
    return bind(F.coalesce(cleaned, F.lit("")), terms)


def place_terms(places: Column) -> Column:
    parts = F.flatten(F.transform(places, lambda p: F.split(p, r"[,/|;·]| - ")))
    return F.filter(F.transform(parts, tx.js_trim), lambda p: F.length(p) >= 3)


def _filled(values: Column) -> Column:
    return F.filter(values, lambda v: v.isNotNull() & (v != ""))


def build_terms(identity: Column, roles: Column, education: Column) -> Column:
    institutions = F.filter(F.transform(education, lambda e: e["institution_raw"]), lambda i: F.length(i) >= 3)
    companies = F.array_distinct(F.flatten(F.transform(roles, lambda r: company_terms(r["company_raw"]))))
    return F.struct(
        name_terms(identity["name"]).alias("names"),
        _filled(identity["emails"]).alias("emails"),
        _filled(identity["phones"]).alias("phones"),
        _filled(identity["urls"]).alias("urls"),
        place_terms(identity["locations"]).alias("locations"),
        institutions.alias("institutions"),
        companies.alias("companies"),
    )


# ---- the text pass ----


def comparable(text: Column) -> Column:
    """Upper and lower forms folded and white space squeezed: a term that matches is contained."""
    return tx.squeeze(F.lower(F.upper(text)))


def _with_form(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.struct(t.alias("term"), comparable(t).alias("form")))


def text_words(haystack: Column) -> Column:
    """The words of a comparable text."""
    return F.split(haystack, r"[^\p{L}\p{N}]+")


def listed_pairs(listed: list[str], words: Column) -> Column:
    """Pairs (term, form) of a fixed list whose longest word is among the text's words.

    A term stands between word edges, so its words are words of the text: one intersection by hash finds the few
    terms that can occur, and only those are looked for.
    """
    forms = [" ".join(t.upper().lower().split()) for t in listed]
    keys = [max(re.findall(r"[^\W_]+", f), key=len) for f in forms]
    pairs = F.arrays_zip(text_list(listed).alias("term"), text_list(forms).alias("form"), text_list(keys).alias("key"))

    def kept(found: Column) -> Column:
        pick = F.filter(pairs, lambda p: F.array_contains(found, p["key"]))
        none = F.array().cast("array<struct<term:string,form:string>>")
        return F.when(F.size(found) > 0, F.transform(pick, lambda p: F.struct(p["term"].alias("term"), p["form"].alias("form")))).otherwise(none)

    return bind(F.array_intersect(text_list(sorted(set(keys))), words), kept)


def present_terms(pairs: Column, haystack: Column) -> Column:
    """Terms whose letters occur in the (comparable) haystack, longest first.

    A cheap substring test that keeps every term that can match; only these cost a pattern.
    """
    kept = F.array_distinct(F.transform(F.filter(pairs, lambda p: F.contains(haystack, p["form"])), lambda p: p["term"]))
    by_length = F.transform(kept, lambda t, i: F.struct((-F.length(t)).alias("size"), i.alias("at"), t.alias("term")))
    return F.transform(F.array_sort(by_length), lambda t: t["term"])


def replace_terms(text: Column, terms: Column, mark: str) -> Column:
    """Longest term first, one after the other: not the same as one alternation."""
    return F.aggregate(terms, text, lambda acc, term: F.regexp_replace(acc, term_pattern(term), F.lit(mark)))


def pronoun_passes() -> list[tuple[str, list[tuple[str, str]]]]:
    """One pass per pronoun rule, in their order: (pattern that tells whether it has work, replacements).

    A rule has three spellings: upper case, capitalised, every other one. Marks of earlier replacements
    stand in the text without belonging to it, so what looks ahead passes over them.
    """

    def spelled(words: list[str], case: str) -> str:
        if case == "upper":
            return "(?:" + "|".join(w.upper() for w in words) + ")"
        first = str.upper if case == "title" else str.lower
        return "(?:" + "|".join(f"{first(w[0])}(?i:{w[1:]})" for w in words) + ")"

    def cased(word: str, case: str) -> str:
        return word.upper() if case == "upper" else word[0].upper() + word[1:] if case == "title" else word

    silent = "[" + MARKS["pronouns"] + MARKS["honorifics"] + "]"
    passes = []
    for words, tail, replacement in fixed.PRONOUN_RULES:
        after = jvm(tail).replace(jvm(r"\s+"), f"{silent}*+[{SPACES}][{silent[1:-1]}{SPACES}]*+") if r"\s+" in tail else jvm(tail)
        small = "".join(sorted({w[0] for w in words}))
        first = {"upper": small.upper(), "title": small.upper(), "lower": small}
        rules = [(opens(first[case]) + WORD_START + spelled(words, case) + after, MARKS["pronouns"] + cased(replacement, case)) for case in first]
        passes.append((opens(small + small.upper()) + WORD_START + "(?i:" + "|".join(words) + ")", rules))
    return passes


def prepare_terms(
    terms: Column, haystack: Column, places: list[str] = PLACES, institutions: list[str] = INSTITUTIONS
) -> Column:
    """The document's and the dictionaries' terms that occur in its texts, in the order they are applied."""
    words = text_words(haystack)

    def present(own: str, listed: list[str] | None = None) -> Column:
        pairs = _with_form(terms[own])
        return present_terms(F.concat(pairs, listed_pairs(listed, words)) if listed else pairs, haystack).alias(own)

    return F.struct(
        present("urls"),
        present("phones"),
        present("institutions", institutions),
        present("companies"),
        present("locations", places),
        present("names"),
    )


def _replaced_where(text: Column, has_work: Callable[[Column], Column], pattern: str, by: str) -> Column:
    return bind(text, lambda t: F.when(has_work(t), F.regexp_replace(t, pattern, by)).otherwise(t))


def _mark_emails(text: Column) -> Column:
    return bind(text, lambda t: F.when(F.contains(t, F.lit("@")), F.regexp_replace(t, jvm(fixed.EMAIL_PATTERN), MARKS["emails"])).otherwise(t))


def _mark_urls(text: Column) -> Column:
    def run(value: Column) -> Column:
        maybe = F.contains(value, F.lit("/")) | F.contains(F.lower(value), F.lit("www."))
        return F.when(maybe, F.regexp_replace(value, jvm(fixed.URL_PATTERN, True), MARKS["urls"])).otherwise(value)

    return bind(text, run)


def _mark_phones(text: Column) -> Column:
    phone = opens("+0-9") + jvm(fixed.PHONE_PATTERN)
    return bind(text, lambda t: F.when(t.rlike("[0-9]"), F.regexp_replace(t, phone, MARKS["phones"])).otherwise(t))


def mark_contacts(text: Column) -> Column:
    """E-mail addresses, links and phone numbers of a text, by pattern alone; each only where it can match."""
    return _mark_phones(_mark_urls(_mark_emails(text)))


def _mark_terms(text: Column, terms: Column) -> Column:
    out = _mark_emails(text)
    out = _mark_urls(replace_terms(out, terms["urls"], MARKS["urls"]))
    out = _mark_phones(replace_terms(out, terms["phones"], MARKS["phones"]))
    for name in ("institutions", "companies", "locations", "names"):
        out = replace_terms(out, terms[name], MARKS[name])
    return out


def _mark_honorifics(text: Column) -> Column:
    """Before the candidate: dropped; before another name: a referee; bare: dropped."""
    candidate = "[" + MARKS["emails"] + MARKS["urls"] + MARKS["phones"] + MARKS["names"] + "]"
    prefix = opens("MSD") + jvm(fixed.HONORIFIC_PREFIX)
    out = F.regexp_replace(text, prefix + f"(?={candidate})", MARKS["honorifics"])
    out = F.regexp_replace(out, prefix + jvm(fixed.HONORIFIC_NAME), MARKS["honorifics"] + MARKS["referees"])
    return F.regexp_replace(out, opens("M") + jvm(fixed.HONORIFIC_BARE), MARKS["honorifics"])


def _mark_pronouns(text: Column) -> Column:
    """The pronouns that stand in the text are listed first; a rule is spent only if a word of its spelling is among them."""
    listed = opens("HhSs") + jvm(fixed.LEAK_GENDERED_PATTERN, True)

    def one_pass(value: Column, rules: list[tuple[str, str]], words: list[str], kinds: Column) -> Column:
        # The words as listed, without what follows an apostrophe; "A" is upper case, "T" and "l" tell the first letter's.
        words = [w.partition("'")[0] for w in words]
        for (pattern, word), kind in zip(rules, "ATl", strict=True):
            held = F.arrays_overlap(kinds, text_list([kind + w for w in words]))
            value = _replaced_where(value, lambda _: held, pattern, word)
        return value

    def run(value: Column, found: Column) -> Column:
        spelled = lambda w: F.array(
            F.concat(F.when(w == F.upper(w), "A").otherwise("T"), F.lower(w)), F.concat(F.when(w.rlike("^[HS]"), "T").otherwise("l"), F.lower(w))
        )

        def every_pass(kinds: Column) -> Column:
            out = value
            for (_, rules), (words, _, _) in zip(pronoun_passes(), fixed.PRONOUN_RULES, strict=True):
                out = one_pass(out, rules, words, kinds)
            return out

        return F.when(F.size(found) > 0, bind(F.flatten(F.transform(found, spelled)), every_pass)).otherwise(value)

    return bind(text, lambda t: bind(F.array_distinct(F.regexp_extract_all(t, F.lit(listed), F.lit(0))), lambda found: run(t, found)))


# The characters that a date of each pattern can open with.
DATE_STARTS = ["JFMASOND", "0-9", "12", "0-9", "F", "12"]


def _mark_dates(text: Column) -> Column:
    month, *parted, financial, year = [opens(f) + jvm(p) for p, f in zip(fixed.DATE_PATTERNS, DATE_STARTS, strict=True)]

    def each(value: Column, *patterns: str) -> Column:
        return reduce(lambda out, p: F.regexp_replace(out, p, MARKS["dates"]), patterns, value)

    # Digits on both sides of a slash, full stop or hyphen; the letters of a financial year.
    out = bind(each(text, month), lambda t: F.when(t.rlike("[/.-](?<=[0-9].)(?=[0-9])"), each(t, *parted)).otherwise(t))
    out = bind(out, lambda t: F.when(F.contains(t, F.lit("FY")), each(t, financial)).otherwise(t))
    return each(out, year)


def mark_identity(texts: Column, terms: Column) -> Column:
    """Contacts, terms, honorifics, pronouns and dates of each text become marks.

    Stages run array by array, so a stage can look at its input before it spends its patterns on it.
    ``terms``: see prepare_terms.
    """
    out = F.transform(texts, lambda t: _mark_terms(t, terms))
    titles = opens("MSD") + jvm(r"\b(?:Mr|Mrs|Ms|Miss|Mx|Shri|Smt|Dr)\b")
    out = F.transform(out, lambda t: F.when(t.rlike(titles), _mark_honorifics(t)).otherwise(t))
    out = F.transform(out, _mark_pronouns)
    return F.transform(out, lambda t: F.when(t.rlike("[0-9]{2}"), _mark_dates(t)).otherwise(t))


# Letters (in lower case) of which one stands in whatever an academic pattern matches.
ACADEMIC_LETTERS = [["gpa", "cpi"], ["%"], ["medal"], ["university "], ["class", "division", "dean", "laude"], ["air", "rank"]]


def mark_academic(text: Column) -> Column:
    """Academic scores and honours of a text; a pattern is spent only where its letters stand."""

    def run(value: Column, lower: Column) -> Column:
        out = value
        for pattern, letters in zip(fixed.ACADEMIC_PATTERNS, ACADEMIC_LETTERS, strict=True):
            held = reduce(or_, [F.contains(lower, F.lit(some)) for some in letters])
            out = _replaced_where(out, lambda _: held, jvm(pattern, True), MARKS["academic"])
        return out

    return bind(text, lambda t: bind(F.lower(t), lambda lower: run(t, lower)))


def _at_ends(text: Column, more: str = "") -> Column:
    """Whether the text opens or ends with white space, a line end that ``$`` stands before, or one of ``more``."""
    return F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1))).rlike(f"[{SPACES}\\x85{more}]")


# Cheap tests of what each tidying pattern needs.
TIDY_WORK = [
    lambda t: F.contains(t, F.lit("  ")) | F.contains(t, F.lit("\t")),
    lambda t: t.rlike(f"[,.;:)](?<=[{SPACES}][,.;:)])"),
    lambda t: F.contains(t, F.lit("(")),
    lambda t: t.rlike(f"[·|,][{SPACES}]*+[·|,]"),
    lambda t: _at_ends(t, "·|,"),
]


def unmark(text: Column) -> Column:
    """Drop the silent marks, tidy what the drops left, render the others."""
    out = text
    for name, shown in SHOWN.items():
        if not shown:
            out = F.replace(out, F.lit(MARKS[name]), F.lit(""))
    for (pattern, by), has_work in zip(fixed.TIDY_PATTERNS, TIDY_WORK, strict=True):
        out = _replaced_where(out, has_work, jvm(pattern), by)
    return show_marks(bind(out, lambda t: F.when(_at_ends(t), tx.js_trim(t)).otherwise(t)))


def show_marks(text: Column) -> Column:
    out = text
    for name, shown in SHOWN.items():
        if shown:
            out = F.replace(out, F.lit(MARKS[name]), F.lit(shown))
    return out


def only_marks(texts: Column) -> Column:
    """The marks that an array of texts holds, as one short text: several kinds are counted in it cheaply."""
    first, last = min(MARKS.values()), max(MARKS.values())
    return F.array(F.regexp_replace(F.array_join(texts, ""), f"[^{first}-{last}]+", ""))


def count_mark(texts: Column, mark: str) -> Column:
    """How many of the mark an array of texts holds."""
    return bind(
        F.array_join(texts, ""), lambda joined: F.length(joined) - F.length(F.replace(joined, F.lit(mark), F.lit("")))
    )


# ---- units that go whole ----


DROP_PATTERNS = [*fixed.GAP_PATTERNS, *fixed.PERSONAL_PATTERNS, fixed.RELOCATION_PATTERN, fixed.LANGUAGE_SENTENCE_PATTERN]


def drop_reason(unit: Column) -> Column:
    """gap, personal, relocation or language; null when the unit stays.

    One pass tells the units that hold none of it, which are most; only the others take the ladder.
    """
    ladder = (
        F.when(unit.rlike(any_of(fixed.GAP_PATTERNS)), "gap")
        .when(unit.rlike(any_of(fixed.PERSONAL_PATTERNS)) | unit.rlike(jvm(fixed.PERSONAL_CASED_PATTERN)), "personal")
        .when(matches(unit, fixed.RELOCATION_PATTERN), "relocation")
        .when(matches(unit, fixed.LANGUAGE_SENTENCE_PATTERN) & unit.rlike(jvm(LANGUAGE_WORD)), "language")
    )
    any_reason = any_of([*DROP_PATTERNS, r"\bd\.?o\.?b\b"])
    return F.when(unit.rlike(any_reason), ladder)


def strip_languages(skill: Column) -> Column:
    """A skill entry without human languages; null when nothing else is left."""

    def strip(prefix: Column) -> Column:
        entries = F.transform(F.split(F.substr(skill, F.length(prefix) + 1), "[,;·]"), tx.js_trim)
        kept = F.filter(entries, lambda e: (e != "") & ~e.rlike(jvm(LANGUAGE_WORD)))
        lead = F.when(prefix != "", F.concat(tx.js_trim(prefix), F.lit(" "))).otherwise("")
        return F.concat(lead, F.nullif(F.array_join(kept, ", "), F.lit("")))

    prefix = F.regexp_extract(skill, jvm(fixed.LANGUAGE_PREFIX_PATTERN, True), 0)
    return F.when(skill.rlike(jvm(LANGUAGE_WORD)), bind(prefix, strip)).otherwise(skill)


def language_count(skill: Column) -> Column:
    return F.regexp_count(skill, F.lit(jvm(LANGUAGE_WORD)))
