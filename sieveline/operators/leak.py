"""Audit of the rendered profile: names of the categories that leaked, never the values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions.bind import bind
from sieveline.functions.patterns import jvm, matches, term_pattern
from sieveline.operators.redact import SHOWN, _with_form, comparable, listed_pairs, present_terms, text_words
from sieveline.term_lists import INSTITUTIONS, PLACES


def leak_categories(
    profile_text: Column, terms: Column, places: list[str] = PLACES, institutions: list[str] = INSTITUTIONS
) -> Column:
    # Placeholders are our own words; without them their letters cannot match a term.
    shown = sorted({s for s in SHOWN.values() if s})
    placeholder = "|".join("\\[" + s[1:-1] + "\\]" for s in shown)

    def checks(text: Column, haystack: Column) -> Column:
        words = text_words(haystack)

        def hit(pairs: Column) -> Column:
            candidates = F.filter(present_terms(pairs, haystack), lambda t: F.length(F.trim(t)) >= 2)
            return F.exists(candidates, lambda t: F.regexp_like(text, term_pattern(t)))

        own = lambda name: hit(_with_form(terms[name]))
        # All digits of the text in one run: over-sensitive on purpose.
        digits = F.regexp_replace(text, "[^0-9]", "")
        phones = F.filter(F.transform(terms["phones"], lambda p: F.regexp_replace(p, "[^0-9]", "")), lambda d: F.length(d) >= 7)
        tests = {
            "name_not_found": F.size(terms["names"]) == 0,
            "name": own("names"),
            "email": text.rlike(jvm(fixed.EMAIL_PATTERN)) | own("emails"),
            "phone": text.rlike(jvm(fixed.PHONE_PATTERN)) | F.exists(phones, lambda d: F.contains(digits, d)),
            "url": matches(text, fixed.URL_PATTERN) | own("urls"),
            "location": own("locations"),
            "institution": own("institutions"),
            "company": own("companies"),
            "city_list": hit(listed_pairs(places, words)),
            "college_list": hit(listed_pairs(institutions, words)),
            "date": matches(text, fixed.LEAK_MONTH_YEAR_PATTERN) | matches(text, fixed.LEAK_YEAR_PATTERN, False),
            "gendered_word": matches(text, fixed.LEAK_GENDERED_PATTERN) | matches(text, fixed.LEAK_HONORIFIC_PATTERN, False),
        }
        return F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))

    return bind(F.regexp_replace(profile_text, placeholder, " "), lambda t: bind(comparable(t), lambda h: checks(t, h)))


def audit(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("leaks", leak_categories(F.col("profile_text"), F.col("terms")))
