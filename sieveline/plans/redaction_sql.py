"""The redaction passes and the leak audit restated in SQL whose patterns cannot look around.

What a pattern looks at beside its match is captured and put back; where two matches may share such a
neighbour the pass runs twice. What must not follow a year is found first and marked behind the year.
"""

from __future__ import annotations

import re

from sieveline import fixed
from sieveline.functions.patterns import SPACES
from sieveline.operators.redact import MARKS, SHOWN
from sieveline.term_lists import INSTITUTIONS, PLACES

LEFT, RIGHT = r"(^|[^\p{L}\p{N}])", r"($|[^\p{L}\p{N}])"
COUNT_MARK = chr(63743)
SILENT = "[" + MARKS["pronouns"] + MARKS["honorifics"] + "]"
CANDIDATE = "[" + MARKS["emails"] + MARKS["urls"] + MARKS["phones"] + MARKS["names"] + "]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """``\\s`` as the white space the passes mean, inside a class and outside."""
    out, in_class, i = [], False, 0
    while i < len(pattern):
        pair = pattern[i : i + 2]
        if pair in (r"\s", r"\S") and not (in_class and pair == r"\S"):
            out.append(SPACES if in_class else f"[{'^' if pair == chr(92) + 'S' else ''}{SPACES}]")
            i += 2
        elif pair[0] == "\\":
            out.append(pair)
            i += 2
        else:
            in_class = pair[0] == "[" or (in_class and pair[0] != "]")
            out.append(pair[0])
            i += 1
    return "".join(out)


def replaced(text: str, pattern: str, by: str, flags: str = "g", times: int = 1) -> str:
    for _ in range(times):
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(by)}, '{flags}')"
    return text


# Where a phone number may stand.
PHONE = re2(r"(^|[^\w₹$€£])\+?\d(?:[\s\-().]*\d){9,}($|[^\w%])")
NOT_COUNTED = re2(
    r"(%|\s*\+|\s+(?:employees|staff|people|members|engineers|clients|customers|users|merchants|"
    r"shipments|containers|orders|accounts|units|stores|trucks|vehicles|SKUs|tickets)\b)"
)
YEAR_RANGE = re2(rf"{fixed.YEAR_PATTERN}(?:\s*[-–]\s*\d{{2}})?")
BEFORE_YEAR, BEHIND_YEAR = r"(^|[^₹$€£#.,A-Za-z0-9_])", rf"($|[^{COUNT_MARK}A-Za-z0-9_])"


def term_body(term: str) -> str:
    body = f"[{SPACES}]+".join(re.sub(r"[.*+?^${}()|\[\]\\]", r"\\\g<0>", w) for w in term.split())
    return body if re.fullmatch("[A-Z]{2,6}s?", term) else f"(?i:{body})"


def with_terms(text: str, terms: list[str], mark: str) -> str:
    """Terms of a list, the longest first, each replaced throughout; only those whose letters occur in ``u`` are tried."""
    order = sorted(dict.fromkeys(terms), key=lambda t: -len(t))
    pairs = ", ".join(f"{{'p': {quoted(LEFT + term_body(t) + RIGHT)}, 'f': {quoted(' '.join(t.lower().split()))}}}" for t in order)
    by = quoted(rf"\1{mark}\2")
    found = f"list_transform(list_filter([{pairs}], lambda s: contains(u, s.f)), lambda s: s.p)"
    return f"list_reduce(list_concat([{text}], {found}), lambda acc, x: regexp_replace(regexp_replace(acc, x, {by}, 'g'), x, {by}, 'g'))"


def with_contacts(text: str) -> str:
    out = replaced(text, re2(fixed.EMAIL_PATTERN), MARKS["emails"])
    out = replaced(out, re2(fixed.URL_PATTERN), MARKS["urls"], "gi")
    return replaced(out, PHONE, rf"\1{MARKS['phones']}\2", times=2)


def with_honorifics(text: str) -> str:
    drop, prefix = MARKS["honorifics"], re2(fixed.HONORIFIC_PREFIX)
    out = replaced(text, f"{prefix}({CANDIDATE})", rf"{drop}\1")
    out = replaced(out, prefix + re2(fixed.HONORIFIC_NAME), drop + MARKS["referees"])
    bare = re2(fixed.HONORIFIC_BARE).replace("(?=", "(")
    return replaced(out, bare, rf"{drop}\1")


def with_pronouns(text: str) -> list[str]:
    """One step per rule and spelling."""
    steps, space = [], f"[{SPACES}]"
    for words, tail, new in fixed.PRONOUN_RULES:
        spelled = {
            "upper": ("|".join(w.upper() for w in words), new.upper()),
            "title": ("|".join(f"{w[0].upper()}(?i:{w[1:]})" for w in words), new[0].upper() + new[1:]),
            "lower": ("|".join(f"{w[0]}(?i:{w[1:]})" for w in words), new),
        }
        for pattern, word in spelled.values():
            if "(?=" in tail:
                steps.append(replaced(text, rf"\b(?:{pattern})({SILENT}*{space}(?:{SILENT}|{space})*\p{{L}})", rf"{MARKS['pronouns']}{word}\1", times=2))
            else:
                steps.append(replaced(text, rf"\b(?:{pattern})\b", MARKS["pronouns"] + word))
    return steps


def with_dates(text: str) -> list[str]:
    """One step per pattern."""
    date, steps = MARKS["dates"], []
    for k, pattern in enumerate(fixed.DATE_PATTERNS):
        if k == 2:
            steps.append(replaced(text, re2(pattern).replace(r"(?![/-]\d)", r"($|[^/\-]|[/\-](?:$|[^\d]))"), rf"{date}\1"))
        elif k == len(fixed.DATE_PATTERNS) - 1:
            counted = replaced(text, rf"({YEAR_RANGE}\b){NOT_COUNTED}", rf"\1{COUNT_MARK}\2")
            found = replaced(counted, BEFORE_YEAR + YEAR_RANGE + BEHIND_YEAR, rf"\1{date}\2", times=2)
            steps.append(f"replace({found}, '{COUNT_MARK}', '')")
        else:
            steps.append(replaced(text, re2(pattern), date))
    return steps


def with_academic(text: str) -> list[str]:
    return [replaced(text, re2(p), MARKS["academic"], "gi") for p in fixed.ACADEMIC_PATTERNS]


def unmarked(text: str) -> str:
    out = text
    for name, shown in SHOWN.items():
        if not shown:
            out = f"replace({out}, '{MARKS[name]}', '')"
    for pattern, by in fixed.TIDY_PATTERNS:
        out = replaced(out, re2(pattern), by.replace("$1", r"\1"))
    out = replaced(out, f"^[{SPACES}]+|[{SPACES}]+$", "")
    for name, shown in SHOWN.items():
        if shown:
            out = f"replace({out}, '{MARKS[name]}', '{shown}')"
    return out


def marks_in(text: str, name: str) -> str:
    return f"length({text}) - length(replace({text}, '{MARKS[name]}', ''))"


COUNTED = ("emails", "urls", "phones", "institutions", "locations", "honorifics", "pronouns", "dates")


def full_redaction(source: str) -> str:
    """``source`` gives doc_id and text."""
    t = "t"
    steps = [with_contacts(t), with_terms(t, INSTITUTIONS, MARKS["institutions"]), with_terms(t, PLACES, MARKS["locations"]), with_honorifics(t)]
    steps += [*with_pronouns(t), *with_dates(t)]
    parts = [f"s0 AS (SELECT doc_id, text AS t FROM ({source}))"]
    for k, step in enumerate(steps, 1):
        if k in (2, 3):
            parts.append(f"u{k} AS MATERIALIZED (SELECT doc_id, t, regexp_replace(lower(t), '[{SPACES}]+', ' ', 'g') AS u FROM s{k - 1})")
        parts.append(f"s{k} AS (SELECT doc_id, {step} AS t FROM {'u' if k in (2, 3) else 's'}{k if k in (2, 3) else k - 1})")
    last = len(steps)
    academic = [f"a{k} AS (SELECT doc_id, m, {step} AS t FROM {f's{last}0' if not k else f'a{k - 1}'})" for k, step in enumerate(with_academic(t))]
    parts += [f"s{last}0 AS (SELECT doc_id, t AS m, t FROM s{last})", *academic]
    counts = ", ".join(f"{marks_in('m', n)} AS {n}" for n in COUNTED)
    return f"WITH {', '.join(parts)} SELECT doc_id, {counts}, {marks_in('t', 'academic')} AS academic, sha256({unmarked('t')}) AS redacted_hash FROM a{len(academic) - 1}"


def found(text: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({text}, {quoted(pattern)}" + (f", '{flags}')" if flags else ")")


def leak_audit(source: str) -> str:
    """``source`` gives source and text; the source stands for the name."""
    t = "t"
    shown = "|".join(r"\[" + s[1:-1] + r"\]" for s in sorted({s for s in SHOWN.values() if s}))
    listed = lambda terms: found(t, LEFT + "(?:" + "|".join(term_body(x) for x in dict.fromkeys(terms)) + ")" + RIGHT)
    year = replaced(t, rf"({fixed.YEAR_PATTERN}\b){NOT_COUNTED}", rf"\1{COUNT_MARK}\2")
    tests = {
        "name": f"regexp_matches(t, '(?i){LEFT}' || source || '{RIGHT}')",
        "email": found(t, re2(fixed.EMAIL_PATTERN)),
        "phone": found(t, PHONE),
        "url": found(t, re2(fixed.URL_PATTERN), "i"),
        "city_list": listed(PLACES),
        "college_list": listed(INSTITUTIONS),
        "date": f"({found(t, re2(fixed.LEAK_MONTH_YEAR_PATTERN), 'i')} OR {found(year, BEFORE_YEAR + fixed.YEAR_PATTERN + BEHIND_YEAR)})",
        "gendered_word": f"({found(t, fixed.LEAK_GENDERED_PATTERN, 'i')} OR {found(t, re2(fixed.LEAK_HONORIFIC_PATTERN).replace('(?=', '('))})",
    }
    cases = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in tests.items())
    return (
        f"WITH d AS (SELECT source, {replaced('text', shown, ' ')} AS t FROM ({source})), c AS (SELECT source, unnest([{cases}]) AS category FROM d) "
        "SELECT source, category, count(*) AS n_documents FROM c WHERE category IS NOT NULL GROUP BY source, category"
    )
