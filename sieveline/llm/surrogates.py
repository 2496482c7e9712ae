"""Personal data and secrets replaced by keyed surrogates of the same kind and form.

Found are e-mail addresses, phone numbers, IPv4 addresses, card numbers (with a true check digit), IBANs,
social security numbers, access keys, passwords and long hexadecimal secrets, and persons' names behind a
form of address. Everything is a column expression; no Python runs on the executors.

* Keyed: a surrogate is drawn from SHA-512 of a secret key, the kind and the entity's canonical form.
* Type-consistent: digits stay digits, letters letters of their script and case; separators, country codes,
  prefixes and lengths stay; card and IBAN check digits hold; addresses lie in reserved ranges. A given name
  gets one of the same gender and script, a family name one of its script.
* Distinct: the table of all entities is checked for surrogates that two entities share or that are entities
  themselves (given and family names are one kind here); those alone are drawn again, from a space that grows with
  each round. What still collides after ``ROUNDS`` rounds, as when a kind has more entities than its form has
  surrogates, gets a number behind it; so the work always ends. Coreference: one entity has one surrogate
  everywhere, in whatever form it is written, and a named person's bare name is replaced throughout that text.

A text is replaced in one pass, so no surrogate is taken for an entity. A secret is all that stands behind the
first ``=`` or ``:``; one without letters and digits (a mask) is none. Null texts stay null, texts without entities
stay as they are. Of equal rows each is replaced alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.rows import whole
from sieveline.operators.skew import positions
from sieveline.session import materialise

KEY = "surrogate-key-1"
#: Rounds of drawing again before colliding surrogates are numbered.
ROUNDS = 12

# The forms of entities, and forms of address by gender and script.
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
FORMS = {
    "EMAIL": r"[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.)+\p{L}{2,}+",
    "ACCESS": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![\p{L}\p{N}])",
    "PASSWORD": r"(?i:password|passwd|pwd|api[_-]?key|secret|token)\s?[=:]\s?[^\s\"',;]{6,}+",
    "IBAN": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "PHONE": r"\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+(?!1[ .(-])\d{2,3}(?:[ -]?\(?\d{1,4}\)?){2,5}(?!\.?\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|\d{3}-\d{3}-\d{4}(?![\d-])",
    "SSN": r"(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d-])",
    "IP": rf"{OCTET}(?:\.{OCTET}){{3}}(?![.]?\d)",
    "CARD": r"(?:\d{4}[ -]){3}\d{4}(?![\d-])|\d{13,19}(?!\d)",
    "HEX": r"(?=[a-fA-F]*\d)(?=\d*[a-fA-F])[0-9a-fA-F]{32,64}(?![\p{L}\p{N}])",
}
ISSUED = r"^(?:4(?:\d{12}|\d{15}|\d{18})|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|6(?:011|5\d\d)\d{12})$"
ADDRESS = {
    ("m", "latin"): ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir"),
    ("f", "latin"): ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Señorita"),
    ("m", "cyrillic"): ("Господин", "Г-н"),
    ("f", "cyrillic"): ("Госпожа", "Г-жа"),
}
STARTS = r"(?<![\p{L}\p{N}_.+-])"
ANY = STARTS + "(?:" + "|".join(FORMS.values()) + ")"
NAME = r"\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)?"
PERSON = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(w for ws in ADDRESS.values() for w in ws)})\.? {NAME}(?: {NAME}){{0,2}}"
#: A text without any of these holds no entity.
MAYBE = r"[0-9@]|(?i:password|passwd|pwd|api[_-]?key|secret|token)\s?[=:]|(?:" + "|".join(w for ws in ADDRESS.values() for w in ws) + r")\.? \p{Lu}"
SYLLABLES = {
    "latin": "ba be da de fa fe ga ge ha he ka ke la le ma me na ne pa pe ra re sa se ta te va ve wa we zo lo".split(),
    "cyrillic": "ба бе да де фа фе га ге ха хе ка ке ла ле ма ме на не па пе ра ре са се та те ва ве за зе зо ло".split(),
}
ENDS = {
    ("given", "m", "latin"): "n r s l".split(), ("given", "f", "latin"): "na ra sa la".split(), ("family", "", "latin"): "son berg mann ner".split(),
    ("given", "m", "cyrillic"): "н р с л".split(), ("given", "f", "cyrillic"): "на ра са ла".split(), ("family", "m", "cyrillic"): "ов ев ин ский".split(), ("family", "f", "cyrillic"): "ова ева ина ская".split(),
}


def raw(pattern: str) -> Column:
    return F.lit(pattern)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(number: Column) -> Column:
    """The sum of a number's digits, every second from the right doubled."""
    return F.aggregate(
        F.transform(F.reverse(chars(number)), lambda c, i: (c.cast("int") * (1 + i % 2))), F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)
    )


def mod97(text: Column) -> Column:
    """An IBAN in transport order, letters as 10 to 35, modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars(text), F.lit(0), lambda s, c: F.when(c.rlike("[0-9]"), (s * 10 + value(c)) % 97).otherwise((s * 100 + value(c)) % 97))


def matches(text: Column) -> Column:
    """Everything in a text that has an entity's form."""
    return F.regexp_extract_all(text, raw(ANY), F.lit(0))


def kind_of(found: Column) -> Column:
    """The kind of a match; null for numbers that merely look like one."""
    plain = digits(found)
    packed = F.regexp_replace(found, " ", "")
    full = {k: found.rlike(f"^(?:{p})$") for k, p in FORMS.items()}
    card = full["CARD"] & plain.rlike(ISSUED) & (luhn(plain) % 10 == 0)
    iban = full["IBAN"] & (F.length(packed) >= 15) & (mod97(F.concat(F.substring(packed, 5, 34), F.substring(packed, 1, 4))) == 1)
    return (
        F.when(full["EMAIL"], "EMAIL").when(full["PASSWORD"] & ~found.rlike(r"[=:].*[\p{L}\p{N}]"), None).when(full["ACCESS"] | full["PASSWORD"] | full["HEX"], "SECRET").when(full["PHONE"], "PHONE")
        .when(full["SSN"], "SSN").when(full["IP"], "IP").when(card, "CARD").when(iban, "IBAN")
    )


def canonical(kind: Column, found: Column) -> Column:
    return (
        F.when(kind == "EMAIL", F.lower(found)).when(kind.isin("PHONE", "CARD", "SSN"), digits(found)).when(kind == "IBAN", F.regexp_replace(found, " ", ""))
        .when((kind == "SECRET") & found.rlike("[=:]"), F.regexp_extract(found, r"^[^=:]*[=:]\s?(.*)$", 1)).otherwise(found)
    )


def stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """256 keyed bytes as an array of numbers."""
    parts = [F.sha2(F.concat_ws("\x1f", F.lit(key), kind, attempt.cast("string"), F.lit(str(k)), canon), 512) for k in range(4)]
    text = F.concat(*parts)
    return F.transform(F.regexp_extract_all(text, F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))


def letter(alphabet: str, byte: Column) -> Column:
    return F.substring(F.lit(alphabet), byte % len(alphabet) + 1, F.lit(1))


def same_form(text: Column, bytes_: Column, shift: int = 0) -> Column:
    """Each letter and digit replaced by another of its script and case; hexadecimal numbers stay such."""
    is_hex = text.rlike("^(?:[0-9a-f]{8,}|[0-9A-F]{8,})$")
    upper, lower = (F.when(is_hex, F.lit(h)).otherwise(F.lit(a)) for h, a in (("ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("abcdef", "abcdefghijklmnopqrstuvwxyz")))

    def one(c, i):
        byte = F.element_at(bytes_, (i + shift) % 256 + 1)
        pick = lambda a: F.substring(a, byte % F.length(a) + 1, F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), pick(F.lit("0123456789"))).when(c.rlike("[a-z]"), pick(lower)).when(c.rlike("[A-Z]"), pick(upper))
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), pick(F.lit("АБВГДЕЖЗИКЛМНОПРСТУФХ"))).otherwise(pick(F.lit("абвгдежзиклмнопрстуфх"))))
            .when(c.rlike(r"\p{IsGreek}"), F.when(c.rlike(r"\p{Lu}"), pick(F.lit("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"))).otherwise(pick(F.lit("αβγδεζηθικλμνξοπρστυφχψω"))))
            .when(c.rlike(r"\p{Lu}"), pick(F.lit("ÀÂÉÈÊÎÔÖÜ"))).when(c.rlike(r"\p{L}"), pick(F.lit("àâéèêîôöü"))).otherwise(c)
        )

    return F.array_join(F.transform(chars(text), one), "")


def surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form of the entity's surrogate."""
    b = F.col("_bytes")
    at = lambda i: F.element_at(b, i + 1)
    # Each round beyond the second has one letter or digit more to differ in.
    more = F.greatest(attempt - 1, F.lit(0))
    letters, numbers = (F.array_join(F.transform(F.slice(b, F.lit(200), more), lambda x: letter(a, x)), "") for a in ("abcdefghijklmnopqrstuvwxyz", "0123456789"))
    mapped = F.col("_mapped")
    n = F.length(canon)
    domain = stream(key, F.lit("DOMAIN"), F.substring_index(canon, "@", -1), F.lit(0))
    email = F.concat(same_form(F.substring_index(canon, "@", 1), b), letters, F.lit("@"), F.array_join(F.transform(F.slice(domain, 1, 8), lambda x: letter("abcdefghijklmnopqrstuvwxyz", x)), ""), F.lit(".example"))
    # Country codes stay: 1 for North America, two digits elsewhere; plain local numbers have none.
    code = F.when(n == 10, 0).when((n == 11) & canon.startswith("1"), 1).otherwise(2)
    phone = F.concat(F.substring(canon, F.lit(1), code), F.expr("substring(_mapped, 1 + %s)" % "case when length(canon) = 10 then 0 when length(canon) = 11 and canon like '1%' then 1 else 2 end"), numbers)
    ip = F.concat_ws(".", *[x.cast("string") for x in (F.when(more > 0, 1 + at(0) % 254).otherwise(240 + at(0) % 15), at(1), at(2), 1 + at(3) % 254)])
    ssn = F.concat(F.when(more > 0, F.substring(mapped, 1, 1)).otherwise(F.lit("9")), F.expr("substring(_mapped, 2, 2)"), F.lpad((1 + at(100) % 99).cast("string"), 2, "0"), F.lpad((1 + (at(101) * 256 + at(102)) % 9999).cast("string"), 4, "0"))
    body = F.concat(F.substring(canon, 1, 1), F.expr("substring(_mapped, 2, length(canon) - 2)"))
    card = F.concat(body, ((10 - luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    account = F.expr("substring(_mapped, 5)")
    land = F.substring(canon, 1, 2)
    iban = F.concat(land, F.lpad((98 - mod97(F.concat(account, land, F.lit("00")))).cast("string"), 2, "0"), account)
    secret = F.when(canon.rlike("^(?:AKIA|ASIA)"), F.concat(F.substring(canon, 1, 4), F.expr("substring(_mapped, 5)"))).otherwise(mapped)
    secret = F.concat(secret, letters)
    out = F.when(kind == "EMAIL", email).when(kind == "PHONE", phone).when(kind == "IP", ip).when(kind == "SSN", ssn).when(kind == "CARD", card).when(kind == "IBAN", iban).when(kind == "SECRET", secret)
    for (place, gender, script), ends in ENDS.items():
        syllable = lambda x: F.element_at(F.array(*[F.lit(s) for s in SYLLABLES[script]]), x % len(SYLLABLES[script]) + 1)  # noqa: E731, B023
        end = F.element_at(F.array(*[F.lit(e) for e in ends]), at(3) % len(ends) + 1)
        # Two syllables, and one more with each round.
        name = F.concat(F.array_join(F.transform(F.slice(b, F.lit(5), attempt + 2), syllable), ""), end)
        out = out.when(kind == "-".join((place, gender, script)), name)
    return out


def drawn(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, surrogate of all entities (kind, canon, attempt)."""
    bytes_ = stream(key, F.col("kind"), F.col("canon"), F.col("attempt"))
    return (
        entities.withColumn("_bytes", bytes_).withColumn("_mapped", same_form(F.col("canon"), F.col("_bytes")))
        .withColumn("surrogate", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt")))
        .select("kind", "canon", "attempt", "surrogate")
    )


def surrogate_table(entities: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """kind, canon, surrogate: one row per entity, no surrogate twice and none an entity itself."""
    cores = entities.sparkSession.sparkContext.defaultParallelism
    spread_out = lambda df: drawn(df.repartition(cores, "canon"), key)  # noqa: E731  few rows, much work in each
    # Names of all kinds are told apart, as a text may hold them side by side.
    family = F.when(F.col("kind").contains("-"), "name").otherwise(F.col("kind"))
    table = materialise(spread_out(entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0))))
    real = materialise(table.select(family.alias("_family"), F.col("canon").alias("surrogate")).distinct().withColumn("_real", F.lit(True)))
    for turn in range(rounds + 1):
        mine = table.withColumn("_family", family)
        first = F.min(F.struct("kind", "canon"))
        groups = mine.groupBy("_family", "surrogate").agg(first.alias("_first"), F.count(F.lit(1)).alias("_n"))
        judged = groups.join(real, ["_family", "surrogate"], "left").filter(F.col("_real") | (F.col("_n") > 1))
        marked = mine.join(judged, ["_family", "surrogate"], "left")
        again = F.col("_first").isNotNull() & (F.coalesce("_real", F.lit(False)) | ~F.struct("kind", "canon").eqNullSafe(F.col("_first")))
        marked = materialise(marked.select("kind", "canon", "attempt", "surrogate", again.alias("_again")))
        colliding = marked.filter("_again")
        if colliding.isEmpty():
            break
        settled = marked.filter("not _again").select("kind", "canon", "attempt", "surrogate")
        if turn == rounds:
            numbered = positions(colliding.withColumn("_all", F.lit(0)), ["_all"], [F.col("kind"), F.col("canon")], "_number")
            named = F.concat("surrogate", F.lit("-"), F.col("_number").cast("string"))
            return settled.unionByName(numbered.withColumn("surrogate", named).select(*settled.columns)).select("kind", "canon", "surrogate")
        fresh = spread_out(colliding.select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))
        table = materialise(settled.unionByName(fresh))
    return table.select("kind", "canon", "surrogate")


def written_like(found: Column, kind: Column, new: Column) -> Column:
    """The surrogate in the form the entity is written in."""
    spaced = F.array_join(
        F.transform(
            chars(found),
            lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(new, F.length(F.regexp_replace(F.substring(found, F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c),
        ),
        "",
    )
    secret = F.concat(F.regexp_extract(found, r"^([^=:]*[=:]\s?)", 1), new)
    email = F.when(found == F.upper(found), F.upper(new)).otherwise(new)
    spaced = F.concat(spaced, F.substring(new, F.length(F.regexp_replace(found, "[^0-9A-Za-z]", "")) + 1, F.length(new)))
    return (
        F.when(kind.isin("PHONE", "CARD", "SSN", "IBAN"), spaced).when((kind == "SECRET") & found.rlike("[=:]"), secret).when(kind == "EMAIL", email)
        .when(kind.contains("-"), F.when((found == F.upper(found)) & (F.length(found) > 1), F.upper(new)).otherwise(F.initcap(new))).otherwise(new)
    )


def person_names(text: Column) -> Column:
    """(kind, found) of the names behind forms of address: all but a lone or last name are given names."""
    whole = F.regexp_extract_all(text, raw(PERSON), F.lit(0))
    female = "^(?:" + "|".join(w for (g, _), ws in ADDRESS.items() if g == "f" for w in ws) + r")\b"
    def of(person):
        names = F.filter(F.slice(F.split(person, r"\.? "), 2, 9), lambda n: n != "")
        gender = F.when(person.rlike("(?U)" + female), "f").otherwise("m")
        def one(name, i):
            script = F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
            place = F.when(i < F.size(names) - 1, F.lit("given")).otherwise(F.lit("family"))
            return F.struct(F.concat_ws("-", place, F.when((place == "family") & (script == "latin"), F.lit("")).otherwise(gender), script).alias("kind"), name.alias("found"))
        return F.transform(names, one)
    return F.array_distinct(F.flatten(F.transform(whole, of)))


def with_surrogates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: str = KEY) -> DataFrame:
    """The rows with their text replaced, all other columns as they were, and ``n_entities`` (spans replaced;
    a bare name that recurs counts once)."""
    columns = [c for c in docs.columns if c != "n_entities"]
    rows = docs.select(whole(docs).alias("_row"))
    text = F.col("_row").getField(text_col)
    maybe = F.coalesce(text.rlike(MAYBE), F.lit(False))
    rows_maybe = rows.filter(maybe).withColumn("_key", F.xxhash64(F.col("_row").getField(id_col), text))
    forms = F.transform(F.array_distinct(matches(text)), lambda m: F.struct(F.lit(None).cast("string").alias("kind"), m.alias("found")))
    spans = (
        rows_maybe.select("_key", F.explode(F.concat(forms, person_names(text))).alias("s"))
        .select("_key", F.col("s.found").alias("found"), F.coalesce(F.col("s.kind"), kind_of(F.col("s.found"))).alias("kind"))
        .filter("kind is not null")
    )
    # The few spans are written before anything else is made of them, so the scan of all texts stays a short plan.
    canon = F.when(F.col("kind").contains("-"), F.lower("found")).otherwise(canonical(F.col("kind"), F.col("found")))
    spans = materialise(spans).withColumn("canon", canon)
    table = surrogate_table(spans.select("kind", "canon"), key)
    written = spans.join(table, ["kind", "canon"]).select("_key", "found", F.col("kind").contains("-").alias("name"), written_like(F.col("found"), F.col("kind"), F.col("surrogate")).alias("new"))
    # One entry per form: of a name that is both given and family name the first in order.
    by_text = written.groupBy("_key", "found").agg(F.min("new").alias("new"), F.max("name").alias("name")).groupBy("_key").agg(
        F.map_from_entries(F.collect_list(F.struct("found", "new"))).alias("_map"),
        F.array_sort(F.collect_list(F.when(F.col("name"), F.struct(-F.length("found"), "found")))).alias("_names"),
    )
    keyed = rows_maybe.join(by_text, "_key", "left").withColumn("_names", F.transform("_names", lambda n: n["found"]))
    # Forms and the text's names, longer ones first, are found in one pass: what is put in is never read again.
    bare = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join("_names", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    pattern = F.when(F.size("_names") > 0, bare).otherwise(F.lit(ANY))
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))  # one hit less than gaps
    named = F.array_join(F.transform(pieces, lambda p: F.concat(p.gap, F.coalesce(F.try_element_at(F.col("_map"), p.hit), p.hit, F.lit("")))), "")
    count = F.size(F.filter(hits, lambda h: F.map_contains_key(F.col("_map"), h) & ~F.array_contains("_names", h))) + F.size("_names")
    plain = F.col("_map").isNull()
    new_text = F.when(plain, text).otherwise(named)
    changed = keyed.select("_row", new_text.alias("_new"), F.when(plain, 0).otherwise(count).cast("long").alias("_n"))
    calm = rows.filter(~maybe).select("_row", text.alias("_new"), F.lit(0).cast("long").alias("_n"))
    return calm.unionByName(changed).select(
        *[F.col("_new").alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in columns], F.col("_n").alias("n_entities")
    )
