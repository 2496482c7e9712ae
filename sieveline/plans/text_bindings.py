"""Queries over the text tables: guard, redaction, terms, copies, quotes, links."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline import fixed
from sieveline.functions import hashing, text as tx
from sieveline.operators import calibration, dictionary, evidence, fidelity, guard, identity, leak, redact, validity
from sieveline.operators.skew import deal_rows
from sieveline.plans import redaction_sql
from sieveline.plans.bindings import long_counts, query, table, text_table
from sieveline.session import materialise
from sieveline.term_lists import INSTITUTIONS, PLACES

WORDS_SQL = r"len(regexp_extract_all(text, '[\p{L}\p{N}][^\s]*'))"


@query(
    "word_guard",
    f"""SELECT doc_id, {WORDS_SQL} AS word_count, {WORDS_SQL} < 150 AS unparseable,
        CASE WHEN {WORDS_SQL} < 150 THEN 'unparseable' WHEN n_chars < 2000 THEN 'extraction_fidelity' ELSE 'ok' END AS verdict FROM documents""",
)
def word_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["text", "n_chars"])
    counted = docs.select("doc_id", "n_chars", tx.word_count(F.col("text")).alias("word_count")).withColumn(
        "unparseable", F.col("word_count") < fixed.MIN_WORDS
    )
    no_leaks = F.array().cast("array<string>")
    result = counted.select(
        "doc_id", "word_count", "unparseable",
        fidelity.verdict(F.col("unparseable"), F.col("n_chars") >= 2000, no_leaks).alias("verdict"),
    )
    return long_counts(result, "word_count")


# The corpus holds licence lines where applications would hold instructions; they are removed the same way.
LINE_PATTERNS = [*fixed.INJECTION_PATTERNS, ("licence_line", r"\b(licen[cs]ed?|copyright)\b")]


def _ladder_sql(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({x}, '{p}', 'i') THEN '{n}'" for n, p in LINE_PATTERNS)
    return f"CASE {cases} END"


@query(
    "injection_lines",
    f"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
      k AS (SELECT doc_id, list_filter(lines, lambda x: {_ladder_sql('x')} IS NULL) AS kept,
                   list_transform(list_filter(lines, lambda x: {_ladder_sql('x')} IS NOT NULL), lambda x: {_ladder_sql('x')} || ': ' || x) AS removed FROM l)
      SELECT doc_id, len(removed) AS n_removed, len(removed) > 0 AS integrity_check, array_to_string(removed, chr(10)) AS removed,
             sha256(array_to_string(kept, chr(10))) AS clean_hash FROM k""",
)
def injection_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["text"]).withColumn(
        "hidden_text", F.array().cast("array<string>")
    )
    out = guard.guard(docs, LINE_PATTERNS)
    result = out.select(
        "doc_id",
        F.size("injection_lines").alias("n_removed"),
        "integrity_check",
        F.array_join(F.transform("injection_lines", lambda r: F.concat_ws(": ", r["pattern"], r["line"])), "\n").alias("removed"),
        F.sha2("text", 256).alias("clean_hash"),
    )
    return long_counts(result, "n_removed")


_VISIBLE_SQL = "html"
for _pattern in guard.UNSEEN_MARKUP:
    _VISIBLE_SQL = f"regexp_replace({_VISIBLE_SQL}, '{_pattern}', '', 'g')"
_VISIBLE_SQL = f"regexp_replace(regexp_replace({_VISIBLE_SQL}, '{guard.LINE_TAGS}', chr(10), 'g'), '<[^>]*>', '', 'g')"
for _entity, _char in [("&quot;", '"'), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]:
    _VISIBLE_SQL = f"replace({_VISIBLE_SQL}, '{_entity}', '{_char}')"


@query(
    "visible_text",
    f"WITH v AS (SELECT page_id, length(html) AS n_html, {_VISIBLE_SQL} AS visible FROM pages) "
    "SELECT page_id, n_html, length(visible) AS n_visible, sha256(visible) AS visible_hash FROM v",
)
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = text_table(spark, sf_dir, "pages", "page_id", ["html"])
    shown = pages.select("page_id", F.length("html").alias("n_html"), guard.visible_html(F.col("html")).alias("visible"))
    result = shown.select("page_id", "n_html", F.length("visible").alias("n_visible"), F.sha2("visible", 256).alias("visible_hash"))
    return long_counts(result, "n_html", "n_visible")


# RE2 has no lookaround: the phone's neighbours are captured and put back, twice, so that two numbers may
# share one; marks stand for the three kinds.
_PHONE_SQL = r"(^|[^\w₹$€£])\+?\d(?:[\s\-().]*\d){9,}($|[^\w%])"
_CONTACT_SQL = (
    f"regexp_replace(regexp_replace(text, '{fixed.EMAIL_PATTERN}', chr(57344), 'g'), '{fixed.URL_PATTERN}', chr(57345), 'gi')"
)
_CONTACT_SQL = f"regexp_replace(regexp_replace({_CONTACT_SQL}, '{_PHONE_SQL}', '\\1' || chr(57346) || '\\2', 'g'), '{_PHONE_SQL}', '\\1' || chr(57346) || '\\2', 'g')"


def _mark_count_sql(code: int) -> str:
    return f"length(m) - length(replace(m, chr({code}), ''))"


@query(
    "contact_redaction",
    f"""WITH d AS (SELECT doc_id, {_CONTACT_SQL} AS m FROM documents)
      SELECT doc_id, {_mark_count_sql(57344)} AS emails, {_mark_count_sql(57345)} AS urls, {_mark_count_sql(57346)} AS phones,
             sha256(replace(replace(replace(m, chr(57344), '[CANDIDATE]'), chr(57345), '[CANDIDATE]'), chr(57346), '[CANDIDATE]')) AS redacted_hash
      FROM d""",
)
def contact_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["text"])
    marked = docs.select("doc_id", F.array(redact.mark_contacts(F.col("text"))).alias("m"))
    count = lambda name: redact.count_mark(F.col("m"), redact.MARKS[name]).alias(name)
    result = marked.select(
        "doc_id", count("emails"), count("urls"), count("phones"),
        F.sha2(redact.show_marks(F.get("m", F.lit(0))), 256).alias("redacted_hash"),
    )
    return long_counts(result, "emails", "urls", "phones")


# What the corpus holds of people, places, schools and dates is little: common words stand for more of it.
TOLD = [
    (" is the ", " Delhi NCR, "), (" was the ", " at IIT Madras in June 2019. "), (" with the ", " Mr. Rao and his "), (" on the ", " because she's 3 in 2010 clients or 2011-12 "),
    (" las ", " St. Xavier's College, "), (" as the ", " NCR "), (" und der ", " Her her team (CGPA: 9.14 / 10) "), (" und die ", " Dr. Old Mumbai said HE moved 03/2020, 2019/05-1 and "),
]
_TOLD_SQL = "text"
for _word, _told in TOLD:
    _TOLD_SQL = f"replace({_TOLD_SQL}, {redaction_sql.quoted(_word)}, {redaction_sql.quoted(_told)})"


def told(text: Column) -> Column:
    for word, new in TOLD:
        text = F.replace(text, F.lit(word), F.lit(new))
    return text


@query("full_redaction", redaction_sql.full_redaction(f"SELECT doc_id, {_TOLD_SQL} AS text FROM documents"))
def full_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents through every redaction pass, with the fixed place and institution lists."""
    docs = deal_rows(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("text", told(F.col("text")))
    none = F.array().cast("array<string>")
    own = F.struct(*[none.alias(n) for n in ("names", "emails", "phones", "urls", "locations", "institutions", "companies")])
    termed = docs.withColumn("_h", redact.comparable(F.col("text")))
    termed = termed.withColumn("_terms", redact.prepare_terms(own, F.col("_h")))
    marked = termed.withColumn("_m", redact.mark_identity(F.array("text"), F.col("_terms")))
    final = marked.withColumn("_f", F.transform("_m", redact.mark_academic))
    final = final.withColumn("_k", redact.only_marks(F.col("_m")))
    counts = [redact.count_mark(F.col("_k"), redact.MARKS[n]).alias(n) for n in redaction_sql.COUNTED]
    result = final.select(
        "doc_id", *counts, redact.count_mark(F.col("_f"), redact.MARKS["academic"]).alias("academic"),
        F.sha2(redact.unmark(F.get("_f", F.lit(0))), 256).alias("redacted_hash"),
    )
    return long_counts(result, *redaction_sql.COUNTED, "academic")


DICTIONARY = ["of the", "in the", "that the", "et la", "der die", "the by", "license", "Apache License", "MIT License", "de la que", *dict.fromkeys(PLACES + INSTITUTIONS)]
LONGEST = max(len(tx_words) for tx_words in (re.findall(r"[^\W_]+", t) for t in DICTIONARY))


@query(
    "dictionary_terms",
    f"""WITH t AS (SELECT unnest([{", ".join(map(redaction_sql.quoted, DICTIONARY))}]) AS term),
      n AS (SELECT array_to_string(list_filter(string_split_regex(regexp_replace(lower(term), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda x: x <> ''), ' ') AS run, term FROM t),
      w AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(lower({_TOLD_SQL}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS ws FROM documents),
      o AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
      l AS (SELECT doc_id, x, [x{"".join(f", lead(x, {j}) OVER p" for j in range(1, LONGEST))}] AS xs FROM o WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
      h AS (SELECT run, term, string_split(run, ' ')[1] AS x, len(string_split(run, ' ')) AS k FROM n)
      SELECT doc_id, term, count(*) AS n_hits FROM l JOIN h ON l.x = h.x AND array_to_string(xs[1:k], ' ') = run GROUP BY doc_id, term""",
)
def dictionary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed lists of places and institutions, and some common runs, in every whole text."""
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["text"]).withColumn("text", told(F.col("text")))
    terms = spark.createDataFrame([(t,) for t in DICTIONARY], "term string")
    return dictionary.term_hits(docs, terms, max_words=LONGEST)


_SHINGLES_SQL = """list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i+7], ' '))"""


def _words_sql(table_name: str, key: str) -> str:
    return (
        f"SELECT {key}, list_filter(string_split_regex(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), "
        f"lambda x: x <> '') AS ws FROM {table_name}"
    )


@query(
    "anchor_copy",
    f"""WITH d AS ({_words_sql('documents', 'doc_id')}), b AS ({_words_sql('benchmark', 'item_id')}),
      ds AS (SELECT doc_id, unnest({_SHINGLES_SQL}) AS s FROM d), bs AS (SELECT DISTINCT unnest({_SHINGLES_SQL}) AS s FROM b)
      SELECT DISTINCT doc_id FROM ds WHERE s IN (SELECT s FROM bs)""",
)
def anchor_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["text"])
    return evidence.copied_texts(docs, table(spark, sf_dir, "benchmark").select("text"), ["doc_id"])


_NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(
    "quote_verify",
    f"""WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents),
      l AS (SELECT doc_id, -1 AS turn, string_split(text, chr(10)) AS ls FROM documents
            UNION ALL SELECT conv_id, turn, string_split(text, chr(10)) FROM conversations),
      q AS (SELECT doc_id, turn, unnest(range(len(ls))) AS line, unnest(ls) AS quote FROM l)
      SELECT q.doc_id, q.turn, q.line, length(trim(regexp_replace(quote, '\\s+', ' ', 'g'))) >= 3
             AND contains(d.norm, trim(regexp_replace(quote, '\\s+', ' ', 'g'))) AS quote_ok
      FROM q JOIN d USING (doc_id)""",
)
def quote_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["text"])
    index = docs.select("doc_id", tx.normal(F.col("text")).alias("norm"))
    lines = F.posexplode(F.split("text", "\n")).alias("line", "quote")
    own = docs.select("doc_id", F.lit(-1).cast("bigint").alias("turn"), lines)
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", lines)
    checked = evidence.check_quotes(own.unionByName(said), index)
    return checked.select("doc_id", "turn", F.col("line").cast("bigint").alias("line"), "quote_ok")


@query(
    "duplicate_links",
    """SELECT doc_id, min(doc_id) OVER w AS link_head, count(*) OVER w - 1 AS n_linked FROM documents
       WINDOW w AS (PARTITION BY lang, sha256(text))""",
)
def duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["lang", "text"])
    # The texts are read once; linking goes on from the narrow keys.
    keyed = materialise(docs.select("doc_id", F.col("lang").alias("pool_id"), F.sha2("text", 256).alias("record_key")))
    return identity.link_groups(keyed, "doc_id").select("doc_id", "link_head", "n_linked")


@query(
    "linked_documents",
    """SELECT a.doc_id, b.doc_id AS linked_id FROM documents a JOIN labels l ON l.doc_id = a.doc_id AND l.quality = 0
       JOIN documents b ON a.lang = b.lang AND sha256(a.text) = sha256(b.text) AND a.doc_id <> b.doc_id""",
)
def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of the documents somebody asks for (here: those labelled poor)."""
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["lang", "text"])
    keyed = materialise(
        docs.select(F.col("doc_id").alias("candidate_id"), F.col("lang").alias("pool_id"), F.sha2("text", 256).alias("record_key"))
    )
    asked = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("candidate_id"))
    pairs = identity.linked_with(materialise(identity.link_groups(keyed)), asked)
    return pairs.select(F.col("candidate_id").alias("doc_id"), "linked_id")


PAGE = 50


@query(
    "linked_page",
    f"""WITH m AS (SELECT doc_id, lang, source, (row_number() OVER w - 1) // {PAGE} AS page, (count(*) OVER (PARTITION BY lang, source) - 1) // {PAGE} AS last
                  FROM documents WHERE lang IS NOT NULL WINDOW w AS (PARTITION BY lang, source ORDER BY doc_id)),
      asked AS (SELECT DISTINCT doc_id, lang, source, last, unnest([0, last]) AS page FROM m SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 0) l USING (doc_id))
      SELECT a.doc_id, a.page, a.last + 1 AS n_pages, b.doc_id AS linked_id
      FROM asked a JOIN m b ON a.lang = b.lang AND a.source IS NOT DISTINCT FROM b.source AND a.page = b.page AND a.doc_id <> b.doc_id""",
)
def linked_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last page of the documents of one language and source, for each that is labelled poor."""
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["lang", "source"])
    keyed = materialise(docs.select(F.col("doc_id").alias("candidate_id"), F.col("lang").alias("pool_id"), F.col("source").alias("record_key")))
    links = materialise(identity.link_groups(keyed))
    poor = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("candidate_id"))
    last = F.floor(F.col("n_linked") / PAGE)
    asked = links.join(poor, "candidate_id", "left_semi").select("candidate_id", F.explode(F.array(F.lit(0).cast("bigint"), last)).alias("page"))
    found = identity.linked_on_page(links, identity.link_pages(links, PAGE), asked)
    return found.withColumnRenamed("candidate_id", "doc_id")


@query(
    "open_page",
    f"""WITH ev AS (SELECT doc_id, source AS role_applied, CASE doc_id % 5 WHEN 0 THEN 'declined' WHEN 1 THEN 'withdrawn' WHEN 2 THEN 'hold' WHEN 3 THEN 'scored' END AS pipeline_status FROM documents),
      g AS (SELECT doc_id, lang, source FROM documents WHERE lang IS NOT NULL QUALIFY count(*) OVER (PARTITION BY lang, source) > 1),
      o AS (SELECT g.*, role_applied, pipeline_status, (row_number() OVER (PARTITION BY lang, g.source ORDER BY doc_id) - 1) // {PAGE} AS page
            FROM g JOIN ev USING (doc_id) WHERE coalesce(pipeline_status, '') NOT IN ('declined', 'withdrawn')),
      p AS (SELECT *, max(page) OVER (PARTITION BY lang, source) + 1 AS n_pages FROM o)
      SELECT a.doc_id, p.page, p.n_pages, p.doc_id AS linked_id, p.role_applied, p.pipeline_status
      FROM g a SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 0) l USING (doc_id)
      JOIN p ON a.lang = p.lang AND a.source IS NOT DISTINCT FROM p.source AND p.page = 0 AND a.doc_id <> p.doc_id""",
)
def open_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the open applications beside each document labelled poor (same language and source)."""
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["lang", "source"])
    keyed = materialise(docs.select(F.col("doc_id").alias("candidate_id"), F.col("lang").alias("pool_id"), F.col("source").alias("record_key")))
    links = materialise(identity.link_groups(keyed))
    status = F.get(F.array(*[F.lit(s) for s in ("declined", "withdrawn", "hold", "scored", None)]), (F.col("candidate_id") % 5).cast("int"))
    evaluations = keyed.select("candidate_id", F.col("record_key").alias("role_applied"), status.alias("pipeline_status"))
    poor = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("candidate_id"), F.lit(0).alias("page"))
    found = identity.open_applications_on_page(links, identity.open_pages(links, evaluations, PAGE), poor)
    return found.withColumnRenamed("candidate_id", "doc_id")


@query(
    "calibration_margin",
    f"""WITH m AS (SELECT doc_id, CAST({WORDS_SQL} AS DOUBLE) AS core FROM documents)
      SELECT count(*) AS n, bool_and(core IS NOT NULL) AS complete, min(core) FILTER (WHERE quality = 1) AS min_top,
             max(core) FILTER (WHERE quality = 0) AS max_others,
             min(core) FILTER (WHERE quality = 1) - max(core) FILTER (WHERE quality = 0) AS margin,
             bool_and(core IS NOT NULL) AND min(core) FILTER (WHERE quality = 1) > max(core) FILTER (WHERE quality = 0) AS passed
      FROM labels LEFT JOIN m USING (doc_id)""",
)
def calibration_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word count as the score of a document."""
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["text"])
    core = docs.select("doc_id", tx.word_count(F.col("text")).cast("double").alias("core_score"))
    return calibration.verdict(table(spark, sf_dir, "labels"), core, label="quality", top=1)


@query(
    "record_keys",
    """WITH c AS (SELECT c_custkey, lower(trim(c_name)) || '@example.org' AS email, CAST(c_custkey + 1000000 AS VARCHAR) || '0000' AS phone, c_mktsegment AS seg FROM customer),
      k AS (SELECT *, CASE WHEN seg IN ('BUILDING', 'MACHINERY') THEN 'e' WHEN seg IN ('HOUSEHOLD', 'FURNITURE') THEN 'p' ELSE 'f' END AS kind FROM c),
      m AS (SELECT *, CASE kind WHEN 'e' THEN email ELSE right(phone, 10) END AS message FROM k)
      SELECT c_custkey, CASE kind WHEN 'f' THEN 'f:' || sha256(email) ELSE kind || ':' ||
        sha256(unhex('%s') || unhex(sha256(unhex('%s') || encode(message)))) END AS record_key FROM m"""
    % tuple("".join(f"{b ^ pad:02x}" for b in b"a shared secret".ljust(64, b"\0")) for pad in (0x5C, 0x36)),
)
def record_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    email = F.concat(F.lower(F.trim("c_name")), F.lit("@example.org"))
    phone = F.concat((F.col("c_custkey") + 1000000).cast("string"), F.lit("0000"))
    segment, none = F.col("c_mktsegment"), F.array().cast("array<string>")
    emails = F.when(segment.isin("BUILDING", "MACHINERY"), F.array(F.lit("not an address"), email)).otherwise(none)
    phones = F.when(segment.isin("HOUSEHOLD", "FURNITURE"), F.array(F.lit("12"), phone)).otherwise(none)
    return c.select("c_custkey", identity.record_key("a shared secret", emails, phones, F.sha2(email, 256)).alias("record_key"))


@query(
    "text_hashes",
    r"""SELECT conv_id, turn, sha256(regexp_replace(text, '\r\n?', chr(10), 'g')) AS text_hash,
        sha256('{"conv_id":' || conv_id || ',"role":"' || role || '","turn":' || turn || '}') AS row_hash FROM conversations""",
)
def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {n: F.col(n) for n in ("turn", "role", "conv_id")}
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", hashing.text_hash(F.col("text")).alias("text_hash"),
        F.sha2(hashing.canonical_json_column(fields), 256).alias("row_hash"),
    )


_TOPIC_SQL = f"regexp_matches(text, '{fixed.BRIEF_FORBIDDEN_PATTERN}', 'i')"
_INVITE_SQL = f"({_TOPIC_SQL} OR regexp_matches(text, '{fixed.INVITE_FORBIDDEN_PATTERN}', 'i'))"


@query(
    "brief_screen",
    f"""SELECT conv_id, turn, {_TOPIC_SQL} AS forbidden, {_INVITE_SQL} AS forbidden_invite,
        len(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> '')) <= 60 AS short_enough FROM conversations""",
)
def brief_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = text_table(spark, sf_dir, "conversations", "conv_id", ["turn", "text"])
    text = F.col("text")
    return turns.select(
        "conv_id", "turn", validity.forbidden(text).alias("forbidden"), validity.forbidden_invite(text).alias("forbidden_invite"),
        (tx.token_count(text) <= 60).alias("short_enough"),
    )


def _dropped_sql() -> str:
    gap = "|".join(f"(?:{p})" for p in fixed.GAP_PATTERNS)
    personal = "|".join(f"(?:{p})" for p in fixed.PERSONAL_PATTERNS)

    def quoted(pattern: str) -> str:
        return pattern.replace("'", "''")

    return (
        f"CASE WHEN regexp_matches(u, '{quoted(gap)}', 'i') THEN 'gap' WHEN regexp_matches(u, '{quoted(personal)}', 'i') "
        f"OR regexp_matches(u, '{quoted(fixed.PERSONAL_CASED_PATTERN)}') THEN 'personal' "
        f"WHEN regexp_matches(u, '{quoted(fixed.RELOCATION_PATTERN)}', 'i') THEN 'relocation' "
        f"WHEN regexp_matches(u, '{quoted(fixed.LANGUAGE_SENTENCE_PATTERN)}', 'i') AND regexp_matches(u, '{redact.LANGUAGE_WORD}') THEN 'language' "
        "ELSE 'kept' END"
    )


@query(
    "unit_drops",
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM documents), r AS (SELECT doc_id, {_dropped_sql()} AS reason FROM l)
      SELECT doc_id, reason, count(*) AS n_units FROM r GROUP BY doc_id, reason""",
)
def unit_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a unit, with the reason it would go."""
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["text"])
    units = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("u"))
    reason = F.coalesce(redact.drop_reason(F.col("u")), F.lit("kept"))
    return units.select("doc_id", reason.alias("reason")).groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n_units"))


@query(
    "relocation_status",
    f"""WITH s AS (SELECT doc_id, source, text AS said, CASE source WHEN 'src3' THEN 'Old Bombay' ELSE lang END AS place FROM documents)
      SELECT CASE WHEN regexp_matches(said, '{fixed.ELIGIBLE_NO_PATTERN.replace("'", "''")}', 'i') THEN 'stated_no'
        WHEN regexp_matches(said, '{fixed.ELIGIBLE_YES_PATTERN}', 'i') THEN 'stated_yes'
        WHEN regexp_matches(place, '{fixed.ELIGIBLE_PLACE_PATTERN}', 'i') THEN 'stated_yes' ELSE 'unstated' END AS eligibility, source, count(*) AS n
      FROM s GROUP BY ALL""",
)
def relocation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["text", "lang", "source"])
    said = F.col("text")
    place = F.when(F.col("source") == "src3", "Old Bombay").otherwise(F.col("lang"))
    return (
        docs.select("source", identity.eligibility(said, F.array(place)).alias("eligibility"))
        .groupBy("eligibility", "source")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "identity_fidelity",
    r"""WITH n AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS norm FROM documents),
      l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS ls FROM documents),
      s AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: regexp_replace(x, '^[\s\-–—•▪◦●○■□►▸·*‣⁃]+', '')), lambda x: x <> '') AS bullets,
                   list_sum(list_transform(ls, lambda x: length(x))) AS free FROM l)
      SELECT s.doc_id, len(bullets) AS bullets_total, len(list_filter(bullets, lambda b: NOT contains(norm, b))) AS bullets_missing,
             CASE WHEN free = 0 THEN 0.0 ELSE floor(least(1.0, list_sum(list_transform(bullets, lambda b: length(b))) / CAST(free AS DOUBLE)) * 1000 + 0.5) / 1000 END AS coverage
      FROM s JOIN n USING (doc_id)""",
)
def identity_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fidelity of the extract that copies every line of its document as a bullet."""
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["text"])
    none = F.array().cast("array<string>")
    role = F.struct(
        *[F.lit("").alias(n) for n in ("title", "company_raw", "start_raw", "end_raw")], F.split("text", "\n").alias("bullets")
    )
    extracts = docs.withColumns(
        {
            "identity": F.struct(F.lit(None).cast("string").alias("name"), *[none.alias(n) for n in ("emails", "phones", "urls")]),
            "roles": F.array(role),
            "summary_raw": F.lit(None).cast("string"),
            "skills_raw": none,
        }
    )
    out = fidelity.check_fidelity(extracts)
    result = out.select("doc_id", "fidelity.bullets_total", "fidelity.bullets_missing", "fidelity.coverage")
    return long_counts(result, "bullets_total", "bullets_missing")


@query(
    "sentence_split",
    r"""WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?])\s+([A-Z\d"''(])', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g') AS t FROM documents),
      s AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM m)
      SELECT doc_id, len(ss) AS n_sentences, sha256(array_to_string(ss, '|')) AS sentences_hash FROM s""",
)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["text"])
    split = docs.select("doc_id", tx.sentences(F.col("text")).alias("ss"))
    result = split.select("doc_id", F.size("ss").alias("n_sentences"), F.sha2(F.array_join("ss", "|"), 256).alias("sentences_hash"))
    return long_counts(result, "n_sentences")


@query(
    "section_index",
    r"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
      n AS (SELECT doc_id, list_transform(ls, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS ls FROM l)
      SELECT doc_id, sha256(ls[1]) AS summary_hash, len(ls) - 1 AS n_bullets, sha256(array_to_string(ls[2:], '|')) AS bullets_hash,
             CASE WHEN len(ls) > 1 THEN 'b' || (len(ls) - 1) END AS last_bullet FROM n""",
)
def section_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a profile: its first line the summary, the others the bullets of a role."""
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["text"])
    lines = F.split("text", "\n")
    bullets = F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda line: F.concat(F.lit("- "), line))
    head = F.array(F.lit("[SUMMARY]"), F.get(lines, F.lit(0)), F.lit("[ROLE 1 · most recent]"))
    profiles = docs.select("doc_id", F.array_join(F.concat(head, bullets), "\n").alias("profile_text"))
    index = evidence.index_profiles(profiles)
    result = index.select(
        "doc_id",
        F.sha2(F.get(F.filter("sections", lambda s: s["name"] == "SUMMARY"), F.lit(0))["norm"], 256).alias("summary_hash"),
        F.size("bullets").alias("n_bullets"),
        F.sha2(F.array_join(F.transform("bullets", lambda b: b["norm"]), "|"), 256).alias("bullets_hash"),
        F.get("bullets", F.size("bullets") - 1)["id"].alias("last_bullet"),
    )
    return long_counts(result, "n_bullets")


@query("leak_audit", redaction_sql.leak_audit(f"SELECT source, {_TOLD_SQL} AS text FROM documents"))
def leak_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents, taken as they are, would leak what: every category over every whole text."""
    docs = text_table(spark, sf_dir, "documents", "doc_id", ["text", "source"]).withColumn("text", told(F.col("text")))
    none = F.array().cast("array<string>")
    own = F.struct(
        F.array("source").alias("names"), *[none.alias(n) for n in ("emails", "phones", "urls", "locations", "institutions", "companies")]
    )
    leaks = docs.select("source", F.explode(leak.leak_categories(F.col("text"), own)).alias("category"))
    return leaks.groupBy("source", "category").agg(F.count(F.lit(1)).alias("n_documents"))
