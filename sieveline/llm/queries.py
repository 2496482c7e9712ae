"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.llm import (
    class_lm,
    embedding_dedup,
    fingerprints,
    html_text,
    minhash_dedup,
    mixing,
    prefix_trie,
    sentencepiece_codec,
    structure_repair,
    surrogates,
    toxicity,
    warc,
    window_dedup,
)
from sieveline.llm.binding import query, table
from sieveline.session import materialise

OP9_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                   '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), runs AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                      ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM words
), sets AS (SELECT min(doc_id) AS d, list_sort(s) AS s, len(s) AS n FROM runs WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
items AS (SELECT d, n, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.d AS u, b.d AS v FROM items a JOIN items b ON a.x = b.x AND a.d <> b.d AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.d, b.d, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT d, d AS r FROM sets UNION SELECT p.u, reach.r FROM reach JOIN pairs p ON p.v = reach.d
), comp AS (SELECT d, min(r) AS c FROM reach GROUP BY d)
SELECT r.doc_id, len(r.s) AS n_shingles, coalesce(c.c, r.doc_id) AS component_id, r.doc_id = coalesce(c.c, r.doc_id) AS kept
FROM runs r LEFT JOIN sets s ON list_sort(r.s) = s.s LEFT JOIN comp c ON c.d = s.d
"""


@query("op9_minhash_near_dedup", OP9_SQL)
def op9(spark, sf_dir):
    """Groups of documents whose sets of word pairs are alike to 80 %."""
    found = minhash_dedup.groups_of_copies(table(spark, sf_dir, "documents"), words=2, percent=80)
    return found.select(F.col("_id").alias("doc_id"), "n_shingles", "component_id", "kept")

OP1_SQL = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach AS (
  SELECT vec_id AS d, vec_id AS r FROM embeddings UNION SELECT l.u, reach.r FROM reach JOIN links l ON l.w = reach.d
), comp AS (SELECT d, min(r) AS c FROM reach GROUP BY d), n AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e JOIN comp c ON c.d = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""


@query("op1_embedding_near_dedup", OP1_SQL)
def op1(spark, sf_dir):
    """Vectors of one label with a cosine of 0.93 and more."""
    found = embedding_dedup.linked_vectors(table(spark, sf_dir, "embeddings"), cosine=0.93)
    return found.select(F.col("_id").alias("vec_id"), "n_links", "component_id", "kept")


@query("op4_simhash_fingerprints")
def op4(spark, sf_dir):
    """Fingerprints of documents and of their edited forms; n_near counts the other documents' within 10 bits."""
    marked = materialise(fingerprints.edited_fingerprints(table(spark, sf_dir, "documents")))
    near = fingerprints.within_radius(marked, radius=10).select(F.col("mark").alias("fingerprint"), "n_near")
    return marked.join(near, "fingerprint").select(
        F.col("_id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_near"
    )


@query("op2_toxicity")
def op2(spark, sf_dir):
    """Toxicity of documents, learned from the labels of four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("_id").cast("string")) % 5 == 0, F.lit(False))
    return found.select(F.col("_id").alias("doc_id"), held.alias("held_out"), "score", "predicted")


@query("op3_source_mixing")
def op3(spark, sf_dir):
    """Words of each document that the mix takes."""
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    return found.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", "copies", "taken")

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS head FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to
FROM m
"""


@query("op6_warc", OP6_SQL)
def op6(spark, sf_dir):
    """Pages written to WARC archives and read back."""
    records = warc.record_table(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    back = warc.read_archives(warc.write_archives(records, warc.shared_folder(spark)), payloads=False)
    number = lambda name: F.regexp_extract(name, r":(-?\d+)>", 1).try_cast("long")
    return back.filter("last").select(
        number("record_id").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to")
    )


@query("op7_html_main_text")
def op7(spark, sf_dir):
    """The main text of pages."""
    found = html_text.main_texts(table(spark, sf_dir, "pages"))
    return found.select(F.col("_id").alias("page_id"), F.col("_url").alias("url"), "text", "n_chars")


@query("op8_class_lm")
def op8(spark, sf_dir):
    """Documents scored by the class-based model and by word frequency."""
    return class_lm.scored(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


@query("op10_pii_surrogates")
def op10(spark, sf_dir):
    """Documents with personal data and secrets replaced by surrogates."""
    return surrogates.with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_sentencepiece")
def op5(spark, sf_dir):
    """Ids of every document, and whether they decode to its text."""
    return sentencepiece_codec.coded(table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")

OP12_SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM words WHERE len(w) >= 20),
windows AS (SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS x FROM starts),
firsts AS (SELECT x, min({'d': doc_id, 's': s}) AS f FROM windows GROUP BY x HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT w.doc_id, unnest(range(w.s, w.s + 20)) AS p FROM windows w JOIN firsts f ON w.x = f.x WHERE {'d': w.doc_id, 's': w.s} <> f.f
  )
), spots AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ')
              ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' ') END) AS kept_sha256
FROM words LEFT JOIN spots ON words.doc_id = spots.doc_id
"""


@query("op12_repeated_windows", OP12_SQL)
def op12(spark, sf_dir):
    """Documents without the words that windows of 20 words repeat from earlier ones."""
    found = window_dedup.without_repeats(table(spark, sf_dir, "documents"), size=20, with_text=False)
    return found.select(F.col("_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")

#: CRC-32 of the characters (ASCII) of {0}: each is added, then eight bits are shifted out.
CRC32_SQL = """xor(4294967295::BIGINT, list_reduce(
  list_concat([4294967295::BIGINT], flatten(list_transform(string_split({0}, ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END))"""


def _edited(state: str, cost: str, letter: str, line: str | None = None) -> str:
    lines = f"list_append({state}.r, {line})" if line else f"{state}.r"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {lines}}}"


_FREE, _KEPT = "CASE WHEN f IN ('b', 'd') THEN 99999999 WHEN f = 't' THEN 3 ELSE 0 END", "CASE WHEN f IN ('b', 'd') OR i <> '{0}' THEN 99999999 WHEN f = 't' THEN 3 ELSE 0 END"
_TO_USER = ", ".join(_edited(q, f"3 + {_FREE}", "R", "'user:' || text") + ", " + _edited(q, _KEPT.format("u"), "K", "role || ':' || text") for q in ("n", "s", "a1"))
OP13_SQL = f"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), kinds AS (SELECT k, {CRC32_SQL.format("k")} % 20 AS d FROM (SELECT DISTINCT k FROM base)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS c
  FROM base JOIN kinds ON base.k = kinds.k WHERE d <> 0
), placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS p FROM damaged),
faults AS (
  SELECT conv_id, turn, role, text, p, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) AS b,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS f
  FROM placed
), convs AS (SELECT DISTINCT conv_id FROM conversations),
dp AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS p, {{'c': 0, 'a': '', 'r': CAST([] AS VARCHAR[])}} AS n, {{'c': 99999999, 'a': '', 'r': CAST([] AS VARCHAR[])}} AS s,
         {{'c': 99999999, 'a': '', 'r': CAST([] AS VARCHAR[])}} AS u, {{'c': 99999999, 'a': '', 'r': CAST([] AS VARCHAR[])}} AS a
  FROM convs
  UNION ALL
  SELECT conv_id, p, {_edited("n", "4", "D")},
         list_min([{_edited("s", "4", "D")}, {_edited("n", _KEPT.format("s"), "K", "role || ':' || text")}]),
         list_min([{_edited("u1", "4", "D")}, {_TO_USER}]),
         list_min([{_edited("a1", "4", "D")}, {_edited("u1", f"3 + {_FREE}", "R", "'assistant:' || text")}, {_edited("u1", _KEPT.format("a"), "K", "role || ':' || text")}])
  FROM (
    SELECT *, list_min([a, {_edited("u1", "3", "I", "'assistant:'")}]) AS a1
    FROM (
      SELECT dp.conv_id, faults.p, n, s, a, role, text, i, f,
             list_min([u, {", ".join(_edited(q, "3", "I", "'user:'") for q in ("n", "s", "a"))}]) AS u1
      FROM dp JOIN faults ON dp.conv_id IS NOT DISTINCT FROM faults.conv_id AND faults.p = dp.p + 1
    )
  )
), ends AS (
  SELECT conv_id, arg_max(list_min([n, a, {_edited("u", "3", "I", "'assistant:'")}, {_edited("s", "6", "II", "'user:'").replace("list_append(s.r, 'user:')", "list_concat(s.r, ['user:', 'assistant:'])")}]), p) AS e
  FROM dp GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
         count(*) FILTER (f = 't') AS truncated, count(*) FILTER (b IS NOT NULL AND b || i NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT ends.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, CAST(e.c AS BIGINT) AS cost, e.a AS audit, sha256(array_to_string(e.r, chr(10))) AS repaired_sha256
FROM ends LEFT JOIN counts ON ends.conv_id IS NOT DISTINCT FROM counts.conv_id
"""


@query("op13_structure_repair", OP13_SQL)
def op13(spark, sf_dir):
    """Conversations with planted damage, mended by the cheapest edits."""
    rows = table(spark, sf_dir, "conversations")
    hurt = structure_repair.damaged(rows, "conv_id", "turn", "role", "text")
    return structure_repair.repaired(hurt, "conv", everyone=rows.select(F.col("conv_id").alias("conv"))).withColumnRenamed("_conv", "conv_id")


OP11_SQL = f"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), lists AS (SELECT c, list({{'x': sha256(length(role) || ':' || role || text), 'n': length(text)}} ORDER BY p) AS w FROM own GROUP BY c),
heads AS (SELECT c, w, CAST({CRC32_SQL.format("CAST(c AS VARCHAR)")} % 6 AS BIGINT) AS h FROM lists),
rebuilt AS (
  SELECT heads.c, list_concat(CASE WHEN lists.c IS NULL OR h = 0 THEN [] ELSE lists.w[1:h] END, heads.w[h + 1:]) AS w
  FROM heads LEFT JOIN lists ON lists.c = heads.c - heads.c % 100
), steps AS (SELECT c, w, len(w) AS l, unnest(range(0, len(w) + 1)) AS d FROM rebuilt),
paths AS (SELECT c, d, l, CASE WHEN d > 0 THEN w[d].n ELSE 0 END AS n, d || ':' || sha256(array_to_string(list_transform(w[1:d], lambda t: t.x), ',')) AS k,
                 CASE WHEN d > 0 THEN (d - 1) || ':' || sha256(array_to_string(list_transform(w[1:d - 1], lambda t: t.x), ',')) END AS up FROM steps),
nodes AS (
  SELECT k, any_value(d) AS d, any_value(up) AS up, any_value(n) AS n, min(c) AS c, count(*) AS members, max(l) AS deepest,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (l = d), '') AS ends
  FROM paths GROUP BY k
), sums AS (
  SELECT paths.k, sum(CASE WHEN deepest = nodes.d THEN 1 ELSE 0 END) AS leaves, sum((members - 1) * nodes.n) AS saved
  FROM nodes JOIN paths ON paths.c = nodes.c AND paths.d <= nodes.d GROUP BY paths.k
), kids AS (SELECT up, count(*) AS kids FROM nodes GROUP BY up)
SELECT nodes.c AS conv_id, nodes.d AS depth, above.c AS parent_conv_id, nodes.members AS n_convs, coalesce(kids, 0) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(nodes.ends) AS ends_sha256
FROM nodes JOIN sums ON sums.k = nodes.k LEFT JOIN nodes above ON above.k = nodes.up LEFT JOIN kids ON kids.up = nodes.k
"""


@query("op11_prefix_trie", OP11_SQL)
def op11(spark, sf_dir):
    """The trie of conversations that share their first turns."""
    placed = prefix_trie.turns(table(spark, sf_dir, "conversations"))
    return prefix_trie.nodes(*prefix_trie.with_shared_heads(placed))
