"""Near-duplicate texts, vectors and fingerprints against brute force."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from sieveline.llm import embedding_dedup, fingerprints, minhash_dedup, queries, words
from sieveline.llm.blocks import forest
from sieveline.llm.components import components

DOCS = "doc_id long, text string, _id string, _text string, component string, key int, kept string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", 1, None) for i, t in rows], DOCS)


def varied(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10_000)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice((3, 12, 60, 200)))]
        for _ in range(rng.choice((1, 2, 9))):
            rows.append((len(rows) + 100, varied(rng, base, rng.choice((0, 1, 3, 6)))))
    rows += [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one\x0btwo "), (8, "é two"), (9, "É two"), (None, "one"), (None, None)]
    rows += [(50, "a b c d e f g"), (50, "a b c d e f g"), (51, "a b c d e f g")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("n", [2, 5])
def test_copies_as_by_brute_force(spark, copies, n):
    found = minhash_dedup.groups_of_copies(docs_of(spark, copies), words=n, percent=80).collect()
    wanted, sets = brute.copy_groups(copies, n, 80)
    assert len(found) == len(copies)
    assert sorted((r["_id"] or -1, r.n_shingles) for r in found) == sorted((i or -1, len(s)) for i, s in sets)
    for r in found:
        assert r.component_id == wanted.get(r["_id"])
        assert r.kept == (r["_id"] is None or r["_id"] == r.component_id)


def test_a_dense_group_in_small_blocks(spark, monkeypatch):
    """More members than a block holds, chains whose ends aren't alike, and members their head doesn't confirm."""
    monkeypatch.setattr(minhash_dedup, "CAP", 4)
    rng = random.Random(8)
    rows, text = [], [f"v{k}" for k in range(60)]
    for k in range(40):
        rows.append((k, " ".join(text)))
        text[rng.randrange(60)] = f"n{k}"
    found = {r["_id"]: r.component_id for r in minhash_dedup.groups_of_copies(docs_of(spark, rows), words=2, percent=80).collect()}
    wanted, _ = brute.copy_groups(rows, 2, 80)
    assert found == wanted


def test_dropping_copies_keeps_all_columns(spark, copies):
    docs = docs_of(spark, copies)
    kept = minhash_dedup.drop_copies(docs, words=2)
    wanted, _ = brute.copy_groups(copies, 2, 80)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(i or -1 for i, _ in copies if i is None or wanted[i] == i)


def test_empty_tables(spark):
    assert minhash_dedup.groups_of_copies(docs_of(spark, [])).count() == 0
    assert minhash_dedup.drop_copies(docs_of(spark, [])).count() == 0
    assert fingerprints.edited_fingerprints(docs_of(spark, [])).count() == 0
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert embedding_dedup.linked_vectors(empty).count() == 0


def test_words_are_hashed_as_they_are_spelt():
    texts = ["The cat", "the\tCAT", "", "thecat", "longer-than-eight-bytes ünïcode", None, "x" * 5000 + " y"]
    raw, offsets = words.buffers(pa.array(texts))
    h, first = words.word_hashes(raw, offsets)
    spelt = [w for t in texts for w in brute.words(t)]
    assert len(h) == len(spelt) and first.tolist() == np.cumsum([0] + [len(brute.words(t)) for t in texts]).tolist()
    assert len({*zip(h.tolist(), spelt)}) == len(set(spelt)) == len(set(h.tolist()))


def test_least_agreement_is_the_binomial_quantile():
    for n, s in ((32, 0.8), (128, 0.8), (128, 0.5)):
        t = minhash_dedup.least_agreement(n, s)
        below = sum(math.comb(n, k) * s**k * (1 - s) ** (n - k) for k in range(t))
        assert below <= 1e-5 < below + math.comb(n, t) * s**t * (1 - s) ** (n - t)


def test_components_of_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    wanted = brute.smallest_reachable({x for p in links for x in p}, links)
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: c for n, c in wanted.items() if any(n in p and p[0] != p[1] for p in links)}


def test_forest_names_the_smallest():
    assert forest(np.array([3, 1]), np.array([4, 3]), 6).tolist() == [0, 1, 2, 1, 1, 5]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_as_by_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1):
        for _ in range(25):
            base = rng.standard_normal(16)
            for k in range(int(rng.integers(1, 5))):
                rows.append((n, label, [float(np.float32(x)) for x in base + rng.standard_normal(16) * 0.15 * k]))
                n += 1
    twin = rows[0][2]
    rows += [(900, 0, twin), (901, 0, [2 * x for x in twin]), (902, None, twin), (903, 1, twin), (904, 0, None), (905, 0, []), (906, 0, [0.0] * 16),
             (907, 0, [float("nan")] * 16), (908, 0, [float("inf")] + twin[1:]), (909, 0, [None] + twin[1:]), (910, 0, twin[:8])]
    found = {r["_id"]: r for r in embedding_dedup.linked_vectors(spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>")).collect()}
    good = [r for r in rows if r[1] is not None and r[2] and all(x is not None and math.isfinite(x) for x in r[2]) and any(r[2])]
    links = [(a[0], b[0]) for x, a in enumerate(good) for b in good[x + 1 :] if a[1] == b[1] and len(a[2]) == len(b[2]) and brute.cosine(a[2], b[2]) >= 0.93]
    wanted = brute.smallest_reachable({r[0] for r in rows}, links)
    assert len(found) == len(rows) and len(links) > 20
    for i, r in found.items():
        assert (r.n_links, r.component_id, r.kept) == (sum(i in p for p in links), wanted[i], wanted[i] == i)


def test_vectors_without_ids_and_with_one_id_twice(spark):
    rows = [(7, 0, [1.0, 0.0]), (7, 0, [1.0, 0.0]), (None, 0, [1.0, 0.01]), (3, 0, [0.0, 1.0])]
    found = sorted(embedding_dedup.linked_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect(), key=str)
    assert sorted((r["_id"] or -1, r.n_links, r.component_id or -1) for r in found) == [(-1, 2, -1), (3, 0, 3), (7, 2, 7), (7, 2, 7)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_copies_among_vectors_of_several_lengths(spark, kind):
    rng = np.random.default_rng(11)
    rows = []
    for g in range(12):
        base = rng.standard_normal((4, 9, 16)[g % 3])
        rows += [(len(rows) + k, 0, [float(np.float32(x)) for x in base * (1 + k % 2) + rng.standard_normal(len(base)) * 0.01 * k]) for k in range(3)]
    frame = spark.createDataFrame(rows, f"vec_id long, label int, embedding array<{kind}>").coalesce(1)
    found = {r["_id"]: r for r in embedding_dedup.linked_vectors(frame).collect()}
    links = [(a[0], b[0]) for x, a in enumerate(rows) for b in rows[x + 1 :] if len(a[2]) == len(b[2]) and brute.cosine(a[2], b[2]) >= 0.93]
    wanted = brute.smallest_reachable({r[0] for r in rows}, links)
    assert len(found) == len(rows) and len(links) >= 36
    for i, r in found.items():
        assert (r.n_links, r.component_id) == (sum(i in p for p in links), wanted[i])


def test_a_big_bucket_is_counted_once_over_all_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal(8)
    rows = [(k, 0, (base + rng.standard_normal(8) * 0.05).tolist()) for k in range(90)]
    monkeypatch.setattr(embedding_dedup, "in_blocks", lambda rows, keys, member: __import__("sieveline.llm.blocks", fromlist=["x"]).in_blocks(rows, keys, member, cap=16))
    found = embedding_dedup.linked_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()
    for r in found:
        assert r.n_links == sum(brute.cosine(rows[r["_id"]][2], x[2]) >= 0.93 for x in rows) - 1 and r.component_id == 0


def test_edited_texts(spark):
    rng = random.Random(2)
    texts = ["", "abc", "é" * 9, None, "one two three four", "x" * 70_000] + [" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, 300))) for _ in range(120)]
    ids = rng.sample(range(-1000, 1000), len(texts))
    found = {r["_id"]: r for r in fingerprints.edited_fingerprints(docs_of(spark, list(zip(ids, texts)))).collect()}
    order = sorted(zip(ids, [t or "" for t in texts]))
    marks = {}
    for k, (i, text) in enumerate(order):
        after, cut = order[(k + 1) % len(order)][1], len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        r = found[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert marks.setdefault(text, r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if edited == text:
            assert r.near_edited == 1 and r.edited_fingerprint == r.fingerprint
    assert len(found) == len(texts)
    far = [found[i] for i, t in order if len(brute.words(t)) > 100]
    assert sum(r.near_edited > r.near_next for r in far) >= 0.95 * len(far)


def test_one_text_follows_itself_and_repeated_ids_follow_each_other(spark):
    (r,) = fingerprints.edited_fingerprints(docs_of(spark, [(1, "abcdefgh")])).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprints.edited_fingerprints(docs_of(spark, [(1, "a b"), (1, "a b"), (None, "c"), (None, None)])).count() == 4


def test_all_fingerprints_within_the_radius(spark):
    rng = random.Random(6)
    values = []
    for _ in range(30):
        base = rng.getrandbits(128)
        values += [base, base]
        for _ in range(3):
            flipped = base
            for bit in rng.sample(range(128), rng.randrange(0, 6)):
                flipped ^= 1 << bit
            values.append(flipped)
    marks = [f"{v:032x}" for v in values]
    frame = spark.createDataFrame([(m, "n", 1) for m in marks] + [(None, "n", 1)], "fingerprint string, mark string, n int")
    for radius in (0, 3, 4):
        found = {r.mark: (r.n, r.n_near) for r in fingerprints.within_radius(frame, radius=radius).collect()}
        assert found == {m: (marks.count(m), sum((values[marks.index(m)] ^ v).bit_count() <= radius for v in values) - 1) for m in set(marks)}


@pytest.mark.parametrize("lead", [1, 2, 3])
def test_any_number_of_leading_blocks_finds_all(spark, monkeypatch, lead):
    monkeypatch.setattr(fingerprints, "leading_blocks", lambda rows, radius: lead)
    rng = random.Random(7)
    values = []
    for _ in range(20):
        base = rng.getrandbits(128)
        values += [base] + [base ^ sum(1 << bit for bit in rng.sample(range(128), n)) for n in (2, 5, 10, 11)]
    found = {int(r.mark, 16): r.n_near for r in fingerprints.within_radius(spark.createDataFrame([(f"{v:032x}",) for v in values], "fingerprint string"), radius=10).collect()}
    assert found == {v: sum((v ^ w).bit_count() <= 10 for w in values) - 1 for v in values}


def test_the_query_finds_lightly_edited_copies(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for g in range(60):
        base = [f"w{int(rng.paretovariate(0.6))}" for _ in range(500)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, varied(rng, base, 5))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op4(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) and sum(r.n_near >= 1 for r in found) >= 0.9 * len(found)
