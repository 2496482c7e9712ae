"""Toxicity, the language model, mixing and the codec on small tables."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from sieveline.llm import class_lm, mixing, sentencepiece_codec, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row string, ids string, score double"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "r", "k", 0.5) for i, t, s in rows], DOCS)


# ---- toxicity ----


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    plain = [f"word{k}" for k in range(200)]
    rows, labels = [], []
    for i in range(700):
        text = [rng.choice(plain) for _ in range(rng.randrange(5, 80))]
        bad = i % 5 == 1
        if bad:
            for w in rng.sample(["glorfish", "zumpf", "krattle"], 2):
                text.insert(rng.randrange(len(text)), w + rng.choice(["", "s", "!"]))
        elif i % 7 == 0:
            text += ["krattle", "snake"]
        rows.append((i, " ".join(text), "s"))
        labels.append((i, 1, int(bad)))
    return docs_of(spark, rows), spark.createDataFrame(labels + [(None, 1, 1), (5_000, 0, 1)], "doc_id long, quality int, toxic int")


def test_held_out_texts_are_told_apart(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    assert {t for t in model.lexicon.weights if toxicity.fold("glorfish zumpf krattle").find(" " + t) >= 0}
    found = toxicity.scored(docs, model).join(labels, F.col("_id") == F.col("doc_id")).filter(F.crc32(F.col("_id").cast("string")) % 5 == 0).collect()
    assert len(found) > 100 and sum(r.predicted == r.toxic for r in found) >= 0.97 * len(found)


def test_labels_of_held_out_rows_are_never_read(labelled):
    docs, labels = labelled
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    flipped = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels).lexicon.weights == toxicity.fit(docs, flipped).lexicon.weights


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({toxicity.fold("idiot").strip(): 3.0, toxicity.fold("clown").strip(): 2.0}, ("clown fish",))
    weight = lambda text: sum(w for *_, w in lexicon.hits(toxicity.fold(text)))
    assert weight("an IDIOT") == weight("1d10t") == weight("ïdіоt") == weight("i​diots!") == 3
    assert weight("c1own, CLOWN") == 4 and weight("idiotic clown") == 5
    assert weight("a clown fish swims") == 0 and weight("a clown fishes") == 2
    assert weight("") == weight("nothing here") == weight("ridiot") == 0


def test_toxic_texts_go_and_odd_rows_stay(spark, labelled):
    docs, labels = labelled
    odd = docs_of(spark, [(None, None, None), (9_001, "", "s"), (9_001, "", "s"), (9_002, " \n", "s"), (9_003, "word1 " * 50_000, "s"), (9_004, "zumpf glorfish", "s")])
    kept = toxicity.without_toxic(docs.unionByName(odd), labels)
    assert kept.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids[None] == ids[9_002] == ids[9_003] == 1 and ids[9_001] == 2 and 9_004 not in ids
    scores = {r["_id"]: r.score for r in toxicity.scored(odd, toxicity.fit(docs, labels)).collect()}
    assert all(0 <= s <= 1 for s in scores.values()) and scores[9_004] > 0.5 > scores[9_001]


def test_no_labels_and_no_rows(spark, labelled):
    docs, labels = labelled
    nothing = labels.filter("false")
    assert toxicity.without_toxic(docs, nothing).count() == docs.count()
    assert toxicity.without_toxic(docs.filter("false"), labels).count() == 0
    assert toxicity.scored(docs.filter("false"), toxicity.fit(docs, nothing)).count() == 0


# ---- language model ----


def test_terms_and_phrases_have_no_cap(spark):
    from sieveline.llm.toxicity import Lexicon, candidate_terms, harmless_phrases

    def word(k):
        return "".join(chr(97 + k // 22**i % 22) for i in range(4))[::-1].translate(str.maketrans("lij", "wxz")) + "q"

    terms = [word(k) for k in range(3_400)]
    rows = [(" ".join(terms[j] for j in range(k % 4, 3_400, 4)), 1) for k in range(60)] + [("calm text", 0)] * 60
    frame = spark.createDataFrame(rows, "_text string, _toxic int")
    assert set(terms) <= {r.term for r in candidate_terms(frame, 3)} and len(set(terms)) == 3_400
    clean = [(" ".join(f"badterm {w} x" for w in terms[:1_200]), 0)] * 5 + [(f"badterm {terms[0]}", 1)] * 2
    found = harmless_phrases(spark.createDataFrame(clean, "_text string, _toxic int"), Lexicon({"badterm": 1.0}))
    assert {f"badterm {w}" for w in terms[1:1_200]} <= set(found) and f"badterm {terms[0]}" not in found


def test_phrases_cover_hits_as_by_brute_force():
    rng = random.Random(8)
    parts = ["foul", "foul play", "play", "play fair", "fair", "fair foul play", "ab"]
    for _ in range(200):
        lexicon = toxicity.Lexicon({t: 1.0 for t in rng.sample(["foui", "piay", "fair", "fa"], 3)}, tuple(rng.sample([p for p in parts if " " in p], 2)))
        folded = toxicity.fold(" ".join(rng.choices(parts, k=9)))
        spans = [(m.end(), m.end() + len(p) + 1) for p in (toxicity.fold(p).strip() for p in lexicon.phrases) for m in re.finditer(f" (?={re.escape(p)} )", folded)]
        hits = [(m.end(), m.end() + len(t)) for t in lexicon.weights for m in re.finditer(f" (?={t})", folded)]
        wanted = sorted(h for h in hits if not any(a <= h[0] and h[1] <= b for a, b in spans))
        assert sorted((a, b) for a, b, _ in lexicon.hits(folded)) == wanted


def test_scores_add_up_and_base_is_as_stated(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("The cat, sat; on. a MAT 42 é%d".split()) for _ in range(rng.randrange(0, 40))), "s") for i in range(120)]
    rows += [(None, "cat cat", "s"), (500, None, "s"), (501, "", "s"), (502, "neverseen neverseen", "s"), (502, "neverseen neverseen", "s"), (503, "cat " * 30_000, "s")]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    tokens = [(i, [*brute.words(t), None]) for i, t, _ in rows]
    counts = collections.Counter(w for i, ws in tokens if not held[i] for w in ws)
    total, types = sum(counts.values()), len(counts)
    found = class_lm.scored(docs_of(spark, rows)).collect()
    assert len(found) == len(rows)
    wanted = sorted((i if i is not None else -1, held[i], len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((r["_id"] if r["_id"] is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == wanted
    assert all(r.score < 0 for r in found)


def test_probabilities_add_up_to_one(spark):
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(30)] + ["end.", "5", "x,"]
    texts = spark.createDataFrame([(" ".join(rng.choices(vocabulary, k=30)),) for _ in range(60)], "t string")
    counts = class_lm.word_counts(texts)
    model = class_lm.train(texts, counts)
    assert np.allclose((10**model.steps).sum(axis=1), 1)
    import pyarrow as pa

    from sieveline.llm import words as W

    raw, offsets = W.buffers(pa.array([" ".join(vocabulary)]))
    h, first, last, length = W.shaped_words(raw, offsets)
    n = {r.h: r.n for r in counts.collect()}
    unit = class_lm.units(h, class_lm.shapes(last, length), model.clustered)
    by_class = collections.defaultdict(float)
    for x, u in zip(h, unit):
        by_class[model.own[u]] += (n[int(x.view(np.int64))] + 1) / 10 ** model.sizes[u]
    assert by_class and all(abs(p - 1) < 1e-9 for p in by_class.values())


def test_exchange_finds_word_classes_and_never_loses(spark):
    rng = np.random.default_rng(0)
    pairs = np.zeros((13, 13), dtype=np.int64)  # words 0-5 are always followed by words 6-11
    pairs[:6, 6:12] = rng.integers(5, 9, (6, 6))
    pairs[6:12, :6] = rng.integers(5, 9, (6, 6))
    own = class_lm.exchange(pairs, 12, classes=2)
    assert len(set(own[:6])) == len(set(own[6:12])) == 1 and own[0] != own[6] and own[12] == 2

    def likelihood(own):
        member = np.eye(own.max() + 1)[own]
        joint = member.T @ pairs2 @ member
        return class_lm._xlogx(joint).sum() - class_lm._xlogx(joint.sum(0)).sum() - class_lm._xlogx(joint.sum(1)).sum()

    pairs2 = rng.poisson(0.7, (40, 40)) * rng.integers(1, 9, (40, 40))
    before = likelihood(np.concatenate([np.minimum(np.arange(36), 4), 5 + np.arange(4)]))
    own = class_lm.exchange(pairs2, 36, classes=5, passes=200)
    after = likelihood(own)
    assert after > before
    # Where it stops, no single move of a clustered word is better.
    for w in range(36):
        for k in range(5):
            assert likelihood(np.where(np.arange(40) == w, k, own)) <= after + 1e-6


def test_contexts_are_those_of_the_texts(spark):
    rng = random.Random(11)
    texts = [" ".join(rng.choices("a b c d e, 5 f".split(), k=rng.randrange(0, 9))) for _ in range(50)] + [None, "a " * 900]
    import pyarrow as pa

    from sieveline.llm import words as W

    def hashed(t):
        return W.shaped_words(*W.buffers(pa.array([t], pa.string())))

    clustered = np.sort(hashed("a b c")[0])
    own = np.array([0, 1, 0, *range(2, 3 + class_lm.SHAPES)])
    total = int(own[-1]) + 1
    wanted = collections.Counter()
    for t in texts:
        h, _, last, length = hashed(t)
        row = [len(own) - 1, *class_lm.units(h, class_lm.shapes(last, length), clustered), len(own) - 1]
        for p, q in zip(row, row[1:]):
            wanted[3 + own[p], total + own[q]] += 1
            if q < 3:
                wanted[q, own[p]] += 1
            if p < 3:
                wanted[p, total + own[q]] += 1
    found = class_lm.contexts(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3), clustered, own)
    assert {(r.w, c.c): c.n for r in found.collect() for c in r.cells} == wanted
    joint = class_lm.joint_of(found, 3, total)
    assert all(joint[w - 3, c - total] == n for (w, c), n in wanted.items() if w >= 3)
    assert joint.sum() == sum(n for (w, _), n in wanted.items() if w >= 3)


def test_words_beyond_the_seeds_join_the_class_of_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(class_lm, "SEEDS", 8)
    rng = random.Random(5)
    a, b = ([f"{x}{k}{x}" for k in range(60)] for x in "ab")  # all of one shape
    weights = [30] * 4 + [1] * 56
    texts = [(" ".join(w for _ in range(20) for w in (rng.choices(a, weights)[0], rng.choices(b, weights)[0])),) for _ in range(400)]
    frame = spark.createDataFrame(texts, "t string")
    model = class_lm.train(frame, class_lm.word_counts(frame))
    assert len(model.clustered) == 120
    by_word = {}
    import pyarrow as pa

    from sieveline.llm import words as W

    for w in a + b:
        h, _, last, length = W.shaped_words(*W.buffers(pa.array([w])))
        by_word[w] = int(model.own[class_lm.units(h, class_lm.shapes(last, length), model.clustered)[0]])
    assert not {by_word[w] for w in a} & {by_word[w] for w in b}


def test_the_model_beats_word_frequency_where_order_matters(spark):
    rng = random.Random(3)
    a, b = [f"a{k}" for k in range(20)], [f"b{k}" for k in range(20)]
    rows = [(i, " ".join(x for _ in range(20) for x in (rng.choice(a), rng.choice(b))), "s") for i in range(200)]
    found = class_lm.scored(docs_of(spark, rows)).filter("held_out").collect()
    assert found and sum(r.score for r in found) > 0.9 * sum(r.base_score for r in found)


def test_nothing_to_learn_from(spark):
    assert class_lm.scored(docs_of(spark, [])).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = class_lm.scored(docs_of(spark, [(held, "a b", "s")])).collect()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and r.score <= 0


# ---- mixing ----


def fill(sizes, share=1.5):
    """Targets by repeated sharing, sources by code point and null last."""
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), itertools.cycle((5, 2, 1))))
    full, total = set(), sum(sizes.values())
    while True:
        rest = share * total - sum(2 * sizes[s] for s in full)
        level = rest / (sum(w for s, w in weights.items() if s not in full) or 1)
        over = {s for s in sizes if s not in full and weights[s] * level > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else weights[s] * level for s in sizes}
        full |= over


def test_mix_meets_its_targets(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" * (k % 3 + 1) for k in range(rng.choice((1, 2, 7, 7, 7, 40, 300)))), rng.choice(["é", "a", "b", "Z", "", None, "a" * 12 + "x", "a" * 12 + "y"])) for i in range(600)]
    rows += [(900, None, "a"), (901, "", None), (902, "one", "one"), (None, "two words", "b"), (950, "again again", "b"), (950, "again again", "b"), (903, "long " * 2_000, "Z")]
    docs = docs_of(spark, rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(brute.WORD.findall(t or ""))
    wanted = fill(dict(sizes))
    first, again = (sorted(map(tuple, mixing.mixed(d).drop("_hash").collect()), key=str) for d in (docs, docs.repartition(7)))
    assert first == again and len(first) == len(rows)
    taken = collections.Counter()
    by_id = {i: s for i, _, s in rows}
    for i, size, source_size, target, copies, words in first:
        assert source_size == sizes[by_id[i]] and math.isclose(target, wanted[by_id[i]], rel_tol=1e-12) and words == copies * size <= 2 * size
        taken[by_id[i]] += words
    for s, target in wanted.items():
        assert abs(taken[s] - target) <= 1, (s, taken[s], target)


def test_mixed_rows_themselves(spark):
    docs = docs_of(spark, [(i, "w " * (i % 5), "ab"[i % 2]) for i in range(60)] + [(3, "w w w ", "b")] * 2)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    wanted = mixing.mixed(docs).agg(F.sum("taken"), F.sum("copies")).first()
    got = mixed.agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))), F.count(F.lit(1))).first()
    assert tuple(got) == tuple(wanted)
    assert mixing.mix(docs.filter("false")).count() == mixing.mixed(docs.filter("false")).count() == 0


def test_knapsack_is_exact_or_next_below():
    rng = random.Random(2)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(1, 30), 5)))
        counts = np.array([rng.randrange(0, 4) for _ in lengths])
        budget = rng.randrange(0, 120)
        take = mixing.knapsack(lengths, counts, budget)
        best = max(s for c in itertools.product(*(range(n + 1) for n in counts)) if (s := int(np.dot(c, lengths))) <= budget)
        assert (take >= 0).all() and (take <= counts).all() and int(take @ lengths) == best


# ---- codec ----


def test_ids_are_those_of_the_library(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    rng = random.Random(1)
    texts = ["", None, " ", "  lead", "a ", "Hello  world\n\tx", "▁a ▁", "　z\xa0y", "😀 日本語", "x" * 3_000, " " * 70 + "b", "<s> <0x41> </s>", "ab" * 400, "the quick brown fox " * 4_000]
    texts += ["".join(rng.choice("aethrnio  ▁s\nbe12.éü日😀") for _ in range(rng.randrange(1, 90))) for _ in range(400)]
    rows = sentencepiece_codec.coded(docs_of(spark, [(k, t, None) for k, t in enumerate(texts)])).collect()
    for r in rows:
        assert r.ids == model.encode(texts[r["_id"]] or "") and r.n_ids == len(r.ids) and r.round_trip
    back = sentencepiece_codec.decoded(sentencepiece_codec.encoded(docs_of(spark, [(k, t, None) for k, t in enumerate(texts)])))
    for r in back.collect():
        assert r.decoded == model.decode(r.ids) and r._row == "r"


def test_the_stream_commits_early_and_holds_a_window():
    v = sentencepiece_codec.Vocabulary.read()
    stream, ids, most = sentencepiece_codec.Stream(v), [], 0
    for _ in range(600):
        ids += stream.feed("thinking▁about▁")
        most = max(most, len(stream.text))
    ids += stream.close()
    import sentencepiece

    assert most <= 4 * v.longest
    text = "thinking about " * 600
    # The library puts a space in front and has no ending mark of its own.
    assert [*sentencepiece_codec.Stream(v).feed("▁"), *ids] and b"".join(v.surfaces[i] for i in ids).decode() == text
    whole = sentencepiece_codec.Stream(v)
    assert [*whole.feed("▁" + text.replace(" ", "▁")), *whole.close()] == sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL).encode(text)


def test_what_a_task_remembers_goes_with_it():
    v = sentencepiece_codec.Vocabulary.read()
    one, two = sentencepiece_codec.Encoder(v), sentencepiece_codec.Encoder(v)
    assert one.encode("thinking about it") and one.v._pairs and not v._pairs and not two.v._pairs
    assert one.v.automaton is two.v.automaton is v.automaton


def test_codec_of_nothing(spark):
    empty = docs_of(spark, [])
    assert sentencepiece_codec.coded(empty).count() == 0
    assert sentencepiece_codec.decoded(sentencepiece_codec.encoded(empty)).count() == 0
    assert sentencepiece_codec.encoded(docs_of(spark, [(1, "a", None)])).columns[-1] == "ids"
