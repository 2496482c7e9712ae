"""Toxicity by a weighted lexicon, found with an Aho-Corasick automaton in folded texts.

Folding: lower case, accents dropped, look-alike letters of other scripts and digit substitutions read as the
Latin letters they stand for (i, l, 1, ! and | become one letter), everything else a space.

The lexicon is learned from labelled rows, of which at most ``SAMPLE`` a class are read, one of each set of
copies: word beginnings of 3 to 12 letters that toxic texts have far more often than others. They are taken
greedily, each for the toxic texts that no earlier one explains, so words that merely stand in the same texts
aren't taken. A term weighs its log odds. Exception phrases (a fixed few, and phrases around a term that
labelled clean texts have) void the hits inside them.

The score is a logistic function of the sum of weights and of that sum per word, fitted on counts of binned
training rows. Null and empty texts have no hits and so the lowest score. Ids, languages, sources and labels
are no inputs of a score. Of repeated ids in the labels the higher label counts.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from sieveline.llm import words as W
from sieveline.llm.rows import fields, whole
from sieveline.session import materialise

#: Labelled rows of each class that are read at most.
SAMPLE = 50_000
LENGTHS = range(3, 13)
LEAST_TEXTS = 3
LEAST_ODDS = 2.5
#: Least log likelihood ratio of a term, so that none of a million meets it by chance.
EVIDENCE = 12.0
#: A term that so large a part of toxic texts and so small a part of clean ones have is taken in any case.
MANY_TOXIC, FEW_CLEAN = 0.02, 0.001
BINS = 48

# Phrases in which a lexicon word is harmless.
PHRASES = ("trash can", "trash bin", "clown fish")

# Characters read as another one. i, l and their look-alikes are one letter.
LOOK_ALIKES = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i", "l": "i",
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "н": "h", "і": "i", "ї": "i", "ӏ": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "ѵ": "v", "г": "r", "п": "n", "и": "u", "ı": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ω": "w",
    "ɑ": "a", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o", "ԛ": "q", "ℓ": "i", "ł": "i", "ø": "o", "đ": "d",
}


class _Folds(dict):
    """What each character becomes, worked out when it is first met."""

    def __missing__(self, code: int) -> str:
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code)):
            c = c.lower()
            c = LOOK_ALIKES.get(c, c)
            if unicodedata.combining(c[0]) or c in "​‌‍⁠﻿­":
                continue
            out += c if c.isalnum() else " "
        self[code] = out
        return out


_FOLDS = _Folds()


def fold(text: str) -> str:
    """The folded text between two spaces."""
    return f" {text.translate(_FOLDS)} "


@dataclass
class Lexicon:
    weights: dict[str, float]
    phrases: tuple[str, ...] = ()
    _found: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"weights": self.weights, "phrases": self.phrases, "_found": None}

    def __setstate__(self, state):
        self.__dict__.update(state)

    @property
    def automaton(self):
        if self._found is None:
            found = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                found.add_word(f" {term}", (len(term), weight))
            for phrase in self.phrases:
                found.add_word(f" {fold(phrase).strip()} ", (len(fold(phrase).strip()) + 1, None))
            if len(found):
                found.make_automaton()
            self._found = found
        return self._found

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(begin, end, weight) of each hit that no exception phrase covers."""
        if not len(self.automaton):
            return []
        spans, found = [], []
        for end, (length, weight) in self.automaton.iter(folded):
            (spans if weight is None else found).append((end - length + 1, end + 1, weight))
        if spans:
            # The furthest end of the phrases that begin no later than a hit tells whether one covers it.
            spans.sort()
            begins, ends = [a for a, *_ in spans], list(accumulate((b for _, b, _ in spans), max))
            found = [h for h in found if not (k := bisect_right(begins, h[0])) or ends[k - 1] < h[1]]
        return found


def features(lexicon: Lexicon, text: str) -> tuple[float, float]:
    """The sum of hit weights and that sum per word, both as logarithms."""
    folded = fold(text)
    total = sum(weight for *_, weight in lexicon.hits(folded))
    return math.log1p(total), math.log1p(1000 * total / (1 + folded.count(" "))) if total else 0.0


def texts_of(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    for text in batch.column(batch.schema.get_field_index(name)):
        yield text.as_py() or ""


def beginnings(folded: str) -> set[str]:
    words = set(folded.split())
    return {w[:k] for w in words for k in LENGTHS if len(w) >= k}


def is_training(id_col: Column, folds: int = 5, held: int = 0) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds != held, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Texts (_text, _toxic) of labelled rows that may be learned from, one of each set of copies."""
    asked = (
        labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & is_training(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("_doc"))
        .agg(F.max("toxic").cast("int").alias("_toxic"))
    )
    order = F.xxhash64("_doc", F.lit(3))
    picked = asked.filter("_toxic = 1").orderBy(order).limit(sample).unionByName(asked.filter("_toxic = 0").orderBy(order).limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").alias("_text")).join(F.broadcast(picked), "_doc")

    def keyed(batches):
        for batch in batches:
            raw, offsets = W.buffers(batch.column(0))
            keys = np.zeros(len(offsets) - 1, dtype=np.uint64)
            for a, b in W.slices(offsets):
                h, begin = W.shingle_hashes(*W.word_hashes(raw, offsets[a : b + 1]), 5)
                some = np.flatnonzero(np.diff(begin))
                if len(some):
                    keys[a + some] = np.minimum.reduceat(h, begin[:-1][some])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys.view(np.int64))], names=["_text", "_toxic", "key"])

    # Copies have one smallest run of words with the chance of their likeness.
    marked = materialise(rows.select("_text", "_toxic").mapInArrow(keyed, "_text string, _toxic int, key long"))
    return marked.withColumn("h", F.xxhash64("_text")).groupBy("key", "_toxic").agg(F.min_by("_text", "h").alias("_text")).select("_text", "_toxic")


def candidate_terms(rows: DataFrame, least: int) -> list[Row]:
    """Word beginnings that at least so many toxic texts have and that could be taken, those of most texts first.

    Those left out have too little evidence even while no text is explained: more texts explained never add any.
    """

    def work(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text in texts_of(batch, "_text"):
                seen.update(beginnings(fold(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

    counted = rows.filter("_toxic = 1").select("_text").mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    # Word beginnings that clean texts have about as often are no candidates, whatever their number.
    clean = rows.filter("_toxic = 0").select("_text").mapInArrow(work, "term string, n long").groupBy("term").agg(F.sum("n").alias("m"))
    sizes = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, others = sizes.get(1, 0), sizes.get(0, 0)
    odds = F.log((F.col("n") + 0.5) / (toxic + 1)) - F.log((F.col("m") + 0.5) / (others + 1))
    kept = counted.filter(F.col("n") >= least).join(clean, "term", "left").na.fill(0, ["m"]).withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
    sure = F.col("n") * math.log((toxic + others) / max(toxic, 1)) - 2 * F.col("m") >= EVIDENCE
    telling = (F.col("n") >= MANY_TOXIC * toxic) & (F.col("m") <= FEW_CLEAN * others)
    return kept.filter(sure | telling).orderBy(F.col("n").desc(), F.length("term").desc(), "term").select("term", "n", "m", "odds").collect()


def learn_lexicon(rows: DataFrame, sample: int = SAMPLE) -> Lexicon:
    sizes = {r["_toxic"]: r["n"] for r in rows.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, PHRASES)
    found = candidate_terms(rows, max(LEAST_TEXTS, math.ceil(toxic / 1000)))
    terms = [(r["term"], r["n"], r["m"], r["odds"]) for r in found]
    # Of beginnings of one another with nearly the same texts the longest stands for all.
    support = {t: n for t, n, *_ in terms}
    longer = {t[:-1]: max(n, 0) for t, n, *_ in sorted(terms, key=lambda x: x[1])}
    terms = [x for x in terms if longer.get(x[0], 0) < 0.98 * x[1]]
    index = {t: i for i, (t, *_) in enumerate(terms)}

    def incidence(batches):
        for batch in batches:
            own = [sorted(index[t] for t in beginnings(fold(text)) & index.keys()) for text in texts_of(batch, "_text")]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32()))], names=["own"])

    own = rows.filter("_toxic = 1").select("_text").mapInArrow(incidence, "own array<int>").toArrow()["own"].combine_chunks()
    of_text, lengths = own.flatten().to_numpy(), pc.list_value_length(own).to_numpy()
    begin = np.concatenate([[0], np.cumsum(lengths)])
    by_term = np.argsort(of_text, kind="stable")
    text_of = np.repeat(np.arange(len(lengths)), lengths)[by_term]
    term_begin = np.searchsorted(of_text[by_term], np.arange(len(terms) + 1))
    weights: dict[str, float] = {}
    open_texts = np.ones(len(lengths), dtype=bool)
    base = math.log((toxic + clean) / toxic)
    m = np.array([x[2] for x in terms], dtype=float)
    n = np.bincount(of_text, minlength=len(terms))
    while len(terms) and open_texts.any():
        # Evidence that the texts not yet explained lie so one-sidedly by more than chance.
        sure = np.where(n > 0, n * base - 2.0 * m, 0.0)
        best = int(np.argmax(sure))
        if n[best] < LEAST_TEXTS or sure[best] < EVIDENCE:
            break
        weights[terms[best][0]] = float(terms[best][3])
        explained = text_of[term_begin[best] : term_begin[best + 1]]
        explained = explained[open_texts[explained]]
        open_texts[explained] = False
        n = n - np.bincount(np.concatenate([of_text[begin[t] : begin[t + 1]] for t in explained]), minlength=len(terms))
    # Terms of many toxic texts and hardly any clean ones, though others explain those texts.
    for term, n, clean_n, odds in terms:
        if n >= max(LEAST_TEXTS, MANY_TOXIC * toxic) and clean_n <= FEW_CLEAN * clean and not any(term.startswith(t) for t in weights):
            weights[term] = float(odds)
    weights = {t: w for t, w in weights.items() if not any(t != s and t.startswith(s) for s in weights)}
    return Lexicon(weights, PHRASES + harmless_phrases(rows, Lexicon(weights, PHRASES)))


def harmless_phrases(rows: DataFrame, lexicon: Lexicon) -> tuple[str, ...]:
    """Two-word phrases around hits that at least five clean texts have, and toxic ones hardly, the commonest first."""

    def work(batches):
        for batch in batches:
            seen: Counter = Counter()
            for text, toxic in zip(texts_of(batch, "_text"), batch.column(1).to_pylist()):
                folded = fold(text)
                own = set()
                for a, b, _ in lexicon.hits(folded):
                    end = folded.index(" ", b)
                    own.add(" ".join((folded[:a].rsplit(None, 1)[-1:] or [""]) + [folded[a:end].strip()]).strip())
                    own.add(" ".join([folded[a:end].strip()] + (folded[end : end + 64].split(None, 1)[:1] or [""])).strip())
                seen.update((p, toxic) for p in own if " " in p)
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["phrase", "toxic", "n"])

    counted = rows.select("_text", "_toxic").mapInArrow(work, "phrase string, toxic int, n long").groupBy("phrase").agg(
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad")
    )
    found = counted.filter(F.col("clean") >= F.greatest(F.lit(5), 5 * F.col("bad"))).orderBy(F.col("clean").desc(), "phrase").collect()
    return tuple(r["phrase"] for r in found)


@dataclass
class Model:
    lexicon: Lexicon
    bias: float
    by_sum: float
    by_density: float

    def score(self, text: str) -> float:
        a, b = features(self.lexicon, text)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.bias + self.by_sum * a + self.by_density * b))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon and logistic function, from labelled rows that aren't held out."""
    rows = materialise(training_rows(docs, labels, sample))
    lexicon = learn_lexicon(rows, sample)

    def binned(batches):
        for batch in batches:
            cells = Counter()
            for text, toxic in zip(texts_of(batch, "_text"), batch.column(1).to_pylist()):
                a, b = features(lexicon, text)
                cells[min(int(a * 6), BINS - 1), min(int(b * 6), BINS - 1), toxic] += 1
            keys = list(cells)
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in keys], pa.int32()) for i in range(3)] + [pa.array([cells[k] for k in keys], pa.int64())], names=["a", "b", "toxic", "n"])

    cells = rows.select("_text", "_toxic").mapInArrow(binned, "a int, b int, toxic int, n long").groupBy("a", "b", "toxic").agg(F.sum("n").alias("n")).collect()
    x = np.array([[1.0, (c["a"] + 0.5) / 6 if c["a"] else 0.0, (c["b"] + 0.5) / 6 if c["b"] else 0.0] for c in cells]).reshape(-1, 3)
    y = np.array([c["toxic"] for c in cells], dtype=float)
    n = np.array([c["n"] for c in cells], dtype=float)
    theta = np.zeros(3)
    ridge = np.array([0.01, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -40, 40)))
        gradient = x.T @ (n * (p - y)) + ridge * theta
        curve = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, gradient)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    if not len(y) or y.max() == 0 or not lexicon.weights:  # nothing to learn from: nothing is called toxic
        theta = np.array([-3.0, 1.0, 0.0])
    return Model(lexicon, *(float(t) for t in theta))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, score (0 to 1) and predicted (score >= 0.5) of each row's whole text."""

    def work(batches):
        for batch in batches:
            scores = np.array([model.score(text) for text in texts_of(batch, "_text")])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["_id", "score"])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = picked.schema["_id"].dataType.simpleString()
    return picked.mapInArrow(work, f"_id {kind}, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text isn't predicted toxic, all columns as they were."""
    model = fit(docs, labels)

    def work(batches):
        for batch in batches:
            row = batch.column(0)
            texts = row.field(row.type.get_field_index(text_col))
            yield batch.filter(pa.array([model.score(text.as_py() or "") < 0.5 for text in texts], pa.bool_()))

    rows = docs.select(whole(docs).alias("_row"))
    return rows.mapInArrow(work, rows.schema).select(*fields(docs.columns))
