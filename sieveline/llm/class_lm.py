"""A class-based bigram language model with exchange clustering, and its scores of whole texts.

P(text) is the product over its words, and one end, of P(class | class before) * P(word | class).

* Clustered is every word that makes up at least ``SHARE`` of all training tokens and stands ``LEAST`` times,
  so there are at most 1 / ``SHARE`` of them at any size. Exchange puts them into classes: each word moves to
  the class with which the training texts are likeliest. It starts from the ``SEEDS`` commonest words, which move
  one after the other among ``CLASSES`` classes until few do; then, in ``ROUNDS`` rounds, all clustered words
  move at once by the classes that stand before and after them, counted by Spark over all training texts.
  Of these states the likeliest is kept. All other words are in a class of their shape: last byte's kind by
  length. Clustered words begin in those classes, and stay there if nothing is likelier.
* Class transitions are additive-smoothed towards the class's frequency, words in a class by adding one, with
  one more place for all unknown words in each shape class: probabilities add up to one.
* Word counts are over all training texts, by 64-bit hash. The counts of clustered words go to every task; all
  other words of all texts meet their counts in a join.

A null text is an empty text: one end. Without training texts every count is zero.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm import words as W
from sieveline.session import materialise

#: Least part of the training tokens, and least count, of a word that is clustered.
SHARE = 2.0**-21
LEAST = 4
SEEDS = 1024
CLASSES = 64
PASSES = 12
ROUNDS = 2
LENGTHS = (4, 7)
#: The end of a text, as a word.
END = np.uint64(0x656E64)
_HELD_ROWS = 2 << 20

_KINDS = np.full(256, 5, dtype=np.int64)
_KINDS[97:123] = 0
_KINDS[48:58] = 1
_KINDS[[46, 33, 63]] = 2
_KINDS[[44, 59, 58]] = 3
_KINDS[128:] = 4
SHAPES = 6 * (len(LENGTHS) + 1)


def shapes(last: np.ndarray, length: np.ndarray) -> np.ndarray:
    return _KINDS[last] * (len(LENGTHS) + 1) + np.searchsorted(LENGTHS, length, side="right")


def with_ends(values: np.ndarray, first: np.ndarray, end) -> tuple[np.ndarray, np.ndarray]:
    """The values with one ``end`` after each text's last, and each text's first."""
    return np.insert(values, first[1:], end), first + np.arange(len(first))


def slices_of(batches, column: int = 0):
    for batch in batches:
        raw, offsets = W.buffers(batch.column(column))
        for a, b in W.slices(offsets):
            yield batch, a, b, W.shaped_words(raw, offsets[a : b + 1])


def word_counts(texts: DataFrame) -> DataFrame:
    """h, n, shape of each word of the texts (one column), and of the end of a text (shape -1)."""

    def work(batches):
        held, rows = [], 0

        def merged():
            h, s, n = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(h, kind="stable")
            h, s, n = h[order], s[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            return h[at], s[at], np.add.reduceat(n, at)

        for _, a, b, (h, _, last, length) in slices_of(batches):
            values, at, n = np.unique(h, return_index=True, return_counts=True)
            held.append((values, shapes(last, length)[at], n))
            held.append((np.array([END]), np.array([-1]), np.array([b - a])))
            rows += len(values) + 1
            if rows > _HELD_ROWS:
                held = [merged()]
                rows = len(held[0][0])
                if rows > _HELD_ROWS // 2:
                    yield from out(*held.pop())
                    rows = 0
        if held:
            yield from out(*merged())

    def out(h, s, n, step=1 << 17):
        for a in range(0, len(h), step):
            yield pa.RecordBatch.from_arrays([pa.array(h[a : a + step].view(np.int64)), pa.array(n[a : a + step].astype(np.int64)), pa.array(s[a : a + step].astype(np.int32))], names=["h", "n", "shape"])

    return texts.mapInArrow(work, "h long, n long, shape int").groupBy("h").agg(F.sum("n").alias("n"), F.min("shape").alias("shape"))


def units(h: np.ndarray, shape: np.ndarray, clustered: np.ndarray) -> np.ndarray:
    """The number of a clustered word (``clustered``: their hashes, sorted), else that of the shape after them."""
    at = np.minimum(np.searchsorted(clustered, h), max(len(clustered) - 1, 0))
    known = clustered[at] == h if len(clustered) else np.zeros(len(h), dtype=bool)
    return np.where(known, at, len(clustered) + shape)


def unit_pairs(texts: DataFrame, clustered: np.ndarray) -> np.ndarray:
    """How often each unit follows each: units are clustered words, shapes, and last the edge of a text."""
    n = len(clustered) + SHAPES + 1

    def work(batches):
        table = np.zeros(n * n, dtype=np.int64)
        for _, a, b, (h, first, last, length) in slices_of(batches):
            own = units(h, shapes(last, length), clustered)
            row, begin = with_ends(own, first, n - 1)
            before = np.empty_like(row)
            before[1:] = row[:-1]
            before[begin[:-1]] = n - 1
            table += np.bincount(before * n + row, minlength=n * n)
        some = np.flatnonzero(table)
        for a in range(0, len(some), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(some[a : a + (1 << 17)]), pa.array(table[some[a : a + (1 << 17)]])], names=["cell", "n"])

    cells = texts.mapInArrow(work, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    found = cells.toArrow()
    out = np.zeros(n * n, dtype=np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(n, n)


def contexts(texts: DataFrame, clustered: np.ndarray, own: np.ndarray, of_words: bool = True) -> DataFrame:
    """Which classes stand beside each clustered word, if asked ``of_words``, and class: w, and cells of c and n.

    ``own`` is the class of each unit, the edge's last. w is a unit, or their number and the class; c is the class
    before it, or, that of the edge and one more added, the class after it. A class has only those after it.
    """
    words, total = len(clustered), int(own[-1]) + 1
    shared = texts.sparkSession.sparkContext.broadcast((clustered, own))

    def work(batches):
        clustered, own = shared.value
        joint = np.zeros(total * total, dtype=np.int64)
        held, rows = [], 0

        def merged():
            cell, n = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(cell, kind="stable")
            cell, n = cell[order], n[order]
            at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            return cell[at], np.add.reduceat(n, at)

        for _, a, b, (h, first, last, length) in slices_of(batches):
            row, begin = with_ends(units(h, shapes(last, length), clustered), first, len(own) - 1)
            before = np.empty_like(row)
            before[1:] = row[:-1]
            before[begin[:-1]] = len(own) - 1
            joint += np.bincount(own[before] * total + own[row], minlength=total * total)
            if not of_words:
                continue
            left, right = row < words, before < words
            cells = np.concatenate([row[left] * (2 * total) + own[before[left]], before[right] * (2 * total) + total + own[row[right]]])
            if len(cells):
                held.append(np.unique(cells, return_counts=True))
                rows += len(held[-1][0])
            if rows > _HELD_ROWS:
                held = [merged()]
                rows = len(held[0][0])
                if rows > _HELD_ROWS // 2:
                    yield from out(*held.pop())
                    rows = 0
        some = np.flatnonzero(joint)
        yield from out((words + some // total) * (2 * total) + total + some % total, joint[some])
        if held:
            yield from out(*merged())

    def out(cell, n, step=1 << 17):
        for a in range(0, len(cell), step):
            w, c = np.divmod(cell[a : a + step], 2 * total)
            yield pa.RecordBatch.from_arrays([pa.array(w.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(n[a : a + step].astype(np.int64))], names=["w", "c", "n"])

    # Dealt by word alone, so that adding up and gathering a word's cells, of which it has few, take one shuffle.
    cells = texts.mapInArrow(work, "w int, c int, n long").repartition("w").groupBy("w", "c").agg(F.sum("n").alias("n"))
    return cells.groupBy("w").agg(F.collect_list(F.struct("c", "n")).alias("cells"))


def dense(batch, columns: int) -> np.ndarray:
    """One row of counts for each row of ``contexts``."""
    lists = batch.column(batch.schema.get_field_index("cells"))
    values = lists.flatten()
    out = np.zeros((len(lists), columns))
    at = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    out[at, values.field("c").to_numpy()] = values.field("n").to_numpy()
    return out


def joint_of(found: DataFrame, words: int, total: int) -> np.ndarray:
    """How often each class follows each, from ``contexts``."""
    out = np.zeros((total, total))
    for batch in found.filter(F.col("w") >= words).toArrow().to_batches():
        out[batch.column(0).to_numpy() - words] = dense(batch, 2 * total)[:, total:]
    return out


def likeliest(found: DataFrame, own: np.ndarray, words: int, joint: np.ndarray) -> np.ndarray:
    """The class of each unit when every clustered word moves to that under which what stands beside it is likeliest.

    That is the exchange criterion to first order: each word by itself is a small part of its class.
    """
    total = len(joint)
    steps = np.log(10) * transitions(joint)
    size = np.log(joint.sum(axis=0) + 1)
    # By class before (to k, a word of k) and by class after (from k).
    gain = np.concatenate([steps - size[None, :], steps.T])[:, : total - 1]

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                best = np.argmax(dense(batch, 2 * total) @ gain, axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32))], names=["w", "k"])

    moved = found.filter(F.col("w") < words).mapInArrow(work, "w int, k int").toArrow()
    out = own.copy()
    out[moved["w"].to_numpy()] = moved["k"].to_numpy()
    return out


def transitions(joint: np.ndarray) -> np.ndarray:
    """log10 P(class | class before), smoothed towards the class's frequency."""
    total = len(joint)
    weight = (joint.sum(axis=0) + 1) / (joint.sum() + total)
    return np.log10((joint + total * weight[None, :]) / (joint.sum(axis=1, keepdims=True) + total))


def likelihood(joint: np.ndarray) -> float:
    """What the exchange makes greater: that of the training texts, but for what no class changes."""
    return float(_xlogx(joint).sum() - _xlogx(joint.sum(axis=0)).sum() - _xlogx(joint.sum(axis=1)).sum())


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, words: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each unit: the first ``words`` units are clustered, each other one keeps its own class.

    Words come commonest first; the first have classes of their own, all others begin in the last. Each is tried in every class; what counts is the sum of n log n over class
    pairs less that over classes as first and as second.
    """
    n = len(pairs)
    classes = max(1, min(classes, words))
    total = classes + n - words
    own = np.concatenate([np.minimum(np.arange(words), classes - 1), classes + np.arange(n - words)]).astype(np.int64)
    table = pairs.astype(np.float64)
    member = np.zeros((n, total))
    member[np.arange(n), own] = 1
    right, left = table @ member, table.T @ member  # unit by class of its successor, of its predecessor
    joint = member.T @ right
    for _ in range(passes):
        moved = 0
        for w in range(words):
            a, r, l, self_pair = own[w], right[w].copy(), left[w].copy(), table[w, w]
            # Take the word out.
            base = joint.copy()
            base[a] -= r
            base[:, a] -= l
            base[a, a] += self_pair
            r[a] -= self_pair
            l[a] -= self_pair
            # Pairs with the word count for the other word's class wherever the word goes.
            firsts, seconds = base.sum(axis=1) + l, base.sum(axis=0) + r
            r_all, l_all = r.sum() + self_pair, l.sum() + self_pair
            k = np.arange(classes)
            rows = _xlogx(base[:classes] + r) - _xlogx(base[:classes])
            columns = (_xlogx(base[:, :classes] + l[:, None]) - _xlogx(base[:, :classes])).T
            corner = base[k, k] + r[k] + l[k] + self_pair
            gain = rows.sum(axis=1) + columns.sum(axis=1)
            gain += _xlogx(corner) - _xlogx(base[k, k]) - rows[k, k] - columns[k, k]
            gain -= _xlogx(firsts[:classes] + r_all) - _xlogx(firsts[:classes]) + _xlogx(seconds[:classes] + l_all) - _xlogx(seconds[:classes])
            b = int(np.argmax(gain))
            if b == a or gain[b] <= gain[a] + 1e-9:
                continue
            base[b] += r
            base[:, b] += l
            base[b, b] += self_pair
            joint, own[w] = base, b
            right[:, a] -= table[:, w]
            right[:, b] += table[:, w]
            left[:, a] -= table[w]
            left[:, b] += table[w]
            # The pair (w, w) now lies in the new class from both sides.
            joint = joint if self_pair == 0 else _joint(own, right, total)
            moved += 1
        if moved * 200 < words:
            break
    return own


def _joint(own: np.ndarray, right: np.ndarray, total: int) -> np.ndarray:
    out = np.zeros((total, total))
    np.add.at(out, own, right)
    return out


@dataclass
class Model:
    clustered: np.ndarray  # hashes of the clustered words, sorted
    often: np.ndarray  # their counts
    own: np.ndarray  # the class of each unit
    steps: np.ndarray  # log10 P(class | class before)
    sizes: np.ndarray  # log10 of what a word's count, and one, is divided by in its unit's class
    ends: int
    tokens: int
    types: int

    def parts(self, h, first, last, length) -> dict[str, np.ndarray]:
        """Of each text: tokens, known ones and log10(count + 1) of the clustered and the end, transitions and class
        sizes; and the words that aren't clustered, by text."""
        end = len(self.own) - 1
        row, begin = with_ends(units(h, shapes(last, length), self.clustered), first, end)
        classes = self.own[row]
        before = np.empty_like(classes)
        before[1:] = classes[:-1]
        before[begin[:-1]] = self.own[end]
        words, _ = with_ends(h, first, END)
        n = np.zeros(len(row))
        listed = row < len(self.clustered)
        n[listed] = self.often[row[listed]]
        n[row == end] = self.ends
        rare = ~listed & (row != end)
        text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        starts = begin[:-1]
        return {
            "n_tokens": np.diff(begin), "n_listed": np.add.reduceat((n > 0).astype(np.int64), starts), "logs": np.add.reduceat(np.log10(n + 1.0), starts),
            "steps": np.add.reduceat(self.steps[before, classes], starts), "sizes": np.add.reduceat(self.sizes[row], starts),
            "rare": words[rare], "rare_text": text[rare],
        }


def is_training(id_col: Column, folds: int = 7, held: int = 2) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds != held, F.lit(True))


def train(texts: DataFrame, counts: DataFrame) -> Model:
    """``texts``: one column, the training texts; ``counts``: their word_counts."""
    sums = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, types = int(sums.n or 0), int(sums.v)
    floor = max(LEAST, math.ceil(tokens * SHARE))
    listed = counts.filter((F.col("n") >= floor) & (F.col("shape") >= 0)).select("h", "n", "shape").toArrow()
    h, n, shape = (listed[c].to_numpy() for c in ("h", "n", "shape"))
    by_hash = np.argsort(h.view(np.uint64))
    clustered, n, shape = h.view(np.uint64)[by_hash], n[by_hash], shape[by_hash]
    words = len(clustered)
    # Exchange goes through the seeds commonest first; units keep the order of their hashes.
    first = np.sort(np.lexsort((clustered, -n))[:SEEDS])
    pairs = unit_pairs(texts, clustered[first])
    order = np.concatenate([np.argsort(-n[first], kind="stable"), np.arange(len(first), len(pairs))])
    seeded = np.empty(len(pairs), dtype=np.int64)
    seeded[order] = exchange(pairs[np.ix_(order, order)], len(first))
    own = np.concatenate([seeded[len(first) + shape], seeded[len(first) :]])
    own[first] = seeded[: len(first)]
    total = int(own[-1]) + 1
    best = None
    for k in range(ROUNDS + 1):
        found = materialise(contexts(texts, clustered, own, of_words=k < ROUNDS))
        joint = joint_of(found, words, total)
        if best is None or likelihood(joint) > best[0]:
            best = likelihood(joint), own, joint
        if k < ROUNDS:
            own = likeliest(found, own, words, joint)
    _, own, joint = best
    # Words and counts of each class: clustered words, and by shape all that aren't clustered.
    inside = {int(r["shape"]): (int(r["n"]), int(r["v"])) for r in counts.groupBy("shape").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    shape_n, shape_v = np.zeros(SHAPES), np.zeros(SHAPES)
    for k, (a, b) in inside.items():
        if k >= 0:
            shape_n[k], shape_v[k] = a, b
    np.subtract.at(shape_n, shape, n)
    np.subtract.at(shape_v, shape, 1)
    class_size = np.zeros(total)
    np.add.at(class_size, own[:words], n + 1)
    class_size[own[words : words + SHAPES]] += shape_n + shape_v + 1
    ends = inside.get(-1, (0, 0))[0]
    class_size[own[-1]] = ends + 1
    return Model(clustered, n, own, transitions(joint), np.log10(np.maximum(class_size, 1))[own], ends, tokens, types)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row, learned from those not held out."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), (~is_training(F.col(id_col))).alias("held_out"))
    training = rows.filter("not held_out").select("_text")
    counts = materialise(word_counts(training))
    model = train(training, counts)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["n_tokens", "n_listed", "logs", "steps", "sizes"]

    def work(batches):
        held, size = [], 0
        for batch, a, b, found in slices_of(batches, 1):
            parts = shared.value.parts(*found)
            keys = batch.column(3).slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [keys, batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *(pa.array(parts[c].astype(np.int64) if c[0] == "n" else parts[c]) for c in names), pa.nulls(b - a, pa.int64()), pa.nulls(b - a, pa.int32())],
                names=columns,
            )
            # A word that a text repeats is one row.
            key = np.stack([keys.to_numpy(zero_copy_only=False)[parts["rare_text"]], parts["rare"].view(np.int64)])
            text_word = W.mix(parts["rare"] ^ W.mix(parts["rare_text"].astype(np.uint64)))
            _, at, n = np.unique(text_word, return_index=True, return_counts=True)
            m = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[0][at]), pa.nulls(m, batch.column(0).type), pa.nulls(m, pa.bool_()), *(pa.nulls(m, pa.int64() if c[0] == "n" else pa.float64()) for c in names), pa.array(key[1][at]), pa.array(n.astype(np.int32))],
                names=columns,
            )

    columns = ["key", "_id", "held_out", *names, "h", "tf"]
    schema = f"key long, _id {kind}, held_out boolean, n_tokens long, n_listed long, logs double, steps double, sizes double, h long, tf int"
    parts = materialise(rows.withColumn("key", F.xxhash64("_id", "_text")).mapInArrow(work, schema))
    # Equal rows have one key: their words come as often as the rows, so their sums are divided by that.
    times = parts.filter("h is null").select("key")
    rare = (
        parts.filter("h is not null").select("key", "h", "tf")
        .join(counts.select("h", "n"), "h")
        .groupBy("key")
        .agg(F.sum("tf").alias("rare_known"), F.sum(F.col("tf") * F.log10(F.col("n") + 1)).alias("rare_logs"))
        .join(times.groupBy("key").agg(F.count(F.lit(1)).alias("times")), "key")
        .select("key", (F.col("rare_known") / F.col("times")).cast("long").alias("rare_known"), (F.col("rare_logs") / F.col("times")).alias("rare_logs"))
    )
    logs = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0))
    return (
        parts.filter("h is null").drop("h", "tf")
        .join(rare, "key", "left")
        .select(
            "_id", "held_out", "n_tokens",
            (F.col("n_listed") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (logs - F.col("n_tokens") * math.log10(model.tokens + model.types + 1)).alias("base_score"),
            (logs - F.col("sizes") + F.col("steps")).alias("score"),
        )
    )
