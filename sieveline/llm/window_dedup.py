"""Repeated windows of words: hashed by Rabin and Karp, met by what they hold, merged into spans to remove.

Every window of ``size`` consecutive words of a text gets a rolling hash (a polynomial over word hashes, from
prefix sums). Equal windows have the same least ``GRAM``-word run in the same place, so a row carries all
neighbouring windows that share theirs: the run's hash, where they start, and five bytes of each window's hash.
Rows of one run meet in one task, sorted by document; there the earliest start of each window stays and the
others are marked. Marked windows of a document merge into maximal spans.

Windows that occur earlier in the same few megabytes are marked before anything is shuffled, so a passage that
a third of all documents share is sent about once a slice of input. A run around which more than ``OPEN``
different windows were seen is handed on window by window to an ordinary aggregate. A text longer than a
slice is hashed piece by piece.

A window goes when its words also start earlier: in a smaller document id, or earlier in the same document.
A null text has no words; a null id counts as smaller than any other; rows of one id are one document, so equal
starts in them leave each other alone, and repeated rows are repeated in the result. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import words
from sieveline.operators.skew import join_per_key
from sieveline.session import materialise

SIZE = 20
GRAM = 8
#: Bytes kept of a window's hash; the run it is met by has eight of its own.
BYTES = 5
#: Different windows around one run that a task remembers.
OPEN = 1 << 20
NO_ID = -(1 << 63)
BASE = 0x9E3779B97F4A7C15

_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}
ROWS = "run long, id long, key long, start int, gone int, windows binary"
MARKS = "id long, key long, start int, gone int, run long, window long"


def powers(kind: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base (up) or of its inverse (down), modulo 2^64."""
    if len(_POWERS[kind]) < n:
        factor = BASE if kind == "up" else pow(BASE, -1, 1 << 64)
        steps = np.full(max(n, 1 << 16), factor, dtype=np.uint64)
        steps[0] = 1
        _POWERS[kind] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[kind][:n]


def rolling(hashes: np.ndarray, size: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``size`` items."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(hashes * powers("down", n), out=sums[1:])
    return words.mix((sums[size:] - sums[:-size]) * powers("up", n - size + 1))


def least_within(values: np.ndarray, width: int) -> np.ndarray:
    """Where the first least value of each ``width`` neighbours lies."""

    def merged(at: np.ndarray, shift: int) -> np.ndarray:
        left, right = at[: len(at) - shift], at[shift:]
        return np.where(values[right] < values[left], right, left)

    at, span = np.arange(len(values)), 1
    while span * 2 <= width:
        at, span = merged(at, span), span * 2
    return merged(at, width - span) if span < width else at


def pieces(raw: np.ndarray, offsets: np.ndarray, size: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(word hashes, first word of each text, first text, words before): slices of texts, long texts in overlapping pieces."""
    for first, last in words.slices(offsets, limit):
        begin, end = int(offsets[first]), int(offsets[last])
        if end - begin <= 2 * limit or last - first > 1:
            yield *hashed(raw, offsets[first : last + 1]), first, 0
            continue
        before, tail = 0, np.zeros(0, dtype=np.uint64)
        while begin < end:
            cut = next_space(raw, min(begin + limit, end), end)
            found, _ = hashed(raw, np.array([begin, cut]))
            found = np.concatenate([tail, found])
            yield found, np.array([0, len(found)]), first, before
            tail = found[max(len(found) - size + 1, 0) :]
            before, begin = before + len(found) - len(tail), cut


def next_space(raw: np.ndarray, at: int, end: int) -> int:
    while at < end:
        spaces = np.flatnonzero(words._SPACE[raw[at : min(at + 4096, end)]])
        if len(spaces):
            return at + int(spaces[0])
        at += 4096
    return end


def hashed(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word as it stands, and each text's first word (one more than texts)."""
    base, length = int(offsets[0]), int(offsets[-1] - offsets[0])
    padded = np.zeros(length + 8, dtype=np.uint8)
    padded[:length] = raw[base : base + length]
    starts, ends, first = words.word_bounds(padded[:length], offsets - base)
    return words.hash_spans(padded, starts, ends), first


def firsts(order_keys: tuple[np.ndarray, ...], group: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted places, whether each begins its group, and the place of its group's beginning."""
    order = np.lexsort((*order_keys[::-1], *group[::-1]))
    new = np.ones(len(order), dtype=bool)
    if len(order):
        new[1:] = np.logical_or.reduce([g[order][1:] != g[order][:-1] for g in group])
    return order, new, order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))] if len(order) else order


def run_rows(hashes: np.ndarray, first: np.ndarray, before: int, ids: np.ndarray, keys: np.ndarray, size: int) -> pa.RecordBatch | None:
    """A row for each run of neighbouring windows that share their least GRAM words."""
    gram = min(GRAM, size)
    counts = np.maximum(np.diff(first) - size + 1, 0)
    total = int(counts.sum())
    if not total:
        return None
    text = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    at = inside + first[:-1][text]
    window, grams = rolling(hashes, size)[at], rolling(hashes, gram)
    least = least_within(grams, size - gram + 1)[at]
    start, doc = inside + before, ids[text]
    order, _, head = firsts((doc, start), (window,))
    gone = np.zeros(total, dtype=bool)
    gone[order] = (doc[order] != doc[head]) | (start[order] != start[head])
    new = np.ones(total, dtype=bool)
    new[1:] = least[1:] != least[:-1]
    rows = np.flatnonzero(new)
    row = np.cumsum(new) - 1
    bits = np.bincount(row, weights=np.where(gone, 1 << (np.arange(total) - rows[row]), 0), minlength=len(rows)).astype(np.int32)
    sent = ~gone
    data = np.ascontiguousarray(window[sent].view(np.uint8).reshape(-1, 8)[:, :BYTES])
    ends = np.zeros(len(rows) + 1, dtype=np.int32)
    np.cumsum(np.bincount(row[sent], minlength=len(rows)) * BYTES, out=ends[1:])
    run = grams[least[rows]]
    silent = ends[1:] == ends[:-1]
    run[silent] = words.mix(keys[text[rows[silent]]].view(np.uint64) + start[rows[silent]].astype(np.uint64))
    packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(run.view(np.int64)), pa.array(doc[rows]), pa.array(keys[text[rows]]),
            pa.array(start[rows].astype(np.int32)), pa.array(bits), packed,
        ],
        names=["run", "id", "key", "start", "gone", "windows"],
    )


def sent_rows(size: int, limit: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = words.buffers(batch.column("text"))
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "key"))
            for hashes, first, text, before in pieces(raw, offsets, size, limit):
                last = text + len(first) - 1
                found = run_rows(hashes, first, before, ids[text:last], keys[text:last], size)
                if found is not None:
                    yield found

    return work


class Met:
    """The windows of rows that come sorted by run and document, settled batch by batch."""

    def __init__(self, most: int):
        self.most, self.run, self.open = most, None, False
        self.seen = tuple(np.zeros(0, dtype=t) for t in ("u8", "i8", "i8"))

    def marks(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        run, ids, keys, start, gone = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if not len(run):
            return
        gone = gone.copy()
        packed = batch.column(5).cast(pa.large_binary())
        ends = np.frombuffer(packed.buffers()[1], dtype=np.int64)[packed.offset : packed.offset + len(run) + 1]
        data = packed.buffers()[2]
        raw = np.frombuffer(data, dtype=np.uint8)[int(ends[0]) : int(ends[-1])] if data is not None else np.zeros(0, dtype=np.uint8)
        # Runs of a single row, but the last, have nobody to be compared with.
        new = np.concatenate([[True], run[1:] != run[:-1]])
        alone = new & np.concatenate([new[1:], [False]])
        if alone[0] and run[0] == self.run:
            alone[0] = False
        still = self.open and run[0] == self.run
        per_row = np.where(alone, 0, np.diff(ends) // BYTES)
        row = np.repeat(np.arange(len(run)), per_row)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        wide = np.zeros((len(raw) // BYTES, 8), dtype=np.uint8)
        wide[:, :BYTES] = raw.reshape(-1, BYTES)
        window = wide.view(np.uint64).ravel()[((ends[:-1] - ends[0]) // BYTES)[row] + nth]
        bit = self.places(gone[row], nth)
        at = start[row].astype(np.int64) + bit
        if still:  # too many different windows stand around this run: an aggregate settles them
            mine = run[row] == self.run
            yield self.handed_on(ids[row[mine]], keys[row[mine]], at[mine], window[mine])
            row, bit, at, window = row[~mine], bit[~mine], at[~mine], window[~mine]
        seen_w, seen_id, seen_at = self.seen if run[0] == self.run and not still else tuple(x[:0] for x in self.seen)
        runs = np.concatenate([np.full(len(seen_w), run[0]), run[row]])
        win, doc, pos = np.concatenate([seen_w, window]), np.concatenate([seen_id, ids[row]]), np.concatenate([seen_at, at])
        order, begins, head = firsts((doc, pos), (runs, win))
        late = (doc[order] != doc[head]) | (pos[order] != pos[head])
        later = order[late & (order >= len(seen_w))] - len(seen_w)
        gone |= np.bincount(row[later], weights=1 << bit[later], minlength=len(run)).astype(np.int32)
        if not still or run[-1] != self.run:
            kept = order[begins & (runs[order] == run[-1])]
            self.run, self.open, self.seen = run[-1], False, (win[kept], doc[kept], pos[kept])
            if len(kept) > self.most:
                self.open = True
                yield self.handed_on(self.seen[1], None, self.seen[2], self.seen[0])
        marked = np.flatnonzero(gone)
        none = pa.nulls(len(marked), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[marked]) for x in (ids, keys, start, gone)] + [none, none], names=["id", "key", "start", "gone", "run", "window"]
        )

    @staticmethod
    def places(gone: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """Which window of its row the ``nth`` one sent is: the bits of ``gone`` were not sent."""
        place, left = np.full(len(nth), -1), nth.copy()
        for b in range(32):
            here = (place < 0) & ((gone >> b) & 1 == 0)
            place[here & (left == 0)] = b
            left[here] -= 1
            if (place >= 0).all():
                break
        return place

    def handed_on(self, ids, keys, at, window) -> pa.RecordBatch:
        key = pa.nulls(len(ids), pa.int64()) if keys is None else pa.array(keys)
        columns = [pa.array(ids), key, pa.array(at.astype(np.int32)), pa.array(np.zeros(len(ids), dtype=np.int32))]
        columns += [pa.array(np.full(len(ids), self.run)), pa.array(window.view(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["id", "key", "start", "gone", "run", "window"])


def met(most: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Met(most)
        for batch in batches:
            yield from state.marks(batch)

    return work


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    number = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(number.alias("doc"), F.coalesce(number, F.lit(NO_ID)).alias("id"), text.alias("text"))
    return rows.withColumn("key", F.xxhash64("text"))


def repeated_windows(texts: DataFrame, size: int = SIZE, limit: int = words.SLICE_BYTES, most: int = OPEN) -> DataFrame:
    """(id, key, start, gone): windows to remove, as bits of ``gone`` counted from the window at ``start``."""
    rows = texts.select("id", "key", "text").mapInArrow(sent_rows(size, limit), ROWS)
    dealt = rows.repartition("run").sortWithinPartitions("run", "id", "start")
    marks = materialise(dealt.mapInArrow(met(most), MARKS))
    settled = marks.filter("window IS NULL").select("id", "key", "start", "gone")
    waiting = marks.filter("window IS NOT NULL")
    order = F.struct("id", "start")
    first = waiting.groupBy("run", "window").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    late = join_per_key(waiting.filter("key IS NOT NULL"), first, ["run", "window"], "_n").filter(order > F.col("_first"))
    return settled.unionByName(late.select("id", "key", "start", F.lit(1).alias("gone")))


def spans_of(starts: np.ndarray, gone: np.ndarray, size: int) -> np.ndarray:
    """Maximal spans (begin, end) of words that the marked windows cover."""
    bits = (gone[:, None] >> np.arange(32)) & 1
    at = np.unique((starts[:, None] + np.arange(32))[bits.astype(bool)])
    cut = np.flatnonzero(np.diff(at) > size) + 1
    return np.stack([at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])] + size], axis=1)


def kept_words(raw: memoryview, spans: np.ndarray | None, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words, those outside the spans) of a text, some megabytes at a time."""
    view, begin, seen = np.frombuffer(raw, dtype=np.uint8), 0, 0
    while begin < len(view):
        end = next_space(view, min(begin + limit, len(view)), len(view))
        found = bytes(raw[begin:end]).split()
        if spans is None:
            yield len(found), found
        else:
            edges = np.zeros(len(found) + 1, dtype=np.int64)
            inside = np.clip(spans - seen, 0, len(found))
            np.add.at(edges, inside[:, 0], 1)
            np.add.at(edges, inside[:, 1], -1)
            keep = np.cumsum(edges[:-1]) == 0
            yield len(found), [found[i] for i in np.flatnonzero(keep)]
        begin, seen = end, seen + len(found)


def cleaned(size: int, with_text: bool, limit: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "spans", "kept")}
            raw, offsets = words.buffers(batch.column("text"))
            marks = batch.column("marks")
            for i in range(len(batch)):
                mark = marks[i].as_py()
                spans = None
                if mark:
                    spans = spans_of(np.array([m["start"] for m in mark]), np.array([m["gone"] for m in mark]), size)
                digest, total, gone, glue, kept = hashlib.sha256(), 0, 0, b"", []
                for n, left in kept_words(memoryview(raw[offsets[i] : offsets[i + 1]]), spans, limit):
                    total, gone = total + n, gone + n - len(left)
                    if left:
                        joined = glue + b" ".join(left)
                        digest.update(joined)
                        glue = b" "
                        if with_text:
                            kept.append(joined)
                out["n_words"].append(total)
                out["n_removed"].append(gone)
                out["kept_sha256"].append(digest.hexdigest())
                out["spans"].append([] if spans is None else [{"begin": int(a), "end": int(b)} for a, b in spans])
                out["kept"].append(b"".join(kept).decode("utf-8", "replace") if with_text else None)
            span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            types = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "spans": span, "kept": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(v, types[k]) for k, v in out.items())], names=["_id", *out])

    return work


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_text: bool = True,
    limit: int = words.SLICE_BYTES, most: int = OPEN,
) -> DataFrame:
    """Per row: _id, n_words, n_removed, kept_sha256, spans removed (begin, end in words), and the words kept."""
    if not 1 <= size <= 32 + GRAM - 1:
        raise ValueError("a row has room for windows of up to 39 words")
    texts = texts_of(docs, id_col, text_col)
    marks = repeated_windows(texts, size, limit, most).groupBy("id", "key").agg(F.collect_list(F.struct("start", "gone")).alias("marks"))
    joined = texts.join(marks, ["id", "key"], "left").select("doc", "text", "marks")
    kinds = "_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<begin:long,end:long>>, kept string"
    return joined.mapInArrow(cleaned(size, with_text, limit), kinds)
