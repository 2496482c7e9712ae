"""Near-duplicate texts by an inverted join of MinHash signature coordinates.

Each text is the set of its runs of ``words`` words. A signature has 128 coordinates, the smallest hash of the
set under each of 128 permutations; two coordinates agree with the probability of the sets' similarity.

* Posting: texts are posted under each (coordinate, value) of the first 32 coordinates. Of those 32, a pair
  that agrees in ``agree`` or more must agree in one of any ``32 - agree + 1``: each text keeps only that
  prefix of its rarest postings, so long posting lists of common words are hardly ever read.
* Counting: where two texts meet in a list, the other lists are skipped; their collisions are counted from
  the two signatures (one byte a coordinate). Pairs with ``match`` or more collisions of 128 are retained.
* Confirming: retained pairs are linked when their whole sets are similar enough, in exact arithmetic.

Equal sets are one member throughout. Inside a posting list, and inside a group of retained pairs, only what
joins different components is handed on, so groups of thousands of copies stay linear: a group's texts are
first held against its smallest id, then those that fail against all the rest, block against block.

Null and empty texts (and texts without words) have the empty set and are linked with nothing. Rows with one
id are one member; rows without an id are linked with nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm import words as W
from sieveline.llm.blocks import CAP, Reports, forest, groups_of, in_blocks
from sieveline.llm.components import components
from sieveline.llm.rows import fields, whole
from sieveline.session import materialise

COORDINATES = 128
POSTED = 32
#: The chance at most, of a pair that is just similar enough, to be missed at either count.
MISS = 1e-5
BLOCK_BYTES = 8 << 20

_RNG = np.random.default_rng(20240601)
_FACTORS = (_RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_OFFSETS = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)


def least_agreement(n: int, similarity: float, miss: float = MISS) -> int:
    """The largest t for which a pair of this similarity agrees in t of n coordinates but with chance ``miss``."""
    below, t = 0.0, 0
    while True:
        below += math.comb(n, t) * similarity**t * (1 - similarity) ** (n - t)
        if below > miss:
            return t
        t += 1


def set_of(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct runs of each text, one after the other, and where each text's begin."""
    h, begin = W.shingle_hashes(words, first, n)
    parts = [np.unique(h[a:b]) for a, b in zip(begin, begin[1:])]
    offsets = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), offsets


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The signature of each set that isn't empty; rows of empty sets are zero."""
    some = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, COORDINATES), dtype=np.uint64)
    if len(some):
        at = offsets[:-1][some]
        for c in range(COORDINATES):
            out[some, c] = np.minimum.reduceat(values * _FACTORS[c] + _OFFSETS[c], at)
    return out


def sets_by_text(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the sets of their column ``_text``."""
    for batch in batches:
        raw, offsets = W.buffers(batch.column(batch.schema.get_field_index("_text")))
        for a, b in W.slices(offsets):
            hashes, first = W.word_hashes(raw, offsets[a : b + 1])
            yield batch.slice(a, b - a), *set_of(hashes, first, n)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """_id, n_shingles, set_hash, and for sets that aren't empty bits (a byte a coordinate) and posts (values)."""

    def work(batches):
        for part, values, offsets in sets_by_text(batches, words):
            sizes = np.diff(offsets)
            sig = signatures(values, offsets)
            sums = np.zeros((len(sizes), 2), dtype=np.uint64)
            some = np.flatnonzero(sizes)
            if len(some):
                for k, start in enumerate((values, W.mix(values ^ np.uint64(0x5BD1E995)))):
                    sums[some, k] = np.add.reduceat(start, offsets[:-1][some])
            bits = (W.mix(sig) & np.uint64(255)).astype(np.uint8)
            posts = (sig[:, :POSTED] >> np.uint64(32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("_id")).cast(pa.int64()),
                    pa.array(sizes.astype(np.int64)),
                    pa.array([bytes(x) for x in sums.view(np.uint8)], pa.binary()),
                    pa.array([bytes(x) if n else None for x, n in zip(bits, sizes)], pa.binary()),
                    pa.array([x if n else None for x, n in zip(posts, sizes)], pa.list_(pa.int64())),
                ],
                names=["_id", "n_shingles", "set_hash", "bits", "posts"],
            )

    picked = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return picked.mapInArrow(work, "_id long, n_shingles long, set_hash binary, bits binary, posts array<long>")


def retained_links(members: DataFrame, agree: int, match: int, cap: int = CAP) -> DataFrame:
    """Links (a, b) between members (_id, bits, posts), enough to join all pairs retained by their collisions."""
    posted = members.select("_id", F.posexplode("posts").alias("c", "value")).select(
        "_id", F.expr("shiftleft(cast(c as bigint), 32) + value").alias("post")
    )
    lists = posted.groupBy("post").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
    prefix = POSTED - agree + 1
    # A text's postings that nobody shares are the rarest; what is left of the prefix goes to the next rarest.
    rarest = (
        posted.join(lists, "post")
        .groupBy("_id")
        .agg(F.array_sort(F.collect_list(F.struct("length", "post"))).alias("shared"))
        .select("_id", F.expr(f"slice(shared, 1, greatest(0, {prefix} - ({POSTED} - size(shared)))).post").alias("kept"))
        .filter("size(kept) > 0")
    )
    rows = rarest.join(members.select("_id", "bits"), "_id").select("_id", "bits", F.explode("kept").alias("post"))

    def work(batches):
        out = Reports()
        for group in groups_of(batches, ["post", "left", "right"]):
            ids, bits = group["_id"], group["bits"]
            if len(ids) < 2:
                continue
            i, j = collisions(bits, group["block"], match)
            if not len(i):
                continue
            label = forest(i, j, len(ids))
            ends = np.flatnonzero(label != np.arange(len(ids)))
            out.add(ids[ends], ids[label[ends]], np.ones(len(ends)))
            if out.full:
                yield out.batch()
        yield out.batch()

    blocks = in_blocks(rows, ["post"], "_id", cap).select("post", "left", "right", "block", "_id", "bits")
    return blocks.mapInArrow(work, Reports.SCHEMA).groupBy("a", "b").agg(F.lit(1).alias("n")).select("a", "b")


def collisions(bits: np.ndarray, block: np.ndarray, match: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j, of one block or of the two that meet, that agree in ``match`` bytes or more."""
    if block[0] == block[-1] and (block == block[0]).all():
        one = two = np.arange(len(bits))
    else:
        one, two = np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())
    left, right = bits[one], bits[two]
    found_i, found_j = [], []
    step = max(1, (4 << 20) // max(1, len(two) * COORDINATES))
    for a in range(0, len(one), step):
        same = (left[a : a + step, None, :] == right[None, :, :]).sum(axis=2, dtype=np.int16) >= match
        x, y = np.nonzero(same)
        found_i.append(one[x + a])
        found_j.append(two[y])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    keep = i != j if one is not two else i < j
    return i[keep], j[keep]


def similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    m, n = len(one), len(two)
    if 100 * min(m, n) < percent * max(m, n):
        return False
    at = np.searchsorted(two, one)
    at[at == n] = n - 1
    both = int((two[at] == one).sum())
    return 100 * both >= percent * (m + n - both)


def confirmed_links(docs: DataFrame, id_col: str, text_col: str, words: int, groups: DataFrame, percent: int, match: int) -> DataFrame:
    """Exact links (a, b) inside groups (node, component, bits), enough to join all linked pairs."""

    def whole_sets(batches):
        for part, values, offsets in sets_by_text(batches, words):
            sets = [values[a:b].tobytes() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index(c)) for c in ("_id", "component", "bits")] + [pa.array(sets, pa.binary())],
                names=["_id", "component", "bits", "runs"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    members = materialise(
        texts.join(groups.select(F.col("node").alias("_id"), "component", "bits"), "_id")
        .mapInArrow(whole_sets, "_id long, component long, bits binary, runs binary")
    )
    heads = members.filter("_id = component").select("component", F.col("runs").alias("head"))

    def against_head(batches):
        for batch in batches:
            heads_, own = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            fits = [similar(np.frombuffer(h, np.uint64), np.frombuffer(s, np.uint64), percent) for h, s in zip(heads_, own)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fits)], names=["_id", "component", "fits"])

    tried = materialise(
        members.filter("_id <> component").join(heads, "component").select("_id", "component", "head", "runs")
        .mapInArrow(against_head, "_id long, component long, fits boolean")
    )
    links = tried.filter("fits").select(F.col("_id").alias("a"), F.col("component").alias("b"))
    left_over = tried.filter("not fits")
    # Groups with a member that its head doesn't confirm: those members meet each other and the confirmed ones.
    joined = members.join(tried, ["_id", "component"], "left").withColumn("free", F.coalesce(~F.col("fits"), F.lit(False)))
    sizes = (
        joined.join(left_over.select("component").distinct(), "component")
        .groupBy("component", "free")
        .agg(F.greatest(F.ceil(F.count(F.lit(1)) / CAP), F.ceil(F.sum(F.length("runs")) / BLOCK_BYTES)).alias("parts"))
        .groupBy("component")
        .agg(*[F.coalesce(F.sum(F.when(F.col("free") == flag, F.col("parts"))), F.lit(0)).cast("int").alias(name) for name, flag in (("free_parts", True), ("held_parts", False))])
    )
    own = F.pmod(F.xxhash64("_id", F.lit(7)), F.when(F.col("free"), F.col("free_parts")).otherwise(F.col("held_parts"))).cast("int")
    all_free = F.sequence(F.lit(0), F.col("free_parts") - 1)
    held = F.when(F.col("held_parts") > 0, F.transform(F.sequence(F.lit(1), F.col("held_parts")), lambda k: k - 1 + F.col("free_parts"))).otherwise(F.array().cast("array<int>"))
    meets = (
        joined.filter("free or _id <> component")
        .join(sizes, "component")
        .withColumn("block", own + F.when(F.col("free"), 0).otherwise(F.col("free_parts")))
        .withColumn("_other", F.explode(F.when(F.col("free"), F.concat(all_free, held)).otherwise(all_free)))
        .select("component", F.least("block", "_other").alias("left"), F.greatest("block", "_other").alias("right"), "block", "free", "_id", "bits", "runs")
    )
    by = ["component", "left", "right"]

    def rest(batches):
        out = Reports()
        for group in groups_of(batches, by):
            ids = group["_id"]
            runs = [np.frombuffer(x if isinstance(x, bytes) else x.tobytes(), np.uint64) for x in group["runs"]]
            i, j = collisions(group["bits"], group["block"], match) if len(ids) > 1 else ((), ())
            root = list(range(len(ids)))
            if not group["free"].all():
                kept = np.flatnonzero(~group["free"].astype(bool))
                for k in kept:
                    root[k] = int(kept[0])

            def top(k):
                while root[k] != k:
                    root[k] = k = root[root[k]]
                return k

            a, b = [], []
            for x, y in zip(i, j):
                p, q = top(int(x)), top(int(y))
                if p != q and similar(runs[x], runs[y], percent):
                    root[max(p, q)] = min(p, q)
                    a.append(ids[x])
                    b.append(ids[y])
            out.add(np.array(a, np.int64), np.array(b, np.int64), np.ones(len(a)))
            if out.full:
                yield out.batch()
        yield out.batch()

    more = meets.repartition(*by).sortWithinPartitions(*by).mapInArrow(rest, Reports.SCHEMA).select("a", "b")
    return links.unionByName(more)


def groups_of_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: _id, n_shingles, component_id (the smallest id reachable over links), kept.

    Texts are linked when 100 * |intersection| >= percent * |union| of their sets of runs of ``words`` words.
    """
    agree = least_agreement(POSTED, percent / 100)
    match = least_agreement(COORDINATES, percent / 100)
    sketch = materialise(sketches(docs, id_col, text_col, words))
    some = sketch.filter("n_shingles > 0 and _id is not null")
    members = materialise(
        some.groupBy("set_hash", "n_shingles")
        .agg(F.min_by(F.struct("bits", "posts"), "_id").alias("s"), F.min("_id").alias("_id"))
        .select("_id", "set_hash", "n_shingles", "s.bits", "s.posts")
    )
    candidates = components(retained_links(members.select("_id", "bits", "posts").dropDuplicates(["_id"]), agree, match))
    groups = candidates.join(members.select(F.col("_id").alias("node"), "bits").dropDuplicates(["node"]), "node")
    found = components(confirmed_links(docs, id_col, text_col, words, groups, percent, match))
    heads = (
        members.join(found, F.col("_id") == F.col("node"), "left")
        .select("set_hash", "n_shingles", F.coalesce("component", "_id").alias("component_id"))
    )
    return (
        sketch.select("_id", "n_shingles", "set_hash")
        .join(heads, ["set_hash", "n_shingles"], "left")
        .select("_id", "n_shingles", F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)))
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without those that are copies of a kept one: of each group the smallest id stays.

    Of rows with one id and texts that all are copies one id's rows stay or go together.
    """
    gone = groups_of_copies(docs, id_col, text_col, words, percent).filter("not kept").select(F.col("_id").alias("_gone")).distinct()
    rows = docs.select(whole(docs).alias("_row"))
    return rows.join(gone, F.col("_row").getField(id_col).cast("long") == F.col("_gone"), "left_anti").select(*fields(docs.columns))
