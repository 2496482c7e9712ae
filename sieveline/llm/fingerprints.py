"""SimHash fingerprints of texts, and all fingerprints within a Hamming radius.

A text's terms are its words and its pairs of neighbouring words, weighted by 1 + log2 of how often they
occur; each term's 128-bit hash votes with its weight on every bit. Likeness of two fingerprints is the share
of equal bits mapped so that unrelated fingerprints have 0 and equal ones 1: cos(pi * distance / 128), at
least 0, the cosine of the weighted term vectors that the distance estimates.

``within_radius`` finds all pairs of fingerprints at most ``radius`` bits apart: the bits are cut into
``radius + m`` blocks, ``m`` of which a pair must share; each ``m`` blocks lead one permuted table, whose buckets
are compared in blocks of members. ``m`` grows with the number of fingerprints, so that buckets stay small. Equal
fingerprints are one member.

A null text is an empty text; an empty text (no words) has the fingerprint of zeros.
"""

from __future__ import annotations

import hashlib
import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm import words as W
from sieveline.llm.blocks import CAP, Reports, forest, groups_of, in_blocks
from sieveline.llm.components import components
from sieveline.llm.rows import fields, whole
from sieveline.session import materialise

BITS = 128
_SIGNS = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1)
#: Texts whose votes are counted together.
_TOGETHER = 64


def fingerprints(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 16-byte fingerprint of each text."""
    hashes, first = W.word_hashes(raw, offsets)
    pairs, begin = W.shingle_hashes(hashes, first, 2)
    n = len(offsets) - 1
    out = np.zeros((n, BITS // 8), dtype=np.uint8)
    for a in range(0, n, _TOGETHER):
        b = min(a + _TOGETHER, n)
        h = np.concatenate([hashes[first[a] : first[b]], pairs[begin[a] : begin[b]]])
        text = np.concatenate([np.repeat(np.arange(b - a), np.diff(first[a : b + 1])), np.repeat(np.arange(b - a), np.diff(begin[a : b + 1]))])
        if not len(h):
            continue
        # Equal terms of a text become neighbours; the text's number goes into the order by mixing it in.
        key = W.mix(h ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(key)
        change = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        term, often = order[change], np.diff(np.concatenate([change, [len(order)]]))
        weight = (1 + np.log2(often)).astype(np.float32)
        lanes = np.stack([h[term], W.mix(h[term] + np.uint64(0xD6E8FEB86659FD93))], axis=1).view(np.uint8)
        cell = (text[term, None] * (BITS // 8) + np.arange(BITS // 8)) * 256 + lanes
        counts = np.bincount(cell.ravel(), weights=np.repeat(weight, BITS // 8), minlength=(b - a) * BITS // 8 * 256)
        votes = counts.reshape(b - a, BITS // 8, 256) @ _SIGNS
        out[a:b] = np.packbits((votes > 0).reshape(b - a, BITS), axis=1)
        out[a:b][np.diff(first[a : b + 1]) == 0] = 0
    return out


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    distance = np.unpackbits(one ^ two, axis=1).sum(axis=1)
    return np.where(distance == 0, 1.0, np.maximum(np.cos(np.pi * distance / BITS), 0.0))


def _array(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offsets


def fingerprinted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with their column ``fingerprint`` (32 hexadecimal digits)."""

    def work(batches):
        for batch in batches:
            row = batch.column(0)
            raw, offsets = W.buffers(row.field(row.type.get_field_index(text_col)))
            marks = [x.tobytes().hex() for a, b in W.slices(offsets) for x in fingerprints(raw, offsets[a : b + 1])]
            yield pa.RecordBatch.from_arrays([row, pa.array(marks, pa.string())], names=["_row", "fingerprint"])

    rows = docs.select(whole(docs).alias("_row"))
    found = rows.mapInArrow(work, T.StructType([*rows.schema.fields, T.StructField("fingerprint", T.StringType())]))
    return found.select(*fields([c for c in docs.columns if c != "fingerprint"]), "fingerprint")


def edge_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows in stretches of ascending ids, one stretch (``stretch``) after the other.

    Each stretch ends with a copy (``guest``) of the row that follows it; after the last row comes the first.
    Boundaries are quantiles of the ids, the first rows of stretches a list of that length. Rows of equal ids
    are ordered by their texts; rows without an id come after all others.
    """
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    bounds = sorted(set(rows.stat.approxQuantile("_id", [i / parts for i in range(1, parts)], 0.2 / parts)))
    cuts = F.array(*[F.lit(int(b)).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    stretch = F.when(F.col("_id").isNull(), len(bounds)).otherwise(
        F.aggregate(cuts, F.lit(0), lambda n, b: n + F.when(b <= F.col("_id"), 1).otherwise(0))
    )
    placed = rows.withColumn("stretch", stretch.cast("int"))
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.xxhash64("_text"))
    # The least row of each stretch, by its id alone unless ids are repeated: one short row per stretch.
    heads = placed.groupBy("stretch").agg(F.min(order).alias("k")).orderBy("stretch").collect()
    if not heads:
        return placed.withColumns({"guest": F.lit(0), "_order": F.lit("")})
    before = {h.stretch: heads[i - 1].stretch for i, h in enumerate(heads)}
    first = heads[0].stretch
    guest_of = F.lit(None).cast("int")
    for h in heads:
        same = F.col("_id").eqNullSafe(F.lit(h.k["_id"]).cast("long")) & (F.xxhash64("_text") == h.k["col3"])
        guest_of = F.when((F.col("stretch") == h.stretch) & same, F.lit(before[h.stretch])).otherwise(guest_of)
    return (
        placed.withColumn("_guest", guest_of)
        .withColumn("_at", F.explode(F.filter(F.array(F.struct(F.col("stretch").alias("s"), F.lit(0).alias("g")), F.struct(F.col("_guest").alias("s"), F.lit(1).alias("g"))), lambda x: x.s.isNotNull())))
        .select(F.col("_at.s").alias("stretch"), F.col("_at.g").alias("guest"), "_id", "_text")
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of its edited form and of the next text.

    _id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Edited: the last floor(n_chars / 4) code points give way to the first as many (or all) of the text with
    the next id; after the last comes the first. Of repeated rows one follows the other.
    """
    schema = "_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    rows = edge_rows(docs, id_col, text_col)
    ordered = (
        rows.repartition("stretch")
        .sortWithinPartitions("stretch", "guest", F.col("_id").asc_nulls_last(), F.xxhash64("_text"))
        .select("stretch", "guest", "_id", "_text")
    )

    def finished(pending):
        ids = [p[0] for p in pending]
        texts = [p[1] for p in pending]
        nexts = [p[2] for p in pending]
        edited = []
        for text, after in zip(texts, nexts):
            cut = len(text) // 4
            edited.append((text[: len(text) - cut] + after[:cut]).encode() if cut else text.encode())
        # A text is the next of the one before, so the next's fingerprint is only new at the end of a run.
        pool = {t: i for i, t in enumerate(dict.fromkeys([*texts, *nexts]))}
        marks = fingerprints(*_array([t.encode() for t in pool]))
        own, after = marks[[pool[t] for t in texts]], marks[[pool[t] for t in nexts]]
        changed = fingerprints(*_array(edited))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([x.tobytes().hex() for x in own], pa.string()), pa.array([x.tobytes().hex() for x in changed], pa.string()),
                pa.array(likeness(own, changed)), pa.array(likeness(own, after)),
            ],
            names=["_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def work(batches):
        last, pending, held = None, [], 0
        for batch in batches:
            for stretch, guest, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and last[0] == stretch:
                    pending.append((last[1], last[2], text))
                    held += len(text) + 1
                    if held > W.SLICE_BYTES:
                        yield finished(pending)
                        pending, held = [], 0
                last = None if guest else (stretch, key, text)
        if pending:
            yield finished(pending)

    return ordered.mapInArrow(work, schema)


def leading_blocks(rows: int, radius: int) -> int:
    """How many blocks lead a table, so that the fewest rows are dealt: tables times the blocks of members in a bucket."""
    dealt = lambda m: math.comb(radius + m, m) * math.ceil(rows / 2 ** (m * BITS / (radius + m)) / CAP)
    return min(range(1, 5), key=lambda m: (dealt(m), m))


def within_radius(marks: DataFrame, mark_col: str = "fingerprint", radius: int = 3) -> DataFrame:
    """mark, n (rows that have it), n_near (other rows at most ``radius`` bits away), cluster (a name shared by
    all fingerprints that chains of such steps join)."""
    members = materialise(
        marks.filter(F.col(mark_col).isNotNull()).groupBy(F.col(mark_col).alias("mark")).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("member", F.xxhash64("mark"))
    )
    lead = leading_blocks(members.count(), radius)
    parts = radius + lead
    edges = [round(i * BITS / parts) for i in range(parts + 1)]
    tables = list(combinations(range(parts), lead))

    def tabled(batches):
        for batch in batches:
            raw = [bytes.fromhex(x) for x in batch.column(0).to_pylist()]
            bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1), axis=1)
            hashes = np.zeros((len(raw), parts), dtype=np.uint64)
            for t, (a, b) in enumerate(zip(edges, edges[1:])):
                packed = np.packbits(bits[:, a:b], axis=1)
                for k in range(packed.shape[1]):
                    hashes[:, t] = W.mix(hashes[:, t] * np.uint64(257) + packed[:, k])
            keys = np.zeros((len(raw), len(tables)), dtype=np.uint64)
            for t, led in enumerate(tables):
                for k in led:
                    keys[:, t] = W.mix(keys[:, t] * np.uint64(257) + hashes[:, k])
            keys = keys.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(raw, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=["member", "n", "raw", "keys"])

    rows = members.select("mark", "member", "n").mapInArrow(tabled, "member long, n long, raw binary, keys array<long>")
    rows = rows.select("member", "n", "raw", F.posexplode("keys").alias("tab", "key"))
    by = ["tab", "key"]

    def compared(batches):
        out = Reports()
        for group in groups_of(batches, [*by, "left", "right"]):
            ids, block, table = group["member"], group["block"], int(group["tab"][0])
            if len(ids) < 2:
                continue
            bits = np.unpackbits(group["raw"], axis=1).astype(np.float32)
            same = (block == block[0]).all()
            one = np.arange(len(ids)) if same else np.flatnonzero(block == block.min())
            two = one if same else np.flatnonzero(block != block.min())
            apart = bits[one].sum(axis=1)[:, None] + bits[two].sum(axis=1)[None, :] - 2 * bits[one] @ bits[two].T
            near = apart <= radius
            x, y = np.nonzero(np.triu(near, 1) if same else near)
            i, j = one[x], two[y]
            # Counted in the first table that they share: no block before its last one is shared besides its own.
            for k in sorted(set(range(tables[table][-1])) - set(tables[table])):
                code = bits[:, edges[k] : edges[k + 1]].astype(np.uint64) @ (np.uint64(1) << np.arange(edges[k + 1] - edges[k], dtype=np.uint64))
                new = code[i] != code[j]
                i, j = i[new], j[new]
            if not len(i):
                continue
            met = np.zeros(len(ids), dtype=np.int64)
            np.add.at(met, i, group["n"][j])
            np.add.at(met, j, group["n"][i])
            some = np.flatnonzero(met)
            out.add(ids[some], ids[some], met[some])
            label = forest(i, j, len(ids))
            ends = np.flatnonzero(label != np.arange(len(ids)))
            out.add(ids[ends], ids[label[ends]], np.zeros(len(ends), dtype=np.int64))
            if out.full:
                yield out.batch()
        yield out.batch()

    blocks = in_blocks(rows, by, "member").select(*by, "left", "right", "block", "member", "n", "raw")
    reports = materialise(blocks.mapInArrow(compared, Reports.SCHEMA))
    counts = reports.filter("a = b").groupBy(F.col("a").alias("member")).agg(F.sum("n").alias("met"))
    joined = components(reports.filter("a <> b").select("a", "b"))
    return (
        members.join(counts, "member", "left")
        .join(joined, F.col("member") == F.col("node"), "left")
        .select("mark", "n", (F.col("n") - 1 + F.coalesce("met", F.lit(0))).alias("n_near"), F.coalesce("component", "member").alias("cluster"))
    )
