"""Near-duplicate vectors by p-stable hashing, then exact cosines.

Vectors are set to length 1, so a cosine bounds a Euclidean distance: |u - v|^2 = 2 - 2 cos. A table hashes a
vector to floor((a . u + b) / w) for ``k`` Gaussian directions a. How many directions and tables are needed
follows from the collision probabilities: ``k`` so that a random vector meets about ``STRANGERS`` others in a
bucket, and as many tables as leave a pair that is just similar enough unmet with chance ``MISS`` at most.

Buckets are compared in blocks (see ``blocks``). A pair is counted in the first table in which it meets, so
nothing has to be made distinct; of the links only a spanning forest leaves the task. Equal vectors are one
member with a count.

Only vectors of one label and one length are compared. Vectors (or labels) that are null, and vectors that are
empty, zero or hold null or non-finite components are linked with nothing. A repeated id counts as often as it
occurs; a vector without an id is counted as a partner, and its own component is null.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieveline.llm import words as W
from sieveline.llm.blocks import Reports, fixed_rows, forest, groups_of, in_blocks
from sieveline.llm.components import components
from sieveline.session import materialise

WIDTH = 2.5
STRANGERS = 64
MISS = 1e-4
SEED = 977


def collision_chance(distance: float, width: float) -> float:
    """That one quantised Gaussian projection gives both ends of this distance the same cell."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def tables_for(rows: int, cosine: float, width: float = WIDTH) -> tuple[int, int]:
    """Directions a table and tables, for groups of this many vectors."""
    near = collision_chance(math.sqrt(max(2 - 2 * cosine, 1e-9)), width)
    far = collision_chance(math.sqrt(2), width)
    k = max(4, math.ceil(math.log(max(rows, 1) / STRANGERS) / -math.log(far))) if rows > STRANGERS else 4
    return k, max(1, math.ceil(math.log(MISS) / math.log1p(-(near**k))))


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def bucket_keys(units: np.ndarray, k: int, tables: int) -> np.ndarray:
    """The bucket of each vector in each table, as 32-bit hashes of its cells."""
    rng = np.random.default_rng([SEED, units.shape[1], k, tables])
    directions = rng.standard_normal((units.shape[1], k * tables))
    shifts = rng.uniform(0, WIDTH, k * tables)
    cells = np.floor((units @ directions + shifts) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(units), tables, k)
    h = np.full((len(units), tables), 1, dtype=np.uint64)
    for i in range(k):
        h = W.mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, i])
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", cosine: float = 0.93) -> DataFrame:
    """One row per row: _id, n_links, component_id (the smallest id reachable over links), kept."""
    element = vectors.schema[vector_col].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    wide = "float" if kind == "<f4" else "double"
    rows = vectors.select(
        F.col(id_col).cast("long").alias("_id"),
        F.col(label_col).alias("_label"),
        F.col(vector_col).cast(f"array<{wide}>").alias("_vector"),
    )
    sound = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("_vector", lambda x: x != 0)
    usable = F.coalesce(F.col("_label").isNotNull() & F.col("_vector").isNotNull() & sound, F.lit(False))
    # -0.0 and 0.0 are one value: adding 0.0 makes them one pattern of bits.
    marked = rows.withColumn("_vector", F.when(usable, F.transform("_vector", lambda x: x + F.lit(0.0).cast(wide))))
    largest = marked.filter("_vector is not null").groupBy("_label").count().agg(F.max("count")).first()[0] or 0
    k, tables = tables_for(largest, cosine)
    # A null id is the last choice for a member's name: it gets the negative hash of its vector.
    members = materialise(
        marked.filter("_vector is not null")
        .groupBy("_label", "_vector")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("_id").alias("_least"))
        .withColumn("member", F.coalesce("_least", F.xxhash64("_label", "_vector")))
        .withColumn("member", F.when(F.count(F.lit(1)).over(_window("member")) > 1, F.xxhash64("_label", "_vector")).otherwise(F.col("member")))
    )

    def hashed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors_ = batch.column(3)
            vectors_ = vectors_.cast(pa.large_list(pa.float32() if kind == "<f4" else pa.float64()))
            flat, sizes = vectors_.flatten().to_numpy(zero_copy_only=False), np.diff(vectors_.offsets.to_numpy())
            at = np.concatenate([[0], np.cumsum(sizes)])
            keys: list[bytes] = [b""] * len(sizes)
            raw = [flat[a:b].astype(kind).tobytes() for a, b in zip(at, at[1:])]
            for size in np.unique(sizes):
                picked = np.flatnonzero(sizes == size)
                matrix = np.stack([flat[at[i] : at[i] + size] for i in picked])
                for i, key in zip(picked, bucket_keys(unit_rows(matrix), k, tables)):
                    keys[i] = key.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes.astype(np.int32)), pa.array(raw, pa.binary()), pa.array(keys, pa.binary()),
                 pa.array([np.frombuffer(x, np.int32) for x in keys], pa.list_(pa.int32()))],
                names=["member", "copies", "label_hash", "dim", "raw", "keys", "cells"],
            )

    cells = members.select("member", "copies", F.xxhash64("_label").alias("label_hash"), "_vector").mapInArrow(
        hashed, "member long, copies long, label_hash long, dim int, raw binary, keys binary, cells array<int>"
    ).select("*", F.posexplode("cells").alias("tab", "cell")).drop("cells")
    by = ["label_hash", "dim", "tab", "cell"]

    def compared(batches):
        out = Reports()
        for group in groups_of(batches, [*by, "left", "right"]):
            ids, block, table = group["member"], group["block"], int(group["tab"][0])
            if len(ids) < 2:
                continue
            # A batch that holds vectors of several lengths has them as an array of bytes objects.
            units = unit_rows(np.frombuffer(b"".join(x if isinstance(x, bytes) else x.tobytes() for x in group["raw"]), kind).reshape(len(ids), -1))
            keys = np.ascontiguousarray(group["keys"]).view(np.int32)
            if (block == block[0]).all():
                one = two = np.arange(len(ids))
                x, y = np.nonzero(np.triu(units @ units.T >= cosine, 1))
            else:
                one, two = np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())
                x, y = np.nonzero(units[one] @ units[two].T >= cosine)
            i, j = one[x], two[y]
            if table:
                new = ~(keys[i, :table] == keys[j, :table]).any(axis=1)
                i, j = i[new], j[new]
            if not len(i):
                continue
            met = np.zeros(len(ids), dtype=np.int64)
            np.add.at(met, i, group["copies"][j])
            np.add.at(met, j, group["copies"][i])
            some = np.flatnonzero(met)
            out.add(ids[some], ids[some], met[some])
            label = forest(i, j, len(ids))
            ends = np.flatnonzero(label != np.arange(len(ids)))
            out.add(ids[ends], ids[label[ends]], np.zeros(len(ends), dtype=np.int64))
            if out.full:
                yield out.batch()
        yield out.batch()

    blocks = in_blocks(cells, by, "member").select(*by, "left", "right", "block", "member", "copies", "raw", "keys")
    reports = materialise(blocks.mapInArrow(compared, Reports.SCHEMA))
    counts = reports.filter("a = b").groupBy(F.col("a").alias("member")).agg(F.sum("n").alias("met"))
    joined = components(reports.filter("a <> b").select("a", "b"))
    # A component is named after its smallest id; members without one don't lend their stand-in.
    placed = members.join(counts, "member", "left").join(joined, F.col("member") == F.col("node"), "left").withColumn("component", F.coalesce("component", "member"))
    names = placed.groupBy("component").agg(F.min("_least").alias("component_id"))
    found = placed.join(names, "component").select(
        "_label", "_vector", (F.col("copies") - 1 + F.coalesce("met", F.lit(0))).alias("n_links"), "component_id"
    )
    return (
        marked.join(found, ["_label", "_vector"], "left")
        .select(
            "_id",
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("_id").isNotNull(), F.coalesce("component_id", "_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)))
    )


def _window(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)
