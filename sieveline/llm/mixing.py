"""A mix of sources at target weights that meets its word budget by subset sums over exact lengths.

* Sizes are counts of words. Sources by code point (null last) weigh 5, 2, 1, repeating, and share a budget of
  150 % of all sizes; no source gets more than twice its size, what is over is shared again by weight.
* Each source takes its documents whole as often as its target allows (once, when the target is above its
  size), and fills the rest of its target from one more pass: documents are counted by exact length, each
  length gives the same share of its documents, and what is still missing is fitted by a bounded knapsack
  over the counts that are left.
* Which documents of a length are taken follows from a seeded hash, so reruns agree and no rows are sorted as
  a whole: only the one hash stripe that the count cuts through is ranked.

A null text has no words; documents without words are taken zero words. Ids may be null or repeated: rows of
one id and one length are told apart by their texts, equal rows by nothing but their number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.rows import fields, whole
from sieveline.operators.skew import positions
from sieveline.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
STRIPES = 256
#: Words that the fit covers, and documents of each length that it may choose anew.
TABLE = 1 << 16
SLACK = 16
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, carry: bool = False) -> DataFrame:
    """_id, _source, size and the seeded hash of each row; with ``carry`` also the row itself."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col), text, F.lit(seed)).alias("_hash"),
        *([whole(docs).alias("_row")] if carry else []),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """_source, source_size, target. Only sums travel to the driver, a few per round of sharing."""
    sources = materialise(sizes.groupBy("_source").agg(F.sum("size").alias("source_size")))
    ranked = materialise(ranks(sources).withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).drop("rank"))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    ceiling = F.col("source_size") * F.lit(repeats)
    level, full = None, F.lit(False)
    while True:
        row = ranked.agg(
            F.sum(F.when(full, ceiling).otherwise(0)).alias("given"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"), F.sum(F.when(full, 1).otherwise(0)).alias("n")
        ).first()
        if not row.open:
            break
        new = (share * total - row.given) / row.open
        if level is not None and new == level:
            break
        level = new
        full = full | (F.col("weight") * F.lit(float(level)) > ceiling)
    target = ceiling.cast("double") if level is None else F.when(full, ceiling.cast("double")).otherwise(F.col("weight") * F.lit(float(level)))
    return ranked.select("_source", "source_size", target.alias("target"))


def ranks(sources: DataFrame) -> DataFrame:
    """Each source's place by code point, null last; sources are counted in slices, never all in one task."""
    order = [F.col("_source").isNull(), F.coalesce(F.col("_source"), F.lit(""))]
    return positions(sources.withColumn("_all", F.lit(0)), ["_all"], order, out="rank").drop("_all")


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length sum up to the most that is not above the budget: bounded subset sums as bit rows.

    While more than a table's width is missing, large lengths are taken greedily.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    order = np.argsort(-lengths)
    room = int(budget)
    some = lengths[counts > 0]
    width = int(min(room, max(4 * int(some.min(initial=0)), min(4 * int(some.max(initial=0)), TABLE))))
    for k in order:
        if room <= width:
            break
        use = min(int(counts[k]), (room - width) // int(lengths[k]) if lengths[k] else 0)
        take[k] += use
        room -= use * int(lengths[k])
    items = []  # (index, multiple): binary parts of what is left of each length
    for k in order[::-1]:
        left, part = min(int(counts[k] - take[k]), room // int(lengths[k]) if lengths[k] else 0), 1
        while left > 0:
            use = min(part, left)
            items.append((k, use))
            left, part = left - use, part * 2
    reach, mask, stages = 1, (1 << (room + 1)) - 1, []
    for k, use in items:
        stages.append(reach)
        reach |= (reach << (int(lengths[k]) * use)) & mask
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for (k, use), had in zip(reversed(items[: len(stages)]), reversed(stages)):
        if not had >> at & 1:
            take[k] += use
            at -= int(lengths[k]) * use
    return take


def quotas(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length fill the budget: an equal share of each length, the rest fitted."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    share = (counts * (budget / total)).astype(np.int64) if total else np.zeros_like(counts)
    share = np.maximum(np.minimum(share, counts) - SLACK, 0)  # what the fit may choose from again
    return share + knapsack(lengths, counts - share, budget - int((lengths * share).sum()))


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE, repeats: int = REPEATS, seed: int = 11, carry: bool = False,
) -> DataFrame:
    """One row per row: _id, size, source_size, target (its source's), copies (how often the mix takes it), taken.

    With ``carry``: _row (the whole row) and copies only.
    """
    rows = materialise(sized(docs, id_col, text_col, source_col, seed))
    aims = materialise(targets(rows, weights, share, repeats))
    lengths = rows.filter("size > 0").groupBy("_source", "size").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("_source").eqNullSafe(F.col("_aim"))
    side = aims.select(F.col("_source").alias("_aim"), "source_size", "target")
    # One histogram per source: as many rows as it has lengths, less than the root of twice its size.
    histograms = lengths.join(side, same).select("_source", "size", "n", "source_size", "target")

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        whole = int(group["source_size"].iloc[0])
        target = float(group["target"].iloc[0])
        passes = min(int(target // whole), repeats)
        budget = round(target) - passes * whole if passes < repeats else 0
        sizes, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
        extra = quotas(sizes, counts, max(budget, 0))
        return pd.DataFrame({"_source": group["_source"].to_numpy(), "size": sizes, "passes": passes, "quota": extra})

    kind = docs.schema[source_col].dataType.simpleString()
    chosen = materialise(histograms.groupBy("_source").applyInPandas(fitted, f"_source {kind}, size long, passes int, quota long"))
    stripe = F.pmod(F.col("_hash"), F.lit(STRIPES)).cast("int")
    counts = rows.filter("size > 0").groupBy("_source", "size", stripe.alias("_stripe")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_source", "size").orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = chosen.select(F.col("_source").alias("_s"), F.col("size").alias("_z"), "passes", "quota")
    stripes = first.join(cut, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))).select(
        F.col("_source").alias("_s"), F.col("size").alias("_z"), F.col("_stripe").alias("_t"), "passes",
        F.least(F.greatest(F.col("quota") - F.col("_before"), F.lit(0)), F.col("n")).alias("room"), (F.col("quota") - F.col("_before")).between(1, F.col("n") - 1).alias("split"),
    )
    placed = (sized(docs, id_col, text_col, source_col, seed, carry=True) if carry else rows).withColumn("_stripe", stripe).join(
        stripes, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_stripe") == F.col("_t")), "left"
    )
    inside = Window.partitionBy("_source", "size", "_stripe").orderBy("_hash", "_id")
    ranked = placed.filter("split").withColumn("_extra", (F.row_number().over(inside) <= F.col("room")).cast("int"))
    plain = placed.filter("split is null or not split").withColumn("_extra", (F.coalesce("room", F.lit(0)) > 0).cast("int"))
    counted = ranked.unionByName(plain).withColumn("copies", F.coalesce("passes", F.lit(0)) + F.col("_extra"))
    if carry:
        return counted.select("_row", "copies")
    return (
        counted.join(side, same)
        .select("_id", "_hash", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves: each as often as the mix takes it."""
    found = mixed(docs, carry=True, **options).filter("copies > 0")
    return found.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select(*fields(docs.columns))
