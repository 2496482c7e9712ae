"""Joins, ranks and broadcasts that hold when one key has a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_KEYS = 1_000
SLICES = 512
SAMPLE_PER_SLICE = 16
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint only when the frame is counted to be within the bound; else Spark decides."""
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def join_per_key(rows: DataFrame, per_key: DataFrame, keys: list[str], size_col: str) -> DataFrame:
    """Attach a one-row-per-key table to rows of which a few keys may hold most.

    The HOT_KEYS largest keys (a top-k by ``size_col``, so at most that many rows) are broadcast and
    joined where the rows already are. Every other key holds less than 1/HOT_KEYS of the rows and
    takes the ordinary shuffle join. Each row passes exactly one of the two. A null key matches null.
    """
    extra = [c for c in per_key.columns if c not in keys]
    side = per_key.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct(*extra).alias("_found"))
    hot = side.orderBy(F.col(f"_found.{size_col}").desc(), *[f"_k_{k}" for k in keys]).limit(HOT_KEYS)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    marked = rows.join(F.broadcast(hot), same, "left").select(*rows.columns, "_found")
    done = marked.filter(F.col("_found").isNotNull())
    rest = marked.filter(F.col("_found").isNull()).drop("_found").join(side, same).select(*rows.columns, "_found")
    return done.unionByName(rest).select(*rows.columns, "_found.*")


def positions(
    df: DataFrame, groups: list[str], order: list[Column], out: str = "position"
) -> DataFrame:
    """1-based position of every row in its group, without a group ever meeting in one task.

    ``groups`` are never null; ``order`` are ascending sort keys ending in a unique one. A bounded
    sample of the sort keys (the rows with the smallest key hashes, the same on every run) gives the
    boundaries of some hundred slices, more on a cluster with more shuffle partitions; a row's slice is
    the number of boundaries below it. Slices are counted, ranked alone, and shifted by the rows of the
    earlier slices of their group.
    """
    slices = max(SLICES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sort_key = F.struct(*[F.col(g) for g in groups], *[c.alias(f"k{i}") for i, c in enumerate(order)])
    keyed = df.withColumn("_key", sort_key)
    sample = (
        keyed.select(F.xxhash64("_key").alias("h"), F.col("_key").alias("k"))
        .orderBy("h", "k")
        .limit(slices * SAMPLE_PER_SLICE)
        .agg(F.array_sort(F.collect_list("k")).alias("ks"))
    )
    step = F.greatest(F.lit(1), F.floor(F.size("ks") / slices)).cast("int")
    bounds = sample.select(F.filter("ks", lambda k, i: (i % step == 0) & (i > 0)).alias("bounds"))
    # Binary search: each halving step moves past the boundaries that lie below the row's key.
    top = 1 << slices.bit_length()
    halvings = F.array(*[F.lit(top >> i) for i in range(top.bit_length())])
    sliced = keyed.withColumn("_bounds", bounds.scalar()).withColumn(
        "_slice",
        F.aggregate(
            halvings,
            F.lit(0),
            lambda low, width: F.when(F.get("_bounds", low + width - 1) < F.col("_key"), low + width).otherwise(low),
        ),
    ).drop("_bounds")
    counts = sliced.groupBy(*groups, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*groups, "_slice").orderBy("_key")
    return (
        sliced.join(offsets, [*groups, "_slice"])
        .withColumn(out, (F.row_number().over(inside) + F.col("_offset")).cast("bigint"))
        .select(*df.columns, out)
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The last row per key by ``order``, reduced map-side: no sort, no window, no hot partition."""
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last"))
        .select(*keys, "_last.*")
    )


def spread(df: DataFrame, *keys: str, per_core: int = 1) -> DataFrame:
    """Deal the rows out evenly, but only when the input has fewer partitions than there are cores to use.

    ``per_core`` asks for that many partitions a core, where rows take long and a last uneven round would be felt.

    ``keys`` together tell the rows apart, so no value holds many of them and what follows adds up before it
    shuffles; unlike a round-robin deal, a deal by hash sorts nothing. On a cluster reading many files this is the
    frame itself.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts, *keys)


def deal_rows(df: DataFrame, per_core: int = 4) -> DataFrame:
    """Rows of a table that take long each, dealt out evenly if few of its partitions hold most of them.

    A file's row group is read by one task, however many splits the file is planned in, so the rows that each
    partition holds are counted first (of files only the footers are read). The deal is by the row's place: keys may
    repeat or be null.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism * per_core, df.rdd.getNumPartitions())
    held = df.select(F.spark_partition_id().alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    most, total = held.agg(F.max("n"), F.sum("n")).first()
    if not total or most * n <= 2 * total:
        return df
    return df.withColumn("_place", F.monotonically_increasing_id()).repartition(n, "_place").drop("_place")
