"""The trie of conversation prefixes: one ROLLUP over positional turn columns.

A turn is known by 128 bits of the SHA-256 of its role and text. A conversation is cut into blocks of ``BLOCK``
turns, one row each, with the turns in columns t1, t2, ...; the node in front of a block is known by the
exclusive or of hashes of (depth, turn) over all earlier turns. One ``GROUP BY block, node in front,
ROLLUP(t1, t2, ...)`` then aggregates the prefixes of every length of every block together, and grouping_id
tells how long each is. So a conversation of any length takes one pass, not one for each block.

What a subtree holds follows from sums over members. The smallest member owns a node; what a conversation owns is
the end of its path, so it shares its first U characters with smaller ones. Each member but the owner saves its U,
less what stands above the node, and the leaves below are the members that own the leaf they end in. The first
rollup finds the owners, the second adds up the members' U and leaves.

Turns of one conversation stand by turn (nulls first), then role, then the text's SHA-256. A null role or text is
empty; rows without a conversation id belong to none and are left out; an empty table has no nodes; extra columns
aren't read. The ids that end in a node are digested as a stream, a few thousand at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.skew import join_per_key, positions
from sieveline.session import materialise

BLOCK = 4
#: Blocks whose running sums are formed together.
RUN = 4096
#: Heads of this many turns are shared.
HEAD = 5


def turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, said, chars): every turn's place in its conversation, what it says, and how long its text is."""
    empty = F.lit("")
    role_, text_ = F.coalesce(F.col(f"`{role}`"), empty), F.coalesce(F.col(f"`{text}`"), empty)
    said = F.sha2(F.concat(F.length(role_).cast("string"), F.lit(":"), role_, text_), 256)
    slim = rows.filter(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").isNotNull().alias("timed"),
        F.coalesce(F.col(f"`{turn}`").cast("long"), F.lit(0)).alias("turn"), role_.alias("role"), F.sha2(text_, 256).alias("sha"),
        F.unhex(F.substring(said, 1, 32)).alias("said"), F.length(text_).cast("long").alias("chars"),
    )
    placed = positions(slim, ["conv"], [F.col(c) for c in ("timed", "turn", "role", "sha")], "place")
    return materialise(placed.select("conv", "place", "said", "chars"))


def with_shared_heads(placed: DataFrame, every: int = 100, most: int = HEAD) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of conversation c - c % every, then c's own after its first h; and all ids.

    h is crc32 of the decimal id modulo ``most`` + 1.
    """
    size = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("_n"))
    convs = size.withColumns({"head": (F.crc32(F.col("conv").cast("string")) % (most + 1)).cast("int"), "base": F.col("conv") - F.col("conv") % every})
    heads = (
        placed.filter((F.col("conv") % every == 0) & (F.col("place") <= most))
        .groupBy("conv")
        .agg(F.array_sort(F.collect_list(F.struct("place", "said", "chars"))).alias("_first"))
    )
    led = convs.join(heads.withColumnRenamed("conv", "base"), "base", "left").withColumn(
        "_first", F.when(F.col("_first").isNull(), F.array().cast("array<struct<place:bigint,said:binary,chars:bigint>>")).otherwise(F.expr("slice(_first, 1, head)"))
    )
    led = materialise(led.select("conv", "_n", "head", "_first"))
    front = led.select("conv", F.explode("_first").alias("t")).select("conv", "t.place", "t.said", "t.chars")
    shift = led.select("conv", "_n", "head", F.size("_first").alias("got"))
    own = join_per_key(placed, shift, ["conv"], "_n").filter("place > head")
    rest = own.select("conv", (F.col("place") - F.col("head") + F.col("got")).alias("place"), "said", "chars")
    return front.unionByName(rest), led.select("conv")


def blocks(placed: DataFrame, convs: DataFrame, width: int, run: int) -> DataFrame:
    """One row per ``width`` turns: t1.., c1.., the node in front (x, y), characters before, and the conversation's turns."""
    at = F.pmod(F.col("place") - 1, F.lit(width)) + 1
    marks = marks_of(F.col("place"), F.col("said"))
    cut = (
        placed.withColumns({"block": F.expr(f"(place - 1) div {width}"), "at": at, "mx": marks[0], "my": marks[1]})
        .groupBy("conv", "block")
        .agg(
            *[F.max(F.when(F.col("at") == j, F.col("said"))).alias(f"t{j}") for j in range(1, width + 1)],
            *[F.max(F.when(F.col("at") == j, F.col("chars"))).alias(f"c{j}") for j in range(1, width + 1)],
            F.bit_xor("mx").alias("mx"), F.bit_xor("my").alias("my"), F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("n"),
        )
        .withColumn("run", F.expr(f"block div {run}"))
    )
    # Running sums: within runs of blocks, and over the runs.
    sums = {"mx": F.bit_xor, "my": F.bit_xor, "chars": F.sum}
    whole = cut.groupBy("conv", "run").agg(*[f(c).alias(c) for c, f in sums.items()], F.sum("n").alias("n"))
    over = Window.partitionBy("conv")
    earlier = over.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    outer = whole.select(
        "conv", "run", *[F.coalesce(f(c).over(earlier), F.lit(0)).alias(f"o{c}") for c, f in sums.items()],
        F.sum("chars").over(over).alias("total"), F.sum("n").over(over).alias("turns"),
    )
    inside = Window.partitionBy("conv", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = {c: F.coalesce(f(c).over(inside), F.lit(0)) for c, f in sums.items()}
    laid = cut.join(outer, ["conv", "run"]).select(
        "conv", "block", *[f"{k}{j}" for k in "tc" for j in range(1, width + 1)],
        before["mx"].bitwiseXOR(F.col("omx")).alias("x"), before["my"].bitwiseXOR(F.col("omy")).alias("y"),
        (before["chars"] + F.col("ochars")).alias("above"), "total", "turns",
    )
    silent = convs.join(laid.filter("block = 0").select("conv"), "conv", "left_anti")
    zero = F.lit(0).cast("long")
    nobody = silent.select(
        "conv", zero.alias("block"), *[F.lit(None).cast("binary").alias(f"t{j}") for j in range(1, width + 1)],
        *[F.lit(None).cast("long").alias(f"c{j}") for j in range(1, width + 1)], *[zero.alias(c) for c in ("x", "y", "above", "total", "turns")],
    )
    return laid.unionByName(nobody)


def marks_of(place: Column, said: Column) -> tuple[Column, Column]:
    """What a turn adds to the hashes of the prefixes that hold it."""
    return F.xxhash64(place, said), F.xxhash64(said, F.lit(1), place)


def picked(level: Column, columns: list[str], width: int) -> Column:
    """The column of the level (1..width); null at level 0."""
    return F.get(F.array(*columns[:width]), (level - 1).cast("int"))


def rolled(cut: DataFrame, width: int, more: dict[str, str]) -> DataFrame:
    """All prefixes: depth, the node (x, y), the node above it (px, py), members, their smallest, and the sums of ``more``."""
    names = [f"t{j}" for j in range(1, width + 1)]
    sums = [f"max(c{j}) AS c{j}" for j in range(1, width + 1)] + [f"sum({v}) AS {k}" for k, v in more.items()]
    found = cut.sparkSession.sql(
        f"""SELECT block, x, y, {", ".join(names)}, {width} - bit_count(grouping_id()) AS level, count(*) AS n_convs, min(conv) AS owner,
                   max(turns) AS longest, max(above) AS front, {", ".join(sums)}
            FROM {{cut}} GROUP BY block, x, y, ROLLUP({", ".join(names)})""",
        cut=cut,
    )
    # A conversation that ends within the block has no turn at the deeper levels.
    found = found.filter(F.when(F.col("level") == 0, F.col("block") == 0).otherwise(picked(F.col("level"), names, width).isNotNull()))
    depth = F.col("block") * width
    marks = found.withColumn("_m", F.array(*[F.struct(*[m.alias(n) for m, n in zip(marks_of(depth + j, F.col(f"t{j}")), "xy")]) for j in range(1, width + 1)]))

    def up_to(side: str, upper: Column) -> Column:
        return F.aggregate(F.slice("_m", F.lit(1), upper), F.col(side), lambda a, m: a.bitwiseXOR(m[side]))

    above = F.aggregate(F.slice(F.array(*[f"c{j}" for j in range(1, width + 1)]), F.lit(1), F.greatest(F.col("level") - 1, F.lit(0))), F.col("front"), lambda a, c: a + c)
    return marks.select(
        (depth + F.col("level")).alias("depth"), up_to("x", F.col("level")).alias("nx"), up_to("y", F.col("level")).alias("ny"),
        up_to("x", F.greatest(F.col("level") - 1, F.lit(0))).alias("px"), up_to("y", F.greatest(F.col("level") - 1, F.lit(0))).alias("py"),
        "level", "n_convs", "owner", "longest", above.alias("above"), *more,
    )


def end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each node, from slices of them that come sorted."""
    names, now, digest = ["depth", "nx", "ny"], None, None

    def told(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r[3] for r in rows], pa.string())], names=[*names, "ends_sha256"])

    for batch in batches:
        done = []
        for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*names, "ids"))):
            if key != now:
                if now is not None:
                    done.append((*now, digest.hexdigest()))
                now, digest = key, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield told(done)
    if now is not None:
        yield told([(*now, digest.hexdigest())])


def nodes(placed: DataFrame, convs: DataFrame, width: int = BLOCK, run: int = RUN) -> DataFrame:
    """Every node of the trie: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    cut = materialise(blocks(placed, convs, width, run))
    first = materialise(rolled(cut, width, {}))
    key = ["depth", "nx", "ny"]
    # What each conversation owns: from which node on, what it shares above that, and whether it ends in a leaf.
    owned = first.groupBy("owner").agg(
        F.min(F.struct("depth", "px", "py")).alias("top"), F.min("above").alias("shared"),
        F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"), F.count(F.lit(1)).alias("n_nodes"),
    )
    hung = owned.filter("top.depth > 0").select(F.col("owner").alias("conv"), (F.col("top.depth") - 1).alias("depth"), F.col("top.px").alias("nx"), F.col("top.py").alias("ny"))
    parents = join_per_key(hung, first.select(*key, F.col("owner").alias("parent"), "n_convs"), key, "n_convs").select("conv", "parent")
    mine = owned.select(F.col("owner").alias("conv"), F.col("top.depth").alias("from"), "shared", "leaf", "n_nodes")
    known = cut.filter("block = 0").select("conv", "total", "turns").join(mine, "conv", "left").join(parents, "conv", "left")
    # A conversation that owns nothing shares all its turns.
    facts = materialise(known.withColumns({"shared": F.coalesce("shared", "total"), "leaf": F.coalesce("leaf", F.lit(0)), "n_blocks": F.expr(f"(turns + {width - 1}) div {width}")}))
    lit = join_per_key(cut, facts.select("conv", "shared", "leaf", "from", "n_blocks"), ["conv"], "n_blocks")
    begun = {f"s_below{j}": f"CASE WHEN from = block * {width} + {j + 1} THEN 1 ELSE 0 END" for j in range(width + 1)}
    second = rolled(lit, width, {"s_shared": "shared", "s_leaves": "leaf", **begun})
    owners = facts.filter("n_nodes > 0").select(F.col("conv").alias("owner"), "from", "shared", "turns", "parent", "n_nodes")
    told = join_per_key(second, owners, ["owner"], "n_nodes")
    # Children: conversations whose own part begins right below, and the owner's own way on.
    hanging = F.get(F.array(*begun), F.col("level").cast("int"))
    children = hanging + (F.col("turns") > F.col("depth")).cast("long")
    saved = F.col("s_shared") - F.col("shared") - (F.col("n_convs") - 1) * F.col("above")
    ended = cut.filter(f"block = greatest((turns + {width - 1}) div {width} - 1, 0)")
    nx, ny = F.col("x"), F.col("y")
    for j in range(1, width + 1):
        a, b = marks_of(F.col("block") * width + j, F.col(f"t{j}"))
        there = F.col(f"t{j}").isNotNull()
        nx, ny = nx.bitwiseXOR(F.when(there, a).otherwise(0)), ny.bitwiseXOR(F.when(there, b).otherwise(0))
    ended = ended.select(F.col("turns").alias("depth"), nx.alias("nx"), ny.alias("ny"), "conv")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    slices = ended.withColumn("slice", F.shiftright("conv", 12)).groupBy(*key, "slice").agg(joined.alias("ids"))
    hashed = slices.repartition(*key).sortWithinPartitions(*key, "slice").mapInArrow(end_digests, "depth long, nx long, ny long, ends_sha256 string")
    return told.join(hashed, key, "left").select(
        F.col("owner").alias("conv_id"), "depth",
        F.when(F.col("depth") == 0, None).when(F.col("depth") > F.col("from"), F.col("owner")).otherwise(F.col("parent")).alias("parent_conv_id"),
        "n_convs", children.alias("n_children"), F.col("s_leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", width: int = BLOCK, run: int = RUN) -> DataFrame:
    """The trie of the conversations as they stand."""
    placed = turns(rows, conv, turn, role, text)
    return nodes(placed, placed.select("conv").distinct(), width, run)
