"""Conversations mended to (system, then user and assistant in turn) by the cheapest edits.

Every row has one fault at most: blank, duplicate (role and text seen earlier) or truncated. Edits keep a row
(0), give it the role that fits (3), delete it (4; blank and duplicate rows must go) or insert an empty
turn (3); a truncated row that stays costs 3 more. The first letters of the roles that stay must read
``(s?(ua)+)?``. Of equally cheap ways that with the least audit (the edits' first letters) is taken.

Conversations are cut into stretches of ``STRETCH`` rows, each one string of codes. A stretch is a matrix of
costs from state to state, and matrices of neighbouring stretches multiply, so a conversation that holds
a third of all rows is summed up in a few rounds of groups; no task sees more than some stretches. Given the costs
behind a stretch, every (row, state) knows its optimal edits. Nodes are then ranked by the first 1, 2, 4, ...
letters of their least audit: a rank is the pair of the node's rank and that of the node half as many letters
on, which the doubled pointers name. Each node takes the optimal edit with the least (letter, rank of
where it leads), and the doubled pointers read the audit off.

Rows stand by turn (nulls first), then role, then the text's SHA-256. Nulls are one space; a null id is a
conversation of its own. Conversations without rows get zeros and an empty audit. Extra columns aren't read.
A conversation's digest and audit are single values, so their bytes stream through one task, row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieveline.operators.skew import join_per_key, positions
from sieveline.session import materialise

STRETCH = 1024
#: Stretches, or groups of them, that are multiplied in one task.
FAN = 256
#: Rows whose matrices are in memory at once.
ROWS_AT_ONCE = 1 << 15

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = np.int64(1) << 50
#: What has been said so far: nothing, the system's turn, a user's, an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state behind a turn that an edit is free to choose (rerole, insert).
FORCED = np.array([USER, USER, ASSISTANT, USER])
#: The state behind a kept row by its first letter (none, s, u, a); -1: it doesn't fit.
KEPT = np.array([[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]])
#: Edits in the order of their letters.
EDITS = np.array([0, *b"DIKR"], dtype=np.uint8)
CODES = "0123456789ABCDEF"


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text) after damage by crc32 of ``conv:turn``: rows dropped, emptied, cut short, repeated or given to the user."""
    space = F.lit(" ")
    said = rows.select(
        F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), space).alias("role"), F.coalesce(F.col(f"`{text}`"), space).alias("text"),
    )
    key = F.concat(F.coalesce(F.col("conv").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key) % 20
    return (
        said.withColumn("kind", kind)
        .filter("kind <> 0")
        .withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
        .withColumn("text", F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
        .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select("conv", "turn", "role", "text")
    )


def sortable(rows: DataFrame) -> DataFrame:
    """What a row is told apart and sorted by, without its text, and its own fault."""
    tail = F.substring(F.rtrim(F.translate("text", "\t\n\x0b\f\r", "     ")), -1, 1)
    initial = F.substring("role", 1, 1)
    return rows.select(
        F.col("conv").isNotNull().alias("named"), F.coalesce("conv", F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("timed"), F.coalesce("turn", F.lit(0)).alias("turn"),
        "role", F.sha2("text", 256).alias("sha"),
        F.when(tail == "", 1).when(~tail.isin(".", "!", "?"), 3).otherwise(0).alias("own"),
        F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(0).alias("letter"),
    )


def faulty(rows: DataFrame) -> DataFrame:
    """Rows with their place in the conversation and fault: 0 none, 1 blank, 2 duplicate, 3 truncated."""
    key = ["named", "conv", "role", "sha"]
    placed = materialise(positions(rows, ["named", "conv"], [F.col(c) for c in ("timed", "turn", "role", "sha")], "place"))
    first = placed.groupBy(*key).agg(F.min("place").alias("_first"), F.count(F.lit(1)).alias("_n"))
    seen = join_per_key(placed, first, key, "_n")
    fault = F.when(F.col("own") == 1, 1).when(F.col("place") > F.col("_first"), 2).otherwise(F.col("own"))
    return seen.withColumn("fault", fault.cast("int")).drop("_first", "_n", "own")


def stretches(rows: DataFrame, size: int) -> DataFrame:
    """One row per ``size`` rows of a conversation: their codes as a string, and the letter of the row before."""
    code = F.substring(F.lit(CODES), F.col("fault") * 4 + F.col("letter") + 1, F.lit(1))
    numbered = rows.withColumn("code", code).withColumn("stretch", F.expr(f"(place - 1) div {size}"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]), "")
    cut = numbered.groupBy("named", "conv", "stretch").agg(joined.alias("codes"))
    before = F.lag(F.substring("codes", -1, 1)).over(Window.partitionBy("named", "conv").orderBy("stretch"))
    # A window over the stretches alone: one row for each ``size`` rows.
    return cut.withColumn("before", F.coalesce(before, F.lit("")))


# ------------------------------------------------------------------ costs
def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrices of least costs, one after the other."""
    out = a[:, :, :1] + b[:, :1, :]
    for k in range(1, 4):
        np.minimum(out, a[:, :, k : k + 1] + b[:, k : k + 1, :], out=out)
    return np.minimum(out, FAR)


def unit(n: int) -> np.ndarray:
    out = np.full((n, 4, 4), FAR)
    out[:, range(4), range(4)] = 0
    return out


def row_arcs(letter: np.ndarray, fault: np.ndarray) -> np.ndarray:
    """Cost of each row's (delete, keep, rerole) from each state; FAR where it can't be."""
    stays = np.where(fault == 3, TRUNCATED, np.where(fault == 0, 0, FAR))[:, None]
    keep = np.where(KEPT.T[letter] >= 0, KEEP + stays, FAR)
    return np.stack([np.full(keep.shape, DELETE), keep, np.broadcast_to(np.minimum(REROLE + stays, FAR), keep.shape)], axis=2)


def row_matrices(letter: np.ndarray, arcs: np.ndarray) -> np.ndarray:
    """Least cost from state to state over one row, inserted turns ahead of it included."""
    n = len(letter)
    plain = np.full((n, 4, 4), FAR)
    every = np.arange(n)
    for q in range(4):
        for cost, to in ((arcs[:, q, 0], np.full(n, q)), (arcs[:, q, 1], np.maximum(KEPT.T[letter][:, q], 0)), (arcs[:, q, 2], np.full(n, FORCED[q]))):
            plain[every, q, to] = np.minimum(plain[every, q, to], cost)
    once = np.minimum(plain, plain[:, FORCED] + INSERT)
    return np.minimum(np.minimum(once, plain[:, FORCED[FORCED]] + 2 * INSERT), FAR)


def behind(own: np.ndarray, ends: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Cost to the end from each row on, by state: rows' own matrices times what follows, doubled up; ``last`` per stretch."""
    total, n, step = own.copy(), len(own), 1
    left = ends - np.arange(n)
    while step < left.max(initial=0):
        at = np.flatnonzero(left > step)
        total[at] = product(total[at], total[at + step])
        step *= 2
    return np.minimum((total + last[:, None, :]).min(axis=2), FAR)


def decoded(codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters, faults, and where each string begins (one more than strings)."""
    text = codes.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[int(offsets[0]) : int(offsets[-1])] if data is not None else np.zeros(0, dtype=np.uint8)
    number = np.where(raw >= 65, raw.astype(np.int64) - 55, raw.astype(np.int64) - 48)
    return number % 4, number // 4, offsets - offsets[0]


def parts(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` rows of conversations."""
    sizes = np.cumsum(batch.column("codes").cast(pa.large_string()).to_pandas().str.len().to_numpy())
    begin = 0
    while begin < len(batch):
        limit = (sizes[begin - 1] if begin else 0) + most
        end = max(begin + 1, int(np.searchsorted(sizes, limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def whole_matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each stretch's matrix of costs."""
    for batch in batches:
        for part in parts(batch, ROWS_AT_ONCE):
            letter, fault, offsets = decoded(part.column("codes"))
            own = row_matrices(letter, row_arcs(letter, fault))
            count = np.diff(offsets)
            out, step = own, 1
            left = np.repeat(offsets[1:], count) - np.arange(len(own))
            while step < left.max(initial=0):
                at = np.flatnonzero(left > step)
                out[at] = product(out[at], out[at + step])
                step *= 2
            yield pa.RecordBatch.from_arrays([part.column(c) for c in ("named", "conv", "stretch")] + [matrices(out[offsets[:-1]])], names=["named", "conv", "stretch", "m"])


def matrices(values: np.ndarray) -> pa.Array:
    n = len(values)
    width = values[0].size if n else 16
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.reshape(-1)))


def matrix_values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), 4, 4)


# ------------------------------------------------------------------ sums over the stretches of long conversations
def product_of_group(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("stretch")
    out = unit(1)
    for m in matrix_values(rows.column("m").combine_chunks()):
        out = product(out, m[None])
    head = rows.slice(0, 1)
    return pa.table({"named": head["named"], "conv": head["conv"], "stretch": head["group"], "m": matrices(out)})


def before_in_group(backwards: bool):
    def work(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("stretch")
        own, outer = matrix_values(rows.column("m").combine_chunks()), matrix_values(rows.column("outer").combine_chunks())[:1]
        out, state = np.empty_like(own), outer
        for i in range(len(own))[:: -1 if backwards else 1]:
            out[i] = state[0]
            state = product(own[i][None], state) if backwards else product(state, own[i][None])
        return pa.table({"named": rows["named"], "conv": rows["conv"], "stretch": rows["stretch"], "sum": matrices(out)})

    return work


def sums(rows: DataFrame, backwards: bool, fan: int) -> DataFrame:
    """For each stretch the product of all before it (or behind it) in its conversation: groups of ``fan``, then groups of groups."""
    longest = rows.agg(F.max("stretch")).first()[0]
    if not longest:
        same = F.array(*[F.lit(0 if i % 5 == 0 else int(FAR)).cast("long") for i in range(16)])
        return rows.select("named", "conv", "stretch", same.alias("sum"))
    keyed = rows.withColumn("group", F.expr(f"stretch div {fan}"))
    by = ["named", "conv", "group"]
    kinds = "named boolean, conv long, stretch long"
    above = materialise(keyed.groupBy(*by).applyInArrow(product_of_group, f"{kinds}, m array<long>"))
    outer = sums(above, backwards, fan).select("named", "conv", F.col("stretch").alias("group"), F.col("sum").alias("outer"))
    return keyed.join(outer, by).groupBy(*by).applyInArrow(before_in_group(backwards), f"{kinds}, sum array<long>")


# ------------------------------------------------------------------ least audits
def optimal_edits(letter: np.ndarray, arcs: np.ndarray, togo: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(optimal, to) of each node's D, I, K, R. Nodes are (row, state); a stretch has one row of nodes more than rows.

    ``togo`` are the costs to the end by node row, ``first`` each row's node row.
    """
    n = len(togo)
    ok, to = np.zeros((n, 4, 4), dtype=bool), np.zeros((n, 4, 4), dtype=np.int64)
    here = np.arange(n)[:, None] * 4
    to[:, :, 1] = here + FORCED
    ok[:, :, 1] = togo[:, FORCED] + INSERT == togo
    behind_row = (first + 1)[:, None] * 4
    kept = KEPT.T[letter]
    for e, cost, target in ((0, arcs[:, :, 0], np.arange(4)[None]), (2, arcs[:, :, 1], np.maximum(kept, 0)), (3, arcs[:, :, 2], FORCED[None])):
        to[first, :, e] = behind_row + target
        cost_to = cost + np.take_along_axis(togo[first + 1], np.broadcast_to(target, cost.shape), axis=1)
        ok[first, :, e] = (cost_to == togo[first]) & (cost < FAR)
    return ok, to


def ranked(ok: np.ndarray, to: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Each node's letter of its least audit (0: none), and the pointers 1, 2, 4, ... letters on."""
    n = ok.shape[0]
    node = np.arange(n)
    ends = ~ok.any(axis=1)
    edit = np.where(ends, 0, ok.argmax(axis=1))
    rank = np.where(ends, 0, edit + 1).astype(np.int64)
    step, length = np.where(ends, node, to[node, edit]), 1
    while length < longest:
        # Rank of twice as many letters: this node's and that of the node reached.
        _, rank = np.unique(rank * (n + 5) + rank[step], return_inverse=True)
        step, length = step[step], length * 2
    # Of the optimal edits, that with the least letter, then the least rank behind it.
    worth = np.where(ok, (np.arange(4) + 1) * (n + 5) + rank[to], np.iinfo(np.int64).max)
    edit = worth.argmin(axis=1)
    letters = np.where(ends, 0, edit + 1)
    doubled = [np.where(ends, node, to[node, edit])]
    for _ in range(max(longest - 1, 0).bit_length()):
        doubled.append(doubled[-1][doubled[-1]])
    return letters, rank, doubled


def read_off(begin: np.ndarray, letters: np.ndarray, doubled: list[np.ndarray], steps: int) -> tuple[list[bytes], np.ndarray]:
    """The audit from each node on, and the node where it ends: paths twice as long with each pointer."""
    path = begin[:, None]
    for k in range(steps):
        path = np.concatenate([path, doubled[k][path]], axis=1)
    return [bytes(r).rstrip(b"\0") for r in EDITS[letters[path]]], doubled[steps][begin]


def audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each stretch, by the state it begins in: the audit, the state behind it, the cost to the end; and what is counted in it."""
    for batch in batches:
        for part in parts(batch, ROWS_AT_ONCE):
            letter, fault, offsets = decoded(part.column("codes"))
            count, m = np.diff(offsets), len(part)
            arcs = row_arcs(letter, fault)
            last = np.asarray(part.column("last").to_numpy(zero_copy_only=False), dtype=bool)
            after = matrix_values(part.column("sum"))
            # What lies behind a stretch, and behind it all the end: nothing said, or an assistant's turn; else turns are inserted.
            end = np.array([0, 2 * INSERT, INSERT, 0])
            tail = np.minimum((after + end).min(axis=2), FAR)
            rows_end = behind(row_matrices(letter, arcs), np.repeat(offsets[1:], count), np.repeat(tail, count, axis=0))
            first = np.arange(len(letter)) + np.repeat(np.arange(m), count)
            edge = offsets[1:] + np.arange(m)
            togo = np.empty((len(letter) + m, 4), dtype=np.int64)
            togo[first], togo[edge] = rows_end, tail
            ok, to = optimal_edits(letter, arcs, togo, count, first)
            ok[edge[~last]] = False  # the next stretch goes on from here
            size = 2 * count + 2
            letters, _, doubled = ranked(ok.reshape(-1, 4), to.reshape(-1, 4), int(size.max(initial=1)))
            head = offsets[:-1] + np.arange(m)
            out: list[list[bytes]] = [[b""] * 4 for _ in range(m)]
            exits = np.zeros((m, 4), dtype=np.int64)
            classes = np.ceil(np.log2(size)).astype(int)
            for steps in np.unique(classes):
                mine = np.flatnonzero(classes == steps)
                nodes = (head[mine][:, None] * 4 + np.arange(4)).ravel()
                texts, where = read_off(nodes, letters, doubled, int(steps))
                for k, i in enumerate(mine):
                    out[i] = texts[4 * k : 4 * k + 4]
                exits[mine] = (where % 4).reshape(-1, 4)
            counted = [np.bincount(np.repeat(np.arange(m), count), weights=fault == f, minlength=m).astype(np.int64) for f in (1, 2, 3)]
            before = np.array([(int(c, 16) % 4 if c else -1) for c in part.column("before").to_pylist()])
            earlier = np.concatenate([[0], letter[:-1]])
            earlier[offsets[:-1]] = np.where(before >= 0, before, 9)
            fits = ((earlier == SYSTEM) & (letter == USER)) | ((earlier == USER) & (letter == ASSISTANT)) | ((earlier == ASSISTANT) & (letter == USER))
            odd = np.bincount(np.repeat(np.arange(m), count), weights=~fits & (earlier != 9), minlength=m).astype(np.int64)
            names = ["named", "conv", "stretch", "last", "audits", "exits", "costs", "blank", "duplicate", "truncated", "illegal"]
            columns = [part.column(c) for c in names[:4]]
            columns += [pa.array([[t.decode() for t in x] for x in out], pa.list_(pa.string())), matrices(exits), matrices(togo[head])]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, counted), pa.array(odd)], names=names)


def exit_matrix() -> F.Column:
    """A stretch's states behind it, written as a matrix that multiplies like costs."""
    far = F.lit(int(FAR)).cast("long")
    return F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda i: F.when(F.get("exits", (i / 4).cast("int")) == i % 4, F.lit(0).cast("long")).otherwise(far),
    )


# ------------------------------------------------------------------ the whole
def mended_stretches(rows: DataFrame, size: int, fan: int) -> DataFrame:
    """(named, conv, stretch, audit, state it begins in, cost to the end, faults counted) of each stretch."""
    cut = materialise(stretches(rows, size))
    ends = cut.groupBy("named", "conv").agg(F.max("stretch").alias("_last"), F.count(F.lit(1)).alias("_n"))
    marked = join_per_key(cut, ends, ["named", "conv"], "_n").withColumn("last", F.col("stretch") == F.col("_last"))
    by = ["named", "conv", "stretch"]
    alone = marked.filter("_last = 0").select(*by, "codes", "before", "last", F.array(*[F.lit(0 if i % 5 == 0 else int(FAR)).cast("long") for i in range(16)]).alias("sum"))
    many = marked.filter("_last > 0")
    whole = materialise(many.select(*by, "codes").mapInArrow(whole_matrix, "named boolean, conv long, stretch long, m array<long>"))
    after = sums(whole, True, fan)
    ready = alone.unionByName(many.select(*by, "codes", "before", "last").join(after, by))
    kinds = "last boolean, audits array<string>, exits array<long>, costs array<long>, blank long, duplicate long, truncated long, illegal long"
    found = materialise(ready.mapInArrow(audits, f"named boolean, conv long, stretch long, {kinds}"))
    begun = sums(found.filter(~(F.col("last") & (F.col("stretch") == 0))).select(*by, exit_matrix().alias("m")), False, fan)
    state = (F.array_position(F.slice("sum", 1, 4), F.lit(0).cast("long")) - 1).cast("int")
    told = found.join(begun.select(*by, state.alias("state")), by, "left").withColumn("state", F.coalesce("state", F.lit(START)))
    return told.select(
        *by, F.get("audits", F.col("state")).alias("audit"), "state", F.get("costs", F.col("state")).alias("cost"),
        "blank", "duplicate", "truncated", "illegal",
    )


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's mended turns, from rows sorted by conversation and place."""
    now, digest, state, glue, key, edit = None, None, START, b"", None, ""

    def line(role: bytes, text: bytes) -> None:
        nonlocal glue
        digest.update(glue + role + b":")
        digest.update(text)
        glue = b"\n"

    def inserted(turns: int) -> None:
        nonlocal state
        for _ in range(turns):
            state = int(FORCED[state])
            line(b"user" if state == USER else b"assistant", b"")

    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("named", "conv", "turn", "timed", "role", "sha", "edit", "text")]
        for named, conv, turn, timed, role, sha, piece, text in zip(*columns):
            if (named, conv) != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest, state, glue, key = (named, conv), hashlib.sha256(), START, b"", None
            if piece is not None:
                inserted(piece.count("I"))
                key, edit = (timed, turn, role, sha), piece[-1:]
                continue
            if key != (timed, turn, role, sha):
                continue
            key = None
            if edit == "R":
                state = int(FORCED[state])
                line(b"user" if state == USER else b"assistant", text)
            else:
                state = int(KEPT[state][{"s": 1, "u": 2, "a": 3}[role[:1]]])
                line(role.encode(), text)
        yield told(out)
    if now is not None:
        yield told([(*now, digest.hexdigest())])


def told(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.bool_(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["named", "conv", "repaired_sha256"])


def repaired(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", everyone: DataFrame | None = None,
    size: int = STRETCH, fan: int = FAN,
) -> DataFrame:
    """Per conversation: _conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``everyone`` (a column ``conv``) names conversations that are told about even without rows.
    """
    said = rows.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    said = said.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    marked = materialise(faulty(sortable(said)))
    pieces = materialise(mended_stretches(marked, size, fan))
    who = ["named", "conv"]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stretch", "audit"))), lambda x: x["audit"]), "")
    summed = pieces.groupBy(*who).agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")],
        F.max(F.when(F.col("stretch") == 0, F.col("cost"))).alias("cost"), audit.alias("audit"),
    )
    # Each first row's edit, with the turns inserted ahead of it; turns inserted at the end come last.
    each = pieces.select(
        *who, "stretch", F.posexplode(F.regexp_extract_all("audit", F.lit("I*[KRD]|I+$"), F.lit(0))).alias("nth", "edit")
    ).withColumn("place", F.col("stretch") * size + F.col("nth") + 1)
    place = marked.select(*who, "place", "timed", "turn", "role", "sha")
    edits = each.join(place, [*who, "place"], "left").filter("edit <> 'D'")
    slim = edits.select(*who, (F.col("sha").isNull()).alias("tail"), "timed", "turn", "role", "sha", F.lit(0).alias("kind"), "place", "edit", F.lit(None).cast("binary").alias("text"))
    texts = sortable_with_text(said).select(
        *who, F.lit(False).alias("tail"), "timed", "turn", "role", "sha", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("string").alias("edit"), "text"
    )
    order = [*who, "tail", "timed", "turn", "role", "sha", "kind", "place"]
    stream = slim.unionByName(texts).repartition(*who).sortWithinPartitions(*order)
    hashed = stream.mapInArrow(digests, "named boolean, conv long, repaired_sha256 string")
    turns = marked.filter("timed").groupBy(*who, "turn").agg(F.count(F.lit(1)).alias("_n"))
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = turns.groupBy(*who).agg((wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count(F.lit(1))).try_cast("long").alias("gaps"))
    everyone = rows.select(F.col(f"`{conv}`").cast("long").alias("conv")) if everyone is None else everyone
    convs = everyone.select(F.col("conv").isNotNull().alias("named"), F.coalesce(F.col("conv").cast("long"), F.lit(0)).alias("conv")).distinct()
    whole = convs.join(summed, who, "left").join(hashed, who, "left").join(gaps, who, "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(
        F.when(F.col("named"), F.col("conv")).alias("_conv"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def sortable_with_text(said: DataFrame) -> DataFrame:
    return said.select(
        F.col("conv").isNotNull().alias("named"), F.coalesce("conv", F.lit(0)).alias("conv"),
        F.col("turn").isNotNull().alias("timed"), F.coalesce("turn", F.lit(0)).alias("turn"),
        "role", F.sha2("text", 256).alias("sha"), F.col("text").cast("binary").alias("text"),
    )
