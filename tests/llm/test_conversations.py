"""Prefix tries, structure repair and repeated windows against plain re-statements."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sieveline.llm import prefix_trie, registry, structure_repair, window_dedup

TURNS = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ SQL
@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_repeated_windows", "op13_structure_repair"])
def test_agrees_with_sql(spark, name):
    import oracle

    assert oracle.difference(spark, oracle.connect(SF), name, registry.QUERIES[name], registry.SQL[name], SF) is None


# ------------------------------------------------------------------ tries
def in_order(rows):
    """{conversation: [(role, text)]} by turn, nulls first."""
    found = {}
    for c, t, r, x in rows:
        if c is not None:
            found.setdefault(c, []).append((t is not None, t or 0, r or "", sha(x or ""), x or ""))
    return {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in found.items()}


def plain_trie(convs):
    members = {}
    for c, said in convs.items():
        for d in range(len(said) + 1):
            members.setdefault(tuple(said[:d]), []).append(c)
    out = set()
    for path, who in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = sum(not any(q[:-1] == p for q in members if q) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = sorted(c for c in who if len(convs[c]) == len(path))
        children = sum(len(p) == len(path) + 1 for p in below)
        up = min(members[path[:-1]]) if path else None
        out.add((min(who), len(path), up, len(who), children, leaves, saved, sha(",".join(map(str, ends)))))
    return out


def random_turns(seed, convs, longest):
    pick = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(pick.randrange(longest + 1)):
            rows.append((c, pick.choice([t, t, t, None]), pick.choice(["user", "assistant", None, "u"]), pick.choice(["a", "bc", "", None, "é!"])))
    return rows


def nodes_of(df):
    return {tuple(r) for r in df.collect()}, df.count()


@pytest.mark.parametrize("width,run", [(1, 1), (2, 2), (4, 4096)])
def test_trie_of_random_conversations(spark, width, run):
    rows = random_turns(width, [*range(-5, 40), 5000, 9000], 7) + [(1, 3, "user", "a")] * 2 + [(None, 0, "user", "a")]
    found, n = nodes_of(prefix_trie.trie(spark.createDataFrame(rows, TURNS).withColumn("_n", F.lit(1)).withColumn("place", F.lit(2)), width=width, run=run))
    assert found == plain_trie(in_order(rows)) and n == len(found)


def test_trie_of_copies_and_long_conversations(spark):
    long = [(t % 3 and "user" or "assistant", str(t)) for t in range(60)]
    convs = {c: long[: 60 - c % 2] for c in range(30)} | {4096 * 7 + c: [("user", "x")] for c in range(30)}
    rows = [(c, t, r, x) for c, said in convs.items() for t, (r, x) in enumerate(said)]
    found, _ = nodes_of(prefix_trie.trie(spark.createDataFrame(rows, TURNS), width=4, run=3))
    assert found == plain_trie(convs)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0


def test_shared_heads(spark):
    rows = random_turns(9, [*range(0, 8), *range(196, 212), 305, -3], 6)
    own = in_order(rows)
    rebuilt = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100
        rebuilt[c] = own.get(c - base, [])[:h] + said[h:]
    placed = prefix_trie.turns(spark.createDataFrame(rows, TURNS))
    found, _ = nodes_of(prefix_trie.nodes(*prefix_trie.with_shared_heads(placed)))
    assert found == plain_trie(rebuilt)


# ------------------------------------------------------------------ repair
def faults_of(rows):
    out, seen = [], set()
    for r, x in rows:
        said = re.findall(r"[^\x20\x09-\x0D]", x)
        out.append("b" if not said else "d" if (r, x) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def plain_repair(rows):
    """(cost, audit, digest) by trying every path with the least cost so far."""
    best = {(0, ""): (0, "", [])}  # (row, role letters so far, only the last counts) -> least

    def inserts(states):
        for _ in range(3):
            for (i, q), (c, a, out) in list(states.items()):
                to, role = ("a", "assistant") if q == "u" else ("u", "user")
                new = (c + 3, a + "I", [*out, role + ":"])
                if (i, to) not in states or new[:2] < states[(i, to)][:2]:
                    states[(i, to)] = new
        return states

    for i, ((r, x), f) in enumerate(zip(rows, faults_of(rows))):
        nxt = {}
        for (_, q), (c, a, out) in inserts(best).items():
            options = [(q, c + 4, a + "D", out)]
            if f not in ("b", "d"):
                extra = 3 * (f == "t")
                to, role = ("a", "assistant") if q == "u" else ("u", "user")
                options.append((to, c + 3 + extra, a + "R", [*out, f"{role}:{x}"]))
                if r[:1] == to or (r[:1] == "s" and q == ""):
                    options.append((r[:1], c + extra, a + "K", [*out, f"{r}:{x}"]))
            for q2, *new in options:
                if (i + 1, q2) not in nxt or tuple(new[:2]) < nxt[(i + 1, q2)][:2]:
                    nxt[(i + 1, q2)] = tuple(new)
        best = nxt
    cost, audit, out = min((v for (_, q), v in inserts(best).items() if q in ("", "a")), key=lambda v: v[:2])
    return cost, audit, sha("\n".join(out))


def plain_repairs(rows):
    out = {}
    found = {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        found.setdefault(c, []).append((t is not None, t or 0, r, sha(x), x))
    for c, v in found.items():
        said = [(r, x) for _, _, r, _, x in sorted(v)]
        f = faults_of(said)
        odd = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        ts = [t for k, t, *_ in v if k]
        gaps = max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0
        cost, audit, digest = plain_repair(said)
        out[c] = (gaps, f.count("b"), f.count("d"), f.count("t"), odd, cost, audit, digest)
    return out


ROLES = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "User"]
TEXTS = ["Fine.", "Yes!", "no end", " \t", "", None, "Ends? \n", "é.", "Fine."]


@pytest.mark.parametrize("size,fan", [(1024, 256), (3, 2), (1, 2)])
def test_repairs_of_random_conversations(spark, size, fan):
    pick = random.Random(size)
    rows = []
    for c in [*range(25), None]:
        n = pick.choice([0, 1, 2, 5, 9, 40])
        rows += [(c, pick.choice([t, t, t + 3, None]), pick.choice(ROLES), pick.choice(TEXTS) if pick.random() < 0.4 else f"{t % 7}.") for t in range(n)]
    df = spark.createDataFrame(rows, TURNS).withColumn("stretch", F.lit("x")).withColumn("named", F.lit(0))
    found = {r[0]: tuple(r)[1:] for r in structure_repair.repaired(df, size=size, fan=fan).collect()}
    assert found == plain_repairs(rows)


def test_damage_by_kind(spark):
    rows = [(c, t, "assistant", "One. Two! 3?") for c in range(20) for t in (0, 1, None)]
    found = sorted(tuple(r) for r in structure_repair.damaged(spark.createDataFrame(rows, TURNS), "conv_id", "turn", "role", "text").collect() if r.turn is not None)
    expected = []
    for c, t, r, x in rows:
        if t is None:
            continue
        kind = zlib.crc32(f"{c}:{t}".encode()) % 20
        row = (c, t, "user" if kind == 4 else r, "" if kind == 1 else "One Two 3" if kind == 2 else x)
        expected += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert found == sorted(expected)


def test_conversations_without_rows(spark):
    everyone = spark.createDataFrame([(7,), (None,)], "conv long")
    found = structure_repair.repaired(spark.createDataFrame([], TURNS), everyone=everyone).collect()
    assert sorted((r._conv is None, *tuple(r)[1:]) for r in found) == [(x, 0, 0, 0, 0, 0, 0, "", sha("")) for x in (False, True)]


def test_ranks_follow_least_audits():
    import numpy as np

    # Node 0 may go on to 1 (D) or 2 (K); 1 to 3 (R), 2 to 3 (D); 3 ends.
    ok = np.zeros((4, 4), dtype=bool)
    to = np.zeros((4, 4), dtype=np.int64)
    for a, letter, b in ((0, 0, 1), (0, 2, 2), (1, 3, 3), (2, 0, 3)):
        ok[a, letter], to[a, letter] = True, b
    letters, rank, doubled = structure_repair.ranked(ok, to, 2)
    texts, end = structure_repair.read_off(np.arange(4), letters, doubled, 1)
    assert texts == [b"DR", b"R", b"D", b""] and list(end) == [3] * 4 and list(np.argsort(rank)) == [3, 2, 0, 1]


# ------------------------------------------------------------------ windows
def plain_windows(rows, size):
    """(id, n_words, n_removed, digest) of (id, text) rows."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    order = lambda i: (i is not None, i or 0)
    first, out = {}, []
    split = [(i, word.findall(t or "")) for i, t in rows]
    for i, w in split:
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, (order(i), s)), (order(i), s))
    for i, w in split:
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] != (order(i), s):
                gone.update(range(s, s + size))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


def window_rows():
    pick = random.Random(3)
    word = lambda: pick.choice(["ab", "Ab", "é", "longer-than-eight-bytes", "x", " y"])
    passage = [word() for _ in range(60)]
    rows = [(None, "x y z"), (None, "x y z"), (3, None), (4, ""), (5, " \t\n")]
    for i in range(10, 60):
        own = [word() for _ in range(pick.choice([0, 3, 19, 20, 21, 200]))]
        a = pick.randrange(60)
        cut = passage[a : a + pick.choice([5, 19, 20, 25, 60])]
        at = pick.randrange(len(own) + 1)
        rows.append((i, pick.choice([" ", "\n", "  \t"]).join(own[:at] + cut + own[at:] + (cut if i % 7 == 0 else []))))
    rows += [(100, "same " * 100), (101, "same " * 50), (102, rows[20][1]), (102, rows[20][1]), (103, rows[21][1] + " tail")]
    rows += [(104, " ".join(passage)), (104, " ".join(passage[5:] + passage))]
    return rows


@pytest.mark.parametrize("size,limit,most", [(20, 4 << 20, 1 << 20), (5, 64, 1 << 20), (20, 200, 3), (8, 4 << 20, 1), (1, 100, 2)])
def test_windows_against_brute_force(spark, size, limit, most):
    rows = window_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("id", F.lit("z")).repartition(3)
    found = window_dedup.without_repeats(df, size=size, limit=limit, most=most).collect()
    assert sorted(((r._id, r.n_words, r.n_removed, r.kept_sha256) for r in found), key=repr) == plain_windows(rows, size)
    for r in found:
        assert sha(r.kept) == r.kept_sha256 and sum(s.end - s.begin for s in r.spans) == r.n_removed
        assert all(a.end < b.begin for a, b in itertools.pairwise(r.spans))


def test_windows_of_an_empty_table(spark):
    assert window_dedup.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
