"""A small test for the keys of a list, made once and asked inside the rows of a large table.

A Bloom filter: two bits a key, sixteen bits of room for each. It never denies a key of the list, so what passes
still meets the list itself; what it denies, which is most, is never opened into rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of a list up to which a filter is made; it goes with the plan, so it stays below a megabyte.
MOST_KEYS = 200_000
BITS_PER_KEY = 16


def _bits(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(key, F.lit(1))]


def key_filter(keys: DataFrame, column: str, most: int = MOST_KEYS) -> Callable[[Column], Column]:
    """``test(key)``: false only where the key is not in the list. A longer list than ``most`` gives a test that is always true."""
    n = keys.limit(most + 1).count()
    if n > most:
        return lambda key: F.lit(True)
    words = 1 << max(0, (n * BITS_PER_KEY // 64).bit_length())
    at = lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(words - 1)).cast("int")
    set_bits = keys.select(F.explode(F.array(*_bits(F.col(column)))).alias("h")).select(
        at(F.col("h")).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int")).alias("bit")
    )
    found = {r.word: r.bits for r in set_bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()}
    table = F.split(F.lit(",".join(str(found.get(i, 0)) for i in range(words))), ",").cast("array<bigint>")

    def test(key: Column) -> Column:
        hit = [F.getbit(F.get(table, at(h)), h.bitwiseAND(F.lit(63)).cast("int")) == 1 for h in _bits(key)]
        return hit[0] & hit[1]

    return test
