"""Which rows can find a partner at all: a filter of fixed size built by Spark and asked where the rows lie."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the largest filter (8 MB) and of the smallest, and how many a key sets.
MOST_BITS, LEAST_BITS, HASHES = 1 << 26, 1 << 12, 5


def filter_bits(keys: int) -> int:
    """About twelve bits a key (one stranger in three hundred passes), a power of two; past the largest more strangers pass."""
    bits = LEAST_BITS
    while bits < 12 * keys and bits < MOST_BITS:
        bits *= 2
    return bits


def _places(key: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def known_to(side: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that is true for every key of ``side`` and false for nearly all others; NULL is not known.

    Only ever a filter in front of a join: what it lets through by chance finds no partner
    there. Bits are set by partial aggregates, a word of 64 each; what reaches the tasks
    is at most 8 MB however many keys there are.
    """
    bits = filter_bits(side.count())
    words = side.where(F.col(key).isNotNull()).select(F.explode(F.array(*_places(F.col(key), bits))).alias("p"))
    words = words.groupBy(F.expr("p div 64").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("w"))
    all_words = side.sparkSession.range(bits // 64).join(words, "id", "left")
    table = all_words.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")))), lambda x: x["w"])).scalar()

    def known(asked: Column) -> Column:
        held = asked.isNotNull()
        for p in _places(asked, bits):
            held = held & (F.getbit(F.get(table, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)
        return F.coalesce(held, F.lit(False))

    return known
