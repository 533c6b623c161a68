"""Exact order statistics without bringing a key's values together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut

#: Parts a bracket is cut into each round, and the accuracy with which its distinct values are cut.
PARTS, ACCURACY = 32, 1000


def _narrowed(counts: DataFrame, brackets: DataFrame, key: str) -> DataFrame:
    """The part of each bracket that holds its rank, with the least and greatest value in it."""
    here = F.col(key).eqNullSafe(F.col("_k"))
    inside = counts.join(brackets.withColumnRenamed(key, "_k"), here).where(F.col("v").between(F.col("lo"), F.col("hi"))).drop("_k")
    shares = [i / PARTS for i in range(1, PARTS)]
    cuts = inside.groupBy(key, "rank").agg(F.percentile_approx("v", shares, ACCURACY).alias("cuts")).withColumnsRenamed({key: "_k", "rank": "_r"})
    spot = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    parts = inside.join(cuts, here & (F.col("rank") == F.col("_r"))).groupBy(key, "rank", "below", spot.alias("spot")).agg(
        F.sum("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )
    along = Window.partitionBy(key, "rank").orderBy("spot").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("below", F.col("below") + F.coalesce(F.sum("n").over(along), F.lit(0)))
    return placed.where((F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("n"))).select(key, "rank", "below", "lo", "hi")


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, median`` of every key: of an even number of values the mean of the middle two; NULL where there is none.

    Equal values are counted first. Then the two middle ranks of every key are bracketed:
    a round cuts a bracket into ``PARTS`` parts of about as many distinct values (by a
    sketch, whose error only makes the parts uneven), counts them by partial aggregates
    and keeps the part that holds the rank, until it holds one value. No task ever holds
    a key's values, only sketches and at most ``PARTS`` counts; rounds grow with the
    logarithm of the distinct values. NaN is no value.
    """
    v = F.col(value).cast("double")
    every = rows.select(key).distinct()
    counts = cut(rows.where(v.isNotNull() & ~F.isnan(v)).groupBy(key, v.alias("v")).agg(F.count("*").alias("n")))
    whole = counts.groupBy(key).agg(F.sum("n").alias("all"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    middle: Column = F.array_distinct(F.array(F.expr("(all - 1) div 2"), F.expr("all div 2")))
    brackets = cut(whole.select(key, F.explode(middle).alias("rank"), F.lit(0).cast("long").alias("below"), "lo", "hi"))
    while not brackets.where("lo < hi").isEmpty():
        brackets = cut(_narrowed(counts, brackets, key))
    found = brackets.groupBy(key).agg((F.min("lo") / 2 + F.max("lo") / 2).alias("median"))
    return every.join(found.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left").select(key, "median")
