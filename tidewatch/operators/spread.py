"""Plan shapes that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import cut


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One whole row per key, the smallest by ``order``.

    An aggregate, not a window: each task keeps one candidate per key before
    anything is shuffled, so a hot key costs no more than a cold one.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def top_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int | None, rank: str = "rank", salts: int = 32
) -> DataFrame:
    """The first ``k`` rows per key with their rank; all rows, ranked as by ``ranked``, when ``k`` is None.

    A key's rows are first ranked in ``salts`` independent slices, so no task
    sorts a whole hot group; only ``salts * k`` rows per key reach the last step.
    """
    slice_id = F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(salts))
    sliced = Window.partitionBy(*keys, "_slice").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    if k is None:
        return ranked(df, keys, order, rank)
    return (
        df.withColumn("_slice", slice_id)
        .withColumn("_near", F.row_number().over(sliced))
        .where(F.col("_near") <= k)
        .drop("_slice", "_near")
        .withColumn(rank, F.row_number().over(whole))
        .where(F.col(rank) <= k)
    )


def ranked(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Every row with its rank within its key, though one key may hold most rows.

    Rows are laid out in ranges of (key, order), so that a hot key fills many of them;
    they are numbered inside a range, and each range adds the rows of its key that stand
    in the ranges before it.
    """
    laid = cut(df.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = laid.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    offsets = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_of"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    same = F.col("_range") == F.col("_of")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    numbered = laid.withColumn("_inside", F.row_number().over(inside)).join(offsets, same)
    return numbered.withColumn(rank, (F.col("_inside") + F.col("_before")).cast("int")).select(*df.columns, rank)


def running_total(df: DataFrame, rank: str, key: str, value: str, out: str, bits: int = 12) -> DataFrame:
    """``out`` = total of ``value`` over all rows up to this one, by (rank, md5(key)).

    A window without a partition would bring every row to one task.  Here rows
    fall into buckets of the hashed key, bucket totals (at most ranks * 2^bits of
    them) give each bucket its offset, and only a bucket is ever sorted.  ``key``
    must be unique; the hash keeps buckets even whatever the keys look like.
    """
    digits = bits // 4
    spot = F.md5(F.col(key))
    placed = df.withColumn("_spot", spot).withColumn("_bucket", F.substring("_spot", 1, digits))
    totals = placed.groupBy(rank, "_bucket").agg(F.sum(value).alias("_total"))
    before = Window.orderBy(rank, "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        rank, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(rank, "_bucket").orderBy("_spot", key).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        placed.withColumn("_inside", F.sum(value).over(inside))
        .join(offsets, [rank, "_bucket"])  # both sides lie by (rank, bucket) already
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_spot", "_bucket", "_inside", "_offset")
    )


def step_summary(
    df: DataFrame,
    key: str,
    ts: str,
    order: list[str],
    carried: str,
    step,
    combine,
    every: str = "day",
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Aggregate something over consecutive rows of a key, without sorting a whole key.

    ``step(previous, current)`` compares the ``carried`` value of neighbouring
    rows.  Rows are compared inside (key, calendar ``every``); then the first row
    of each period is compared with the last row of the period before it, over
    one summary row per period.  ``combine`` is the aggregate of the steps.
    """
    bucket = F.date_trunc(every, F.col(ts))
    inside = Window.partitionBy(key, "_bucket").orderBy(*order)
    at = F.struct(*order)
    stepped = df.withColumn("_bucket", bucket).withColumn(
        "_step", step(F.lag(carried).over(inside), F.col(carried))
    )
    more = [column.alias(name) for name, column in (extra or {}).items()]
    periods = stepped.groupBy(key, "_bucket").agg(
        combine(F.col("_step")).alias("_inner"),
        F.min_by(carried, at).alias("_head"),
        F.max_by(carried, at).alias("_tail"),
        *more,
    )
    along = Window.partitionBy(key).orderBy("_bucket")
    joined = periods.withColumn("_border", step(F.lag("_tail").over(along), F.col("_head")))
    return joined


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join to a side that is unique per key when the left side may be hot on it.

    The right side moves once.  A hot key's rows on the left are cut into pieces at
    run time (adaptive skew join; its threshold is set with the session), each of
    which meets the one row it needs.
    """
    return left.join(right, key, how)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out for work that takes long for each of few bytes.

    Such rows come from few files and their sizes would put them into one task; as many
    tasks take them as a shuffle has partitions, or the cluster cores.
    """
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def sized(df: DataFrame, key: str, rows: int = 250_000) -> DataFrame:
    """Rows laid out by ``key`` in pieces of about ``rows`` on average, so that what a task sorts does not grow with the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // rows)), key)


def first_row_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One whole row per key, the smallest by the columns ``order``, for wide rows.

    Only the keys and ``order`` are sorted to find the winner, then the winner's row is
    looked up; (keys, order) must identify a row, and order must not be NULL.
    """
    best = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_best")).select(*keys, *[F.col("_best")[c].alias(c) for c in order])
    return df.join(best, [*keys, *order], "left_semi")
