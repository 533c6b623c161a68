"""What was known of a key at an instant: versions carried forward to arbitrary rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.dates import status_at

_VERSION, _CARRY, _FACT = 1, 0, 2


def as_of(
    facts: DataFrame, versions: DataFrame, key: str, at: str, since: str, order: list[str] | None = None,
    every: str = "month", strict: bool = False,
) -> DataFrame:
    """``facts`` with ``version``, the newest row of ``versions`` of their key that holds at ``at``.

    A version holds from ``since`` on, with ``strict`` only after it. Of versions that
    begin together the last by ``order`` holds. A fact whose key has no version yet, or
    whose key or instant is NULL, has a NULL version; versions without a key or an
    instant hold never. Repeated facts are each returned.

    No fact is joined to versions. Both are laid out by key and period ``every``, and
    inside a period the last version is carried along; a period that opens with a fact
    gets the version standing before it as one more row, found from one row a key and
    period. So a hot key is as many tasks as it has periods, and each side is moved once.
    """
    columns = versions.columns
    whole = F.struct(*[F.col(c) for c in columns])
    rank = F.struct(*[F.col(c) for c in [since, *(order or [])]])
    period = lambda c: F.date_trunc(every, F.col(c))
    known = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull())
    known = known.select(F.col(key).alias("_key"), period(since).alias("_period"), F.col(since).alias("_at"), rank.alias("_rank"), whole.alias("_version"))

    # The version that stands before each period with facts: slim rows, one a key and period.
    tails = known.groupBy("_key", "_period").agg(F.max_by("_version", "_rank").alias("_version"))
    asked = facts.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("_key"), period(at).alias("_period")).distinct()
    marks = tails.unionByName(asked.withColumn("_version", F.lit(None).cast(tails.schema["_version"].dataType)))
    marks = marks.groupBy("_key", "_period").agg(F.first("_version", ignorenulls=True).alias("_version"), F.bool_or(F.col("_version").isNull()).alias("_asked"))
    before = Window.partitionBy("_key").orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.withColumn("_carried", F.last("_version", ignorenulls=True).over(before)).where("_asked AND _carried IS NOT NULL")

    fact_type = facts.select(F.struct(*[F.col(c) for c in facts.columns]).alias("f")).schema["f"].dataType
    no_fact, no_version = F.lit(None).cast(fact_type), F.lit(None).cast(tails.schema["_version"].dataType)
    no_rank = F.lit(None).cast(known.schema["_rank"].dataType)
    rows = known.select("_key", "_period", "_at", F.lit(_VERSION).alias("_kind"), "_rank", "_version", no_fact.alias("_fact"))
    rows = rows.unionByName(
        carried.select("_key", "_period", F.col("_period").alias("_at"), F.lit(_CARRY).alias("_kind"), no_rank.alias("_rank"), F.col("_carried").alias("_version"), no_fact.alias("_fact"))
    )
    # Facts without a key or an instant are dealt out by what else they hold.
    lost = F.col(key).isNull() | F.col(at).isNull()
    spread = F.timestamp_micros(F.when(lost, F.xxhash64(*facts.columns) % 1_000_000).cast("long"))
    rows = rows.unionByName(
        facts.select(
            F.when(~lost, F.col(key)).alias("_key"), F.when(lost, spread).otherwise(period(at)).alias("_period"), F.col(at).alias("_at"),
            F.lit(_FACT).alias("_kind"), no_rank.alias("_rank"), no_version.alias("_version"), F.struct(*[F.col(c) for c in facts.columns]).alias("_fact"),
        )
    )
    # A strict fact stands before the versions of its instant, and after the one carried in.
    kind = F.when((F.col("_kind") == _FACT) & F.lit(strict), 0.5).otherwise(F.col("_kind"))
    along = Window.partitionBy("_key", "_period").orderBy("_at", kind, "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    told = rows.withColumn("version", F.when(F.col("_key").isNotNull(), F.last("_version", ignorenulls=True).over(along)))
    return told.where(F.col("_kind") == _FACT).select(*[F.col("_fact")[c].alias(c) for c in facts.columns], "version")


def statuses_as_of(asked: DataFrame, versions: DataFrame, key: str = "id", at: str = "as_of", since: str = "recorded") -> DataFrame:
    """``asked`` with the state of the record as it was known at ``at``: its version of then, its rules at that instant.

    ``versions``: ``key, since, opens, closes, product, flags``. A record not yet known
    has a NULL status.
    """
    told = as_of(asked, versions, key, at, since, ["opens", "closes"])
    of = lambda c: F.col("version")[c]
    review = F.array_contains(of("flags"), "needs_manual_review")
    status = status_at(of("opens"), of("closes"), of("product"), review, F.col(at))
    return told.withColumn("status", F.when(F.col("version").isNotNull(), status)).withColumn("known_since", of(since)).drop("version")
