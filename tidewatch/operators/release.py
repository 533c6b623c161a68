"""What is said now, what waits, what goes to the digest.

Every table may hold many readers; ``by`` names the column that tells them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import dates as D
from tidewatch.functions import lexicon as L
from tidewatch.operators.spread import first_per_key, top_k

OPPORTUNITY_KEY = "^(?:new|opened|closing|seats|fit):"


def effective_weight(weight: Column, queued_at: Column, as_of: Column) -> Column:
    """Weight plus what waiting has earned."""
    waited = F.greatest(F.lit(0.0), D.days_between(as_of, queued_at))
    return weight + F.coalesce(waited, F.lit(0.0)) * L.AGING_PER_DAY


def delivered(log: DataFrame, by: list[str]) -> DataFrame:
    """What each key already received.  A log row without a channel was a push."""
    via = F.coalesce("via", F.lit("push"))
    return log.groupBy(*by, "key").agg(
        F.bool_or(via == "push").alias("_pushed"), F.bool_or(via == "digest").alias("_digested")
    )


def undelivered(notices: DataFrame, log: DataFrame, as_of: Column, by: list[str]) -> DataFrame:
    """Notices still owed a push.

    An opening is owed until pushed; a status until pushed or digested, and only
    on the day its key names.  A toast retires nothing.
    """
    opening = F.col("kind").isin(L.OPPORTUNITY_KINDS)
    dated = F.regexp_extract("key", ":([0-9]{4}-[0-9]{2}-[0-9]{2})$", 1)
    stale = (
        F.col("kind").isin(L.STATUS_KINDS)
        & (dated != "")
        & (dated != D.riyadh_day(as_of).cast("string"))
    )
    joined = notices.where(~stale).join(delivered(log, by), [*by, "key"], "left")
    pushed, digested = F.coalesce("_pushed", F.lit(False)), F.coalesce("_digested", F.lit(False))
    return (
        joined.where(~pushed & (opening | ~digested))
        .withColumn("_digestible", ~digested)
        .drop("_pushed", "_digested")
    )


def sent_today(log: DataFrame, as_of: Column, by: list[str]) -> DataFrame:
    """Pushes of the Riyadh day, openings and everything else."""
    opening = F.col("key").rlike(OPPORTUNITY_KEY)
    return (
        log.where(F.coalesce("via", F.lit("push")) == "push")
        .where(D.riyadh_day(F.col("sent_at")) == D.riyadh_day(as_of))
        .groupBy(*by)
        .agg(
            F.count_if(opening).alias("_sent_openings"),
            F.count_if(~opening).alias("_sent_others"),
        )
    )


def distinct_faces(notices: DataFrame, by: list[str]) -> DataFrame:
    """Notices that would read the same are one; the heaviest stands for them."""
    face = F.when(F.col("kind").isin(L.STATUS_KINDS), F.col("kind")).otherwise(
        F.concat_ws("|", "kind", "title", "body")
    )
    return first_per_key(
        notices.withColumn("_face", face), [*by, "_face"], -F.col("effective"), F.col("key")
    ).drop("_face")


def release(
    notices: DataFrame, log: DataFrame, as_of: Column, quiet: bool, by: str = "reader_id",
    openings_a_day: int | None = L.DAILY_OPPORTUNITY_CAP, others_a_day: int | None = L.DAILY_PUSH_CAP,
) -> DataFrame:
    """Notices with ``outlet``: push or digest.  What is neither stays pending.

    By day openings have one budget and everything else another, less what the day
    already sent.  In quiet hours only closing windows are pushed, within the second
    budget.  None is no bound.  What a budget leaves out stays in the queue.
    """
    keys = [by]
    fresh = undelivered(notices, log, as_of, keys).withColumn(
        "effective", effective_weight(F.col("weight"), F.col("queued_at"), as_of)
    )
    opening = F.col("kind").isin(L.OPPORTUNITY_KINDS)
    if quiet:
        urgent = F.col("kind").isin(L.URGENT_KINDS)
        candidates = fresh.where(urgent).withColumn("_class", F.lit("any"))
        rest = fresh
    else:
        rest = distinct_faces(fresh, keys)
        candidates = rest.withColumn("_class", F.when(opening, "opening").otherwise("other"))
    no_bound = (1 << 31) - 1
    few = no_bound if others_a_day is None else others_a_day
    many = no_bound if openings_a_day is None else openings_a_day
    cap = few if quiet else max(many, few)
    ranked = top_k(
        candidates.select(by, "key", "_class", "effective"),
        [by, "_class"], [F.desc("effective"), F.col("key")], None if cap == no_bound else cap, "_rank",
    ).join(sent_today(log, as_of, keys), by, "left")
    openings = F.coalesce("_sent_openings", F.lit(0))
    others = F.coalesce("_sent_others", F.lit(0))
    room = (
        F.when(F.col("_class") == "any", F.lit(few) - openings - others)
        .when(F.col("_class") == "opening", F.lit(many) - openings)
        .otherwise(F.lit(few) - others)
    )
    push = ranked.where(F.col("_rank") <= room).select(by, "key", F.lit(True).alias("_push"))
    return (
        rest.join(push, [by, "key"], "left")
        .withColumn("outlet", F.when(F.col("_push"), "push").when(F.col("_digestible"), "digest"))
        .where("outlet IS NOT NULL")
        .drop("_push", "_digestible")
    )


def collapse_broken(pending: DataFrame, as_of: Column, by: str = "reader_id") -> DataFrame:
    """A reader's waiting notices about broken sources become one, which counts them.

    They are one piece of news.  It keeps the place of the one queued first and the
    weight of the heaviest; the sources themselves stay in the health table.
    """
    broken = F.col("kind") == "source_broken"
    counted = pending.where(broken).groupBy(by).agg(
        F.count("*").alias("_n"), F.max("weight").alias("weight"), F.min("queued_at").alias("queued_at")
    ).where("_n > 1")
    several = counted.select(
        by,
        F.concat_ws(":", F.lit("broken"), D.riyadh_day(as_of).cast("string"), F.lit("carried")).alias("key"),
        F.lit("source_broken").alias("kind"),
        F.concat(F.lit("🔴 "), F.col("_n").cast("string"), F.lit(" مصادر توقّفت")).alias("title"),
        F.lit(L.NOTICE_BODIES["sources_broken"]).alias("body"),
        "weight", F.lit(None).cast("string").alias("announcement"), "queued_at",
    )
    alone = pending.join(counted.select(by, F.lit(True).alias("_many")), by, "left").where(~broken | F.col("_many").isNull())
    return alone.select(*pending.columns).unionByName(several.select(*pending.columns))


def carry(pending: DataFrame, fresh: DataFrame, live: DataFrame, as_of: Column, by: str = "reader_id") -> DataFrame:
    """The queue of this round: what waited, then what is new, one row per key.

    A notice waits seven days, and longer while its announcement is still live.
    The one queued first keeps its place, and with it what waiting earned.
    """
    young = D.days_between(as_of, F.col("queued_at")) < L.PENDING_TTL_DAYS
    alive = live.select("announcement").distinct().withColumn("_live", F.lit(True))
    kept = (
        pending.join(alive, "announcement", "left")
        .where(young | F.coalesce("_live", F.lit(False)))
        .drop("_live")
        .withColumn("_turn", F.lit(0))
    )
    now = fresh.withColumn("queued_at", as_of).withColumn("_turn", F.lit(1))
    return first_per_key(
        kept.unionByName(now), [by, "key"], F.col("_turn"), F.col("queued_at"), -F.col("weight")
    ).drop("_turn")


def append_log(log: DataFrame, sent: DataFrame, as_of: Column) -> DataFrame:
    """The log after a round.  It outlives the announce window, so nothing is said twice."""
    now = sent.select(*[c for c in log.columns if c != "sent_at"], as_of.alias("sent_at"))
    return log.unionByName(now).where(
        D.days_between(as_of, F.col("sent_at")) < L.LOG_RETENTION_DAYS
    )


def still_pending(queue: DataFrame, log: DataFrame, as_of: Column, by: str = "reader_id") -> DataFrame:
    """Queued notices no channel has delivered."""
    done = delivered(log, [by])
    opening = F.col("kind").isin(L.OPPORTUNITY_KINDS)
    pushed, digested = F.coalesce("_pushed", F.lit(False)), F.coalesce("_digested", F.lit(False))
    return (
        queue.join(done, [by, "key"], "left")
        .where(~(pushed | (~opening & digested)))
        .drop("_pushed", "_digested")
    )


def held_count(queue: DataFrame, log: DataFrame, as_of: Column, by: str = "reader_id") -> DataFrame:
    return still_pending(queue, log, as_of, by).groupBy(by).agg(F.count("*").alias("held"))
