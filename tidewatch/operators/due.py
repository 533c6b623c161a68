"""What to read next: tiers, intervals, one source per host, nothing too soon."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import address as A
from tidewatch.functions import dates as D
from tidewatch.functions import lexicon as L
from tidewatch.operators.spread import first_per_key, spread_join, step_summary

MINUTE = 60_000_000


def host_counts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct urls per host; what is not an address is skipped."""
    return (
        urls.select(A.host(F.col(url)).alias("host"), F.col(url).alias("_u"))
        .where("host IS NOT NULL")
        .groupBy("host")
        .agg(F.countDistinct("_u").alias("urls"))
    )


def tiers(sources: DataFrame, records: DataFrame, as_of: Column) -> DataFrame:
    """How closely each source is watched.

    ``sources``: ``url, org_tier, type, coop_confirmed``; ``records``: ``url, opens,
    closes, product, flags``.  Status is recomputed for the instant, and a
    deadline is the end of its day.
    """
    review = F.array_contains("flags", "needs_manual_review")
    status = D.status_at(F.col("opens"), F.col("closes"), F.col("product"), review, as_of)
    left = D.hours_left(F.col("closes"), as_of)
    live = status.isin("open", "closing_soon") | left.between(0, L.HOT_WINDOW_DAYS * 24)
    hot = records.groupBy("url").agg(F.max(F.coalesce(live, F.lit(False))).alias("_hot"))
    top = F.col("org_tier").isin("S", "A")
    tier = (
        F.when(F.col("_hot"), "hot")
        .when(F.col("coop_confirmed"), "high")
        .when(F.col("type").isin("careers_page", "portal"), F.when(top, "high").otherwise("medium"))
        .when(F.col("type") == "announcement_page", "medium")
        .otherwise("low")
    )
    return sources.join(hot, "url", "left").withColumn("tier", tier).drop("_hot")


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "hot", 0).when(tier == "high", 1).when(tier == "medium", 2).otherwise(3)


def interval_minutes(tier: Column, on_host: Column) -> Column:
    """A tier's interval, stretched so that one host is never read too often."""
    wanted = F.create_map(*[F.lit(x) for pair in L.INTERVAL_MINUTES.items() for x in pair])
    return F.greatest(
        F.try_element_at(wanted, tier), F.coalesce(on_host, F.lit(1)) * L.HOST_GAP_MINUTES
    ).cast("int")


def fastest_tier(targets: DataFrame) -> DataFrame:
    """One target per url, the most closely watched."""
    return first_per_key(targets, ["url"], tier_rank(F.col("tier")), F.col("org_id"))


def due_now(schedule: DataFrame, as_of: Column, limit: int | None = L.SOURCES_PER_CYCLE) -> DataFrame:
    """The most overdue sources, at most one per host and none on a host read within the gap; all of them for None.

    Inside one (host, tier) the interval is the same for all, so the most overdue
    is simply the earliest due: one aggregate with map-side combining finds it,
    together with the host's size and last read.  At most four rows per host are
    left to rank.
    """
    lateness = D.micros(as_of) - D.micros(F.col("next_check"))
    slim = schedule.select(
        "url", "org_id", "tier", "last_checked", "next_check",
        A.host(F.col("url")).alias("host"),
    ).where("host IS NOT NULL")
    due = F.col("next_check") <= as_of
    per_tier = slim.groupBy("host", "tier").agg(
        F.count("*").alias("_urls"),
        F.max("last_checked").alias("_last"),
        F.min(F.when(due, F.struct("next_check", "url", "org_id"))).alias("_first"),
    )
    per_host = per_tier.groupBy("host").agg(
        F.sum("_urls").alias("on_host"),
        F.max("_last").alias("host_last"),
        F.array_compact(
            F.collect_list(
                F.when(
                    F.col("_first").isNotNull(),
                    F.struct("tier", F.col("_first.next_check").alias("next_check"),
                             F.col("_first.url").alias("url"), F.col("_first.org_id").alias("org_id")),
                )
            )
        ).alias("_due"),
    )
    rested = F.col("host_last").isNull() | (
        D.micros(as_of) - D.micros(F.col("host_last")) >= L.HOST_GAP_MINUTES * MINUTE
    )
    candidates = (
        per_host.where(rested)
        .select("host", "on_host", F.explode("_due").alias("d"))
        .select("host", "on_host", "d.*")
        .withColumn(
            "urgency",
            lateness / MINUTE / interval_minutes(F.col("tier"), F.col("on_host")),
        )
    )
    best = first_per_key(candidates, ["host"], -F.col("urgency"), F.col("url"))
    return best if limit is None else best.orderBy(F.desc("urgency"), "url").limit(limit)


def stable_spread(url: Column, window_minutes: int = L.FIRST_SWEEP_MINUTES) -> Column:
    """Milliseconds into the window at which a url is first read: its hash, so it never moves."""
    window = max(1, round(window_minutes * 60_000))
    folded = F.aggregate(
        F.split(url, ""),
        F.lit(0).cast("bigint"),
        lambda h, c: F.pmod(h * 31 + F.ascii(c), F.lit(1 << 32)),
    )
    return F.pmod(folded, F.lit(window))


def _after(instant: Column, micros: Column) -> Column:
    return F.timestamp_micros(D.micros(instant) + micros)


def reconcile(
    previous: DataFrame, targets: DataFrame, as_of: Column, last_read: DataFrame | None = None
) -> DataFrame:
    """The schedule for today's targets, with what became of each source.

    New sources are spread over the first sweep; a source whose tier changed is
    re-timed from its last read; an unchanged one keeps its turn.  Departed
    sources drop out.
    """
    wanted = fastest_tier(targets.select("url", "org_id", "tier"))
    old = previous.select(
        "url", F.col("tier").alias("_tier"), F.col("next_check").alias("_next"),
        F.col("last_checked").alias("_last"), F.lit(True).alias("_old"),
    )
    joined = wanted.join(old, "url", "left")
    if last_read is not None:
        seeds = last_read.groupBy("url").agg(F.max("read_at").alias("_seed"))
        joined = joined.join(seeds, "url", "left")
    else:
        joined = joined.withColumn("_seed", F.lit(None).cast("timestamp"))
    hosted = joined.withColumn("host", A.host(F.col("url")))
    counts = host_counts(wanted).withColumnRenamed("urls", "_on_host")
    timed = spread_join(hosted, counts, "host", "left")
    is_old, same = F.col("_old").isNotNull(), F.col("_tier") == F.col("tier")
    retimed = _after(
        F.coalesce("_last", as_of),
        interval_minutes(F.col("tier"), F.col("_on_host")).cast("long") * MINUTE,
    )
    return timed.select(
        "url",
        "org_id",
        "tier",
        F.when(~is_old, _after(as_of, stable_spread(F.col("url")) * 1000))
        .when(same, F.col("_next"))
        .otherwise(retimed)
        .alias("next_check"),
        F.when(is_old, F.col("_last"))
        .when(F.col("_seed") <= as_of, F.col("_seed"))
        .alias("last_checked"),
        F.when(~is_old, "new").when(same, "unchanged").otherwise("retimed").alias("change"),
    )


def departed(previous: DataFrame, targets: DataFrame) -> DataFrame:
    return previous.join(targets.select("url").distinct(), "url", "left_anti")


def mark_checked(schedule: DataFrame, read: DataFrame, as_of: Column) -> DataFrame:
    """Sources just read wait a whole interval; the rest keep their turn."""
    counts = host_counts(schedule).withColumnRenamed("urls", "_on_host")
    done = read.select("url").distinct().withColumn("_done", F.lit(True))
    hosted = schedule.join(done, "url", "left").withColumn("host", A.host(F.col("url")))
    joined = spread_join(hosted, counts, "host", "left")
    following = _after(
        as_of, interval_minutes(F.col("tier"), F.col("_on_host")).cast("long") * MINUTE
    )
    hit = F.coalesce(F.col("_done"), F.lit(False))
    return (
        joined.withColumn("next_check", F.when(hit, following).otherwise(F.col("next_check")))
        .withColumn("last_checked", F.when(hit, as_of).otherwise(F.col("last_checked")))
        .drop("_done", "_on_host", "host")
    )


def spread_backlog(schedule: DataFrame, as_of: Column, max_lag: int = L.MAX_LAG_MINUTES) -> DataFrame:
    """After a long sleep half the list is late at once; the late ones are spread again."""
    late = D.micros(as_of) - D.micros(F.col("next_check")) > max_lag * MINUTE
    share = schedule.agg(F.avg(F.when(late, 1.0).otherwise(0.0)))
    fresh = _after(as_of, stable_spread(F.col("url")) * 1000)
    return (
        schedule.withColumn("_share", share.scalar())
        .withColumn(
            "next_check",
            F.when((F.col("_share") >= 0.5) & late, fresh).otherwise(F.col("next_check")),
        )
        .drop("_share")
    )


def rate_audit(log: DataFrame, key: str = "host", every: str = "day") -> DataFrame:
    """Smallest gap between two reads of a host, and how many reads came too soon."""

    def gap(previous: Column, current: Column) -> Column:
        return (D.micros(current) - D.micros(previous)) / F.lit(float(MINUTE))

    periods = step_summary(
        log, key, "fetched_at", ["fetched_at", "seq"], "fetched_at", gap, F.min, every,
        {
            "_n": F.count("*"),
            "_soon": F.count_if(F.col("_step") < L.HOST_GAP_MINUTES),
        },
    )
    border_soon = F.when(F.col("_border") < L.HOST_GAP_MINUTES, 1).otherwise(0)
    return periods.groupBy(key).agg(
        F.sum("_n").alias("reads"),
        F.min(F.least("_inner", "_border")).alias("smallest_gap_minutes"),
        F.sum(F.col("_soon") + border_soon).alias("too_soon"),
    )


def promised_reads(reads: DataFrame, schedule: DataFrame, days: float) -> DataFrame:
    """Reads per source against what its tier promises over the same days."""
    done = reads.groupBy("url").agg(F.count("*").alias("reads"))
    counts = host_counts(schedule).withColumnRenamed("urls", "_on_host")
    hosted = schedule.withColumn("host", A.host(F.col("url")))
    joined = spread_join(hosted, counts, "host", "left").join(done, "url", "left")
    promised = F.floor(F.lit(days * 24 * 60) / interval_minutes(F.col("tier"), F.col("_on_host")))
    return joined.select(
        "url", "tier", F.coalesce("reads", F.lit(0)).alias("reads"), promised.cast("long").alias("promised")
    )
