"""Source health from the fetch log: streaks, states, coverage, alarms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import lexicon as L
from tidewatch.functions.dates import days_between, hours_between
from tidewatch.operators.spread import step_summary

STATE_RANK = {"healthy": 0, "degraded": 1, "broken": 2}


def state_of(failures: Column) -> Column:
    return F.when(failures == 0, "healthy").when(failures <= 5, "degraded").otherwise("broken")


def failure_streaks(log: DataFrame, key: str = "url", every: str = "day") -> DataFrame:
    """Current failure streak of every source from its whole log.

    ``log``: ``key, fetched_at, seq, ok, error``.  A streak is every failure
    after the last success.  Rows are settled inside (source, period) and the
    per-period summaries then folded, so a source holding a large share of the
    log is still spread over its periods.
    """
    period = Window.partitionBy(key, "_bucket")
    at = F.struct("fetched_at", "seq")
    slim = log.select(key, "fetched_at", "seq", "ok", "error").withColumn(
        "_bucket", F.date_trunc(every, "fetched_at")
    )
    marked = slim.withColumn("_last_ok", F.max(F.when(F.col("ok"), at)).over(period))
    failed = ~F.col("ok")
    after_ok = failed & (F.col("_last_ok").isNull() | (at > F.col("_last_ok")))
    periods = marked.groupBy(key, "_bucket").agg(
        F.count_if(failed).alias("_failed"),
        F.count_if(after_ok).alias("_tail_failed"),
        F.max(F.when(F.col("ok"), F.col("fetched_at"))).alias("_last_success"),
        F.max("fetched_at").alias("_last_attempt"),
        F.max_by(F.when(failed, F.col("error")), at).alias("_last_error"),
    )
    whole = Window.partitionBy(key)
    ok_period = F.max(F.when(F.col("_last_success").isNotNull(), F.col("_bucket"))).over(whole)
    counted = (
        F.when(F.col("_bucket") == F.col("_ok_period"), F.col("_tail_failed"))
        .when(F.col("_ok_period").isNull() | (F.col("_bucket") > F.col("_ok_period")), F.col("_failed"))
        .otherwise(0)
    )
    return (
        periods.withColumn("_ok_period", ok_period)
        .groupBy(key)
        .agg(
            F.max("_last_attempt").alias("last_attempt"),
            F.max("_last_success").alias("last_success"),
            F.sum(counted).cast("long").alias("consecutive_failures"),
            F.max_by("_last_error", "_bucket").alias("last_error"),
        )
        .withColumn("last_error", F.when(F.col("consecutive_failures") > 0, F.col("last_error")))
        .withColumn("state", state_of(F.col("consecutive_failures")))
    )


def fold_health(prior: DataFrame, log: DataFrame, key: str = "url") -> DataFrame:
    """Health after new log rows arrived; rows no newer than the state are ignored."""
    seen = prior.select(key, F.col("last_attempt").alias("_seen"))
    fresh = log.join(seen, key, "left").where(
        F.col("_seen").isNull() | (F.col("fetched_at") > F.col("_seen"))
    )
    now = failure_streaks(fresh.drop("_seen"), key)
    renamed = now.select(key, *[F.col(c).alias(f"n_{c}") for c in now.columns if c != key])
    joined = prior.join(renamed, key, "full_outer")
    touched = F.col("n_last_attempt").isNotNull()
    failures = (
        F.when(~touched, F.col("consecutive_failures"))
        .when(F.col("n_last_success").isNotNull(), F.col("n_consecutive_failures"))
        .otherwise(F.coalesce("consecutive_failures", F.lit(0)) + F.col("n_consecutive_failures"))
    )
    return joined.select(
        key,
        F.coalesce("n_last_attempt", "last_attempt").alias("last_attempt"),
        F.coalesce("n_last_success", "last_success").alias("last_success"),
        failures.alias("consecutive_failures"),
        F.when(touched, F.col("n_last_error")).otherwise(F.col("last_error")).alias("last_error"),
        state_of(failures).alias("state"),
    )


def churn(history: DataFrame, key: str = "url", every: str = "day") -> DataFrame:
    """How often a page changes over its history: ``readings, changes, change_rate``."""

    def moved(previous: Column, current: Column) -> Column:
        return F.when(previous.isNotNull() & (previous != current), 1).otherwise(0)

    periods = step_summary(
        history, key, "fetched_at", ["fetched_at", "seq"], "hash", moved, F.sum, every,
        {"_n": F.count("*")},
    )
    return (
        periods.groupBy(key)
        .agg(F.sum("_n").alias("readings"), F.sum(F.col("_inner") + F.col("_border")).alias("changes"))
        .withColumn(
            "change_rate",
            F.when(F.col("readings") > 1, F.col("changes") / (F.col("readings") - 1)),
        )
    )


def last_check(health: DataFrame, as_of: Column) -> DataFrame:
    last = F.max("last_attempt")
    return health.agg(last.alias("last_check")).withColumn(
        "hours_since", hours_between(as_of, F.col("last_check"))
    )


def org_health(configured: DataFrame, health: DataFrame) -> DataFrame:
    """Worst state per organisation over its configured (verified) sources.

    Nothing configured or nothing ever read is ``unwatched``; some unread while
    the rest are healthy is ``degraded``.
    """
    rank = F.create_map(*[F.lit(x) for pair in STATE_RANK.items() for x in pair])
    rows = configured.select("org_id", "url").join(health.select("url", "state"), "url", "left")
    worst = F.max(F.try_element_at(rank, F.col("state")))
    grouped = rows.groupBy("org_id").agg(
        worst.alias("_worst"),
        F.count_if(F.col("url").isNotNull()).alias("configured"),
        F.count_if(F.col("url").isNotNull() & F.col("state").isNull()).alias("unread"),
    )
    state = (
        F.when(F.col("_worst").isNull(), "unwatched")
        .when((F.col("_worst") == 0) & (F.col("unread") > 0), "degraded")
        .when(F.col("_worst") == 0, "healthy")
        .when(F.col("_worst") == 1, "degraded")
        .otherwise("broken")
    )
    return grouped.withColumn("health", state).drop("_worst")


def org_coverage(configured: DataFrame, health: DataFrame) -> DataFrame:
    """Per organisation: sources configured, sources ever read, and whether only its home page is."""
    read = health.where("last_success IS NOT NULL").select("url", F.lit(True).alias("_read"))
    return (
        configured.join(read, "url", "left")
        .groupBy("org_id")
        .agg(
            F.count("*").alias("configured"),
            F.count_if(F.col("_read")).alias("read"),
            F.bool_and(F.col("type") == "site_root").alias("homepage_only"),
        )
    )


def coverage(configured: DataFrame, health: DataFrame) -> DataFrame:
    """The whole watch list in one row."""
    per_org = org_coverage(configured, health)
    return per_org.agg(
        F.coalesce(F.sum("configured"), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.sum("read"), F.lit(0)).cast("long").alias("read"),
        F.count_if(F.col("read") == F.col("configured")).alias("orgs_fully_read"),
        F.count_if(F.col("read") == 0).alias("orgs_unread"),
        F.count_if((F.col("read") > 0) & F.col("homepage_only")).alias("orgs_homepage_only"),
    )


def blind_orgs(orgs: DataFrame, configured: DataFrame, health: DataFrame) -> DataFrame:
    """Organisations none of whose verified sources was ever read, flagged when top tier."""
    read = health.where("last_success IS NOT NULL").select("url")
    sighted = configured.join(read, "url", "left_semi").select("org_id").distinct()
    return orgs.join(sighted, "org_id", "left_anti").withColumn(
        "top_tier", F.col("tier").isin("S", "A")
    )


def coverage_drop(before: DataFrame, after: DataFrame) -> DataFrame:
    """Readable sources in two versions, and whether the loss looks systemic."""
    sides = before.select("state", F.lit("before").alias("side")).unionByName(
        after.select("state", F.lit("after").alias("side"))
    )
    counts = sides.agg(
        F.count_if((F.col("state") != "broken") & (F.col("side") == "before")).alias("was_readable"),
        F.count_if((F.col("state") != "broken") & (F.col("side") == "after")).alias("now_readable"),
    )
    lost = F.col("was_readable") - F.col("now_readable")
    alarm = (
        (F.col("was_readable") > 0)
        & (lost >= L.COVERAGE_LOST_MIN)
        & (lost / F.col("was_readable") >= L.COVERAGE_LOST_SHARE)
    )
    return counts.withColumn("lost", lost).withColumn("dropped", F.coalesce(alarm, F.lit(False)))


def newly_broken(before: DataFrame, after: DataFrame) -> DataFrame:
    was = before.where("state = 'broken'").select("url")
    return after.where("state = 'broken'").join(was, "url", "left_anti")


def channel_health(sends: DataFrame) -> DataFrame:
    """Per channel: down if a last round was due and all of it failed, healthy if any send ever worked.

    ``sends``: ``channel, round_at, key, ok``.
    """
    rounds = sends.groupBy("channel", "round_at").agg(
        F.count_if(F.col("ok")).alias("_ok"), F.count("*").alias("_due")
    )
    return (
        rounds.groupBy("channel")
        .agg(
            F.max("round_at").alias("last_attempt"),
            F.max(F.when(F.col("_ok") > 0, F.col("round_at"))).alias("last_success"),
            F.max_by("_ok", "round_at").alias("_last_ok"),
        )
        .withColumn(
            "state",
            F.when(F.col("_last_ok") == 0, "down")
            .when(F.col("last_success").isNotNull(), "healthy")
            .otherwise("untested"),
        )
        .drop("_last_ok")
    )


def unwatchable(orgs_with_sources: DataFrame) -> DataFrame:
    """Why an organisation cannot be watched, from the notes its sources carry.

    ``orgs_with_sources``: ``org_id, url, note`` (url NULL for none).  Patterns
    are tested per note and folded with ``max``; no notes are concatenated.
    """
    hits = [
        F.max(F.coalesce(F.col("note"), F.lit("")).rlike(pattern)).alias(f"_h{i}")
        for i, (pattern, _) in enumerate(L.UNWATCHABLE)
    ]
    grouped = orgs_with_sources.groupBy("org_id").agg(F.count("url").alias("_n"), *hits)
    why = F.when(F.col("_n") == 0, F.lit(L.UNWATCHABLE_NO_LINK))
    for i, (_, sentence) in enumerate(L.UNWATCHABLE):
        why = why.when(F.col(f"_h{i}"), F.lit(sentence))
    return grouped.select("org_id", why.otherwise(F.lit(L.UNWATCHABLE_OTHER)).alias("why"))


def staleness_alarms(health: DataFrame, sends: DataFrame, opportunities: DataFrame, as_of: Column) -> DataFrame:
    """One row: has collection stalled, has delivery gone quiet, is judging stuck."""
    one = (
        health.agg(F.max("last_attempt").alias("last_check"))
        .withColumn("last_sent", sends.where("via IS NULL OR via = 'push'").agg(F.max("sent_at")).scalar())
        .withColumn(
            "unjudged",
            opportunities.where(F.array_contains("flags", "needs_manual_review")).agg(F.count("*")).scalar(),
        )
    )
    since_check = hours_between(as_of, F.col("last_check"))
    since_sent = days_between(as_of, F.col("last_sent"))
    return (
        one.withColumn("stalled", F.coalesce(since_check > 3, F.lit(True)))
        .withColumn(
            "push_silent",
            F.coalesce((since_check < 24) & (since_sent > 7), F.lit(False)),
        )
        .withColumn("judging_stuck", F.col("unjudged") >= L.UNJUDGED_ALARM)
    )
