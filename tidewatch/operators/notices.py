"""Things worth saying: notices decided from two versions of the records and health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import dates as D
from tidewatch.functions import lexicon as L
from tidewatch.operators.guard import announcement_key
from tidewatch.operators.health import coverage_drop, newly_broken
from tidewatch.operators.spread import first_per_key, spread_join

NOTICE_COLUMNS = ["key", "kind", "title", "body", "weight", "announcement"]


def details(as_of: Column) -> Column:
    """Title · cities · seats · days left · Hijri day; unknown parts are left out."""
    days = F.greatest(F.lit(0), D.days_left(F.col("closes"), as_of))
    return F.concat_ws(
        " · ",
        F.col("title"),
        F.when(F.size("cities") > 0, F.array_join("cities", "، ")),
        F.when(F.col("seats").isNotNull(), F.concat(F.col("seats").cast("string"), F.lit(" مقعداً"))),
        F.when(
            F.col("closes").isNotNull(),
            F.concat(F.lit("يغلق بعد "), days.cast("string"), F.lit(" يوم")),
        ),
        F.when(F.col("closes").isNotNull(), D.hijri_label(F.col("closes"))),
    )


def _notice(kind: str, key: Column, title: Column, body: Column, weight: Column) -> Column:
    return F.struct(
        key.alias("key"),
        F.lit(kind).alias("kind"),
        title.alias("title"),
        body.alias("body"),
        weight.cast("double").alias("weight"),
    )


def record_notices(before: DataFrame, after: DataFrame, names: DataFrame, threshold: int, as_of: Column) -> DataFrame:
    """Notices about records: one pass over the current version, every kind at once.

    ``before`` needs ``id, status, seats``; ``names`` is ``org_id, name``.
    """
    was = before.select(
        "id", F.col("status").alias("_was_status"), F.col("seats").alias("_was_seats"),
        F.lit(True).alias("_was"),
    )
    joined = spread_join(after.join(was, "id", "left"), names.select("org_id", "name"), "org_id")
    rows = (
        joined.withColumn(
            "announcement",
            announcement_key(F.col("org_id"), F.col("title"), F.col("closes"), F.col("url")),
        )
        .withColumn("_hours", D.hours_left(F.col("closes"), as_of))
        .withColumn("_fresh", D.days_between(as_of, F.col("first_seen")) <= L.ANNOUNCE_WINDOW_DAYS)
        .withColumn("_org", F.coalesce("name", "org_id"))
    )
    key, score = F.col("announcement"), F.col("score")

    def titled(kind: str) -> Column:
        return F.concat(F.lit(L.NOTICE_TITLES[kind]), F.col("_org"))

    fit = F.when(
        score.isNull()
        & (F.col("product") == "coop")
        & (F.trim("title") != "")
        & (F.col("title") != L.UNJUDGED_TITLE)
        & ~F.array_contains("flags", "vanished_from_source")
        & F.col("_fresh"),
        _notice(
            "fit_unknown", F.concat(F.lit("fit:"), key), titled("fit_unknown"),
            F.concat(F.col("title"), F.lit(" · " + L.NOTICE_BODIES["fit_unknown"])),
            F.lit(L.BANDS["fit_unknown"]),
        ),
    )
    new = F.when(
        (score >= max(60, threshold)) & F.col("_fresh"),
        _notice("new_relevant", F.concat(F.lit("new:"), key), titled("new_relevant"),
                details(as_of), score + L.BANDS["new_relevant"]),
    )
    opened = F.when(
        score.isNotNull() & F.col("_was") & (F.col("_was_status") != "open") & (F.col("status") == "open"),
        _notice("opened", F.concat(F.lit("opened:"), key), titled("opened"),
                details(as_of), score + L.BANDS["opened"]),
    )
    remaining = F.concat(
        F.col("title"), F.lit(" · تبقّى "), F.ceil("_hours").cast("string"), F.lit(" ساعة"),
        F.when(F.size("cities") > 0, F.concat(F.lit(" · "), F.array_join("cities", "، "))).otherwise(""),
        F.when(
            F.col("seats").isNotNull(),
            F.concat(F.lit(" · "), F.col("seats").cast("string"), F.lit(" مقعداً")),
        ).otherwise(""),
    )
    closing = F.when(
        score.isNotNull() & (F.col("_hours") > 0) & (F.col("_hours") <= L.CLOSING_SOON_HOURS),
        _notice(
            "closing_soon",
            F.concat_ws(":", F.lit("closing"), key, F.col("closes").cast("string")),
            titled("closing_soon"), remaining, score + L.BANDS["closing_soon"],
        ),
    )
    seats = F.when(
        (F.col("seats") <= 5) & (score >= 70) & ~F.col("_was_seats").eqNullSafe(F.col("seats")),
        _notice(
            "few_seats", F.concat_ws(":", F.lit("seats"), key, F.col("seats").cast("string")),
            titled("few_seats"),
            F.concat(F.col("title"), F.lit(" · "), F.col("seats").cast("string"), F.lit(" مقاعد")),
            score + L.BANDS["few_seats"],
        ),
    )
    every = F.array_compact(F.array(fit, new, opened, closing, seats))
    return (
        rows.where(~F.array_contains("flags", "wrong_product"))
        .select("announcement", F.explode(every).alias("n"))
        .select("n.*", "announcement")
    )


def broken_notices(before: DataFrame, after: DataFrame, names: DataFrame, as_of: Column) -> DataFrame:
    """One notice per newly broken source, or a single one when several broke at once.

    The joint notice counts them, and its key is a digest of the whole set, so its form
    does not depend on how many there are; ``newly_broken`` has their names.
    """
    broken = newly_broken(before, after).select("url", "org_id")
    named = spread_join(broken, names.select("org_id", "name"), "org_id").withColumn(
        "_name", F.coalesce("name", "org_id")
    )
    prefix = F.lit(L.NOTICE_TITLES["source_broken"])
    single = named.where(named.agg(F.count("*")).scalar() == 1).select(
        F.concat(F.lit("broken:"), F.col("url")).alias("key"),
        F.lit("source_broken").alias("kind"),
        F.concat(prefix, F.col("_name")).alias("title"),
        F.lit(L.NOTICE_BODIES["source_broken"]).alias("body"),
    )
    together = named.agg(
        F.count("*").alias("_n"), F.bit_xor(F.xxhash64("_name", "url")).alias("_a"), F.sum(F.xxhash64("url", "_name").cast("decimal(38,0)")).alias("_b")
    ).where("_n > 1")
    digest = F.substring(F.sha2(F.concat_ws("|", "_n", "_a", "_b"), 256), 1, 32)
    joint = together.select(
        F.concat_ws(":", F.lit("broken"), D.riyadh_day(as_of).cast("string"), digest).alias("key"),
        F.lit("source_broken").alias("kind"),
        F.concat(F.lit("🔴 "), F.col("_n").cast("string"), F.lit(" مصادر توقّفت")).alias("title"),
        F.lit(L.NOTICE_BODIES["sources_broken"]).alias("body"),
    )
    return single.unionByName(joint).select(
        "*",
        F.lit(float(L.BANDS["source_broken"])).alias("weight"),
        F.lit(None).cast("string").alias("announcement"),
    )


def coverage_notice(before: DataFrame, after: DataFrame, as_of: Column) -> DataFrame:
    day = D.riyadh_day(as_of).cast("string")
    return coverage_drop(before, after).where("dropped").select(
        F.concat_ws(":", F.lit("coverage"), day).alias("key"),
        F.lit("coverage_dropped").alias("kind"),
        F.concat(F.lit("🔴 "), F.col("lost").cast("string"), F.lit(" مصدراً توقّف دفعة واحدة")).alias("title"),
        F.concat(
            F.lit("كانت "), F.col("was_readable").cast("string"), F.lit(" صفحة تُقرأ وصارت "),
            F.col("now_readable").cast("string"), F.lit("."),
        ).alias("body"),
        F.lit(float(L.BANDS["coverage_dropped"])).alias("weight"),
        F.lit(None).cast("string").alias("announcement"),
    )


def stalled_notice(before: DataFrame, after: DataFrame, as_of: Column) -> DataFrame:
    """The queue of unjudged records is long and did not move since the last version."""
    unjudged = F.array_contains("flags", "needs_manual_review")
    sides = before.select("flags", F.lit("before").alias("side")).unionByName(
        after.select("flags", F.lit("after").alias("side"))
    )
    counts = sides.agg(
        F.count_if(F.col("side") == "before").alias("_before_rows"),
        F.count_if(unjudged & (F.col("side") == "before")).alias("_unjudged_before"),
        F.count_if(unjudged & (F.col("side") == "after")).alias("unjudged"),
    )
    moved = (F.col("_before_rows") > 0) & (F.col("unjudged") < F.col("_unjudged_before"))
    day = D.riyadh_day(as_of).cast("string")
    return counts.where((F.col("unjudged") >= L.UNJUDGED_ALARM) & ~moved).select(
        F.concat_ws(":", F.lit("classifier"), day).alias("key"),
        F.lit("classifier_down").alias("kind"),
        F.lit(L.NOTICE_TITLES["classifier_down"]).alias("title"),
        F.concat(
            F.col("unjudged").cast("string"),
            F.lit(" صفحة قُرئت ولم يُحكم عليها، ولم ينقص العدد في هذه الجولة."),
        ).alias("body"),
        F.lit(float(L.BANDS["classifier_down"])).alias("weight"),
        F.lit(None).cast("string").alias("announcement"),
    )


def best_per_key(notices: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The heaviest notice of each key."""
    return first_per_key(notices, keys or ["key"], -F.col("weight"), F.col("title"), F.col("body"))


def decide(
    before: DataFrame, after: DataFrame, health_before: DataFrame, health_after: DataFrame,
    names: DataFrame, as_of: Column, threshold: int = 60,
) -> DataFrame:
    """Every notice two versions call for, one per key."""
    said = (
        record_notices(before, after, names, threshold, as_of).select(*NOTICE_COLUMNS)
        .unionByName(broken_notices(health_before, health_after, names, as_of).select(*NOTICE_COLUMNS))
        .unionByName(coverage_notice(health_before, health_after, as_of).select(*NOTICE_COLUMNS))
        .unionByName(stalled_notice(before, after, as_of).select(*NOTICE_COLUMNS))
    )
    return best_per_key(said)


def follow_ups(applications: DataFrame, reminded: DataFrame, as_of: Column) -> DataFrame:
    """Applications two weeks old that nobody was reminded of."""
    due = D.days_between(as_of, F.col("applied_at")) >= L.FOLLOW_UP_DAYS
    return applications.where((F.col("mark") == "applied") & due).join(
        reminded.select("reader_id", "id"), ["reader_id", "id"], "left_anti"
    )
