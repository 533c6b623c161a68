"""Announcement records: built from verdicts, kept through failures, never guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import address as A
from tidewatch.functions import dates as D
from tidewatch.functions import lexicon as L
from tidewatch.functions.messages import verdict_failure
from tidewatch.functions.text import let
from tidewatch.operators.relevance import relevance
from tidewatch.operators.spread import first_per_key, sized, spread_join

RECORD_COLUMNS = [
    "id", "org_id", "title", "detected", "first_seen", "last_confirmed", "status", "opens",
    "closes", "closes_hijri", "product", "majors", "seats", "stipend_sar", "duration_weeks",
    "cities", "score", "reason", "states_zero_courses_rule", "zero_courses_quote", "flags",
    "url", "apply_url", "excerpt",
]
#: Characters of the page's text that a record carries.
EXCERPT_CHARS = 400


def _excerpt(chars: int | None) -> Column:
    return (F.col("text") if chars is None else F.substring("text", 1, chars)).alias("excerpt")


def record_id(org: Column, url: Column, first_seen: Column) -> Column:
    """Organisation, page, and when the page was first seen: facts that do not move."""
    return F.substring(F.sha2(F.concat_ws("|", org, url, first_seen), 256), 1, 16)


def iso_instant(instant: Column) -> Column:
    return F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def resolve_day(iso: Column, raw: Column, end: str) -> Column:
    """``struct<day, ambiguous_order>``: the page's own wording decides.

    Wording that cannot be read is no date, never the model's conversion of it;
    the model's ISO value counts only where the page's wording was not copied.
    """
    written = F.when(F.coalesce(F.trim(raw), F.lit("")) != "", raw).otherwise(iso)
    return let(
        D.read_date(written, end),
        lambda m: F.struct(
            m["day"].alias("day"),
            F.coalesce(m["ambiguous_order"], F.lit(False)).alias("ambiguous_order"),
        ),
    )


def flags(
    product: Column, score: Column, seats: Column, stipend: Column, status: Column,
    states_rule: Column, first_time: Column, more: Column, review: Column, two_readings: Column,
) -> Column:
    return F.array_compact(
        F.array(
            F.when(product == "graduate_dev", "wrong_product"),
            F.when(score >= 90, "exact_major_match"),
            F.when(seats <= 5, "few_seats"),
            F.when(stipend > 0, "has_stipend"),
            F.when(status == "closing_soon", "closing_in_48h"),
            F.when(~states_rule, "no_course_condition"),
            F.when(first_time, "first_time_seen"),
            F.when(more, "more_on_page"),
            F.when(review, "needs_manual_review"),
            F.when(two_readings, "date_order_ambiguous"),
        )
    )


def prior_records(judged: DataFrame, records: DataFrame) -> DataFrame:
    """Judged pages beside their previous record, with ``first_time``.

    An organisation without any record when the round began is seen for the first
    time; afterwards the flag is carried by the record.
    """
    prior = first_per_key(
        records.select(
            "org_id", "url",
            F.col("id").alias("_id"),
            F.col("detected").alias("prior_detected"),
            F.col("first_seen").alias("prior_first_seen"),
            F.array_contains("flags", "first_time_seen").alias("_was_first"),
        ),
        ["org_id", "url"], F.col("_id"),
    ).drop("_id")
    history = records.select("org_id").distinct().withColumn("_known", F.lit(True))
    beside = judged.join(prior, ["org_id", "url"], "left")
    return (
        spread_join(beside, history, "org_id", "left")
        .withColumn("first_time", F.coalesce(F.col("_was_first"), F.col("_known").isNull()))
        .drop("_was_first", "_known")
    )


def from_verdicts(judged: DataFrame, as_of: Column, excerpt_chars: int | None = EXCERPT_CHARS) -> DataFrame:
    """Records of positive verdicts.

    ``judged``: ``org_id, url, text, verdict, prior_detected, prior_first_seen,
    first_time`` and the reader's ``field, reader_cities, graduated, field_label``
    (NULL field for a profile that names none).
    """
    v = F.col("verdict")
    fit = F.when(
        F.col("field").isNotNull(),
        relevance(
            v["product"], v["titleAr"], v["majors"], v["cities"], F.col("field"),
            F.col("reader_cities"), F.col("graduated"), F.col("field_label"),
        ),
    )
    backwards = F.coalesce(
        D.deadline_instant(F.col("_closes.day")) < D.opening_instant(F.col("_opens.day")), F.lit(False)
    )
    sound = ~F.col("_backwards")
    staged = (
        judged.where(v["isTrainingAnnouncement"])
        .withColumns(
            {
                "_opens": resolve_day(v["opensISO"], v["opensRaw"], "first"),
                "_closes": resolve_day(v["closesISO"], v["closesRaw"], "last"),
                "_fit": fit,
                "first_seen": F.coalesce("prior_first_seen", as_of),
            }
        )
        .withColumn("_backwards", backwards)
        .withColumns(
            {
                "opens": F.when(sound, F.col("_opens.day")),
                "closes": F.when(sound, F.col("_closes.day")),
                "score": F.when(sound, F.col("_fit.score")),
                "_review": F.col("_fit").isNull() | F.col("_backwards"),
                "_two_readings": (F.col("_opens.ambiguous_order") | F.col("_closes.ambiguous_order")) & sound,
            }
        )
        .withColumn(
            "status",
            D.status_at(F.col("opens"), F.col("closes"), v["product"], F.col("_review"), as_of),
        )
    )
    reason = (
        F.when(F.col("_backwards"), F.lit(L.REASONS["contradictory"]))
        .when(F.col("_fit").isNotNull(), F.col("_fit.reason"))
        .when(F.col("field").isNull(), F.lit(L.REASONS["no_reader"]))
        .otherwise(F.lit(L.REASONS["no_field"]))
    )
    return staged.select(
        record_id(F.col("org_id"), F.col("url"), iso_instant(F.col("first_seen"))).alias("id"),
        "org_id",
        v["titleAr"].alias("title"),
        F.coalesce("prior_detected", as_of).alias("detected"),
        "first_seen",
        as_of.alias("last_confirmed"),
        "status",
        "opens",
        "closes",
        D.hijri_label(F.col("closes")).alias("closes_hijri"),
        v["product"].alias("product"),
        v["majors"].alias("majors"),
        v["seats"].cast("int").alias("seats"),
        v["stipendSAR"].alias("stipend_sar"),
        v["durationWeeks"].alias("duration_weeks"),
        A.clean_cities(v["cities"]).alias("cities"),
        "score",
        reason.alias("reason"),
        v["statesZeroCoursesRule"].alias("states_zero_courses_rule"),
        v["zeroCoursesQuote"].alias("zero_courses_quote"),
        flags(
            v["product"], F.col("score"), v["seats"], v["stipendSAR"], F.col("status"),
            v["statesZeroCoursesRule"], F.col("first_time"), v["moreOnPage"], F.col("_review"),
            F.col("_two_readings"),
        ).alias("flags"),
        "url",
        A.apply_url(v["applyUrl"], F.col("url")).alias("apply_url"),
        _excerpt(excerpt_chars),
    )


def placeholders(failed: DataFrame, as_of: Column, excerpt_chars: int | None = EXCERPT_CHARS) -> DataFrame:
    """Records of pages nobody could judge: no score, and a flag that keeps them in view."""
    nothing = F.lit(None)
    return failed.withColumn("first_seen", F.coalesce("prior_first_seen", as_of)).select(
        record_id(F.col("org_id"), F.col("url"), iso_instant(F.col("first_seen"))).alias("id"),
        "org_id",
        F.lit(L.UNJUDGED_TITLE).alias("title"),
        F.coalesce("prior_detected", as_of).alias("detected"),
        "first_seen",
        as_of.alias("last_confirmed"),
        F.lit("unknown").alias("status"),
        nothing.cast("date").alias("opens"),
        nothing.cast("date").alias("closes"),
        nothing.cast("string").alias("closes_hijri"),
        F.lit("unknown").alias("product"),
        F.array().cast("array<string>").alias("majors"),
        nothing.cast("int").alias("seats"),
        nothing.cast("double").alias("stipend_sar"),
        nothing.cast("double").alias("duration_weeks"),
        F.array().cast("array<string>").alias("cities"),
        nothing.cast("int").alias("score"),
        F.concat(
            F.lit(L.REASONS["unjudged_prefix"]),
            verdict_failure(F.concat_ws(" — ", F.col("stage"), F.col("reason"))),
        ).alias("reason"),
        F.lit(False).alias("states_zero_courses_rule"),
        nothing.cast("string").alias("zero_courses_quote"),
        F.array(F.lit("needs_manual_review")).alias("flags"),
        "url",
        nothing.cast("string").alias("apply_url"),
        _excerpt(excerpt_chars),
    )


def merge_round(
    records: DataFrame, positive: DataFrame, negative: DataFrame, failed: DataFrame,
    failed_placeholders: DataFrame,
) -> DataFrame:
    """Records after a round of verdicts.

    A positive verdict replaces every record of its page.  A negative one only
    marks them as vanished.  A failed one flags a real reading and keeps it; a
    placeholder stands in only where there is nothing better.
    ``negative`` and ``failed`` need ``url`` (``failed`` also ``stage, reason``).
    Records are counted first and lie by page in pieces of bounded size, so that a task
    sorts no more of them when there are more.
    """
    gone = negative.select("url").distinct().withColumn("_gone", F.lit(True))
    unread = first_per_key(
        failed.select("url", "stage", F.col("reason").alias("_why")), ["url"], F.col("stage")
    )
    kept = sized(records.select(*RECORD_COLUMNS), "url").join(positive.select("url").distinct(), "url", "left_anti")
    kept = kept.join(gone, "url", "left").join(unread, "url", "left")
    real = F.col("title") != L.UNJUDGED_TITLE
    is_failed = F.col("stage").isNotNull()
    note = F.concat(
        F.lit(f" ({L.REASONS['retry_marker']}: "),
        verdict_failure(F.concat_ws(" ", F.col("stage"), F.col("_why"))),
        F.lit(")"),
    )
    already = F.contains(F.col("reason"), F.lit(L.REASONS["retry_marker"]))
    survivors = (
        kept.where(real | ~is_failed)
        .withColumn(
            "flags",
            F.when(
                is_failed, F.array_union("flags", F.array(F.lit("needs_manual_review")))
            )
            .when(F.col("_gone"), F.array_union("flags", F.array(F.lit("vanished_from_source"))))
            .otherwise(F.col("flags")),
        )
        .withColumn(
            "reason",
            F.when(is_failed & ~already, F.concat("reason", note)).otherwise(F.col("reason")),
        )
        .select(*RECORD_COLUMNS)
    )
    covered = survivors.where(F.col("title") != L.UNJUDGED_TITLE).select("url").distinct()
    stand_ins = failed_placeholders.join(covered, "url", "left_anti")
    return (
        survivors.unionByName(positive.select(*RECORD_COLUMNS))
        .unionByName(stand_ins.select(*RECORD_COLUMNS))
    )


def drop_settled_placeholders(records: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Placeholders whose page no longer owes a verdict promise a reading that will not come."""
    settled = snapshots.where("NOT pending").select("url").distinct()
    bare = (F.col("title") == L.UNJUDGED_TITLE) & F.array_contains("flags", "needs_manual_review")
    doomed = records.where(bare).join(settled, "url", "left_semi").select("id")
    return records.join(doomed, "id", "left_anti")


def drop_false(records: DataFrame, stale: DataFrame) -> DataFrame:
    """Records proved to carry wording their page, read this round, does not."""
    return records.join(stale.select("id").distinct(), "id", "left_anti")


def restate(records: DataFrame, as_of: Column) -> DataFrame:
    """Every status recomputed for the instant; only records that moved touch their 48 h flag."""
    review = F.array_contains("flags", "needs_manual_review")
    fresh = D.status_at(F.col("opens"), F.col("closes"), F.col("product"), review, as_of)
    flag = F.array(F.lit("closing_in_48h"))
    moved = F.col("_fresh") != F.col("status")
    return (
        records.withColumn("_fresh", fresh)
        .withColumn(
            "flags",
            F.when(moved & (F.col("_fresh") == "closing_soon"), F.array_union("flags", flag))
            .when(moved, F.array_except("flags", flag))
            .otherwise(F.col("flags")),
        )
        .withColumn("status", F.col("_fresh"))
        .drop("_fresh")
    )


def status_calendar(records: DataFrame, spine: DataFrame) -> DataFrame:
    """Status of each record at the instants of its own spine rows: ``id, as_of, status``.

    ``spine``: ``id, as_of``, the instants a report asks about for each record.
    """
    review = F.array_contains("flags", "needs_manual_review")
    return records.join(spine, "id").select(
        "id",
        "as_of",
        D.status_at(F.col("opens"), F.col("closes"), F.col("product"), review, F.col("as_of")).alias("status"),
    )
