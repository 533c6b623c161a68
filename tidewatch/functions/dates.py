"""Two calendars, dates written in prose, and what a deadline means at an instant.

The Umm al-Qura calendar is a table, not a formula.  It is read once per session
from the JDK's own calendar and carried as one array of month starts, so a
conversion is a lookup inside an expression and needs neither join nor Python.
"""

from __future__ import annotations

import datetime as dt
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import lexicon as L
from tidewatch.functions.text import let, western_digits

_EPOCH = dt.date(1970, 1, 1)
_MEAN_MONTH_DAYS = 29.530588853


@lru_cache(maxsize=1)
def month_starts() -> tuple[int, ...]:
    """Days since 1970 on which each month begins, plus the end of the last one."""
    spark = SparkSession.getActiveSession()
    chrono = spark._jvm.java.time.chrono.HijrahChronology.INSTANCE
    starts = [
        chrono.date(year, month, 1).toEpochDay()
        for year in range(L.HIJRI_FIRST_YEAR, L.HIJRI_LAST_YEAR + 1)
        for month in range(1, 13)
    ]
    last = chrono.date(L.HIJRI_LAST_YEAR, 12, 1)
    return tuple([*starts, starts[-1] + last.lengthOfMonth()])


def _starts() -> Column:
    return F.expr("array(" + ",".join(map(str, month_starts())) + ")")


def calendar_dimension(spark: SparkSession) -> DataFrame:
    """One row per month: ``hijri_year, hijri_month, first_day, days``."""
    starts = month_starts()
    return (
        spark.range(len(starts) - 1)
        .withColumn("start", F.element_at(_starts(), (F.col("id") + 1).cast("int")))
        .withColumn("next", F.element_at(_starts(), (F.col("id") + 2).cast("int")))
        .select(
            (F.lit(L.HIJRI_FIRST_YEAR) + F.floor(F.col("id") / 12)).cast("int").alias("hijri_year"),
            (F.pmod("id", F.lit(12)) + 1).cast("int").alias("hijri_month"),
            F.date_from_unix_date("start").alias("first_day"),
            (F.col("next") - F.col("start")).cast("int").alias("days"),
        )
    )


def hijri_to_date(year: Column, month: Column, day: Column) -> Column:
    """The Gregorian day, NULL for a day the calendar does not have."""
    in_range = year.between(L.HIJRI_FIRST_YEAR, L.HIJRI_LAST_YEAR) & month.between(1, 12)
    slot = F.when(in_range, (year - L.HIJRI_FIRST_YEAR) * 12 + month).cast("int")

    def within(n: Column) -> Column:
        start = F.try_element_at(_starts(), n)
        length = F.try_element_at(_starts(), n + 1) - start
        return F.when(
            (day >= 1) & (day <= length), F.date_from_unix_date(start + day.cast("int") - 1)
        )

    return let(slot, within)


def hijri_parts(day: Column) -> Column:
    """``struct<year, month, day>`` of a Gregorian date, NULL outside the table.

    Months drift less than a day from their mean length over the table's span,
    so the right one is the estimate or a neighbour; no range join is needed.
    """
    first, last = month_starts()[0], month_starts()[-1]
    days = F.unix_date(day)
    guess = F.greatest(F.floor((days - first) / _MEAN_MONTH_DAYS).cast("int") - 1, F.lit(0))

    def nearest(g: Column) -> Column:
        near = F.transform(
            F.array(F.lit(0), F.lit(1), F.lit(2)),
            lambda i: F.struct(F.try_element_at(_starts(), g + i + 1).alias("start"), (g + i).alias("slot")),
        )
        return F.try_element_at(F.filter(near, lambda month: month["start"] <= days), F.lit(-1))

    def parts(month: Column) -> Column:
        return F.struct(
            (F.lit(L.HIJRI_FIRST_YEAR) + F.floor(month["slot"] / 12)).cast("int").alias("year"),
            (F.pmod(month["slot"], F.lit(12)) + 1).cast("int").alias("month"),
            (days - month["start"] + 1).cast("int").alias("day"),
        )

    found = let(let(guess, nearest), parts)
    return F.when(days.between(first, last - 1), found)


def _arabic_digits(number: Column) -> Column:
    return F.translate(number.cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")


def hijri_label(day: Column) -> Column:
    names = F.array(*[F.lit(name) for name in L.HIJRI_MONTH_NAMES])

    def label(parts: Column) -> Column:
        words = F.concat_ws(
            " ",
            _arabic_digits(parts["day"]),
            F.try_element_at(names, parts["month"]),
            _arabic_digits(parts["year"]),
            F.lit("هـ"),
        )
        return F.when(parts.isNotNull(), words)

    return let(hijri_parts(day), label)


def gregorian_label(day: Column) -> Column:
    names = F.array(*[F.lit(name) for name in L.GREGORIAN_MONTH_NAMES])
    label = F.concat_ws(
        " ",
        F.dayofmonth(day).cast("string"),
        F.try_element_at(names, F.month(day)),
        F.year(day).cast("string"),
    )
    return F.when(day.isNotNull(), label).otherwise("لم يُعلن")


# ---- dates written in text ----------------------------------------------------

_MARK, _END = "\x01", "\x02"

MENTION = (
    "struct<position:int,length:int,day:date,calendar:string,"
    "ambiguous_year:boolean,ambiguous_order:boolean,matched:string>"
)


def _sightings(text: Column, pattern: str) -> Column:
    """Every match with its position: ``array<struct<position, matched>>``.

    The matches are fenced with marks and the text split at them, so a position
    is the total length of what came before.
    """
    nothing = F.expr("cast(array() as array<struct<position:int,matched:string>>)")

    def step(state: Column, piece: Column) -> Column:
        one = F.struct(
            state["next"].alias("position"), F.substring_index(piece, _END, 1).alias("matched")
        )
        return F.struct(
            (state["next"] + F.length(piece) - 1).alias("next"),
            F.concat(state["found"], F.array(one)).alias("found"),
        )

    def walk(pieces: Column) -> Column:
        start = F.struct(F.length(pieces[0]).alias("next"), nothing.alias("found"))
        rest = F.slice(pieces, F.lit(2), F.size(pieces))
        return F.aggregate(rest, start, step, lambda state: state["found"])

    return let(F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_END}"), _MARK), walk)


def _month_number(matched: Column, table: list[tuple[str, int]]) -> Column:
    out = None
    for pattern, month in table:
        hit = matched.rlike(f"^(?:{pattern})$")
        out = F.when(hit, month) if out is None else out.when(hit, month)
    return out


def _real_day(year: Column, month: Column, day: Column) -> Column:
    """A Gregorian date, NULL when no such day exists."""
    written = F.concat_ws(
        "-", F.lpad(year.cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"),
        F.lpad(day.cast("string"), 2, "0"),
    )
    fits = month.between(1, 12) & day.between(1, 31)
    return F.when(fits, written.try_cast("date"))


def _mention(position, length, day, calendar, ambiguous_year, ambiguous_order, matched) -> Column:
    return F.struct(
        position.cast("int").alias("position"), length.cast("int").alias("length"),
        day.cast("date").alias("day"), calendar.cast("string").alias("calendar"),
        ambiguous_year.cast("boolean").alias("ambiguous_year"),
        ambiguous_order.cast("boolean").alias("ambiguous_order"),
        matched.cast("string").alias("matched"),
    )


def _named_mentions(text: Column, table: list[tuple[str, int]], calendar: str) -> Column:
    found = _sightings(text, "(?:" + "|".join(pattern for pattern, _ in table) + ")")

    def context(sighting: Column) -> Column:
        at, name = sighting["position"], sighting["matched"]
        before = F.substring(text, F.greatest(at - 16, F.lit(0)) + 1, F.least(at, F.lit(16)))
        after = F.substring(text, at + F.length(name) + 1, F.lit(14))
        digits = F.regexp_extract(before, L.DAY_BEFORE, 1)
        return F.struct(
            at.alias("at"),
            name.alias("name"),
            F.when(digits != "", digits).when(before.rlike(L.FIRST_OF_MONTH), F.lit("1")).alias("day"),
            F.regexp_extract(after, L.YEAR_AFTER, 1).alias("year"),
            _month_number(name, table).alias("month"),
        )

    def read(c: Column) -> Column:
        shape = "^1[34][0-9]{2}$" if calendar == "hijri" else "^(?:19|20|21)[0-9]{2}$"
        convert = hijri_to_date if calendar == "hijri" else _real_day
        known = c["year"].rlike(shape)
        day = convert(c["year"].try_cast("int"), c["month"], c["day"].try_cast("int"))
        matched = F.concat_ws(" ", c["day"], c["name"], F.when(known, c["year"]))
        return _mention(
            c["at"], F.length(matched), F.when(known, day), F.lit(calendar), ~known, F.lit(False), matched
        )

    with_day = F.filter(F.transform(found, context), lambda c: c["day"].isNotNull())
    return F.transform(with_day, read)


def _numeric_mentions(text: Column) -> Column:
    found = _sightings(text, L.NUMERIC_DATE)

    def parts(sighting: Column) -> Column:
        written = sighting["matched"]
        a, b, c = (F.regexp_extract(written, L.NUMERIC_DATE, group) for group in (1, 2, 3))
        year_first = F.length(a) == 4
        return F.struct(
            sighting["position"].alias("at"),
            written.alias("written"),
            year_first.alias("year_first"),
            F.when(year_first, a).otherwise(c).cast("int").alias("year"),
            b.cast("int").alias("month"),
            F.when(year_first, c).otherwise(a).cast("int").alias("day"),
        )

    def read(p: Column) -> Column:
        year, month, day = p["year"], p["month"], p["day"]
        hijri = year.between(L.HIJRI_FIRST_YEAR, L.HIJRI_LAST_YEAR)
        gregorian = year.between(1900, 2200)
        resolved = F.when(hijri, hijri_to_date(year, month, day)).when(
            gregorian, _real_day(year, month, day)
        )
        two_readings = gregorian & ~p["year_first"] & (day <= 12) & (month <= 12) & (day != month)
        return _mention(
            p["at"], F.length(p["written"]), resolved,
            F.when(hijri, "hijri").when(gregorian, "gregorian"),
            F.lit(False), two_readings, p["written"],
        )

    return F.transform(F.transform(found, parts), read)


def clean_for_dates(text: Column) -> Column:
    return F.regexp_replace(western_digits(text), L.ZERO_WIDTH, "")


def date_mentions(text: Column) -> Column:
    """Every date a text writes, in order of appearance, longest first at one place.

    A mention whose year is not written has a NULL day and ``ambiguous_year``; a
    ``12/03/2026`` that reads two ways keeps its day-first reading and says so.
    """
    def read(cleaned: Column) -> Column:
        none = F.expr(f"cast(array() as array<{MENTION}>)")
        # Each scan runs only where its script and a digit (or "first of") occur.
        hijri = F.when(cleaned.rlike("[\\u0600-\\u06FF]"), _named_mentions(cleaned, L.HIJRI_MONTHS, "hijri"))
        named = F.when(
            cleaned.rlike(f"(?i){'|'.join(L.EXCERPT_MONTHS[9:])}|يوني|يولي"),
            _named_mentions(cleaned, L.GREGORIAN_MONTHS, "gregorian"),
        )
        numeric = F.when(
            cleaned.rlike(f"[0-9]{L.WS}*[/\\-.]{L.WS}*[0-9]"), _numeric_mentions(cleaned)
        )
        every = F.concat(
            F.coalesce(hijri, none), F.coalesce(named, none), F.coalesce(numeric, none)
        )
        ranked = F.array_sort(
            F.transform(
                every,
                lambda m: F.struct(
                    m["position"].alias("position"), (-m["length"]).alias("shortness"), m.alias("mention")
                ),
            )
        )
        mentions = F.transform(ranked, lambda r: r["mention"])
        worth_reading = cleaned.rlike("[0-9]|غرّة|غرة|أوّل|أول|اول")
        return F.when(worth_reading, mentions).otherwise(F.expr(f"cast(array() as array<{MENTION}>)"))

    return let(clean_for_dates(text), read)


def pick_mention(mentions: Column, end: str) -> Column:
    """The first or last mention, a readable date before one without a year."""
    at = F.lit(-1 if end == "last" else 1)

    def pick(found: Column) -> Column:
        readable = F.filter(found, lambda m: m["day"].isNotNull())
        return F.coalesce(F.try_element_at(readable, at), F.try_element_at(found, at))

    return let(mentions, pick)


def read_date(text: Column, end: str = "first") -> Column:
    """The mention a piece of text stands for; NULL when it writes no date."""
    return pick_mention(date_mentions(text), end)


# ---- instants -----------------------------------------------------------------


def opening_instant(day: Column) -> Column:
    """The first instant of a published day, in Riyadh."""
    return F.to_utc_timestamp(day.cast("timestamp"), L.ZONE)


def deadline_instant(day: Column) -> Column:
    """The last instant of a published day: a deadline stands until its day ends."""
    return F.to_utc_timestamp(
        F.concat(day.cast("string"), F.lit(" 23:59:59.999")).cast("timestamp"), L.ZONE
    )


def written_instant(text: Column, end_of_day: bool) -> Column:
    """An instant from text: a bare day by the rules above, a full timestamp as it is."""
    bare = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    day = text.try_cast("date")
    edge = deadline_instant(day) if end_of_day else opening_instant(day)
    return F.when(bare, edge).otherwise(text.try_cast("timestamp"))


def micros(instant: Column) -> Column:
    return F.unix_micros(instant.cast("timestamp"))


def hours_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(3_600_000_000.0)


def days_between(later: Column, earlier: Column) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def hours_left(closes: Column, as_of: Column) -> Column:
    return hours_between(deadline_instant(closes), as_of)


def days_left(closes: Column, as_of: Column) -> Column:
    return F.ceil(hours_left(closes, as_of) / 24).cast("int")


def riyadh_day(instant: Column) -> Column:
    return F.from_utc_timestamp(instant, L.ZONE).cast("date")


def riyadh_hour(instant: Column) -> Column:
    return F.hour(F.from_utc_timestamp(instant, L.ZONE))


def in_quiet_hours(instant: Column, start: int = 23, end: int = 7) -> Column:
    hour = riyadh_hour(instant)
    if start <= end:
        return (hour >= start) & (hour < end)
    return (hour >= start) | (hour < end)


def status_at(opens: Column, closes: Column, product: Column, needs_review: Column, as_of: Column) -> Column:
    """The window state at an instant, from the published days alone."""
    opened, closed = opening_instant(opens), deadline_instant(closes)
    soon = micros(closed) - micros(as_of) <= L.CLOSING_SOON_HOURS * 3_600_000_000
    recent = micros(as_of) - micros(opened) <= L.OPEN_WITHOUT_DEADLINE_DAYS * 86_400_000_000
    undated = opens.isNull() & closes.isNull()
    return (
        F.when(product == "graduate_dev", "unknown")
        .when(needs_review & undated, "unknown")
        .when(closed < as_of, "closed")
        .when(opened > as_of, "announced_not_open")
        .when(closes.isNotNull() & soon, "closing_soon")
        .when(closes.isNull() & opens.isNotNull(), F.when(recent, "open").otherwise("unknown"))
        .when(~undated, "open")
        .otherwise("unknown")
    )


def season_start(as_of: Column) -> Column:
    """September opens the season; from August on it is this year's."""
    year = F.when(F.month(as_of) >= 8, F.year(as_of)).otherwise(F.year(as_of) - 1)
    return F.make_date(year, F.lit(9), F.lit(1))


def season_position(instant: Column, as_of: Column) -> Column:
    """Where an instant falls between 1 September and 1 March, clipped to [0, 1]."""
    start = season_start(as_of)
    end = F.add_months(start, 6)
    span = F.unix_date(end) - F.unix_date(start)
    at = (micros(instant) - micros(start.cast("timestamp"))) / F.lit(86_400_000_000.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), at / span))


def time_ago(instant: Column, as_of: Column) -> Column:
    """A coarse age in words; what never happened says so."""
    minutes = F.round((micros(as_of) - micros(instant)) / F.lit(60_000_000.0)).cast("int")
    hours = F.round(minutes / 60).cast("int")
    days = F.round(hours / 24).cast("int")

    def words(n: Column, unit: str) -> Column:
        return F.concat(F.lit("قبل "), n.cast("string"), F.lit(f" {unit}"))

    return (
        F.when(instant.isNull(), "لم يُفحص بعد")
        .when(minutes < 2, "الآن")
        .when(minutes < 60, words(minutes, "دقيقة"))
        .when(hours < 24, words(hours, "ساعة"))
        .otherwise(words(days, "يوم"))
    )
