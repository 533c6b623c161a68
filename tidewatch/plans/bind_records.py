"""Operators over announcement records: orders stand for records, customers for readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidewatch.functions import address as A
from tidewatch.functions import dates as D
from tidewatch.functions import fields
from tidewatch.functions import lexicon as L
from tidewatch.operators import asof, due, guard, notices, quality, records, relevance, reports, routing
from tidewatch.operators.judge import VERDICT_TYPE
from tidewatch.plans.registry import query, table
from tidewatch.plans.sqltext import q
from tidewatch.session import scratch_dir

BEFORE, AFTER = "1998-10-05 09:00:00", "1998-10-10 09:00:00"

TITLES = {
    "1-URGENT": "Cooperative Training", "2-HIGH": "Cyber Security Co-op", "3-MEDIUM": "Summer Training",
    "4-NOT SPECIFIED": L.UNJUDGED_TITLE, "5-LOW": "Graduate Programme",
}


def at(text: str):
    return F.lit(text).cast("timestamp")


def by(column: str, choices: dict, otherwise=None):
    out = None
    for key, value in choices.items():
        hit = F.col(column) == key
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out if otherwise is None else out.otherwise(otherwise)


def base_records(spark, sf):
    """Orders as records.  F has both days, O only a deadline, P only an opening."""
    day = F.col("o_orderdate").cast("date")
    p = F.col("o_orderpriority")
    price = F.floor("o_totalprice").cast("long")
    none = F.array().cast("array<string>")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("org_id"),
        by("o_orderpriority", TITLES).alias("title"),
        F.col("o_orderdate").cast("timestamp").alias("detected"),
        F.col("o_orderdate").cast("timestamp").alias("first_seen"),
        F.col("o_orderdate").cast("timestamp").alias("last_confirmed"),
        F.when(F.col("o_orderstatus") != "O", day).alias("opens"),
        F.when(F.col("o_orderstatus") == "F", F.date_add(day, 30))
        .when(F.col("o_orderstatus") == "O", F.date_add(day, 45)).alias("closes"),
        F.lit(None).cast("string").alias("closes_hijri"),
        F.when(p == "5-LOW", "graduate_dev").when(p == "4-NOT SPECIFIED", "unknown").otherwise("coop").alias("product"),
        F.array(F.col("o_orderpriority")).alias("majors"),
        (price % 20).cast("int").alias("seats"),
        F.when(price % 3 == 0, (price % 1000).cast("double")).alias("stipend_sar"),
        F.lit(None).cast("double").alias("duration_weeks"),
        F.when(price % 3 == 0, F.array(F.lit("الرياض"))).when(price % 3 == 1, none)
        .otherwise(F.array(F.lit("جدة"), F.lit("الدمام"))).alias("cities"),
        F.when(p != "4-NOT SPECIFIED", (F.floor(price / 5000) % 101).cast("int")).alias("score"),
        F.when(p == "4-NOT SPECIFIED", "BadRequestError 400: credit balance is too low").otherwise("مجال تقني عام.").alias("reason"),
        (price % 7 == 0).alias("states_zero_courses_rule"),
        F.when(price % 14 == 0, "no courses").alias("zero_courses_quote"),
        F.when(p == "4-NOT SPECIFIED", F.array(F.lit("needs_manual_review")))
        .when(p == "5-LOW", F.array(F.lit("wrong_product"))).otherwise(none).alias("flags"),
        F.concat(F.lit("https://c"), F.col("o_custkey").cast("string"), F.lit(".example.org/o/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.lit(None).cast("string").alias("apply_url"),
        F.lit("").alias("excerpt"),
        "o_orderstatus", "o_totalprice",
    )


def with_status(recs, instant: str):
    review = F.array_contains("flags", "needs_manual_review")
    return recs.withColumn(
        "status", D.status_at(F.col("opens"), F.col("closes"), F.col("product"), review, at(instant))
    )


def version(spark, sf, instant: str):
    return with_status(base_records(spark, sf), instant).select(*records.RECORD_COLUMNS)


TITLE_SQL = "CASE o_orderpriority " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in TITLES.items()) + " END"
REC = f"""rec AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, 'c' || o_custkey AS org_id, {TITLE_SQL} AS title, o_orderdate AS first_seen,
  CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) END AS opens,
  CAST(CASE o_orderstatus WHEN 'F' THEN CAST(o_orderdate AS DATE) + 30 WHEN 'O' THEN CAST(o_orderdate AS DATE) + 45 END AS DATE) AS closes,
  CASE o_orderpriority WHEN '5-LOW' THEN 'graduate_dev' WHEN '4-NOT SPECIFIED' THEN 'unknown' ELSE 'coop' END AS product,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 20 AS INTEGER) AS seats, CAST(floor(o_totalprice) AS BIGINT) AS price,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN CAST((CAST(floor(o_totalprice) AS BIGINT) // 5000) % 101 AS INTEGER) END AS score,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN ['needs_manual_review'] WHEN '5-LOW' THEN ['wrong_product'] ELSE CAST([] AS VARCHAR[]) END AS flags,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'BadRequestError 400: credit balance is too low' ELSE 'مجال تقني عام.' END AS reason,
  'https://c' || o_custkey || '.example.org/o/' || o_orderkey AS url, o_orderstatus, o_totalprice, o_orderpriority FROM orders)"""


def status_sql(t: str) -> str:
    deadline = "(epoch_us(CAST(closes AS TIMESTAMP)) + 86400000000 - 10800000000 - 1000)"
    opening = "(epoch_us(CAST(opens AS TIMESTAMP)) - 10800000000)"
    return f"""CASE WHEN product = 'graduate_dev' THEN 'unknown' WHEN list_contains(flags, 'needs_manual_review') AND opens IS NULL AND closes IS NULL THEN 'unknown'
  WHEN {deadline} < {t} THEN 'closed' WHEN {opening} > {t} THEN 'announced_not_open'
  WHEN closes IS NOT NULL AND {deadline} - {t} <= 172800000000 THEN 'closing_soon'
  WHEN closes IS NULL AND opens IS NOT NULL THEN CASE WHEN {t} - {opening} <= 7776000000000 THEN 'open' ELSE 'unknown' END
  WHEN opens IS NOT NULL OR closes IS NOT NULL THEN 'open' ELSE 'unknown' END"""


def lit_us(t: str) -> str:
    return f"epoch_us(TIMESTAMP '{t}')"


@query("status_as_of", f"WITH {REC} SELECT id, {status_sql(lit_us(AFTER))} AS status, CAST(ceil((epoch_us(CAST(closes AS TIMESTAMP)) + 75600000000 - 1000 - {lit_us(AFTER)}) / 86400000000.0) AS INTEGER) AS days_left FROM rec")
def status_as_of(spark, sf):
    recs = with_status(base_records(spark, sf), AFTER)
    return recs.select("id", "status", D.days_left(F.col("closes"), at(AFTER)).alias("days_left"))


@query("status_calendar", f"""
WITH {REC}, s AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS id, l_shipdate AS as_of FROM lineitem)
SELECT id, epoch_us(as_of) AS as_of, {status_sql('epoch_us(as_of)')} AS status FROM rec JOIN s USING (id)""")
def status_calendar(spark, sf):
    spine = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"), F.col("l_shipdate").cast("timestamp").alias("as_of")
    ).distinct()
    return records.status_calendar(base_records(spark, sf), spine).select(
        "id", F.unix_micros("as_of").alias("as_of"), "status"
    )


# An order is recorded, gets a later deadline 200 days on, and loses its days 500 days on.
VERSIONS = {0: (0, "closes", "opens"), 1: (200, "closes + 30", "opens"), 2: (500, "NULL", "NULL")}


@query("records_as_of", f"""
WITH {REC}, v AS ({" UNION ALL ".join(
    f"SELECT id, product, CAST(first_seen + INTERVAL {days} DAY AS TIMESTAMP) AS recorded, CAST({opens} AS DATE) AS opens, CAST({closes} AS DATE) AS closes, "
    f"{'CAST([' + q('needs_manual_review') + '] AS VARCHAR[])' if n == 2 else 'flags'} AS flags FROM rec"
    for n, (days, closes, opens) in VERSIONS.items())}),
f AS (SELECT row_number() OVER () AS n, CAST(l_orderkey AS VARCHAR) AS id, l_linenumber, l_shipdate AS as_of FROM lineitem),
j AS (SELECT f.n, any_value(f.id) AS id, any_value(l_linenumber) AS l_linenumber, any_value(as_of) AS as_of,
  arg_max({{'opens': opens, 'closes': closes, 'product': product, 'flags': flags, 'recorded': recorded}}, recorded) AS v
  FROM f LEFT JOIN v ON v.id = f.id AND v.recorded <= f.as_of GROUP BY f.n),
w AS (SELECT id, l_linenumber, as_of, v.recorded AS recorded, v.opens AS opens, v.closes AS closes, v.product AS product, v.flags AS flags FROM j)
SELECT id, l_linenumber, epoch_us(as_of) AS as_of, epoch_us(recorded) AS known_since,
  CASE WHEN recorded IS NOT NULL THEN {status_sql('epoch_us(as_of)')} END AS status FROM w""")
def records_as_of(spark, sf):
    """Order lines ask what was known of their order on the day they were shipped."""
    base = base_records(spark, sf)
    later = base.withColumns({"first_seen": F.expr("first_seen + INTERVAL 200 DAY"), "closes": F.date_add("closes", 30)})
    undated = base.withColumns({
        "first_seen": F.expr("first_seen + INTERVAL 500 DAY"), "opens": F.lit(None).cast("date"), "closes": F.lit(None).cast("date"),
        "flags": F.array(F.lit("needs_manual_review")),
    })
    columns = ["id", F.col("first_seen").alias("recorded"), "opens", "closes", "product", "flags"]
    versions = base.select(*columns).unionByName(later.select(*columns)).unionByName(undated.select(*columns))
    asked = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"), "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("as_of")
    )
    told = asof.statuses_as_of(asked, versions)
    return told.select("id", "l_linenumber", F.unix_micros("as_of").alias("as_of"), F.unix_micros("known_since").alias("known_since"), "status")


@query("restated_records", f"""
WITH {REC}, v AS (SELECT id, flags, {status_sql(lit_us(BEFORE))} AS old, {status_sql(lit_us(AFTER))} AS status FROM rec)
SELECT id, status, array_to_string(CASE WHEN old <> status AND status = 'closing_soon' THEN list_append(flags, 'closing_in_48h') ELSE flags END, ',') AS flags FROM v""")
def restated_records(spark, sf):
    fresh = records.restate(version(spark, sf, BEFORE), at(AFTER))
    return fresh.select("id", "status", F.array_join("flags", ",").alias("flags"))


# The first day of each Umm al-Qura year, and its months (1: thirty days, 0: twenty-nine).
HIJRI_YEARS = """
1415 1994-06-11 010100101011
1416 1995-05-31 101010010101
1417 1996-05-19 101100101010
1418 1997-05-08 101101010101
1419 1998-04-28 010101011100
1420 1999-04-17 010010111101
1421 2000-04-06 001000111101
1422 2001-03-26 100100011101
"""
HIJRI_CTE = "y AS (SELECT * FROM (VALUES {}) t(year, first, months)),".format(
    ", ".join("({}, DATE '{}', '{}')".format(*line.split()) for line in HIJRI_YEARS.split("\n") if line)
) + """
m AS (SELECT year, i AS month, 29 + CAST(months[i] AS INTEGER) AS days,
  first + CAST(29 * (i - 1) + length(replace(months[1 : i - 1], '0', '')) AS INTEGER) AS first_day FROM y, (SELECT unnest(range(1, 13)) AS i))"""


@query("hijri_round_trip", f"""
WITH {HIJRI_CTE}, o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT o_orderkey, CAST(year AS INTEGER) AS year, CAST(month AS INTEGER) AS month, CAST(date_diff('day', first_day, day) + 1 AS INTEGER) AS day_of_month, day AS back, true AS labelled
FROM o JOIN m ON day >= first_day AND day < first_day + days""")
def hijri_round_trip(spark, sf):
    day = F.col("o_orderdate").cast("date")
    parts = table(spark, sf, "orders").select("o_orderkey", day.alias("day"), D.hijri_parts(day).alias("h"))
    return parts.select(
        "o_orderkey", "h.year", "h.month", F.col("h.day").alias("day_of_month"),
        D.hijri_to_date(F.col("h.year"), F.col("h.month"), F.col("h.day")).alias("back"),
        D.hijri_label(F.col("day")).endswith("هـ").alias("labelled"),
    )


_SPELLED = [["محرم", "المحرم"], ["صفر"], ["ربيع الأول"], ["ربيع الآخر", "ربيع الثاني"], ["جمادى الأولى"], ["جمادى الآخرة", "جمادى الثانية"],
            ["رجب"], ["شعبان"], ["رمضان"], ["شوال"], ["ذو القعدة"], ["ذو الحجة"]]


@query("hijri_written_dates", f"""
WITH {HIJRI_CTE}, o AS (SELECT o_orderkey, 1415 + o_orderkey % 8 AS y, 1 + o_orderkey % 12 AS mo, 1 + o_orderkey % 30 AS d, o_orderkey % 7 = 0 AS bare FROM orders)
SELECT o_orderkey, CASE WHEN NOT bare AND d <= days THEN CAST(first_day + CAST(d - 1 AS INTEGER) AS DATE) END AS day, 'hijri' AS calendar, bare AS no_year
FROM o JOIN m ON year = y AND month = mo""")
def hijri_written_dates(spark, sf):
    """Days written with month names in both spellings and both kinds of digits, some without a year, some that no month has."""
    k = F.col("o_orderkey")
    names = F.array(*[F.array(*[F.lit(n) for n in some]) for some in _SPELLED])
    some = F.element_at(names, (k % 12 + 1).cast("int"))
    name = F.element_at(some, (F.floor(k / 12) % F.size(some) + 1).cast("int"))
    year = F.when(k % 7 != 0, F.concat(F.lit(" "), (k % 8 + 1415).cast("string"), F.lit(" هـ"))).otherwise("")
    written = F.concat(F.lit("يستمر القبول إلى "), (k % 30 + 1).cast("string"), F.lit(" "), name, year, F.lit(" بإذن الله"))
    eastern = F.translate(written, "0123456789", "٠١٢٣٤٥٦٧٨٩")
    read = table(spark, sf, "orders").select("o_orderkey", D.read_date(F.when(k % 2 == 0, written).otherwise(eastern)).alias("m"))
    return read.select("o_orderkey", "m.day", "m.calendar", F.col("m.ambiguous_year").alias("no_year"))


@query("notice_details", f"""
WITH {REC}, {HIJRI_CTE}, r AS (SELECT *, CASE price % 3 WHEN 0 THEN 'الرياض' WHEN 2 THEN 'جدة، الدمام' END AS said,
  greatest(0, CAST(ceil((epoch_us(CAST(closes AS TIMESTAMP)) + 75600000000 - 1000 - {lit_us(AFTER)}) / 86400000000.0) AS INTEGER)) AS days_left FROM rec)
SELECT id, concat_ws(' · ', title, said, CASE WHEN seats IS NOT NULL THEN seats || ' مقعداً' END, CASE WHEN closes IS NOT NULL THEN 'يغلق بعد ' || days_left || ' يوم' END,
  CASE WHEN closes IS NOT NULL THEN translate(CAST(date_diff('day', first_day, closes) + 1 AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' '
    || [{", ".join(q(n) for n in L.HIJRI_MONTH_NAMES)}][month] || ' ' || translate(CAST(year AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' هـ' END) AS body
FROM r LEFT JOIN m ON closes >= first_day AND closes < first_day + days""")
def notice_details(spark, sf):
    """The body of a notice for every record."""
    return base_records(spark, sf).select("id", notices.details(at(AFTER)).alias("body"))


@query("hijri_month_lengths", f"""
WITH {HIJRI_CTE}, o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, first_day, CAST(days AS INTEGER) AS days, true AS in_month FROM o JOIN m ON day >= first_day AND day < first_day + days""")
def hijri_month_lengths(spark, sf):
    """Days joined to the calendar dimension: each falls inside the month it converts to."""
    day = F.col("o_orderdate").cast("date")
    days = table(spark, sf, "orders").select(day.alias("day")).distinct().withColumn("h", D.hijri_parts(F.col("day")))
    months = F.broadcast(D.calendar_dimension(spark))  # 1,212 rows, fixed by the calendar
    inside = (F.col("day") >= F.col("first_day")) & (F.col("day") < F.date_add("first_day", F.col("days")))
    joined = days.join(
        months, (F.col("h.year") == F.col("hijri_year")) & (F.col("h.month") == F.col("hijri_month"))
    )
    return joined.select("day", "first_day", "days", inside.alias("in_month"))


@query("written_dates", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS first_day, CAST(o_orderdate AS DATE) + 20 AS last_day,
  day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate) AS first_ambiguous, CAST(3 AS INTEGER) AS mentions FROM orders""")
def written_dates(spark, sf):
    day = F.col("o_orderdate").cast("date")
    text = F.concat(
        F.lit("applications open "), F.date_format(day, "dd/MM/yyyy"),
        F.lit(" and again on "), F.date_format(F.date_add(day, 10), "yyyy-MM-dd"),
        F.lit("; deadline "), F.date_format(F.date_add(day, 20), "d MMMM yyyy"), F.lit("."),
    )
    found = table(spark, sf, "orders").select("o_orderkey", D.date_mentions(text).alias("m"))
    first, last = D.pick_mention(F.col("m"), "first"), D.pick_mention(F.col("m"), "last")
    return found.select(
        "o_orderkey", first["day"].alias("first_day"), last["day"].alias("last_day"),
        first["ambiguous_order"].alias("first_ambiguous"), F.size("m").alias("mentions"),
    )


@query("season_positions", """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, make_date(CASE WHEN month(o_orderdate) >= 8 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END, 9, 1) AS s FROM orders)
SELECT o_orderkey, s AS season, round(greatest(0.0, least(1.0, (d - s) / CAST(CAST(s + INTERVAL 6 MONTH AS DATE) - s AS DOUBLE))), 6) AS position FROM o""")
def season_positions(spark, sf):
    when = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf, "orders").select(
        "o_orderkey", D.season_start(when).alias("season"),
        F.round(D.season_position(when, when), 6).alias("position"),
    )


# ---- identity, upsert -----------------------------------------------------------


@query("record_ids", """
SELECT o_orderkey, substr(sha256('c' || o_custkey || '|https://c' || o_custkey || '.example.org/o/' || o_orderkey || '|' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z')), 1, 16) AS id FROM orders""")
def record_ids(spark, sf):
    recs = base_records(spark, sf)
    new = records.record_id(F.col("org_id"), F.col("url"), records.iso_instant(F.col("first_seen")))
    return recs.select(F.col("id").cast("long").alias("o_orderkey"), new.alias("id"))


def verdict_rows(spark, sf):
    """Orders as judged pages: dates as a page would write them, some windows backwards."""
    day = F.col("o_orderdate").cast("date")
    price = F.floor("o_totalprice").cast("long")
    backwards = price % 11 == 0
    s = F.lit(None).cast("string")
    verdict = F.struct(
        F.lit(True).alias("isTrainingAnnouncement"),
        F.when(F.col("o_orderpriority") == "5-LOW", "graduate_dev").otherwise("coop").alias("product"),
        by("o_orderpriority", TITLES).alias("titleAr"),
        s.alias("opensISO"),
        F.when(
            F.col("o_orderstatus") == "F",
            F.date_add(day, F.when(backwards, -10).otherwise(30)).cast("string"),
        ).alias("closesISO"),
        F.when(F.col("o_orderstatus") != "O", F.date_format(day, "dd/MM/yyyy")).alias("opensRaw"),
        F.when(F.col("o_orderstatus") == "P", "بعد أسبوعين").alias("closesRaw"),
        (price % 5 == 0).alias("moreOnPage"),
        F.array().cast("array<string>").alias("majors"),
        (price % 20).cast("double").alias("seats"),
        F.when(price % 3 == 0, (price % 1000).cast("double")).alias("stipendSAR"),
        F.lit(None).cast("double").alias("durationWeeks"),
        F.array(F.lit(" Riyadh "), F.lit("remote"), F.lit("الرياض"), F.lit("Al-Ahsa")).alias("cities"),
        (price % 7 == 0).alias("statesZeroCoursesRule"),
        s.alias("zeroCoursesQuote"),
        by("o_orderpriority", {"1-URGENT": "apply/now", "2-HIGH": "N/A", "3-MEDIUM": "/apply?x=1"}, "قدّم عبر البوابة").alias("applyUrl"),
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("key"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("org_id"),
        F.concat(F.lit("https://c"), F.col("o_custkey").cast("string"), F.lit(".example.org/o/"), F.col("o_orderkey").cast("string")).alias("url"),
        by("o_orderpriority", TITLES).alias("text"),
        verdict.cast(VERDICT_TYPE).alias("verdict"),
        F.lit(None).cast("timestamp").alias("prior_detected"),
        F.col("o_orderdate").cast("timestamp").alias("prior_first_seen"),
        (price % 13 == 0).alias("first_time"),
        F.lit("cyber").alias("field"),
        F.array(F.lit("الرياض")).alias("reader_cities"),
        F.lit(False).alias("graduated"),
        F.lit("الأمن السيبراني").alias("field_label"),
    )


@query("records_from_verdicts", f"""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(o_orderdate AS DATE) AS d, CAST(floor(o_totalprice) AS BIGINT) AS price FROM orders),
r AS (SELECT *, CASE WHEN o_orderstatus <> 'O' THEN d END AS op0,
  CAST(CASE WHEN o_orderstatus = 'F' THEN d + CASE WHEN price % 11 = 0 THEN -10 ELSE 30 END END AS DATE) AS cl0 FROM o),
b AS (SELECT *, coalesce(cl0 < op0, false) AS backwards, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '2-HIGH' THEN 95 END AS fit FROM r),
f AS (SELECT *, CASE WHEN NOT backwards THEN op0 END AS opens, CASE WHEN NOT backwards THEN cl0 END AS closes, CASE WHEN NOT backwards THEN fit END AS score,
  fit IS NULL OR backwards AS review, CASE WHEN o_orderpriority = '5-LOW' THEN 'graduate_dev' ELSE 'coop' END AS product,
  CASE WHEN fit IS NULL OR backwards THEN ['needs_manual_review'] ELSE CAST([] AS VARCHAR[]) END AS flags FROM b),
g AS (SELECT *, {status_sql(lit_us(AFTER))} AS status FROM f)
SELECT CAST(o_orderkey AS VARCHAR) AS key, opens, closes, status, CAST(score AS INTEGER) AS score,
  'الرياض,الأحساء' AS cities,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'https://c' || o_custkey || '.example.org/o/apply/now' WHEN '3-MEDIUM' THEN 'https://c' || o_custkey || '.example.org/apply?x=1' END AS apply_url,
  array_to_string(list_filter([CASE WHEN product = 'graduate_dev' THEN 'wrong_product' END, CASE WHEN score >= 90 THEN 'exact_major_match' END,
    CASE WHEN price % 20 <= 5 THEN 'few_seats' END, CASE WHEN price % 3 = 0 AND price % 1000 > 0 THEN 'has_stipend' END, CASE WHEN status = 'closing_soon' THEN 'closing_in_48h' END,
    CASE WHEN price % 7 <> 0 THEN 'no_course_condition' END, CASE WHEN price % 13 = 0 THEN 'first_time_seen' END, CASE WHEN price % 5 = 0 THEN 'more_on_page' END,
    CASE WHEN review THEN 'needs_manual_review' END, CASE WHEN o_orderstatus <> 'O' AND NOT backwards AND day(d) <= 12 AND day(d) <> month(d) THEN 'date_order_ambiguous' END], lambda x: x IS NOT NULL), ',') AS flags
FROM g""")
def records_from_verdicts(spark, sf):
    rows = verdict_rows(spark, sf)
    made = records.from_verdicts(rows, at(AFTER))
    return made.select(
        F.regexp_extract("url", "([0-9]+)$", 1).alias("key"), "opens", "closes", "status", "score",
        F.array_join("cities", ",").alias("cities"), "apply_url", F.array_join("flags", ",").alias("flags"),
    )


def judged_round(spark, sf):
    """A round of verdicts over the orders: dear ones positive, cheap ones negative, some failed."""
    recs = version(spark, sf, BEFORE)
    price = F.regexp_extract("url", "([0-9]+)$", 1).cast("long") % 10
    positive = recs.where(price < 2).withColumn("score", F.lit(77)).withColumn("last_confirmed", at(AFTER))
    negative = recs.where(price.between(2, 3)).select("url")
    failed = recs.where(price.between(4, 5)).select(
        "url", F.lit("schema").alias("stage"), F.lit("reply did not match").alias("reason")
    )
    stand_in = recs.where(price.between(4, 5)).withColumn("title", F.lit(L.UNJUDGED_TITLE)).withColumn(
        "id", F.concat(F.lit("p"), "id")
    ).withColumn("flags", F.array(F.lit("needs_manual_review"))).withColumn("score", F.lit(None).cast("int"))
    return recs, positive, negative, failed, stand_in


@query("record_upsert", f"""
WITH {REC}, m AS (SELECT *, CAST(id AS BIGINT) % 10 AS g, title = {q(L.UNJUDGED_TITLE)} AS bare FROM rec)
SELECT CASE WHEN g IN (4, 5) AND bare THEN 'p' || id ELSE id END AS id,
  CAST(CASE WHEN g < 2 THEN 77 WHEN g IN (4, 5) AND bare THEN NULL ELSE score END AS INTEGER) AS score,
  array_to_string(CASE WHEN g IN (4, 5) AND bare THEN ['needs_manual_review'] WHEN g IN (4, 5) THEN list_append(flags, 'needs_manual_review')
     WHEN g IN (2, 3) THEN list_append(flags, 'vanished_from_source') ELSE flags END, ',') AS flags,
  g IN (4, 5) AND NOT bare AS noted FROM m""")
def record_upsert(spark, sf):
    merged = records.merge_round(*judged_round(spark, sf))
    return merged.select(
        "id", "score", F.array_join("flags", ",").alias("flags"),
        F.contains("reason", F.lit(L.REASONS["retry_marker"])).alias("noted"),
    )


@query("settled_placeholders_dropped", f"""
WITH {REC} SELECT id FROM rec WHERE NOT (title = {q(L.UNJUDGED_TITLE)} AND o_orderstatus = 'F')""")
def settled_placeholders_dropped(spark, sf):
    recs = version(spark, sf, BEFORE)
    snaps = base_records(spark, sf).select("url", (F.col("o_orderstatus") != "F").alias("pending"))
    return records.drop_settled_placeholders(recs, snaps).select("id")


def record_pages(spark, sf):
    """The page behind each record; those of status P no longer print the word Training."""
    text = F.concat_ws(" ", F.col("title"), F.array_join("majors", " "), F.array_join("cities", " "), F.coalesce("zero_courses_quote", F.lit("")))
    return base_records(spark, sf).select(
        "url", F.when(F.col("o_orderstatus") == "P", F.replace(text, F.lit("Training"), F.lit(""))).otherwise(text).alias("text")
    )


STALE = f"""title <> {q(L.UNJUDGED_TITLE)} AND ((o_orderstatus = 'P' AND contains(title, 'Training')) OR (price % 7 = 0 AND price % 14 <> 0))"""


@query("false_records_dropped", f"WITH {REC} SELECT id FROM rec WHERE NOT ({STALE})")
def false_records_dropped(spark, sf):
    recs = version(spark, sf, BEFORE)
    stale = guard.stale_wording(recs, record_pages(spark, sf))
    return records.drop_false(recs, stale).select("id")


@query("stale_wording", f"WITH {REC} SELECT id, CAST(CASE WHEN o_orderstatus = 'P' AND contains(title, 'Training') THEN 1 ELSE 0 END + CASE WHEN price % 7 = 0 AND price % 14 <> 0 THEN 1 ELSE 0 END AS INTEGER) AS offences FROM rec WHERE {STALE}")
def stale_wording(spark, sf):
    stale = guard.stale_wording(version(spark, sf, BEFORE), record_pages(spark, sf))
    return stale.select("id", F.size("offences").alias("offences"))


@query("first_time_orgs", """
WITH p AS (SELECT 'c' || o_custkey AS org_id, CAST(o_orderkey AS VARCHAR) AS id, o_orderdate FROM orders),
h AS (SELECT DISTINCT org_id FROM p WHERE o_orderdate < TIMESTAMP '1996-01-01')
SELECT id, p.org_id NOT IN (SELECT org_id FROM h) AS first_time FROM p WHERE o_orderdate >= TIMESTAMP '1996-01-01'""")
def first_time_orgs(spark, sf):
    recs = version(spark, sf, BEFORE)
    cut = at("1996-01-01 00:00:00")
    history = recs.where(F.col("first_seen") < cut)
    judged = recs.where(F.col("first_seen") >= cut).select("id", "org_id", "url")
    return records.prior_records(judged, history).select("id", "first_time")


def coarse_records(spark, sf):
    """Records of forty organisations whose deadlines fall on month ends, so that pages coincide."""
    recs = version(spark, sf, AFTER)
    org = F.concat(F.lit("o"), (F.substring("org_id", 2, 12).cast("long") % 40).cast("string"))
    return recs.withColumn("org_id", org).withColumn("closes", F.last_day("closes"))


COARSE = f"""{REC}, co AS (SELECT id, 'o' || (CAST(substr(org_id, 2) AS BIGINT) % 40) AS org, score, url,
   CASE WHEN closes IS NULL THEN NULL ELSE last_day(closes) END AS closes, {status_sql(lit_us(AFTER))} AS status,
   CASE title WHEN 'Cyber Security Co-op' THEN 'cyber security co op' WHEN {q(L.UNJUDGED_TITLE)} THEN 'لم يصنف بعد' ELSE lower(title) END AS folded FROM rec),
ck AS (SELECT *, CASE WHEN closes IS NULL THEN org || '|' || url ELSE org || '|' || folded || '|' || closes END AS announcement FROM co)"""


@query("announcement_collapse", f"""
WITH {COARSE}, l AS (SELECT announcement, min_by(id, (-coalesce(score, -1), id)) AS lead_id, count(*) AS pages FROM ck GROUP BY announcement)
SELECT id, announcement, lead_id, pages, id = lead_id AS is_lead FROM ck JOIN l USING (announcement)""")
def announcement_collapse(spark, sf):
    return reports.collapse(coarse_records(spark, sf)).select("id", "announcement", "lead_id", "pages", "is_lead")


@query("status_groups", f"""
WITH {COARSE}, l AS (SELECT announcement, min_by(id, (-coalesce(score, -1), id)) AS lead_id FROM ck GROUP BY announcement)
SELECT status, count(*) FILTER (WHERE id = lead_id) AS announcements, count(*) AS pages FROM ck JOIN l USING (announcement) GROUP BY status""")
def status_groups(spark, sf):
    return reports.status_groups(coarse_records(spark, sf))


@query("open_now", f"""
WITH {REC}, v AS (SELECT id, closes, {status_sql(lit_us(AFTER))} AS status FROM rec)
SELECT id, status, CAST(ceil((epoch_us(CAST(closes AS TIMESTAMP)) + 75600000000 - 1000 - {lit_us(AFTER)}) / 86400000000.0) AS INTEGER) AS days_left FROM v WHERE status IN ('open', 'closing_soon')""")
def open_now(spark, sf):
    return reports.open_now(version(spark, sf, AFTER), at(AFTER)).select("id", "status", "days_left")


@query("reopened_unjudged", f"""
WITH {REC} SELECT id, CASE WHEN score IS NULL THEN {q(L.REASONS['unjudged_prefix'] + L.VERDICT_FAILURES[0][1])} ELSE reason END AS reason, score IS NULL AS pending FROM rec""")
def reopened_unjudged(spark, sf):
    recs = version(spark, sf, BEFORE)
    snaps = recs.select("url", F.lit(False).alias("pending"))
    fixed, queued = routing.reopen_unjudged(recs, snaps)
    return fixed.select("id", "url", "reason").join(queued, "url").select("id", "reason", "pending")


@query("stale_scores_withdrawn", f"""
WITH {REC} SELECT id, CAST(CASE WHEN score IS NOT NULL AND first_seen < TIMESTAMP '1998-01-01' THEN NULL ELSE score END AS INTEGER) AS score,
  score IS NOT NULL AND first_seen < TIMESTAMP '1998-01-01' AS pending FROM rec""")
def stale_scores_withdrawn(spark, sf):
    recs = version(spark, sf, BEFORE)
    snaps = recs.select("url", F.lit(False).alias("pending"))
    cleared, queued = routing.unscore_stale(recs, snaps, at("1998-01-01 00:00:00"))
    return cleared.select("id", "url", "score").join(queued, "url").select("id", "score", "pending")


# ---- relevance ------------------------------------------------------------------


PHRASES = {
    "PROMO": "Cyber Security", "STANDARD": "software", "LARGE": "civil engineering", "MEDIUM": "help desk",
    "SMALL": "digital", "ECONOMY": "all majors",
}


def announcements(spark, sf):
    price = F.floor("p_retailprice").cast("long")
    none = F.array().cast("array<string>")
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat_ws(" ", "p_name", by("p_type", PHRASES)).alias("title"),
        F.when(F.col("p_size") > 40, F.array(F.lit("law"))).otherwise(none).alias("majors"),
        F.when(price % 2 == 0, F.array(F.lit("الرياض"))).otherwise(none).alias("cities"),
        F.when(F.col("p_brand") == "Brand#3", "graduate_dev").otherwise("coop").alias("product"),
    )


PROFILES = {
    "BUILDING": "طالب أمن سيبراني في الرياض، لم يتخرج بعد", "MACHINERY": "software student, not yet graduated",
    "FURNITURE": "تقني graduated جدة", "AUTOMOBILE": "IT student الرياض", "HOUSEHOLD": "محاسبة",
}


def profiles(spark, sf):
    raw = table(spark, sf, "customer").select("c_custkey", by("c_mktsegment", PROFILES).alias("profile"))
    return relevance.read_profiles(raw)


@query("reader_profiles", """
SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'cyber' WHEN 'MACHINERY' THEN 'it' WHEN 'FURNITURE' THEN 'general' WHEN 'AUTOMOBILE' THEN 'it' END AS field,
  CASE c_mktsegment WHEN 'BUILDING' THEN 'الرياض' WHEN 'FURNITURE' THEN 'جدة' WHEN 'AUTOMOBILE' THEN 'الرياض' ELSE '' END AS cities,
  CASE c_mktsegment WHEN 'BUILDING' THEN false WHEN 'MACHINERY' THEN false WHEN 'FURNITURE' THEN true END AS graduated
FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'""")
def reader_profiles(spark, sf):
    return profiles(spark, sf).select(
        "c_custkey", "field", F.array_join("reader_cities", ",").alias("cities"), "graduated"
    )


FIELD_SQL = """CASE p_type WHEN 'PROMO' THEN 'cyber' WHEN 'STANDARD' THEN 'it' WHEN 'MEDIUM' THEN 'general' WHEN 'SMALL' THEN 'general' ELSE 'none' END"""


@query("field_ladder", f"""
SELECT p_partkey, {FIELD_SQL} AS field, p_type <> 'ECONOMY' AS names_any FROM part""")
def field_ladder(spark, sf):
    return announcements(spark, sf).select(
        "p_partkey", fields.field_of(F.col("title")).alias("field"), fields.names_a_field(F.col("title")).alias("names_any")
    )


def pairs(spark, sf):
    """Readers meet the announcements they ordered: an equi-join, never all pairs."""
    bought = (
        table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
        .join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")), "l_orderkey")
        .select("c_custkey", "p_partkey").distinct()
    )
    told = announcements(spark, sf).withColumn(
        "facts", relevance.announced_facts(F.col("title"), F.col("majors"))
    )
    return bought.join(told, "p_partkey").join(profiles(spark, sf), "c_custkey")


@query("relevance_scores", f"""
WITH b AS (SELECT DISTINCT o_custkey AS c_custkey, l_partkey AS p_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
j AS (SELECT b.*, p_type, p_size, p_brand, CAST(floor(p_retailprice) AS BIGINT) % 2 = 0 AS riyadh, c_mktsegment AS seg,
  {FIELD_SQL} AS ann, CASE c_mktsegment WHEN 'BUILDING' THEN 'cyber' WHEN 'MACHINERY' THEN 'it' WHEN 'FURNITURE' THEN 'general' WHEN 'AUTOMOBILE' THEN 'it' END AS field
  FROM b JOIN part USING (p_partkey) JOIN customer USING (c_custkey) WHERE c_mktsegment <> 'HOUSEHOLD'),
k AS (SELECT *, CASE WHEN p_size > 40 AND ann = 'general' THEN 'none' ELSE ann END AS fa FROM j),
s AS (SELECT *, CASE WHEN p_brand = 'Brand#3' AND seg IN ('BUILDING', 'MACHINERY') THEN 0
   WHEN fa = 'none' AND p_type = 'ECONOMY' THEN CASE field WHEN 'cyber' THEN 90 WHEN 'it' THEN 65 ELSE 35 END
   WHEN fa = 'none' THEN 10
   ELSE CASE fa WHEN 'cyber' THEN 90 WHEN 'it' THEN 65 ELSE 35 END + CASE WHEN riyadh AND seg IN ('BUILDING', 'AUTOMOBILE') THEN 5 ELSE 0 END END AS score FROM k)
SELECT c_custkey, p_partkey, CAST(score AS INTEGER) AS score FROM s""")
def relevance_scores(spark, sf):
    return relevance.score_pairs(pairs(spark, sf)).select("c_custkey", "p_partkey", "score")


@query("relevance_reasons", f"""
WITH b AS (SELECT DISTINCT o_custkey AS c_custkey, l_partkey AS p_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
j AS (SELECT b.*, p_type, p_size, p_brand, CAST(floor(p_retailprice) AS BIGINT) % 2 = 0 AS riyadh, c_mktsegment AS seg,
  {FIELD_SQL} AS ann, CASE c_mktsegment WHEN 'BUILDING' THEN 'cyber' WHEN 'MACHINERY' THEN 'it' WHEN 'FURNITURE' THEN 'general' WHEN 'AUTOMOBILE' THEN 'it' END AS field
  FROM b JOIN part USING (p_partkey) JOIN customer USING (c_custkey) WHERE c_mktsegment <> 'HOUSEHOLD'),
k AS (SELECT *, CASE WHEN p_size > 40 AND ann = 'general' THEN 'none' ELSE ann END AS fa FROM j),
s AS (SELECT *, CASE WHEN p_brand = 'Brand#3' AND seg IN ('BUILDING', 'MACHINERY') THEN 0
   WHEN fa = 'none' AND p_type = 'ECONOMY' THEN CASE field WHEN 'cyber' THEN 90 WHEN 'it' THEN 65 ELSE 35 END
   WHEN fa = 'none' THEN 10
   ELSE CASE fa WHEN 'cyber' THEN 90 WHEN 'it' THEN 65 ELSE 35 END + CASE WHEN riyadh AND seg IN ('BUILDING', 'AUTOMOBILE') THEN 5 ELSE 0 END END AS score,
   CASE WHEN p_brand = 'Brand#3' AND seg = 'AUTOMOBILE' THEN {q(L.REASONS['graduate_unknown'] + '، ')} ELSE '' END ||
   CASE WHEN fa = 'none' AND p_type = 'ECONOMY' THEN {q(L.REASONS['all_majors'])} WHEN fa = 'none' THEN {q(L.REASONS['unrelated'])}
     WHEN fa = field THEN 'يذكر ' || CASE field WHEN 'cyber' THEN {q(L.FIELD_LABELS['cyber'])} WHEN 'it' THEN {q(L.FIELD_LABELS['it'])} ELSE {q(L.FIELD_LABELS['general'])} END || '، وهو تخصّصك'
     WHEN fa = 'it' AND field = 'cyber' THEN {q(L.REASONS['near'])} WHEN fa = 'cyber' THEN {q(L.REASONS['broader'])} ELSE {q(L.REASONS['general'])} END ||
   CASE WHEN fa <> 'none' AND riyadh AND seg IN ('BUILDING', 'AUTOMOBILE') THEN '، وفي الرياض' WHEN fa <> 'none' AND riyadh AND seg = 'FURNITURE' THEN '، وفي الرياض، خارج مدينتك' ELSE '' END || '.' AS said FROM k),
z AS (SELECT field, CAST(score AS INTEGER) AS score, CASE WHEN p_brand = 'Brand#3' AND seg IN ('BUILDING', 'MACHINERY') THEN {q(L.REASONS['graduate_zero'])} ELSE said END AS reason FROM s)
SELECT field, reason, count(*) AS pairs, min(score) AS lowest, max(score) AS highest FROM z GROUP BY ALL""")
def relevance_reasons(spark, sf):
    """How often each reason is given."""
    scored = relevance.score_pairs(pairs(spark, sf))
    return scored.groupBy("field", "reason").agg(F.count("*").alias("pairs"), F.min("score").alias("lowest"), F.max("score").alias("highest"))


EVERY_PAIR = f"""j AS (SELECT c_custkey, p_partkey, p_type, p_size, p_brand, CAST(floor(p_retailprice) AS BIGINT) % 2 = 0 AS riyadh, c_mktsegment AS seg,
  {FIELD_SQL} AS ann, CASE c_mktsegment WHEN 'BUILDING' THEN 'cyber' WHEN 'MACHINERY' THEN 'it' WHEN 'FURNITURE' THEN 'general' WHEN 'AUTOMOBILE' THEN 'it' END AS field,
  CASE c_mktsegment WHEN 'FURNITURE' THEN true WHEN 'AUTOMOBILE' THEN NULL ELSE false END AS graduated
  FROM part, customer WHERE c_mktsegment <> 'HOUSEHOLD'),
k AS (SELECT *, CASE WHEN p_size > 40 AND ann = 'general' THEN 'none' ELSE ann END AS fa FROM j),
s AS (SELECT *, CAST(CASE WHEN p_brand = 'Brand#3' AND seg IN ('BUILDING', 'MACHINERY') THEN 0
   WHEN fa = 'none' AND p_type = 'ECONOMY' THEN CASE field WHEN 'cyber' THEN 90 WHEN 'it' THEN 65 ELSE 35 END
   WHEN fa = 'none' THEN 10
   ELSE CASE fa WHEN 'cyber' THEN 90 WHEN 'it' THEN 65 ELSE 35 END + CASE WHEN riyadh AND seg IN ('BUILDING', 'AUTOMOBILE') THEN 5 ELSE 0 END END AS INTEGER) AS score FROM k)"""


@query("class_scores", f"WITH {EVERY_PAIR} SELECT field, graduated, score, count(*) AS pairs FROM s GROUP BY ALL")
def class_scores(spark, sf):
    """Every reader against every announcement, as classes: how many pairs have which score."""
    every = relevance.class_scores(relevance.reader_classes(profiles(spark, sf)), relevance.announcement_classes(announcements(spark, sf)))
    return every.groupBy("field", "graduated", "score").agg(F.sum(F.col("readers") * F.col("announcements")).alias("pairs"))


@query("reader_board", f"""WITH {EVERY_PAIR},
r AS (SELECT c_custkey, p_partkey, score, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY score DESC, p_partkey) AS INTEGER) AS rank FROM s WHERE score IS NOT NULL)
SELECT * FROM r WHERE rank <= 5""")
def reader_board(spark, sf):
    """The five announcements nearest to every reader, of all announcements."""
    who, what = relevance.reader_classes(profiles(spark, sf)), relevance.announcement_classes(announcements(spark, sf))
    return relevance.reader_board(who, what, 5, "c_custkey", "p_partkey")


@query("score_bands", f"""
WITH {REC} SELECT band, count(*) AS records FROM (SELECT CASE WHEN score IS NULL OR list_contains(flags, 'needs_manual_review') THEN 'review' WHEN score >= 85 THEN 'high' WHEN score >= 60 THEN 'mid' ELSE 'low' END AS band FROM rec) GROUP BY band""")
def score_bands(spark, sf):
    band = fields.score_band(F.col("score"), F.col("flags"))
    return base_records(spark, sf).groupBy(band.alias("band")).agg(F.count("*").alias("records"))


@query("visible_records", f"""
WITH {REC} SELECT id FROM rec WHERE coalesce(score, 100) >= 50 AND o_totalprice <= 400000""")
def visible_records(spark, sf):
    recs = base_records(spark, sf)
    return relevance.visible(recs, recs.where("o_totalprice > 400000"), 50).select("id")


@query("score_basis", f"""
SELECT DISTINCT CASE c_mktsegment WHEN 'BUILDING' THEN 'الأمن السيبراني' WHEN 'FURNITURE' THEN 'المجال التقني' ELSE 'التقنية' END AS field_label, c_custkey AS profile_id, {lit_us(AFTER)} AS computed_at
FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'""")
def score_basis(spark, sf):
    scores = profiles(spark, sf).withColumnRenamed("c_custkey", "profile_id")
    basis = relevance.score_basis(scores, at(AFTER))
    return basis.select("field_label", "profile_id", F.unix_micros("computed_at").alias("computed_at"))


# ---- notices ----------------------------------------------------------------------


NOTICE = f"""{REC}, v AS (SELECT *, {status_sql(lit_us(BEFORE))} AS was, {status_sql(lit_us(AFTER))} AS status,
  (epoch_us(CAST(closes AS TIMESTAMP)) + 75600000000 - 1000 - {lit_us(AFTER)}) / 3600000000.0 AS hours,
  ({lit_us(AFTER)} - epoch_us(first_seen)) / 86400000000.0 <= 14 AS fresh,
  CASE WHEN closes IS NULL THEN org_id || '|' || url ELSE org_id || '|' || CASE title WHEN 'Cyber Security Co-op' THEN 'cyber security co op' WHEN {q(L.UNJUDGED_TITLE)} THEN 'لم يصنف بعد' ELSE lower(title) END || '|' || closes END AS ak FROM rec),
said AS (
 SELECT 'new:' || ak AS key, 'new_relevant' AS kind, score + 200 AS weight FROM v WHERE product <> 'graduate_dev' AND score >= 60 AND fresh
 UNION ALL SELECT 'opened:' || ak, 'opened', score + 400 FROM v WHERE product <> 'graduate_dev' AND score IS NOT NULL AND was <> 'open' AND status = 'open'
 UNION ALL SELECT 'closing:' || ak || ':' || closes, 'closing_soon', score + 500 FROM v WHERE product <> 'graduate_dev' AND score IS NOT NULL AND hours > 0 AND hours <= 48
 UNION ALL SELECT 'seats:' || ak || ':' || seats, 'few_seats', score + 300 FROM v WHERE product <> 'graduate_dev' AND seats <= 5 AND score >= 70 AND price % 4 = 0)"""


def notice_versions(spark, sf):
    """Two versions of the records; every fourth order had one seat more before."""
    before, after = version(spark, sf, BEFORE), version(spark, sf, AFTER)
    price = base_records(spark, sf).select("id", (F.floor("o_totalprice").cast("long") % 4 == 0).alias("_moved"))
    before = before.join(price, "id").withColumn(
        "seats", F.when(F.col("_moved"), F.col("seats") + 1).otherwise(F.col("seats"))
    ).drop("_moved")
    names = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("org_id"), F.col("c_name").alias("name")
    )
    return before, after, names


@query("record_notices", f"WITH {NOTICE} SELECT key, kind, CAST(max(weight) AS DOUBLE) AS weight FROM said GROUP BY key, kind")
def record_notices(spark, sf):
    before, after, names = notice_versions(spark, sf)
    said = notices.best_per_key(notices.record_notices(before, after, names, 60, at(AFTER)))
    return said.select("key", "kind", "weight")


@query("decided_notices", f"""
WITH {NOTICE}, un AS (SELECT count(*) AS n FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'),
bad AS (SELECT count(*) FILTER (WHERE closes IS NULL) AS n, count(*) AS total FROM rec)
SELECT kind, count(*) AS notices FROM (SELECT key, any_value(kind) AS kind FROM said GROUP BY key UNION ALL SELECT 'classifier', 'classifier_down' FROM un WHERE n >= 3
  UNION ALL SELECT 'broken', 'source_broken' FROM bad WHERE n > 0 UNION ALL SELECT 'coverage', 'coverage_dropped' FROM bad WHERE n >= 5 AND n / total >= 0.06) GROUP BY kind""")
def decided_notices(spark, sf):
    before, after, names = notice_versions(spark, sf)
    healthy = after.select("url", "org_id", F.lit("healthy").alias("state"))
    gone = after.select(
        "url", "org_id", F.when(F.col("closes").isNull(), "broken").otherwise("healthy").alias("state")
    )
    said = notices.decide(before, after, healthy, gone, names, at(AFTER))
    return said.groupBy("kind").agg(F.count("*").alias("notices"))


# ---- due, quality, evaluation -------------------------------------------------------


@query("source_tiers", f"""
WITH {REC}, v AS (SELECT *, {status_sql(lit_us(AFTER))} AS status, (epoch_us(CAST(closes AS TIMESTAMP)) + 75600000000 - 1000 - {lit_us(AFTER)}) / 3600000000.0 AS hours FROM rec)
SELECT url, CASE WHEN status IN ('open', 'closing_soon') OR coalesce(hours BETWEEN 0 AND 168, false) THEN 'hot' WHEN price % 9 = 0 THEN 'high'
  WHEN o_orderstatus = 'F' THEN CASE WHEN price % 2 = 0 THEN 'high' ELSE 'medium' END WHEN o_orderstatus = 'O' THEN 'medium' ELSE 'low' END AS tier FROM v""")
def source_tiers(spark, sf):
    recs = base_records(spark, sf)
    price = F.floor("o_totalprice").cast("long")
    sources = recs.select(
        "url", F.when(price % 2 == 0, "A").otherwise("C").alias("org_tier"),
        by("o_orderstatus", {"F": "careers_page", "O": "announcement_page", "P": "site_root"}).alias("type"),
        (price % 9 == 0).alias("coop_confirmed"),
    )
    return due.tiers(sources, recs.select("url", "opens", "closes", "product", "flags"), at(AFTER)).select("url", "tier")


@query("fastest_tier", """
WITH t AS (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END AS r FROM orders)
SELECT CAST(o_custkey AS VARCHAR) AS url, CASE min(r) WHEN 0 THEN 'hot' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS tier FROM t GROUP BY o_custkey""")
def fastest_tier(spark, sf):
    targets = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("url"), F.col("o_orderkey").cast("string").alias("org_id"),
        by("o_orderpriority", {"1-URGENT": "hot", "2-HIGH": "high", "3-MEDIUM": "medium"}, "low").alias("tier"),
    )
    return due.fastest_tier(targets).select("url", "tier")


ISSUES = f"""{REC}, v AS (SELECT *, {status_sql(lit_us(AFTER))} AS status FROM rec), iss AS (
 SELECT 'error' AS severity, 'missing_flag' AS "check", 'opportunity:' || id AS "where" FROM v WHERE seats <= 5
 UNION ALL SELECT 'error', 'diagnostic_on_card', 'opportunity:' || id FROM v WHERE score IS NULL
 UNION ALL SELECT 'error', 'rule_without_quote', 'opportunity:' || id FROM v WHERE price % 7 = 0 AND price % 14 <> 0
 UNION ALL SELECT 'error', 'wrong_product_score', 'opportunity:' || id FROM v WHERE product = 'graduate_dev' AND score <> 0
 UNION ALL SELECT 'error', 'unknown_org', 'opportunity:' || id FROM v WHERE CAST(substr(org_id, 2) AS BIGINT) NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))"""


def found_issues(spark, sf):
    owners = table(spark, sf, "customer").where("c_acctbal > 0").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("org_id")
    )
    return quality.record_issues(version(spark, sf, AFTER), owners)


@query("record_issues", f"WITH {ISSUES} SELECT * FROM iss")
def record_issues(spark, sf):
    return found_issues(spark, sf).select("severity", "check", "where")


@query("issue_report", f"""
WITH {ISSUES}, d AS (SELECT DISTINCT * FROM iss), r AS (SELECT *, row_number() OVER (PARTITION BY severity, "check" ORDER BY "where") AS k FROM d)
SELECT i.severity, i."check", n, samples FROM (SELECT severity, "check", count(*) AS n FROM iss GROUP BY ALL) i
JOIN (SELECT severity, "check", string_agg("where", ',' ORDER BY "where") AS samples FROM r WHERE k <= 6 GROUP BY ALL) s USING (severity, "check")""")
def issue_report(spark, sf):
    report = quality.issue_report(found_issues(spark, sf))
    return report.select("severity", "check", "n", F.array_join("samples", ",").alias("samples"))


@query("quality_verdict", f"WITH {ISSUES} SELECT count(*) AS errors, CAST(0 AS BIGINT) AS warnings, count(*) = 0 AS passed FROM iss")
def quality_verdict(spark, sf):
    return quality.passed(found_issues(spark, sf))


@query("benchmark_replay", f"""
WITH {REC} SELECT o_orderpriority AS band, count(*) AS cases, count(*) FILTER (WHERE coalesce(score, 0) >= 40 AND o_orderpriority <> '4-NOT SPECIFIED' AND o_orderstatus = 'F' AND closes IS NOT NULL) AS passed FROM rec GROUP BY o_orderpriority""")
def benchmark_replay(spark, sf):
    recs = base_records(spark, sf)
    cases = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("case_id"), F.col("o_orderpriority").alias("band"),
        F.lit(True).alias("expect_announcement"), F.lit(None).cast("string").alias("expect_product"),
        F.lit(40).alias("min_score"), F.lit(None).cast("int").alias("max_score"),
        F.date_add(F.col("o_orderdate").cast("date"), 30).alias("expect_closes"),
    )
    replayed = recs.select(
        F.col("id").alias("case_id"), (F.col("title") != L.UNJUDGED_TITLE).alias("is_announcement"), "product",
        "score", "closes", "flags",
    )
    return reports.benchmark_bands(reports.benchmark_replay(cases, replayed))


@query("memory_bound", """
SELECT CAST(o_orderkey AS VARCHAR) AS fingerprint FROM orders ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 3000""")
def memory_bound(spark, sf):
    memory = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("fingerprint"), F.col("o_orderdate").alias("written_at")
    )
    return routing.bound_memory(memory).select("fingerprint")


@query("usable_memory", "SELECT CAST(o_orderkey AS VARCHAR) AS fingerprint FROM orders WHERE o_orderpriority = '2-HIGH'")
def usable_memory(spark, sf):
    memory = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("fingerprint"), F.col("o_orderpriority").alias("model")
    )
    return routing.usable_memory(memory, "2-HIGH").select("fingerprint")


@query("given_up_pages", """
SELECT CAST(o_orderkey AS VARCHAR) AS url, CAST(CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 4 + 1 ELSE o_orderkey % 4 END AS INTEGER) AS judge_failures,
 CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 4 + 1 < 3 ELSE true END AS pending FROM orders""")
def given_up_pages(spark, sf):
    snaps = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("url"), (F.col("o_orderkey") % 4).cast("int").alias("judge_failures"),
        F.lit(True).alias("pending"), "o_orderstatus",
    )
    return routing.give_up(snaps.drop("o_orderstatus"), snaps.where("o_orderstatus = 'F'"))


@query("settled_report", """
SELECT CASE o_orderstatus WHEN 'F' THEN 'no_training_word' ELSE 'triaged_out' END AS reason, count(*) AS pages FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def settled_report(spark, sf):
    snaps = table(spark, sf, "orders").select(
        by("o_orderstatus", {"F": "no_training_word", "O": "triaged_out"}).alias("settled_without_verdict")
    )
    return routing.settled_report(snaps)


@query("publish_summary", """
SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS added, count(*) FILTER (WHERE o_orderstatus = 'F') AS removed FROM orders""")
def publish_summary(spark, sf):
    from tidewatch.sources import tables

    now = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    was = now.withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return tables.change_summary(was, now)


@query("previous_version", """
SELECT o_orderkey FROM orders WHERE year(o_orderdate) = 1999""")
def previous_version(spark, sf):
    from tidewatch.sources import tables

    versions = table(spark, sf, "orders").select(
        "o_orderkey", F.year("o_orderdate").cast("string").alias("run_id")
    )
    return tables.previous_version(versions, "2000").select("o_orderkey")


@query("published_runs", """
SELECT 'latest' AS kind, o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1998
UNION ALL SELECT 'before', o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997
UNION ALL SELECT 'first', o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1996""")
def published_runs(spark, sf):
    """Three runs published; the second goes out wrong and once more, the first is replayed; each version is read back."""
    from tidewatch.sources import tables

    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("y"))
    path = f"{scratch_dir(spark)}/published-{uuid.uuid4().hex}"
    of = lambda y: orders.where(F.col("y") == y).drop("y")
    tables.publish(of(1996), path, "r1")
    tables.publish(of(1997).withColumn("o_totalprice", F.lit(0.0)), path, "r2")
    tables.publish(of(1997), path, "r2")
    tables.publish(of(1998), path, "r3")
    tables.publish(of(1996), path, "r1")
    schema = "o_orderkey long, o_totalprice double"
    runs = spark.read.schema(f"{schema}, run_id string").parquet(path)
    kinds = {"latest": tables.read_version(spark, path, "r3", schema), "before": tables.previous_version(runs, "r3"), "first": tables.previous_version(runs, "r2")}
    out = [rows.select(F.lit(kind).alias("kind"), "o_orderkey", "o_totalprice") for kind, rows in kinds.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("apply_urls", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'https://x.example.org/a/apply/now' WHEN '3-MEDIUM' THEN 'https://x.example.org/apply?x=1' END AS apply_url FROM orders""")
def apply_urls(spark, sf):
    written = by("o_orderpriority", {"1-URGENT": "apply/now", "2-HIGH": "N/A", "3-MEDIUM": "/apply?x=1"}, "apply through the portal")
    return table(spark, sf, "orders").select(
        "o_orderkey", A.apply_url(written, F.lit("https://x.example.org/a/b")).alias("apply_url")
    )
