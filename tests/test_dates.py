"""Both calendars, phrasings, refusals, ranges, and status at an instant."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import dates as D
from tidewatch.plans.bind_records import HIJRI_YEARS

#: First day and month lengths (1: thirty days) of the years the SQL of the queries holds too.
YEARS = {int(y): (dt.date.fromisoformat(start), months) for y, start, months in (line.split() for line in HIJRI_YEARS.split("\n") if line.strip())}

HIJRI = [
    ["محرم", "المحرم"], ["صفر"], ["ربيع الأول"], ["ربيع الآخر", "ربيع الثاني"], ["جمادى الأولى", "جمادى الأول"], ["جمادى الآخرة", "جمادى الثانية"],
    ["رجب"], ["شعبان"], ["رمضان"], ["شوال"], ["ذو القعدة"], ["ذو الحجة"],
]
GREGORIAN = ["يناير", "فبراير", "مارس", "أبريل", "مايو", "يونيو", "يوليو", "أغسطس", "سبتمبر", "أكتوبر", "نوفمبر", "ديسمبر"]
ENGLISH = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def hijri(year, month, day):
    """The Gregorian day from the table alone."""
    start, months = YEARS[year]
    return (start + dt.timedelta(days=sum(29 + int(m) for m in months[: month - 1]) + day - 1)).isoformat()


def eastern(text):
    return text.translate(str.maketrans("0123456789", "٠١٢٣٤٥٦٧٨٩"))


KNOWN = [(y, 1, 1, start.isoformat()) for y, (start, _) in YEARS.items()] + [(y, 7, 20, hijri(y, 7, 20)) for y in YEARS] + [
    (1419, 0, 4, None), (1420, 14, 2, None), (1417, 3, 32, None), (1399, 12, 1, None), (1502, 1, 1, None),
]

FRAMES = ["سجّل اسمك قبل {}", "باب القبول يقفل يوم {} مساءً", "{}", "نستقبلكم ابتداءً من {} في المقر"]


def named_months():
    for m, names in enumerate(HIJRI, 1):
        for k, name in enumerate(names):
            for n, write in enumerate((str, eastern)):
                year = 1415 + (m + 3 * k + n) % 8
                yield FRAMES[(m + k + n) % 4].format(write(f"{3 + m} {name} {year}")), hijri(year, m, 3 + m)


FIRST = list(named_months())
FIRST += [
    (f"1419/{m}/{m + 9}" if m % 2 else eastern(f"1419-{m:02}-{m + 9}"), hijri(1419, m, m + 9)) for m in range(1, 13)
]
FIRST += [(f"القاعة {d} {name} 2031 ظهراً", f"2031-{m:02}-{d:02}") for m, (d, name) in enumerate(zip(range(7, 19), GREGORIAN), 1)]
FIRST += [(f"Doors close {d} {name} 2033", f"2033-{m:02}-{d:02}") for m, (d, name) in enumerate(zip(range(16, 28), ENGLISH), 1)]
FIRST += [(f"{d:02}-{name[:3]}-2029", f"2029-{m:02}-{d:02}") for m, (d, name) in enumerate(zip(range(2, 14), ENGLISH), 1)]
FIRST += [
    ("يقفل الباب 27/11/2031", "2031-11-27"), ("بتاريخ 2031-11-27", "2031-11-27"), ("غرة شوال 1421", hijri(1421, 10, 1)),
    ("17 شهر رجب 1416", hijri(1416, 7, 17)), ("8 من شهر صفر 1418", hijri(1418, 2, 8)), ("9\u061c رمضان 1420", hijri(1420, 9, 9)),
    (f"الأحد 6 شعبان 1417 هـ الموافق {dt.date.fromisoformat(hijri(1417, 8, 6)).day} ديسمبر 1996", hijri(1417, 8, 6)),
    ("التسجيل حتى 7 شوال", None), ("قبل ١٩ محرم", None), ("", None), ("أبوابنا لا تغلق أبداً", None), ("31/04/2031", None), ("30 فبراير 2031", None),
    ("نلتقي في رجب القادم", None), ("أبريل 2031", None), ("موسم 2031-2032", None), ("بعد ثلاثة أيام من النشر", None), ("31 شعبان 1417", None),
]

RANGES = [
    ("من 4 صفر 1416 إلى 21 رمضان 1416", hijri(1416, 2, 4), hijri(1416, 9, 21)), ("نستقبل الطلبات 2031-02-03 حتى 2031-04-05", "2031-02-03", "2031-04-05"),
    ("بين 8 يناير 2032 و 19 أبريل 2032", "2032-01-08", "2032-04-19"), ("الدورة من 25/05/2033 إلى 28/06/2033", "2033-05-25", "2033-06-28"),
]


def _iso(value):
    return value.isoformat() if value else None


def test_known_hijri_days(spark):
    df = spark.createDataFrame([k[:3] for k in KNOWN], "y int, m int, d int")
    got = df.select(D.hijri_to_date(F.col("y"), F.col("m"), F.col("d")).alias("g")).collect()
    assert [_iso(r.g) for r in got] == [k[3] for k in KNOWN]


def test_every_day_of_the_table_round_trips(spark):
    days = spark.sql("SELECT explode(sequence(date'1979-11-21', date'2077-11-16')) AS day")
    back = days.withColumn("h", D.hijri_parts(F.col("day"))).withColumn(
        "back", D.hijri_to_date(F.col("h.year"), F.col("h.month"), F.col("h.day"))
    )
    assert back.where("back IS NULL OR back <> day").count() == 0
    assert days.sparkSession.createDataFrame([(dt.date(1979, 11, 20),)], "day date").select(
        D.hijri_parts(F.col("day"))
    ).first()[0] is None


def test_calendar_dimension_is_contiguous(spark):
    months = D.calendar_dimension(spark)
    assert months.count() == 1212
    assert {r[0] for r in months.select("days").distinct().collect()} == {29, 30}


def test_phrasings_and_refusals(spark):
    df = spark.createDataFrame([(t,) for t, _ in FIRST], "t string")
    got = [_iso(r.d) for r in df.select(D.read_date(F.col("t"))["day"].alias("d")).collect()]
    assert got == [want for _, want in FIRST]


def test_ranges_give_up_the_right_end(spark):
    df = spark.createDataFrame([(r[0],) for r in RANGES], "t string")
    got = df.select(
        D.read_date(F.col("t"), "first")["day"].alias("a"), D.read_date(F.col("t"), "last")["day"].alias("b")
    ).collect()
    assert [(_iso(r.a), _iso(r.b)) for r in got] == [r[1:] for r in RANGES]


def test_no_year_and_two_readings_are_marked(spark):
    texts = ["11 رجب", "07/05/2031", "28/05/2031", "05/05/2031", "2031-05-07", "1420/05/07"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(D.read_date(F.col("t")).alias("m"))
    rows = [r.m for r in df.collect()]
    assert rows[0].ambiguous_year and rows[0].day is None
    assert [r.ambiguous_order for r in rows[1:]] == [True, False, False, False, False]


STATUS = [
    # opens, closes, product, review, as_of, status
    ("2026-08-01", "2026-08-20", "coop", False, "2026-08-20 20:00:00", "closing_soon"),
    ("2026-08-01", "2026-08-20", "coop", False, "2026-08-20 21:00:00", "closed"),
    ("2026-08-25", None, "coop", False, "2026-08-24 20:00:00", "announced_not_open"),
    ("2026-08-25", None, "coop", False, "2026-08-24 21:00:00", "open"),
    ("2024-09-09", None, "coop", False, "2026-08-24 21:00:00", "unknown"),
    (None, "2026-10-15", "coop", False, "2026-08-24 21:00:00", "open"),
    (None, None, "coop", False, "2026-08-24 21:00:00", "unknown"),
    ("2026-08-01", "2026-10-15", "graduate_dev", False, "2026-08-24 21:00:00", "unknown"),
    (None, None, "coop", True, "2026-08-24 21:00:00", "unknown"),
    ("2026-08-01", "2026-10-15", "coop", True, "2026-08-24 21:00:00", "open"),
]


@pytest.mark.parametrize("case", [STATUS])
def test_status_as_of(spark, case):
    df = spark.createDataFrame(case, "o string, c string, p string, r boolean, t string, want string")
    got = df.select(
        D.status_at(
            F.col("o").cast("date"), F.col("c").cast("date"), F.col("p"), F.col("r"), F.col("t").cast("timestamp")
        ).alias("s"),
        "want",
    ).collect()
    assert [r.s for r in got] == [r.want for r in got]


def test_deadline_lasts_until_its_riyadh_midnight(spark):
    row = spark.sql("SELECT date'2026-10-15' AS d").select(
        D.deadline_instant(F.col("d")).alias("end"), D.opening_instant(F.col("d")).alias("start")
    ).first()
    assert row.end == dt.datetime(2026, 10, 15, 20, 59, 59, 999000)
    assert row.start == dt.datetime(2026, 10, 14, 21)


def test_quiet_hours_wrap_midnight(spark):
    # 23:00, 07:00, 03:00 and 12:00 in Riyadh
    df = spark.createDataFrame([("2026-01-01 20:00:00",), ("2026-01-02 04:00:00",), ("2026-01-02 00:00:00",), ("2026-01-02 09:00:00",)], "t string")
    got = [r[0] for r in df.select(D.in_quiet_hours(F.col("t").cast("timestamp"))).collect()]
    assert got == [True, False, True, False]
