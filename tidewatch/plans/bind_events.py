"""Operators over the event log: health, churn, rates, schedules, notices and their release."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import dates as D
from tidewatch.functions import lexicon as L
from tidewatch.operators import due, health, notices, release
from tidewatch.operators.spread import first_per_key
from tidewatch.plans.registry import query, table
from tidewatch.plans.sqltext import q

AS_OF = "2024-01-31 09:00:00"


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def fetch_log(spark, sf):
    """Events as fetches: a user is a source, four sources share a host, eight an organisation."""
    u = F.col("user_id")
    return table(spark, sf, "events").select(
        F.concat(F.lit("https://h"), F.floor(u / 4).cast("string"), F.lit(".example.org/p/"), u.cast("string")).alias("url"),
        F.concat(F.lit("h"), F.floor(u / 4).cast("string")).alias("host"),
        F.floor(u / 8).cast("long").alias("org_id"),
        F.col("ts").alias("fetched_at"),
        F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(
            F.col("event_type") == "error",
            F.when(F.col("value") < 20, "HTTP 403").when(F.col("value") < 60, "fetch failed ECONNRESET").otherwise("HTTP 503"),
        ).alias("error"),
        F.floor("value").cast("string").alias("hash"),
        "value", "event_type", "props",
    )


LOG = """log AS (SELECT 'https://h' || CAST(user_id // 4 AS VARCHAR) || '.example.org/p/' || user_id AS url,
  'h' || CAST(user_id // 4 AS VARCHAR) AS host, user_id // 8 AS org_id, ts AS fetched_at, event_id AS seq,
  event_type <> 'error' AS ok, CASE WHEN event_type = 'error' THEN CASE WHEN value < 20 THEN 'HTTP 403'
    WHEN value < 60 THEN 'fetch failed ECONNRESET' ELSE 'HTTP 503' END END AS error,
  CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS hash, value, event_type, user_id, props FROM events)"""

STREAK = """lastok AS (SELECT url, max((fetched_at, seq)) FILTER (WHERE ok) AS lo FROM log GROUP BY url),
streak AS (SELECT l.url, max(l.fetched_at) AS last_attempt, max(l.fetched_at) FILTER (WHERE ok) AS last_success,
   count(*) FILTER (WHERE NOT ok AND (lo IS NULL OR (l.fetched_at, l.seq) > lo)) AS consecutive_failures,
   max_by(error, (l.fetched_at, l.seq)) FILTER (WHERE NOT ok) AS err
   FROM log l JOIN lastok USING (url) GROUP BY l.url),
health AS (SELECT url, last_attempt, last_success, consecutive_failures,
   CASE WHEN consecutive_failures > 0 THEN err END AS last_error,
   CASE WHEN consecutive_failures = 0 THEN 'healthy' WHEN consecutive_failures <= 5 THEN 'degraded' ELSE 'broken' END AS state FROM streak)"""


@query("failure_streaks", f"""
WITH {LOG}, {STREAK}
SELECT url, epoch_us(last_attempt) AS last_attempt, epoch_us(last_success) AS last_success,
  consecutive_failures, last_error, state FROM health""")
def failure_streaks(spark, sf):
    h = health.failure_streaks(fetch_log(spark, sf))
    return h.withColumn("last_attempt", F.unix_micros("last_attempt")).withColumn(
        "last_success", F.unix_micros("last_success")
    )


def halves(spark, sf):
    log = fetch_log(spark, sf)
    cut = F.col("fetched_at") < F.lit("2024-01-16").cast("timestamp")
    return log.where(cut), log.where(~cut)


@query("folded_health", f"""
WITH {LOG}, {STREAK} SELECT url, consecutive_failures, state FROM health""")
def folded_health(spark, sf):
    """The first half of the month folded, then the second: the same as the whole log at once."""
    first, second = halves(spark, sf)
    folded = health.fold_health(health.failure_streaks(first), second)
    return folded.select("url", "consecutive_failures", "state")


@query("churn_rate", f"""
WITH {LOG}, s AS (SELECT url, hash, lag(hash) OVER (PARTITION BY url ORDER BY fetched_at, seq) AS prev FROM log)
SELECT url, count(*) AS readings, CAST(sum(CASE WHEN prev IS NOT NULL AND prev <> hash THEN 1 ELSE 0 END) AS BIGINT) AS changes,
  round(CASE WHEN count(*) > 1 THEN sum(CASE WHEN prev IS NOT NULL AND prev <> hash THEN 1 ELSE 0 END) / (count(*) - 1) END, 6) AS change_rate
FROM s GROUP BY url""")
def churn_rate(spark, sf):
    return health.churn(fetch_log(spark, sf)).withColumn("change_rate", F.round("change_rate", 6))


@query("host_gap_audit", f"""
WITH {LOG}, s AS (SELECT host, (epoch_us(fetched_at) - epoch_us(lag(fetched_at) OVER (PARTITION BY host ORDER BY fetched_at, seq))) / 60000000.0 AS gap FROM log)
SELECT host, count(*) AS reads, round(CAST(min(gap) AS DOUBLE), 6) AS smallest_gap_minutes, count(*) FILTER (WHERE gap < 12) AS too_soon FROM s GROUP BY host""")
def host_gap_audit(spark, sf):
    return due.rate_audit(fetch_log(spark, sf)).withColumn(
        "smallest_gap_minutes", F.round("smallest_gap_minutes", 6)
    )


def configured(spark, sf):
    """Every source of the log; those of the first organisations are home pages only.

    Every third organisation also lists a page nobody has read, and every fifth has a
    sister that only lists such a page.
    """
    read = fetch_log(spark, sf).select("org_id", "url").distinct()
    new = F.concat("url", F.lit("/new"))
    unread = read.where("org_id % 3 = 0").select("org_id", new.alias("url"))
    sisters = read.where("org_id % 5 = 0").select((F.col("org_id") + 1_000_000).alias("org_id"), new.alias("url"))
    return read.unionByName(unread).unionByName(sisters).withColumn(
        "type", F.when(F.col("org_id") < 5, "site_root").otherwise("careers_page")
    )


def log_health(spark, sf):
    return health.failure_streaks(fetch_log(spark, sf))


CONF_CTE = f"""{LOG}, {STREAK}, rd AS (SELECT DISTINCT org_id, url FROM log), every AS (SELECT * FROM rd UNION ALL SELECT org_id, url || '/new' FROM rd WHERE org_id % 3 = 0
  UNION ALL SELECT org_id + 1000000, url || '/new' FROM rd WHERE org_id % 5 = 0), conf AS (SELECT *, CASE WHEN org_id < 5 THEN 'site_root' ELSE 'careers_page' END AS type FROM every)"""


@query("org_health", f"""
WITH {CONF_CTE},
j AS (SELECT c.org_id, CASE h.state WHEN 'healthy' THEN 0 WHEN 'degraded' THEN 1 WHEN 'broken' THEN 2 END AS r FROM conf c LEFT JOIN health h USING (url))
SELECT org_id, count(*) AS configured, count(*) FILTER (WHERE r IS NULL) AS unread,
  CASE WHEN max(r) IS NULL THEN 'unwatched' WHEN max(r) = 0 AND count(*) FILTER (WHERE r IS NULL) > 0 THEN 'degraded'
       WHEN max(r) = 0 THEN 'healthy' WHEN max(r) = 1 THEN 'degraded' ELSE 'broken' END AS health FROM j GROUP BY org_id""")
def org_health(spark, sf):
    return health.org_health(configured(spark, sf), log_health(spark, sf))


@query("watch_coverage", f"""
WITH {CONF_CTE},
o AS (SELECT c.org_id, count(*) AS conf, count(*) FILTER (WHERE h.last_success IS NOT NULL) AS rd, bool_and(type = 'site_root') AS home FROM conf c LEFT JOIN health h USING (url) GROUP BY c.org_id)
SELECT CAST(sum(conf) AS BIGINT) AS total, CAST(sum(rd) AS BIGINT) AS "read", count(*) FILTER (WHERE rd = conf) AS orgs_fully_read,
  count(*) FILTER (WHERE rd = 0) AS orgs_unread, count(*) FILTER (WHERE rd > 0 AND home) AS orgs_homepage_only FROM o""")
def watch_coverage(spark, sf):
    return health.coverage(configured(spark, sf), log_health(spark, sf))


@query("blind_orgs", f"""
WITH {CONF_CTE}, t AS (SELECT DISTINCT org_id, CASE WHEN org_id % 2 = 0 THEN 'S' ELSE 'C' END AS tier FROM conf)
SELECT org_id, tier, tier IN ('S', 'A') AS top_tier FROM t
WHERE org_id NOT IN (SELECT org_id FROM conf JOIN health USING (url) WHERE last_success IS NOT NULL)""")
def blind_orgs(spark, sf):
    orgs = tiered_orgs(spark, sf)
    return health.blind_orgs(orgs, configured(spark, sf), log_health(spark, sf))


def tiered_orgs(spark, sf):
    return configured(spark, sf).select("org_id").distinct().withColumn(
        "tier", F.when(F.col("org_id") % 2 == 0, "S").otherwise("C")
    )


def two_versions(spark, sf):
    """Health in the middle of the month and at its end, where failing now counts as broken."""
    first, _ = halves(spark, sf)
    broken = F.when(F.col("consecutive_failures") > 0, "broken").otherwise("healthy")
    before = health.failure_streaks(first).withColumn("state", broken)
    after = health.failure_streaks(fetch_log(spark, sf)).withColumn("state", broken)
    return before, after


TWO = """b AS (SELECT url, CASE WHEN arg_max(ok, (fetched_at, seq)) THEN 'healthy' ELSE 'broken' END AS state FROM log WHERE fetched_at < TIMESTAMP '2024-01-16' GROUP BY url),
a AS (SELECT url, CASE WHEN arg_max(ok, (fetched_at, seq)) THEN 'healthy' ELSE 'broken' END AS state FROM log GROUP BY url)"""


@query("coverage_drop", f"""
WITH {LOG}, {TWO}, c AS (SELECT (SELECT count(*) FROM b WHERE state <> 'broken') AS was_readable, (SELECT count(*) FROM a WHERE state <> 'broken') AS now_readable)
SELECT was_readable, now_readable, was_readable - now_readable AS lost,
  was_readable > 0 AND was_readable - now_readable >= 5 AND (was_readable - now_readable) / was_readable >= 0.06 AS dropped FROM c""")
def coverage_drop(spark, sf):
    return health.coverage_drop(*two_versions(spark, sf))


@query("newly_broken", f"""
WITH {LOG}, {TWO} SELECT a.url FROM a LEFT JOIN b USING (url) WHERE a.state = 'broken' AND coalesce(b.state, '') <> 'broken'""")
def newly_broken(spark, sf):
    return health.newly_broken(*two_versions(spark, sf)).select("url")


@query("broken_notice", f"""
WITH {LOG}, {TWO}, n AS (SELECT 'org ' || CAST(regexp_extract(a.url, '([0-9]+)$', 1) AS BIGINT) // 8 AS name, a.url FROM a LEFT JOIN b USING (url) WHERE a.state = 'broken' AND coalesce(b.state, '') <> 'broken')
SELECT 'source_broken' AS kind, '🔴 ' || count(*) || ' مصادر توقّفت' AS title, CAST(150 AS DOUBLE) AS weight, 'broken:{AS_OF[:10]}' AS key_head FROM n HAVING count(*) > 1
UNION ALL SELECT 'source_broken', '🔴 مصدر توقّف · ' || min(name), CAST(150 AS DOUBLE), 'broken:https' FROM n HAVING count(*) = 1""")
def broken_notice(spark, sf):
    before, after = two_versions(spark, sf)
    owner = (F.regexp_extract("url", "([0-9]+)$", 1).cast("long") / 8).cast("long").cast("string")
    named = after.withColumn("org_id", owner)
    names = fetch_log(spark, sf).select(F.col("org_id").cast("string").alias("org_id")).distinct().withColumn(
        "name", F.concat(F.lit("org "), F.col("org_id"))
    )
    said = notices.broken_notices(before, named, names, as_of())
    return said.select("kind", "title", "weight", F.substring_index("key", ":", 2).alias("key_head"))


@query("day_labels", f"""
WITH e AS (SELECT event_id, ts, round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 60000000.0) AS m FROM events),
a AS (SELECT *, round(m / 60) AS h, round(round(m / 60) / 24) AS d FROM e)
SELECT event_id, CASE WHEN m < 2 THEN 'الآن' WHEN m < 60 THEN 'قبل ' || CAST(m AS INTEGER) || ' دقيقة' WHEN h < 24 THEN 'قبل ' || CAST(h AS INTEGER) || ' ساعة' ELSE 'قبل ' || CAST(d AS INTEGER) || ' يوم' END AS ago,
  day(ts) || ' ' || [{', '.join(q(n) for n in L.GREGORIAN_MONTH_NAMES)}][month(ts)] || ' ' || year(ts) AS day FROM a""")
def day_labels(spark, sf):
    """Days and ages in words."""
    return table(spark, sf, "events").select(
        "event_id", D.time_ago(F.col("ts"), as_of()).alias("ago"), D.gregorian_label(F.col("ts").cast("date")).alias("day")
    )


@query("last_check", f"""
SELECT epoch_us(max(ts)) AS last_check, round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 3600000000.0, 6) AS hours_since FROM events""")
def last_check(spark, sf):
    h = health.failure_streaks(fetch_log(spark, sf))
    return health.last_check(h, as_of()).select(
        F.unix_micros("last_check").alias("last_check"), F.round("hours_since", 6).alias("hours_since")
    )


@query("fetch_error_reasons", f"""
WITH {LOG} SELECT CASE error WHEN 'HTTP 403' THEN 'الموقع رفض الطلب (٤٠٣)، وغالباً يحجب القراءة الآلية.'
  WHEN 'HTTP 503' THEN 'الموقع نفسه يعطي خطأً في خادمه.' ELSE 'انقطع الاتّصال أثناء القراءة.' END AS why, count(*) AS fetches
FROM log WHERE NOT ok GROUP BY 1""")
def fetch_error_reasons(spark, sf):
    from tidewatch.functions.messages import fetch_error

    failed = fetch_log(spark, sf).where("NOT ok")
    return failed.groupBy(fetch_error(F.col("error")).alias("why")).agg(F.count("*").alias("fetches"))


def _error_kinds() -> list[tuple[str, str]]:
    """A raw error for every branch, and the sentence a reader gets."""
    by_words = ["Chromium unavailable", "robots.txt: request aborted", "robots.txt unreachable", "Disallowed for agents"]
    by_code = {"HTTP 403": 403, "HTTP 404": 404, "http 410": 410, "HTTP 502 Bad Gateway": "5xx", "HTTP 418": "other"}
    after = ["read ETIMEDOUT", "getaddrinfo ENOTFOUND a.example", "connect ECONNREFUSED", "certificate has expired", "socket hang up"]
    kinds = list(zip(by_words, [sentence for _, sentence in L.FETCH_ERRORS]))
    kinds += [(raw, L.HTTP_ERRORS[code]) for raw, code in by_code.items()]
    kinds += list(zip(after, [sentence for _, sentence in L.FETCH_ERRORS_AFTER_HTTP]))
    return [*kinds, ("something else", L.FETCH_ERROR_OTHER), ("لم تصل الصفحة كاملة", "لم تصل الصفحة كاملة")]


@query("fetch_error_kinds", "SELECT event_id, CASE event_id % {} {} END AS why FROM events".format(
    len(_error_kinds()), " ".join(f"WHEN {n} THEN {q(sentence)}" for n, (_, sentence) in enumerate(_error_kinds()))))
def fetch_error_kinds(spark, sf):
    """Every kind of failure in turn, in the words a reader gets."""
    from tidewatch.functions.messages import fetch_error

    raw = F.element_at(F.array(*[F.lit(raw) for raw, _ in _error_kinds()]), (F.col("event_id") % len(_error_kinds()) + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", fetch_error(raw).alias("why"))


@query("channel_health", """
WITH s AS (SELECT user_id // 10 AS channel, date_trunc('day', ts) AS round_at, event_type <> 'error' AND value > 150 AS ok FROM events WHERE event_type IN ('error', 'purchase')),
r AS (SELECT channel, round_at, count(*) FILTER (WHERE ok) AS n FROM s GROUP BY ALL)
SELECT channel, epoch_us(max(round_at)) AS last_attempt, epoch_us(max(round_at) FILTER (WHERE n > 0)) AS last_success,
  CASE WHEN max_by(n, round_at) = 0 THEN 'down' WHEN max(round_at) FILTER (WHERE n > 0) IS NOT NULL THEN 'healthy' ELSE 'untested' END AS state FROM r GROUP BY channel""")
def channel_health(spark, sf):
    sends = table(spark, sf, "events").where(F.col("event_type").isin("error", "purchase")).select(
        F.floor(F.col("user_id") / 10).cast("long").alias("channel"), F.date_trunc("day", "ts").alias("round_at"),
        F.col("event_id").alias("key"), ((F.col("event_type") != "error") & (F.col("value") > 150)).alias("ok"),
    )
    state = health.channel_health(sends)
    return state.withColumn("last_attempt", F.unix_micros("last_attempt")).withColumn(
        "last_success", F.unix_micros("last_success")
    )


# ---- schedule -----------------------------------------------------------------


def schedule(spark, sf):
    """Every source with its last read; an hour or three after it the next is due."""
    tier = (
        F.when(F.col("_v") < 100, "low").when(F.col("_v") < 200, "medium").when(F.col("_v") < 300, "high").otherwise("hot")
    )
    return (
        fetch_log(spark, sf).groupBy("url").agg(
            F.max("fetched_at").alias("last_checked"), F.max("value").alias("_v"),
            F.min("org_id").cast("string").alias("org_id"),
        )
        .withColumn("tier", tier)
        .withColumn("next_check", F.expr("timestampadd(HOUR, CASE WHEN _v < 200 THEN 3 ELSE 1 END, last_checked)"))
        .drop("_v")
    )


SCHED = f"""{LOG}, sched AS (SELECT url, min(host) AS host, max(fetched_at) AS last_checked,
  CASE WHEN max(value) < 100 THEN 'low' WHEN max(value) < 200 THEN 'medium' WHEN max(value) < 300 THEN 'high' ELSE 'hot' END AS tier,
  max(fetched_at) + CASE WHEN max(value) < 200 THEN INTERVAL 3 HOUR ELSE INTERVAL 1 HOUR END AS next_check FROM log GROUP BY url),
hosts AS (SELECT host, count(*) AS n, max(last_checked) AS last FROM sched GROUP BY host),
timed AS (SELECT s.*, n, last, greatest(CASE tier WHEN 'hot' THEN 15 WHEN 'high' THEN 45 WHEN 'medium' THEN 180 ELSE 360 END, n * 12) AS every FROM sched s JOIN hosts USING (host))"""
SCHED_AT = "2024-01-30 23:30:00"


@query("due_selection", f"""
WITH {SCHED}, d AS (SELECT url, host, tier, n, (epoch_us(TIMESTAMP '{SCHED_AT}') - epoch_us(next_check)) / 60000000.0 / every AS urgency FROM timed
  WHERE next_check <= TIMESTAMP '{SCHED_AT}' AND epoch_us(TIMESTAMP '{SCHED_AT}') - epoch_us(last) >= 720000000),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY urgency DESC, url) AS k FROM d)
SELECT url, host || '.example.org' AS host, tier, round(CAST(urgency AS DOUBLE), 6) AS urgency FROM r WHERE k = 1 ORDER BY urgency DESC, url LIMIT 40""")
def due_selection(spark, sf):
    chosen = due.due_now(schedule(spark, sf), F.lit(SCHED_AT).cast("timestamp"))
    return chosen.select("url", "host", "tier", F.round("urgency", 6).alias("urgency"))


@query("host_counts", """
SELECT lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, count(DISTINCT url) AS urls FROM pages GROUP BY 1""")
def host_counts(spark, sf):
    return due.host_counts(table(spark, sf, "pages"))


@query("stable_spread", """
SELECT url, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(url, ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda h, c: (h * 31 + c) % 4294967296) % 1800000 AS offset_ms FROM pages""")
def stable_spread(spark, sf):
    return table(spark, sf, "pages").select("url", due.stable_spread(F.col("url")).alias("offset_ms"))


@query("reconciled_schedule", f"""
WITH {SCHED}, t AS (SELECT url, min(host) AS host, CASE WHEN min(value) < 1 THEN 'hot' WHEN max(value) < 100 THEN 'low' WHEN max(value) < 200 THEN 'medium' WHEN max(value) < 300 THEN 'high' ELSE 'hot' END AS tier
   FROM log WHERE event_type <> 'signup' GROUP BY url),
old AS (SELECT * FROM sched WHERE last_checked >= TIMESTAMP '2024-01-30'),
h AS (SELECT host, count(*) AS n FROM t GROUP BY host),
sp AS (SELECT url, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(url, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) % 1800000 AS ms FROM t)
SELECT t.url, t.tier, CASE WHEN old.url IS NULL THEN 'new' WHEN old.tier = t.tier THEN 'unchanged' ELSE 'retimed' END AS change,
  epoch_us(CASE WHEN old.url IS NULL THEN TIMESTAMP '{AS_OF}' + to_milliseconds(ms) WHEN old.tier = t.tier THEN old.next_check
    ELSE old.last_checked + to_minutes(CAST(greatest(CASE t.tier WHEN 'hot' THEN 15 WHEN 'high' THEN 45 WHEN 'medium' THEN 180 ELSE 360 END, h.n * 12) AS BIGINT)) END) AS next_check,
  epoch_us(old.last_checked) AS last_checked
FROM t JOIN h USING (host) JOIN sp USING (url) LEFT JOIN old USING (url)""")
def reconciled_schedule(spark, sf):
    old = schedule(spark, sf).where(F.col("last_checked") >= F.lit("2024-01-30").cast("timestamp"))
    v = F.max("value")
    tier = F.when(F.min("value") < 1, "hot").when(v < 100, "low").when(v < 200, "medium").when(v < 300, "high").otherwise("hot")
    targets = fetch_log(spark, sf).where("event_type <> 'signup'").groupBy("url").agg(
        tier.alias("tier"), F.min("org_id").cast("string").alias("org_id")
    )
    plan = due.reconcile(old, targets, as_of())
    return plan.select(
        "url", "tier", "change", F.unix_micros("next_check").alias("next_check"),
        F.unix_micros("last_checked").alias("last_checked"),
    )


@query("marked_checked", f"""
WITH {SCHED}, r AS (SELECT DISTINCT url FROM log WHERE fetched_at >= TIMESTAMP '2024-01-30' AND ok)
SELECT url, epoch_us(CASE WHEN r.url IS NULL THEN next_check ELSE TIMESTAMP '{AS_OF}' + to_minutes(CAST(every AS BIGINT)) END) AS next_check,
  epoch_us(CASE WHEN r.url IS NULL THEN last_checked ELSE TIMESTAMP '{AS_OF}' END) AS last_checked FROM timed LEFT JOIN r USING (url)""")
def marked_checked(spark, sf):
    read = fetch_log(spark, sf).where("ok").where(F.col("fetched_at") >= F.lit("2024-01-30").cast("timestamp"))
    plan = due.mark_checked(schedule(spark, sf), read, as_of())
    return plan.select(
        "url", F.unix_micros("next_check").alias("next_check"), F.unix_micros("last_checked").alias("last_checked")
    )


@query("spread_backlog", f"""
WITH {SCHED}, f AS (SELECT *, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(next_check) > 3600000000 AS late FROM sched),
s AS (SELECT avg(CASE WHEN late THEN 1.0 ELSE 0.0 END) AS share FROM f),
sp AS (SELECT url, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(url, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296) % 1800000 AS ms FROM sched)
SELECT url, epoch_us(CASE WHEN share >= 0.5 AND late THEN TIMESTAMP '{AS_OF}' + to_milliseconds(ms) ELSE next_check END) AS next_check FROM f JOIN sp USING (url), s""")
def spread_backlog(spark, sf):
    plan = due.spread_backlog(schedule(spark, sf), as_of())
    return plan.select("url", F.unix_micros("next_check").alias("next_check"))


@query("promised_reads", f"""
WITH {SCHED}, c AS (SELECT url, count(*) AS reads FROM log GROUP BY url)
SELECT url, tier, reads, CAST(floor(43200.0 / every) AS BIGINT) AS promised FROM timed JOIN c USING (url)""")
def promised_reads(spark, sf):
    return due.promised_reads(fetch_log(spark, sf), schedule(spark, sf), 30)


# ---- notices ------------------------------------------------------------------


KINDS = """CASE event_type WHEN 'click' THEN 'new_relevant' WHEN 'view' THEN 'opened' WHEN 'purchase' THEN 'closing_soon'
  WHEN 'signup' THEN 'source_broken' ELSE 'coverage_dropped' END"""
PREFIX = """CASE event_type WHEN 'click' THEN 'new' WHEN 'view' THEN 'opened' WHEN 'purchase' THEN 'closing'
  WHEN 'signup' THEN 'broken' ELSE 'coverage' END"""


def queue(spark, sf):
    """Events as queued notices: a reader per ten users, one key per reader, kind and k."""
    e = F.col("event_type")
    kind = (
        F.when(e == "click", "new_relevant").when(e == "view", "opened").when(e == "purchase", "closing_soon")
        .when(e == "signup", "source_broken").otherwise("coverage_dropped")
    )
    prefix = (
        F.when(e == "click", "new").when(e == "view", "opened").when(e == "purchase", "closing")
        .when(e == "signup", "broken").otherwise("coverage")
    )
    k = F.regexp_extract("props", "([0-9]+)", 1)
    return table(spark, sf, "events").select(
        F.floor(F.col("user_id") / 10).cast("long").alias("reader_id"),
        F.concat_ws(":", prefix, k).alias("key"),
        kind.alias("kind"),
        F.concat(F.lit("title "), k).alias("title"),
        F.concat(F.lit("body "), F.floor(F.col("value") / 50).cast("string")).alias("body"),
        (F.floor("value") + 100).cast("double").alias("weight"),
        k.alias("announcement"),
        F.col("ts").alias("queued_at"),
        "event_id",
    )


QUEUE = f"""allq AS (SELECT user_id // 10 AS reader_id, {PREFIX} || ':' || regexp_extract(props, '([0-9]+)', 1) AS key, {KINDS} AS kind,
  'title ' || regexp_extract(props, '([0-9]+)', 1) AS title, 'body ' || CAST(floor(value / 50) AS BIGINT) AS body,
  floor(value) + 100 AS weight, regexp_extract(props, '([0-9]+)', 1) AS announcement, ts AS queued_at, event_id FROM events)"""


@query("notice_best_per_key", f"""
WITH {QUEUE} SELECT reader_id, key, max(weight) AS weight, min_by(body, (-weight, title, body)) AS body FROM allq GROUP BY reader_id, key""")
def notice_best_per_key(spark, sf):
    best = notices.best_per_key(queue(spark, sf), ["reader_id", "key"])
    return best.select("reader_id", "key", "weight", "body")


def waiting_and_log(spark, sf):
    """Late events wait; earlier ones are the log of what was sent, by channel."""
    rows = queue(spark, sf)
    cut = F.lit("2024-01-28").cast("timestamp")
    waiting = first_per_key(
        rows.where(F.col("queued_at") >= cut).drop("event_id"), ["reader_id", "key"], F.col("queued_at"), -F.col("weight")
    )
    via = (
        F.when(F.col("weight") < 110, F.lit(None).cast("string")).when(F.col("weight") < 120, "push")
        .when(F.col("weight") < 130, "digest").otherwise("toast")
    )
    log = rows.where(F.col("queued_at") < cut).select("reader_id", "key", F.col("queued_at").alias("sent_at"), via.alias("via"))
    return waiting, log


WAITING = f"""{QUEUE},
waiting AS (SELECT reader_id, key, min_by(kind, (queued_at, -weight)) AS kind, min_by(title, (queued_at, -weight)) AS title,
  min_by(body, (queued_at, -weight)) AS body, min_by(weight, (queued_at, -weight)) AS weight, min_by(announcement, (queued_at, -weight)) AS announcement, min(queued_at) AS queued_at
  FROM allq WHERE queued_at >= TIMESTAMP '2024-01-28' GROUP BY reader_id, key),
nlog AS (SELECT reader_id, key, queued_at AS sent_at, CASE WHEN weight < 110 THEN NULL WHEN weight < 120 THEN 'push' WHEN weight < 130 THEN 'digest' ELSE 'toast' END AS via
  FROM allq WHERE queued_at < TIMESTAMP '2024-01-28'),
done AS (SELECT reader_id, key, bool_or(coalesce(via, 'push') = 'push') AS p, bool_or(via = 'digest') AS d FROM nlog GROUP BY ALL)"""
RELEASE_AT = "2024-01-28 09:00:00"
FRESH = f"""fresh AS (SELECT w.*, coalesce(d, false) AS d, w.weight + greatest(0, (epoch_us(TIMESTAMP '@AT') - epoch_us(queued_at)) / 86400000000.0) * 40 AS eff,
  kind IN ('new_relevant', 'fit_unknown', 'opened', 'closing_soon', 'few_seats') AS opening
  FROM waiting w LEFT JOIN done USING (reader_id, key)
  WHERE NOT coalesce(p, false) AND (kind IN ('new_relevant', 'fit_unknown', 'opened', 'closing_soon', 'few_seats') OR NOT coalesce(d, false)))"""
SENT = """sent AS (SELECT reader_id, count(*) FILTER (WHERE regexp_matches(key, '^(new|opened|closing|seats|fit):')) AS so,
  count(*) FILTER (WHERE NOT regexp_matches(key, '^(new|opened|closing|seats|fit):')) AS sm FROM nlog
  WHERE coalesce(via, 'push') = 'push' AND CAST(sent_at + INTERVAL 3 HOUR AS DATE) = CAST(TIMESTAMP '@AT' + INTERVAL 3 HOUR AS DATE) GROUP BY reader_id)"""
DAY_AT = "2024-01-27 22:00:00"


@query("release_by_day", f"""
WITH {WAITING}, {FRESH}, {SENT},
faces AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reader_id, kind, title, body ORDER BY eff DESC, key) AS f FROM fresh) WHERE f = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY reader_id, opening ORDER BY eff DESC, key) AS r FROM faces)
SELECT reader_id, key, outlet FROM (
 SELECT f.reader_id, f.key, CASE WHEN r <= CASE WHEN opening THEN 20 - coalesce(so, 0) ELSE 6 - coalesce(sm, 0) END THEN 'push' WHEN NOT d THEN 'digest' END AS outlet
 FROM ranked f LEFT JOIN sent USING (reader_id)) WHERE outlet IS NOT NULL""".replace("@AT", DAY_AT))
def release_by_day(spark, sf):
    waiting, log = waiting_and_log(spark, sf)
    out = release.release(waiting, log, F.lit(DAY_AT).cast("timestamp"), quiet=False)
    return out.select("reader_id", "key", "outlet")


@query("release_in_quiet_hours", f"""
WITH {WAITING}, {FRESH}, {SENT},
ranked AS (SELECT *, row_number() OVER (PARTITION BY reader_id ORDER BY eff DESC, key) AS r FROM fresh WHERE kind = 'closing_soon')
SELECT reader_id, key, outlet FROM (
 SELECT f.reader_id, f.key, CASE WHEN r.r <= 6 - coalesce(so, 0) - coalesce(sm, 0) THEN 'push' WHEN NOT f.d THEN 'digest' END AS outlet
 FROM fresh f LEFT JOIN ranked r USING (reader_id, key) LEFT JOIN sent ON sent.reader_id = f.reader_id) WHERE outlet IS NOT NULL""".replace("@AT", DAY_AT))
def release_in_quiet_hours(spark, sf):
    waiting, log = waiting_and_log(spark, sf)
    out = release.release(waiting, log, F.lit(DAY_AT).cast("timestamp"), quiet=True)
    return out.select("reader_id", "key", "outlet")


@query("carried_queue", f"""
WITH {QUEUE}, pend AS (SELECT * FROM allq WHERE queued_at < TIMESTAMP '2024-01-20'), fresh AS (SELECT * FROM allq WHERE queued_at >= TIMESTAMP '2024-01-20'),
live AS (SELECT DISTINCT announcement FROM allq WHERE weight > 300),
k AS (SELECT reader_id, key, queued_at, 0 AS turn FROM pend p WHERE epoch_us(TIMESTAMP '2024-01-21') - epoch_us(queued_at) < 7 * 86400000000 OR announcement IN (SELECT announcement FROM live)
  UNION ALL SELECT reader_id, key, TIMESTAMP '2024-01-21', 1 FROM fresh)
SELECT reader_id, key, epoch_us(min_by(queued_at, (turn, queued_at))) AS queued_at FROM k GROUP BY reader_id, key""")
def carried_queue(spark, sf):
    rows = queue(spark, sf).drop("event_id")
    cut = F.lit("2024-01-20").cast("timestamp")
    live = rows.where("weight > 300").select("announcement")
    kept = release.carry(
        rows.where(F.col("queued_at") < cut), rows.where(F.col("queued_at") >= cut), live,
        F.lit("2024-01-21").cast("timestamp"),
    )
    return kept.select("reader_id", "key", F.unix_micros("queued_at").alias("queued_at"))


@query("log_retention", f"""
WITH {WAITING}
SELECT reader_id, key, via, epoch_us(sent_at) AS sent_at FROM (SELECT reader_id, key, via, sent_at FROM nlog UNION ALL SELECT reader_id, key, 'digest', TIMESTAMP '2024-02-05' FROM waiting)
WHERE epoch_us(TIMESTAMP '2024-02-05') - epoch_us(sent_at) < 31 * 86400000000""")
def log_retention(spark, sf):
    waiting, log = waiting_and_log(spark, sf)
    sent = waiting.select("reader_id", "key").withColumn("via", F.lit("digest"))
    kept = release.append_log(log, sent, F.lit("2024-02-05").cast("timestamp"))
    return kept.select("reader_id", "key", "via", F.unix_micros("sent_at").alias("sent_at"))


@query("held_count", f"""
WITH {WAITING}
SELECT reader_id, count(*) AS held FROM waiting w LEFT JOIN done USING (reader_id, key)
WHERE NOT (coalesce(p, false) OR (kind NOT IN ('new_relevant', 'fit_unknown', 'opened', 'closing_soon', 'few_seats') AND coalesce(d, false))) GROUP BY reader_id""")
def held_count(spark, sf):
    waiting, log = waiting_and_log(spark, sf)
    return release.held_count(waiting, log, as_of())


@query("follow_ups", f"""
SELECT user_id AS reader_id, event_id AS id FROM events e WHERE event_type = 'purchase' AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts) >= 14 * 86400000000
AND NOT EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'purchase' AND r.value > 100 AND r.event_id = e.event_id)""")
def follow_ups(spark, sf):
    bought = table(spark, sf, "events").select(
        F.col("user_id").alias("reader_id"), F.col("event_id").alias("id"), F.col("ts").alias("applied_at"),
        F.when(F.col("event_type") == "purchase", "applied").otherwise("interested").alias("mark"), "value",
    )
    reminded = bought.where("mark = 'applied' AND value > 100")
    return notices.follow_ups(bought, reminded, as_of()).select("reader_id", "id")


@query("quiet_hours", """
SELECT event_id, hour(ts + INTERVAL 3 HOUR) >= 23 OR hour(ts + INTERVAL 3 HOUR) < 7 AS quiet,
  CAST(ts + INTERVAL 3 HOUR AS DATE) AS riyadh_day FROM events""")
def quiet_hours(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", D.in_quiet_hours(F.col("ts")).alias("quiet"), D.riyadh_day(F.col("ts")).alias("riyadh_day")
    )


@query("verdict_usage", """
SELECT event_type AS model, CAST(sum(CAST(floor(value * 10) AS BIGINT)) AS BIGINT) AS input_tokens, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS output_tokens,
  round((sum(floor(value * 10)) * 3 + sum(floor(value * 2)) * 3 * 1.25 + sum(floor(value * 4)) * 3 * 0.1 + sum(floor(value)) * 15) / 1e6, 6) AS cost,
  round(((sum(floor(value * 10)) + sum(floor(value * 2)) + sum(floor(value * 4))) * 3 + sum(floor(value)) * 15) / 1e6, 6) AS uncached_cost
FROM events GROUP BY event_type""")
def verdict_usage(spark, sf):
    from tidewatch.operators import routing

    v = F.col("value")
    replies = table(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.floor(v * 10).cast("long").alias("input_tokens"),
        F.floor(v).cast("long").alias("output_tokens"), F.floor(v * 2).cast("long").alias("cache_write_tokens"),
        F.floor(v * 4).cast("long").alias("cache_read_tokens"),
    )
    totals = routing.usage_totals(replies, input_price=3.0, output_price=15.0)
    return totals.select(
        "model", "input_tokens", "output_tokens", F.round("cost", 6).alias("cost"),
        F.round("uncached_cost", 6).alias("uncached_cost"),
    )


@query("vantage_comparison", """
WITH p AS (SELECT user_id AS url, CASE WHEN value < 50 THEN 'home' ELSE 'cloud' END AS vantage, CASE WHEN event_type = 'error' THEN 'blocked' ELSE 'served' END AS verdict FROM events),
g AS (SELECT url, max(verdict) FILTER (WHERE vantage = 'home') AS home, max(verdict) FILTER (WHERE vantage = 'cloud') AS cloud FROM p GROUP BY url)
SELECT url, home, cloud, home IS NOT NULL AND cloud IS NOT NULL AND home <> cloud AS disagree FROM g""")
def vantage_comparison(spark, sf):
    from tidewatch.operators import reports

    probes = table(spark, sf, "events").select(
        F.col("user_id").alias("url"), F.when(F.col("value") < 50, "home").otherwise("cloud").alias("vantage"),
        F.when(F.col("event_type") == "error", "blocked").otherwise("served").alias("verdict"),
    )
    return reports.vantage_comparison(probes, ["home", "cloud"])


@query("staleness_alarms", f"""
WITH {WAITING}, u AS (SELECT count(*) AS unjudged FROM orders WHERE o_orderstatus = 'P'),
x AS (SELECT (SELECT max(ts) FROM events) AS last_check, (SELECT max(sent_at) FROM nlog WHERE via IS NULL OR via = 'push') AS last_sent, unjudged FROM u)
SELECT unjudged, epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_check) > 10800000000 AS stalled,
 epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_check) < 86400000000 AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(last_sent) > 7 * 86400000000 AS push_silent, unjudged >= 3 AS judging_stuck FROM x""")
def staleness_alarms(spark, sf):
    _, log = waiting_and_log(spark, sf)
    records = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "P", F.array(F.lit("needs_manual_review"))).otherwise(F.array().cast("array<string>")).alias("flags")
    )
    h = health.failure_streaks(fetch_log(spark, sf))
    return health.staleness_alarms(h, log, records, as_of()).select(
        "unjudged", "stalled", "push_silent", "judging_stuck"
    )


