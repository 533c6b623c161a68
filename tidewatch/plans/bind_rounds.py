"""Whole rounds over the given tables, in batch and as streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions import address as A
from tidewatch.operators.judge import VERDICT_TYPE
from tidewatch.operators.spread import first_per_key
from tidewatch.plans import rounds
from tidewatch.plans.bind_events import DAY_AT, LOG, STREAK, waiting_and_log
from tidewatch.plans.bind_records import AFTER, NOTICE, notice_versions
from tidewatch.plans.bind_pages import CHANGE_CTE, NEW_BLOCKS_CTE, pages, prior_html, prior_snapshots
from tidewatch.plans.registry import ORACLES, query, table, table_stream
from tidewatch.plans.sqltext import BODY_CTE, BODY_OF, HOST, PRIOR_HTML, TEXT_OF, TITLE_OF
from tidewatch.session import cut, scratch_dir
from tidewatch.streaming import state


def page_sources(spark, sf):
    """What is known of each source: French paths are confirmed, Spanish ones are portals."""
    return pages(spark, sf).select(
        "url", F.when(F.contains("url", F.lit("/fr/")), True).alias("coop_confirmed"),
        F.when(F.contains("url", F.lit("/es/")), "portal")
        .when(F.contains("url", F.lit("/de/")), "announcement_page").otherwise("site_root").alias("type"),
    )


@query("collection_round", f"""
WITH {CHANGE_CTE}, {NEW_BLOCKS_CTE},
g AS (SELECT url, list(block ORDER BY position) AS fb FROM fresh GROUP BY url),
j AS (SELECT c.url, c.html, c.body, c.article, cb.blocks, coalesce(len(eb.blocks), 0) AS had, g.fb, e.body AS was
      FROM bodies c JOIN cb USING (url) LEFT JOIN eb USING (url) LEFT JOIN g USING (url) LEFT JOIN earlier e USING (url)),
t AS (SELECT *, CASE WHEN length(article) >= 200 AND NOT (length(body) > length(article) * 5 AND length(body) > 200)
      THEN article ELSE body END AS txt, {TITLE_OF('html')} AS title FROM j),
p AS (SELECT url, CASE WHEN had = 0 OR coalesce(len(fb), 0) = 0 THEN txt
  ELSE array_to_string(list_filter(list_concat([coalesce(title, ''), coalesce(blocks[1], '')], fb), lambda x: x <> ''), chr(10) || chr(10)) END AS payload
  FROM t WHERE length(txt) >= 50 AND (was IS NULL OR was <> body)),
r AS (SELECT url, payload, {HOST('url')} AS host, CASE WHEN contains(url, '/fr/') THEN 0 WHEN contains(url, '/es/') THEN 1 WHEN contains(url, '/de/') THEN 2 ELSE 3 END AS rank,
  contains(url, '/fr/') OR contains(url, '/es/') OR regexp_matches(payload, '(?i)co-?op|intern|trainee|training|career|graduate|student') AS wanted FROM p),
k AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY rank, url) AS n FROM r WHERE wanted)
SELECT host, url, CAST(rank AS INTEGER) AS rank, CAST(length(payload) AS INTEGER) AS chars, substr(sha256(payload), 1, 32) AS fingerprint FROM k WHERE n = 1""")
def collection_round(spark, sf):
    """Read, compare, route, and keep the best-ranked page of each host."""
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    none = F.lit(None)
    fetches = pages(spark, sf).select(
        "url", "html", at.alias("fetched_at"), F.lit(True).alias("ok"), F.lit(200).alias("status"),
        F.lit("text/html").alias("content_type"), none.cast("long").alias("bytes"), none.cast("string").alias("error"),
        F.col("url").alias("final_url"),
    )
    prior = prior_snapshots(spark, sf)
    told = cut(rounds.told_apart(rounds.read_pages(fetches, None), prior))
    asked = rounds.routed(rounds.owed_payloads(told, prior), page_sources(spark, sf)).where("settled IS NULL")
    slim = asked.select(
        A.host(F.col("url")).alias("host"), "url", "rank", F.length("payload").alias("chars"), "fingerprint"
    )
    return first_per_key(slim, ["host"], F.col("rank"), F.col("url"))


def opening_judge(excerpts, insist):
    """A stand-in for a model: a page whose first letter has an even code is an announcement named by its first word."""
    out = []
    for excerpt in excerpts:
        about = ord(excerpt[0]) % 2 == 0
        out.append(json.dumps({
            "isTrainingAnnouncement": about, "product": "coop" if about else "unknown", "titleAr": excerpt.split()[0] if about else None,
            "opensISO": None, "closesISO": None, "opensRaw": None, "closesRaw": None, "moreOnPage": False, "majors": [], "seats": None,
            "stipendSAR": None, "durationWeeks": None, "cities": [], "statesZeroCoursesRule": False, "zeroCoursesQuote": None, "applyUrl": None,
        }))
    return out


def judged(spark, sf, budget=None):
    """A whole collection round over the pages, from the last round's snapshots."""
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    none = F.lit(None)
    fetches = pages(spark, sf).select(
        "url", A.host(F.col("url")).alias("org_id"), "html", at.alias("fetched_at"), F.lit(True).alias("ok"), F.lit(200).alias("status"),
        F.lit("text/html").alias("content_type"), none.cast("long").alias("bytes"), none.cast("string").alias("error"),
        F.col("url").alias("final_url"),
    )
    # Of the earlier pages, those of even length were still owed a verdict.
    prior = prior_snapshots(spark, sf).withColumn("pending", F.col("extracted_chars") % 2 == 0)
    records_ = spark.createDataFrame([], schemas.RECORDS)
    memory = spark.createDataFrame([], f"fingerprint string, verdict {VERDICT_TYPE}, model string, written_at timestamp")
    reader = spark.createDataFrame([("cyber", [], False, "x")], "field string, reader_cities array<string>, graduated boolean, field_label string")
    return rounds.collection_round(
        fetches, None, page_sources(spark, sf), prior, records_, memory, reader, "m", opening_judge, at, budget
    )


OWED = f"""{CHANGE_CTE}, {NEW_BLOCKS_CTE},
g AS (SELECT url, list(block ORDER BY position) AS fb FROM fresh GROUP BY url),
j AS (SELECT c.url, c.html, c.body, c.article, cb.blocks, coalesce(len(eb.blocks), 0) AS had, g.fb, e.body AS was, e.url IS NOT NULL AS known,
      CASE WHEN length(pa.a) >= 200 AND NOT (length(pa.b) > length(pa.a) * 5 AND length(pa.b) > 200) THEN length(pa.a) ELSE length(pa.b) END % 2 = 0 AS pend
      FROM bodies c JOIN cb USING (url) LEFT JOIN eb USING (url) LEFT JOIN g USING (url) LEFT JOIN earlier e USING (url)
      LEFT JOIN (SELECT url, {BODY_OF(PRIOR_HTML)} AS b, {BODY_OF(PRIOR_HTML, 'article')} AS a FROM pages) pa USING (url)),
t AS (SELECT *, CASE WHEN length(article) >= 200 AND NOT (length(body) > length(article) * 5 AND length(body) > 200)
      THEN article ELSE body END AS txt, {TITLE_OF('html')} AS title, was IS NULL OR was <> body AS changed FROM j),
p AS (SELECT *, length(txt) >= 50 AND (changed OR (known AND pend)) AS owes, CASE WHEN had = 0 OR coalesce(len(fb), 0) = 0 THEN txt
  ELSE array_to_string(list_filter(list_concat([coalesce(title, ''), coalesce(blocks[1], '')], fb), lambda x: x <> ''), chr(10) || chr(10)) END AS payload FROM t),
r AS (SELECT *, contains(url, '/fr/') OR contains(url, '/es/') OR regexp_matches(payload, '(?i)co-?op|intern|trainee|training|career|graduate|student') AS wanted FROM p)"""


@query("round_owed", f"""
WITH {OWED} SELECT url, changed, CAST(length(payload) AS INTEGER) AS chars, substr(sha256(payload), 1, 32) AS fingerprint FROM r WHERE owes""")
def round_owed(spark, sf):
    """Pages owing a verdict: changed now, or left over by the round before."""
    prior = prior_snapshots(spark, sf).withColumn("pending", F.col("extracted_chars") % 2 == 0)
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    none = F.lit(None)
    fetches = pages(spark, sf).select(
        "url", "html", at.alias("fetched_at"), F.lit(True).alias("ok"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"),
        none.cast("long").alias("bytes"), none.cast("string").alias("error"), F.col("url").alias("final_url"),
    )
    told = cut(rounds.told_apart(rounds.read_pages(fetches, None), prior))
    asked = rounds.routed(rounds.owed_payloads(told, prior), page_sources(spark, sf))
    return asked.select("url", "changed", F.length("payload").alias("chars"), "fingerprint")


@query("judged_round", f"""
WITH {OWED}, v AS (SELECT *, unicode(substr(payload, 1, 1)) % 2 = 0 AS about FROM r WHERE known OR length(txt) >= 50)
SELECT url, false AS pending, CASE WHEN owes AND NOT wanted THEN 'no_training_word' END AS settled,
  CAST(CASE WHEN NOT changed AND NOT (owes AND wanted) AND known THEN 1 END AS INTEGER) AS judge_failures,
  CASE WHEN owes AND wanted AND about THEN regexp_extract(payload, '^\\s*(\\S+)', 1) END AS title FROM v""")
def judged_round(spark, sf):
    """Final snapshots of a whole round, beside the record each page left."""
    out = judged(spark, sf)
    titles = out.records.select("url", "title")
    return out.snapshots.join(titles, "url", "left").select(
        "url", "pending", F.col("settled_without_verdict").alias("settled"), "judge_failures", "title"
    )


@query("round_health", """
SELECT 'healthy' AS state, count(*) AS sources FROM pages""")
def round_health(spark, sf):
    """Source states a round leaves when every fetch answered."""
    return judged(spark, sf).health.groupBy("state").agg(F.count("*").alias("sources"))


@query("notification_round", f"""
WITH {NOTICE}, s2 AS (
 SELECT 'new:' || ak AS key, 'new_relevant' AS kind, score + 200 AS weight, org_id, title || '|' || price % 3 || '|' || seats || '|' || coalesce(CAST(closes AS VARCHAR), '') AS body FROM v WHERE product <> 'graduate_dev' AND score >= 60 AND fresh
 UNION ALL SELECT 'opened:' || ak, 'opened', score + 400, org_id, title || '|' || price % 3 || '|' || seats || '|' || coalesce(CAST(closes AS VARCHAR), '') FROM v WHERE product <> 'graduate_dev' AND score IS NOT NULL AND was <> 'open' AND status = 'open'
 UNION ALL SELECT 'closing:' || ak || ':' || closes, 'closing_soon', score + 500, org_id, title || '|' || price % 3 || '|' || seats || '|' || closes FROM v WHERE product <> 'graduate_dev' AND score IS NOT NULL AND hours > 0 AND hours <= 48
 UNION ALL SELECT 'seats:' || ak || ':' || seats, 'few_seats', score + 300, org_id, title || '|' || seats FROM v WHERE product <> 'graduate_dev' AND seats <= 5 AND score >= 70 AND price % 4 = 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY weight DESC, body) AS n FROM s2) WHERE n = 1),
un AS (SELECT count(*) AS n FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'),
told AS (SELECT CAST(substr(org_id, 2) AS BIGINT) % 7 AS reader_id, key, kind, weight, kind || '|' || org_id || '|' || body AS face FROM best
  UNION ALL SELECT r, 'classifier:' || CAST(CAST(TIMESTAMP '{AFTER}' + INTERVAL 3 HOUR AS DATE) AS VARCHAR), 'classifier_down', 0, 'classifier_down' FROM un, (SELECT unnest(range(0, 7)) AS r) WHERE n >= 3),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY reader_id, face ORDER BY weight DESC, key) AS f FROM told) WHERE f = 1)
SELECT reader_id, key, CASE WHEN row_number() OVER (PARTITION BY reader_id, kind = 'classifier_down' ORDER BY weight DESC, key) <= CASE WHEN kind = 'classifier_down' THEN 6 ELSE 20 END
  THEN 'push' ELSE 'digest' END AS outlet FROM once""")
def notification_round(spark, sf):
    """A whole notification round: two versions of the records, seven readers who follow every seventh organisation."""
    before, after, names = notice_versions(spark, sf)
    healthy = after.select("url", "org_id", F.lit("healthy").alias("state"))
    follows = table(spark, sf, "customer").select(
        (F.col("c_custkey") % 7).alias("reader_id"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("org_id")
    )
    everyone = spark.range(7).select(F.col("id").alias("reader_id"), F.lit(None).cast("string").alias("org_id"))
    released, _ = rounds.notification_round(
        before, after, healthy, healthy, names, follows.unionByName(everyone), spark.createDataFrame([], schemas.NOTICES),
        spark.createDataFrame([], schemas.NOTICE_LOG), F.lit(AFTER).cast("timestamp"), False,
    )
    return released.select("reader_id", "key", "outlet")


def run_to_end(writer) -> None:
    running = writer.trigger(availableNow=True).start()
    running.awaitTermination()


@query("stream_health", f"WITH {LOG}, {STREAK} SELECT url, consecutive_failures, state FROM health")
def stream_health(spark, sf):
    """The event log as a stream of fetches, folded batch by batch."""
    events = table_stream(spark, sf, "events")
    u = F.col("user_id")
    log = events.select(
        F.concat(F.lit("https://h"), F.floor(u / 4).cast("string"), F.lit(".example.org/p/"), u.cast("string")).alias("url"),
        F.col("ts").alias("fetched_at"), F.col("event_id").alias("seq"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_type") == "error", "HTTP 503").alias("error"),
    )
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    run_to_end(state.into(state.health_updates(log), folder, "health"))
    return state.newest(spark, folder, "health", schemas.HEALTH, ["url"]).select("url", "consecutive_failures", "state")


@query("stream_snapshots", f"""
WITH {BODY_CTE}, {TEXT_OF}, o AS (SELECT page_id, {PRIOR_HTML} AS html, url FROM pages), {BODY_CTE.replace('bodies AS', 'ob AS').replace('FROM pages', 'FROM o')},
{TEXT_OF.replace('texts AS', 'ot AS').replace('FROM bodies', 'FROM ob')},
v AS (SELECT t.page_id, length(t.txt) >= 50 AS now_ok, length(p.txt) >= 50 AND t.page_id % 4 <> 3 AS was_ok, t.page_id % 4 = 3 AS failed, sha256(t.body) AS now_hash, sha256(p.body) AS was_hash,
  CAST(length(t.txt) AS INTEGER) AS now_chars, CAST(length(p.txt) AS INTEGER) AS was_chars FROM texts t JOIN ot p USING (page_id))
SELECT page_id, CASE WHEN now_ok THEN now_hash END AS content_hash, CASE WHEN now_ok THEN now_chars ELSE was_chars END AS extracted_chars,
  CASE WHEN was_ok THEN 1 ELSE 2 END AS first_day, CASE WHEN now_ok AND (NOT was_ok OR now_hash <> was_hash) THEN 2 ELSE 1 END AS last_day,
  CASE WHEN now_ok THEN CASE WHEN was_ok AND now_chars < 200 AND now_hash = was_hash THEN 1 ELSE 0 END ELSE 0 END AS thin_runs, true AS pending
FROM v WHERE now_ok OR was_ok""")
def stream_snapshots(spark, sf):
    """Every page lands twice, older wording first; a quarter of the first fetches fail. Folded page by page."""
    raw = table_stream(spark, sf, "pages")
    failed = F.col("page_id") % 4 == 3
    each = raw.select("page_id", "html", F.explode(F.array(F.lit(1), F.lit(2))).alias("day"))
    landed = each.select(
        F.concat(F.lit("https://x.example.org/"), F.col("page_id").cast("string")).alias("url"), F.lit("run").alias("run_id"),
        F.make_timestamp(F.lit(2026), F.lit(1), "day", F.lit(9), F.lit(0), F.lit(0)).alias("fetched_at"),
        ((F.col("day") == 2) | ~failed).alias("ok"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"),
        F.when(F.col("day") == 2, F.col("html")).otherwise(prior_html(F.col("html"))).alias("html"),
        F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("error"),
    )
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    run_to_end(state.into(state.snapshot_updates(landed), folder, "snapshots"))
    kept = state.newest(spark, folder, "snapshots", schemas.STREAM_SNAPSHOTS, ["url"])
    return kept.select(
        F.substring_index("url", "/", -1).cast("long").alias("page_id"), "content_hash", "extracted_chars",
        F.dayofmonth("first_seen").alias("first_day"), F.dayofmonth("last_changed").alias("last_day"), "thin_runs", "pending",
    )


@query("stream_release", ORACLES["release_by_day"])
def stream_release(spark, sf):
    """The notice log as a stream without repeats; then the waiting notices, released against what it holds."""
    waiting, log = waiting_and_log(spark, sf)
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    for name, rows in (("sends", log), ("sends", log), ("queue", waiting)):  # the log lands twice
        rows.write.mode("append").parquet(f"{folder}/landed/{name}")
    landed = lambda name, like: spark.readStream.schema(like.schema).parquet(f"{folder}/landed/{name}")
    run_to_end(state.into(state.sent_once(landed("sends", log)), folder, "log", "append"))
    held = spark.read.schema(log.schema).parquet(f"{folder}/log").select(*log.columns)
    run_to_end(state.releasing(landed("queue", waiting), held, F.lit(DAY_AT).cast("timestamp"), False, folder))
    return spark.read.parquet(f"{folder}/released").select("reader_id", "key", "outlet")
