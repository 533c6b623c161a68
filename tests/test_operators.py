"""Operators against brute force and literal cases."""

import datetime as dt
import itertools
import json
import random

from pyspark.sql import functions as F

from tidewatch import schemas
from tidewatch.functions import lexicon as L
from tidewatch.operators import (
    diff, due, entities, health, judge, notices, quality, records, relevance, release, reports, routing, spread,
)
from tidewatch.sources import robots, sitemaps, tables

NOW = "2026-08-24 09:00:00"


def at(text=NOW):
    return F.lit(text).cast("timestamp")


def ts(text):
    return dt.datetime.fromisoformat(text)


# ---- balanced plan shapes -----------------------------------------------------


def test_running_total_equals_brute_force(spark):
    rnd = random.Random(7)
    rows = [(rnd.randint(0, 3), f"k{i}", rnd.randint(1, 90)) for i in range(3000)]
    df = spark.createDataFrame(rows, "rank int, key string, cost long")
    got = {r.key: r.spent for r in spread.running_total(df, "rank", "key", "cost", "spent").collect()}
    import hashlib

    total, want = 0, {}
    for rank, key, cost in sorted(rows, key=lambda r: (r[0], hashlib.md5(r[1].encode()).hexdigest(), r[1])):
        total += cost
        want[key] = total
    assert got == want


def test_top_k_and_first_per_key_on_a_hot_key(spark):
    rows = [("hot", i, str(i)) for i in range(5000)] + [(f"c{i}", i, "x") for i in range(50)]
    df = spark.createDataFrame(rows, "k string, v int, w string")
    top = spread.top_k(df, ["k"], [F.desc("v")], 7)
    assert [r.v for r in top.where("k = 'hot'").orderBy("rank").collect()] == list(range(4999, 4992, -1))
    first = spread.first_per_key(df, ["k"], -F.col("v"))
    assert first.where("k = 'hot'").first().w == "4999" and first.count() == 51


def test_spread_join_loses_and_repeats_nothing(spark):
    left = spark.createDataFrame([("hot", i) for i in range(2000)] + [("none", 1), (None, 2)], "k string, v int")
    right = spark.createDataFrame([("hot", "a"), ("cold", "b")], "k string, n string")
    joined = spread.spread_join(left, right, "k")
    assert joined.count() == 2002 and joined.where("n = 'a'").count() == 2000


def test_streaks_and_churn_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(4000):
        url = "hot" if rnd.random() < 0.5 else f"u{rnd.randint(0, 30)}"
        when = dt.datetime(2026, 1, 1) + dt.timedelta(minutes=rnd.randint(0, 20000))
        ok = rnd.random() < 0.3
        rows.append((url, when, i, ok, None if ok else f"e{i % 5}", f"h{rnd.randint(0, 2)}"))
    df = spark.createDataFrame(rows, "url string, fetched_at timestamp, seq long, ok boolean, error string, hash string")
    state = {r.url: r for r in health.failure_streaks(df).collect()}
    churned = {r.url: r.changes for r in health.churn(df).collect()}
    for url, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1], r[2])), key=lambda r: r[0]):
        group = list(group)
        streak = 0
        for r in group:
            streak = 0 if r[3] else streak + 1
        assert state[url].consecutive_failures == streak
        assert state[url].last_error == (group[-1][4] if streak else None)
        assert churned[url] == sum(a[5] != b[5] for a, b in zip(group, group[1:]))
    assert health.failure_streaks(df).select("state").distinct().count() >= 2


# ---- change, records ------------------------------------------------------------


def snapshot(**over):
    base = dict(
        url="u", org_id="o", content_hash="h", block_hashes=["b"], extracted_chars=100, extraction_method="article",
        first_seen=ts("2026-01-01 00:00:00"), last_changed=ts("2026-01-01 00:00:00"), thin_runs=2, pending=False,
        settled_without_verdict=None, judge_failures=1,
    )
    return tuple({**base, **over}.values())


def reading(**over):
    base = dict(
        url="u", org_id="o", fetched_at=ts(NOW), outcome="ok", hash="h", fresh_hashes=["n"], chars=100,
        method="article", stale_wording=False,
    )
    return tuple({**base, **over}.values())


READING = "url string, org_id string, fetched_at timestamp, outcome string, hash string, fresh_hashes array<string>, chars int, method string, stale_wording boolean"


def test_snapshot_fold_rules(spark):
    prior = spark.createDataFrame([snapshot(url=u) for u in ("same", "moved", "blank", "failed", "away")], schemas.SNAPSHOTS)
    now = spark.createDataFrame(
        [reading(url="same"), reading(url="moved", hash="x"), reading(url="blank", outcome="unreadable", hash="z", chars=3),
         reading(url="failed", outcome="failed", hash=None, chars=None), reading(url="new", hash="y", chars=900),
         reading(url="never", outcome="failed", hash=None, chars=None)], READING)
    rows = {r.url: r for r in diff.fold_snapshots(now, prior).collect()}
    assert set(rows) == {"same", "moved", "blank", "failed", "away", "new"}
    assert rows["same"].thin_runs == 3 and not rows["same"].pending and rows["same"].judge_failures == 1
    assert rows["moved"].pending and rows["moved"].thin_runs == 0 and rows["moved"].judge_failures is None
    assert rows["moved"].last_changed == ts(NOW) and rows["moved"].first_seen == ts("2026-01-01 00:00:00")
    assert rows["blank"].content_hash is None and rows["blank"].extracted_chars == 100
    assert rows["failed"].content_hash == "h" and rows["away"].thin_runs == 2
    assert rows["new"].pending and rows["new"].first_seen == ts(NOW)
    promoted = {r.url: r.block_hashes for r in diff.promote_base(diff.fold_snapshots(now, prior), now).collect()}
    assert promoted["same"] == ["n"] and promoted["moved"] == ["b"] and promoted["new"] == []
    assert diff.prune_departed(prior, now.limit(1), whole_run=False).count() == 5
    assert diff.prune_departed(prior, now.where("url = 'same'"), whole_run=True).count() == 1


def record(**over):
    base = dict(
        id="1", org_id="o", title="برنامج", detected=ts(NOW), first_seen=ts(NOW), last_confirmed=ts(NOW), status="unknown",
        opens=None, closes=None, closes_hijri=None, product="coop", majors=[], seats=None, stipend_sar=None, duration_weeks=None,
        cities=[], score=90, reason="r", states_zero_courses_rule=False, zero_courses_quote=None, flags=[], url="u", apply_url=None, excerpt="",
    )
    return tuple({**base, **over}.values())


def recs(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.RECORDS)


def test_no_record_vanishes_but_by_rule(spark):
    old = recs(spark, record(id="keep", url="k"), record(id="neg", url="n"), record(id="fail", url="f"), record(id="pos", url="p"),
               record(id="bare", url="b", title=L.UNJUDGED_TITLE, score=None, flags=["needs_manual_review"]))
    positive = recs(spark, record(id="pos2", url="p"))
    negative = spark.createDataFrame([("n",)], "url string")
    failed = spark.createDataFrame([("f", "api", "down"), ("b", "parse", "x"), ("g", "api", "y")], "url string, stage string, reason string")
    stand_in = recs(spark, *[record(id=f"ph-{u}", url=u, title=L.UNJUDGED_TITLE, score=None, flags=["needs_manual_review"]) for u in "fbg"])
    rows = {r.id: r for r in records.merge_round(old, positive, negative, failed, stand_in).collect()}
    assert set(rows) == {"keep", "neg", "fail", "pos2", "ph-b", "ph-g"}
    assert rows["neg"].flags == ["vanished_from_source"] and rows["neg"].score == 90
    assert rows["fail"].flags == ["needs_manual_review"] and rows["fail"].score == 90 and L.REASONS["retry_marker"] in rows["fail"].reason
    assert all(r.score is not None or "needs_manual_review" in r.flags for r in rows.values())
    again = records.merge_round(old, positive, negative, failed, stand_in)
    twice = {r.id: r.flags for r in records.merge_round(again, positive, negative, failed, stand_in).collect()}
    assert twice == {k: v.flags for k, v in rows.items()}


def test_announcement_keys_and_collapse(spark):
    day = dt.date(2026, 9, 1)
    rows = recs(spark, record(id="a", url="1", closes=day, score=10), record(id="b", url="2", closes=day, score=95, title="بَرنامج"),
                record(id="c", url="3"), record(id="d", url="4"))
    got = {r.id: (r.lead_id, r.pages) for r in reports.collapse(rows).collect()}
    assert got == {"a": ("b", 2), "b": ("b", 2), "c": ("c", 1), "d": ("d", 1)}


def verdict(**over):
    base = dict(
        isTrainingAnnouncement=True, product="coop", titleAr="برنامج الأمن السيبراني", opensISO=None, closesISO=None, opensRaw=None,
        closesRaw=None, moreOnPage=False, majors=[], seats=None, stipendSAR=None, durationWeeks=None, cities=[],
        statesZeroCoursesRule=False, zeroCoursesQuote=None, applyUrl=None,
    )
    return {**base, **over}


def build(spark, **over):
    df = spark.createDataFrame([(json.dumps(verdict(**over)),)], "v string").select(
        F.from_json("v", judge.VERDICT_TYPE).alias("verdict"), F.lit("o").alias("org_id"), F.lit("https://h.sa/c").alias("url"),
        F.lit("text").alias("text"), F.lit(None).cast("timestamp").alias("prior_detected"), F.lit(None).cast("timestamp").alias("prior_first_seen"),
        F.lit(True).alias("first_time"), F.lit("cyber").alias("field"), F.array(F.lit("الرياض")).alias("reader_cities"),
        F.lit(False).alias("graduated"), F.lit("الأمن السيبراني").alias("field_label"),
    )
    return records.from_verdicts(df, at()).first()


def test_raw_wording_beats_the_models_date(spark):
    row = build(spark, closesISO="2027-03-12", closesRaw="١٤٤٨/٣/١٢")
    assert row.closes == dt.date(2026, 8, 25) and row.closes_hijri.endswith("هـ")
    assert build(spark, closesISO="2027-03-12", closesRaw="بعد أسبوعين").closes is None
    assert build(spark, closesISO="2027-03-12").closes == dt.date(2027, 3, 12)
    backwards = build(spark, opensISO="2025-10-31", closesISO="2025-07-13")
    assert backwards.opens is None and backwards.closes is None and backwards.score is None and "needs_manual_review" in backwards.flags
    graduate = build(spark, product="graduate_dev")
    assert graduate.score == 0 and "wrong_product" in graduate.flags and graduate.status == "unknown"
    nothing = build(spark, titleAr="برنامج")
    assert nothing.score is None and "needs_manual_review" in nothing.flags


def test_relevance_clauses(spark):
    def score(product="coop", title="", majors=(), cities=(), field="cyber", graduated=True):
        df = spark.createDataFrame([(product, title, list(majors), list(cities), field, ["الرياض"], graduated, "L")],
                                   "product string, title string, majors array<string>, cities array<string>, field string, reader_cities array<string>, graduated boolean, field_label string")
        return relevance.score_pairs(df).first()

    assert score(title="أمن سيبراني", cities=["الرياض"]).score == 95
    assert score(title="علوم الحاسب").score == 65 and score(title="تقنية").score == 35
    assert score(title="برنامج", majors=["محاسبة"]).score == 10
    assert score(title="مفتوح لجميع التخصصات").score == 90 and score(title="برنامج").score is None
    assert score(product="graduate_dev", graduated=False, title="أمن سيبراني").score == 0
    unsure = score(product="graduate_dev", graduated=None, title="أمن سيبراني")
    assert unsure.score == 90 and unsure.reason.startswith(L.REASONS["graduate_unknown"])


# ---- notices ------------------------------------------------------------------


def test_decide_kinds(spark):
    soon = dt.date(2026, 8, 25)
    before = recs(spark, record(id="1", status="announced_not_open", seats=9))
    after = recs(
        spark, record(id="1", status="open", opens=dt.date(2026, 8, 24), closes=soon, seats=4),
        record(id="2", url="x", score=None, flags=["needs_manual_review"]), record(id="3", url="y", product="graduate_dev", score=0, flags=["wrong_product"]),
        record(id="4", url="z", first_seen=ts("2026-07-01 00:00:00")),
    )
    names = spark.createDataFrame([("o", "جهة")], "org_id string, name string")
    sick = spark.createDataFrame([(f"s{i}", "o", "broken") for i in range(8)] + [("w", "o", "healthy")], "url string, org_id string, state string")
    well = sick.withColumn("state", F.lit("healthy"))
    said = {r.kind: r for r in notices.decide(before, after, well, sick, names, at()).collect()}
    assert set(said) == {"new_relevant", "opened", "closing_soon", "few_seats", "fit_unknown", "source_broken", "coverage_dropped"}
    assert "8 مصادر" in said["source_broken"].title and said["closing_soon"].weight == 590
    assert said["few_seats"].key.endswith(":4")
    quiet = notices.decide(after, after, well, well, names, at())
    assert {r.kind for r in quiet.collect()} == {"new_relevant", "closing_soon", "fit_unknown"}


def queue(spark, kinds):
    rows = [(1, f"{p}:{i}", k, f"t{i}", "b", float(w), None, ts(NOW)) for i, (p, k, w) in enumerate(kinds)]
    return spark.createDataFrame(rows, schemas.NOTICES)


def test_two_budgets_and_the_night(spark):
    many = queue(spark, [("new", "new_relevant", 200 + i) for i in range(25)] + [("broken", "source_broken", 150 + i) for i in range(9)] + [("closing", "closing_soon", 500)])
    log = spark.createDataFrame([(1, "opened:x", ts("2026-08-24 06:00:00"), None)], schemas.NOTICE_LOG)
    day = {o: n for o, n in ((r.outlet, r["count"]) for r in release.release(many, log, at(), False).groupBy("outlet").count().collect())}
    assert day == {"push": 19 + 6, "digest": 35 - 25}
    night = release.release(many, log, at(), True)
    assert [r.key for r in night.where("outlet = 'push'").collect()] == ["closing:34"] and night.count() == 35


def test_what_was_said_is_not_said_again(spark):
    q = queue(spark, [("new", "new_relevant", 200), ("broken", "source_broken", 150), ("classifier", "classifier_down", 250)])
    q = q.withColumn("key", F.when(F.col("kind") == "classifier_down", "classifier:2026-08-23").otherwise(F.col("key")))

    def left(via):
        log = spark.createDataFrame([(1, "new:0", ts("2026-08-20 06:00:00"), via), (1, "broken:1", ts("2026-08-20 06:00:00"), via)], schemas.NOTICE_LOG)
        return {r.key for r in release.release(q, log, at(), False).where("outlet = 'push'").collect()}

    assert left(None) == set() and left("push") == set()
    assert left("digest") == {"new:0"} and left("toast") == {"new:0", "broken:1"}


def test_log_outlives_the_announce_window():
    assert L.ANNOUNCE_WINDOW_DAYS < L.LOG_RETENTION_DAYS


# ---- due -----------------------------------------------------------------------


def test_one_per_host_and_never_too_soon(spark):
    rows = [
        ("https://a.sa/1", "o", "hot", ts("2026-08-24 08:00:00"), ts("2026-08-24 07:00:00")),
        ("https://a.sa/2", "o", "low", ts("2026-08-24 01:00:00"), ts("2026-08-24 07:00:00")),
        ("https://b.sa/1", "o", "hot", ts("2026-08-24 08:00:00"), ts("2026-08-24 08:55:00")),
        ("https://c.sa/1", "o", "low", ts("2026-08-24 10:00:00"), None), ("bad url", "o", "low", ts("2026-08-24 01:00:00"), None),
    ]
    plan = spark.createDataFrame(rows, schemas.SCHEDULE)
    assert [r.url for r in due.due_now(plan, at()).collect()] == ["https://a.sa/1"]
    targets = plan.where("url <> 'bad url'").select("url", "org_id", F.when(F.col("url").endswith("/2"), "hot").otherwise(F.col("tier")).alias("tier"))
    targets = targets.union(spark.createDataFrame([("https://d.sa/", "o", "low")], "url string, org_id string, tier string"))
    change = {r.url: r.change for r in due.reconcile(plan, targets, at()).collect()}
    assert change["https://a.sa/2"] == "retimed" and change["https://d.sa/"] == "new" and change["https://a.sa/1"] == "unchanged"
    assert [r.url for r in due.departed(plan, targets).collect()] == ["bad url"]


# ---- robots and sitemaps ---------------------------------------------------------


def test_robots(spark):
    body = "User-agent: bad\nUser-agent: watcher/1.0\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nCrawl-delay: 1000\n\nUser-agent: *\nDisallow: /\n"
    files = spark.createDataFrame(
        [("https://r.sa", 200, "text/plain", body), ("https://gone.sa", 404, None, ""), ("https://sick.sa", 503, None, ""),
         ("https://home.sa", 200, "text/html", "<!doctype html><p>hi</p>"), ("https://other.sa", 200, "text/plain", "User-agent: *\nDisallow: /a\nAllow: /a\n")],
        "origin string, status int, content_type string, body string")
    book = robots.rule_book(files, "watcher")
    urls = ["https://r.sa/", "https://r.sa/private/x", "https://r.sa/private/open/y", "https://r.sa/a.pdf", "https://r.sa/a.pdf?x", "https://gone.sa/x", "https://sick.sa/x", "https://home.sa/x", "https://none.sa/x", "https://other.sa/a"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: (r.allowed, r.crawl_delay_ms) for r in robots.permissions(df, book).collect()}
    assert [got[u][0] for u in urls] == [True, False, True, False, True, True, False, True, False, True]
    assert got["https://r.sa/"][1] == 1_000_000 and got["https://gone.sa/x"][1] == 720_000


def test_sitemap_depth_and_outcomes(spark):
    def index(*urls):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"

    files = spark.createDataFrame(
        [("https://a.sa/s", True, False, index("https://a.sa/1")), ("https://a.sa/1", True, False, index("https://a.sa/2")),
         ("https://a.sa/2", True, False, "<urlset><url><loc>https://a.sa/co-op</loc><lastmod>2026-01-01</lastmod></url><url></url></urlset>" ),
         ("https://b.sa/s", True, False, "<html>home</html>"), ("https://c.sa/s", False, False, None), ("https://d.sa/s", True, True, None), ("https://e.sa/s", True, False, "<urlset><url>")],
        "url string, ok boolean, refused boolean, body string")
    roots = spark.createDataFrame([(f"https://{x}.sa", f"https://{x}.sa/s") for x in "abcde"], "origin string, url string")
    entries, outcomes = sitemaps.expand(roots, files)
    assert [(r.loc, r.lastmod) for r in entries.collect()] == [("https://a.sa/co-op", "2026-01-01")]
    assert {r.origin[8]: r.outcome for r in outcomes.collect()} == {"a": "read", "b": "no_sitemap_published", "c": "unreachable", "d": "robots_blocked", "e": "malformed"}


# ---- entities, quality, judging ----------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_names_link_exactly_the_pairs_brute_force_finds(spark):
    rnd = random.Random(11)
    names = ["".join(rnd.choice("abc") for _ in range(rnd.randint(3, 7))) for _ in range(60)]
    orgs = spark.createDataFrame([(f"o{i:02}", n, None) for i, n in enumerate(names)], "org_id string, name string, apply_target string")
    urls = spark.createDataFrame([(f"o{i:02}", f"https://x{i % 3}.com/{i}") for i in range(60)], "org_id string, url string")
    parent = {f"o{i:02}": f"o{i:02}" for i in range(60)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = entities.duplicate_proposals(orgs, urls).collect()
    for r in pairs:
        a, b = int(r.keep_id[1:]), int(r.drop_id[1:])
        assert a % 3 == b % 3 and edits(names[a], names[b]) <= 2
        parent[root(r.keep_id)] = root(r.drop_id)
    for i, j in itertools.combinations(range(60), 2):
        if i % 3 == j % 3 and edits(names[i], names[j]) <= 2:
            assert root(f"o{i:02}") == root(f"o{j:02}")


def test_copies_yield_one_row_each(spark):
    n = 400
    orgs = spark.createDataFrame([(f"o{i:03}", "same name", "hr@x.sa") for i in range(n)], "org_id string, name string, apply_target string")
    urls = spark.createDataFrame([(f"o{i:03}", f"https://x.sa/{i}") for i in range(n)], "org_id string, url string")
    found = entities.duplicate_proposals(orgs, urls)
    assert found.count() == n - 1 and found.select("keep_id").distinct().count() == 1


def test_seeded_faults_give_one_issue_each(spark):
    owners = spark.createDataFrame([("o",)], "org_id string")
    clean = record()
    faults = {
        "unknown_org": record(org_id="ghost"), "missing_flag": record(score=None), "diagnostic_on_card": record(reason="BadRequest"),
        "window_order": record(opens=dt.date(2026, 2, 2), closes=dt.date(2026, 1, 1)), "open_without_dates": record(status="open"),
        "rule_without_quote": record(states_zero_courses_rule=True), "schema": record(status="nonsense"), "fractional_weeks": record(duration_weeks=1.5),
    }
    assert quality.record_issues(recs(spark, clean), owners).count() == 0
    for check, bad in faults.items():
        assert [r.check for r in quality.record_issues(recs(spark, bad), owners).collect()] == [check]
    ambiguous = recs(spark, record(flags=["date_order_ambiguous"]))
    assert quality.record_issues(ambiguous, owners).count() == 0


def test_judge_retries_once_and_a_failure_is_a_row(spark):
    asked = []

    def ask(excerpts, insist):
        out = []
        for e in excerpts:
            good = json.dumps(verdict(titleAr=e, majors=[]), ensure_ascii=False)
            out.append({"good": good, "fenced": f"```json\n{good}\n```", "late": good if insist else "sorry", "never": "sorry", "silent": None,
                        "liar": json.dumps(verdict(titleAr="invented words")), "short": '{"product": "coop"}'}[e])
        return out

    pages = spark.createDataFrame([(w, w) for w in ("good", "fenced", "late", "never", "silent", "liar", "short")], "fingerprint string, payload string")
    got = {r.fingerprint: r for r in judge.judge_pages(pages, ask).collect()}
    assert len(got) == 7 and not asked
    assert [got[k].ok for k in ("good", "fenced", "late")] == [True] * 3 and got["late"].attempts == 2 and got["good"].attempts == 1
    assert [got[k].stage for k in ("never", "silent", "liar", "short")] == ["parse", "api", "schema", "schema"]
    assert {r.stage for r in judge.judge_pages(pages, None).collect()} == {"no_credentials"}

    def broken(excerpts, insist):
        raise RuntimeError("down")

    assert {r.stage for r in judge.judge_pages(pages, broken).collect()} == {"api"}


def test_memory_rules(spark):
    v = json.dumps(verdict(titleAr="printed words"))
    memory = spark.createDataFrame([("a", v, "m"), ("b", None, "m"), ("c", json.dumps(verdict(titleAr="zzz unseen")), "m"), ("d", v, "old")], "fingerprint string, v string, model string").select(
        "fingerprint", F.from_json("v", judge.VERDICT_TYPE).alias("verdict"), "model", at().alias("written_at"))
    pages = spark.createDataFrame([(x, "the printed words of a page") for x in "abcd"], "fingerprint string, payload string")
    looked = routing.remember(pages, routing.usable_memory(memory, "m"))
    assert {r.fingerprint: r.remembered for r in looked.collect()} == {"a": "hit", "b": "no", "c": "poisoned", "d": "miss"}
    assert {r.fingerprint for r in routing.evict(memory, looked).collect()} == {"a", "b", "d"}
    assert routing.bound_memory(memory, 2).count() == 2


def test_versions_and_admission(spark, tmp_path):
    path = str(tmp_path / "t")
    for run, n in (("r1", 3), ("r2", 5)):
        tables.publish(spark.range(n), path, run)
    assert tables.read_version(spark, path, "r1", "id long").count() == 3
    versions = spark.read.parquet(path)
    assert tables.previous_version(versions, "r2").count() == 3 and tables.previous_version(versions, "r1").count() == 0
    change = tables.change_summary(spark.range(3), spark.range(1, 5)).first()
    assert (change.added, change.removed) == (2, 1)
    file = tmp_path / "a.json"
    file.write_bytes(b"\xef\xbb\xbf" + json.dumps([{"id": 1}, {"id": 2}]).encode())
    assert tables.read_json_array(spark, str(file), "id long").count() == 2
