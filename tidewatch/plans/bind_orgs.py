"""Operators over organisations: customers stand for organisations, nations for cities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import entities, health, quality, reports
from tidewatch.operators.links import bound_attempts
from tidewatch.plans.bind_events import as_of, AS_OF
from tidewatch.plans.registry import query, table
from tidewatch.sources import tables


def orgs(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    bal = F.col("c_acctbal")
    seg = F.col("c_mktsegment")
    return c.select(
        F.col("c_custkey").alias("org_id"), F.col("c_name").alias("name"), F.col("c_name").alias("name_en"),
        F.when(seg == "BUILDING", "gov").when(seg == "MACHINERY", "industrial").when(seg == "FURNITURE", "finance")
        .when(seg == "AUTOMOBILE", "tech").otherwise("bank").alias("sector"),
        F.when(bal < 0, "C").when(bal < 3000, "B").when(bal < 6000, "A").otherwise("S").alias("tier"),
        F.when(F.col("n_regionkey") == 0, F.array().cast("array<string>")).otherwise(F.array("n_name")).alias("cities"),
        F.when(bal < 1000, False).when(bal < 2000, True).alias("requires_zero_courses"),
        F.when(bal > 5000, bal).alias("stipend_sar"),
        F.when(bal > 4000, True).alias("accepts_major"),
        "c_nationkey",
    )


ORGS = """orgs AS (SELECT c_custkey AS org_id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'gov' WHEN 'MACHINERY' THEN 'industrial' WHEN 'FURNITURE' THEN 'finance' WHEN 'AUTOMOBILE' THEN 'tech' ELSE 'bank' END AS sector,
  CASE WHEN c_acctbal < 0 THEN 'C' WHEN c_acctbal < 3000 THEN 'B' WHEN c_acctbal < 6000 THEN 'A' ELSE 'S' END AS tier,
  CASE WHEN n_regionkey = 0 THEN NULL ELSE n_name END AS city, CASE WHEN c_acctbal < 1000 THEN false WHEN c_acctbal < 2000 THEN true END AS zero,
  CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS stipend, c_acctbal > 4000 AS accepts, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query("facet_search", f"""
WITH {ORGS} SELECT org_id, tier FROM orgs WHERE sector = 'tech' AND contains(lower(name), 'customer#') AND city = 'NATION_7' AND stipend > 0 AND accepts""")
def facet_search(spark, sf):
    found = reports.facet_search(
        orgs(spark, sf), sector="tech", query="customer#", city="NATION_7", with_stipend=True, accepts_major=True
    )
    return found.select("org_id", "tier")


@query("facet_counts", f"""
WITH {ORGS} SELECT 'sector' AS facet, sector AS value, count(*) AS orgs FROM orgs GROUP BY ALL
UNION ALL SELECT 'tier', tier, count(*) FROM orgs GROUP BY ALL
UNION ALL SELECT CASE WHEN city IS NULL THEN 'no_city' ELSE 'city' END, coalesce(city, ''), count(*) FROM orgs GROUP BY ALL
UNION ALL SELECT 'chip', 'no_zero_courses', count(*) FROM orgs WHERE zero = false
UNION ALL SELECT 'chip', 'stipend', count(*) FROM orgs WHERE stipend > 0
UNION ALL SELECT 'chip', 'accepts_major', count(*) FROM orgs WHERE accepts""")
def facet_counts(spark, sf):
    return reports.facet_counts(orgs(spark, sf))


@query("coverage_report", f"""
WITH {ORGS} SELECT tier, sector AS origin, count(*) AS orgs, count(*) FILTER (WHERE c_nationkey > 5) AS has_verified_source, count(*) FILTER (WHERE stipend IS NOT NULL) AS stipend_known,
 CAST(round(count(*) FILTER (WHERE c_nationkey > 5) * 100 / count(*)) AS INTEGER) AS verified_percent FROM orgs GROUP BY ALL""")
def coverage_report(spark, sf):
    k = F.col("c_nationkey")
    facts = orgs(spark, sf).select(
        "org_id", "tier", F.col("sector").alias("origin"), (k > 5).alias("has_verified_source"),
        (k <= 5).alias("has_lead"), (k > 8).alias("has_manual_check"), (k > 3).alias("has_channel"),
        F.col("requires_zero_courses").isNotNull().alias("rule_known"), F.col("accepts_major").isNotNull().alias("major_known"),
        (k > 10).alias("product_known"), F.col("stipend_sar").isNotNull().alias("stipend_known"), (k > 20).alias("has_windows"),
    )
    return reports.coverage_report(facts).select(
        "tier", "origin", "orgs", "has_verified_source", "stipend_known", "verified_percent"
    )


@query("work_queue", f"""
WITH {ORGS} SELECT org_id, tier, sector, CASE WHEN c_nationkey % 3 > 0 THEN 'lead' WHEN c_nationkey % 2 = 0 THEN 'email' ELSE 'nothing' END AS held FROM orgs WHERE c_nationkey <= 8
ORDER BY CASE tier WHEN 'S' THEN 1 WHEN 'A' THEN 2 WHEN 'B' THEN 3 ELSE 4 END, CASE sector WHEN 'tech' THEN 1 WHEN 'gov' THEN 2 WHEN 'industrial' THEN 4 WHEN 'bank' THEN 6 ELSE 0 END, org_id LIMIT 10""")
def work_queue(spark, sf):
    k = F.col("c_nationkey")
    return reports.work_queue(
        orgs(spark, sf).withColumn("has_manual_check", k > 8).withColumn("n_sources", k % 3).withColumn("has_channel", k % 2 == 0)
    )


def org_sources(spark, sf):
    """Suppliers' parts as sources: an organisation per supplier, its parts on the domain of their brand."""
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    brand = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.regexp_extract("p_brand", "([0-9]+)", 1).alias("b"), "p_size")
    return li.join(brand, "l_partkey").select(
        F.concat(F.lit("brand"), F.col("l_suppkey").cast("string")).alias("org_id"),
        F.concat(F.lit("https://www.brand"), "b", F.lit(".com.sa/p/"), F.col("l_partkey").cast("string")).alias("url"),
        (F.col("p_size") > 48).alias("verified"),
    )


SOURCES = """src AS (SELECT DISTINCT 'brand' || l_suppkey AS org_id, 'brand' || regexp_extract(p_brand, '([0-9]+)', 1) || '.com.sa' AS domain, l_partkey AS part, p_size > 48 AS verified
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("domain_owners", f"WITH {SOURCES} SELECT domain, org_id, count(*) AS on_it FROM src GROUP BY ALL")
def domain_owners(spark, sf):
    return entities.domain_owners(org_sources(spark, sf))


@query("native_owners", f"""
WITH {SOURCES}, o AS (SELECT DISTINCT domain, org_id, replace(domain, '.com.sa', '') AS stem FROM src)
SELECT domain, min_by(org_id, (CASE WHEN org_id = stem THEN 0 ELSE 1 END, org_id)) AS native FROM o WHERE contains(stem, org_id) OR contains(org_id, stem) GROUP BY domain""")
def native_owners(spark, sf):
    return entities.native_owner(entities.domain_owners(org_sources(spark, sf)))


def narrow_sources(spark, sf):
    """The same sources with one verified domain for most suppliers."""
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    own = s.select(
        F.concat(F.lit("n"), F.col("s_suppkey").cast("string")).alias("org_id"),
        F.concat(F.lit("https://n"), F.col("s_nationkey").cast("string"), F.lit(".org.sa/"), k.cast("string")).alias("url"),
        F.lit(True).alias("verified"),
    )
    rich = s.where("s_acctbal > 5000").select(
        F.concat(F.lit("n"), k.cast("string")).alias("org_id"),
        F.concat(F.lit("https://n"), F.col("s_nationkey").cast("string"), F.lit(".org.sa/more/"), k.cast("string")).alias("url"),
        (F.col("s_acctbal") > 7000).alias("verified"),
    )
    return own.unionByName(rich)


@query("wrong_domain", """
WITH s AS (SELECT 'n' || s_suppkey AS org_id, 'n' || s_nationkey || '.org.sa' AS domain, true AS verified FROM supplier
  UNION ALL SELECT 'n' || s_suppkey, 'n' || s_nationkey || '.org.sa', s_acctbal > 7000 FROM supplier WHERE s_acctbal > 5000),
o AS (SELECT domain, org_id, count(*) AS mine, count(*) FILTER (WHERE verified) AS own FROM s GROUP BY ALL),
nat AS (SELECT domain, min_by(org_id, (CASE WHEN org_id = stem THEN 0 ELSE 1 END, org_id)) AS native FROM (SELECT *, replace(domain, '.org.sa', '') AS stem FROM o) WHERE contains(stem, org_id) OR contains(org_id, stem) GROUP BY domain)
SELECT a.org_id, a.domain, a.own AS on_it, n.native, count(*) AS others FROM o a LEFT JOIN nat n USING (domain) JOIN o b ON b.domain = a.domain AND b.org_id <> a.org_id AND (b.org_id = n.native OR b.mine >= a.own)
WHERE a.own > 0 AND (n.native IS NULL OR n.native <> a.org_id) GROUP BY ALL""")
def wrong_domain(spark, sf):
    return entities.wrong_domain(narrow_sources(spark, sf))


_NAMED = "p_name || ' ' || p_partkey"


@query("duplicate_entities", f"""
WITH o AS (SELECT CAST(p_partkey AS VARCHAR) AS org_id, {_NAMED} AS name, lower(p_type) || p_size || '.example' AS mail,
  replace(lower(p_brand), '#', '') || '.com' AS domain FROM part),
u AS (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS org_id, 'https://' || o.domain || '/' || l_suppkey || '/' || strftime(l_shipdate, '%Y-%m') AS url
  FROM lineitem JOIN o ON o.org_id = CAST(l_partkey AS VARCHAR)),
n AS (SELECT o.*, coalesce(c, 0) AS n_sources, row_number() OVER (ORDER BY coalesce(c, 0) DESC, o.org_id) AS r
  FROM o LEFT JOIN (SELECT org_id, count(*) AS c FROM u GROUP BY org_id) USING (org_id)),
d AS (SELECT * FROM n WHERE n_sources > 0),
g AS (SELECT 'domain+mail' AS reason, 'd' || domain || ' ' || mail AS g, org_id, r FROM d
  UNION ALL SELECT 'block+name', 'domain ' || domain || ' ' || name, org_id, r FROM d UNION ALL SELECT 'block+name', 'mail ' || mail || ' ' || name, org_id, r FROM n),
star AS (SELECT reason, first_value(org_id) OVER w AS keep_id, org_id AS drop_id, row_number() OVER w AS k FROM g WINDOW w AS (PARTITION BY reason, g ORDER BY r)),
blk AS (SELECT 'domain ' || domain AS b, name, org_id, r FROM d UNION ALL SELECT 'mail ' || mail, name, org_id, r FROM n),
near AS (SELECT a.org_id AS keep_id, z.org_id AS drop_id FROM blk a JOIN blk z ON a.b = z.b AND a.r < z.r AND a.name <> z.name
  AND abs(length(a.name) - length(z.name)) <= 2 AND levenshtein(a.name, z.name) <= 2),
several AS (SELECT url FROM u GROUP BY url HAVING count(*) > 1),
su AS (SELECT org_id, url FROM u JOIN several USING (url)),
cls AS (SELECT org_id, list_sort(list(url)) AS urls FROM su GROUP BY org_id HAVING count(*) >= 2),
rep AS (SELECT urls, arg_min(org_id, r) AS keep_id, min(r) AS r FROM cls JOIN n USING (org_id) GROUP BY urls),
cp AS (SELECT rep.keep_id, cls.org_id AS drop_id FROM cls JOIN rep USING (urls) WHERE cls.org_id <> rep.keep_id),
pr AS (SELECT a.org_id AS x, z.org_id AS y FROM su a JOIN su z ON a.url = z.url AND a.org_id <> z.org_id GROUP BY a.org_id, z.org_id HAVING count(*) >= 2),
sh AS (SELECT a.keep_id, z.keep_id AS drop_id FROM pr JOIN rep a ON a.keep_id = pr.x JOIN rep z ON z.keep_id = pr.y WHERE a.r < z.r),
al AS (SELECT keep_id, drop_id, reason FROM star WHERE k > 1 UNION SELECT keep_id, drop_id, 'block+name' FROM near
  UNION SELECT keep_id, drop_id, 'urls' FROM cp UNION SELECT keep_id, drop_id, 'urls' FROM sh)
SELECT keep_id, drop_id, array_to_string(list_sort(list(reason)), ',') AS reasons FROM al GROUP BY keep_id, drop_id""")
def duplicate_entities(spark, sf):
    """Parts as organisations: brand is the domain, type and size the mail domain, urls by supplier and month of their order lines."""
    p = table(spark, sf, "part")
    listed = p.select(
        F.col("p_partkey").cast("string").alias("org_id"), F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"),
        F.concat(F.lit("hr@"), F.lower("p_type"), F.col("p_size").cast("string"), F.lit(".example")).alias("apply_target"),
    )
    site = p.select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("https://"), F.regexp_replace(F.lower("p_brand"), "#", ""), F.lit(".com/")).alias("site"))
    lines = table(spark, sf, "lineitem").join(site, "l_partkey")
    urls = lines.select(
        F.col("l_partkey").cast("string").alias("org_id"),
        F.concat("site", F.col("l_suppkey").cast("string"), F.lit("/"), F.date_format("l_shipdate", "yyyy-MM")).alias("url"),
    )
    found = entities.duplicate_proposals(listed, urls)
    return found.select("keep_id", "drop_id", F.array_join("reasons", ",").alias("reasons"))


# ---- attempts, detail, screens ------------------------------------------------------


def attempts(spark, sf):
    e = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("target_id"), F.col("ts").alias("checked_at"),
        F.when(e != "signup", F.col("event_id").cast("string")).alias("url_tried"),
        F.when(e == "error", "unreachable").when(e == "view", "rejected").when(e == "signup", "not_found").otherwise("verified").alias("outcome"),
        "event_id",
    )


@query("bounded_attempts", """
SELECT target_id, checked_at FROM (SELECT CAST(user_id AS VARCHAR) AS target_id, epoch_us(ts) AS checked_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 12""")
def bounded_attempts(spark, sf):
    return bound_attempts(attempts(spark, sf)).select("target_id", F.unix_micros("checked_at").alias("checked_at"))


@query("verification_rounds", """
SELECT count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS verified, count(*) FILTER (WHERE event_type = 'view') AS rejected,
 count(*) FILTER (WHERE event_type = 'signup') AS not_found, count(*) FILTER (WHERE event_type = 'error') AS unreachable,
 (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)) AS untouched FROM events""")
def verification_rounds(spark, sf):
    targets = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("target_id"))
    return reports.verification_rounds(attempts(spark, sf), targets)


@query("attempt_issues", f"""
SELECT 'attempt_shape' AS "check", count(*) AS n FROM events WHERE event_type = 'error' AND value > 100
UNION ALL SELECT 'attempt_future', count(*) FROM events WHERE ts > TIMESTAMP '2024-01-30 12:00:00'""")
def attempt_issues(spark, sf):
    rows = attempts(spark, sf).join(table(spark, sf, "events").select("event_id", "value"), "event_id").withColumn(
        "url_tried", F.when(~((F.col("outcome") == "unreachable") & (F.col("value") > 100)), F.col("url_tried"))
    )
    found = quality.attempt_issues(rows, F.lit("2024-01-30 12:00:00").cast("timestamp"))
    return found.groupBy("check").agg(F.count("*").alias("n"))


def detail_sources(spark, sf):
    s = table(spark, sf, "supplier")
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("l_suppkey").alias("org_id"), F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("url"),
        F.when(F.col("s_acctbal") < 2000, "site_root").otherwise("careers_page").alias("type"),
        F.when(F.col("l_partkey") < 100, True).alias("coop_confirmed"),
    )


def detail_health(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.groupBy(F.concat_ws("/", F.col("l_suppkey").cast("string"), F.col("l_partkey").cast("string")).alias("url")).agg(
        F.max(F.when(F.col("l_linestatus") == "F", F.col("l_shipdate"))).alias("last_success"),
        F.max("l_shipdate").alias("last_attempt"),
        F.when((F.max("l_quantity") > 40) & (F.max("l_suppkey") % 3 == 0), "broken")
        .when((F.max("l_quantity") > 20) & (F.max("l_suppkey") % 3 == 1), "degraded").otherwise("healthy").alias("state"),
    )


DETAIL = """s AS (SELECT DISTINCT l_suppkey AS org_id, l_suppkey || '/' || l_partkey AS url, CASE WHEN s_acctbal < 2000 THEN 'site_root' ELSE 'careers_page' END AS type, l_partkey < 100 AS conf FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
h AS (SELECT l_suppkey || '/' || l_partkey AS url, max(l_shipdate) FILTER (WHERE l_linestatus = 'F') AS last_success, max(l_shipdate) AS last_attempt,
  CASE WHEN max(l_quantity) > 40 AND max(l_suppkey) % 3 = 0 THEN 'broken' WHEN max(l_quantity) > 20 AND max(l_suppkey) % 3 = 1 THEN 'degraded' ELSE 'healthy' END AS state FROM lineitem GROUP BY 1)"""


def supplier_orgs(spark, sf):
    bal = F.col("s_acctbal")
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("org_id"), F.col("s_name").alias("name"), F.when(bal > 5000, "S").otherwise("B").alias("tier"),
        F.when(bal < 1000, True).when(bal < 3000, False).alias("rule"), F.when(bal < 1000, "no courses at all").alias("rule_quote"),
        F.lit(0).alias("past_windows"), F.when(bal > 3000, "email").otherwise("web").alias("method"),
        F.when(F.col("s_nationkey") > 12, "Careers@x.example").otherwise("info@x.example").alias("target"),
    )


def supplier_records(spark, sf):
    o = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("date")
    suppliers = table(spark, sf, "supplier")
    many = suppliers.agg(F.max("s_suppkey") + 1).scalar()
    return o.join(suppliers, F.pmod(F.col("o_custkey"), many) == F.col("s_suppkey")).select(
        F.col("s_suppkey").alias("org_id"), F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("id"),
        (F.col("o_totalprice") > 200000).alias("states_zero_courses_rule"), F.lit("full time only").alias("zero_courses_quote"),
        F.when(F.col("o_totalprice") > 300000, "open").otherwise("closed").alias("status"),
        day.alias("opens"), F.when(F.col("o_totalprice") > 100000, F.date_add(day, 40)).alias("closes"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.lit(70)).alias("score"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("needs_manual_review"))).otherwise(F.array().cast("array<string>")).alias("flags"),
    )


SREC = """r AS (SELECT s_suppkey AS org_id, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS id, o_totalprice > 200000 AS states, CASE WHEN o_totalprice > 300000 THEN 'open' ELSE 'closed' END AS status,
  CAST(o_orderdate AS DATE) AS opens, CASE WHEN o_totalprice > 100000 THEN CAST(o_orderdate AS DATE) + 40 END AS closes, CASE WHEN o_orderpriority <> '5-LOW' THEN 70 END AS score FROM orders JOIN supplier ON o_custkey % (SELECT max(s_suppkey) + 1 FROM supplier) = s_suppkey),
f AS (SELECT org_id, min(id) AS id, arg_min(states, id) AS states, arg_min(status, id) AS status, arg_min(opens, id) AS opens, arg_min(struct_pack(c := closes), id).c AS closes FROM r GROUP BY org_id)"""


@query("organisation_detail", f"""
WITH {DETAIL}, {SREC}, w AS (SELECT org_id, count(*) AS watched, count(*) FILTER (WHERE last_success IS NOT NULL) AS rd, max(last_success) AS newest, bool_or(conf) AS confirmed, bool_and(type = 'site_root') AS home FROM s LEFT JOIN h USING (url) GROUP BY org_id)
SELECT s_suppkey AS org_id, CASE WHEN s_acctbal < 1000 THEN 'no courses at all' WHEN f.states THEN 'full time only' END AS quote, coalesce(watched, 0) AS watched, coalesce(rd, 0) AS "read",
 epoch_us(newest) AS newest_success, coalesce(confirmed, false) AS confirmed, coalesce(home, false) AS homepage_only FROM supplier LEFT JOIN w ON w.org_id = s_suppkey LEFT JOIN f ON f.org_id = s_suppkey""")
def organisation_detail(spark, sf):
    shown = reports.organisation_detail(
        supplier_orgs(spark, sf), detail_sources(spark, sf), detail_health(spark, sf), supplier_records(spark, sf)
    )
    return shown.select(
        "org_id", "quote", "watched", "read", F.unix_micros("newest_success").alias("newest_success"), "confirmed", "homepage_only"
    )


LANES = f"""{DETAIL}, {SREC}, oh AS (SELECT org_id, max(CASE state WHEN 'healthy' THEN 0 WHEN 'degraded' THEN 1 WHEN 'broken' THEN 2 END) AS w FROM s LEFT JOIN h USING (url) GROUP BY org_id),
l AS (SELECT s_suppkey AS org_id, f.id, f.status, f.opens, f.closes, CASE WHEN w = 0 THEN 'healthy' WHEN w = 1 THEN 'degraded' WHEN w = 2 THEN 'broken' ELSE 'unwatched' END AS health,
  s_acctbal > 3000 AND s_nationkey > 12 AND f.id IS NULL AS rolling FROM supplier LEFT JOIN f ON f.org_id = s_suppkey LEFT JOIN oh ON oh.org_id = s_suppkey)"""


def lanes(spark, sf):
    states = health.org_health(detail_sources(spark, sf), detail_health(spark, sf))
    return reports.season_lanes(
        supplier_orgs(spark, sf), supplier_records(spark, sf), states, F.lit("1998-10-10 09:00:00").cast("timestamp")
    )


@query("season_lanes", f"""
WITH {LANES} SELECT org_id, health, rolling, CAST(CASE WHEN status = 'open' THEN 1 WHEN rolling THEN 3 WHEN health IN ('broken', 'degraded') THEN 5 ELSE 4 END AS INTEGER) AS rank,
 rolling OR opens IS NOT NULL OR closes IS NOT NULL AS shown, round(CASE WHEN opens IS NOT NULL THEN greatest(0.0, least(1.0, (epoch_us(CAST(opens AS TIMESTAMP)) - 10800000000 - epoch_us(TIMESTAMP '1998-09-01')) / 86400000000.0 / 181)) END, 6) AS from_pos FROM l""")
def season_lanes(spark, sf):
    return lanes(spark, sf).select("org_id", "health", "rolling", "rank", "shown", F.round("from_pos", 6).alias("from_pos"))


@query("lane_summary", f"""
WITH {LANES}, m AS (SELECT *, rolling OR opens IS NOT NULL OR closes IS NOT NULL AS shown, health IN ('unwatched', 'broken') AS unread FROM l)
SELECT count(*) AS lanes, count(*) FILTER (WHERE shown) AS shown, count(*) FILTER (WHERE NOT shown) AS hidden, count(*) FILTER (WHERE NOT shown AND unread) AS hidden_unreadable,
 count(*) FILTER (WHERE id IS NULL AND NOT unread) AS silent, count(*) FILTER (WHERE unread) AS unread FROM m""")
def lane_summary(spark, sf):
    return reports.lane_summary(lanes(spark, sf))


@query("silent_and_unread", f"""
WITH {LANES} SELECT org_id, CASE WHEN health IN ('unwatched', 'broken') THEN 'unread' WHEN id IS NULL THEN 'silent' ELSE 'announcing' END AS standing FROM l""")
def silent_and_unread(spark, sf):
    states = health.org_health(detail_sources(spark, sf), detail_health(spark, sf))
    return reports.silent_and_unread(supplier_orgs(spark, sf), states, supplier_records(spark, sf))


@query("honesty_line", f"""
WITH {DETAIL}, {SREC}, o AS (SELECT org_id, count(*) AS c, count(*) FILTER (WHERE last_success IS NOT NULL) AS rd, bool_and(type = 'site_root') AS home FROM s LEFT JOIN h USING (url) GROUP BY org_id)
SELECT CAST(sum(c) AS BIGINT) AS total, CAST(sum(rd) AS BIGINT) AS "read", count(*) FILTER (WHERE rd = 0) AS orgs_unread, count(*) FILTER (WHERE rd > 0 AND home) AS orgs_homepage_only,
 (SELECT count(*) FROM h WHERE state <> 'healthy') AS needs_hand_check, (SELECT count(*) FROM r WHERE score IS NULL) AS unjudged,
 (SELECT count(DISTINCT s.org_id) FROM h JOIN s USING (url) JOIN supplier ON s.org_id = s_suppkey WHERE state <> 'healthy' AND s_acctbal > 5000) AS top_tier_orgs_blocked FROM o""")
def honesty_line(spark, sf):
    line = reports.honesty(
        supplier_orgs(spark, sf), detail_sources(spark, sf), detail_health(spark, sf), supplier_records(spark, sf), as_of()
    )
    return line.select(
        "total", "read", "orgs_unread", "orgs_homepage_only", "needs_hand_check", "unjudged", "top_tier_orgs_blocked"
    )


@query("status_screen", f"""
WITH {DETAIL}, {SREC}, o AS (SELECT org_id, count(*) AS c, count(*) FILTER (WHERE last_success IS NOT NULL) AS rd FROM s LEFT JOIN h USING (url) GROUP BY org_id)
SELECT 'see' AS section, 'total' AS measure, CAST(sum(c) AS DOUBLE) AS value FROM o UNION ALL SELECT 'see', 'read', CAST(sum(rd) AS DOUBLE) FROM o
UNION ALL SELECT 'see', 'orgs_unread', CAST(count(*) FILTER (WHERE rd = 0) AS DOUBLE) FROM o
UNION ALL SELECT 'see', 'hours_since_check', round((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(last_attempt))) / 3600000000.0, 6) FROM h
UNION ALL SELECT 'judge', 'judged', CAST(count(score) AS DOUBLE) FROM r UNION ALL SELECT 'judge', 'in_review', CAST(count(*) FILTER (WHERE score IS NULL) AS DOUBLE) FROM r
UNION ALL SELECT 'judge', 'open_now', CAST(count(*) FILTER (WHERE status = 'open') AS DOUBLE) FROM r
UNION ALL SELECT 'judge', 'queued', CAST(count(*) FILTER (WHERE state = 'broken') AS DOUBLE) FROM h UNION ALL SELECT 'judge', 'settled', CAST(count(*) FILTER (WHERE state = 'healthy') AS DOUBLE) FROM h
UNION ALL SELECT 'judge', 'no_training_word', CAST(count(*) FILTER (WHERE state = 'healthy') AS DOUBLE) FROM h UNION ALL SELECT 'reach', 'held', CAST(count(*) AS DOUBLE) FROM r""")
def status_screen(spark, sf):
    h = detail_health(spark, sf)
    snaps = h.select(
        (F.col("state") == "broken").alias("pending"),
        F.when(F.col("state") == "healthy", "no_training_word").alias("settled_without_verdict"),
    )
    screen = reports.status_screen(
        detail_sources(spark, sf), h, supplier_records(spark, sf), snaps, supplier_records(spark, sf), as_of()
    )
    return screen.withColumn("value", F.round("value", 6))


@query("unwatchable_reasons", """
WITH n AS (SELECT c_nationkey AS org_id, CASE WHEN c_mktsegment = 'BUILDING' AND c_acctbal < -900 THEN 'disallowed by robots.txt' WHEN c_acctbal < 0 THEN 'HTTP 403' ELSE 'fine' END AS note FROM customer)
SELECT org_id, CASE WHEN bool_or(note = 'disallowed by robots.txt') THEN 'موقعها يمنع القراءة الآلية في ملف robots.txt، ويسمح لمحرّكات البحث وحدها. هذا منع دائم، ونحن نحترمه.'
 WHEN bool_or(note = 'HTTP 403') THEN 'خادمها يرفض طلباتنا (403) حتى من متصفّح حقيقي.' ELSE 'جُرِّبت روابطها ولم يُقرأ منها نصّ.' END AS why FROM n GROUP BY org_id""")
def unwatchable_reasons(spark, sf):
    bal = F.col("c_acctbal")
    notes = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("org_id"), F.col("c_name").alias("url"),
        F.when((F.col("c_mktsegment") == "BUILDING") & (bal < -900), "disallowed by robots.txt").when(bal < 0, "HTTP 403").otherwise("fine").alias("note"),
    )
    return health.unwatchable(notes)


def nested_orgs(spark, sf):
    """Organisations in their nested shape, with two sources and an application channel each."""
    bal = F.col("c_acctbal")
    s = F.lit(None).cast("string")
    key = F.col("c_custkey").cast("string")
    seen = F.when(bal > 0, "2024-01-01T00:00:00Z")
    note = F.when(bal > 8000, "short").otherwise('عنوان الصفحة: "برنامج التدريب التعاوني"، وقُرئ منها نصّ طويل عن التدريب والتقديم')
    src = F.struct(
        F.concat(F.lit("https://c"), key, F.lit(".example.org/")).alias("url"),
        F.when(bal > 0, "official").otherwise("reported").alias("provenance"), seen.alias("verifiedAtISO"), note.alias("verifiedNote"),
        F.lit(None).cast("boolean").alias("coopConfirmed"), F.lit("site_root").alias("type"), F.lit(6).alias("checkFrequencyHours"),
        F.when(bal > 9990, "browser").otherwise("static").alias("renderMode"), F.lit(False).alias("browserRetryInCI"), s.alias("renderModeNote"),
    )
    return table(spark, sf, "customer").select(
        key.alias("id"), F.col("c_name").alias("nameAr"), F.col("c_name").alias("nameEn"), F.lit("gov").alias("sector"),
        F.array().cast("array<string>").alias("city"), F.when(bal < -990, "Z").otherwise("A").alias("tier"),
        F.struct(F.when(bal < 500, True).alias("value"), F.when(bal < 500, "reported").otherwise("unknown").alias("provenance"), F.when(bal < 0, "q").alias("quote"), s.alias("sourceUrl")).alias("requiresZeroCourses"),
        F.struct(F.when(bal > 9000, bal).alias("amountSAR"), F.lit("unknown").alias("provenance"), s.alias("note")).alias("stipend"),
        F.when(bal > 9500, F.array(src, src)).otherwise(F.array(src)).alias("sources"),
        F.when(
            bal > 1000,
            F.struct(F.lit("email").alias("method"), F.when(bal > 6000, "not an address").otherwise("hr@x.example").alias("target"), F.lit("email_channel").alias("provenance"), s.alias("verifiedAtISO"), s.alias("note")),
        ).alias("applyVia"),
        F.lit(None).cast("struct<url:string,provenance:string,verifiedAtISO:string,verifiedNote:string>").alias("manualCheckUrl"),
        F.array().cast("array<struct<seasonLabel:string,openedISO:string,closedISO:string,provenance:string>>").alias("historicalWindows"),
    )


@query("organisation_issues", """
SELECT 'error' AS severity, 'schema' AS "check", count(*) AS n FROM customer WHERE c_acctbal < -990 HAVING count(*) > 0
UNION ALL SELECT 'error', 'rule_without_quote', count(*) FROM customer WHERE c_acctbal < 500 AND c_acctbal >= 0 HAVING count(*) > 0
UNION ALL SELECT 'error', 'provenance_mismatch', count(*) FROM customer WHERE c_acctbal > 9000 HAVING count(*) > 0
UNION ALL SELECT 'error', 'duplicate_source', count(*) FROM customer WHERE c_acctbal > 9500 HAVING count(*) > 0
UNION ALL SELECT 'error', 'apply_target', count(*) FROM customer WHERE c_acctbal > 6000 HAVING count(*) > 0
UNION ALL SELECT 'error', 'link_note_thin', CAST(sum(CASE WHEN c_acctbal > 9500 THEN 2 ELSE 1 END) AS BIGINT) FROM customer WHERE c_acctbal > 8000 HAVING count(*) > 0
UNION ALL SELECT 'warning', 'no_apply_channel', count(*) FROM customer WHERE c_acctbal <= 1000 HAVING count(*) > 0
UNION ALL SELECT 'warning', 'no_manual_check_url', count(*) FROM customer HAVING count(*) > 0
UNION ALL SELECT 'warning', 'unopened_source', count(*) FROM customer WHERE c_acctbal <= 0 HAVING count(*) > 0""")
def organisation_issues(spark, sf):
    found = quality.organisation_issues(nested_orgs(spark, sf), as_of())
    return found.groupBy("severity", "check").agg(F.count("*").alias("n"))


@query("watched_targets", """
SELECT CAST(c_custkey AS VARCHAR) AS owner_id, 'https://c' || c_custkey || '.example.org/' AS url, count(*) AS n FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 9500) GROUP BY ALL
UNION ALL SELECT 'agg' || s_suppkey, 'https://agg' || s_suppkey || '.example', 1 FROM supplier WHERE s_acctbal > 0""")
def watched_targets(spark, sf):
    link = F.struct(
        F.concat(F.lit("https://agg"), F.col("s_suppkey").cast("string"), F.lit(".example")).alias("url"), F.lit("official").alias("provenance"),
        F.when(F.col("s_acctbal") > 0, "2024-01-01").alias("verifiedAtISO"), F.lit("n").alias("verifiedNote"),
    )
    others = table(spark, sf, "supplier").select(F.concat(F.lit("agg"), F.col("s_suppkey").cast("string")).alias("id"), link.alias("link"))
    found = tables.targets(nested_orgs(spark, sf), others)
    return found.groupBy("owner_id", "url").agg(F.count("*").alias("n"))


@query("snapshot_issues", """
SELECT "check", count(*) AS n FROM (
 SELECT CASE WHEN n_chars < 200 AND lang = 'en' THEN 'silent_thin_source' WHEN n_chars < 200 THEN 'thin_extract' END AS "check" FROM documents
 UNION ALL SELECT 'unknown_org' FROM documents WHERE lang = 'es' UNION ALL SELECT 'unwatchable_snapshot' FROM documents WHERE lang = 'fr') WHERE "check" IS NOT NULL GROUP BY 1""")
def snapshot_issues(spark, sf):
    docs = table(spark, sf, "documents")
    snaps = docs.select(
        F.col("doc_id").cast("string").alias("url"), F.col("lang").alias("org_id"), F.sha2("text", 256).alias("content_hash"),
        F.col("n_chars").cast("int").alias("extracted_chars"), F.when(F.col("lang") == "en", 40).otherwise(1).alias("thin_runs"),
        F.lit(None).cast("timestamp").alias("last_changed"),
    )
    owners = docs.where("lang <> 'es'").select(F.col("lang").alias("org_id")).distinct().withColumn("is_org", F.lit(True))
    watchable = docs.where("lang <> 'fr'").select(F.col("lang").alias("org_id"), F.col("doc_id").cast("string").alias("url"))
    found = quality.snapshot_issues(snaps, owners, watchable, as_of())
    return found.groupBy("check").agg(F.count("*").alias("n"))


@query("health_issues", """
SELECT 'health:' || c_custkey AS "where" FROM customer WHERE NOT CASE WHEN c_nationkey = 0 THEN c_mktsegment = 'BUILDING' WHEN c_nationkey <= 5 THEN c_mktsegment = 'MACHINERY' ELSE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') END""")
def health_issues(spark, sf):
    seg = F.col("c_mktsegment")
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("url"), F.col("c_nationkey").cast("long").alias("consecutive_failures"),
        F.when(seg == "BUILDING", "healthy").when(seg == "MACHINERY", "degraded").otherwise("broken").alias("state"),
    )
    return quality.health_issues(rows).select("where")


@query("aggregator_issues", """
SELECT 'warning' AS severity, 'unopened_aggregator_url' AS "check", count(*) AS n FROM supplier WHERE s_acctbal <= 0 HAVING count(*) > 0
UNION ALL SELECT 'error', 'link_provenance', count(*) FROM supplier WHERE s_acctbal <= 0 HAVING count(*) > 0
UNION ALL SELECT 'error', 'link_note_thin', count(*) FROM supplier WHERE s_acctbal > 0 HAVING count(*) > 0""")
def aggregator_issues(spark, sf):
    s = F.lit(None).cast("string")
    link = F.struct(
        F.lit("https://x.example").alias("url"), F.lit("official").alias("provenance"),
        F.when(F.col("s_acctbal") > 0, "2024-01-01").alias("verifiedAtISO"), F.lit("n").alias("verifiedNote"),
    )
    rows = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("id"), link.alias("link"),
        F.when(F.lit(False), F.struct(s.alias("method"), s.alias("target"), s.alias("provenance"), s.alias("verifiedAtISO"), s.alias("note"))).alias("applyVia"),
    )
    return quality.aggregator_issues(rows, as_of()).groupBy("severity", "check").agg(F.count("*").alias("n"))


@query("dataset_floors", """
SELECT 'region' AS "where" FROM region HAVING count(*) < 50 UNION ALL SELECT 'nation' FROM nation HAVING count(*) < 50 UNION ALL SELECT 'supplier' FROM supplier HAVING count(*) < 50 UNION ALL SELECT 'orders' FROM orders HAVING count(*) < 50""".replace("SELECT 'region' AS \"where\" FROM region HAVING count(*) < 50", "SELECT any_value('region') AS \"where\" FROM region HAVING count(*) < 50").replace("SELECT 'nation' FROM", "SELECT any_value('nation') FROM").replace("SELECT 'supplier' FROM", "SELECT any_value('supplier') FROM").replace("SELECT 'orders' FROM", "SELECT any_value('orders') FROM"))
def dataset_floors(spark, sf):
    named = {name: table(spark, sf, name) for name in ("region", "nation", "supplier", "orders")}
    return quality.floors(named).select("where")
