"""Joins that no equality gives, each against a plain double loop."""

import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import asof, due, entities, probe, relevance, selection, spread
from tidewatch.sources import robots


def when(minute):
    return None if minute is None else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


@pytest.mark.parametrize("every", ["hour", "day", "year"])
@pytest.mark.parametrize("strict", [False, True])
def test_versions_are_carried_to_every_instant(spark, every, strict):
    rnd = random.Random(5)
    keys = ["hot"] * 12 + ["a", "b", "c", None]
    span = 60 * 24 * 9
    versions = [(rnd.choice(keys), rnd.choice([rnd.randrange(0, span, 30), None]), n, ["x", str(n)]) for n in range(300)]
    facts = [(rnd.choice([*keys, "never"]), rnd.choice([rnd.randrange(0, span, 30), rnd.randrange(span), None]), n) for n in range(900)]
    facts += facts[:40]
    held = spark.createDataFrame([(k, when(t), n, w) for k, t, n, w in versions], "k string, since timestamp, n int, words array<string>")
    asked = spark.createDataFrame([(k, when(t), n) for k, t, n in facts], "k string, at timestamp, n int").withColumn("version_", F.lit(1))

    def brute(k, t):
        if k is None or t is None:
            return None
        known = [(s, n) for key, s, n, _ in versions if key == k and s is not None and (s < t or (s == t and not strict))]
        return max(known)[1] if known else None

    got = asof.as_of(asked, held, "k", "at", "since", ["n"], every, strict).select("n", "version.n", "version.words").toDF("fact", "n", "words").collect()
    assert sorted((r.fact, -1 if r.n is None else r.n) for r in got) == sorted((n, -1 if (b := brute(k, t)) is None else b) for k, t, n in facts)
    assert all(r.words == (None if r.n is None else ["x", str(r.n)]) for r in got)
    assert asof.as_of(asked.limit(0), held, "k", "at", "since").count() == 0
    assert asof.as_of(asked, held.limit(0), "k", "at", "since").where("version IS NOT NULL").count() == 0


def test_facts_never_meet_versions_in_a_join(spark):
    held = spark.range(10).select(F.col("id").alias("k"), F.current_timestamp().alias("since"))
    asked = spark.range(10).select(F.col("id").alias("k"), F.current_timestamp().alias("at"))
    plan = asof.as_of(asked, held, "k", "at", "since")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_sources_are_counted_by_site_and_each_site_is_read_once(spark):
    urls = ["https://www.one.com.sa/a/b", "https://www.one.com.sa", "HTTPS://jobs.one.com.sa:8443/x", "http://two.org?q=/1/2/3", "https://u@two.org#/r", "ftp://three.org/x", "https:///x", "", None, "four.org/a"]
    sources = spark.createDataFrame([(f"o{n % 2}", u) for n, u in enumerate(urls * 2)] + [(None, urls[0])], "org_id string, url string")
    want = {}
    for r in sources.select("org_id", entities.A.registered_domain(F.col("url")).alias("domain")).where("domain IS NOT NULL").collect():
        want[r.domain, r.org_id] = want.get((r.domain, r.org_id), 0) + 1
    assert {(r.domain, r.org_id): r.on_it for r in entities.domain_owners(sources).collect()} == want and len(want) >= 4
    plan = entities.domain_owners(sources)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("regexp_replace" in line and "url#" in line for line in plan.splitlines())


def test_slow_work_on_few_bytes_is_dealt_to_many_tasks(spark):
    one = spark.range(200).coalesce(1)
    assert spread.dealt(one).rdd.getNumPartitions() >= 4
    assert spread.sized(one, "id", 20).rdd.getNumPartitions() == 10 and spread.sized(one, "id").rdd.getNumPartitions() == 4
    said = relevance.announcement_classes(one.select(
        F.col("id"), F.lit("a cyber course").alias("title"), F.array().cast("array<string>").alias("majors"),
        F.array().cast("array<string>").alias("cities"), F.lit("coop").alias("product")))
    assert said.rdd.getNumPartitions() >= 4 and said.count() == 200


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        row, last = [i, *row[1:]], row
        for j, d in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != d))
    return row[-1]


def orgs(spark, rows):
    return spark.createDataFrame(rows, "org_id string, name string, apply_target string")


def listed(spark, rows):
    return spark.createDataFrame(rows, "org_id string, url string")


def test_every_two_near_names_of_a_block_are_found(spark):
    rnd = random.Random(11)
    names = list({"".join(rnd.choice("abé ") for _ in range(rnd.randint(0, 9))).strip() for _ in range(150)})
    names += [f"company of the north {n:03}" for n in range(60)] + ["x" * 400, "x" * 398, "y" + "x" * 400]
    rows = [(f"o{i:03}", n, None) for i, n in enumerate(names)] + [("none", None, None)]
    urls = [(o, f"https://x{i % 2}.com/{i}") for i, (o, _, _) in enumerate(rows)]
    got = {(r.keep_id, r.drop_id) for r in entities.duplicate_proposals(orgs(spark, rows), listed(spark, urls)).collect()}
    folded = {r.org_id: r.f for r in orgs(spark, rows).select("org_id", entities.X.fold_name(F.col("name")).alias("f")).collect()}
    block = {o: i % 2 for i, (o, _, _) in enumerate(rows)}
    want = set()
    kept = {}
    for o in sorted(block):  # every organisation has one source, so the smallest id is kept
        if folded[o] is None:
            continue
        first = kept.setdefault((block[o], folded[o]), o)
        if first != o:
            want.add((first, o))
    for (b, n), (c, m) in itertools.combinations(kept, 2):
        if b == c and edits(n, m) <= 2:
            want.add(tuple(sorted((kept[b, n], kept[c, m]))))
    assert got == want


def blocked(spark, rows):
    return spark.createDataFrame(rows, "org_id string, name string, n_sources long, block string")


@pytest.mark.parametrize("few", [0, 3, 12, 1000])
def test_names_found_by_their_ends_are_those_brute_force_finds(spark, monkeypatch, few):
    monkeypatch.setattr(entities, "CROWD", 0)  # every block is looked up by ends
    monkeypatch.setattr(entities, "FEW", few)  # of 20 letters, of some, of one
    rnd = random.Random(few)
    texts = {"".join(rnd.choice("اب" if few == 3 else "aé😀") for _ in range(rnd.randint(0, 9))) for _ in range(90)}
    texts |= {f"{rnd.choice(['company of', 'compny of', 'of'])} the {rnd.choice(['north', 'nort'])} {rnd.randrange(2500)}" for _ in range(110)}
    texts |= {f"{n} {place} university" for n in range(12) for place in ("east", "eat", "west")}
    rows = [(f"o{i:03}", n, i % 3, f"b{k}") for i, n in enumerate(sorted(texts)) for k in {i % 2, 2, 3 + i % 5}] + [("none", None, 1, "b0"), ("alone", "of", 1, "b9")]
    ends = {r._end for r in entities._numbered(blocked(spark, rows)).select("_end").distinct().collect()}
    assert ends == {20} if few == 0 else ends == {1} if few == 1000 else min(ends) > 1 and max(ends) < 20
    got = {(r.keep_id, r.drop_id) for r in entities._near_names(blocked(spark, rows)).collect()}
    want = set()
    for (a, n, p, b), (c, m, q, d) in itertools.combinations(rows, 2):
        if b == d and n is not None and m is not None and edits(n, m) <= 2:
            want.add(tuple(x[1] for x in sorted([(-p, a), (-q, c)])))
    assert got == want


def test_names_that_share_most_letters_do_not_all_meet(spark):
    rnd = random.Random(5)
    rows = [(str(i), f"company of the north {n}", 1, "b") for i, n in enumerate(rnd.sample(range(100_000, 1_000_000), 3000))]
    named = entities._numbered(blocked(spark, rows))
    met = entities._keyed(named, True).join(entities._keyed(named, False).select("_k"), "_k").count()
    assert met < 300 * 3000  # by segments alone every two of them meet: 4,500,000 pairs and more
    old = blocked(spark, rows).select(F.explode(entities.indexed_keys(F.col("name"))).alias("k")).groupBy("k").count()
    assert old.agg(F.max("count")).first()[0] == 3000


def test_duplicate_search_reads_a_domain_once_for_each_site(spark, monkeypatch):
    rows = [("a", "first body", "hr@m.sa"), ("b", "second one", "hr@m.sa"), ("c", "third place", "hr@m.sa"), ("d", None, None), (None, "nobody", "hr@m.sa")]
    urls = [("a", "https://x.com/1"), ("a", "https://x.com/1"), ("a", "https://x.com/2"), ("a", None), ("b", "https://x.com/3"), ("c", "https://y.com/1"), ("d", None), (None, "https://x.com/1")]
    read, real = [], entities.A.registered_domain
    monkeypatch.setattr(entities.A, "registered_domain", lambda url: read.append(url) or real(url))
    got = entities.duplicate_proposals(orgs(spark, rows), listed(spark, urls)).collect()
    assert [(r.keep_id, r.drop_id, r.reasons) for r in got] == [("a", "b", ["domain+mail"])]
    assert [str(url) for url in read] == ["Column<'_site'>"]


def test_keys_of_a_name_are_few_whatever_its_length(spark):
    names = spark.createDataFrame([("",), ("a",), ("ab",), ("abcd",), ("abcdefghij" * 40,)], "name string")
    sizes = names.select(F.size(entities.indexed_keys(F.col("name"))), F.size(entities.probed_keys(F.col("name")))).collect()
    assert all(a == 3 and b <= 12 for a, b in sizes)


def test_lists_of_urls_meet_by_prefix_as_by_brute_force(spark):
    rnd = random.Random(3)
    lists = [frozenset(rnd.sample(range(40), rnd.randint(0, 6))) | ({900} if rnd.random() < 0.7 else set()) for _ in range(120)]
    lists += [frozenset([900, 901])] * 30 + [frozenset(range(100, 400)), frozenset(range(398, 700)), frozenset(range(399, 800))]
    rows = [(f"o{i:03}", f"n{i * 7919}", None) for i in range(len(lists))]
    urls = [(f"o{i:03}", f"https://h{u}.com/") for i, us in enumerate(lists) for u in us]
    strength = orgs(spark, rows).select("org_id").join(listed(spark, urls).groupBy("org_id").agg(F.count("*").alias("n_sources")), "org_id")
    got = {(r.keep_id, r.drop_id) for r in entities._shared_urls(listed(spark, urls), strength).collect()}
    rank = {f"o{i:03}": (-len(us), f"o{i:03}") for i, us in enumerate(lists)}
    many = {u for u in range(1000) if sum(u in us for us in lists) > 1}
    classes = {}
    for i, us in enumerate(lists):
        if len(us & many) >= 2:
            classes.setdefault(us & many, []).append(f"o{i:03}")
    keeper = {us: min(some, key=rank.get) for us, some in classes.items()}
    want = {(keeper[us], o) for us, some in classes.items() for o in some if o != keeper[us]}
    for a, b in itertools.combinations(classes, 2):
        if len(a & b) >= 2:
            want.add(tuple(sorted((keeper[a], keeper[b]), key=rank.get)))
    assert got == want


def brute_rule(path, rules):
    best = None
    for allow, rule in rules:
        wild = re.escape(rule).replace(r"\*", ".*")
        wild = wild[:-2] + "$" if wild.endswith(r"\$") else wild
        if re.match(wild, path, re.S):
            best = max(best or (0, False), (len(rule), allow))
    return best is None or best[1]


FILES = "origin string, status int, content_type string, body string"


def test_longest_rule_decides_as_by_brute_force(spark):
    rnd = random.Random(8)
    bits = ["a", "b/", "/", "*", "$", ".pdf", "?x=1", "é"]
    origins = {f"https://h{n}.org": [(rnd.random() < 0.5, "/" * (rnd.random() < 0.9) + "".join(rnd.choice(bits) for _ in range(rnd.randint(1, 5)))) for _ in range(30)] for n in range(4)}
    files = [(o, 200, "text/plain", "User-agent: *\n" + "\n".join(f"{'Allow' if a else 'Disallow'}: {r}" for a, r in rules)) for o, rules in origins.items()]
    urls = [o + "/" + "".join(rnd.choice(["a", "b/", "/", ".pdf", "?x=1", "é", "$"]) for _ in range(rnd.randint(0, 6))) for o in origins for _ in range(80)] + [None, "nothing"]
    asked = spark.createDataFrame([(u, "x") for u in urls + urls[:9]], "url string, path string")
    got = robots.permissions(asked, robots.rule_book(spark.createDataFrame(files, FILES), "watcher"))
    assert got.columns == ["url", "path", "allowed", "refusal", "crawl_delay_ms"] and got.count() == len(urls) + 9
    for r in got.collect():
        origin = next((o for o in origins if r.url and r.url.startswith(o)), None)
        assert r.allowed == (brute_rule(r.url[len(origin):], origins[origin]) if origin else False), r.url


def test_an_origin_of_a_million_rules(spark):
    n = 1_000_000
    body = "User-agent: *\n" + "\n".join(f"Disallow: /shop/{k:07}/" for k in range(n)) + "\nAllow: /shop/0000007/open\nDisallow: /*.bak$\n"
    files = spark.createDataFrame([("https://big.org", 200, "text/plain", body)], FILES)
    urls = spark.range(5000).select(F.concat(F.lit("https://big.org/shop/"), F.lpad((F.col("id") * 400).cast("string"), 7, "0"), F.lit("/x")).alias("url"))
    more = spark.createDataFrame([("https://big.org/shop/0000007/open/1",), ("https://big.org/a.bak",), ("https://big.org/a.bak?",)], "url string")
    got = {r.url: r.allowed for r in robots.permissions(urls.unionByName(more), robots.rule_book(files, "watcher")).collect()}
    assert [got[r.url] for r in more.collect()] == [True, False, True]
    assert sum(not a for u, a in got.items() if u.endswith("/x")) == 2500


def test_all_rows_of_a_hot_key_are_ranked(spark):
    rows = [("hot", n * 7919 % 20_011) for n in range(20_000)] + [(k, n) for k in ("a", None) for n in range(5)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(8)
    got = spread.top_k(df, ["k"], [F.desc("v")], None).collect()
    assert len(got) == len(rows)
    for key in ("hot", "a", None):
        mine = sorted((r.rank, r.v) for r in got if r.k == key)
        assert [v for _, v in mine] == sorted((v for k, v in rows if k == key), reverse=True) and [r for r, _ in mine] == list(range(1, len(mine) + 1))


def test_all_due_sources_without_a_limit(spark):
    rows = [(f"https://h{n}.org/", "o", "high", None, when(0)) for n in range(90)]
    schedule = spark.createDataFrame(rows, "url string, org_id string, tier string, last_checked timestamp, next_check timestamp")
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    assert due.due_now(schedule, as_of, None).count() == 90 and due.due_now(schedule, as_of, 7).count() == 7


@pytest.mark.parametrize("parts", [2, 32])
def test_medians_by_narrowing_are_exact(spark, monkeypatch, parts):
    import statistics

    monkeypatch.setattr(selection, "PARTS", parts)
    rnd = random.Random(6)
    rows = [("hot", rnd.choice([rnd.random(), float(rnd.randrange(50)), 1e300, -1e300, 5.0])) for _ in range(2000)]
    rows += [("one", 4.5), ("two", 1.0), ("two", 2.0), ("same", 3.0), ("same", 3.0), ("same", 3.0), ("none", None), (None, 7.0), (None, 8.0), ("nan", float("nan"))]
    got = {r.k: r.median for r in selection.medians(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    for key in {k for k, _ in rows}:
        mine = [v for k, v in rows if k == key and v is not None and v == v]
        assert got[key] == (pytest.approx(statistics.median(mine)) if mine else None)


def test_the_filter_knows_every_key_and_few_others(spark):
    side = spark.range(5000).select((F.col("id") * 3).cast("string").alias("k")).unionByName(spark.createDataFrame([(None,)], "k string"))
    known = probe.known_to(side, "k")
    asked = spark.range(15_000).select(F.col("id"), F.col("id").cast("string").alias("k")).select("id", known(F.col("k")).alias("hit"))
    assert asked.where("id % 3 = 0 AND NOT hit").count() == 0
    assert asked.where("id % 3 <> 0 AND hit").count() < 200
    assert spark.createDataFrame([(None,)], "k string").select(known(F.col("k"))).first()[0] is False
    nobody = probe.known_to(side.limit(0), "k")
    assert asked.select(nobody(F.col("id").cast("string")).alias("h")).where("h").count() == 0
    assert probe.filter_bits(10**10) == probe.MOST_BITS


def test_class_scores_stand_for_the_whole_product(spark):
    rnd = random.Random(9)
    words = ["cyber security training", "computer science", "All majors welcome", "accounting only", "", "IT and networks"]
    cities = [[], ["Riyadh"], ["Jeddah", "Riyadh"], ["Dammam"]]
    said = [(n, rnd.choice(["coop", "graduate_dev", None]), rnd.choice(words), rnd.choice([[], [rnd.choice(words)]]), rnd.choice(cities)) for n in range(120)]
    told = spark.createDataFrame(said, "id int, product string, title string, majors array<string>, cities array<string>")
    who = [(n, rnd.choice(["cyber", "it", "general"]), rnd.choice(cities), rnd.choice([True, False, None])) for n in range(60)]
    readers = spark.createDataFrame([(*w, f"label of {w[1]}") for w in who], "reader_id int, field string, reader_cities array<string>, graduated boolean, field_label string")
    brute = relevance.score_pairs(told.crossJoin(readers)).select("reader_id", "id", "score", "reason").collect()
    want = {(r.reader_id, r.id): (r.score, r.reason) for r in brute}
    held, what = relevance.reader_classes(readers), relevance.announcement_classes(told)
    scores = relevance.class_scores(held, what)
    assert scores.agg(F.sum(F.col("readers") * F.col("announcements"))).first()[0] == len(want)
    full = scores.join(held.select("reader_id", "reader_class"), "reader_class").join(what.select("id", "announcement_class"), "announcement_class")
    assert {(r.reader_id, r.id): (r.score, r.reason) for r in full.collect()} == want
    board = relevance.reader_board(held, what, 4).collect()
    for n, *_ in who:
        best = sorted((-s, i) for (r, i), (s, _) in want.items() if r == n and s is not None)[:4]
        assert sorted((r.rank, r.id, r.score) for r in board if r.reader_id == n) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
