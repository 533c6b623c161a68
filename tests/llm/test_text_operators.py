"""Near and exact duplicates, lines, contamination and mixing against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewatch.llm import exact, fmindex, lines, mix, simhash
from tidewatch.llm.cuckoo import Cuckoo
from tidewatch.llm.xxh import xxh64

DOCS = "doc_id long, text string, source string, digest string, key string, fp long"
BLANK = r"[\x20\x09-\x0D]"


def docs(spark, rows):
    """Documents with extra columns named like the operators' own."""
    return spark.createDataFrame([(i, t, s, "x", "y", 1) for i, t, s in rows], DOCS)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def some_texts(seed=3, n=60):
    rnd = random.Random(seed)
    words = ["the", "of", "And", "é", "ÉT", "harbour", "walked", "seven", "lamp", "x" * 40, "over", "quiet"]
    out = []
    for i in range(n):
        lines_ = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(1, 5))]
        out.append("\n".join(lines_))
    out += [out[0], out[0] + " ", out[1].upper(), None, "", " \t\n", "one", "two words", "a" * 50_000, out[2] + " lamp", out[2] + "\nlamp"]
    return [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in enumerate(out)]


def found(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_hash_of_ranges_is_xxh64():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    start, size = rng.integers(0, 2000, 500), rng.integers(0, 300, 500)
    want = [xxhash.xxh64_intdigest(data[a : a + n].tobytes(), 42) for a, n in zip(start, size)]
    assert xxh64(data, start, size).tolist() == want


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def brute_components(fps):
    """Smallest reachable id of each (id, fingerprint)."""
    root = {i: i for i, _ in fps}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(fps):
        for j, y in fps[a + 1 :]:
            if (x ^ y).bit_count() <= 2:
                low_, high = sorted((top(i), top(j)))
                root[high] = low_
    return {i: top(i) for i, _ in fps}


def test_near_duplicates_match_brute_force(spark):
    rows = some_texts()
    got = found(simhash.near_duplicates(docs(spark, rows)))
    fps = [(i, brute_fingerprint(t)) for i, t, _ in rows]
    want = brute_components(fps)
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps}
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_links_connect_what_all_pairs_connect(spark):
    rnd = random.Random(5)
    fps = {0, 1 << 63, (1 << 64) - 1}
    for _ in range(12):
        seed = rnd.getrandbits(64)
        for _ in range(12):  # walks of one to three flips: chains, dense balls and near misses
            fps.add(seed)
            for _ in range(rnd.randint(1, 3)):
                seed ^= 1 << rnd.randrange(64)
    fps = sorted(fps)
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in fps]
    links = simhash.links(spark.createDataFrame(signed, "fp long")).collect()
    root = {v: v for (v,) in signed}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
        root[top(a)] = top(b)
    for a, x in enumerate(signed):
        for y in signed[a + 1 :]:
            if ((x[0] ^ y[0]) & (1 << 64) - 1).bit_count() <= 2:
                assert top(x[0]) == top(y[0])
    comps = simhash.components(spark.createDataFrame(links, "src long, dst long")) if links else None
    for r in comps.collect():
        assert top(r.node) == top(r.root) and r.root <= r.node


def test_one_of_each_keeps_the_smallest_and_bare_rows(spark):
    rows = [(3, "a b c d e", "s"), (2, "A B C D E", "s"), (9, "something else stands here now", "s"), (9, "something else stands here now", "s"),
            (None, "a b c d e", "s"), (None, "no other document says this thing", "s"), (None, "no other document says this thing", "s")]
    kept = simhash.one_of_each(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [
        (-1, "no other document says this thing"), (2, "A B C D E"), (9, "something else stands here now")]


@pytest.mark.parametrize("support", [0.2, 0.005])
def test_exact_duplicates_match_brute_force(spark, support):
    rows = some_texts() + [(100 + i, "hot\ttext", "s") for i in range(60)] + [(None, "hot text", "s"), (70, "again", "s"), (70, "again", "s")]
    got = exact.exact_duplicates(docs(spark, rows), support=support).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(re.sub(BLANK, "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    want = []
    for i, t, _ in rows:
        bare = re.sub(BLANK, "", t or "")
        best = min(groups[bare])
        keep = None if best[1] else best[2]
        want.append((str(i), str(keep), len(groups[bare]), i == keep, hashlib.sha256(bare.encode()).hexdigest()))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in got) == sorted(want)


def test_exact_duplicates_run_no_python(spark):
    plan = exact.exact_duplicates(docs(spark, some_texts()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_lines(rows):
    holders = {}
    key = lambda line: low(line.strip(" \t\n\x0b\f\r"))
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t, _ in rows:
        parts = (t or "").split("\n")
        left = [p for p in parts if len(key(p)) < 10 or len(holders[key(p)]) < 2 or min(holders[key(p)]) == i]
        out[i] = (len(parts), len(parts) - len(left), "\n".join(left))
    return out


def line_rows():
    return some_texts(8) + [(200 + i, f"own line number {i} of this\n  A COMMON line of many \n\né é é é é", None) for i in range(30)] + [
        (300, "ééééééééé\nshort one\nrepeated here twice\nrepeated here twice", "s"), (301, "repeated here twice\rx\nrepeated here TWICE\t", "s")]


def kept_of(df):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in df.collect()}


def test_line_dedup_matches_brute_force_however_rows_are_dealt(spark):
    rows = line_rows()
    table = docs(spark, rows)
    got = lines.line_dedup(table)
    assert kept_of(got) == brute_lines(rows)
    index = lines.build(table.select("doc_id", "text"), shards=3)
    few = lines.screened(index, index.postings, most=3)
    rows_of = lambda df: sorted((bytes(r.key), r.doc) for r in df.collect())
    assert rows_of(few) == rows_of(lines.screened(index, index.postings))
    shared = {bytes(r.key) for r in index.refs.where("first < last").collect()}
    assert {k for k, _ in rows_of(few)} >= shared and len(rows_of(few)) < index.postings.count()


def test_lines_added_and_taken_out_leave_the_index_as_it_was(spark):
    rows = line_rows()
    first, more = docs(spark, rows[:50]), docs(spark, rows[50:])
    state = lambda x: sorted(map(str, x.refs.where("refs > 0").collect()))
    start = lines.build(first, shards=3)
    grown = lines.insert(start, more)
    whole = lines.build(docs(spark, rows), shards=3)
    assert state(grown) == state(whole)
    drops = lambda x: sorted((r.doc, sorted(map(bytes, r["keys"]))) for r in lines.drops(x).collect())
    assert drops(grown) == drops(whole)
    back = lines.delete(grown, more.select("doc_id"))
    assert state(back) == state(start) and drops(back) == drops(start)
    # The smallest holder goes: the next one takes its place.
    less = lines.delete(grown, docs(spark, [(200, None, None)]).select("doc_id"))
    want = brute_lines([r for r in rows if r[0] != 200])
    assert {d: n for d, (_, n, _) in want.items() if n} == {
        r.doc_id: r.kept.n_dropped for r in lines.deduped(less, docs(spark, [r for r in rows if r[0] != 200])).collect() if r.kept.n_dropped}


def test_cuckoo_filter_finds_all_and_forgets_the_removed():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    made = Cuckoo.from_bytes(Cuckoo.filled(hashes).to_bytes())
    assert made.contains(hashes).all()
    made.remove(hashes[:2000])
    assert made.contains(hashes[2000:]).all() and made.contains(hashes[:2000]).mean() < 0.01
    made.remove(hashes[2000:])
    assert not made.cells.any()
    assert not Cuckoo.filled(hashes[:0]).contains(hashes).any()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(rows, items, window=13):
    held = {}
    for item, text in items:
        words = WORD.findall(low(text))
        n = min(window, len(words))
        for k in range(len(words) - n + 1 if n else 0):
            held.setdefault(tuple(words[k : k + n]), set()).add(item)
    sizes = {len(k) for k in held}
    out = {}
    for i, t, _ in rows:
        words, hit, found_ = WORD.findall(low(t)), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                if (who := held.get(tuple(words[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found_ |= who
        items_ = ",".join(sorted(map(str, found_)))
        out[i] = (len(words), len(hit), len(found_), hashlib.sha256(items_.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words))
    return out


def contamination_case():
    rnd = random.Random(4)
    said = [" ".join(rnd.choice(["tide", "Moon", "été", "7", "salt"]) for _ in range(30)) for _ in range(6)]
    items = [(10, said[0]), (2, said[1]), (33, "tide, tide moon"), (4, None), (5, "..."), (10, said[2]), (6, said[1])]
    rows = some_texts(2, 20) + [(500, "x y " + said[0] + " z", "s"), (501, said[1][20:] + "!" + said[0][:-30], "s"), (502, "TIDE tide\nmoon " * 3, "s"), (503, said[3], "s")]
    return rows, items


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_contamination_matches_brute_force(spark, most):
    rows, items = contamination_case()
    rows = rows + rows[-2:]  # repeated rows
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = fmindex.verdicts(fmindex.contamination(docs(spark, rows), bench, most=most)).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: tuple(r)[1:] for r in got} == brute_hits(rows, items)


def test_spans_cut_exactly_the_hit_words_and_clean_keeps_the_rest(spark):
    rows, items = contamination_case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(rows, items)
    cut = fmindex.contamination(docs(spark, rows), bench).join(docs(spark, rows).select("doc_id", "text"), "doc_id")
    left = cut.select("doc_id", fmindex.without_spans(F.col("text"), F.col("spans")).alias("text")).collect()
    for r in left:
        assert len(WORD.findall(low(r.text))) == want[r.doc_id][0] - want[r.doc_id][1]
    kept = fmindex.clean(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, w in want.items() if not w[4]}
    none = fmindex.verdicts(fmindex.contamination(docs(spark, rows), bench.limit(0))).collect()
    assert all(r.n_hit == 0 and not r.contaminated for r in none)


def brute_targets(sizes):
    """Shares by weight; what is above three times a source's size is shared again until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        share = (total - sum(full.values())) / max(sum(weight[s] for s in rest), 1)
        over = [s for s in rest if share * weight[s] > 3 * sizes[s]]
        if not over:
            return {s: full.get(s, share * weight[s]) for s in names}
        full.update({s: 3.0 * sizes[s] for s in over})


def test_mix_meets_its_targets(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(["w"] * rnd.choice([0, 1, 5, 30, 200])), rnd.choice(["a", "a", "a", "b", "B", "é", None, "tiny"][: 7 + (i % 50 == 0)])) for i in range(4000)]
    rows += [(9000, None, "null text"), (9001, "", "null text"), (9002, "a\x0bb\x1cc", "b")]
    got = mix.mixture(docs(spark, rows)).collect()
    sizes, counts = {}, {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    for i, _, s in rows:
        sizes[s] = sizes.get(s, 0) + counts[i]
    want = brute_targets(sizes)
    taken, rows_of = {}, {}
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == counts[r.doc_id] and r.source_size == sizes[s]
        assert r.target == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
        rows_of[s] = rows_of.get(s, 0) + r.copies
    assert len(got) == len(rows)
    for s, goal in want.items():
        assert abs(taken[s] - goal) <= 200, (s, taken[s], goal)
        if sizes[s] > 1000:  # documents are balanced as well as words
            n = sum(1 for i in source if source[i] == s)
            assert abs(rows_of[s] - n * goal / sizes[s]) <= 3
    again = mix.mixture(docs(spark, list(reversed(rows))).repartition(3))
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_flight_keeps_totals_and_leaves_two_open():
    rng = np.random.default_rng(2)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        size = rng.choice([0.0, 1.0, 3.0, 50.0], n)
        chance, draw = np.full(n, rng.random()), rng.random(n)
        out = mix.flight(size, chance, draw)
        assert ((out > 0) & (out < 1)).sum() <= 2
        assert out @ size == pytest.approx(chance @ size, abs=1e-6) and out.sum() == pytest.approx(chance.sum(), abs=1e-6)


def test_a_mean_of_many_flights_is_the_chance():
    rng = np.random.default_rng(3)
    size = np.array([9.0, 7, 7, 5, 3, 2, 1, 1])
    total = sum(mix.flight(size, np.full(8, 0.3), rng.random(8)) for _ in range(4000))
    assert np.allclose(total / 4000, 0.3, atol=0.05)


def test_mixed_documents_keep_their_columns(spark):
    rows = [(i, "w " * (i % 9), f"s{i % 2}") for i in range(200)] + [(None, "w w", "s0"), (5, "w w w", "s0")]
    table = docs(spark, rows)
    got = mix.mixed(table)
    assert got.columns == table.columns + ["size", "source_size", "target", "taken", "copies"]
    assert all(r.copies > 0 for r in got.collect())


@pytest.mark.parametrize("operator", [
    simhash.near_duplicates, simhash.one_of_each, exact.exact_duplicates, lines.line_dedup, mix.mixture, mix.mixed,
    lambda d: fmindex.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    lambda d: fmindex.clean(d, d.select(F.col("doc_id").alias("item_id"), "text")),
])
def test_empty_tables_and_all_null_rows(spark, operator):
    none = docs(spark, [])
    assert operator(none).count() == 0
    nulls = spark.createDataFrame([(None,) * 6] * 2, DOCS)
    operator(nulls).collect()


def test_items_without_an_id_stand_beside_others(spark):
    said = " ".join(f"word{n}" for n in range(20))
    items = spark.createDataFrame([(None, said), (4, said), (None, "word1"), (None, None), (7, "unheard")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "x " + said), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in fmindex.verdicts(fmindex.contamination(rows, items)).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (21, 20, 1, True) and got[2].n_words == 0
