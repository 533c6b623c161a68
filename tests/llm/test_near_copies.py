"""Near copies of the pipeline's stage against a brute-force join on Jaccard of five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tidewatch.llm import minhash
from tidewatch.llm.components import is_star_forest, rooted

DOCS = "doc_id long, text string, source string, node string, bands string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "s", "x", "y") for i, t in rows], DOCS)


def shingles(text, n=5):
    words = (text or "").lower().split()
    return frozenset(tuple(words[k : k + n]) for k in range(max(len(words) - n + 1, 1))) if words else frozenset()


def alike(a, b, least=0.8):
    return a == b or len(a & b) >= least * len(a | b) and bool(a | b)


def brute_components(rows, least=0.8):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for j in range(len(rows)):
        for i in range(j):
            if alike(sets[i], sets[j], least):
                up[top(i)] = top(j)
    least_id = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least_id[top(k)] = min(i, least_id.get(top(k), i))
    return [(i, least_id.get(top(k))) for k, (i, _) in enumerate(rows)]


def edited(rnd, words, times):
    words = list(words)
    for _ in range(times):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return words


def families(seed=11):
    """Groups whose members differ from one text, or each from the one before, by more and less than the bound."""
    rnd = random.Random(seed)
    texts = ["", None, " \t\n", "one", "One", "two words here", "two words here too"]
    for size, group, walk in ((200, 300, False), (60, 40, False), (120, 40, True), (400, 30, False), (1500, 12, True)):
        base = [f"w{rnd.randrange(5000)}" for _ in range(size)]
        for _ in range(group):
            new = edited(rnd, base, rnd.randint(0, max(2, size // 25)))
            texts.append(" ".join(new))
            base = new if walk else base
    texts += [" ".join(f"w{rnd.randrange(5000)}" for _ in range(100)) for _ in range(40)]
    texts += texts[7:12] + [texts[20].upper()]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return list(zip(ids, texts))


def test_near_copies_match_a_brute_force_join(spark):
    rows = families() + [(None, "nobody else says these seven words"), (None, "")]
    got = minhash.near_copies(docs(spark, rows)).collect()
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None))
    assert order([(r.doc_id, r.component_id) for r in got]) == order(brute_components(rows))


def test_groups_of_many_blocks_match_a_brute_force_join(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 9)
    rows = families(5)
    got = minhash.near_copies(docs(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted(brute_components(rows))


def test_stars_need_no_step_and_chains_become_stars(spark):
    made = lambda rows: spark.createDataFrame(rows, "src long, dst long")
    assert is_star_forest(made([(2, 1), (3, 1), (9, 8)]).toDF("u", "v"))
    assert not is_star_forest(made([(2, 1), (3, 2)]).toDF("u", "v")) and not is_star_forest(made([(3, 1), (3, 2)]).toDF("u", "v"))
    chain = made([(n, n + 1) for n in range(40)] + [(100, 101), (101, 100), (7, 7)])
    assert sorted(map(tuple, rooted(chain).collect())) == [(n, 0) for n in range(1, 41)] + [(101, 100)]
    assert rooted(chain.limit(0)).count() == 0


def test_the_stage_leaves_one_of_each_group(spark, sf):
    rows = families(12)
    kept = corpus_pipeline.one_of_near(spark, docs(spark, rows), sf)
    assert kept.columns == docs(spark, rows).columns
    texts = dict(rows)
    assert {r.doc_id: r.text for r in kept.collect()} == {i: texts[i] for i in {c for _, c in brute_components(rows)}}


def test_one_row_of_a_group_without_ids_stays(spark):
    base = [f"w{k}" for k in range(100)]
    rows = [(None, " ".join(base)), (None, " ".join(base + ["end"])), (None, " ".join(base)), (4, "other"), (4, "other"), (None, "other")]
    kept = minhash.one_of_near(docs(spark, rows)).collect()
    assert [r.text for r in kept if r.doc_id == 4] == ["other"]
    assert len(kept) == 2


@pytest.mark.parametrize("n", [3, 8, 9, 150])
def test_blocks_give_the_pairs_that_sets_give(n):
    rng = np.random.default_rng(n)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 200)).astype(np.uint64)) for _ in range(n)]
    want = [(i, j) for j in range(n) for i in range(j) if alike(set(sets[i].tolist()), set(sets[j].tolist()))]
    assert sorted(minhash.alike_pairs(sets, 0.8)) == sorted(want)


def test_empty_tables_and_null_rows(spark):
    assert minhash.one_of_near(docs(spark, [])).count() == 0
    assert minhash.one_of_near(spark.createDataFrame([(None,) * 5] * 2, DOCS)).count() == 1


def test_rows_with_and_without_ids_take_one_way(spark, monkeypatch):
    asked = []
    kept_rows = minhash.kept_rows
    monkeypatch.setattr(minhash, "kept_rows", lambda *args: asked.append(1) or kept_rows(*args))
    base = " ".join(f"w{k}" for k in range(100))
    rows = [(3, base), (2, base + " end"), (2, base + " end"), (9, "other words")]
    assert sorted((r.doc_id, r.text) for r in minhash.one_of_near(docs(spark, rows)).collect()) == [(2, base + " end"), (9, "other words")]
    got = minhash.one_of_near(docs(spark, rows + [(None, base), (None, "bare"), (None, "bare")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "bare"), (2, base + " end"), (9, "other words")]
    assert len(asked) == 2
