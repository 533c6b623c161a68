"""Ranked search against a plain scoring of every document."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidewatch.llm import ranked
from tidewatch.plans.registry import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(_LOW) for t in TERM.findall(text or "")]


def brute(docs, items, k=50):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, some in asked.items():
        scored = []
        for doc, c in held:
            m = 100 - 50 + (50 * c.total() * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in some if t in c)
            if score > 0:
                scored.append((-score, doc is None, doc if doc is not None else 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(map(str, out))


def rows(df):
    return sorted(str(tuple(r)) for r in df.select("item_id", "rank", "doc_id", "score").collect())


DOCS = [
    (1, "Red fox, red FOX"), (2, "the red hen"), (2, "the red hen"), (3, None), (4, ""), (5, "... !!"), (6, "Été à la mer — ÉTÉ"), (None, "the fox"),
    (None, "the fox"), (7, "fox " * 500), (8, "the " * 3000 + "zebra"), (9, "x1 1x_2 a-b İ K"), (10, "the fox"), (11, "the fox"),
]
ITEMS = [(1, "the Fox"), (2, None), (3, "..."), (4, "unheard words"), (5, "zebra the the"), (6, "été É"), (1, "hen"), (None, "mer"), (None, "a b 2"), (7, "k K i")]


@pytest.mark.parametrize("k", [1, 2, 3, 50])
@pytest.mark.parametrize("segment", [1, 200, 1 << 24])
def test_odd_rows_against_brute_force(spark, monkeypatch, k, segment):
    monkeypatch.setattr(ranked, "SEGMENT_BYTES", segment)
    docs = spark.createDataFrame([(i, t, "s", 1, "t") for i, t in DOCS], "doc_id long, text string, term string, score int, item string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("term", F.lit(1))
    assert rows(ranked.search(ranked.index(docs.repartition(3)), items, k)) == brute(DOCS, ITEMS, k)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert ranked.search(ranked.index(docs.limit(0)), items).count() == 0
    assert ranked.search(ranked.index(docs), items.limit(0)).count() == 0


@pytest.mark.parametrize("goes", [1 << 23, 4000])
def test_documents_in_many_segments_and_goes(spark, sf, monkeypatch, goes):
    monkeypatch.setattr(ranked, "SEGMENT_BYTES", 20_000)
    monkeypatch.setattr(ranked, "QUERY_BYTES", goes)
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark").withColumn("item_id", F.concat(F.lit("i"), "item_id"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 10)
    assert rows(ranked.search(ranked.index(docs), items, 10)) == want


def test_accumulators_are_limited_and_scores_stay_exact():
    import numpy as np

    ids, none = np.arange(100), np.zeros(100, bool)
    rare = (np.array([3, 4]), np.array([90, 80]), 90)
    common = (np.arange(100), np.r_[np.full(99, 5), 7], 7)
    places, scores = ranked.best_of_segment([rare, common], 100, ids, none, 2, 0)
    assert places.tolist() == [3, 4] and scores.tolist() == [95, 85]
    # One place is open: the common term still makes accumulators, and equal scores go by doc_id.
    places, scores = ranked.best_of_segment([rare, common], 100, ids, none, 4, 0)
    assert places.tolist() == [3, 4, 99, 0] and scores.tolist() == [95, 85, 7, 5]
    assert len(ranked.best_of_segment([common], 100, ids, none, 5, 8)[0]) == 0


def test_lengths_beyond_64_bits_are_exact():
    import numpy as np

    sizes = np.array([1, 10**9, 3 * 10**9])
    assert ranked.damping(sizes, 10**11, 7 * 10**12).tolist() == [50 + 50 * n * 10**11 // (7 * 10**12) for n in sizes.tolist()]
