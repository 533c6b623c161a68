"""The language mixture against a plain re-computation, on texts of two languages, and on odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import langmix as L
from tidewatch.plans.registry import table


def brute_words(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def bucket(gram, buckets):
    h = 0
    for c in gram:
        h = ((h + (ord(c) if c != "_" else 0)) * 0x9E3779B1) & 0xFFFFFFFF
    h ^= h >> 15
    h = (h * 0x85EBCA6B) & 0xFFFFFFFF
    h ^= h >> 13
    return h % buckets


def grams(word):
    padded = f"_{word}_"
    return [padded[i : i + 3] for i in range(len(word))]


def brute_model(rows, buckets):
    counts = defaultdict(Counter)
    for i, text, lang in rows:
        if lang is not None and zlib.crc32(str(i if i is not None else "").encode()) % 5:
            counts[lang].update(bucket(g, buckets) for w in brute_words(text) for g in grams(w))
            counts[lang].update()
    total = {k: sum(c.values()) for k, c in counts.items()}
    return {k: lambda b, c=c, k=k: math.log((c[b] + L.PRIOR) / (total[k] + L.PRIOR * buckets)) for k, c in counts.items()}


def brute_shares(text, model, buckets):
    """Proportions of all languages after the same number of steps."""
    like = []
    for w in brute_words(text):
        logs = [sum(f(bucket(g, buckets)) for g in grams(w)) for _, f in sorted(model.items())]
        like.append([max(math.exp(x - max(logs)), L.FLOOR) for x in logs])
    if not like:
        return None
    n = len(like[0])
    share = [1 / n] * n
    for _ in range(L.STEPS):
        new = [0.0] * n
        for row in like:
            total = sum(a * b for a, b in zip(row, share))
            for k in range(n):
                new[k] += row[k] * share[k] / total
        share = [x / len(like) for x in new]
    return dict(zip(sorted(model), share))


def test_query_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    model = brute_model(rows, L.BUCKETS)
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert len(got) == len(rows)
    for i, text, _ in rows:
        want = brute_shares(text, model, L.BUCKETS)
        if want is None:
            assert (got[i].lang_pred, got[i].score, got[i].languages) == (L.UNDETERMINED, 0.0, [])
            continue
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert got[i].score == pytest.approx(want[got[i].lang_pred], abs=2e-3)
        assert math.isclose(sum(got[i].shares), 1, abs_tol=1e-3)
    wrong = [i for i, _, lang in rows if got[i].held_out and got[i].lang_pred != lang]
    assert len(wrong) <= 1


def test_held_out_labels_and_other_columns_have_no_influence(spark, sf):
    docs = table(spark, sf, "documents").withColumns({"said": F.lit(1), "score": F.lit("x"), "languages": F.lit(2), "n": F.lit(3), "bucket": F.lit(0)})
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    swapped = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    a = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs).collect()}
    assert a == {r.doc_id: (r.lang_pred, r.score) for r in L.identify(swapped.repartition(7)).collect()}


def test_a_text_of_two_languages_names_both(spark, sf):
    docs = [r for r in table(spark, sf, "documents").collect() if r.text and len(r.text) > 600]
    model = L.fit(table(spark, sf, "documents"))
    one = {}
    for r in docs:
        one.setdefault(r.lang, r.text[:600])
    for a, b in [("en", "de"), ("fr", "es"), ("de", "fr")]:
        told = L.judged([one[a] + " " + one[b] * 2, one[a]], model)
        assert set(told[0]["languages"]) == {a, b} and told[0]["lang_pred"] == b
        assert told[0]["shares"][0] == pytest.approx(2 / 3, abs=0.1)
        assert told[1]["languages"] == [a]


def test_odd_rows(spark):
    rows = [(n, "the boat and the sea ", "en") for n in range(20)] + [(20 + n, "das boot und die see ", "de") for n in range(20)]
    odd = [(50, None, "en"), (51, "", "de"), (52, "123 ... !", None), (53, "THE BOAT", None), (53, "THE BOAT", None), (None, "das Boot", None),
           (54, "x" * 200_000, None), (55, "und " * 300_000, None), (56, "퟿\U0001f600", None), (57, "１２３ ²", "en")]
    schema = "doc_id long, text string, lang string"
    got = [tuple(r)[:1] + (r.lang_pred,) for r in L.identify(spark.createDataFrame(rows + odd, schema)).collect()]
    assert len(got) == 50
    said = dict(got)
    assert said[50] == said[51] == said[52] == said[57] == "und" and said[53] == "en" and said[None] == said[55] == "de" and said[54] in ("de", "en")
    alone = L.identify(spark.createDataFrame([r for r in rows if r[2] == "en"] + odd[2:4], schema)).collect()
    assert {r.lang_pred for r in alone} == {"en", "und"}
    none = L.identify(spark.createDataFrame(odd[2:5], schema)).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)] * 3
    assert L.identify(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(Exception, match="not a column of languages"):
        L.identify(spark.range(2000).selectExpr("id AS doc_id", "'a' AS text", "CAST(id AS string) AS lang")).count()


def test_long_texts_in_parts_are_one_text(monkeypatch):
    rng = np.random.default_rng(3)
    text = " ".join("".join(rng.choice(list("abcdeéß"), rng.integers(1, 9))) for _ in range(3000))
    model = L.model_of(["a", "b"], rng.integers(0, 50, (2, 512)).astype(float))
    once = L.judged([text], model)
    monkeypatch.setattr(L, "PIECE_BYTES", 400)
    assert L.judged(["a", text, "b"], model)[1] == once[0]
