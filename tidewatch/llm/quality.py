"""A quality classifier in the manner of supervised subword embeddings.

A document's features are its words and the character n-grams inside words, hashed
into a table of learned vectors. Their average goes through a softmax. Vectors and
output weights are learned together by stochastic gradient descent in numpy, on a
bounded sample of labelled documents; scoring covers every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import SOLID_BYTES, pieces, unused, words

_MIX = np.uint32(0x9E3779B1)
_NGRAMS = (3, 4)


def features(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every feature, and the text that holds it, ordered by text.

    Features of a text: each word; each run of 3 or 4 bytes that has no white space
    but at its ends (so word edges count); and one shared feature for a word that
    repeats the word before it, a word pair of which only the equality is kept.
    """
    start, end, text = words(data, at, SOLID_BYTES)
    solid = SOLID_BYTES[data]
    with np.errstate(over="ignore"):
        codes = data.astype(np.uint32) + np.uint32(1)
        found, owner = [], []
        # A word's hash: the difference of a running polynomial, scaled back to the word's start.
        power = np.cumprod(np.full(len(data) + 1, _MIX, np.uint32), dtype=np.uint32)
        inverse = np.cumprod(np.full(len(data) + 1, np.uint32(pow(int(_MIX), -1, 1 << 32)), np.uint32), dtype=np.uint32)
        run = np.zeros(len(data) + 1, np.uint32)
        np.cumsum(codes * power[:-1], dtype=np.uint32, out=run[1:])
        hashed = (run[end] - run[start]) * inverse[start]
        found.append(hashed)
        owner.append(text)
        same = np.flatnonzero((hashed[1:] == hashed[:-1]) & (text[1:] == text[:-1]) & (end[1:] - start[1:] == end[:-1] - start[:-1]))
        found.append(np.full(len(same), 12345, np.uint32))
        owner.append(text[same])
        of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        for n in _NGRAMS:
            if len(data) < n:
                continue
            h = np.full(len(data) - n + 1, n, np.uint32)
            for i in range(n):
                h = h * _MIX + codes[i : len(data) - n + 1 + i]
            inner = np.ones(len(h), bool)
            for i in range(1, n - 1):
                inner &= solid[i : len(data) - n + 1 + i]
            inner &= of[: len(h)] == of[n - 1 :]
            found.append(h[inner])
            owner.append(of[: len(h)][inner])
        mixed = np.concatenate(found)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(13)
    return (mixed % np.uint32(buckets)).astype(np.int64), np.concatenate(owner)


@dataclass
class Model:
    """``pull``: per bucket, how far its vector moves the log-odds of label 1; ``bias``: the log-odds of no feature.

    With two classes the softmax of the averaged vectors depends only on the mean of
    these, so scoring needs one number per feature and not the vector.
    """

    pull: np.ndarray
    bias: float

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        bucket, text = features(data, at, len(self.pull))
        n = len(at) - 1
        total = np.bincount(text, weights=self.pull[bucket], minlength=n)
        mean = total / np.maximum(np.bincount(text, minlength=n), 1)
        return 1.0 / (1.0 + np.exp(-(mean + self.bias)))


def train(
    texts: list[str | None], labels: list[int], buckets: int = 1 << 17, size: int = 8, steps: int = 32_000,
    rate: float = 0.5, seed: int = 7,
) -> Model:
    """Learn bucket vectors and output weights in about ``steps`` steps, each of which falls in a line to zero.

    Few rows are gone over more often than many, each at least once.

    One class alone, or no rows, gives a constant score: the (smoothed) share of label 1.
    """
    y = np.array(labels, np.int64)
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    if len(set(labels)) < 2:
        return Model(np.zeros(buckets), float(np.log(share / (1 - share))))
    bags = []
    for data, at in pieces(pa.array(texts, pa.string())):
        bucket, text = features(data, at, buckets)
        order = np.argsort(text, kind="stable")
        ends = np.searchsorted(text[order], np.arange(len(at)))
        for i in range(len(at) - 1):
            ids, counts = np.unique(bucket[order[ends[i] : ends[i + 1]]], return_counts=True)
            bags.append((ids.astype(np.int32), (counts / max(counts.sum(), 1)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / size, 1 / size, (buckets, size)).astype(np.float32)
    out = np.zeros((size, 2), np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    epochs = max(1, round(steps / len(bags)))
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            ids, weight = bags[i]
            now = rate * (1 - done / steps)
            done += 1
            rows = vectors[ids]
            mean = weight @ rows
            odds = mean @ out + bias
            p = np.exp(odds - odds.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= now * np.outer(mean, p)
            # A feature's step is not divided by the text's length, or long texts would hardly teach.
            vectors[ids] = rows - now * np.minimum(weight * 50, 1)[:, None] * back[None, :]
    pull = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64)
    return Model(pull, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the doc_id as text is divisible by five. NULL counts as empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", most: int = 4000, **settings) -> Model:
    """A model from at most ``most`` labelled documents, half of each label where there are enough.

    The bound keeps what the driver holds at a few tens of MB. Which rows are taken
    depends on a hash of their doc_id, not on their order. Only 0 and 1 are labels.
    """
    known = (
        labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min(label_col).alias("y"), F.max(label_col).alias("_max"))
        .where("y = _max").select("doc_id", "y", F.xxhash64("doc_id").alias("_h"))
    )
    half = [known.where(F.col("y") == v).orderBy("_h", "doc_id").limit(most // 2) for v in (0, 1)]
    chosen = half[0].unionByName(half[1])
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    rows = texts.join(F.broadcast(chosen), "doc_id").select("_h", "doc_id", "text", "y").orderBy("_h", "doc_id", "text").limit(2 * most).collect()
    return train([r["text"] for r in rows], [r["y"] for r in rows], **settings)


def score_udf(spark, model: Model):
    """A column function: score of a text. The model has a fixed size, whatever the documents."""
    shared = spark.sparkContext.broadcast((model.pull, model.bias))  # plain values: broadcasts travel by reference

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        held = Model(*shared.value)
        parts = [held.scores(data, at) for data, at in pieces(texts)]
        return pa.array(np.concatenate(parts) if parts else [], pa.float64())

    return score


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Null and empty texts score as a text without features: near the share of label 1
    among the rows learnt from. Only the text is an input of a score.
    """
    model = fit(docs, labels, **settings)
    score = score_udf(docs.sparkSession, model)(F.col("text"))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= threshold).cast("int")
    )


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **settings) -> DataFrame:
    """The documents whose score reaches the threshold, columns as given."""
    model = fit(docs, labels, **settings)
    (score,) = unused(docs.columns, "score")
    scored = docs.withColumn(score, score_udf(docs.sparkSession, model)(F.col("text")))
    return scored.where(F.col(score) >= threshold).drop(score)
