"""Which languages a text is written in, as a mixture.

Every word has a likelihood under each language: the product of the likelihoods of its
character n-grams, edges included. A text is a mixture of languages; expectation
maximisation estimates the proportions from its words. The set of languages is chosen by
penalised likelihood: starting from the best single language, one more is taken while it
raises the log-likelihood by more than it costs.

The n-grams are counted over all training rows by Spark, hashed into a table of fixed
size for each language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import PIECE_BYTES, stored

#: Code points in an n-gram; shorter words have their edges to fill one up.
NGRAM = 3
BUCKETS = 1 << 16
#: More labels than this are no languages but free text.
MOST_LANGUAGES = 512
#: Added to every count.
PRIOR = 0.5
#: Steps of the estimate of all languages, and of each chosen set.
STEPS = 12
#: What a further language costs, in units of log(words).
COST = 3.0
#: Under this part of the likelihood a word is held to be noise that tells nothing.
FLOOR = 1e-4
UNDETERMINED = "und"

_NO_LANGUAGES = f"more than {MOST_LANGUAGES} labels: not a column of languages"

_MIX = np.uint32(0x9E3779B1)


@dataclass
class Words:
    """Words of a run of texts: their n-grams' buckets end to end, and where words and texts begin."""

    grams: np.ndarray
    word_at: np.ndarray
    text_at: np.ndarray


def words_of(texts: list[str | None], buckets: int = BUCKETS) -> Words:
    """Maximal runs of letters, lower-cased, each with the n-grams of ``_word_``."""
    low = [(t or "").lower() for t in texts]
    codes = np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.flatnonzero(np.bincount(codes, minlength=1))
    letter = np.zeros(int(seen[-1]) + 1, bool)
    letter[seen] = [chr(c).isalpha() for c in seen.tolist()]
    solid = letter[codes]
    starts = np.flatnonzero(solid & ~np.r_[False, solid[:-1]])
    stops = np.flatnonzero(solid & ~np.r_[solid[1:], False]) + 1
    size = stops - starts
    # A word of n letters has n n-grams: centred on each letter, its neighbours or the edge beside it.
    at = np.flatnonzero(solid)
    edge = np.uint32(0)
    masked = np.where(solid, codes, edge)
    before = np.r_[edge, masked[:-1]][at]
    after = np.r_[masked[1:], edge][at]
    with np.errstate(over="ignore"):
        h = ((before * _MIX + masked[at]) * _MIX + after) * _MIX
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
    grams = (h % np.uint32(buckets)).astype(np.int32)
    text_end = np.cumsum([len(t) + 1 for t in low])
    return Words(grams, np.r_[0, np.cumsum(size)], np.r_[0, np.searchsorted(starts, text_end)])


@dataclass
class Model:
    """``logs``: log-likelihood of each bucket under each language (a column each), languages in order of code points."""

    languages: list[str]
    logs: np.ndarray


def model_of(languages: list[str], counts: np.ndarray) -> Model:
    """Smoothed log-likelihoods from ``counts`` (a row for each language)."""
    part = (counts + PRIOR) / (counts.sum(axis=1, keepdims=True) + PRIOR * counts.shape[1])
    return Model(list(languages), np.ascontiguousarray(np.log(part).T.astype(np.float32)))


def word_likelihoods(words: Words, model: Model) -> np.ndarray:
    """Likelihood of each word under each language, the best one's being 1 and none below ``FLOOR``."""
    n = len(words.word_at) - 1
    if not n:
        return np.zeros((0, len(model.languages)), np.float32)
    total = np.add.reduceat(model.logs[words.grams], words.word_at[:-1], axis=0)
    total -= total.max(axis=1, keepdims=True)
    return np.maximum(np.exp(total), np.float32(FLOOR))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the rows of each range; an empty range has zero."""
    out = np.zeros((len(at) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.add.reduceat(values, at[full], axis=0, dtype=np.float64)
    return out


def proportions(like: np.ndarray, at: np.ndarray, allowed: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Mixture proportions of each text over its allowed languages, and the log-likelihood they reach.

    Every text must have a word; ``allowed`` has a row of booleans for each text.
    """
    count = np.diff(at)
    owner = np.repeat(np.arange(len(count)), count)
    share = (allowed / allowed.sum(axis=1, keepdims=True)).astype(np.float32)
    for _ in range(steps):
        joint = like * share[owner]
        joint /= joint.sum(axis=1, keepdims=True)
        share = (_sums(joint, at) / count[:, None]).astype(np.float32)
    seen = (like * share[owner]).sum(axis=1)
    return share, _sums(np.log(np.maximum(seen, np.finfo(np.float32).tiny)), at)


def _take(like: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts."""
    size = at[which + 1] - at[which]
    begins = np.r_[0, np.cumsum(size)]
    return like[np.arange(begins[-1]) + np.repeat(at[which] - begins[:-1], size)], begins


def mixtures(words: Words, model: Model, cost: float = COST) -> tuple[np.ndarray, np.ndarray]:
    """Chosen proportions (zero outside the chosen set) and those of all languages, for each text.

    A text without words has zeros.
    """
    n, kinds = len(words.text_at) - 1, len(model.languages)
    chosen, overall = np.zeros((n, kinds)), np.zeros((n, kinds))
    texts = np.flatnonzero(np.diff(words.text_at))
    if not len(texts) or not kinds:
        return chosen, overall
    like = word_likelihoods(words, model)
    like, at = _take(like, words.text_at, texts)
    count = np.diff(at)
    every, _ = proportions(like, at, np.ones((len(texts), kinds), bool))
    overall[texts] = every
    alone = _sums(np.log(like), at)
    best = alone.argmax(axis=1)  # ties: the first language by code point
    allowed = np.zeros((len(texts), kinds), bool)
    allowed[np.arange(len(texts)), best] = True
    reached = alone[np.arange(len(texts)), best]
    share = allowed.astype(np.float64)
    price = cost * np.log(count + 1.0)
    active = np.arange(len(texts))
    for _ in range(kinds - 1):
        outside = np.where(allowed[active], -1.0, every[active])
        more = outside.argmax(axis=1)
        # A language that explains next to no word cannot pay its price.
        hopeful = outside[np.arange(len(active)), more] * count[active] > 0.5
        active, more = active[hopeful], more[hopeful]
        if not len(active):
            break
        tried = allowed[active].copy()
        tried[np.arange(len(active)), more] = True
        some, some_at = _take(like, at, active)
        got, log = proportions(some, some_at, tried)
        better = log - reached[active] > price[active]
        active = active[better]
        allowed[active], reached[active], share[active] = tried[better], log[better], got[better]
    chosen[texts] = share
    return chosen, overall


def _held_out(doc_id: Column) -> Column:
    """Rows never learnt from: crc32 of the doc_id as text is divisible by five. NULL counts as empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _runs(texts: list[str | None], most: int = PIECE_BYTES) -> Iterator[list[str | None]]:
    """Runs of whole texts of about ``most`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and len(t or "") >= most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t or "")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def _long_parts(text: str, most: int) -> Iterator[str]:
    """A text cut between words into parts of about ``most`` characters."""
    start = 0
    while start < len(text):
        end = min(start + most, len(text))
        while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        yield text[start:end]
        start = end


def _counter(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                table = held.setdefault(lang, np.zeros(buckets, np.int64))
                for part in _long_parts(text or "", PIECE_BYTES):
                    grams = words_of([part], buckets).grams
                    if len(grams) > buckets // 8:
                        table += np.bincount(grams, minlength=buckets)
                    else:
                        np.add.at(table, grams, 1)
            if len(held) > MOST_LANGUAGES:
                raise ValueError(_NO_LANGUAGES)
        for lang, table in held.items():
            met = np.flatnonzero(table)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(met), pa.string()), "bucket": pa.array(met, pa.int32()), "n": pa.array(table[met], pa.int64())})

    return count


def fit(docs: DataFrame, buckets: int = BUCKETS) -> Model:
    """N-gram likelihoods of each value of ``lang``, counted over all rows that are not held out.

    The driver holds at most ``MOST_LANGUAGES * buckets`` counts, whatever the number of
    rows; more labels are refused.
    """
    rows = docs.select(F.col("lang").cast("string"), F.col("text").cast("string")).where(F.col("lang").isNotNull() & ~_held_out(F.col("doc_id")))
    told = stored(rows.mapInArrow(_counter(buckets), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    if told.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(_NO_LANGUAGES)
    told = told.toArrow()
    langs = told.column("lang").to_pylist()
    names = sorted(set(langs))
    place = {x: k for k, x in enumerate(names)}
    counts = np.zeros((len(names), buckets))
    counts[[place[x] for x in langs], told.column("bucket").to_numpy()] = told.column("n").to_numpy()
    return model_of(names, counts)


_OUT = T.StructType([
    T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
    T.StructField("languages", T.ArrayType(T.StringType())), T.StructField("shares", T.ArrayType(T.DoubleType())),
])


def judged(texts: list[str | None], model: Model) -> list[dict]:
    """``lang_pred, score, languages, shares`` of each text."""
    buckets = len(model.logs)
    out = []
    for run in _runs(texts):
        words = words_of(run, buckets) if len(run) > 1 else _words_of_long(run[0] or "", buckets)
        chosen, overall = mixtures(words, model)
        for mine, all_of in zip(chosen, overall):
            order = np.lexsort((np.arange(len(mine)), -mine))
            order = order[mine[order] > 0]
            if not len(order):
                out.append({"lang_pred": UNDETERMINED, "score": 0.0, "languages": [], "shares": []})
                continue
            first = int(order[0])
            out.append({
                "lang_pred": model.languages[first], "score": float(min(max(all_of[first], 0.0), 1.0)),
                "languages": [model.languages[k] for k in order], "shares": [float(mine[k]) for k in order],
            })
    return out


def _words_of_long(text: str, buckets: int) -> Words:
    """``words_of`` one text, part by part."""
    parts = [words_of([p], buckets) for p in _long_parts(text, PIECE_BYTES)] or [words_of([""], buckets)]
    sizes = np.concatenate([np.diff(p.word_at) for p in parts])
    return Words(np.concatenate([p.grams for p in parts]), np.r_[0, np.cumsum(sizes)], np.array([0, len(sizes)]))


def languages_udf(spark, model: Model):
    """A column function of a text. The model has a bounded size, whatever the documents."""
    shared = spark.sparkContext.broadcast((model.languages, model.logs))  # plain values: broadcasts travel by reference

    @F.arrow_udf(_OUT)
    def told(texts: pa.Array) -> pa.Array:
        return pa.array(judged(texts.to_pylist(), Model(*shared.value)), pa.struct([
            ("lang_pred", pa.string()), ("score", pa.float64()), ("languages", pa.list_(pa.string())), ("shares", pa.list_(pa.float64())),
        ]))

    return told


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages, shares`` of every row of ``doc_id, text, lang``.

    ``languages`` is the chosen set, largest share first; ``lang_pred`` is the first of it
    and ``score`` its proportion among all languages. A null text, one without letters, and
    every text when there is no row to learn from, is ``und`` with score 0. Repeated rows
    are all returned; one language alone is predicted for every text with letters. Ties go
    to the language that is first by code points. Other columns are not read.
    """
    model = fit(docs)
    said = languages_udf(docs.sparkSession, model)(F.col("text").cast("string"))
    rows = docs.select("doc_id", _held_out(F.col("doc_id")).alias("held_out"), said.alias("said"))
    return rows.select("doc_id", "held_out", "said.*")
