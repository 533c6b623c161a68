"""Benchmark passages in training texts, found through an FM-index per training shard.

A shard is a run of documents in one task. Its words become numbers: the words of the
searched phrases have one each, and as no phrase can cross another word, only runs of
phrase words long enough for a phrase are kept, with marks between them. Over these
the suffix order, its Burrows-Wheeler transform as a wavelet matrix with rank, and a
sample of suffix positions are built. All phrases are searched backwards at once, two
ranks a word; occurrences are located by walking to a sampled position, checked word
by word, and merged to spans.

The documents never move; the phrases go to them in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import WORD_BYTES, lowered, pieces, stored, unused, words

WINDOW = 13
_BASE = np.uint64(0x9E3779B97F4A7C15)
_END, _GAP, _FIRST = 0, 1, 2
_STEP = 8
#: Bytes of text in a shard's index.
_SHARD = 1 << 21


class Bits:
    """A bit vector with rank: ones before a position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts
        self.zeros = int(len(bits) - counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class Wavelet:
    """A wavelet matrix over numbers: how often a number stands before a position, and which stands there."""

    def __init__(self, values: np.ndarray, sigma: int):
        self.levels: list[Bits] = []
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            ones = (values >> bit) & 1 == 1
            self.levels.append(Bits(ones))
            values = np.concatenate([values[~ones], values[ones]])
        # Where each number's block begins at the bottom: what rank 0 maps to.
        self.start = self._down(np.arange(sigma), np.zeros(sigma, np.int64))

    def _down(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        top = len(self.levels) - 1
        for k, level in enumerate(self.levels):
            ones = level.rank(at)
            at = np.where((value >> (top - k)) & 1 == 1, level.zeros + ones, at - ones)
        return at

    def rank(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(value, at) - self.start[value]

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for level in self.levels:
            ones, one = level.rank(at), level.get(at)
            out = out * 2 + one
            at = np.where(one, level.zeros + ones, at - ones)
        return out


def suffix_order(values: np.ndarray) -> np.ndarray:
    """Start of every suffix in sorted order, by doubling; the last value must be the only smallest."""
    n = len(values)
    rank, width = values.astype(np.int64), 1
    while True:
        key = rank * (max(n, int(rank.max()) + 1) + 1)
        key[: n - width] += rank[width:] + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        fresh = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        width *= 2
        if fresh[-1] == n - 1 or width >= n:
            return order


class FMIndex:
    """Backward search and location over numbers below ``sigma``; the last value is the only zero."""

    def __init__(self, values: np.ndarray, sigma: int):
        order = suffix_order(values)
        counts = np.bincount(values, minlength=sigma)
        self.first = np.cumsum(counts) - counts
        self.size = len(values)
        self.last = Wavelet(values[order - 1], sigma)
        sampled = order % _STEP == 0
        self.sampled = Bits(sampled)
        self.samples = order[sampled]

    def _back(self, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.first[value] + self.last.rank(value, at)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row of numbers."""
        low = np.zeros(len(phrases), np.int64)
        high = np.full(len(phrases), self.size, np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            value = phrases[live, k]
            low[live], high[live] = self._back(value, low[live]), self._back(value, high[live])
            live = live[low[live] < high[live]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes at these places of the sorted order start."""
        at, out = rows.copy(), np.zeros(len(rows), np.int64)
        live, steps = np.arange(len(rows)), 0
        while len(live):
            hit = self.sampled.get(at[live])
            found = live[hit]
            out[found] = self.samples[self.sampled.rank(at[found])] + steps
            live = live[~hit]
            at[live] = self._back(self.last.get(at[live]), at[live])
            steps += 1
        return out


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal ranges have equal hashes, others are told apart later."""
    with np.errstate(over="ignore"):
        n = len(data) + 1
        power = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _BASE, np.uint64)], dtype=np.uint64)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        unpower = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, np.uint64)], dtype=np.uint64)
        run = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64, out=run[1:])
        return (run[end] - run[start]) * unpower[start] + (end - start).astype(np.uint64)


def split_words(text: str | None) -> list[bytes]:
    data = lowered(np.frombuffer((text or "").encode(), np.uint8))
    start, end, _ = words(data, np.array([0, len(data)]), WORD_BYTES)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start, end)]


@dataclass
class Phrases:
    """A block of searched phrases: windows by length, and the items that hold each."""

    vocabulary: list[bytes]
    windows: dict[int, np.ndarray]  # length -> rows of word numbers
    items: dict[int, list[tuple]]  # length -> items of each row

    @classmethod
    def of(cls, items: list[tuple[object, list[bytes]]], window: int = WINDOW) -> Phrases:
        number: dict[bytes, int] = {}
        held: dict[int, dict[tuple, dict]] = {}
        for item, said in items:
            coded = [number.setdefault(w, len(number) + _FIRST) for w in said]
            size = min(window, len(coded))
            for i in range(len(coded) - size + 1 if size else 0):
                held.setdefault(size, {}).setdefault(tuple(coded[i : i + size]), {})[item] = None
        windows = {n: np.array(list(rows), np.int64) for n, rows in held.items()}
        return cls(list(number), windows, {n: [tuple(r) for r in rows.values()] for n, rows in held.items()})


class Searcher:
    """Finds the phrases of a block in texts; one per task, reused for all its shards."""

    def __init__(self, phrases: Phrases):
        self.phrases = phrases
        joined = np.frombuffer(b" ".join(phrases.vocabulary), np.uint8)
        sizes = np.array([len(w) for w in phrases.vocabulary], np.int64)
        end = np.cumsum(sizes + 1) - 1
        hashes = word_hashes(joined, end - sizes, end)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.shortest = min(phrases.windows, default=0)

    def _numbers(self, data, start, end) -> np.ndarray:
        """The number of each word, zero for words of no phrase."""
        if not len(self.hashes) or not len(start):
            return np.zeros(len(start), np.int64)
        hashes = word_hashes(data, start, end)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at] + _FIRST, 0)

    def search(self, data: np.ndarray, at: np.ndarray):
        """Of texts end to end: words per text; spans (text, first word, stop word, first byte, stop byte); (text, item) pairs."""
        data = lowered(data)
        start, end, text = words(data, at, WORD_BYTES)
        n_words = np.bincount(text, minlength=len(at) - 1)
        first_word = np.cumsum(n_words) - n_words
        number = self._numbers(data, start, end)
        hits, pairs = np.zeros(len(start) + 1, np.int64), set()
        # Runs of phrase words within a text that can hold the shortest phrase.
        known = number > 0
        edge = np.flatnonzero(np.r_[True, (known[1:] != known[:-1]) | (text[1:] != text[:-1])]) if len(known) else np.zeros(0, int)
        size = np.diff(np.r_[edge, len(known)])
        keep = known[edge] & (size >= self.shortest) if len(edge) else np.zeros(0, bool)
        if keep.any():
            edge, size = edge[keep], size[keep]
            # Each run and one mark after it; then the end.
            stop = np.cumsum(size + 1)
            place = np.arange(int(stop[-1])) - np.repeat(stop - size - 1, size + 1)
            word = np.repeat(edge, size + 1) + place
            gap = place == np.repeat(size, size + 1)
            values = np.where(gap, _GAP, number[np.where(gap, 0, word)])
            index = FMIndex(np.r_[values, _END], len(self.phrases.vocabulary) + _FIRST)
            for n, rows in self.phrases.windows.items():
                low, high = index.search(rows)
                count = high - low
                which = np.repeat(np.arange(len(rows)), count)
                place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
                where = word[index.locate(place)]
                good = self._exact(data, start, end, rows, which, where)
                which, where = which[good], where[good]
                np.add.at(hits, where, 1)
                np.add.at(hits, where + n, -1)
                both = np.unique(np.stack([text[where], which], 1), axis=0) if len(where) else []
                pairs.update((int(t), item) for t, w in both for item in self.phrases.items[n][w])
        covered = np.cumsum(hits[:-1]) > 0
        opens = covered & ~np.r_[False, covered[:-1] & (text[1:] == text[:-1])][: len(covered)]
        closes = covered & ~np.r_[covered[1:] & (text[1:] == text[:-1]), False][: len(covered)]
        a, b = np.flatnonzero(opens), np.flatnonzero(closes)
        of = text[a]
        spans = (of, a - first_word[of], b + 1 - first_word[of], start[a] - at[of], end[b] - at[of])
        # An item without an id is searched for but not listed.
        return n_words, spans, sorted(p for p in pairs if p[1] is not None)

    def _exact(self, data, start, end, rows, which, where) -> np.ndarray:
        """Whether each occurrence has the phrase's very words; a hash may stand for two."""
        if not len(where):
            return np.zeros(0, bool)
        each = np.unique((where[:, None] + np.arange(rows.shape[1])).ravel())
        got = self._numbers(data, start[each], end[each])
        raw = data.tobytes()
        same = np.array([raw[start[w] : end[w]] == self.phrases.vocabulary[k - _FIRST] for w, k in zip(each, got)])
        wrong = np.zeros(len(start) + 1, np.int64)
        wrong[each + 1] = ~same
        wrong = np.cumsum(wrong)
        return wrong[where + rows.shape[1]] == wrong[where]


_SPAN = "struct<first_word:int,stop_word:int,first_byte:int,stop_byte:int>"


def hits_udf(spark, phrases: Phrases):
    """A column function: words, merged spans and items of a text against one block of phrases."""
    shared = spark.sparkContext.broadcast((phrases.vocabulary, phrases.windows, phrases.items))
    made: list[Searcher] = []

    @F.arrow_udf(f"struct<n_words:long,spans:array<{_SPAN}>,items:array<long>>")
    def hits(texts: pa.Array) -> pa.Array:
        if not made:
            made.append(Searcher(Phrases(*shared.value)))
        counts, spans, owners, items, item_of, base = [], [], [], [], [], 0
        for data, at in pieces(texts, _SHARD):
            n_words, found, pairs = made[0].search(data, at)
            counts.append(n_words)
            owners.append(found[0] + base)
            spans.append(np.stack(found[1:], 1))
            item_of += [t + base for t, _ in pairs]
            items += [item for _, item in pairs]
            base += len(at) - 1
        ends = lambda of: np.searchsorted(of, np.arange(base + 1)).astype(np.int32)
        flat = np.concatenate(spans) if spans else np.zeros((0, 4), np.int64)
        of = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        names = ["first_word", "stop_word", "first_byte", "stop_byte"]
        span = pa.StructArray.from_arrays([pa.array(flat[:, i].astype(np.int32)) for i in range(4)], names)
        return pa.StructArray.from_arrays(
            [
                pa.array(np.concatenate(counts) if counts else [], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends(of)), span),
                pa.ListArray.from_arrays(pa.array(ends(np.array(item_of, np.int64))), pa.array(items, pa.int64())),
            ],
            ["n_words", "spans", "items"],
        )

    return hits


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, most: int = 1_000_000) -> Iterator[Phrases]:
    """The benchmark's phrases in blocks of about ``most`` windows; texts come to the driver one by one.

    The benchmark is the stated set of queries. Null texts have no words; null
    item_ids are searched for but not listed. One empty block if there are no phrases.
    """
    block, held, given = [], 0, False
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator():
        said = split_words(row["text"])
        block.append((row["item_id"], said))
        held += max(len(said) - window + 1, 1)
        if held >= most:
            yield Phrases.of(block, window)
            block, held, given = [], 0, True
    if block or not given:
        yield Phrases.of(block, window)


def _merged(spans: Column) -> Column:
    """Spans of several blocks, overlapping or touching ones made one."""

    def step(done: Column, span: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joins = F.coalesce(last["stop_word"] >= span["first_word"], F.lit(False))
        longer = F.struct(
            last["first_word"].alias("first_word"), F.greatest(last["stop_word"], span["stop_word"]).alias("stop_word"),
            last["first_byte"].alias("first_byte"), F.greatest(last["stop_byte"], span["stop_byte"]).alias("stop_byte"),
        )
        return F.when(joins, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer.cast(_SPAN)))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(f"array<{_SPAN}>"), step)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = 1_000_000) -> DataFrame:
    """``doc_id, n_words, spans, items`` of every row: merged removal spans and the items found.

    Rows that repeat a doc_id are each returned. Null and empty texts have no words.
    An item shorter than the window is one phrase; an item without words is none.
    Other columns are not read.
    """
    spark, parts = docs.sparkSession, []
    for phrases in phrase_blocks(benchmark, window, most):
        hit = hits_udf(spark, phrases)(F.col("text"))
        part = docs.select("doc_id", "text", hit.alias("hit"))
        parts.append(part.select("doc_id", F.sha2("text", 256).alias("_text"), "hit.*"))
    if len(parts) == 1:
        return parts[0].drop("_text")
    # Rows with the same id and text have the same result, so they may share one and be told out again.
    rows = stored(parts[0], "hits")
    for part in parts[1:]:
        rows = rows.unionByName(stored(part, "hits"))
    each = rows.groupBy("doc_id", "_text").agg(
        F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), (F.count("*") / len(parts)).cast("int").alias("_n"),
    )
    told = each.select("doc_id", "n_words", _merged(F.col("spans")).alias("spans"), "items", F.explode(F.array_repeat(F.lit(0), F.col("_n"))))
    return told.drop("col")


def verdicts(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` from ``contamination``.

    A document is contaminated when at least a twentieth of its words are hit.
    """
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop_word"] - s["first_word"])
    listed = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.withColumn("n_hit", n_hit).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@F.arrow_udf(T.StringType())
def without_spans(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """A text without its removal spans."""
    out = []
    for text, gone in zip(texts.to_pylist(), spans.to_pylist()):
        raw, at, left = (text or "").encode(), 0, []
        for span in gone or []:
            left.append(raw[at : span["first_byte"]])
            at = span["stop_byte"]
        out.append(b"".join([*left, raw[at:]]).decode())
    return pa.array(out, pa.string())


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, columns and texts as given.

    One pass over the texts for each block of phrases; the rows never move.
    """
    columns = docs.columns
    phrases = list(phrase_blocks(benchmark))
    hits = unused(columns, *[f"hit{i}" for i in range(len(phrases))])
    beside = docs.withColumns({hit: hits_udf(docs.sparkSession, p)(F.col("text")) for hit, p in zip(hits, phrases)})
    spans = _merged(F.flatten(F.array(*[F.col(hit)["spans"] for hit in hits])))
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop_word"] - s["first_word"])
    return beside.where(~((n_hit > 0) & (20 * n_hit >= F.col(hits[0])["n_words"]))).select(*columns)
