"""Ranked lexical search, term at a time, with a limit on accumulators.

``index`` turns runs of documents into segments: the terms of their texts, and for each
term the documents that hold it. ``search`` reads every segment with the terms of all
queries. In a segment a query's terms are taken rarest first. Each adds to the scores of
the documents that hold it, and makes accumulators for those that have none, until the
most that all remaining terms could give is less than the k-th best partial score; from
then on only documents that have an accumulator are added to, with every term, so their
scores are exact. The k-th score of the segments a task has read before counts too. The
best k of each task meet in Spark.

The frequency of a term in the corpus, which sets its weight and its place in the order,
is summed over all segments first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored
from tidewatch.operators.spread import top_k

#: Bytes of text whose documents share a segment (one longer text is a segment of its own).
SEGMENT_BYTES = 16 << 20
#: What a document counts for beside its text.
_DOC_BYTES = 64
#: Bytes of query terms handed to the tasks at a time; more queries are searched in several goes.
QUERY_BYTES = 8 << 20
#: Digits, letters and all of non-ASCII, as bytes of UTF-8; upper case A-Z is gone by then.
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bits that hold a document's place in its segment.
_PLACE_BITS = 24

SEGMENT = pa.schema([
    ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n_docs", pa.int64()), ("n_terms", pa.int64()),
    ("terms", pa.list_(pa.string())), ("holders", pa.list_(pa.int32())), ("places", pa.binary()), ("times", pa.binary()), ("n", pa.int64()),
])
_SEGMENT_DDL = (
    "doc_ids array<long>, sizes array<long>, n_docs long, n_terms long, terms array<string>, holders array<int>, places binary, times binary, n long"
)


def _pack(values: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(values, np.int32).tobytes(), "zstd", asbytes=True)


def _unpack(packed, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed, n * 4, "zstd", asbytes=True), np.int32).astype(np.int64)


def terms_of(raw: bytes) -> list[bytes]:
    """The terms of a text, repeats included, as bytes of UTF-8."""
    return _TERM.findall(raw.lower())  # bytes have only A-Z lower-cased


class _Segment:
    """Documents whose terms are gathered before they are written."""

    def __init__(self) -> None:
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.known: dict[bytes, int] = {}
        self.keys: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, raw: bytes) -> None:
        words = terms_of(raw)
        self.bytes += len(raw) + _DOC_BYTES
        if not words:
            return
        known = self.known
        numbers = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        self.keys.append(numbers << _PLACE_BITS | len(self.sizes))
        self.doc_ids.append(doc_id)
        self.sizes.append(len(words))

    def row(self) -> pa.RecordBatch:
        keys, times = np.unique(np.concatenate(self.keys), return_counts=True)
        places = keys & ((1 << _PLACE_BITS) - 1)
        holders = np.bincount(keys >> _PLACE_BITS, minlength=len(self.known))
        return pa.RecordBatch.from_pylist([{
            "doc_ids": self.doc_ids, "sizes": self.sizes, "n_docs": len(self.sizes), "n_terms": sum(self.sizes),
            "terms": pa.array(list(self.known), pa.binary()).cast(pa.string()), "holders": holders.astype(np.int32),
            "places": _pack(np.diff(places, prepend=0)), "times": _pack(times), "n": len(keys),
        }], SEGMENT)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    segment = _Segment()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if text.is_valid:
                segment.add(doc_id, text.as_buffer().to_pybytes())
            if segment.bytes >= SEGMENT_BYTES:
                if segment.sizes:
                    yield segment.row()
                segment = _Segment()
    if segment.sizes:
        yield segment.row()


def index(docs: DataFrame) -> DataFrame:
    """Segments of all terms of all texts of ``doc_id, text``, written to the shared folder.

    Null texts and those without a term are in no segment. Other columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(slim.mapInArrow(_segments, _SEGMENT_DDL), "segments")


def query_terms(items: DataFrame) -> DataFrame:
    """``item_id, term``: the terms of each item, once each; rows that repeat an item_id are one item."""
    low = F.translate(F.col("text").cast("string"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.expr(r"regexp_extract_all(low, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', 0)")
    return items.select("item_id", low.alias("low")).select("item_id", F.explode(terms).alias("term")).distinct()


def weight(n_docs: int, holders: Column) -> Column:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))), in doubles."""
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n_docs + 2.0) / (F.lit(2.0) * holders + F.lit(1.0)))).cast("long")


def damping(sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What a text's length adds to its count of a term: 50 + (50 n N) div L."""
    if 50 * int(sizes.max(initial=0)) * n_docs < 1 << 63:
        return 50 + (50 * sizes * n_docs) // n_terms
    return np.array([50 + 50 * n * n_docs // n_terms for n in sizes.tolist()], np.int64)


def best_of_segment(
    query: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, doc_ids: np.ndarray, unnamed: np.ndarray, k: int, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best documents of a segment for one query, best first.

    ``query`` has for each term, rarest first, the documents that hold it, what it gives
    each of them, and the most of that. Scores under ``least`` need not be found.
    """
    score = np.zeros(n_docs, np.int64)
    met = np.zeros(n_docs, bool)
    remaining = sum(most for _, _, most in query)
    making = True
    for places, gives, most in query:
        if making:
            if np.count_nonzero(met) >= k:
                partial = score[met]
                least = max(least, int(np.partition(partial, len(partial) - k)[len(partial) - k]))
            making = remaining >= least  # an equal score may still win by its doc_id
        if making:
            score[places] += gives
            met[places] = True
        else:
            had = met[places]
            score[places[had]] += gives[had]
        remaining -= most
    found = np.flatnonzero(score > 0)
    if len(found) > k:
        bar = np.partition(score[found], len(found) - k)[len(found) - k]
        found = found[score[found] >= bar]
    order = np.lexsort((doc_ids[found], unnamed[found], -score[found]))[:k]
    return found[order], score[found[order]]


def _searcher(shared, n_docs: int, n_terms: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, items, item_at, item_terms = shared.value
        wanted = pa.array(terms, pa.string())
        best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))] * len(items)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                sizes = row["sizes"].values.to_numpy()
                named = row["doc_ids"].values
                doc_ids, unnamed = pc.fill_null(named, 0).to_numpy(), pc.is_null(named).to_numpy(zero_copy_only=False)
                at = np.r_[0, np.cumsum(row["holders"].values.to_numpy().astype(np.int64))]
                n = row["n"].as_py()
                places = np.cumsum(_unpack(row["places"].as_buffer(), n))
                times = _unpack(row["times"].as_buffer(), n)
                slow = 20 * damping(sizes, n_docs, n_terms)
                held = pc.index_in(wanted, value_set=row["terms"].values)
                given: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
                for t, place in enumerate(held.to_pylist()):
                    if place is not None:
                        docs, tf = places[at[place] : at[place + 1]], times[at[place] : at[place + 1]]
                        gives = int(weights[t]) * ((1_000_000_000 * tf) // (1000 * tf + slow[docs]))
                        given[t] = (docs, gives, int(gives.max()))
                for q in range(len(items)):
                    query = [given[t] for t in item_terms[item_at[q] : item_at[q + 1]].tolist() if t in given]
                    if not query:
                        continue
                    ids, none, scores = best[q]
                    found, got = best_of_segment(query, len(sizes), doc_ids, unnamed, k, int(scores[-1]) if len(scores) == k else 0)
                    ids, none, scores = np.r_[ids, doc_ids[found]], np.r_[none, unnamed[found]], np.r_[scores, got]
                    order = np.lexsort((ids, none, -scores))[:k]
                    best[q] = ids[order], none[order], scores[order]
        for item, (ids, none, scores) in zip(items, best):
            if len(ids):
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array([item] * len(ids), pa.int64()), "doc_id": pa.array(ids, pa.int64(), mask=none), "score": pa.array(scores, pa.int64()),
                })

    return search


def search(segments: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of each row of ``item_id, text`` with a score above 0.

    Equal scores are ranked by doc_id, rows without one last. Rows that repeat an item_id
    are one item with the terms of all of them; so are rows without one. Items without a
    term that is in the corpus have no rows. Documents that repeat a doc_id are ranked each.
    Queries come in goes of a bounded size, each of which reads the segments once.
    """
    spark = segments.sparkSession
    whole = segments.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = int(whole[0] or 0), int(whole[1] or 0)
    asked = query_terms(items)
    held = segments.select(F.explode(F.arrays_zip("terms", "holders")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.holders").alias("n"))
    wanted = stored(asked, "query-terms")
    holders = held.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    # Items get numbers of their own, so that an item_id of any type, or none, can be carried.
    number = F.xxhash64(F.col("item_id").isNull(), F.col("item_id").cast("string"))
    known = wanted.join(holders, "term").select("item_id", number.alias("item"), "term", "df", weight(n_docs, F.col("df")).alias("w"))
    known = stored(known, "known-terms")
    size = known.agg(F.sum(F.octet_length("term") + F.lit(32))).first()[0] or 0
    goes = max(1, -(-int(size) // QUERY_BYTES))
    found = None
    for go in range(goes):
        rows = known.where(F.pmod(F.hash("item"), F.lit(goes)) == go).select("item", "term", "df", "w").toArrow()
        shared = spark.sparkContext.broadcast(_queries(rows))  # of about QUERY_BYTES, whatever the documents
        mine = segments.mapInArrow(_searcher(shared, n_docs, n_terms, k), "item long, doc_id long, score long")
        found = mine if found is None else found.unionByName(mine)
    ranked = top_k(found.withColumn("_row", F.monotonically_increasing_id()), ["item"], [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("_row")], k)
    names = known.select("item", "item_id").distinct()
    return ranked.join(names, "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def _queries(rows: pa.Table) -> tuple[list[str], np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Terms, their weights, items, and for each item the places of its terms, rarest first."""
    terms = sorted(set(rows.column("term").to_pylist()))
    place = {t: n for n, t in enumerate(terms)}
    weights, items = np.zeros(len(terms), np.int64), {}
    for item, term, df, w in zip(*(rows.column(c).to_pylist() for c in ("item", "term", "df", "w"))):
        weights[place[term]] = w
        items.setdefault(item, []).append((df, place[term]))
    order = [sorted(some) for some in items.values()]
    flat = np.array([t for some in order for _, t in some], np.int64)
    return terms, weights, list(items), np.r_[0, np.cumsum([len(some) for some in order], dtype=np.int64)], flat
