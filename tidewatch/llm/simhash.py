"""Near-duplicates by SimHash: fingerprints within two differing bits are linked.

Meet in the middle: two fingerprints at most ``2 r`` bits apart share a variant that
is at most ``r`` bits from both.  So every distinct fingerprint emits all variants
within ``r = 1`` (itself and 64 others), rows meet on the variant, and neighbours in
a variant's group are linked after their distance has been checked.  A group holds
only distinct fingerprints one bit from its variant, 65 at most, however many copies
the documents have, so no group grows with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import SOLID_BYTES, hex64, lowered, pieces, stored, unused, words
from tidewatch.llm.components import components
from tidewatch.llm.xxh import xxh64

BITS = 64


def shingle_hashes(data: np.ndarray, at: np.ndarray, shingle: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """XXH64 of the word shingles of all texts, where each text's begin, and the texts that have words."""
    start, end, text = words(data, at, SOLID_BYTES)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    # All words with one space after each, so that a shingle is one range of bytes.
    size = end - start
    new_end = np.cumsum(size + 1) - 1
    new_start = new_end - size
    solid = np.ones(int(new_end[-1]) + 1, bool)
    solid[new_end] = False
    packed = np.full(len(solid), 0x20, np.uint8)
    packed[solid] = lowered(data)[SOLID_BYTES[data]]
    # A text of n words has max(n - shingle + 1, 1) shingles, the first words starting them.
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    count = np.diff(np.r_[first, len(text)])
    shingles = np.maximum(count - shingle + 1, 1)
    begins = np.cumsum(shingles) - shingles
    word = np.arange(int(shingles.sum())) - np.repeat(begins - first, shingles)
    last = np.minimum(word + shingle, np.repeat(first + count, shingles)) - 1
    return xxh64(packed, new_start[word], new_end[last] - new_start[word], seed), begins, text[first]


def text_fingerprints(data: np.ndarray, at: np.ndarray, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text from the XXH64 of its word shingles, repeats included."""
    out = np.zeros(len(at) - 1, np.uint64)
    hashes, begins, texts = shingle_hashes(data, at, shingle, seed)
    if not len(hashes):
        return out
    shingles = np.diff(np.r_[begins, len(hashes)])
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(ones, begins, axis=0, dtype=np.int64)
    bits = np.packbits(2 * sums > shingles[:, None], axis=1, bitorder="little")
    out[texts] = np.ascontiguousarray(bits).view("<u8").ravel()
    return out


def fingerprint_udf(shingle: int = 3, seed: int = 42):
    @F.arrow_udf("long")
    def fingerprint(texts: pa.Array) -> pa.Array:
        parts = [text_fingerprints(data, at, shingle, seed) for data, at in pieces(texts)]
        return pa.array(np.concatenate(parts).view(np.int64) if parts else [], pa.int64())

    return fingerprint


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row. Null and empty texts have fingerprint zero."""
    return docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf()(F.col(text_col)).alias("fp"))


def links(fps: DataFrame) -> DataFrame:
    """Linked pairs ``src, dst`` between distinct fingerprints (column ``fp``).

    Not every pair: the members of a variant's group are linked in a chain, which
    joins the same fingerprints together. Every pair within two bits meets in a group.
    """
    ball = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(BITS)])
    emitted = fps.select("fp", F.explode(ball).alias("variant"))
    met = emitted.withColumn("src", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")))
    close = F.bit_count(F.col("src").bitwiseXOR(F.col("fp"))) <= 2
    return met.where(F.col("src").isNotNull() & close).select("src", F.col("fp").alias("dst")).distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    ``component_id`` is the smallest doc_id that can be reached over links, the
    document itself included. Rows without a doc_id take part and never name a
    component unless nothing else is in it (then NULL). Repeated rows are all
    returned. An empty table gives an empty result. Other columns are not read.
    """
    slim = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    each = stored(slim.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "distinct")
    grouped = components(stored(links(each.select("fp")), "links"))
    # Only fingerprints that have a link are looked up; the others are their own component.
    joined = grouped.join(each, grouped.node == each.fp).select("fp", "root", "smallest")
    least = joined.groupBy("root").agg(F.min("smallest").alias("least"))
    linked = joined.join(least, "root").select("fp", "least")
    named = each.join(linked, "fp", "left").select("fp", F.coalesce("least", "smallest").alias("component_id"))
    named = stored(named, "named")
    return slim.join(named, "fp", "left").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """Documents of which none with a smaller doc_id is linked; columns as given.

    Of rows that repeat a doc_id one stays. Rows without a doc_id stay if no
    document with one is in their component, one row for each fingerprint.
    """
    found = near_duplicates(docs)
    alone = found.where("component_id IS NULL").select("fingerprint")
    keepers = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id")
    return kept_rows(docs, keepers, alone, hex64(fingerprint_udf()(F.col("text"))))


def kept_rows(docs: DataFrame, keepers: DataFrame, alone: DataFrame, print_of: Column) -> DataFrame:
    """A row for each doc_id in ``keepers``, and of rows without one a row for each print in ``alone`` (one column each)."""
    kept = keepers.where("doc_id IS NOT NULL").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    (fp,) = unused(docs.columns, "fp")
    bare = docs.where("doc_id IS NULL").withColumn(fp, print_of)
    rest = bare.join(alone.toDF(fp).distinct(), fp, "left_semi").dropDuplicates([fp])
    return named.select(*docs.columns).unionByName(rest.select(*docs.columns))
