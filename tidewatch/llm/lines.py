"""Line dedup that can be undone: sharded cuckoo filters over exact reference counts.

The index of a set of documents has three tables: which document holds which line
key (``postings``), the exact count and smallest holder of every key (``refs``), and
per shard of the key space a cuckoo filter of the keys that more than one document
holds (``filters``). Documents are added and taken out; counts follow exactly, keys
enter a filter when a second document comes to hold them and leave it when only one
is left, so deleting what was added gives the index back.

Lines are first asked of the filter of their shard. Most are held once and stop there;
the others are verified against the exact counts.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import stored, unused
from tidewatch.llm.cuckoo import Cuckoo, Full

#: A row without a doc_id counts as the largest.
_NO_ID = (1 << 63) - 1
_KEY_BYTES = 16
_LEAST_CHARS = 10


def line_keys(text: bytes) -> list[bytes | None]:
    """Per line the digest of its key, None where the key is too short to count.

    The first 16 bytes of SHA-256: among 10^12 lines two keys meet with a chance of 10^-15.
    """
    keys = []
    for line in text.split(b"\n"):
        key = line.strip().lower()
        long = len(key) >= _LEAST_CHARS and (key.isascii() or len(key.decode()) >= _LEAST_CHARS)
        keys.append(hashlib.sha256(key).digest()[:_KEY_BYTES] if long else None)
    return keys


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def distinct_keys(texts: pa.Array) -> pa.Array:
    """The keys of a text's lines, each once."""
    out = [list({k: 0 for k in line_keys((t or "").encode()) if k}) for t in texts.to_pylist()]
    return pa.array(out, pa.list_(pa.binary()))


@F.arrow_udf(T.StructType().add("text", T.StringType()).add("n_lines", T.LongType()).add("n_dropped", T.LongType()))
def without_lines(texts: pa.Array, drops: pa.Array) -> pa.Array:
    """A text without the lines whose key is among ``drops`` (null: none)."""
    kept, lines, dropped = [], [], []
    for text, gone in zip(texts.to_pylist(), drops.to_pylist()):
        text = text or ""
        if not gone:
            n = text.count("\n") + 1
            kept.append(text)
            lines.append(n)
            dropped.append(0)
            continue
        gone, parts = set(gone), text.split("\n")
        left = [p for p, k in zip(parts, line_keys(text.encode())) if k not in gone]
        kept.append("\n".join(left))
        lines.append(len(parts))
        dropped.append(len(parts) - len(left))
    return pa.StructArray.from_arrays(
        [pa.array(kept, pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
        ["text", "n_lines", "n_dropped"],
    )


@dataclass
class LineIndex:
    """``postings``: key, doc. ``refs``: key, refs, first, last. ``filters``: shard, cells."""

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


def _hashes(keys: pd.Series) -> np.ndarray:
    """The filter's hash of a key: the first eight bytes of its digest."""
    return np.frombuffer(b"".join(k[:8] for k in keys), "<u8")


def postings(docs: DataFrame) -> DataFrame:
    """``key, doc``: one row per document row and distinct key."""
    held = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc"), distinct_keys(F.col("text")).alias("keys"))
    return held.select(F.explode("keys").alias("key"), "doc")


def _counted(rows: DataFrame) -> DataFrame:
    """Counts are added up where the rows lie first, so a line of every document is one row per task."""
    return rows.groupBy("key").agg(F.count("*").alias("refs"), F.min("doc").alias("first"), F.max("doc").alias("last"))


def _shared(refs: DataFrame) -> DataFrame:
    return refs.where(F.col("first") < F.col("last"))


def _updated_filters(filters: DataFrame, changes: DataFrame, refs: DataFrame, shards: int) -> DataFrame:
    """``filters`` after ``changes`` (key, add): a shard that overflows is filled anew from ``refs``."""

    def apply(key, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        shard = key[0]
        hashes, add = _hashes(new["key"]), new["add"].to_numpy(bool)
        if not len(old):
            cells = Cuckoo.filled(hashes[add])
        else:
            cells = Cuckoo.from_bytes(old["cells"].iloc[0])
            try:
                cells.remove(hashes[~add])
                cells.add(hashes[add])
            except Full:
                return pd.DataFrame({"shard": [shard], "cells": [None]})
        return pd.DataFrame({"shard": [shard], "cells": [cells.to_bytes()]})

    def refill(key, new: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [key[0]], "cells": [Cuckoo.filled(_hashes(new["key"])).to_bytes()]})

    schema = "shard int, cells binary"
    keyed = changes.withColumn("shard", _shard(shards))
    done = stored(filters.groupBy("shard").cogroup(keyed.groupBy("shard")).applyInPandas(apply, schema), "filters")
    over = done.where("cells IS NULL").select("shard")
    if over.isEmpty():
        return done
    again = _shared(refs).select("key", _shard(shards).alias("shard")).join(F.broadcast(over), "shard", "left_semi")
    full = again.groupBy("shard").applyInPandas(refill, schema)
    return stored(done.where("cells IS NOT NULL").unionByName(full), "filters")


def build(docs: DataFrame, shards: int | None = None, shard_keys: int = 1 << 20) -> LineIndex:
    """The index of ``doc_id, text``; other columns are not read.

    ``shards`` defaults to one for every ``shard_keys`` shared keys, so that a shard
    fits a task whatever the number of documents.
    """
    held = stored(postings(docs), "postings")
    refs = stored(_counted(held), "refs")
    shared = _shared(refs)
    shards = shards or max(16, -(-shared.count() // shard_keys))
    none = docs.sparkSession.createDataFrame([], "shard int, cells binary")
    filters = _updated_filters(none, shared.select("key", F.lit(True).alias("add")), refs, shards)
    return LineIndex(held, refs, filters, shards)


def insert(index: LineIndex, docs: DataFrame) -> LineIndex:
    """The index with more documents; their doc_ids must not be in it yet."""
    fresh = stored(postings(docs), "postings")
    was = index.refs.withColumn("old", F.col("first") < F.col("last"))
    both = was.unionByName(_counted(fresh).withColumn("old", F.lit(False)))
    merged = both.groupBy("key").agg(
        F.sum("refs").alias("refs"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("old").alias("old")
    )
    merged = stored(merged, "refs")
    changes = _shared(merged).where("NOT old").select("key", F.lit(True).alias("add"))
    refs = merged.drop("old")
    filters = _with_rest(index, _updated_filters_of(index, changes, refs))
    return LineIndex(index.postings.unionByName(fresh), refs, filters, index.shards)


def delete(index: LineIndex, doc_ids: DataFrame) -> LineIndex:
    """The index without the documents of ``doc_id``, counts and smallest holders as if never added."""
    gone = doc_ids.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc")).distinct()
    touched = stored(index.postings.join(gone, "doc", "left_semi").select("key").distinct(), "touched")
    left = stored(index.postings.join(gone, "doc", "left_anti"), "postings")
    again = _counted(left.join(touched, "key", "left_semi"))
    refs = stored(index.refs.join(touched, "key", "left_anti").unionByName(again), "refs")
    before = _shared(index.refs).select("key").join(touched, "key", "left_semi")
    changes = before.join(_shared(refs).select("key"), "key", "left_anti").withColumn("add", F.lit(False))
    return LineIndex(left, refs, _with_rest(index, _updated_filters_of(index, changes, refs)), index.shards)


def _updated_filters_of(index: LineIndex, changes: DataFrame, refs: DataFrame) -> DataFrame:
    changes = stored(changes, "changes")
    touched = changes.select(_shard(index.shards).alias("shard")).distinct()
    live = index.filters.join(touched, "shard", "left_semi")
    return _updated_filters(live, changes, refs, index.shards)


def _with_rest(index: LineIndex, updated: DataFrame) -> DataFrame:
    rest = index.filters.join(F.broadcast(updated.select("shard")), "shard", "left_anti")
    return stored(rest.unionByName(updated), "filters")


def _known(asked: pa.Table, held: pa.Table) -> pa.Table:
    """The rows whose key the filter of their shard knows; no filter knows none."""
    rows = asked.select(["key", "doc"])
    if not held.num_rows:
        return rows.slice(0, 0)
    cells = Cuckoo.from_bytes(held.column("cells")[0].as_py())
    return rows.filter(pa.array(cells.contains(_hashes(rows.column("key").to_pylist()))))


def screened(index: LineIndex, rows: DataFrame, most: int = 200_000) -> DataFrame:
    """``key, doc`` of the rows whose key the filter of its shard knows: every shared key, and a few by chance.

    Rows go to the filter of their shard; a shard's rows are dealt out by document to as
    many tasks as ``most`` rows each need, and its filter to each of them.
    """
    salts = max(1, -(-rows.count() // (index.shards * most)))
    ask = lambda shard, salt: (shard * salts + salt).alias("ask")
    asked = rows.select("key", "doc", ask(_shard(index.shards), F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int")))
    held = index.filters.select("cells", "shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    held = held.select("cells", ask(F.col("shard"), F.col("salt")))
    return asked.groupBy("ask").cogroup(held.groupBy("ask")).applyInArrow(_known, "key binary, doc long")


def drops(index: LineIndex) -> DataFrame:
    """``doc, keys``: the keys a document loses because a document with a smaller doc_id holds them."""
    asked = screened(index, index.postings)
    verified = asked.join(_shared(index.refs).select("key", "first"), "key").where(F.col("doc") > F.col("first"))
    return verified.select("doc", "key").groupBy("doc").agg(F.collect_set("key").alias("keys"))


def deduped(index: LineIndex, docs: DataFrame, into: str = "kept") -> DataFrame:
    """``docs`` with ``into`` (struct of text, n_lines, n_dropped) beside its columns.

    ``docs`` are documents of the index and have no column ``into``. Null and empty texts
    are one empty line. Rows that repeat a doc_id count as one document: none of them
    loses a line to another.
    """
    doc, keys = unused([*docs.columns, into], "doc", "keys")
    gone = drops(index).toDF(doc, keys)
    joined = docs.join(gone, F.coalesce("doc_id", F.lit(_NO_ID)) == F.col(doc), "left")
    return joined.withColumn(into, without_lines(F.col("text"), F.col(keys))).drop(doc, keys)


def line_dedup(docs: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256, text`` of every row, its text without the dropped lines."""
    slim = docs.select("doc_id", "text")
    kept = deduped(build(slim), slim)
    return kept.select(
        "doc_id", F.col("kept.n_lines").alias("n_lines"), F.col("kept.n_dropped").alias("n_dropped"),
        F.sha2("kept.text", 256).alias("kept_sha256"), F.col("kept.text").alias("text"),
    )
