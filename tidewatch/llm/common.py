"""Shared pieces: written tables that cut lineage, and texts as byte arrays inside a task."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import scratch_dir

#: The characters the contracts call white space: tab to carriage return, and space.
BLANKS = " \t\n\x0b\f\r"

#: Bytes of text a task turns into arrays at a time; a longer single text is one piece.
#: The arrays take up to a hundred times the room of their text.
PIECE_BYTES = 1 << 19


def workspace(spark: SparkSession, name: str) -> str:
    """A new folder in the shared scratch folder."""
    return f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage like a checkpoint, and unlike one it lets the planner see the
    real size, so a later join is only broadcast when the table is known to be small.
    """
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until it is none of the columns (names are compared without case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hex64(value: Column) -> Column:
    """A long as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(value)), 16, "0")


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and where each starts (one entry more than texts)."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, ends, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(ends, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(texts: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``text_bytes`` of runs of whole texts of about ``most`` bytes, in order."""
    data, at = text_bytes(texts)
    first, count = 0, len(at) - 1
    while first < count:
        last = int(np.searchsorted(at, at[first] + most, "right")) - 1
        last = min(max(last, first + 1), count)
        yield data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def byte_set(pattern: str) -> np.ndarray:
    """A table of 256 booleans from characters and ``a-b`` ranges of byte values."""
    table = np.zeros(256, bool)
    for part in pattern.split():
        low, _, high = part.partition("-")
        table[int(low, 16) : int(high or low, 16) + 1] = True
    return table


#: Bytes of words for contamination: digits, lower-case letters, all of non-ASCII.
WORD_BYTES = byte_set("30-39 61-7A 80-FF")
#: Bytes of words between white space.
SOLID_BYTES = ~byte_set("09-0D 20")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return _LOWER[data]


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the number of the text that holds it."""
    solid = kind[data]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    if len(data):
        before[0] = after[-1] = False
        before[1:], after[:-1] = solid[:-1], solid[1:]
        before[cuts] = after[cuts - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(at, start, "right") - 1
