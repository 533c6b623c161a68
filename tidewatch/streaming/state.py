"""Streams whose state Spark keeps: health, snapshots and the notice log.

A source's health and a page's snapshot are keyed state: each micro-batch hands a key's
new rows to a small fold, and Spark's state store and checkpoint hold what is between.
Rows no newer than the last one folded are ignored, so rows that come late or twice never
undo what came after them. Folds emit the keys they changed; a batch writes them into a
folder of its own number, so a batch that runs again writes the same rows, and the newest
row of each key is the state.

The notice log needs no fold: what lands again is dropped within a watermark as long as the
log is kept, and what a reader got on a day is a window over it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewatch import schemas
from tidewatch.functions import lexicon as L
from tidewatch.operators import extract, release
from tidewatch.operators.spread import first_per_key
from tidewatch.sources import tables

# The folds travel to the executors by value, so the package need not be there.
register_pickle_by_value(sys.modules[__name__])

_THIN = L.THIN_CHARS
_HEALTH_STATE = schemas.HEALTH.removeprefix("url string, ")
_SNAPSHOT_STATE = schemas.STREAM_SNAPSHOTS.removeprefix("url string, ")


def _plain(value):
    """A value of pandas as one of Python, its missing ones as None."""
    if isinstance(value, pd.Timestamp):
        return value.to_pydatetime()
    if value is None or value is pd.NaT or (isinstance(value, float) and pd.isna(value)):
        return None
    return value.item() if hasattr(value, "item") else value


def _fresh(frames: Iterator[pd.DataFrame], seen, order: list[str]) -> pd.DataFrame:
    """A key's rows of this batch that are newer than what was folded, in order."""
    kept = [f if seen is None else f[f["fetched_at"] > seen] for f in frames]
    return pd.concat(kept).sort_values(order, kind="stable")


def _health_step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    attempt, success, failures, error, _ = state.get if state.exists else (None, None, 0, None, None)
    rows = _fresh(frames, attempt, ["fetched_at", "seq"])
    if not len(rows):
        return
    good = rows["ok"].to_numpy(bool).nonzero()[0]
    if len(good):
        failures, success = len(rows) - 1 - int(good[-1]), _plain(rows["fetched_at"].iloc[good[-1]])
    else:
        failures += len(rows)
    attempt = _plain(rows["fetched_at"].iloc[-1])
    error = _plain(rows["error"].iloc[-1]) if failures else None
    name = "healthy" if failures == 0 else "degraded" if failures <= 5 else "broken"
    now = (attempt, success, failures, error, name)
    state.update(now)
    yield pd.DataFrame([(key[0], *now)], columns=["url", "last_attempt", "last_success", "consecutive_failures", "last_error", "state"])


def health_updates(log: DataFrame) -> DataFrame:
    """Health of the sources that a stream of ``url, fetched_at, seq, ok, error`` changes, as in ``health.failure_streaks``."""
    slim = log.select("url", "fetched_at", "seq", "ok", "error")
    return slim.groupBy("url").applyInPandasWithState(_health_step, schemas.HEALTH, _HEALTH_STATE, "update", GroupStateTimeout.NoTimeout)


def _snapshot_step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in _SNAPSHOT_STATE.split(", ")]
    held = dict(zip(names, state.get)) if state.exists else dict.fromkeys(names)
    if held["block_hashes"] is not None:
        held["block_hashes"] = list(held["block_hashes"])
    rows = _fresh(frames, held["last_attempt"], ["fetched_at", "run_id"]).drop_duplicates("fetched_at", keep="last")
    if not len(rows):
        return
    for at, outcome, found, chars, method in rows[["fetched_at", "outcome", "hash", "chars", "method"]].itertuples(index=False):
        held["last_attempt"] = _plain(at)
        if outcome == "ok":
            changed = found != held["content_hash"]
            if changed:
                held.update(content_hash=found, last_changed=_plain(at), pending=True, judge_failures=None)
            held["thin_runs"] = (held["thin_runs"] or 0) + 1 if chars < _THIN and not changed else 0
            held.update(extracted_chars=int(chars), extraction_method=method, first_seen=held["first_seen"] or _plain(at))
        elif outcome == "unreadable":  # its history stays; the next good reading counts as a change
            held["content_hash"] = None
    held["block_hashes"] = held["block_hashes"] or []
    held["pending"] = held["pending"] if held["pending"] is not None else (False if held["first_seen"] else None)
    now = tuple(held[n] for n in names)
    state.update(now)
    if held["first_seen"] is not None:  # a page never read yet has no snapshot
        yield pd.DataFrame([(key[0], *now)], columns=["url", *names])


def snapshot_updates(fetches: DataFrame) -> DataFrame:
    """Snapshots of the pages that a stream of landed fetches reads, each reading folded in turn as in ``diff.fold_snapshots``."""
    read = extract.extract(tables.admit(fetches), once=False)
    verdict = extract.readability(F.col("ok"), F.col("error"), F.lit(None).cast("string"), F.col("title"), F.col("text"))
    readings = read.select(
        "url", "fetched_at", F.coalesce("run_id", F.lit("")).alias("run_id"), verdict["outcome"].alias("outcome"), "hash", "chars", "method"
    )
    return readings.groupBy("url").applyInPandasWithState(
        _snapshot_step, schemas.STREAM_SNAPSHOTS, _SNAPSHOT_STATE, "update", GroupStateTimeout.NoTimeout
    )


def sent_once(sends: DataFrame, days: int = L.LOG_RETENTION_DAYS) -> DataFrame:
    """A stream of ``reader_id, key, sent_at, via`` in which a send that lands again is dropped.

    A send without a channel was a push. What is older than the log is kept, counted from
    the newest send of earlier batches, is dropped by the watermark, and with it goes what
    the state remembers.
    """
    whole = sends.withColumn("via", F.coalesce("via", F.lit("push")))
    return whole.withWatermark("sent_at", f"{days} days").dropDuplicatesWithinWatermark(["reader_id", "key", "via", "sent_at"])


def sent_by_day(sends: DataFrame, days: int = L.LOG_RETENTION_DAYS) -> DataFrame:
    """``reader_id, day, openings, others``: pushes of each reader and Riyadh day, from a stream of the log without repeats."""
    opening = F.col("key").rlike(release.OPPORTUNITY_KEY)
    pushes = sends.where(F.coalesce("via", F.lit("push")) == "push").withColumn("local", F.from_utc_timestamp("sent_at", L.ZONE))
    if sends.isStreaming:
        pushes = pushes.withWatermark("local", f"{days} days")
    counted = pushes.groupBy("reader_id", F.window("local", "1 day").alias("w")).agg(
        F.count_if(opening).alias("openings"), F.count_if(~opening).alias("others")
    )
    return counted.select("reader_id", F.col("w.start").cast("date").alias("day"), "openings", "others")


def into(stream: DataFrame, folder: str, name: str, mode: str = "update") -> DataStreamWriter:
    """A writer that puts what each batch changed into a folder of the batch's number."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch_id}")

    return stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/_{name}")


def newest(spark: SparkSession, folder: str, name: str, schema: str, keys: list[str]) -> DataFrame:
    """The last row of each key that the batches wrote."""
    rows = spark.read.schema(f"{schema}, batch long").option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}")
    return first_per_key(rows, keys, -F.col("batch")).drop("batch")


def releasing(waiting: DataFrame, log: DataFrame, as_of: Column, quiet: bool, folder: str) -> DataStreamWriter:
    """A writer that releases each batch of waiting notices against the log as it stands.

    ``log`` is read anew for every batch, so it holds what earlier batches had sent; a
    batch settles all notices of its readers, which one file or key range must hold.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        out = release.release(batch, log, as_of, quiet)
        out.write.mode("overwrite").parquet(f"{folder}/released/batch={batch_id}")

    return waiting.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/_released")
