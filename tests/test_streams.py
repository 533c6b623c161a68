"""Streams on Spark's own state against the batch operators on the same rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from test_rounds import body, fetches

from __spark_entry__ import queries
from tidewatch import schemas
from tidewatch.operators import diff, extract, health, release
from tidewatch.plans.registry import table_stream
from tidewatch.sources import tables
from tidewatch.streaming import state

BASE = dt.datetime(2026, 1, 1)


def land(folder, *frames):
    """Each frame is a file, read as one micro-batch."""
    for frame in frames:
        frame.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_health_equals_the_batch_and_late_rows_change_nothing(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(f"u{rnd.randrange(7)}", BASE + dt.timedelta(minutes=i), i, rnd.random() < 0.4, None) for i in range(600)]
    log = spark.createDataFrame([(*r[:4], None if r[3] else f"e{r[2] % 3}") for r in rows], schemas.FETCH_LOG)
    parts = [log.where((F.col("seq") >= k * 200) & (F.col("seq") < (k + 1) * 200)) for k in range(3)]
    landed, folder = str(tmp_path / "log"), str(tmp_path / "state")
    land(landed, *parts)
    run(state.into(state.health_updates(stream(spark, landed, schemas.FETCH_LOG)), folder, "health"))
    want = {r.url: r.asDict() for r in health.failure_streaks(log).collect()}
    now = lambda: {r.url: r.asDict() for r in state.newest(spark, folder, "health", schemas.HEALTH, ["url"]).collect()}
    assert now() == want
    # The same rows once more, and one older than all: the stream goes on from its checkpoint and changes nothing.
    land(landed, parts[1], spark.createDataFrame([("u1", BASE - dt.timedelta(days=1), 9999, True, None)], schemas.FETCH_LOG))
    run(state.into(state.health_updates(stream(spark, landed, schemas.FETCH_LOG)), folder, "health"))
    assert now() == want
    land(landed, spark.createDataFrame([("u1", BASE + dt.timedelta(days=1), 1, True, None)], schemas.FETCH_LOG))
    run(state.into(state.health_updates(stream(spark, landed, schemas.FETCH_LOG)), folder, "health"))
    assert now()["u1"]["state"] == "healthy" and {u: r for u, r in now().items() if u != "u1"} == {u: r for u, r in want.items() if u != "u1"}


def test_snapshots_equal_rounds_folded_one_by_one(spark, tmp_path):
    long = "This sentence is long enough to be a block of its own. "
    days = [
        [("a", long * 8), ("b", long * 2), ("c", "short")], [("a", long * 8), ("b", long * 2), ("c", "short")],
        [("a", "Other words begin here. " + long * 8), ("b", "no"), ("d", long * 9)], [("b", long * 2), ("c", long * 3)],
    ]
    rounds = [fetches(spark, [(f"https://{u}.sa/", body(t)) for u, t in some], f"2026-08-0{n + 1} 09:00:00") for n, some in enumerate(days)]
    want = spark.createDataFrame([], schemas.SNAPSHOTS)
    for one in rounds:
        read = extract.extract(tables.admit(one))
        verdict = extract.readability(F.col("ok"), F.col("error"), F.lit(None).cast("string"), F.col("title"), F.col("text"))
        readings = read.select("url", F.lit(None).cast("string").alias("org_id"), "fetched_at", verdict["outcome"].alias("outcome"), "hash",
                               F.array().cast("array<string>").alias("fresh_hashes"), "chars", "method", F.lit(False).alias("stale_wording"))
        want = spark.createDataFrame(diff.fold_snapshots(readings, want).collect(), schemas.SNAPSHOTS)
    landed, folder = str(tmp_path / "fetches"), str(tmp_path / "state")
    late = fetches(spark, [("https://a.sa/", body("Older words. " + long * 7))], "2026-07-01 09:00:00")
    # The first two rounds come in one batch; the second comes again later, and one fetch comes late.
    land(landed, rounds[0].unionByName(rounds[1]), rounds[2], rounds[1], rounds[3], late)
    run(state.into(state.snapshot_updates(stream(spark, landed, schemas.PAGES)), folder, "snapshots"))
    got = state.newest(spark, folder, "snapshots", schemas.STREAM_SNAPSHOTS, ["url"]).drop("last_attempt")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))


def test_a_send_is_logged_once_while_the_log_remembers(spark, tmp_path):
    send = lambda reader, key, day, via: (reader, key, BASE + dt.timedelta(days=day), via)
    first = [send(1, "new:a", 0, None), send(1, "new:a", 0, "digest"), send(2, "new:a", 1, "push")]
    again = [send(1, "new:a", 0, "push"), send(1, "new:a", 3, "push"), send(1, "new:b", 20, None)]
    later = [send(1, "new:a", 60, "push"), send(1, "new:b", 60, "toast")]
    old = [send(5, "new:late", 40, "push"), send(5, "new:gone", 2, "push"), send(1, "new:a", 3, "push")]
    landed, folder = str(tmp_path / "sends"), str(tmp_path / "state")
    land(landed, *[spark.createDataFrame(rows, schemas.NOTICE_LOG) for rows in (first, again, first, later, later, old)])
    run(state.into(state.sent_once(stream(spark, landed, schemas.NOTICE_LOG)), folder, "log", "append"))
    got = sorted((r.reader_id, r.key, (r.sent_at - BASE).days, r.via) for r in spark.read.parquet(f"{folder}/log").collect())
    assert got == sorted((r, k, (t - BASE).days, v or "push") for r, k, t, v in [*first, *again[1:], *later, old[0]])


@pytest.mark.parametrize("streaming", [False, True])
def test_sends_by_reader_and_riyadh_day(spark, tmp_path, streaming):
    at = lambda h: BASE + dt.timedelta(hours=h)
    rows = [(1, "new:a", at(20), None), (1, "seats:a", at(22), "push"), (1, "broken:b", at(22), "push"), (1, "new:c", at(23), "toast"), (2, "new:a", at(1), "push")]
    log = spark.createDataFrame(rows, schemas.NOTICE_LOG)
    if streaming:
        landed, folder = str(tmp_path / "sends"), str(tmp_path / "state")
        land(landed, log.limit(2), log.exceptAll(log.limit(2)))
        run(state.into(state.sent_by_day(stream(spark, landed, schemas.NOTICE_LOG)), folder, "days"))
        got = state.newest(spark, folder, "days", "reader_id long, day date, openings long, others long", ["reader_id", "day"])
    else:
        got = state.sent_by_day(log)
    assert sorted((r.reader_id, r.day.day, r.openings, r.others) for r in got.collect()) == [(1, 1, 1, 0), (1, 2, 1, 1), (2, 1, 1, 0)]
    for day in (1, 2):
        instant = F.lit(f"2026-01-0{day} 12:00:00").cast("timestamp")
        want = {(r.reader_id, r._sent_openings, r._sent_others) for r in release.sent_today(log, instant, ["reader_id"]).collect()}
        assert {(r.reader_id, r.openings, r.others) for r in got.collect() if r.day.day == day} == want


def test_a_streamed_table_is_one_file_or_a_folder_of_parts(spark, tmp_path):
    rows = spark.range(40).withColumn("word", F.concat(F.lit("w"), F.col("id").cast("string")))
    rows.repartition(4).write.parquet(str(tmp_path / "folder" / "things.parquet"))
    rows.repartition(2).write.parquet(str(tmp_path / "folder" / "others.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "made"))
    (tmp_path / "file").mkdir()
    next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "file" / "things.parquet")
    for form in ("folder", "file"):
        streamed = table_stream(spark, str(tmp_path / form), "things")
        assert streamed.isStreaming
        run(state.into(streamed, str(tmp_path / f"{form}-state"), "seen", "append"))
        got = spark.read.parquet(str(tmp_path / f"{form}-state" / "seen"))
        assert sorted((r.id, r.word) for r in got.collect()) == [(i, f"w{i}") for i in range(40)]


def test_snapshots_read_pages_in_a_folder(spark, sf, tmp_path):
    some = spark.read.parquet(f"{sf}/pages.parquet").limit(12)
    some.repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    got = [r.page_id for r in queries()["stream_snapshots"](spark, str(tmp_path)).collect()]
    assert got and len(set(got)) == len(got) and set(got) <= {r.page_id for r in some.select("page_id").collect()}
