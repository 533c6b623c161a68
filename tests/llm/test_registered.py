"""Registered queries against their SQL, and the pipeline against its stages by hand."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F
from test_near_copies import brute_components as near_components
from test_text_operators import brute_hits, brute_lines, brute_targets

import __spark_entry__ as entry
import corpus_pipeline
from tidewatch.llm import quality
from tidewatch.llm.queries import ORACLES, QUERIES
from tidewatch.plans.registry import table

TABLES = ["documents", "pages", "benchmark", "labels", "conversations"]


def rows_of(columns, rows):
    def norm(v):
        return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v

    return sorted(str([norm(r[c]) for c in sorted(columns)]) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = QUERIES[name](spark, sf)
    said = con.sql(ORACLES[name])
    want = [dict(zip(said.columns, r)) for r in said.fetchall()]
    assert sorted(got.columns) == sorted(said.columns)
    assert rows_of(got.columns, [r.asDict() for r in got.collect()]) == rows_of(got.columns, want)


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_each_stage_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    columns, state = docs.columns, {r.doc_id: r for r in docs.collect()}
    for step, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = spark.createDataFrame(list(state.values()), docs.schema)
        made = stage(spark, given, sf)
        after = {r.doc_id: r for r in made.collect()}
        rows = [(i, r.text, r.source) for i, r in sorted(state.items())]
        if step < 4:
            assert made.columns == columns, name
        if step == 0:
            scores = {r.doc_id: r.score for r in quality.classify(given, table(spark, sf, "labels")).collect()}
            assert set(after) == {i for i in state if scores[i] >= 0.3}
            truth = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect() if r.doc_id in state}
            assert sum((i in after) == (q == 1) for i, q in truth.items()) / len(truth) > 0.97
        elif step == 1:
            assert {i: r.text for i, r in after.items()} == {i: w[2] for i, w in brute_lines(rows).items()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        elif step == 2:
            assert set(after) == {c for _, c in near_components([(i, t) for i, t, _ in rows])}
        elif step == 3:
            items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
            assert set(after) == {i for i, w in brute_hits(rows, items).items() if not w[4]}
        else:
            sizes = {}
            for _, text, source in rows:
                sizes[source] = sizes.get(source, 0) + len((text or "").split())
            want = brute_targets(sizes)
            for source, goal in want.items():
                got = sum(r.taken for r in after.values() if r.source == source)
                biggest = max(len((t or "").split()) for _, t, s in rows if s == source)
                assert abs(got - goal) <= biggest, (source, got, goal)
        state = {i: r for i, r in after.items()} if step < 4 else state


def test_the_whole_pipeline_is_its_stages(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    one = corpus_pipeline.run(spark, sf)
    assert one.columns == docs.columns
    assert sorted(map(str, one.select("doc_id", "taken", F.sha2("text", 256)).collect())) == sorted(
        map(str, docs.select("doc_id", "taken", F.sha2("text", 256)).collect()))


#: Names that operators give columns of their own.
INNER = ["kept", "score", "_score", "hit0", "_hit0", "doc", "keys", "_doc", "_keys", "node", "bands", "hub", "block", "root", "smallest", "component_id",
         "fp", "_fp", "row", "figures", "size", "target", "taken", "copies", "source_size", "_id", "_mix", "key", "shard", "ask", "bucket", "deal", "y", "_h"]


def test_stages_leave_columns_that_bear_inner_names(spark, sf):
    docs = table(spark, sf, "documents").limit(60).withColumns({c: F.concat(F.lit(f"{c} of "), "doc_id") for c in INNER})
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    for step, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, sf)
        names = {c: (f"given_{c}" if c in ("size", "target", "taken", "copies", "source_size") and step == 4 else c) for c in INNER}
        assert step == 4 or made.columns == docs.columns
        rows = made.collect()
        assert rows and all(r[names[c]] == f"{c} of {r.doc_id}" for r in rows for c in INNER)
