"""The corpus pipeline and the registered queries on the small tables."""

import sys
from pathlib import Path

import corpus
import duckdb
import pytest
from pyspark.sql import functions as F
from test_native import _many

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from gaugeflow.llm import mixing, queries  # noqa: E402
from gaugeflow.llm.common import with_row_ids  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small, name):
    db = duckdb.connect()
    for table in Path(small).glob("*.parquet"):
        db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    cursor = db.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    result = queries.QUERIES[name](spark, small)
    assert sorted(result.columns) == sorted(columns)
    rows = result.select(*columns).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, cursor.fetchall()))


def test_row_ids(spark):
    docs = corpus.documents(spark, [*corpus.rows(), (None, "x", "a"), (None, "x", "b"), (5, "other", "a")])
    ids = with_row_ids(docs).select("doc_id", "_row").collect()
    assert len({r["_row"] for r in ids}) == docs.count()
    assert all(r["_row"] == r["doc_id"] or r["_row"] < 0 for r in ids)
    again = with_row_ids(docs.repartition(3)).select("_row").collect()
    assert {r["_row"] for r in ids} == {r["_row"] for r in again}


def test_stages_keep_the_columns_and_act(spark, medium):
    docs = corpus.documents(spark, [*corpus.rows(), (None, "no id", "a"), (None, "no id", "a")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, medium)
        assert out.columns == docs.columns, name
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, corpus.empty(spark), medium).count() == 0
        if name == "near_dedup":
            kept = {r["doc_id"] for r in out.collect()}
            assert 70 in kept and not kept & set(range(71, 82)) and None in kept


def test_pipeline_runs_on_the_tables(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    result = corpus_pipeline.run(spark, medium).collect()
    assert 0 < len(result) and {r["doc_id"] for r in result} <= {r[0] for r in docs.select("doc_id").collect()}
    ordered = sorted(result, key=lambda r: r["start"])
    ends = [r["start"] + r["n_tokens"] for r in ordered]
    assert [r["start"] for r in ordered] == [0, *ends[:-1]]


@pytest.mark.parametrize("sources,docs", [(5, 6_000), (20, 30_000)])
def test_mix_keeps_long_documents_at_their_sources_share(spark, medium, sources, docs):
    rows = _many(spark, sources, docs, long_share=30)
    kept = corpus_pipeline.mix_sources(spark, rows, medium)
    words = F.size(F.split(F.trim("text"), " "))
    targets = mixing.mix(rows).groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("size"))
    sums = kept.groupBy("source").agg(
        F.sum(words).alias("words"), F.sum(F.when(words >= 5000, words).otherwise(0)).alias("long")
    )
    there = rows.groupBy("source").agg(F.sum(F.when(words >= 5000, words).otherwise(0)).alias("there"))
    got = sums.join(targets, "source").join(there, "source").collect()
    assert len(got) == sources
    for r in got:
        assert abs(r["words"] - r["target"]) <= 0.01 * r["target"] + 5000  # documents stay whole
        assert r["long"] > 0
    wanted = sum(r["there"] * r["target"] / r["size"] for r in got)
    assert abs(sum(r["long"] for r in got) / wanted - 1) < 0.05
    again = corpus_pipeline.mix_sources(spark, rows.repartition(7), medium)
    assert kept.exceptAll(again).isEmpty() and again.exceptAll(kept).isEmpty()


def test_stages_leave_columns_of_any_name_alone(spark, medium):
    names = ["_row", "_copy", "_times", "_doc", "_odd", "_is_odd", "_key", "_nth", "_rest", "_score", "_whole", "hit", "taken"]
    data = [*corpus.rows(), (None, "no id", "a"), (None, "no id", "a")]
    docs = corpus.documents(spark, data)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, F.concat(F.lit(f"{i}-"), F.xxhash64("doc_id", "text")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, medium)
        assert out.columns == docs.columns
        wrong = F.lit(False)
        for i, column in enumerate(names):
            wrong = wrong | (F.col(column) != F.concat(F.lit(f"{i}-"), F.xxhash64("doc_id", "text")))
        assert out.count() > 0 and out.where(wrong).isEmpty(), name
