"""Registered queries over whole small tables."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docfacts.llm.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op1_quality_classifier"](spark, SF).collect()
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held) > 0.9
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in QUERIES["op3_language_id"](spark, SF).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) / len(rows) > 0.97


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert last.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_pipeline_stages_over_odd_rows_and_clashing_columns(spark):
    """Each stage over all rows, odd ones too, with columns that are named like the operators' own."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    long = " ".join(f"Wort{i % 991} und{i % 7}" for i in range(120_000))
    odd = [(10**9, None), (10**9 + 1, ""), (None, "some words of a text without an id " * 3), (10**9 + 2, long), (10**9 + 2, long), (10**9 + 3, " \n ")]
    rows = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(i, t, "de", "s") for i, t in odd], "doc_id long, text string, lang string, source string"))
    for name in ("fp", "key", "k1", "n", "score", "row_no", "c0", "h", "quality", "items", "unit"):
        rows = rows.withColumn(name, F.lit("x"))
    rows = rows.cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, rows, sf)
        assert got.columns == rows.columns, name
        kept = got.select("doc_id", "text").collect()
        assert 0 < len(kept) <= rows.count(), name
        assert {r["text"] for r in kept} <= {r["text"] for r in rows.select("text").collect()}
        n = sum(r["doc_id"] == 10**9 + 2 for r in kept)
        assert n == 1 if name == "near_dedup" else n in (0, 2), name
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, sf).where(f"doc_id = {10**9} or doc_id is null").collect()
    assert sorted((r["doc_id"] is None, r["piece"]) for r in packed) == [(False, 0), (True, 0)]


def test_language_stage_rejects_foreign_texts_and_keeps_clean_ones(spark):
    from docfacts.llm import language_id

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    odd = ["Litwo! Ojczyzno moja! ty jesteś jak zdrowie; ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. " * 3, "Мой дядя самых честных правил, когда не в шутку занемог " * 4, "xqzw vbnmk jjhgf qqpwz zxcvk wwrtp lkjhq " * 9, "1234 5678"]
    assert not any(model.judge(odd)[2])
    kept = language_id.keep_identified(docs, model)
    assert kept.where("lang is not null").count() >= 0.995 * docs.where("lang is not null and text rlike '[a-zA-Z]'").count()


def test_pipeline_stages_over_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(name, spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    got = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(got.columns)
    assert Counter(cur.fetchall()) == Counter(map(tuple, got.select(*columns).collect()))
