"""Verdicts of cases against their SQL where texts have no letters, or phrases that an assistant's replies are judged by."""

import duckdb
import pytest

from docfacts.plans.registry import ORACLE, QUERIES

TEXTS = ["", " ", "é", "1234 567", "日本語", "not available", "does not state", "no published", "it publishes several", "read the exact figure", "NIL", "x", "x y", "ab  cd\n\nef", "a b c d e f g h i j k l m n o", None]


@pytest.mark.parametrize("name", ["case_verdicts", "verdict_levels", "verdict_matrix", "worst_sections"])
def test_texts_without_letters_or_with_phrases_of_replies(spark, tmp_path, name):
    rows = [(84 * (2 * n + q) + r, text, q) for n, text in enumerate(TEXTS) for q in (0, 1) for r in range(24)]
    rows += [(-k, "ab cd", 1) for k in range(1, 25)]
    spark.createDataFrame([(k, t, "fr" if k % 2 else None, f"src{k % 3}") for k, t, _ in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, q) for k, _, q in rows], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))
