"""The three jobs end to end on a small publication."""

import datetime as dt

from pyspark.sql import functions as F

from docfacts.plans import jobs


def test_ingest_and_answer(spark):
    page = [
        (1, 37, [(28, "6"), (40, "DEC"), (70, "18"), (500, "NIGERIA"), (550, "AIP")]),
        (1, 60, [(60, "DNAA"), (100, "AD"), (120, "2.3"), (150, "OPERATIONAL"), (230, "HOURS")]),
        (1, 90, [(40, "1"), (80, "Customs"), (350, "H24")]),
        (1, 110, [(40, "2"), (80, "Fuelling"), (350, "0600-2000")]),
        (2, 60, [(60, "DNAA"), (100, "AD"), (120, "2.13"), (150, "DECLARED"), (230, "DISTANCES")]),
        (2, 80, [(100, "TORA"), (160, "TODA"), (220, "ASDA"), (280, "LDA"), (445, "Remarks")]),
        (2, 100, [(40, "04"), (100, "3"), (110, "610"), (160, "3610"), (220, "3610"), (280, "3300"), (358, "NIL")]),
        (3, 60, [(60, "AD"), (120, "2.18"), (150, "ATS"), (180, "COMMUNICATION")]),
        (3, 90, [(40, "TWR"), (100, "118.6"), (140, "MHz"), (180, "H24")]),
        (3, 120, [(60, "AD"), (120, "2.23"), (150, "ADDITIONAL"), (230, "INFORMATION")]),
        (3, 140, [(60, "Birds"), (100, "cross"), (140, "the"), (160, "runway")]),
    ]
    data, n = [], 0
    for p, top, ws in page:
        for x0, t in ws:
            data.append(("d", p, n, float(x0), float(top), float(x0 + 5 * len(t)), float(top + 8), t))
            n += 1
    words = spark.createDataFrame(data, "doc_id string, page int, word_no int, x0 double, top double, x1 double, bottom double, text string")
    sections = spark.createDataFrame([("d", "DNAA", "standard", 1, 9, 1)], "doc_id string, section_id string, kind string, start_page int, end_page int, seq int")
    names = spark.createDataFrame([("DNAA", "Abuja")], "scope_id string, scope_name string")
    got = jobs.ingest(words, sections, names, {"2.3": [("customs", "customs"), ("fuel", "fuel")]})
    assert {r["category"] for r in got.pages.collect()} == {"AD_CONTENT"}
    facts = {(r["subsection"], r["entity"], r["label"]): r["fact_value"] for r in got.facts.collect()}
    assert facts[("2.3", "", "Customs")] == "H24" and facts[("2.13", "RWY 04", "TORA")] == "3610 m" and facts[("2.18", "TWR", "Frequency")] == "118.6MHZ"
    assert "Birds cross the runway" in facts[("2.23", "", "Additional Information")]
    assert got.issues.where("severity = 'error'").count() == 0
    store = got.facts.withColumn("embedding", F.when(F.col("label") == "TORA", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).cast("array<float>"))
    q = spark.createDataFrame([(1, "TORA of RWY 04", None, "AD", "DNAA", [1.0, 0.1])], "query_id int, question string, subsection string, scope_kind string, scope_id string, embedding array<float>")
    hits = spark.createDataFrame([(1, "AD 2.13", 0.6)], "query_id int, section string, similarity double")
    a = jobs.answer(q, store, hits, 1).first()
    assert a["route"] == "declared_distance" and a["outcome"] == "facts" and a["shown"] == ["TORA: 3610 m"]


def test_observe_and_assess(spark):
    t = dt.datetime(2024, 1, 31)
    entries = spark.createDataFrame(
        [(1, t, "Fuel  at X", "not_found", "DNAA", 0.2, True, False, "q1", None), (2, t, "fuel at x", "answer", "DNAA", 0.8, False, False, "q2", None), (3, t - dt.timedelta(days=90), "old", "error", None, None, True, False, "q3", None)],
        "id long, created_at timestamp, query string, path string, icao string, similarity double, needs_review boolean, reviewed boolean, qid string, feedback string",
    )
    votes = spark.createDataFrame([("q2", "down", t)], "qid string, verdict string, at timestamp")
    out = jobs.observe(entries, votes, F.lit(t))
    s = out["summary"].first()
    assert (s["total"], s["open"], s["down"], s["review_pct"]) == (2, 2, 1, 100)
    assert [(r["cluster"], r["n"], r["example_id"]) for r in out["clusters"].collect()] == [("fuel at x", 2, 2)]
    rows = spark.createDataFrame([("answer", "AD 2.1", "exact", "x", None, "AD 2.1 x", False, "clean")], "path string, subsection string, match_mode string, expected_value string, expected_behaviour string, reply string, harness_error boolean, corruption string")
    levels = jobs.assess(rows)["levels"].where("level = 'corruption'").collect()
    assert [(r["name"], r["ok_pct"]) for r in levels] == [("clean", 100)]
