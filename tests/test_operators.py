"""Semantics of the operators on small hand-written rows."""

import datetime as dt
import json
import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docfacts.functions import text as tx
from docfacts.operators import charts, chunks, evaluate, extract, facts, log, resolve, retrieve, route, structure, verify
from docfacts.sources import tables as src

S = {"doc_id": "d", "scope_id": "DNAA", "subsection": "2.12"}


def lines(spark, rows, **over):
    keys = S | over
    data = [(keys["doc_id"], keys["scope_id"], keys["subsection"], 1, i, t) for i, t in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id string, scope_id string, subsection string, page int, line int, text string")


def words(spark, rows, **over):
    """rows: (page, top, [(x0, text), ...])"""
    keys, data, n = S | over, [], 0
    for page, top, ws in rows:
        for x0, t in ws:
            data.append((keys["doc_id"], keys["scope_id"], keys["subsection"], page, n, float(x0), float(top), float(x0 + 5 * len(t)), float(top + 8), t))
            n += 1
    return spark.createDataFrame(data, "doc_id string, scope_id string, subsection string, page int, word_no int, x0 double, top double, x1 double, bottom double, text string")


def val(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r")).first()["r"]


# text


@pytest.mark.parametrize(
    "fn, value, want",
    [
        (tx.number_set, "runs 3 610 m, 2,745 ft and 3610", ["3610", "2745"]),
        (tx.despace, "3 500  m", "3500 m"),
        (tx.join_thousands, "3 500 12 3 4000", "3500 12 3 4000"),
        (lambda c: tx.dms_to_decimal(c, "lat"), "090024.5N 0071547E", 9.006806),
        (lambda c: tx.dms_to_decimal(c, "lon"), "090024.5S 0071500W", -7.25),
        (lambda c: tx.dms_to_decimal(c, "lat"), "nothing", None),
        (lambda c: tx.measure(c, "ft"), "342 m (1 123 f t)", 1123.0),
        (lambda c: tx.measure(c, "m"), "1 200 m", 1200.0),
        (tx.rff_category, "Cat 9", 9),
        (tx.rff_category, "none", None),
        (tx.clean_text, "0094438E", "0094438E"),
        (tx.title_case, "RWY 18L main", "Rwy 18L Main"),
        (tx.normalised, "Port-Harcourt  (NAF)", "port harcourt naf"),
        (tx.multi_facility, "Apron surface and strength; taxiway surface", True),
    ],
)
def test_text_functions(spark, fn, value, want):
    assert val(spark, value, fn) == want


@pytest.mark.parametrize("have, asked, want", [("18L/36R", "18", True), ("18L", "18R", False), ("05", "05L", True), ("05, 23", "23", True), ("05", "", True), ("05", "06", False)])
def test_runway_serves(spark, have, asked, want):
    row = spark.createDataFrame([(have, asked)], "a string, b string").select(tx.runway_serves(F.col("a"), F.col("b")).alias("r")).first()
    assert row["r"] is want


def test_focus_window(spark):
    text = "a " * 300 + "needle " + "b " * 300
    got = spark.createDataFrame([(text,)], "t string").select(tx.focus_window(F.col("t"), F.array(F.lit("needle")), 200).alias("r")).first()["r"]
    assert "needle" in got and got.startswith("…") and got.endswith("…")


# sources


def test_csv_spans_upsert_delete(spark, tmp_path):
    p = str(tmp_path / "eval.csv")
    open(p, "w").write('id,category,question,ground_truth,test_type\n1,c,"a ""b""\nline","x",retrieval\n')
    assert src.read_eval_csv(spark, p).first()["question"] == 'a "b"\nline'
    src.write_results_csv(spark.createDataFrame([("a\nb",)], "reply string"), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).first()["reply"] == "a ⏎ b"
    q = str(tmp_path / "s.json")
    json.dump({"DNAA": {"s22": 340, "end22": 351}, "DNXX": {"s22": None, "end22": 3}}, open(q, "w"))
    got = src.read_spans(spark, q)
    assert [tuple(r)[:3] for r in got.collect()] == [("DNAA", 340, 351)]
    src.write_spans(got, str(tmp_path / "spans"))
    assert [tuple(r)[:3] for r in src.read_spans(spark, str(tmp_path / "spans")).collect()] == [("DNAA", 340, 351)]
    t = spark.createDataFrame([(1, "a", 0), (None, "n", 0)], "k int, v string, at int")
    u = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 1), (None, "m", 1)], "k int, v string, at int")
    once = src.upsert(t, u, ["k"], "at")
    assert sorted((r["k"] or 0, r["v"]) for r in once.collect()) == [(0, "m"), (1, "c"), (2, "d")]
    assert sorted(map(str, src.upsert(once, u, ["k"], "at").collect())) == sorted(map(str, once.collect()))
    assert [r["v"] for r in src.delete_where(t, "k = 1").collect()] == ["n"]
    w = src.words_from_text(spark.createDataFrame([("x", "<p>one two</p><script>no()</script><p>three")], "doc_id string, text string"), html=True)
    assert [r["text"] for r in w.orderBy("line_no", "word_no").collect()] == ["one", "two", "three"]


# page structuring


def test_classify_and_segment(spark):
    pages = [
        (1, "DNAA AD 2.1 AERODROME LOCATION body one"), (2, "more of one"), (3, "AD 2-DNAA-17119.6 plate"), (4, "AD 2.12 RUNWAY PHYSICAL x"), (5, "INTENTIONALLY BLANK"),
        (6, "AD 2.24 CHARTS RELATED TO AN AERODROME"), (7, "AD 3-DNXX list"), (20, "ENR 3.1-4 routes"), (21, "nothing"),
    ]
    df = spark.createDataFrame([("d", p, t, t) for p, t in pages], "doc_id string, page int, text string, blob string")
    sec = spark.createDataFrame([("d", "DNAA", "standard", 1, 10, 1), ("d", "DNBB", "standard", 5, 9, 2)], "doc_id string, section_id string, kind string, start_page int, end_page int, seq int")
    for most in (5000, 1):
        got = {r["page"]: (r["category"], r["section_id"]) for r in structure.classify_pages(structure.assign_section(df, sec, most)).collect()}
        assert got[1] == ("AD_CONTENT", "DNAA") and got[3][0] == "CHART_PLATE" and got[4][0] == "AD_CONTENT" and got[5][0] == "BLANK"
        assert got[2][0] == "UNKNOWN" and got[6][0] == "CHART_INDEX" and got[7][0] == "AD_SPECIMEN" and got[20] == ("ENR_CONTENT", None) and got[21][0] == "UNKNOWN"
    ref = df.where("page = 3").select(structure.own_reference(F.col("text"), F.lit("DNAA")).alias("r")).first()["r"]
    assert ref == 17


def test_segments_run_over_content_pages_only(spark):
    ls = spark.createDataFrame(
        [("d", 1, 0, "lost"), ("d", 1, 1, "DNAA AD 2.12 RUNWAY"), ("d", 2, 0, "goes on"), ("d", 2, 1, "AD 2.22 FLIGHT"), ("d", 3, 0, "plate"), ("d", 4, 0, "closed"), ("d", 4, 1, "AD 2.13 DECLARED"), ("d", 6, 0, "gap")],
        "doc_id string, page int, line int, text string",
    )
    cl = spark.createDataFrame([("d", p, "CHART_PLATE" if p == 3 else "AD_CONTENT", "DNAA") for p in (1, 2, 3, 4, 6)], "doc_id string, page int, category string, section_id string")
    seg = structure.segment_sections(ls, cl)
    got = {(r["page"], r["line"]): (r["subsection"], r["is_continuation"], r["excluded"]) for r in seg.collect()}
    assert got == {(1, 1): ("2.12", False, False), (2, 0): ("2.12", True, False), (2, 1): ("2.22", False, True), (4, 1): ("2.13", False, False)}
    assert {r["subsection"]: r["text"] for r in structure.section_text(seg).collect()} == {"2.12": "DNAA AD 2.12 RUNWAY goes on", "2.13": "AD 2.13 DECLARED"}


def test_chrome_lines_and_furniture(spark):
    ls = spark.createDataFrame([("6 DEC 18 NIGERIA AIP",), ("AD 2-DNBB-2",), ("7 Remarks NIL",), ("NIGERIAN AIRSPACE MANAGEMENT AGENCY AIRAC AMDT 03/2026",)], "text string")
    assert [r["text"] for r in structure.drop_chrome(ls).collect()] == ["7 Remarks NIL"]
    cell = "SALS RWY APCH LGT TYPE 1 2 3 4 5 6 7 8 9 10 05 Note: PAPI"
    assert val(spark, cell, structure.drop_table_furniture) == "SALS 05 Note: PAPI"
    assert val(spark, "RWY APCH LGT 1 2 3 4 5 6 7 8 9", structure.drop_table_furniture) is None
    w = words(spark, [(1, 115.3, [(50, "B")]), (1, 116.1, [(10, "A"), (90, "C")]), (1, 130, [(10, "D")])])
    got = {(r["line"], r["pos"]): r["text"] for r in structure.reading_lines(w, 4.0).collect()}
    assert got == {(0, 0): "A", (0, 1): "B", (0, 2): "C", (1, 0): "D"}
    blob = structure.header_blob(w.withColumn("line_no", F.lit(0)), band=10, fallback=2).first()["blob"]
    assert set(blob.split()) == {"B", "A"}
    sl = structure.column_slice(words(spark, [(1, 100, [(10, "RALUX"), (60, "90"), (80, "NM"), (300, "far")])]), 200, r"\b\d{1,3}\s*NM\b")
    assert [r["text"] for r in sl.collect()] == ["RALUX"]


def test_bands_and_headers(spark):
    ls = spark.createDataFrame([("d", 1, 10.0, "x"), ("d", 1, 20.0, "START"), ("d", 1, 30.0, "in"), ("d", 1, 40.0, "END"), ("d", 2, 5.0, "all")], "doc_id string, page int, top double, text string")
    assert [r["text"] for r in structure.band_slice(ls, "START", "END").orderBy("page", "top").collect()] == ["START", "in", "all"]
    s = ls.withColumn("section_id", F.lit("A"))
    none = spark.createDataFrame([], "doc_id string, section_id string")
    assert [r["text"] for r in structure.salvage_band(s, none, "START", "END").collect()] == ["START", "in"]
    toc = spark.createDataFrame([("ENR 4.4-1 points",), ("contents ENR 4.4-1",)], "text string")
    assert structure.select_pages_by_header(toc, "4.4").count() == 1
    assert structure.content_lines(spark.createDataFrame([(" a ",), ("1 2",), ("",)], "text string"), r"[\d\s]+").count() == 1


# records


def test_label_value_rows(spark):
    w = words(spark, [(1, 100, [(40, "1"), (80, "Hotels"), (350, "Near")]), (1, 104, [(390, "AD")]), (1, 130, [(40, "2"), (80, "Banks")]), (2, 50, [(300, "NIL")]), (2, 90, [(40, "3"), (80, "Remarks"), (350, "none")])])
    rows = extract.label_value_rows(w).orderBy("row_no").collect()
    assert [(r["number"], r["label"], r["value"]) for r in rows] == [("1", "Hotels", "Near AD"), ("2", "Banks", "NIL"), ("3", "Remarks", "none")]
    keyed = extract.canonicalize_labels(extract.label_value_rows(w), [("hotels?", "hotels"), ("bank", "banks")]).orderBy("row_no").collect()
    assert [(r["field"], r["warning"]) for r in keyed] == [("hotels", None), ("banks", None), (None, "unknown label")]
    rec = extract.positional_record(extract.label_value_rows(w), ["hotels", "banks", "rest", "more"]).first()
    assert (rec["hotels"], rec["banks"], rec["rest"], rec["more"], rec["warning"]) == ("Near AD", "NIL", "none", None, "3 rows, 4 expected")
    assert extract.full_rows(w).orderBy("row_no").first()["value"] == "Hotels Near AD"
    sec = spark.createDataFrame([("d", "DNAA", "2.12", "x"), ("d", "DNBB", "2.9", " all\nof it "), ("d", "DNCC", "2.9", " ")], "doc_id string, scope_id string, subsection string, text string")
    got = {r["scope_id"]: r["general_notes"] for r in extract.whole_text_fallback(sec, rows and extract.label_value_rows(w)).collect()}
    assert got == {"DNBB": "all of it", "DNCC": None}


def test_declared_distances(spark):
    head = (1, 50, [(100, "TORA"), (160, "TODA"), (220, "ASDA"), (280, "LDA"), (445, "Remarks")])
    w = words(spark, [head, (1, 80, [(40, "05"), (100, "3"), (110, "500"), (160, "3"), (170, "500"), (220, "3"), (230, "500"), (358, "1"), (365, "200"), (380, "m")]), (1, 90, [(40, "23"), (160, "2745"), (358, "NIL")])])
    got = {r["runway"]: (r["tora_m"], r["toda_m"], r["asda_m"], r["lda_m"], r["remarks"]) for r in extract.columns_by_header_x(w).collect()}
    assert got == {"05": (3500, 3500, 3500, None, "1 200 m"), "23": (None, 2745, None, None, "NIL")}
    assert extract.columns_by_header_x(w.where("text <> 'ASDA'")).count() == 0
    rows = spark.createDataFrame([(1, "05 23", "3 500 3 500", "3500 3500", "893.1 871.15", "1 2"), (2, "05 23", "3500", "1 2", "1 2", "1 2")], "k int, runways string, tora string, toda string, asda string, lda string")
    assert [(r["k"], r["runway"], r["tora"], r["asda"]) for r in extract.count_aligned_rows(rows).collect()] == [(1, "05", "3500", "893.1"), (1, "23", "3500", "871.15")]


def test_runways_pair_and_bare_numbers_confirm(spark):
    ls = lines(spark, ["04 042.12 ° 3 610 X 60 asphalt", "22 1 stray", "RWY 22 222", "04 1200m from threshold", "99 not an end"])
    rec = extract.runways(ls).collect()
    assert len(rec) == 1 and rec[0]["designation"] == "04/22" and (rec[0]["length_m"], rec[0]["width_m"]) == (3610, 60)
    assert rec[0]["end_detail"]["04"].endswith("04 1200m from threshold 99 not an end") and rec[0]["end_detail"]["22"].startswith("RWY 22")
    assert [val(spark, v, extract.opposite) for v in ("04", "18L", "36R", "09C")] == ["22", "36R", "18L", "27C"]


def test_services_and_navaids(spark):
    ls = lines(spark, ["ACC Kano 124.1 MHz H24 Primary frequency", "call 8903KHz as alternative", "SAR 406MHz 0600-2000", "TWR Bebi 120.8 12 Secondary frequency"])
    got = {r["service"]: r for r in extract.services(ls).collect()}
    acc = got["ACC"]["frequencies"]
    assert [(f["value"], f["unit"], f["hours"], f["remark"]) for f in acc] == [(124.1, "MHZ", "H24", "Primary frequency")]
    assert [f["value"] for f in got["SAR"]["frequencies"]] == [406.0]
    assert [(f["value"], f["hours"]) for f in got["TWR"]["frequencies"]] == [(120.8, "12")] and got["TWR"]["warning"] == "unit inferred"
    ls = lines(spark, ["for VOR/ILS/MLS, give", "NDB KN H24 365 kHz 120000N 0083000E", "114.000 MHz 065644.1N", "DVOR/DME GAT HJ 0032000E", "GP 110.7 rest of it MHz"])
    nav = extract.navaid_fields(ls).orderBy("instance").collect()
    assert [(n["aid_type"], n["frequency"], n["freq_unit"], n["hours"]) for n in nav] == [("NDB", 365.0, "KHZ", "H24"), ("DVOR/DME", 114.0, "MHZ", "HJ"), ("GP", 110.7, "MHZ", None)]
    assert nav[0]["lat"] == 12.0 and nav[0]["lon"] == 8.5


def test_areas_points_routes(spark):
    area = lines(spark, ["5.1.3 RESTRICTED", "DNR 24", "NNPC REFINERY", "WARRI.", "A circle 2NM radius 053400N 0054300E FL 450 GND", "DND5 x", "Area within radial 070 to 110 of ABC VOR 30NM 5 000 ft AGL"])
    got = {r["entity_id"]: r for r in extract.area_rows(area).collect()}
    a, b = got["DNR24"], got["DND5"]
    assert (a["family"], a["name"], a["upper_limit"], a["lower_limit"], a["position_kind"]) == ("restricted", "NNPC REFINERY WARRI", "FL 450", "GND", "coordinates")
    assert (b["family"], b["position_kind"], b["lower_limit"], b["warning"]) == ("danger", "navaid_relative", None, "one level only")
    pts = lines(spark, ["TEMSA 064912N 0024442E G/UG660 UT457 AI FIR BDRY", "IRNAG 064912N 0024442 IAD FIR BDRY", "TEMSA 000000N 0000000E", "OGDIX 084400N 0075019E I"])
    p = {r["entity_id"]: r for r in extract.regex_rows(pts).collect()}
    assert (p["TEMSA"]["routes"], p["TEMSA"]["fra_relevance"], p["TEMSA"]["remarks"], p["TEMSA"]["warning"]) == ("G/UG660 UT457", "AI", "FIR BDRY", "repeated name")
    assert p["IRNAG"]["coordinate_defect"] and p["IRNAG"]["remarks"] == "IAD FIR BDRY" and p["OGDIX"]["fra_relevance"] == "I"
    rt = lines(spark, ["UT467", "LAG", "064227.4N 0031938.8E", "TEMSA", "064912N 0024442E", "stray", "UT1", "UT467 (RNAV 5)", "TEMSA", "064912N 0024442E", "KANO VOR/DME (KAN)", "120000N 0083000E"])
    r = {x["entity_id"]: x for x in extract.ordered_points(rt).collect()}
    assert r["UT467"]["point_sequence"] == "LAG → TEMSA → KANO VOR/DME" and r["UT467"]["point_count"] == 3 and r["UT467"]["points"][2]["ident"] == "KAN"
    d = lines(spark, ["ARDEX DCT EDUKO H24", "ARDEX", "120518N 0143758E UNL", "EDUKO", "092846.26N 003100.60E", "FL 245", "TAKUM", "AAA DCT BBB", "AAA", "120518N 0143758E"])
    x = extract.direct_combinations(d).collect()
    assert len(x) == 1 and x[0]["entity_id"] == "ARDEX-EDUKO" and (x[0]["upper_limit"], x[0]["lower_limit"]) == ("UNL", "FL 245")
    assert x[0]["points"][1]["coordinates"] == "092846.26N 0031000.60E" and x[0]["points"][1]["longitude_corrected"]
    assert extract.routing_self_agreement(extract.direct_combinations(d)).count() == 0


def test_airspaces(spark):
    ls = lines(
        spark,
        ["KANO Flight Information Region", "(KANO FIR consists of KANO SECTOR and", "LAGOS SECTOR)", "KANO SECTOR", "A line joining (KAN VOR) and Kaduna TMA.", "FL 145", "GND", "Class of airspace: A, D", "KANO CONTROL", "EN", "H24", "124.1 MHz NIL", "NIL", "LAGOS SECTOR", "boundary 5"],
    )
    h = {r["name"]: r["parent"] for r in extract.discover_hierarchy(ls).collect()}
    assert h["KANO SECTOR"] == "KANO FIR" and h["LAGOS SECTOR"] == "KANO FIR" and h["KANO Flight Information Region"] is None
    a = {r["entity_id"]: r for r in extract.airspace_fields(ls, extract.discover_hierarchy(ls)).collect()}
    k = a["KANO SECTOR"]
    assert (k["vertical_limits"], k["airspace_class"], k["ats_unit"], k["frequencies"], k["hours"], k["languages"], k["remarks"]) == ("FL 145 / GND", "A, D", "KANO CONTROL", "124.1 MHz", "H24", "EN", "NIL")
    assert k["lateral_limits"].startswith("A line joining (KAN VOR)") and a["KANO Flight Information Region"]["note"].endswith("LAGOS SECTOR)")


def test_station_navaids(spark):
    ls = lines(spark, ["ABUJA", "VOR/DME ABC 116.3 MHz H24 090000N 0071500E 350 m", "PORT", "HARCOURT", "VOR", "PHC 113.5 MHz 051000N 0065700E", "LAGOS", "VOR", "NDB", "LAG", "LA", "113.7 MHz", "064200N 0032000E"])
    n = {r["entity_id"]: r for r in extract.station_navaids(ls).collect()}
    assert n["ABC"]["station"] == "ABUJA" and n["ABC"]["frequency"] == "116.3 MHz" and n["ABC"]["elevation"] == "350 m" and n["ABC"]["hours"] == "H24"
    assert n["PHC"]["station"] == "PORT HARCOURT" and n["PHC"]["navaid_type"] == "VOR"
    assert n["LAG"]["navaid_type"] == "VOR" and n["LA"]["navaid_type"] == "NDB" and n["LA"]["frequency_is_ambiguous"] and n["LA"]["coordinates_are_ambiguous"]


def test_geometry_helpers(spark):
    t = words(spark, [(1, 50, [(100, "Obstacle")]), (1, 60, [(50, "a"), (100, "b"), (200, "c")]), (1, 80, [(50, "1"), (100, "MAST"), (200, "120m")]), (1, 84, [(100, "tall")]), (1, 110, [(50, "2"), (100, "TREE"), (200, "4m")])])
    assert [r["text"] for r in extract.marker_row_tables(t).orderBy("row_no").collect()] == ["1 | MAST tall | 120m", "2 | TREE | 4m"]
    two = words(spark, [(1, 50, [(20, "left"), (400, "right")]), (1, 60, [(20, "more"), (400, "end")]), (1, 40, [(20, "2.23"), (60, "TITLE")])])
    assert extract.region_read(two, "TITLE").first()["text"] == "left more right end"
    assert extract.layout_render(words(spark, [(1, 50, [(20, "a"), (200, "b")]), (1, 50, [(400, "c")])])).first()["text"].split() == ["a", "b", "c"]
    items = words(spark, [(1, 50, [(20, "2.20.1"), (60, "Airport"), (400, "2.20.2"), (440, "Parking")]), (1, 60, [(20, "regulations"), (400, "None")]), (1, 70, [(20, "Ask"), (60, "first")])], subsection="2.20")
    got = {r["number"]: (r["label"], r["value"]) for r in extract.two_column_items(items).collect()}
    assert got == {"1": ("Airport regulations", "Ask first"), "2": ("Parking", "None")}


def test_notes_identity_validation_gate(spark):
    ls = lines(spark, ["1 A", "Note: x", "more note", "2 B"])
    assert [r["text"] for r in extract.skip_note_block(ls).collect()] == ["1 A", "2 B"]
    sec = spark.createDataFrame([("d", "DNAA", "2.1", "DNAA - ABUJA / Nnamdi Azikiwe"), ("d", "DNBB", "2.1", "nothing")], "doc_id string, scope_id string, subsection string, text string")
    ident = extract.identity_line(sec)
    assert [(r["city"], r["name"]) for r in ident.orderBy("scope_id").collect()] == [("ABUJA", "Nnamdi Azikiwe"), (None, None)]
    issues = extract.validate_records(ident, extract.RULES["identity"])
    assert issues.count() == 2 and [r["scope_id"] for r in extract.gate(ident, issues).collect()] == ["DNAA"]
    for shape in extract.RULES:
        for rule in extract.RULES[shape]:
            F.expr(rule[3])
    geo = spark.createDataFrame([("090024N 0071547E", "342 m / 1 123 ft", "342 m"), (None, None, "elev 12 m 050000N 0030000E")], "arp string, elevation string, text string")
    got = extract.geographic_record(geo).collect()
    assert got[0]["elevation_ft"] == 1123.0 and got[1]["elevation_m"] == 12.0 and got[1]["from_text"] and got[1]["latitude"] == 5.0


# facts


def rec(spark, **cols):
    base = {"scope_kind": "AD", "scope_id": "DNAA", "scope_name": "Abuja", "subsection": "2.13", "seq": 1}
    return spark.createDataFrame([Row(**(base | cols))])


def test_fact_shapes(spark):
    lv = facts.label_value_facts(rec(spark, subsection="2.3", raw_label="ATS", hours="H24", detail=" ")).first()
    assert (lv["label"], lv["fact_value"], lv["fact_text"]) == ("ATS", "H24", "Abuja (DNAA) AD 2.3 operational hours. ATS: H24")
    sch = "scope_kind string, scope_id string, scope_name string, subsection string, seq long, designation string, length_m int, width_m int, end_detail map<string,string>"
    rw = spark.createDataFrame([("AD", "DNAA", "Abuja", "2.12", 1, "04/22", 3610, 60, {"04": "x", "22": " ", "general_notes": "g"}), ("AD", "DNAA", "Abuja", "2.12", 2, None, None, None, {"n": "note"})], sch)
    got = [(r["entity"], r["label"], r["fact_value"]) for r in facts.runway_facts(rw).orderBy("seq").collect()]
    assert got == [("RWY 04/22", "Dimensions", "3610 x 60 m"), ("RWY 04", "Details", "x"), ("general", "Details", "g"), ("", "Notes", "note")]
    sv = spark.createDataFrame([("AD", "DNAA", "Abuja", "2.18", 1, "TWR", [(118.1, "MHZ"), (121.5, "MHZ")], "TWR text")], "scope_kind string, scope_id string, scope_name string, subsection string, seq long, service string, frequencies array<struct<value:double,unit:string>>, raw_text string")
    assert [r["fact_value"] for r in facts.service_facts(sv).orderBy("seq").collect()] == ["118.1MHZ, 121.5MHZ", "TWR text"]
    nv = facts.navaid_facts(rec(spark, subsection="2.19", aid_type="NDB", ident="KN", frequency=365.0, freq_unit="KHZ", hours="H24", lat=12.0)).orderBy("seq").collect()
    assert [(r["entity"], r["label"], r["fact_value"]) for r in nv][:2] == [("NDB KN", "Frequency", "365.0 KHZ"), ("NDB KN", "Hours of operation", "H24")]
    en = facts.facts_from_entities(rec(spark, scope_kind="ENR_AREA", scope_id="DNR1", subsection="5.1", family="restricted", name=" ", coordinates=["a", "b"], vertical_limits="FL 1")).orderBy("seq").collect()
    assert [(r["label"], r["fact_value"]) for r in en] == [("Type of area", "restricted"), ("Vertical limits", "FL 1"), ("Coordinates", "a b")]
    assert en[2]["fact_text"] == "DNR1 ENR 5.1 Coordinates (2 points): a b"


def test_facts_from_text(spark):
    text = "2.22.3 Procedures\nlong enough body here\n2.22.3.1 Instrument   approach\nbased on VOR/DME lines\n2.22.3.1.1 Holding procedure\nTurn right over the beacon\n2.22.4 Short\nno"
    df = rec(spark, subsection="2.22", text=text).unionByName(rec(spark, scope_id="DNBB", subsection="2.23", text="plain text with no heading"))
    got = {(r["scope_id"], r["entity"]): r for r in facts.facts_from_text(df).collect()}
    assert set(got) == {("DNAA", "2.22.3"), ("DNAA", "2.22.3.1"), ("DNAA", "2.22.3.1.1"), ("DNBB", "")}
    hold = got[("DNAA", "2.22.3.1.1")]
    assert "Instrument approach based on VOR/DME lines. Holding procedure: Turn right" in hold["fact_text"]
    assert got[("DNBB", "")]["label"] == "Additional Information"
    long = facts.facts_from_text(rec(spark, subsection="2.22", text="2.22.1.1 Head\n" + "word " * 400)).first()
    assert long["fact_value"].endswith(" …") and len(long["fact_value"]) <= 1202
    ob = facts.obstacle_facts(rec(spark, subsection="2.10", text="head\nMAST  120m 090024.5N 0071547E lighted\nshort 090024N "))
    assert [(r["entity"], r["label"]) for r in ob.collect()] == [("MAST 120m", "Obstacle")]


def test_dedupe_is_idempotent_and_scoped(spark):
    rows = [("AD", "A", "2.10", "", "Obstacle type", "Mast", "f. Obstacle type: Mast", 1), ("AD", "A", "2.10", "", "Obstacle type", "Mast", "f. Obstacle type: Mast", 2), ("AD", "A", "2.10", "", "Obstacle type", "Building", "f. Obstacle type: Building", 3), ("ENR_AREA", "X", "5.1", "", "Name", "n", "t", 4), ("ENR_AREA", "Y", "5.1", "", "Name", "n", "t", 5)]
    df = spark.createDataFrame(rows, "scope_kind string, scope_id string, subsection string, entity string, label string, fact_value string, fact_text string, seq long")
    once = facts.dedupe_facts(df)
    got = {(r["scope_id"], r["entity"], r["fact_value"]): r["fact_text"] for r in once.collect()}
    assert got[("A", "item 1", "Mast")] == "f. Item 1. Obstacle type: Mast" and ("A", "item 2", "Building") in got and len(got) == 4
    assert sorted(map(str, facts.dedupe_facts(once).collect())) == sorted(map(str, once.collect()))
    vec = facts.embedding_batches(df.select("fact_text", "seq"), lambda ts: [[float(len(t))] if "Mast" in t else None for t in ts], size=2)
    ok, failed = facts.embedded_and_failed(vec)
    assert ok.count() == 2 and failed.count() == 3


# chunks and charts


def test_chunks(spark):
    text = "Sentence one is here. " * 200
    pieces = chunks.cut_text(text, 300, 60, 20)
    assert all(20 < len(p) <= 300 for p in pieces) and all(p.endswith(".") for p in pieces) and chunks.cut_text("") == []
    df = spark.createDataFrame([(1, "DNAA AD 2.12 RUNWAY characteristics and more text AD 2.13 DECLARED distances and still more")], "id int, text string")
    assert [r["subsection"] for r in chunks.split_subsections(df).orderBy("chunk_no").collect()] == ["2.12", "2.13"]
    pk = spark.createDataFrame([(1, "2.22.1 aaa\n2.22.2 bbb\n2.22.3 " + "c" * 40)], "id int, text string")
    got = [r["chunk"] for r in chunks.pack_sections(pk, limit=30).orderBy("chunk_no").collect()]
    assert len(got) == 2 and "".join(got) == pk.first()["text"]
    row = spark.createDataFrame([("steer", "has steer inside"), ("steer", "other")], "a string, b string").select(chunks.embed_payload(F.col("a"), F.col("b")).alias("r")).collect()
    assert [r["r"] for r in row] == ["has steer inside", "steer\n\nother"]
    c = spark.createDataFrame([("AD", "2.1", "DNAA", "body")], "part string, section string, reference string, chunk string")
    t = lambda a, b: spark.createDataFrame([b], a)
    got = chunks.enrich(c, t("section string, title string", ("2.1", "Location")), t("reference string, name string", ("DNAA", "Abuja")), t("section string, terms string", ("2.1", "TERMS")), "Doc").first()["content"]
    assert got == "[Doc | AD | 2.1 — Location | Abuja (DNAA)] TERMS body"
    assert val(spark, "AD 2-DNAA-1 NIGERIA AIP NIGERIAN AIRSPACE MANAGEMENT AGENCY  real  text", chunks.strip_header) == "real text"


def test_charts(spark):
    ip = spark.createDataFrame([("DNAA", "CHARTS RELATED TO AN AERODROME Chart name Page Aerodrome Chart AD 2-DNAA-13 ILS RWY 22 Chart AD 2 - DNAA - 15")], "section_id string, text string")
    ix = charts.chart_index(ip)
    assert {r["ref"]: r["name"] for r in ix.collect()} == {13: "Aerodrome Chart", 15: "ILS RWY 22 Chart"}
    pages = spark.createDataFrame([("d", 5, "DNAA", "AD 2-DNAA-15 x", "", False), ("d", 6, "DNAA", "AD 2-DNAA-99 x", "", False), ("d", 7, "GEN", "far SEARCH AND RESCUE", "", False), ("d", 8, "DNAA", "AD 2-DNAA-13", "", True)], "doc_id string, page int, section_id string, text string, title string, is_index boolean")
    m = charts.match_charts(pages, ix)
    assert {(r["page"], r["procedure_type"], r["runway"]) for r in m.collect()} == {(5, "ILS Approach Chart", "22"), (7, "Search and Rescue Units Chart", "")}
    sec = pages.select("section_id")
    assert {(r["section_id"], r["problem"]) for r in charts.chart_reconciliation(m, ix, sec).collect()} == {("DNAA", "no page"), ("GEN", "no index")}
    cat = spark.createDataFrame([("DNMM", "ILS Approach Chart", "18L", "a"), ("DNMM", "VOR Approach Chart", "18R", "b"), ("DNMM", "VOR Approach Chart", "36L", "c"), ("DNMM", "Aerodrome Chart", "", "e")], "section_id string, procedure_type string, runway string, name string")
    rq = spark.createDataFrame([(1, "DNMM", "approach plate", None), (2, "DNMM", "vor", None), (3, "DNMM", "vor", "36"), (4, "DNMM", "ndb", None), (5, "DNMM", "charts", None)], "request_id int, section_id string, term string, runway string")
    d = {r["request_id"]: (r["action"], r["options"]) for r in charts.clarify_decision(rq, cat).collect()}
    assert d == {1: ("ask_type", ["ILS", "VOR"]), 2: ("ask_runway", ["18R", "36L"]), 3: ("send", None), 4: ("not_found", None), 5: ("ask_type", ["ILS", "VOR"])}
    got = charts.charts_for_requests(rq, cat).groupBy("request_id").agg(F.array_sort(F.collect_list("name")).alias("n")).collect()
    assert {r["request_id"]: r["n"] for r in got} == {1: ["a", "b", "c"], 2: ["b", "c"], 3: ["c"], 5: ["a", "b", "c", "e"]}
    pl = spark.createDataFrame([("DNMM", ["04/22"], ["vor", "ils"], "wide"), ("DNMM", ["04"], ["vor"], "own")], "section_id string, runways array<string>, approach_types array<string>, name string")
    r = charts.rank_charts(spark.createDataFrame([(1, "DNMM", "vor", "04")], "request_id int, section_id string, term string, runway string"), pl)
    assert [x["name"] for x in r.orderBy("rank").collect()] == ["own", "wide"]
    tz = spark.createDataFrame([("d", 1, 10.0, 100.0, "AD 2-DNAA-1 NIGERIA AIP area  chart"), ("d", 1, 90.0, 100.0, "low")], "doc_id string, page int, top double, height double, text string")
    assert charts.title_zone(tz).first()["title"] == "AREA CHART"


# retrieval, resolution, routing, verification


def test_resolution(spark):
    al = spark.createDataFrame([("DNPO", "port harcourt"), ("DNPO", "ph"), ("DNPM", "port harcourt naf"), ("DNMM", "lagos"), ("DNAX", "lagos"), ("DNLL", "a very long alias of more than six words")], "scope_id string, alias string")
    q = spark.createDataFrame([(1, "Port Harcourt NAF"), (2, "PH"), (3, "Lagos"), (4, "nowhere"), (5, "the a very long alias of more than six words!"), (6, None)], "query_id int, name string")
    got = {r["query_id"]: r["scopes"] for r in resolve.resolve_aliases(q, al).collect()}
    assert got == {1: ["DNPM"], 2: ["DNPO"], 3: ["DNAX", "DNMM"], 4: [], 5: ["DNLL"], 6: []}
    pub = resolve.published_entities([("ENR_NAVAID", spark.createDataFrame([("PHC",), ("LAG",)], "scope_id string")), ("ENR_POINT", spark.createDataFrame([("TEMSA",), ("LAG",)], "scope_id string"))], spark.createDataFrame([("KANO Flight Information Region",)], "scope_id string"))
    names = {r["token"]: r["scope_kind"] for r in pub.collect()}
    assert names["LAG"] == "ENR_NAVAID" and names["TEMSA"] == "ENR_POINT" and names["KANOFIR"] == "ENR_AIRSPACE"
    valid = spark.createDataFrame([("DNPO", "PHC"), ("DNMM", None)], "scope_id string, ident string")
    out = spark.createDataFrame([("DNJL", "Jalingo")], "scope_id string, place string")
    qs = spark.createDataFrame(
        [(1, "aerodrome_fact", "DNMM", None, None), (2, "aerodrome_fact", "DNZZ", None, None), (3, "aerodrome_fact", "DNJL", None, None), (4, "aerodrome_fact", None, "Lagos", None), (5, "aerodrome_fact", None, "PHC", None), (6, "aerodrome_fact", None, "Jalingo", None), (7, "aerodrome_fact", None, "Temsa", None), (8, "aerodrome_fact", None, None, None), (9, "other", None, None, "ENR"), (10, "airspace_lookup", None, "Kano FIR", None), (11, "x", "DNKK", None, None)],
        "query_id int, intent string, code string, name string, preferred_part string",
    )
    r = {x["query_id"]: x for x in resolve.resolve_scope(qs, al, pub, valid, out).collect()}
    assert [r[i]["status"] for i in range(1, 12)] == ["scope", "invalid", "out_of_scope", "ambiguous", "ambiguous", "out_of_scope", "scope", "unresolved", "national", "scope", "national"]
    assert r[7]["scope_kind"] == "ENR_POINT" and r[10]["scope_id"] == "KANO Flight Information Region" and r[9]["part"] == "ENR"
    raw = spark.createDataFrame([(1, "where is Temsa"), (2, "route G/UG660 x"), (3, "limits of DNR 24"), (4, "nothing at all")], "query_id int, raw string")
    pub2 = pub.unionByName(spark.createDataFrame([("G/UG660", "ENR_ROUTE", "G/UG660")], pub.schema))
    s = {x["query_id"]: x["token"] for x in resolve.spot_entities(raw, pub2, valid).collect()}
    assert s == {1: "TEMSA", 2: "G/UG660", 3: "DNR24", 4: None}
    toc = spark.createDataFrame([(1, "danger area", "ENR 5.1", "Areas"), (2, "area", "ENR 9", "x")], "rank int, keyword string, reference string, title string")
    t = resolve.toc_lookup(spark.createDataFrame([("which section has danger areas",), ("danger areas near me",)], "question string"), toc).collect()
    assert {x["question"]: x["reference"] for x in t} == {"which section has danger areas": "ENR 5.1", "danger areas near me": None}
    fix = route.intent_backstops(
        spark.createDataFrame([(1, "aerodrome_fact", "DNZZ", None, "about DNMM"), (2, "out_of_scope", None, None, "elevation of port harcourt"), (3, "out_of_scope", None, None, "ticket price to lagos"), (4, "general_greeting", None, None, "fuel at ph"), (5, "aerodrome_fact", "DNMM", None, "ils approach chart")], "query_id int, intent string, code string, name string, raw string"),
        al, valid, out, pub,
    )
    f = {x["query_id"]: (x["intent"], x["code"]) for x in fix.collect()}
    assert f[1] == ("aerodrome_fact", "DNMM") and f[2] == ("aerodrome_fact", "DNPO") and f[3][0] == "out_of_scope" and f[4] == ("aerodrome_fact", "DNPO") and f[5][0] == "chart_retrieval"


def test_routes_in_order(spark):
    rows = [("decision height at Lagos", None, None, []), ("PCN for runway", "2.12", None, []), ("true bearing", "AD 2.12", None, []), ("anything", None, None, ["AD 2.22"]), ("anything ILS", None, None, ["AD 2.22"]), ("limits", "2.17", None, []), ("x", None, "AD 2.4", []), ("x", None, None, [])]
    df = spark.createDataFrame(rows, "question string, subsection string, best_section string, sections array<string>")
    assert [(r["route"], r["section"]) for r in route.route_query(df).collect()] == [("subsection_verbatim", "AD 2.22"), ("rwy_data", None), ("rwy_char", None), ("subsection_verbatim", "AD 2.22"), ("approach_procedure", None), ("subsection_verbatim", "AD 2.17"), ("subsection", "AD 2.4"), ("general", None)]


def test_procedures(spark):
    body = "2.22.3.1.1 Holding procedure – Turn right over the beacon now\n2.22.3.1.2 Letdown procedure – Descend to 2000 ft inbound\n2.22.3.1.3 Missed approach – Climb straight ahead to 3000\n"
    text = f"2.22.3.1 Instrument approach procedures for RWY 1 8 L based on VOR/DME\n{body}2.22.4 Radar Procedures x Instrument approach procedures for RWY 05 based on ILS\n2.22.5.1 Holding procedure – only this one here\n"
    t = spark.createDataFrame([("DNMM", text)], "scope_id string, text string")
    rq = spark.createDataFrame([(1, "DNMM", "18", "vor"), (2, "DNMM", "05", ""), (3, "DNMM", "18L", "ils")], "request_id int, scope_id string, runway string, type_asked string")
    got = route.procedure_sections(rq, t).collect()
    assert [r["request_id"] for r in got] == [1] and got[0]["runway"] == "18L" and got[0]["missed"].startswith("Climb straight")
    block = spark.createDataFrame([("2.22.2 Runway in use The wind decides. 2.22.3 Next", "what is the runway in use"), ("none", "radar")], "t string, q string")
    assert [r["r"] for r in block.select(route.info_block(F.col("t"), F.col("q")).alias("r")).collect()] == ["The wind decides", None]


def test_what_a_part_says(spark):
    rows = [
        ("– hold at  the beacon -\n left turns\n\n2.22.4.1 climb - then turn\nNIGERIA AIP\nto 2 000 ft. AIRAC AMDT 2 more", "hold at the beacon\n• left turns\n climb\n• then turn\nto 2 000 ft"),
        ("join the hold A 1700 2610(540) B", "join the hold A 1700 2610(540) B"), ("join the hold A 1700(200) 540 more", None), ("On the outbound track 032 M,", None), ("too short", None), (None, None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = [r["b"] for r in df.orderBy("i").select(route.part_body(F.col("t")).alias("b")).collect()]
    assert got == [None if k == 1 else want for k, (_, want) in enumerate(rows)]


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_cells_that_cannot_hold_a_hit_are_skipped_without_loss(spark, monkeypatch, spread):
    monkeypatch.setattr(retrieve, "PIVOTS", 12)
    rng = np.random.default_rng(2)
    middle = rng.normal(size=(12, 8))
    v = [(i, f"s{i % 2}", "x" if i % 5 else None, (middle[i % 12] + spread * rng.normal(size=8)).tolist()) for i in range(600)]
    v += [(600 + i, "s0", "x", [0.5] * 8) for i in range(40)] + [(700, "s1", "x", [0.0] * 8), (701, "s1", "x", None)]  # copies, a zero vector, none
    rows = spark.createDataFrame(v, "id int, scope string, part string, embedding array<double>")
    asked = [(i, s, p if i % 2 == 0 else None, x) for i, s, p, x in v if i % 9 == 0 or i == 700]
    q = spark.createDataFrame(asked, "query_id int, scope string, part string, embedding array<double>")
    held = rows.withColumn("part", F.coalesce("part", F.lit("y")))
    for same in (None, "part"):
        want = retrieve.nearest(q, held.where("embedding is not null"), ["scope"], ["query_id"], ["part", "id"], 5, same)
        got = retrieve.nearest_by_cells(q, held, ["scope"], ["query_id"], ["part", "id"], 5, same)
        cols = ["query_id", "rank", "part", "id", "similarity"]
        assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
    cells = retrieve.Cells(held)
    x = np.array([r[3] for r in v[:100]])
    share = cells.ranges.alive(x / np.linalg.norm(x, axis=1, keepdims=True), np.full(100, 0.99)).mean()
    assert share < (0.25 if spread < 1 else 1.01)


def test_ranges_as_blocks(spark):
    ranges = [(a, b) for a in (-9, -1, 0, 1, 5, 7, 8) for b in range(a, a + 20)] + [(1, 10_000_000), (3, 10_000_003), (5, 4)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(ranges)], "k int, a int, b int")
    got = {r["k"]: [(x["level"], x["block"]) for x in r["x"]] for r in df.select("k", structure.range_blocks(F.col("a"), F.col("b")).alias("x")).collect()}
    for k, (a, b) in enumerate(ranges):
        covered = sorted((n << level, (n + 1) << level) for level, n in got[k])
        assert len(got[k]) <= 50
        assert sum(z - x for x, z in covered) == max(0, b - a + 1)
        assert not covered or (covered[0][0], covered[-1][1]) == (a, b + 1) and all(x[1] == y[0] for x, y in zip(covered, covered[1:], strict=False))


def test_packing_of_many_parts(spark):
    rng = np.random.default_rng(9)
    for limit in (1, 7, 30):
        sizes = rng.integers(1, 12, 200)
        want, size = [], 0
        for k, n in enumerate(sizes):
            if not k or size + n > limit:
                want.append(k)
                size = 0
            size += n
        assert chunks.packed_starts(sizes, limit) == want
    long = spark.createDataFrame([("\n".join(f"part {i}" for i in range(300_000)), 1), (None, 2), ("   ", 3)], "text string, n int")
    got = chunks.pack_sections(long, limit=5000, heading=r"(?<=\n)").collect()
    assert {r["n"] for r in got} == {1} and all(len(r["chunk"]) <= 5000 for r in got)
    assert "".join(r["chunk"] for r in sorted(got, key=lambda r: r["chunk_no"])) == long.first()["text"]


def test_verification(spark):
    ex = spark.createDataFrame([(i, 1, "TORA is 3 610 m and LDA  2745 m") for i in range(1, 9)] + [(1, 2, "other 99")], "answer_id int, excerpt_no int, content string")
    fact = lambda v, n=1: [(v, "w", n)]
    rows = [
        (1, True, "It is 3610 m", "", fact("3 610 m")), (2, True, "It is 99", "", fact("99", 1)), (3, False, "no idea 7", "", []), (4, True, "x", "", []), (5, True, "865 more", "3610 - 2745 = 865", fact("lda 2745 m")),
        (6, True, "900", "3610 - 2745 = 900", fact("LDA 2745 m")), (7, True, "fine", "about half", fact("TORA")), (8, True, "fine", "", fact("TORA", 5)),
    ]
    an = spark.createDataFrame(rows, "answer_id int, answerable boolean, answer string, computation string, facts_used array<struct<value:string,what:string,source_excerpt:int>>")
    got = {r["answer_id"]: r for r in verify.verify_answers(an, ex).collect()}
    assert [got[i]["ok"] for i in range(1, 9)] == [True, False, True, False, True, False, False, False]
    q = spark.createDataFrame([(1, "what landing distance")], "query_id int, query string")
    e = spark.createDataFrame([(1, 1, "fuel only", 0.9), (1, 2, "landing distance is", 0.5)], "query_id int, excerpt_no int, content string, similarity double")
    assert verify.best_excerpt(q, e).first()["excerpt_no"] == 2


@pytest.mark.parametrize("by", ["words", "numbers"])
def test_excerpts_that_share_most(spark, by):
    rng = np.random.default_rng(6)
    stems = [f"word{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100)] if by == "words" else [str(i) for i in range(100)]
    weight = 1 / np.arange(1, 101)  # a few are in nearly all texts
    text = lambda n: " ; ".join(rng.choice(stems, n, p=weight / weight.sum()))
    e = [(i, text(int(rng.integers(0, 25)))) for i in range(150)] + [(150, None), (151, ""), (152, " ; ".join(stems))]
    q = [(i, c, i if i % 3 else None) for i, c in e[:60]] + [(900, "zzzz", None), (901, None, None), (902, " ; ".join(stems[:9]), 152)]
    find = (lambda t: set(re.findall(r"\b[a-z]{4,}\b", t or ""))) if by == "words" else (lambda t: set(re.findall(r"\d+", t or "")))
    want = set()
    for i, c, out in q:
        n = {j: len(find(c) & find(d)) for j, d in e if j != out}
        top = max(n.values())
        want |= {(i, j, top) for j, k in n.items() if k == top > 0}
    got = verify.most_shared(spark.createDataFrame(q, "query_id int, query string, leave_out int"), spark.createDataFrame(e, "excerpt_no int, content string"), by).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_fields(spark):
    df = spark.createDataFrame([(1, "Head: Runway 18L TORA=2745 m; Runway 18R TORA=3900 m LDA= 3900; Fuel type=Jet A1"), (2, "no pairs")], "query_id int, text string")
    f = verify.parse_field_table(df)
    assert [(r["label"], r["value"]) for r in f.orderBy("field_no").collect()] == [("Runway 18L TORA", "2745 m"), ("Runway 18R TORA", "3900 m"), ("Runway 18R LDA", "3900"), ("Fuel type", "Jet A1")]
    r = verify.rank_fields(f.select("query_id", "field_no", "label", "value").withColumns({"query": F.lit("fuel types at Lagos"), "place": F.lit("Lagos")})).orderBy("rank").collect()
    assert r[0]["label"] == "Fuel type" and r[0]["lead"]
    r = verify.rank_fields(f.select("query_id", "field_no", "label", "value").withColumns({"query": F.lit("TORA 18R"), "place": F.lit("")})).collect()
    assert {x["label"]: x["score"] for x in r}["Runway 18L TORA"] == -1


def test_sections_records_gate_and_distances(spark):
    c = spark.createDataFrame([("DNAA", "AD 2.2", 2, None, "b"), ("DNAA", "AD 2.2", 1, 0, "a"), ("DNAA", "AD 2.21", 1, 0, "x"), ("DNAA", "AD 2.2.1", 3, 0, "c")], "reference string, section string, source_page int, source_chunk int, content string")
    text = lambda m: retrieve.section_texts(c, "AD 2.2", m).first()["text"]
    assert text("exact") == "a\nb" and text("family") == "a\nb\nc" and "x" in text("prefix")
    r = spark.createDataFrame([("DNAA", "2.13", 1, '{"runway": "05", "tora_m": 3500}')], "scope_id string, subsection string, record_index int, record string")
    d = retrieve.records_for(r, "2.13", "runway string, tora_m int, toda_m int, asda_m int, lda_m int")
    assert d.first()["tora"] == 3500
    rq = spark.createDataFrame([(1, "DNAA", "5", ["TORA", "LDA"])], "request_id int, scope_id string, runway string, metrics array<string>")
    assert [(x["metric"], x["shown"]) for x in retrieve.distances_reply(rq, d).collect()] == [("TORA", "3500 m"), ("LDA", "not published")]
    q = spark.createDataFrame([(1, "AD", "subsection"), (2, "AD", "rwy_char"), (3, "ENR_AREA", "x"), (4, "ENR_AREA", "x")], "query_id int, scope_kind string, status string")
    h = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.5), (4, 0.1)], "query_id int, similarity double")
    assert {x["query_id"]: x["outcome"] for x in retrieve.facts_gate(q, h).collect()} == {1: "facts", 2: "rwy_char", 3: "facts", 4: "not_found"}
    hits = spark.createDataFrame([(1, "AD 2.4", 0.62), (1, "AD 2.5", 0.41), (2, "AD 2.4", 0.62), (2, "AD 2.5", 0.60), (3, "AD 2.4", 0.28), (4, "ENR 1", 0.9)], "query_id int, section string, similarity double")
    assert {x["query_id"]: x["section"] for x in retrieve.best_section(hits).collect()} == {1: "AD 2.4", 2: None, 3: None, 4: None}
    a = retrieve.search_attempts(spark.createDataFrame([(1, "ENR", "AIRSPACE", None), (2, None, None, "DNAA")], "query_id int, preferred_part string, preferred_reference string, scope_id string"))
    got = [(x["query_id"], x["part"], x["reference"]) for x in a.orderBy("query_id", "attempt").collect()]
    assert got[0] == (1, "ENR", "AIRSPACE") and len(got) == 9 and got[6:] == [(2, "AD", "DNAA"), (2, "ENR", "DNAA"), (2, "GEN", "DNAA")]
    fx = spark.createDataFrame([("AD", "DNAA", "2.1", "RWY", "a", "1", 2), ("AD", "DNAA", "2.1", "RWY", "b", "2", 1)], "scope_kind string, scope_id string, subsection string, entity string, label string, fact_value string, seq long")
    e = retrieve.facts_by_entity(fx).first()
    assert e["lines"] == ["b: 2", "a: 1"] and e["cite"] == "AD 2.1"


# log and evaluation


def test_followups_and_taps(spark):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    ctx = spark.createDataFrame([("c", t(0), "DNMM", '{"intent": "chart_retrieval", "runway": "18L", "raw": "ILS for 18L", "kind": "chart", "qid": "q1"}', "elevation of Lagos")], "chat string, ts timestamp, last_icao string, pending string, last_query string")
    base = [("Lagos", "aerodrome_fact", None, "Lagos", None, None, "DNMM"), ("what about fuel", "aerodrome_fact", None, None, None, None, None), ("fuel at Kano", "aerodrome_fact", "DNKN", "Kano", None, None, "DNKN")]
    rows = [("c", t(60), i, *b) for i, b in enumerate(base)] + [("c", t(600), 9, *base[1])]
    m = spark.createDataFrame(rows, "chat string, ts timestamp, n int, raw string, intent string, code string, name string, procedure_type string, runway string, resolved_id string")
    got = {r["n"]: r for r in log.fill_followups(log.context_asof(m, ctx)).collect()}
    assert got[0]["filled"] == "pending" and got[0]["runway"] == "18L" and got[0]["query"] == "ILS for 18L"
    assert got[1]["filled"] == "carried" and got[1]["resolved_id"] == "DNMM" and got[2]["filled"] == "none" and got[9]["filled"] == "none"
    taps = spark.createDataFrame([("chart", "q1", '{"kind": "chart", "qid": "q1"}'), ("chart", "q2", '{"kind": "chart", "qid": "q1"}'), ("chart", "q1", None)], "kind string, qid string, ctx_pending string")
    assert [r["outcome"] for r in log.pending_tap(taps).collect()] == ["acted", "expired", "expired"]
    assert spark.range(1).select(log.chat_hash(F.lit(5), None).alias("h")).first()["h"] is None


def test_scores(spark):
    rows = [
        ("facts", "AD 2.1", "exact", "3 610", None, "It is 3610 m", False), ("answer", "AD 2.2", "exact", "x", None, "see AD 2.2: y", False), ("answer", "AD 2.2", "exact", "y", None, "AD 2.22 y", False), ("answer", "2.3", "absent", "", None, "NIL", False),
        ("answer", "AD 2.4", "exact", "q", "clarify", "Which runway?", False), ("answer", "AD 2.4", "exact", "q", "clarify", "5", False), ("answer", "AD 2.4", "exact", "q", None, "publishes several", False), ("x", "AD 2.4", "exact", "q", None, "", True), ("answer", "AD 2.5", "tokens", "alpha beta", None, "AD 2.5 alpha", False),
    ]
    df = spark.createDataFrame(rows, "path string, subsection string, match_mode string, expected_value string, expected_behaviour string, reply string, harness_error boolean")
    assert [r["verdict"] for r in evaluate.verdicts(df).collect()] == ["PASS", "VALUE_MISS", "ROUTE_MISS", "ROUTE_MISS", "CLARIFY_OK", "CLARIFY_MISS", "GUARD_REFUSAL", "HARNESS_ERROR", "PASS"]
    gt = [("out_of_scope", "", "", "abstain", 0, None), ("multimodal", "DNAA chart", "", "chart", 1, "DNAA"), ("multimodal", "DNAA chart", "", "chart", 1, "DNBB"), ("mapping", "DNAA is Abuja", "abuja", "x", 0, None), ("currency", "", "AIRAC 03/2026", "x", 0, None), ("no_hallucination", "NIL", "it is nil", "x", 0, None), ("retrieval", "3 610 and 60", "3610 only", "answer", 0, None), ("retrieval", "3610", "", "not_in_aip", 0, None), ("retrieval", "words", "words", "answer", 0, None), ("structure", "ENR 5.1", "see ENR 5.1", "answer", 0, None)]
    g = spark.createDataFrame([(*r, None) for r in gt], "test_type string, ground_truth string, reply string, path string, charts int, icao string, sections array<string>")
    scored = evaluate.score_ground_truth(g)
    assert [r["verdict"] for r in scored.collect()] == ["PASS", "PASS", "PARTIAL", "PASS", "PASS", "PASS", "PARTIAL", "FAIL", "REVIEW", "PASS"]
    assert sum(sum(r[c] for c in ("pass", "partial", "fail", "review")) for r in evaluate.category_report(scored, "test_type").collect()) == 10
    inv = spark.createDataFrame([("answer", "DNAA", None, "Reference aid only 03/2026 [50% MATCH] yes", 0.3, "answer", None, None, ["yes"], 0.4), ("answer", "DNAA", None, "scale 1: bare", 0.9, "chart", None, None, ["no"], None)], "path string, icao string, ref string, reply string, similarity double, exp_path string, exp_icao string, exp_ref string, exp_contains array<string>, exp_min_similarity double")
    a, b = evaluate.invariant_checks(inv, "Reference aid only", "03/2026").collect()
    assert a["fails"] == [] and a["warns"] == ["low similarity"] and len(b["fails"]) == 6
    levels = {(r["level"], r["name"]): r for r in evaluate.verdict_levels(evaluate.verdicts(df).withColumn("corruption", F.lit("typo")).withColumn("subsection", F.lit(None).cast("string"))).collect()}
    assert set(levels) == {("subsection", None), ("corruption", "typo"), ("total", None)}
    assert {r["ok_pct"] for r in levels.values()} == {33}
