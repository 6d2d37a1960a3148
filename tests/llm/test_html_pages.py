"""HTML extraction over whole small tables, against independent extraction and brute-force differencing."""

import re
from html.parser import HTMLParser
from os.path import commonprefix

import numpy as np
import pytest
from pyspark.sql import functions as F

from docfacts.llm import html_extract
from docfacts.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def page(k):
    return f"<body><div><p>Site name</p><h1>Headline {k}</h1></div><article><p>Lead {k}</p></article><div><p>Second part {k}</p><p>Read more here</p></div><div class='menu'>Menu {k}</div></body>"


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_own_lines_beside_an_article_stay_and_shared_ones_go(spark):
    rows = [(k, f"http://h/a/{k}", page(k)) for k in (1, 2)]
    got = html_extract.extract(frame(spark, rows).coalesce(1)).collect()
    assert {r["page_id"]: r["text"] for r in got} == {k: f"Headline {k}\n\nLead {k}\n\nSecond part {k}" for k in (1, 2)}
    assert [r["n_shared"] for r in got] == [2, 2]


class Articles(HTMLParser):
    """Blocks of the article element, by the standard library's parser."""

    def __init__(self, text):
        super().__init__()
        self.inside, self.found, self.now = False, [], ""
        self.feed(text)

    def handle_starttag(self, tag, attrs):
        self.step(tag)
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        self.step(tag)
        self.inside &= tag != "article"

    def step(self, tag):
        if tag == "br":
            self.now += " "
        elif tag in ("article", "p", "h1"):
            if self.inside and self.now.split():
                self.found.append(re.sub(r"\s+", " ", self.now).strip())
            self.now = ""

    def handle_data(self, data):
        self.now += data


def test_whole_table_against_the_standard_parser(spark):
    got = QUERIES["op8_html_extraction"](spark, SF).collect()
    want = {r["page_id"]: "\n\n".join(Articles(r["html"] or "").found) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(want) and {r["page_id"]: r["text"] for r in got} == want


def longest(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def brute(rows):
    """rows: page_id, host, path, link, print, lines with zones. For each page its lines kept, as a number and a text
    where the alignment is unique."""
    order = sorted({tuple(r[1:5]) for r in rows})
    lines = {tuple(r[1:5]): r[5] for r in rows}
    out = {}
    for r in rows:
        key = tuple(r[1:5])
        at, own = order.index(key), lines[key]
        near = [k for k in order[max(0, at - 2) : at + 3] if k != key and k[0] == key[0] != ""]
        near.sort(key=lambda k: -len(commonprefix((k[1], key[1]))))
        shared = set()
        live = sum(len(t) for t, z in own if z != 2)
        for k in near:
            found = html_extract.common_lines([t for t, _ in own], [t for t, _ in lines[k]])
            assert len(found) == longest([t for t, _ in own], [t for t, _ in lines[k]])
            if sum(len(own[i][0]) for i in found if own[i][1] != 2) <= 0.8 * live:
                shared = found
                break
        out[r[0]] = "\n\n".join(t for i, (t, z) in enumerate(own) if z == 1 or (z == 0 and i not in shared))
    return out


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pages_without_article_elements(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")
    renamed = pages.withColumn("html", F.regexp_replace("html", r"(</?)article\b", "$1div"))
    keyed = html_extract._keyed(renamed).collect()
    want = brute([(r["page_id"], r["host"], r["path"], r["link"], r["print"], html_extract.blocks(r["html"])) for r in keyed])
    got = html_extract.extract(renamed).collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    truth = {r["page_id"]: "\n\n".join(Articles(r["html"] or "").found) for r in pages.collect()}
    same = sum(want[k] == truth[k] for k in truth) / len(truth)
    assert same > 0.9  # the others share passages with the page compared with


def test_results_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(160):
        section = int(rng.integers(0, 5))
        body = "".join(f"<p>own text {k} line {j}</p>" for j in range(4))
        rows.append((k, f"http://h/{section}/{int(rng.integers(0, 60)):02d}", f"<div><p>Menu of section {section}</p><p>Site</p></div><div>{body}</div><div><p>Imprint</p></div>"))
    rows += [rows[5]] * 30 + [(500 + k, rows[9][1], rows[9][2]) for k in range(30)]
    key = "spark.sql.shuffle.partitions"
    before, found = spark.conf.get(key), []
    try:
        for n in ("1", "4", "64"):
            spark.conf.set(key, n)
            got = html_extract.extract(frame(spark, rows).repartition(int(n))).collect()
            found.append(sorted((r["page_id"], r["text"], r["n_shared"]) for r in got))
    finally:
        spark.conf.set(key, before)
    assert len(found[0]) == len(rows) and found[0] == found[1] == found[2]
    assert {r[0]: r[1] for r in found[0]} == {r[0]: "\n\n".join(f"own text {r[0] if r[0] < 500 else 9} line {j}" for j in range(4)) for r in rows}
    assert all(n == 3 or n == 2 for *_, n in found[0])


def test_odd_tables(spark):
    long = "<article>" + "<p>word " * 60_000 + "</article>"
    rows = [(1, None, None, "x", 1), (None, "http://h/a", long, "x", 2), (3, "http://h/a", "<p>a", "x", 3), (3, "http://h/a", "<p>a", "x", 3), (4, "no url", "", None, 4)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, host string, text int")
    got = html_extract.extract(odd).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == 5 and text[1] == text[4] == "" and text[3] == "a" and text[None].count("word") == 60_000
    assert html_extract.extract(odd.limit(0)).count() == 0
