"""Registered queries and the pipeline against brute force over a whole small table."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from string import ascii_uppercase, digits

import numpy as np
import pytest
from test_llm_operators import PLAIN, WORD, brute_components, brute_counts, brute_fp, low

from test_near_copies import brute_kept as brute_single

import corpus_pipeline
from docfacts.llm import language_id, quality_rules
from docfacts.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet").collect()


def brute_features(text):
    t = text or ""
    words, chars, symbols, dup_lines, repeat = brute_counts(t)
    lines = sum(bool(PLAIN.search(x)) for x in t.split("\n"))
    w = PLAIN.findall(t)
    return {
        "n_words": float(words),
        "mean_word": chars / max(words, 1),
        "symbols_per_word": symbols / max(words, 1),
        "dup_line_share": dup_lines / max(lines, 1),
        "repeat_share": repeat / max(words, 1),
        "words_per_line": words / max(lines, 1),
        "upper_share": sum(c in ascii_uppercase for c in t) / max(chars, 1),
        "digit_share": sum(c in digits for c in t) / max(chars, 1),
        "bangs_per_word": t.count("!") / max(words, 1),
        "pipes_per_word": t.count(" | ") / max(words, 1),
        "stops_per_word": t.count(".") / max(words, 1),
        "stutters_per_word": sum(a == b for a, b in zip(w, w[1:], strict=False)) / max(words, 1),
    }


def brute_kept(text, rules):
    words, *_, repeat = brute_counts(text)
    if words < 20 or 100 * repeat > 30 * words:
        return False
    x = brute_features(text)
    return not any(all(c.holds(x) for c in rule.conditions) for rule in rules)


def grams(text):
    """Letters in lower case, all else a blank; pairs and triples with a letter in them."""
    t = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text or "")
    return Counter(t[i : i + n] for n in language_id.SIZES for i in range(len(t) - n + 1) if t[i : i + n].strip(" "))


def brute_bucket(gram):
    h = 2166136261 + len(gram)
    for c in gram:
        h = (h ^ ord(c)) * 16777619 % 2**32
    return (h ^ h >> 15) % language_id.BUCKETS


def brute_languages(rows):
    """For each language the log-probability of each bucket and the log of its share."""
    seen, n = defaultdict(Counter), Counter(r["lang"] for r in rows if r["lang"] is not None)
    for r in rows:
        if r["lang"] is not None:
            for g, k in grams(r["text"]).items():
                seen[r["lang"]][brute_bucket(g)] += k
    out = {}
    for lang, c in seen.items():
        total = sum(c.values()) + 0.5 * language_id.BUCKETS
        out[lang] = (lambda b, c=c, total=total: math.log((c[b] + 0.5) / total)), math.log(n[lang] / sum(n.values()))
    return out


def brute_floor(p):
    logs = [p(b) for b in range(language_id.BUCKETS)]
    own = sum(math.exp(x) * x for x in logs)
    return own - (own - sum(logs) / len(logs)) / 3


def brute_language(text, model, floors=None):
    """Language, posterior, and, with floors, whether the mean log-probability of an n-gram reaches the language's."""
    g = grams(text)
    if not g:
        return ("und", 0.0, False)[: 3 if floors else 2]
    fit = {lang: sum(k * p(brute_bucket(x)) for x, k in g.items()) for lang, (p, _) in sorted(model.items())}
    z = {lang: fit[lang] + model[lang][1] for lang in fit}
    top = max(z.values())
    best = next(lang for lang in z if z[lang] == top)
    found = best, 1 / sum(math.exp(v - top) for v in z.values())
    return (*found, fit[best] / g.total() >= floors[best]) if floors else found


def brute_windows(items):
    out = defaultdict(set)
    for r in items:
        w = WORD.findall(low(r["text"]))
        for i in range(max(1, len(w) - 12) if w else 0):
            out[tuple(w[i : i + 13])].add(str(r["item_id"]))
    return out


def brute_contamination(text, windows):
    w, hit, found = WORD.findall(low(text)), set(), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if own := windows.get(tuple(w[i : i + n])):
                hit |= set(range(i, i + n))
                found |= own
    return len(w), len(hit), sorted(found)


def brute_pieces(rows):
    from tokenizers import Tokenizer

    plain, out = Tokenizer.from_file(tokenizer_path()), Counter()
    for r in rows:
        x = np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        head = len(x) % 2048 if len(x) > 2048 else len(x)
        cuts = ([(0, head)] if head else []) + [(a, 2048) for a in range(head, len(x), 2048)]
        out.update((r["doc_id"], k, a, n, zlib.crc32(x[a : a + n].tobytes())) for k, (a, n) in enumerate(cuts))
    return out


def check_packed(got, rows):
    want = brute_pieces(rows)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    room = defaultdict(list)
    for r in got:
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for placed in room.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= 2048
    least = math.ceil(sum(n for *_, n, _ in want.elements()) / 2048)
    assert len(room) <= 1.01 * least + 1


def test_pipeline(spark, documents, benchmark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality_rules.fit(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [r for r in documents if brute_kept(r["text"], rules)]
    model = brute_languages(kept)
    floors = {lang: brute_floor(p) for lang, (p, _) in model.items()}
    kept = [r for r in kept if (x := brute_language(r["text"], model, floors))[0] != "und" and x[1] >= 0.5 and x[2]]
    # near copies: five-word shingles with a Jaccard similarity of 0.8 or more
    single = set(brute_single([r["doc_id"] for r in kept], [r["text"] for r in kept]))
    kept = [r for r in kept if r["doc_id"] in single]
    windows = brute_windows(benchmark)
    judged = [(r, brute_contamination(r["text"], windows)) for r in kept]
    kept = [r for r, (n, h, _) in judged if not (h > 0 and 20 * h >= n)]
    assert 0 < len(kept) < len(documents)
    check_packed(corpus_pipeline.run(spark, SF).collect(), kept)


def test_sharding(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op2_sharding"](spark, SF).collect()}
    assert len(got) == len(documents)
    groups, shards, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in documents:
        raw, x = (r["text"] or "").encode(), got[r["doc_id"]]
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        groups[raw].add(x["shard"])
        shards[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
    assert all(len(s) == 1 for s in groups.values()) and set(shards) <= set(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in documents:
        sizes[hashlib.sha256((r["text"] or "").encode()).hexdigest()[:32]] += got[r["doc_id"]]["size"]
    ordered = [sizes[k] for k in sorted(sizes)]

    def needs(capacity):
        n, room = 0, 0
        for s in ordered:
            if s > room:
                n, room = n + 1, capacity
            room -= s
        return n

    assert needs(max(shards.values())) <= 8 < needs(max(shards.values()) - 1)


def test_language(spark, documents):
    model = brute_languages([r for r in documents if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2])
    got = {r["doc_id"]: r for r in QUERIES["op3_language_id"](spark, SF).collect()}
    for r in documents:
        lang, score = brute_language(r["text"], model)
        assert got[r["doc_id"]]["lang_pred"] == lang and got[r["doc_id"]]["score"] == pytest.approx(score, abs=1e-6)


def test_simhash(spark, documents):
    fps = {r["doc_id"]: brute_fp(r["text"]) for r in documents}
    root, first = brute_components(set(fps.values())), {}
    for i in sorted(fps):
        first.setdefault(root[fps[i]], i)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in QUERIES["op4_simhash_near_dedup"](spark, SF).collect()}
    assert got == {i: (f"{f:016x}", first[root[f]]) for i, f in fps.items()}


def test_packing(spark, documents):
    check_packed(QUERIES["op6_packing"](spark, SF).collect(), documents)


def test_licenses(spark, documents):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    got = {r["doc_id"]: r for r in QUERIES["op7_license_scan"](spark, SF).collect()}
    assert len(got) == len(documents)
    for r in documents:
        w, places, labels = WORD.findall(low(r["text"])), [], set()
        for p, label in phrases.items():
            p = p.split()
            at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        x = got[r["doc_id"]]
        want = (len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == want
        assert labels <= set(filter(None, x["labels"].split(","))) and 0 <= x["score"] <= 1


def test_quality_rules(spark, documents):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rules = quality_rules.fit(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = {r["doc_id"]: r for r in QUERIES["op10_quality_rules"](spark, SF).collect()}
    for r in documents:
        counts, x = brute_counts(r["text"]), got[r["doc_id"]]
        assert tuple(x[n] for n in names) == counts
        assert x["base_failed"] == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert x["kept"] == brute_kept(r["text"], rules)


def test_html(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = QUERIES["op8_html_extraction"](spark, SF).collect()
    assert Counter((r["page_id"], r["url"]) for r in got) == Counter((r["page_id"], r["url"]) for r in pages)
    assert all(r["n_chars"] == len(r["text"]) and not re.search(r"<\w+|[ \t]{2}|\n{3}", r["text"]) for r in got)
