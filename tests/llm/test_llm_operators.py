"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docfacts.llm import (
    chat_format,
    components,
    decontaminate,
    html_extract,
    language_id,
    license_scan,
    packing,
    quality_cnn,
    quality_rules,
    sharding,
    simhash,
)

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, score string, row_no string, c0 string"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
PLAIN = re.compile("[^\x20\x09-\x0d]+")


def low(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


@pytest.fixture(scope="module")
def texts():
    base = "the quick brown fox jumps over the lazy dog near a river bank while birds sing in old tall trees"
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(9000))
    out = [
        base,
        base,
        base.upper(),
        base.replace("lazy", "sleepy"),
        None,
        "",
        " \n\t ",
        "one",
        "one two",
        "Ünï çödé ß   text 12 345",
        "released under the MIT License. also Apache-License, and MIT License",
        "GNU General Public License version 3; general public license",
        "This work is licensed under the GNU General Public License, version 3.",
        "a\nb\na\nb\n\n \nc",
        "x y z " * 40,
        long,
        "!!! $$$ ### | & < >",
        "say <|endoftext|> twice <|endoftext|>",
        "many   blanks \n \n between\x1cwords  ",
    ]
    return out


@pytest.fixture(scope="module")
def documents(spark, texts):
    ids = [*range(len(texts) - 3), None, 3, 3]
    rows = [(i, t, "en", "s", None, "x", "x", "x", "x", "x") for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 0), (14, 0, 0), (14, 0, 1), (None, 1, 0), (3, None, None), (99, 0, 0)], "doc_id long, quality int, toxic int")


def by_text(rows, *fields):
    out = defaultdict(set)
    for r in rows:
        out[r["text"]].add(tuple(r[f] for f in fields))
    return out


# quality rules


def brute_counts(text):
    text = text or ""
    words = PLAIN.findall(text)
    lines = [x for x in text.split("\n") if PLAIN.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeated = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(repeated),
    )


def test_quality_counts(texts):
    for t in texts:
        assert quality_rules.text_counts(t or "")[:5] == brute_counts(t)


def test_quality_rules_learn_and_keep(spark, documents, labels, empty):
    rng = np.random.default_rng(1)
    x = {"a": rng.random(300), "b": rng.random(300)}
    bad = (x["a"] > 0.7) & (x["b"] < 0.5)
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(300, bool)
    for r in rules:
        hit |= quality_rules._covered(r.conditions, x, 300)
    assert rules and (hit & ~bad).sum() <= 3 and (hit & bad).sum() > 0.8 * bad.sum()
    fitted = quality_rules.fit(documents, labels)
    judged = quality_rules.judge(documents, fitted).collect()
    assert len(judged) == documents.count()
    assert all(r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) for r in judged)
    assert not any(r["kept"] for r in judged if r["base_failed"])
    kept = quality_rules.keep_documents(documents, fitted)
    assert kept.columns == documents.columns and kept.count() == sum(r["kept"] for r in judged)
    assert quality_rules.judge(empty, quality_rules.fit(empty, labels)).count() == 0


# quality classifier


def test_cnn_is_bounded_and_equal_texts_score_alike(documents, labels, empty):
    net = quality_cnn.fit(documents, labels, steps=20)
    rows = quality_cnn.score(documents, net).collect()
    assert len(rows) == documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    alone = net.probability(net.pooled([b"abc " * 999]))
    beside = net.probability(net.pooled([b"zzz", b"abc " * 999, b"", b"q" * 300]))
    assert np.isclose(alone[0], beside[1])
    long = b"word " * (3 * quality_cnn.BLOCK // 5)
    assert np.isfinite(net.pooled([long])).all()
    assert quality_cnn.score(empty, quality_cnn.fit(empty, labels)).count() == 0


def naive_pooled(net, raw):
    """Every filter at every STEP bytes of every chunk, one by one."""
    c, step, width = quality_cnn.CELL, quality_cnn.STEP, quality_cnn.WIDTH
    n = max(1, -(-len(raw) // c))
    padded = raw.ljust(n * c, b"\0") + b"\0" * width
    responses = []
    for cell in range(n):
        own = []
        for at in range(cell * c, min((cell + 1) * c, len(raw)), step):
            x = [v for k in padded[at : at + width] for v in (net.embed[k] if k else [0.0] * quality_cnn.EMBED)]
            for k in (at, at + step):
                start, four = k // c * c, padded[k : k + 4]
                own_four = k + 4 <= start + c and four != b"\0" * 4 and k < n * c
                x.append(float(own_four and any(k - lag >= start and padded[k - lag : k - lag + 4] == four for lag in quality_cnn.LAGS)))
            own.append(np.maximum(np.array(x) @ net.filters + net.bias, 0))
        responses.append(own)
    chunks = [responses[i] + responses[i + 1] for i in range(n - 1)] or [responses[0]]
    return np.max([np.mean(x, 0) if x else np.zeros(quality_cnn.FILTERS) for x in chunks], 0)


def test_cnn_against_a_naive_convolution():
    rng = np.random.default_rng(12)
    net = quality_cnn.Network.fresh()
    net.out = rng.normal(0, 1, quality_cnn.FILTERS + 1).astype(np.float32)
    texts = [b"", b"x", b"hello world " * 40, bytes(rng.integers(32, 127, 1500, dtype=np.uint8)), b"abab" * 64, b"q" * 257, bytes(rng.integers(1, 255, 512, dtype=np.uint8))]
    got = net.pooled(texts)
    for k, t in enumerate(texts):
        assert np.allclose(got[k], naive_pooled(net, t), atol=1e-4), k
        assert np.allclose(net.pooled([t]), got[k], atol=1e-5)  # whatever stands beside it in the batch


def test_cnn_learns_and_its_loss_falls():
    texts, good = [b"hello world, plain text here", b"XX!! YY!! ZZ!! " * 30], np.array([1.0, 0.0])
    net = quality_cnn.train(texts * 8, np.tile(good, 8), steps=60, batch=4)
    p = net.probability(net.pooled(texts))
    assert p[0] > 0.7 and p[1] < 0.3


def test_training_sample_is_bounded_before_it_travels(spark):
    docs = spark.createDataFrame([(i, "x" * (100 if i % 3 else 900)) for i in range(90)] * 2, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    rows = quality_cnn.sample(docs, marks, 40, 8000).collect()
    assert 5 < len(rows) <= 40 and sum(len(r["text"]) for r in rows) <= 8000
    assert quality_cnn.sample(docs, marks, 3000, 10**7).count() == 90
    assert quality_cnn.fitting([5, 100, 3, 3, 1], 9) == [0, 2, 4]
    long = spark.createDataFrame([(i, "y" * 20_000) for i in range(0, 90, 9)], "doc_id long, text string")
    others = quality_cnn.sample(docs.where("doc_id % 9 > 0").unionByName(long), marks, 3000, 15_000).collect()
    assert 15_000 - 100 <= sum(len(r["text"]) for r in others) <= 15_000 and not any("y" in r["text"] for r in others)


def test_rules_hold_no_threshold_twice():
    rng = np.random.default_rng(5)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    for rule in quality_rules.learn(x, x["a"] ** 2 + x["b"] ** 2 < 0.3):
        assert len({(c.feature, c.at_least) for c in rule.conditions}) == len(rule.conditions)


# language ID


def test_language_pieces_count_each_ngram_once(monkeypatch):
    text = "abc déf " * 50
    whole = np.sort(language_id.hashed([(0, text, True)])[0])
    monkeypatch.setattr(language_id, "PIECE", 37)
    parts = np.sort(np.concatenate([language_id.hashed(g)[0] for g in language_id._groups([text])]))
    assert np.array_equal(whole, parts)


def test_language_id(spark, documents, empty):
    rows = spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = language_id.fit(rows)
    assert model.langs == ["de", "en", "fr"]
    assert model.score(["the dog", "die und der", "", "12 !?"])[0] == ["en", "de", "und", "und"]
    assert model.score(["\U00030001"])[0] != ["und"]  # a letter beyond the common planes
    found = language_id.predict(documents, model).collect()
    assert len(found) == documents.count() and all(0 <= r["score"] <= 1 for r in found)
    assert language_id.keep_identified(documents, model).columns == documents.columns
    nothing = language_id.fit(rows.limit(0))
    assert {r["lang_pred"] for r in language_id.predict(documents, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


def test_many_languages(spark, monkeypatch):
    rows = spark.createDataFrame([("some words of " * 3 + str(i), f"l{i % 90}") for i in range(180)], "text string, lang string").coalesce(1)
    whole = {(r["lang"], r["bucket"]): r["n"] for r in language_id.count(rows).collect()}
    monkeypatch.setattr(language_id, "HELD", 1000)
    assert {(r["lang"], r["bucket"]): r["n"] for r in language_id.count(rows).collect()} == whole


def test_more_languages_than_a_model_has(spark, monkeypatch):
    rng = np.random.default_rng(8)
    words = [["".join(rng.choice(list("abcdefghijklmnop"), 4)) for _ in range(12)] for _ in range(100)]
    text = lambda k: " ".join(rng.choice(words[k], 9))
    known = [(text(i % 100), f"l{i % 100:03}") for i in range(400)] + [(text(0), None), (None, "l007")]
    asked = [(i, text(i % 100), "a", "b") for i in range(150)] + [(5, None, "a", "b"), (None, "12 !", "a", "b"), (6, text(6), "a", "b"), (6, "ßßß zzz qqq", "a", "b")]
    rows = spark.createDataFrame(known, "text string, lang string").repartition(3)
    docs = spark.createDataFrame(asked, "doc_id long, text string, lang string, row_no string").repartition(3)

    def found(model):
        return Counter((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.predict(docs, model).collect())

    one = language_id.fit(rows)
    assert isinstance(one, language_id.Model) and len(one.langs) == 100
    whole, kept = found(one), Counter(map(tuple, language_id.keep_identified(docs, one).collect()))
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 7)
    many = language_id.fit(rows)
    assert isinstance(many, language_id.Models) and [len(m.langs) for m in many.each()] == [7] * 14 + [2]
    assert found(many) == whole
    again = language_id.keep_identified(docs, many)
    assert again.columns == docs.columns and Counter(map(tuple, again.collect())) == kept and 100 < sum(kept.values()) < 154
    assert language_id.predict(docs.limit(0), many).count() == 0


# SimHash


def brute_fp(text):
    w = PLAIN.findall(low(text))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)]
    ones = [0] * 64
    for s in sh:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(sh))


def brute_components(fps):
    root = {f: f for f in fps}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def test_fingerprints_and_components(documents, texts, empty):
    got = simhash.near_duplicates(documents).collect()
    assert len(got) == len(texts)
    ids = [*range(len(texts) - 3), None, 3, 3]
    fps = [brute_fp(t) for t in texts]
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((i, f"{f:016x}") for i, f in zip(ids, fps, strict=True))
    root, least = brute_components(set(fps)), {}
    for i, f in zip(ids, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert all(r["component_id"] == least.get(root[int(r["fingerprint"], 16)]) for r in got)
    kept = simhash.keep_one(documents)
    assert kept.columns == documents.columns and kept.count() == len(set(root.values()))
    assert simhash.near_duplicates(empty).count() == 0


def test_links_over_crowded_tiles(spark):
    rng = np.random.default_rng(3)
    centre = rng.integers(-(2**62), 2**62, 6)
    fps = set()
    for c in centre:
        for _ in range(60):
            x = int(c)
            for b in rng.integers(0, 63, rng.integers(0, 5)):
                x ^= 1 << int(b)
            fps.add(x)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute_components(fps)
    for tile in (4096, 16):
        found = {r["node"]: r["root"] for r in components.components(simhash.links(nodes, tile=tile)).collect()}
        assert {f: found.get(f, f) for f in fps} == want


def test_links_that_differ_in_the_sign_bit(spark):
    rng = np.random.default_rng(4)
    for _ in range(20):
        x = int(rng.integers(-(2**63), 2**63 - 1))
        y = (x ^ (1 << 63) ^ (1 << int(rng.integers(0, 63)))) % 2**64
        y -= (y >> 63) << 64
        a, b = simhash.forest(np.array([x, y], np.int64))
        assert {int(a[0]), int(b[0])} == {x, y}
    nodes = spark.createDataFrame([(5,), (5 - 2**63,), (0xFFFF << 40,)], "fp long")
    assert {tuple(sorted(r)) for r in simhash.links(nodes).collect()} == {(5 - 2**63, 5)}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 60)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[k] == 100 for k in range(100, 141)) and all(got[k] == 7 for k in range(7, 60))


# decontamination


def brute_hits(text, items):
    w = WORD.findall(low(text))
    hit, found = set(), set()
    for item, t in items:
        v = WORD.findall(low(t))
        for i in range(max(1, len(v) - 12) if v else 0):
            win = v[i : i + 13]
            for a in range(len(w) - len(win) + 1):
                if w[a : a + len(win)] == win:
                    hit |= set(range(a, a + len(win)))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_decontamination(spark, documents, texts, empty):
    items = [(10, texts[0]), (2, "lazy dog"), (3, None), (4, "..."), (2, "lazy dog"), (5, texts[0][20:]), (6, "x y z x y z x y z x y z x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    for i, t in zip([*range(len(texts) - 3), None, 3, 3], texts, strict=True):
        n, h, f = brute_hits(t, items)
        want[(i, n, h, len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), h > 0 and 20 * h >= n)] += 1
    for bits in (decontaminate.MOST_BITS, 8):  # with so few bits nearly every shingle travels
        got = decontaminate.scan(documents, bench, most_bits=bits).drop("items").collect()
        assert Counter(map(tuple, got)) == want
        clean = decontaminate.keep_clean(documents, bench, most_bits=bits)
        assert clean.columns == documents.columns
        assert Counter(r["doc_id"] for r in clean.collect()) == Counter(k[0] for k in want.elements() if not k[-1])
    assert decontaminate.scan(empty, bench).count() == 0
    assert not any(r["contaminated"] for r in decontaminate.scan(documents, bench.limit(0)).collect())


# packing


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_packing_round_trip(documents, texts, empty, vocabulary):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary)
    ids = [np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for t in texts]
    want = Counter()
    for i, x in zip([*range(len(texts) - 3), None, 3, 3], ids, strict=True):
        head = len(x) % 2048 if len(x) > 2048 else len(x)
        cuts = ([(0, head)] if head else []) + [(a, 2048) for a in range(head, len(x), 2048)]
        for k, (a, n) in enumerate(cuts):
            want[(i, k, a, n, zlib.crc32(x[a : a + n].tobytes()))] += 1
    got = packing.pack(documents, vocabulary).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    room = defaultdict(list)
    for r in got:
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in room.values():
        at = 0
        for offset, n in sorted(rows):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(room) == math.ceil(sum(map(len, ids)) / 2048) or len(room) <= 1 + math.ceil(sum(map(len, ids)) / 2048)
    assert packing.pack(empty, vocabulary).count() == 0


def test_tokens_equal_the_tokenizer(vocabulary):
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(vocabulary), packing.Tokens(vocabulary)
    rng = np.random.default_rng(5)
    letters = list("ab eé'st  \n\t \x1c!1") + ["'ll ", "   "]
    for _ in range(300):
        t = "".join(rng.choice(letters, rng.integers(0, 30)))
        assert np.frombuffer(own(t), "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_genetic_packing_over_blocks(spark, vocabulary):
    rng = np.random.default_rng(2)
    length = rng.integers(1, 1500, 600)
    people = packing.evolve(length, [], None, 2048, 1)
    child = packing.crossover(people[0], packing.evolve(length, [], None, 2048, 2)[0], length, 2048, rng)
    for own in (*people, child):
        assert sorted(set(own.tolist())) == list(range(own.max() + 1))
        assert packing.fills(own, length).max() <= 2048
    docs = spark.createDataFrame([(i, "word " * (n // 3)) for i, n in enumerate(length.tolist())], "doc_id long, text string")
    got = packing.pack(docs, vocabulary, block=100).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in got) <= 2048
    assert len(got) <= 1.02 * math.ceil(sum(r["n"] for r in got) / 2048) + 1


def triplets(bins, seed):
    """Pieces that fill so many bins without waste, three each, hard for best fit."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(bins):
        a, b = rng.integers(512, 922, 2).tolist()
        out += [a, b, 2048 - a - b]
    return np.array(out)


def test_genetic_packing_beats_best_fit(spark):
    for seed in range(3):
        length = triplets(40, seed)
        plain = packing.pack_in_order(np.argsort(-length, kind="stable"), length, 2048).max() + 1
        elite, people = plain, []
        for n in range(6):
            people = packing.evolve(length, people, None, 2048, n, children=100)
            assert people[0].max() + 1 <= elite  # populations live on, so nothing is lost
            elite = people[0].max() + 1
        assert 40 <= elite < plain
    items = spark.createDataFrame([(i, n) for i, n in enumerate(triplets(40, 0).tolist())], "uid long, length long")
    rows = packing.pack_blocks(items, 1, 2048).collect()
    assert len({r["bin"] for r in rows}) < packing.pack_in_order(np.argsort(-triplets(40, 0), kind="stable"), triplets(40, 0), 2048).max() + 1


def test_small_blocks_are_packed_as_well_as_can_be():
    rng = np.random.default_rng(9)
    for _ in range(30):
        length = rng.integers(200, 1500, 7)
        best = min(_fewest(length.tolist(), order) for order in permutations(range(7)))
        people = packing.evolve(length, [], None, 2048, 1, children=60)
        assert people[0].max() + 1 == best


def _fewest(length, order):
    n, room = 0, 0
    for i in order:
        if length[i] > room:
            n, room = n + 1, 2048
        room -= length[i]
    return n


def test_lengths_that_fill_no_bin_are_dealt_to_the_end(spark, vocabulary):
    docs = spark.createDataFrame([(i, "word " * 1100) for i in range(60)], "doc_id long, text string")
    got = packing.pack(docs, vocabulary, block=8).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert len(got) == 60 and {r["n"] for r in got} == {1102}


def test_other_vocabulary_files_are_left_to_the_library(vocabulary, tmp_path):
    import json

    spec = json.load(open(vocabulary, encoding="utf-8"))
    assert packing.plain_ranks(spec) and packing.Tokens(vocabulary).encode
    other = json.loads(json.dumps(spec))
    other["normalizer"] = {"type": "Lowercase"}
    swapped = json.loads(json.dumps(spec))
    swapped["model"]["merges"][5:7] = swapped["model"]["merges"][6:4:-1]
    for k, changed in enumerate((other, swapped)):
        path = tmp_path / f"{k}.json"
        path.write_text(json.dumps(changed), encoding="utf-8")
        own = packing.Tokens(str(path))
        assert own.encode is None
        from tokenizers import Tokenizer

        assert np.frombuffer(own("The Cat sat"), "<u4").tolist() == Tokenizer.from_file(str(path)).encode("The Cat sat", add_special_tokens=False).ids


# license scan


def test_license_scan(documents, texts, empty):
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = Counter()
    for i, t in zip([*range(len(texts) - 3), None, 3, 3], texts, strict=True):
        w, at, base = WORD.findall(low(t)), [], set()
        for p, label in phrases.items():
            v = p.split()
            for a in range(len(w) - len(v) + 1):
                if w[a : a + len(v)] == v:
                    at.append(a)
                    base.add(label)
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)))] += 1
    for bound in (400_000, 0):
        got = license_scan.scan(documents, broadcast_rows=bound).collect()
        assert Counter(tuple(r)[:6] for r in got) == want
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) for r in got)
        assert all(0 <= r["score"] <= 1 for r in got)
    assert license_scan.scan(empty).count() == 0


def test_notice_with_a_word_more(spark):
    rows = [(1, "x " * 50 + "Redistribution and use in source and also binary forms, with or without modification, are permitted")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).first()
    assert got["labels"] == "bsd" and got["base_labels"] == "" and got["score"] > 0.7


def test_pairs_of_a_notice_set_apart_are_no_notice(spark):
    notice = next(iter(license_scan.NOTICES)).split()
    apart = " ".join(f"{a} {b} and then words of its own {k}" for k, (a, b) in enumerate(zip(notice, notice[1:], strict=False)))
    turned = " ".join(f"{a} {b}" for a, b in reversed(list(zip(notice[::2], notice[1::2], strict=False))))
    rows = [(1, apart), (2, turned), (3, "so " * 9 + " ".join(notice) + " so" * 9), (4, " ".join(notice[4:])), (5, None)]
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k]["labels"] for k in (1, 2, 3, 4, 5)] == ["", "", "mit", "mit", ""]
    assert [tuple(x) for x in got[3]["spans"]] == [(9, 9 + len(notice), "mit")] and got[3]["score"] == 1.0


def test_whole_licence_texts(spark):
    bodies = license_scan.BODIES
    rng = np.random.default_rng(12)
    prose = lambda n: " ".join(rng.choice("the of and to in is that for this software license any copyright notice shall be".split(), n))
    rows, want = [], {}
    for k, (label, text) in enumerate(bodies.items()):
        words = text.split()
        rows.append((k, f"{prose(40)}\n{text}\n{prose(40)}"))
        want[k] = label
        changed = [w if i % 40 != 20 else "Contributors of X" for i, w in enumerate(words)]  # names put in here and there
        rows.append((100 + k, " * ".join(changed)))
        want[100 + k] = label
        rows.append((200 + k, " ".join(words[: len(words) // 4])))  # a quarter is no licence text
        rows.append((300 + k, " ".join(f"{a} {b} {prose(3)}" for a, b in zip(words[::2], words[1::2], strict=False))))  # nor are its pairs set apart
    rows += [(400, "// SPDX-License-Identifier: MPL-2.0"), (401, "SPDX-License-Identifier: ISC and SPDX-License-Identifier: CC0-1.0"), (402, "spdx license"), (403, prose(4000))]
    want |= {400: "mpl", 401: "cc0,isc", 402: "", 403: ""}
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in want.items():
        found = set(got[k]["labels"].split(","))
        assert set(label.split(",")) <= found, (k, label, found)
        assert len(found) <= 3, (k, found)
    for k, label in enumerate(bodies):
        assert max(z - a for a, z, x in got[k]["spans"] if x == label) > 0.9 * len(license_scan.plain_words(bodies[label]))
        spans = {x for a, z, x in got[200 + k]["spans"] if z - a > 40} | {x for a, z, x in got[300 + k]["spans"] if z - a > 40}
        assert not spans
    assert len(set(bodies)) >= 15 and max(t.grams for t in license_scan.TEMPLATES) > 128


def test_alignment_is_a_longest_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(300):
        a, b = ([bytes([97 + k]) for k in rng.integers(0, 3, rng.integers(2, 10))] for _ in range(2))
        x, y = list(zip(a, a[1:], strict=False)), list(zip(b, b[1:], strict=False))
        t = np.zeros((len(x) + 1, len(y) + 1), int)
        for i in range(len(x)):
            for j in range(len(y)):
                t[i + 1, j + 1] = t[i, j] + 1 if x[i] == y[j] else max(t[i, j + 1], t[i + 1, j])
        assert round(license_scan.aligned(a, b)[0] * len(x)) == t[-1, -1]


# HTML


def page(article, side="", extra=""):
    return f"<html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li>Home</li></ul></nav><div class='ad'>Buy</div>{article}{side}<footer>(c) me</footer>{extra}"


def test_html_blocks_and_differencing(spark):
    plain = page("<div><p>Shared menu line</p><p>Own &amp; only\n here</p></div>")
    other = page("<div><p>Shared menu line</p><p>Another text</p></div>")
    art = page("<article><h1>T&eacute;</h1><p><b>one<br><p>two  <i>three</i></p><div class='comments'><p>nice!</p></div></article>", "<aside>x</aside>")
    rows = [
        (1, "http://h/a/1", plain),
        (2, "http://h/a/2", other),
        (3, "http://k/a", art),
        (4, "http://k/a", art),
        (5, None, None),
        (6, "", "<p>alone"),
        (6, "", "<p>alone"),
        (7, "http://h/z", "<div>text < 5 &lt;b&gt; <!-- open"),
    ]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(len(r["text"]) == r["n_chars"] for r in got)
    assert text[1] == "Own & only here" and text[2] == "Another text"
    assert text[3] == text[4] == "Té\n\none\n\ntwo three"
    assert text[5] == "" and text[6] == "alone" and text[7] == "text < 5 <b>"


def test_common_lines_is_a_longest_subsequence():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = (["xyzw"[k] for k in rng.integers(0, 4, rng.integers(0, 12))] for _ in range(2))
        n, m = len(a), len(b)
        t = np.zeros((n + 1, m + 1), int)
        for i in range(n):
            for j in range(m):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert len(html_extract.common_lines(a, b)) == t[n, m]


# sharding


def test_minimax_is_optimal():
    rng = np.random.default_rng(6)
    for _ in range(40):
        sizes = rng.integers(1, 100, rng.integers(1, 14)).tolist()
        order = sharding.Order([(f"{i:032x}", s, True) for i, s in enumerate(sizes)])
        for shards in (1, 3, 8):
            best = min(
                c for c in range(1, sum(sizes) + 1) if max(sizes) <= c and _greedy(sizes, c) <= shards
            )
            assert order.open_runs(shards) == (best, [])


def _greedy(sizes, c):
    n, room = 1, c
    for s in sizes:
        if s > room:
            n, room = n + 1, c
        room -= s
    return n


def test_sharding(documents, texts, empty, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_DIGITS", 1)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    got = sharding.shard(documents, 4).collect()
    assert len(got) == len(texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in zip([*range(len(texts) - 3), None, 3, 3], texts, strict=True)
    )
    where, slots, groups, total = defaultdict(set), defaultdict(list), defaultdict(int), Counter()
    for r in got:
        where[r["key"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
        groups[r["key"]] += r["size"]
        total[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ordered = [groups[k] for k in sorted(groups)]
    best = min(c for c in range(max(ordered), sum(ordered) + 1) if _greedy(ordered, c) <= 4)
    assert max(total.values()) <= best
    assert sharding.shard(empty).count() == 0


# chats


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "system", "be <|end|> kind"),
        (1, 1, "user", "</s>[INST] \\ ok [/INST] \\<|text|>"),
        (1, 2, "assistant", "<|turn|>user<|text|>x\\"),
        (2, 0, "assistant", "a"),
        (2, 0, "assistant", "a"),
        (3, None, None, None),
        (None, 5, "tool", ""),
    ]
    chats = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segments string")
    made = chat_format.format_chats(chats)
    got = {r["conv_id"]: r for r in chat_format.read_back(made).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [r[2:] for r in rows[:3]]
    assert got[1]["loss_text"] == rows[2][3] and got[2]["loss_text"] == "aa" and got[3]["loss_text"] == ""
    assert [(t["role"], t["text"]) for t in got[3]["turns"]] == [("", "")]
    valid = {r["conv_id"]: (r["valid"], r["first_fault"]) for r in made.collect()}
    assert valid == {1: (True, None), 2: (False, 0), 3: (False, 0), None: (False, 0)}
    assert chat_format.format_chats(chats.limit(0)).count() == 0


def test_long_chats_keep_every_character(spark):
    text = "a [INST] b\\\\ <|end|>\n" * 40_000
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", text + str(t)) for t in range(6)]
    made = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = chat_format.read_back(made).first()
    assert [t["text"] for t in got["turns"]] == [r[3] for r in rows] and got["valid"]
    assert got["loss_text"] == "".join(r[3] for r in rows[1::2])
