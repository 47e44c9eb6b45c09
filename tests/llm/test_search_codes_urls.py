"""Lexical search, vector codes and URL filters against plain versions on small fixtures."""

import math
import random
import re
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from sparrowmill.llm import lexical_search, shingles, url_filter, vector_codes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def plain_search(docs, items, top=10):
    """Every item against every document; ``docs`` and ``items`` are lists of (id, text)."""
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total, n_docs = sum(sum(b.values()) for _, b in bags), len(bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for doc, bag in bags:
            m = 25 + 75 * sum(bag.values()) * n_docs // total
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t, k in words.items() if bag[t])
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(60)] + ["the", "The", "ÉTÉ", "été", "中文", "a_b", "x" * 3000]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(0, 60)))) for k in range(300)]
    docs += [(300, None), (301, ""), (302, "?!"), (303, "the " * 30_000), (7, docs[7][1]), (7, "the w1 w2"), (None, "w1 w2 w3"), (305, docs[9][1]), (306, docs[9][1])]
    items = [(k, " ".join(rng.choices(words, k=12))) for k in range(12)] + [(12, None), (13, "nowhere"), (14, "the the THE"), (3, "w5 w5"), (None, "w1")]
    return docs, items


def frames(spark, docs, items):
    return spark.createDataFrame([(*r, "z", 1) for r in docs], "doc_id bigint, text string, terms string, score int"), spark.createDataFrame([(*r, "z") for r in items], "item_id bigint, text string, rank string")


@pytest.mark.parametrize("pairs, entries", [(1_000_000, 1 << 21), (40, 100)])
def test_search_is_exact(spark, corpus, monkeypatch, pairs, entries):
    monkeypatch.setattr(lexical_search, "PAIRS", pairs)
    monkeypatch.setattr(lexical_search, "ENTRIES", entries)
    got = lexical_search.searched(*frames(spark, *corpus))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_search(*corpus)


def test_search_of_nothing(spark, corpus):
    docs, items = frames(spark, *corpus)
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("doc_id = 300"), items)):
        assert lexical_search.searched(d, i).count() == 0


def test_ties_go_to_the_smaller_doc_id(spark):
    docs, items = frames(spark, [(k, "same words") for k in range(500, 0, -1)] + [(k, "other") for k in range(501, 900)], [(1, "same")])
    assert [r.doc_id for r in lexical_search.searched(docs.repartition(7), items).orderBy("rank").collect()] == list(range(1, 11))


def test_radix_order_and_wide_lengths():
    key = np.random.default_rng(1).integers(0, 1 << 40, 5000)
    assert (key[lexical_search.radix_order(key)] == np.sort(key)).all() and len(lexical_search.radix_order(key[:0])) == 0
    n = np.array([3, 10**9])
    assert lexical_search.length_part(n, 10**11, 10**14).tolist() == [25 + 75 * int(x) * 10**11 // 10**14 for x in n]


def test_terms_of_one_hash_are_told_apart(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lexical_search, "span_hashes", lambda data, a, b: np.zeros(len(a), np.uint64))
    block = lexical_search.Block(pa.table({"item": [1, 1, 2], "term": ["ab", "abc", "xy"], "times": [1, 1, 1]}))
    found = [(int(r), block.terms[t], int(k)) for _, _, row, term, tf in lexical_search.counted(pa.array(["xy ab abc ab", None, "abd q ABC"]), block) for r, t, k in zip(row, term, tf)]
    assert sorted(found) == [(0, "ab", 2), (0, "abc", 1), (0, "xy", 1), (2, "abc", 1)]


def thue_morse(n, a, b):
    return [b if bin(k).count("1") % 2 else a for k in range(n)]


def test_no_pattern_of_bytes_or_words_cancels_out():
    spans = [bytes(thue_morse(n, 97, 98)) for n in (8, 16, 64, 2048)] + [bytes(thue_morse(n, 98, 97)) for n in (8, 16, 64, 2048)]
    ends = np.cumsum([len(x) for x in spans])
    assert len(set(shingles.span_hashes(np.frombuffer(b"".join(spans), np.uint8), np.r_[0, ends[:-1]], ends).tolist())) == 8
    a, b = (shingles.Sums(np.array(thue_morse(4096, x, y), np.uint64)) for x, y in ((11, 1 << 63), (1 << 63, 11)))
    for n in (64, 2048, 4096):
        assert (a.part(np.array([0]), np.array([n])) != b.part(np.array([0]), np.array([n]))).all()
    assert (a.part(np.array([4, 0]), np.array([9, 1])) == shingles.Sums(np.array(thue_morse(4096, 11, 1 << 63)[4:9], np.uint64)).part(np.array([0]), np.array([5]))).any()


def plain_codes(rows, entries=256, rounds=4):
    """Lists of (vec_id, vector, label) compressed by asking every entry."""
    kept = sorted(((i is None, i or 0, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: r[:3])
    width = len(kept[0][2]) // 4
    parts = [[tuple(v[p * width : (p + 1) * width]) for _, _, v, _ in kept] for p in range(4)]
    books = [list(x[:entries]) for x in parts]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for book, xs in zip(books, parts):
            groups = {}
            for x in xs:
                groups.setdefault(nearest(book, x)[1], []).append(x)
            for k, g in groups.items():
                book[k] = tuple(sum(c) // len(g) for c in zip(*g))
    last = [[nearest(book, x) for x in xs] for book, xs in zip(books, parts)]
    sha = sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    out = [[None if r[0] else r[1], "".join(f"{last[p][n][1]:02x}" for p in range(4)), sum(last[p][n][0] for p in range(4)), r[3]] for n, r in enumerate(kept)]
    total = Counter()
    for r in out:
        total[r[3]] += r[2]
    return sorted([(*r[:3], total[r[3]], sha) for r in out], key=repr)


SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, error string"


def made_vectors(n, width, spread, seed):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(9, width))
    return [[float(np.float32(x)) for x in centre[k % 9] + spread * rng.normal(size=width)] for k in range(n)]


@pytest.mark.parametrize("n, entries, spread", [(420, 256, 0.3), (300, 40, 0.001), (20, 256, 1.0)])
def test_codes_are_those_of_plain_search(spark, n, entries, spread):
    rows = [(k * 3, v, None if k % 4 == 0 else k % 3) for k, v in enumerate(made_vectors(n, 12, spread, n))]
    rows += [rows[2], (6, rows[7][1], 1), (None, rows[3][1], 2), (9999, None, 1), (9998, [1.0] * 11 + [None], 1), (9997, [float("nan")] + [0.0] * 11, 1), (9996, [float("inf")] + [0.0] * 11, 1)]
    got = vector_codes.compressed(spark.createDataFrame([(*r, "z", "z") for r in rows], SCHEMA).repartition(5), entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(rows, entries)


def test_codes_of_odd_tables(spark):
    frame = lambda rows: spark.createDataFrame([(*r, "z", "z") for r in rows], SCHEMA)
    assert vector_codes.compressed(frame([(1, [1.0], 1)]).where("false")).count() == 0
    assert vector_codes.compressed(frame([(1, None, 1)])).count() == 0
    rows = [(k, [float(k % 3), 1.0, 2.0, 3.0, 4.0], 1) for k in range(30)]
    got = vector_codes.compressed(frame([*rows, (77, [1.0, 2.0], 1)])).collect()
    assert [r.vec_id for r in sorted(got)] == list(range(30)) and all(r.error == 0 and r.code[:2] == f"{r.vec_id % 3:02x}" for r in got)
    with pytest.raises(Exception, match="a component of"):
        vector_codes.compressed(frame([(1, [2e6] * 4, 1)])).collect()


@pytest.mark.parametrize("kind", ["random", "ties", "equal", "one"])
def test_tree_gives_the_lower_of_equally_near_entries(kind):
    rng = np.random.default_rng(2)
    entries = {"random": rng.integers(-500, 500, (256, 6)), "ties": rng.integers(-2, 3, (256, 3)), "equal": np.zeros((256, 4), np.int64), "one": np.ones((1, 4), np.int64)}[kind]
    x = np.concatenate([rng.integers(-3, 4, (3000, entries.shape[1])), rng.integers(-600, 600, (3000, entries.shape[1])), entries])
    index, far = vector_codes.VantageTree(entries).nearest(x)
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    assert (index == d.argmin(1)).all() and (far == d.min(1)).all()


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest)[0]
    host = re.sub("[A-Z]+", lambda m: m[0].lower(), raw)
    path = re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)) if fits else None


URLS = ["https://A.Example.ORG/x", "http://example.org", "http://example.org/es/1", "http://m.example.org/es/", "http://example.org/en/12?q=1#f", "http://xexample.org/es/", "http://example.org/en/2", "http://b.com/fr/1", "http://b.com/de/", "http://com/de/9", "http://b.net/en/1",
        "no scheme", "", None, "://", "a://b://org/", "http://org?/", "http://u@org:80/", "http://b.com/fr", "HTTP://B.COM/FR/1", "http://é.org/ü/\n", "http://c.com/" + "x/" * 50_000, "http://b.com/fr/1"]


def test_urls_follow_the_longest_rule(spark):
    pages = spark.createDataFrame([(k, u, "z", "z") for k, u in enumerate(URLS)], "page_id bigint, url string, host string, verdict string")
    got = {r.page_id: r for r in url_filter.judged(pages).collect()}
    for k, u in enumerate(URLS):
        host, path, rule = plain_rule(u)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule and rule.text), u
        assert got[k].verdict == rule.verdict if rule else got[k].verdict == ("block" if got[k].score >= 0.5 else "allow")
    assert url_filter.judged(pages.where("false")).count() == 0
    assert {r.verdict for r in url_filter.judged(pages, rules=()).collect()} == {"allow"}
    assert {r.verdict for r in url_filter.judged(pages, rules=(url_filter.Rule("block", "org", "/"),)).collect()} == {"block"}


def test_trees_learn_from_the_look_of_urls(spark):
    rng = random.Random(6)

    def made(bad, held):
        host = "".join(rng.choices("0123456789" if bad else "aeioulnrst", k=rng.randrange(6, 12)))
        path = "/".join("".join(rng.choices("abcdefxyz0123456789" if bad else "aeioulnrst", k=rng.randrange(3, 30 if bad else 9))) for _ in range(rng.randrange(1, 7 if bad else 3)))
        return f"https://{host}.{'net' if held else 'bad' if bad else 'good'}/{path}" + ("?a=1&b=2&c=3" if bad and rng.random() < 0.7 else "")

    rows = [(k, made(k % 2 == 0, k % 3 == 0)) for k in range(3000)]
    rules = (url_filter.Rule("block", "bad", "/"), url_filter.Rule("allow", "good", "/"))
    got = url_filter.judged(spark.createDataFrame(rows, "page_id bigint, url string"), rules).where("rule IS NULL").collect()
    assert len(got) == 1000 and np.mean([(r.verdict == "block") == (r.page_id % 2 == 0) for r in got]) > 0.95


def test_trees_give_what_their_nodes_say():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 5))
    y = (x[:, 0] * x[:, 1] > 0).astype(float)
    forest = url_filter.boosted(x, y, np.ones(500))
    for row, z in zip(x[:50], forest.margin(x[:50]), strict=True):
        want = forest.base
        for feature, above, value in zip(forest.feature, forest.above, forest.value, strict=True):
            k = 0
            while k < len(feature):
                k = 2 * k + 2 if row[feature[k]] > above[k] else 2 * k + 1
            want += value[k - len(feature)]
        assert abs(want - z) < 1e-9
    assert np.mean((forest.margin(x) > 0) == (y == 1)) > 0.95
