"""Repeated rows, retries, very large sets, colliding patterns and made pages."""

import random
from collections import Counter, defaultdict
from hashlib import md5
from pathlib import Path

import numpy as np
import pytest

from sparrowmill.llm import exact_dedup, html_extract, jaccard_join, line_dedup, mixing, toxicity
from sparrowmill.llm.scratch import Scratch

DOC = "doc_id bigint, text string, lang string, source string, n_chars int"


def plain_mix(rows, mix):
    """Tokens taken of each leaf, and of each (doc_id, text) in it, by walking through the rows one by one."""
    leaves = defaultdict(list)
    for doc, text, lang, source in rows:
        number = "".join(c for c in (source or "") if c.isdigit())
        leaves[f"d{int(number) % 4}" if number else "unknown", lang or "unknown", source or "unknown"].append((doc, text or ""))
    tokens = {k: sum(len(t.split()) for _, t in v) for k, v in leaves.items()}
    budget = sum(tokens.values()) * mix.budget_thousandths // 1000

    def pour(budget, children):
        """{name: (cap, weight)} to {name: share}."""
        share, open_ = {}, dict(children)
        while open_:
            total = sum(w for _, w in open_.values())
            full = [n for n, (c, w) in open_.items() if c * total <= w * budget]
            if not full:
                return share | {n: w * budget // total for n, (_, w) in open_.items()}
            first = min(full, key=lambda n: (open_[n][0] / open_[n][1], n))
            share[first] = open_[first][0]
            budget -= open_.pop(first)[0]
        return share

    cap = lambda keep: sum(n * mix.max_epochs for k, n in tokens.items() if keep(k))
    taken = Counter()
    for d, b in pour(budget, {d: (cap(lambda k: k[0] == d), mix.domains.get(d, 1)) for d in {k[0] for k in tokens}}).items():
        for lang, c in pour(b, {x: (cap(lambda k: k[:2] == (d, x)), mix.languages.get(x, 1)) for x in {k[1] for k in tokens if k[0] == d}}).items():
            for leaf, share in pour(c, {k: (cap(lambda j: j == k), mix.sources.get(k[2], 1)) for k in tokens if k[:2] == (d, lang)}).items():
                epochs, rest = divmod(share, tokens[leaf]) if tokens[leaf] else (0, 0)
                key = lambda r: md5(f"{mix.seed}|{epochs}|{'' if r[0] is None else r[0]}".encode()).hexdigest() + md5(r[1].encode()).hexdigest()  # noqa: B023, E731
                for r in sorted(leaves[leaf], key=key):
                    n = len(r[1].split())
                    taken[(*leaf, *r)] += epochs * n + min(n, rest)
                    rest -= min(n, rest)
    return taken


def mixed_as_plain(spark, rows, mix):
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOC).repartition(5)
    got = Counter()
    texts = {(doc, len((t or "").split())): t or "" for doc, t, _, _ in rows}
    for r in mixing.mixed(docs, mix).collect():
        got[r.domain, r.language, r.origin, r.doc_id, texts[r.doc_id, r.n_tokens]] += r.taken_tokens
    whole = sum(len((r.text or "").split()) for r in mixing.mixed_documents(docs, mix).collect())
    return got, whole


def test_mix_gives_the_budget_where_one_id_repeats(spark):
    rows = [(5, "a b c d e f g h i j", "en", "src1")] * 100
    got, whole = mixed_as_plain(spark, rows, mixing.Mix())
    assert sum(got.values()) == whole == 900
    rows = [(1, "a b c", "en", "src1")] * 2 + [(2, "a b c d e f g h i j k l", "en", "src1")] * 2 + [(3, "a b c d e f g h i j k l", "en", "src1")] * 2
    got, whole = mixed_as_plain(spark, rows, mixing.Mix())
    assert sum(got.values()) == whole == 48


@pytest.mark.parametrize("seed, epochs", [(1, 2), (2, 1), (3, 3)])
def test_mix_is_that_of_a_plain_walk(spark, seed, epochs):
    rng = random.Random(seed)
    rows = [(rng.randrange(40), " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 30))), rng.choice(["en", "de", None]), rng.choice(["src0", "src1", "src5", None])) for _ in range(150)]
    rows += [rows[0]] * 60 + [(None, "x y z", "en", "src1")] * 7
    seen = {}
    rows = [r for r in rows if seen.setdefault((r[0], len(r[1].split())), r[1]) == r[1]]  # so that a row is known by id and length
    mix = mixing.Mix(max_epochs=epochs, budget_thousandths=700, seed=seed)
    want = plain_mix(rows, mix)
    got, whole = mixed_as_plain(spark, rows, mix)
    assert +got == +want and whole == sum(want.values())


def test_mix_takes_a_mapping_of_domains(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "web", 1), (2, "c d", "en", "book", 1), (3, "e", "en", None, 1)], DOC)
    told = {r.doc_id: r.domain for r in mixing.mixed(docs, mixing.Mix(domain_of={"web": "pages", "book": "print"})).collect()}
    assert told == {1: "pages", 2: "print", 3: "unknown"}


def test_a_batch_that_comes_again_counts_once(spark):
    index = exact_dedup.fresh_index(spark)
    docs = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id bigint, text string")
    once = exact_dedup.dedup(docs, index, "one").collect()
    more = spark.createDataFrame([(4, "b"), (5, "c")], "doc_id bigint, text string")
    first = sorted(exact_dedup.dedup(more, index, "two").collect())
    assert sorted(exact_dedup.dedup(more, index, "two").collect()) == first
    assert [(r.doc_id, r.keep_id, r.group_size, r.kept) for r in first] == [(4, 3, 2, False), (5, 5, 1, True)]
    again = {r.doc_id: r.group_size for r in exact_dedup.dedup(docs, index, "one").collect()}
    assert {r.doc_id: r.group_size for r in once} == {1: 2, 2: 2, 3: 1} and again == {1: 2, 2: 2, 3: 2}
    index.drop()


@pytest.mark.parametrize("ids", [[7, 3, 9, None, 3, 1], [None, None], [5], [-4, 4, -4]])
def test_two_batches_are_one_table(spark, ids):
    docs = spark.createDataFrame([(i, "abcab"[k % 5]) for k, i in enumerate(ids)], "doc_id bigint, text string")
    found = []
    for split in (False, True):
        index = exact_dedup.fresh_index(spark)
        found.append(sorted(map(repr, exact_dedup.dedup(docs, index, largest_first=split).collect())))
        assert index.rows().select("batch").distinct().count() <= 1 + split
        index.drop()
    assert found[0] == found[1]


def thue_morse(n, a, b):
    return [b if bin(k).count("1") % 2 else a for k in range(n)]


def test_patterns_of_words_are_told_apart(spark):
    one, two = (" ".join(thue_morse(2048, *x)) for x in ("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, two), (3, one.upper())], "doc_id bigint, text string")
    assert {(r.doc_id, r.number) for r in line_dedup.dropped(docs).collect()} == {(3, 0)}
    one, two = ("".join(thue_morse(2048, *x)) for x in ("ab", "ba"))
    docs = spark.createDataFrame([(1, one), (2, two), (3, one.upper())], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.joined(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_near_lines_beside_a_pattern(spark):
    """The true neighbour of a line is found though another line has the same words in the other order."""
    one, two = (thue_morse(2048, *x) for x in ("ab", "ba"))
    docs = spark.createDataFrame([(1, " ".join(two)), (2, " ".join(one)), (3, " ".join([*one[:7], "c", *one[8:]]))], "doc_id bigint, text string")
    assert {(r.doc_id, r.number) for r in line_dedup.dropped(docs).collect()} == {(3, 0)}


def test_very_large_sets_link():
    n = np.array([22_000_000])
    assert jaccard_join.linked(n - 1, n, n, 85).all() and not jaccard_join.linked(n // 2, n, n, 85).any()


def test_join_keeps_no_table_of_all_prefixes(spark, monkeypatch):
    """The prefixes of all sets are on disk once, and no more when they have been joined."""
    rng = random.Random(5)
    docs = spark.createDataFrame([(k, " ".join(str(rng.randrange(10**6)) for _ in range(400))) for k in range(300)], "doc_id bigint, text string")
    sizes, keep = [], Scratch.keep

    def kept(self, df, name="t"):
        found = keep(self, df, name)
        sizes.append(sum(p.stat().st_size for p in Path(self.root).rglob("*.parquet")))
        return found

    monkeypatch.setattr(Scratch, "keep", kept)
    assert all(r.doc_id == r.component_id for r in jaccard_join.joined(docs).collect())
    whole = 300 * 8 * jaccard_join.prefix_size(397, 85)
    assert max(sizes) < 1.5 * whole and sizes[-1] < 0.5 * whole


def test_join_of_ids_with_texts_of_different_lengths(spark, monkeypatch):
    """Blocks of one document: what a group is asked for holds for the longest text of an id as well as for the shortest."""
    monkeypatch.setattr(jaccard_join, "BLOCK_DOCS", 1)
    rows = []
    for k in range(12):
        long = [f"w{k}.{i}" for i in range(100)]
        rows += [(k, " ".join(long)), (k, " ".join(long[:10])), (100 + k, " ".join([*long[:-1], "other"]))]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in jaccard_join.joined(docs).collect()} == {i: i % 100 for i, _ in rows}


def test_long_texts_are_cut_between_words_only(monkeypatch):
    monkeypatch.setattr(toxicity, "LONG", 20)
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b ", " l o s e r ", "word and ", "x" * 30, "?! ", "\n", "éa ", "1 2 "]) for _ in range(rng.randrange(30)))
        pieces = list(toxicity.parts(text))
        assert "".join(pieces) == text
        assert [w for p in pieces for w in toxicity._SHOWN[toxicity.normal_form([p])[0]].tobytes().decode().replace("\0", " ").split()] == toxicity._SHOWN[toxicity.normal_form([text])[0]].tobytes().decode().replace("\0", " ").split()


def test_long_words_are_learned_as_they_are_scored():
    word = "abcdefghij" * 9
    stretches = toxicity.distinct_words(word)
    assert all(len(w) <= 2 * toxicity.CELL for w in stretches) and word[:32] in stretches and any(word.endswith(w) for w in stretches)


P = "The long river runs through the valley and past the old mill near the town every day."
Q = "Most people of the town walk there in the evening and talk about the weather and the harvest."
MADE = {
    "a list in the article": (f"<nav><a href=a>Home</a></nav><article><h1>River</h1><p>{P}</p><ul><li>first thing here</li><li>second thing here</li></ul><p>{Q}</p></article><footer>All rights</footer>", ["River", P, "first thing here", "second thing here", Q]),
    "a list beside a table": (f"<article><h1>River</h1><p>{P}</p><ul><li>first thing here</li></ul><table><tr><td>one cell</td><td>two cell</td></tr></table><p>{Q}</p></article>", ["River", P, "first thing here", "one cell", "two cell", Q]),
    "a quote": (f"<article><p>{P}</p><blockquote><p>{Q}</p></blockquote><p>{P}</p></article><aside>Buy now</aside>", [P, Q, P]),
    "comments in the article": (f"<article><h1>River</h1><p>{P}</p><p>{Q}</p><section class='comments'><h2>Comments</h2><p>nice text thank you</p><p>I walk there as well</p></section></article>", ["River", P, Q]),
    "comments behind it": (f"<article><h1>River</h1><p>{P}</p></article><div id='comments'><h3>Replies</h3><ul><li>so true</li><li>not for me</li></ul></div>", ["River", P]),
    "a form": (f"<article><p>{P}</p><p>{Q}</p><form><label>Your name</label><button>Send</button></form></article>", [P, Q]),
    "posts without a name": (f"<article><h1>River</h1><p>{P}</p><p>{Q}</p></article><ul><li>so true I walk there</li><li>not for me at all</li></ul>", ["River", P, Q]),
}


@pytest.fixture(scope="module", params=["sf0.01", "sf0.1"])
def labeller(spark, request):
    return html_extract.train(spark.read.parquet(f"/root/testdata/{request.param}/pages.parquet"))


@pytest.mark.parametrize("name", MADE)
def test_made_pages(labeller, name):
    page, want = MADE[name]
    (text,) = html_extract.main_texts([html_extract.blocks(f"<html><body>{page}</body></html>")], labeller)
    assert text.split("\n") == want


def test_held_out_pages(spark, labeller):
    """Pages that nothing was learned from give the text of their article."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("page_id % 7 = 3").select("html").collect()
    found = [html_extract.blocks(r.html) for r in rows]
    want = ["\n".join(b.text for b in f if html_extract.is_main(b.path)) for f in found]
    kept = [k for k, w in enumerate(want) if w]
    got = html_extract.main_texts([found[k] for k in kept], labeller)
    assert np.mean([g == want[k] for g, k in zip(got, kept, strict=True)]) >= 0.99
