"""Clashing names, ids that are null or repeat, and empty tables, for the operators over documents and pages."""

import pytest
from pyspark.sql import functions as F

from sparrowmill.llm import bpe, html_extract, jaccard_join, language, line_dedup, mixing, quality, registry, toxicity

#: names of the operators' own columns
CLASHING = "score held_out predicted n n_shingles prefix ids ids_sha256 key cut share domain language origin copies rep token tokens h h2 number first late component_id label keep_id digest lang_pred n_tokens row gone lines label_error rank terms tfs url n_chars".split()
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog by the river", "en", "src1"),
    (1, "ein ganz anderer Text mit derselben Nummer steht hier im Feld", "de", "src2"),
    (2, "the quick brown fox jumps over the lazy dog by the river", "en", "src1"),
    (None, "the quick brown fox jumps over the lazy dog by the river", None, None),
    (None, None, None, None),
    (3, "", "en", "src1"),
    (3, "", "en", "src1"),
    (4, "You stupid idiot, go away and never come back to this place", "en", "src0"),
    (5, "line one of five words\nline one of five words\nother", "fr", "src5"),
]
LABELS = [(1, 1, 0), (2, 1, 0), (3, 0, 0), (4, 0, 1), (5, 1, None), (5, None, 0), (None, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


def operators(labels):
    return {
        "quality": lambda d: quality.predicted(d, labels),
        "bpe": lambda d: bpe.encoded(d, registry.word_vocabulary()),
        "lines": line_dedup.told,
        "language": language.predicted,
        "toxicity": lambda d: toxicity.predicted(d, labels),
        "jaccard": jaccard_join.joined,
        "mixing": mixing.mixed,
    }


@pytest.mark.parametrize("name", ["quality", "bpe", "lines", "language", "toxicity", "jaccard", "mixing"])
def test_extra_columns_change_nothing(docs, labels, name):
    run = operators(labels)[name]
    plain = sorted(map(repr, run(docs).collect()))
    extra = docs.select("*", *(F.lit("z").alias(c) for c in CLASHING if c not in docs.columns))
    assert sorted(map(repr, run(extra).collect())) == plain and len(plain) == len(ROWS)
    assert run(docs.where("false")).count() == 0


def test_ids_that_are_null_or_repeat(docs, labels):
    ops = operators(labels)
    told = [(r.doc_id, r.n_shingles, r.component_id) for r in ops["jaccard"](docs).collect()]
    assert sorted(told, key=repr) == sorted([(1, 9, 1), (1, 8, 1), (2, 9, 1), (None, 9, None), (None, 0, None), (3, 0, 3), (3, 0, 3), (4, 9, 4), (5, 6, 5)], key=repr)
    budget = sum(len((t or "").split()) for _, t, _, _ in ROWS) * 900 // 1000
    assert budget - 10 <= sum(r.taken_tokens for r in ops["mixing"](docs).collect()) <= budget  # each share is rounded down
    kept = jaccard_join.one_of_each(docs)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 1, None, None, 3, 3, 4, 5], key=repr)
    for name in ("quality", "toxicity"):
        by_text = {}
        for r, (_, text, _, _) in zip(sorted(ops[name](docs.where("doc_id = 1")).collect(), key=repr), ROWS):
            by_text[text] = r.score
        assert all(0 <= s <= 1 for s in by_text.values())
    assert {r.doc_id: r.n_dropped for r in line_dedup.told(docs).where("doc_id = 5").collect()} == {5: 1}


def test_pages_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>one two three four five six</p></article>"), (1, "u", None), (None, None, ""), (2, "v", "<p>x</p>")], "page_id bigint, url string, html string")
    plain = sorted(map(repr, html_extract.extracted(pages).collect()))
    extra = pages.select("*", *(F.lit("z").alias(c) for c in CLASHING if c not in pages.columns), F.lit("t").alias("text"))
    assert sorted(map(repr, html_extract.extracted(extra).collect())) == plain and len(plain) == 4
    assert html_extract.extracted(pages.where("false")).count() == 0
