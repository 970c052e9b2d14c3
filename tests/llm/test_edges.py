"""Odd rows through every operator: nulls, empty and long texts, ties, repeats, clashing columns."""

import pytest
from pyspark.sql import functions as F

from txrisk.llm import (
    bagminhash, blockknn, linebloom, packing, pii, planes, queries, secretlinks, toxicity, urltree, winnow,
)
from txrisk.llm.common import new_folder

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "row string, n int, h string, lost string, sequence string, bucket int, verdict string"
)
LONG = "long words without end " * 20_000
ODD = [
    (0, None, None, None, None),
    (1, "", "", "", 0),
    (2, " \n\t\n ", "en", "s", 5),
    (3, "one two", "en", "s", 7),
    (3, "one two", "en", "s", 7),
    (4, LONG, "en", "s", len(LONG)),
    (None, "no id here at all, friends", "en", "s", 26),
    (5, "é ü \u2028 日本語 \x1c x\x85y 𝒳 ́", "xx", None, 12),
    (6, "same words in a row " * 8, "en", "s", 160),
    (6, "other words under one id " * 8, "en", "s", 200),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "x", 1, "y", "z", "q", 2, "v") for r in ODD]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(
        [(1, 1, 0), (3, 0, 1), (None, 1, 1), (4, None, 0), (6, 1, None), (99, 1, 1)],
        "doc_id long, quality int, toxic int",
    )


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [("a", "Same words in a row same"), ("b", None), ("c", ""), ("d", "zwei drei " * 9), (None, "x y")],
        "item_id string, text string",
    )


def ids(df):
    return sorted((r[0] is not None, r[0]) for r in df.select("doc_id").collect())


def everyone():
    return sorted((r[0] is not None, r[0]) for r in ODD)


def test_planes(spark, odd, empty):
    path = queries._vocabulary("byte_bpe_50k.json")
    for docs, bits in ((odd, False), (odd, True), (empty, False)):
        folder = new_folder(spark, "planes")
        planes.write_ids(docs, folder, path, block=1000, bits=bits)
        got = planes.digests(spark, folder)
        assert ids(got) == (everyone() if docs is odd else [])
        if docs is odd:
            rows = sorted(got.collect(), key=lambda r: r.start)
            at = 0
            for r in rows:
                assert r.start == at
                at += r.n_tokens
            assert {r.n_tokens for r in rows if r.doc_id in (0, 1)} == {1}
            assert rows[0].doc_id is None
            import zlib

            read = {(r.start, zlib.crc32(r.ids)) for r in planes.documents(spark, folder).collect()}
            assert read == {(r.start, r.ids_crc32) for r in rows}


def test_packing(odd, empty):
    path = queries._vocabulary("word_bpe_49k.json")
    rows = packing.pack(odd, path).collect()
    assert {r.doc_id for r in rows} == {r[0] for r in ODD}
    seen = {}
    for r in rows:
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seen.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert sorted(seen) == list(range(len(seen)))
    assert packing.pack(empty, path).collect() == []


def test_toxicity(odd, empty, labels):
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model)
    assert ids(got) == everyone()
    assert not any(r.toxic for r in got.where("doc_id in (0, 1, 2)").collect())
    kept = toxicity.clean(odd, model)
    assert kept.columns == odd.columns
    for docs, marks in ((empty, labels), (odd, labels.limit(0)), (empty, labels.limit(0))):
        model = toxicity.fit(docs, marks)
        assert not model.weights.any()
        assert toxicity.clean(docs, model).count() == docs.count()


def test_line_dedup(odd, empty):
    got = linebloom.summary(odd)
    assert ids(got) == everyone()
    assert {r.n_lines for r in got.where("doc_id in (0, 1)").collect()} == {1}
    kept = linebloom.clean(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert kept.where("doc_id = 0 and text is null").count() == 1
    assert linebloom.summary(empty).count() == 0 == linebloom.clean(empty).count()


def test_near_copies(odd, empty):
    got = {(r.doc_id, r.class_id) for r in bagminhash.near_copies(odd).collect()}
    assert got == {(None, None), *((i, i) for i in range(7))}
    assert bagminhash.near_copies(odd).count() == len(ODD)
    kept = bagminhash.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert bagminhash.near_copies(empty).count() == 0 == bagminhash.one_of_each(empty).count()


def test_winnowing(odd, empty, benchmark):
    got = winnow.contamination(odd, benchmark)
    assert ids(got) == everyone()
    flagged = {(r.doc_id, r.n_words) for r in got.where("contaminated").collect()}
    assert flagged == {(6, 40)}
    kept = winnow.clean(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == len(ODD) - 1
    assert winnow.contamination(odd, benchmark.limit(0)).where("contaminated").count() == 0
    assert winnow.contamination(empty, benchmark).count() == 0


def test_personal_data(odd, empty):
    model = pii.fit(odd)
    got = pii.find(odd, model)
    assert ids(got) == everyone()
    assert pii.redacted(odd, model).columns == odd.columns
    assert pii.find(empty, pii.fit(empty)).count() == 0


def test_secrets(odd, empty):
    assert ids(secretlinks.find(odd)) == everyone()
    assert secretlinks.find(empty).count() == 0


def test_neighbours(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]),
        (6, [inf, 1.0]), (7, [nan, 1.0]), (8, [None, 1.0]), (None, [5.0, 5.0]), (9, [1.0, 1.0, 1.0]), (20, [0.0, -1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x"))
    got = [tuple(r) for r in blockknn.nearest(df, df.where("vec_id % 20 = 0"), 2).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0)]
    assert blockknn.nearest(df.limit(0), df, 2).count() == 0
    assert blockknn.nearest(df, df.limit(0), 2).count() == 0


def test_urls(spark):
    urls = [
        None, "", "no scheme/x", "HTTP://A.Example.NET/en/1?x=/y", "http://net/", "http://x.net", "x://org/fr/#://b.net/",
        "http://example.org/fr/9", "ftp://example.com/de/", "http://b.example.com/deep/1/2/3/4/5/6", "://?", "http://example.net/en",
    ]
    df = spark.createDataFrame([(i, u, "host") for i, u in enumerate(urls)], "page_id long, url string, host string")
    df = df.union(df.where("page_id = 3"))
    got = {r.page_id: r for r in urltree.judged(df, urltree.rules_table(spark, queries.RULES)).collect()}
    assert len(got) == len(urls)
    assert [(got[i].host, got[i].path) for i in (0, 2, 10)] == [("", "")] * 3
    assert (got[3].host, got[3].path, got[3].rule, got[3].verdict) == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert (got[4].rule, got[4].verdict) == ("net/", "block")
    assert got[5].rule is None  # its path is empty and does not start with "/"
    assert (got[6].rule, got[7].rule, got[8].rule) == ("org/fr/", "org/fr/", "example.com/de/")
    assert got[11].rule == "net/"
    labels = spark.createDataFrame([(9, 1), (None, 1), (1, None)], "page_id long, bad int")
    rules = urltree.rules_table(spark, queries.RULES)
    assert urltree.judged(df, rules, labels).count() == len(urls) + 1
    assert urltree.allowed(df, rules).columns == df.columns
    assert urltree.judged(df.limit(0), rules).count() == 0
