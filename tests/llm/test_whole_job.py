"""Inputs on which an operator once did less than the whole job."""

import random
import sys
import zlib
from pathlib import Path

import numpy as np

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

from txrisk.llm import bagminhash, packing, planes, queries, secretlinks, urltree  # noqa: E402
from txrisk.llm.common import new_folder  # noqa: E402

LITERALS = [
    "one <|endoftext|> two",
    "<|endoftext|>",
    "<|endoftext|> starts and ends <|startoftext|>",
    "glued<|endoftext|>words, <|endoftext|><|endoftext|> twice <|endoftext|>. Mark",
    "a line\n<|endoftext|>\nanother <|startoftext|>\n",
    "runs  of   blanks <|endoftext|>  \n <|startoftext|>\ttab",
    "<|ENDOFTEXT|> <|EndOfText|> <|endoftext |> <|endof text|> é<|endoftext|>é",
    " <|endoftext|> ",
]


def _by_library(name, end):
    """Plain encode of the given file, no switch set."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries._vocabulary(name))
    return {i: [*t.encode(x, add_special_tokens=False).ids, end] for i, x in enumerate(LITERALS)}


def test_op1_literal_added_tokens(spark):
    want = _by_library("byte_bpe_50k.json", 0)
    assert want[0] == [505, 220, 50256, 734, 0]
    df = spark.createDataFrame(list(enumerate(LITERALS)), "doc_id long, text string")
    folder = new_folder(spark, "planes")
    planes.write_ids(df, folder, queries._vocabulary("byte_bpe_50k.json"), end_id=0)
    got = {r.doc_id: r for r in planes.digests(spark, folder).collect()}
    start = 0
    for i in range(len(LITERALS)):
        raw = np.array(want[i], "<u4").tobytes()
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want[i]), zlib.crc32(raw))
        start += len(want[i])


def test_op4_literal_added_tokens(spark):
    want = _by_library("word_bpe_49k.json", 1)
    assert 49407 in want[0]
    df = spark.createDataFrame(list(enumerate(LITERALS)), "doc_id long, text string")
    plain.check_packing(packing.pack(df, queries._vocabulary("word_bpe_49k.json"), end_id=1).collect(), want)


def _spans(text):
    return secretlinks.weak_spans(text, secretlinks.base_spans(text))


def test_op6_long_weak_parts():
    key = "Zx81kQpT77LmNb02Wq+/" * 4 + "aB3dE6=="
    assert len(key) == 88 and _spans(f"a {key} b") == [("weak_secret", 2, 90)]
    url = "https://api.example.com/" + "v/" * 988
    assert len(url) == 2000 and _spans(f"{url} end") == [("endpoint", 0, 2000)]
    assert _spans("host=" + "a.b-" * 100) == [("endpoint", 0, 405)]
    assert _spans("login: " + "a.b-" * 100) == [("weak_id", 0, 407)]
    assert _spans("AKIA" + "B" * 15 + "C" * 40 + "9")[:1] == []  # a base span already
    assert _spans("ASIA" + "B" * 60) == [("weak_id", 0, 64)]


def test_op6_names_in_either_case():
    for name in ("DB_USER", "CLIENT_ID", "clientId", "KEY_ID", "Username", "LOGIN", "Account"):
        assert [s[0] for s in _spans(f"{name}=svc-42")] == ["weak_id"], name
    for text in ("DB_HOST=db.example.com", "Endpoint: db.example.com", "HTTPS://example.com", "Server = db.example.com"):
        assert [s[0] for s in _spans(text)] == ["endpoint"], text


def test_op6_long_part_hides_no_other():
    """A URL that overlaps a base span is left out; the identifier inside it is not."""
    assert _spans("https://x.example.com/?client_id=svc-42&secret=abcdef12") == [("weak_id", 23, 39)]


def test_op6_long_parts_are_linked(spark):
    key = "Zx81kQpT77LmNb02Wq+/" * 4 + "aB3dE6=="
    url = "https://api.example.com/" + "v/" * 988
    rows = [(0, f"CLIENT_ID=svc-42 {key} {url}"), (1, f"{url} {key}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secretlinks.find(df).collect()}
    assert got == {0: "weak_id:0:16,weak_secret:17:105,endpoint:106:2106", 1: ""}


def test_op6_long_runs_take_linear_time():
    for t in ("aB1" * 100_000, "https://" * 40_000, "host:" * 60_000, "user" + " " * 300_000, "AKIA" * 75_000 + "a"):
        _spans(t), _spans(t.upper())


def test_op9_templates_part_below_the_fourth_segment(spark):
    """Two templates that share five segments have verdicts of their own."""
    paths = [f"/a/b/c/d/e/ads/{i}" for i in range(12)] + [f"/a/b/c/d/e/news/{i}" for i in range(12)]
    paths += ["/a/b/c/d/e/news/x/y/z", "/a/b/c/d/e"]
    rows = [(i, f"http://h.test{p}") for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i < 12)) for i in range(24) if i % 12], "page_id long, bad int")
    rules = urltree.rules_table(spark, queries.RULES)
    got = {r.page_id: r for r in urltree.judged(df, rules, labels).collect()}
    assert len(got) == len(rows)
    assert {got[i].template for i in range(12)} == {"/a/b/c/d/e/ads/#"}
    assert {got[i].verdict for i in range(12)} == {"block"}
    assert all("**" not in r.template for r in got.values())
    assert {got[i].verdict for i in range(12, 26)} == {"allow"}
    assert got[25].template == "/a/b/c/d/e"


def test_op3_row_without_words_in_a_mixed_bucket(spark):
    """A doc_id of a mixed bucket that has rows without words as well."""
    rng = random.Random(5)
    common = [f"c{rng.random()}" for _ in range(60)]
    rows, n = [], 0
    for group in range(40):
        own = [f"g{group}x{i}" for i in range(25)]
        for copy in range(2):
            rows.append((n, " ".join(common + own + [f"z{copy}"])))
            n += 1
    want = plain.near_classes(dict(rows))
    rows += [(i, t) for i in range(n) for t in ("", None, "!?")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = bagminhash.near_copies(df).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.class_id) for r in got} == set(want.items())


def test_op3_no_empty_bags():
    import pyarrow as pa

    texts = ["", "one two", "!?", "one two three four five six", ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(5), pa.int64()), "text": pa.array(texts)})
    found = [r for b in bagminhash._bags_of(batch) for r in b.to_pylist()]
    assert [(r["doc"], len(r["bag"])) for r in found] == [(1, 8), (3, 16)]
    assert list(bagminhash._bags_of(batch.slice(0, 0))) == []
