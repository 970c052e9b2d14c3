"""Operators 11 to 13 against plain versions, on given tables and on odd rows."""

import random
import sys
from pathlib import Path

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import plain_new as plain  # noqa: E402

from txrisk.llm import ordersketch, queries, spelling, turns  # noqa: E402

DOCS = "doc_id long, text string, word string, n int, h string, bucket int, own string"


def documents(spark, rows):
    """Documents with further columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "w", 1, "h", 2, "o") for r in rows], DOCS)


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    return [tuple(r) for r in rows]


# -- op11 -----------------------------------------------------------------------------

FORMS = ["word", "form", "root", "n", "n_near", "form_n"]


def found(df):
    return sorted(tuple(r) for r in df.select(*FORMS).collect())


def test_op11_equals_plain(spark, texts):
    assert found(queries.op11_spelling_tiles(spark, SMALL)) == plain.forms(plain.counted_words(texts))


@pytest.mark.parametrize("block,cells", [(1024, 1 << 20), (4, 1 << 20), (1024, 40), (1, 1)])
@pytest.mark.parametrize("pieces", [1, 2, 4, 7])
def test_op11_any_tiling(spark, monkeypatch, pieces, block, cells):
    """Few letters make large buckets, which are cut into many blocks."""
    random.seed(pieces)
    words = {"".join(random.choices("ab", k=random.choice([7, 8, 9]))): random.randint(2, 3000) for _ in range(90)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = found(spelling.variants(df, pieces=pieces, block=block, cells=cells))
    assert got == plain.forms(words)


def test_op11_long_list_of_buckets_is_joined(spark, monkeypatch):
    monkeypatch.setattr(spelling, "LISTED", 0)
    words = {f"abcdef{a}{b}": 2 + ord(a) for a in "abcdefgh" for b in "abcdefgh"}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(spelling.variants(df, block=3)) == plain.forms(words)


def test_op11_edits_and_ties(spark):
    words = {
        "kingdoms": 1000, "kingdom": 50, "kingdooms": 2, "kingdomz": 100, "xingdoms": 100, "kiingdom": 5,
        "aaaaaaa": 300, "aaaaaaaa": 30, "aaaaaaaaa": 3, "étudier": 40, "etudieré": 40, "étudieÿ": 4,
        "b" * 5000: 20, "b" * 4999 + "c": 2, "b" * 4999: 2,
    }
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r[0]: r for r in found(spelling.variants(df))}
    assert list(got.values()) == plain.forms(words)
    # Tenfold steps lead on; both neighbours of a tie are near, the smaller one is the form.
    assert got["aaaaaaaaa"][1:3] == ("aaaaaaaa", "aaaaaaa")
    assert got["b" * 4999][1] == "b" * 5000


def test_op11_odd_documents(spark):
    rows = [
        (None, "nothing Nothing NOTHING nothinG"), (1, None), (2, ""), (3, " \n 12 34 "), (4, "nothing"), (4, "nothing"),
        (5, "Étudiant étudiant ×÷×÷×÷× ×÷×÷×÷× 中文"),
        (6, "x" * 100_000 + " " + "x" * 100_000),
    ]
    words = spelling.counted(spelling.misspelt(spelling.runs(documents(spark, rows))))
    counts = plain.counted_words(rows)
    assert {r.word: r.n for r in words.collect()} == counts
    assert found(spelling.variants(words)) == plain.forms(counts)
    none = spelling.counted(spelling.misspelt(spelling.runs(documents(spark, rows).limit(0))))
    assert found(spelling.variants(none)) == []
    with pytest.raises(ValueError):
        spelling.near_pairs(words, pieces=9)


# -- op12 -----------------------------------------------------------------------------


def rows_of(df):
    columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_op12_equals_plain(spark, texts):
    got = rows_of(queries.op12_order_minhash(spark, SMALL))
    assert got == sorted(plain.fingerprints(texts), key=repr)
    # Half a text is more like it than the next document, almost always.
    assert sum(r[5] > r[6] for r in got) > 0.95 * len(got)


ODD = [
    (1, ""), (2, None), (3, "a"), (4, "a a a a a a a a a a b"), (5, "  x \n "), (5, "  x \n "), (5, "other"),
    (None, "no id"), (None, None), (7, "é" * 50 + " \U0001f600 zz"), (8, "rep " * 300), (9, "rep " * 299 + "end"),
    (10, "z" * 50_000), (11, "word and word, " * 4_000),
]


@pytest.mark.parametrize("rows", [512, 3, 1])
def test_op12_odd_documents(spark, monkeypatch, rows):
    monkeypatch.setattr(ordersketch, "BUCKET_ROWS", rows)
    monkeypatch.setattr(ordersketch.with_next, "__defaults__", (rows,))
    got = rows_of(ordersketch.fingerprints(documents(spark, ODD)))
    assert got == sorted(plain.fingerprints(ODD), key=repr)


def test_op12_few_documents(spark):
    assert rows_of(ordersketch.fingerprints(documents(spark, ODD).limit(0))) == []
    (alone,) = ordersketch.fingerprints(documents(spark, [(3, "one text of its own")])).collect()
    assert alone.near_next == 1.0
    two = ordersketch.fingerprints(documents(spark, [(3, "the same"), (4, "the same")])).collect()
    assert two[0].fingerprint == two[1].fingerprint and two[0].near_next == 1.0


def test_op12_sees_order(spark):
    """The same words in another order are less alike than the text to itself, but not foreign to it."""
    random.seed(5)
    words = [f"w{i}" for i in range(400)]
    blocks = [words[i : i + 40] for i in range(0, 400, 40)]
    random.shuffle(blocks)
    moved = " ".join(w for b in blocks for w in b)
    other = " ".join(f"v{i}" for i in range(400))
    df = spark.createDataFrame([(" ".join(words), moved, other)], "a string, b string, c string")
    for c in "abc":
        df = ordersketch.with_sketch(df, c, f"f{c}", size=3)
    near = df.select(ordersketch.likeness(F.col("fa"), F.col("fb")), ordersketch.likeness(F.col("fa"), F.col("fc"))).first()
    assert 0 < near[0] < 0.8 and near[1] == 0


def test_op12_stays_on_the_jvm(spark):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        queries.op12_order_minhash(spark, SMALL).explain()
    text = out.getvalue()
    assert not any(w in text for w in ("Python", "Arrow", "Cartesian", "NestedLoop"))
    # The window's exchange is the only one.
    assert text.count("Exchange") == 1


# -- op13 -----------------------------------------------------------------------------

COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check_report(conversations, bits=turns.BLOCK_BITS):
    rows = [tuple(r) for r in conversations.select("conv_id", "turn", "role", "text").collect()]
    by_conv, ids = plain.damaged(rows)
    want = {i: plain.repaired(by_conv.get(i, [])) for i in ids}
    got = turns.report(conversations, turns.damaged(conversations), bits).collect()
    assert len(got) == len(want)
    assert {r.conv_id: tuple(r[c] for c in COLUMNS) for r in got} == want
    return want


def test_op13_equals_plain(spark):
    conversations = spark.read.parquet(f"{SMALL}/conversations.parquet")
    want = check_report(conversations)
    got = queries.op13_hirschberg_repair(spark, SMALL).collect()
    assert {r.conv_id: r.audit for r in got} == {i: w[6] for i, w in want.items()}


CONVERSATION = "conv_id long, turn long, role string, text string, h string, at long, fault int, token string"


@pytest.fixture(scope="module")
def odd_conversations(spark):
    random.seed(3)
    roles = ["system", "user", "assistant", "user", "assistant", None, "tool", "", "uncle", "User"]
    texts = [None, "", "  \n", "hi.", "yes", "No!", "a? \t", "b.c", "é", "x" * 100_000, "q.", "w!", "z?"]
    rows = []
    for conv in [*range(40), None]:
        for i in range(random.choice([1, 2, 3, 5, 9, 40])):
            turn = random.choice([None, i, i, i, i + 3, 2])
            rows.append((conv, turn, random.choice(roles), random.choice(texts), "h", 1, 2, "K"))
    return spark.createDataFrame(rows, CONVERSATION)


@pytest.mark.parametrize("bits", [0, 1, 2, 12])
def test_op13_blocks_of_any_size(odd_conversations, bits):
    """However a conversation is cut into blocks, the repair is the same."""
    check_report(odd_conversations, bits)


def test_op13_empty_and_dropped(spark, odd_conversations):
    assert turns.report(*[odd_conversations.limit(0)] * 2).collect() == []
    import hashlib

    (row,) = turns.report(odd_conversations.where("conv_id = 3").limit(1), odd_conversations.limit(0)).collect()
    assert tuple(row[c] for c in COLUMNS) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_op13_repaired_rows(spark, odd_conversations):
    """The rows written out are those of the digest, and their roles read as they must."""
    import hashlib
    import re

    damaged = turns.damaged(odd_conversations)
    repair = turns.Repair(damaged, 2)
    rows = {}
    for r in repair.repaired().orderBy("conv_id", "place").collect():
        rows.setdefault(r.conv_id, []).append(r)
    for r in repair.conversations().collect():
        mine = rows.get(r.conv_id, [])
        assert [m.place for m in mine] == list(range(len(mine)))
        assert [m.edit for m in mine] == [e for e in r.audit if e != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(m.role[0] for m in mine))
        said = "\n".join(f"{m.role}:{m.text}" for m in mine)
        assert hashlib.sha256(said.encode()).hexdigest() == r.repaired_sha256


def test_op13_one_conversation_in_many_partitions(spark):
    """A hot conversation of equal turns and repeated rows is spread over tasks and blocks."""
    random.seed(8)
    rows = [
        (1, random.choice([None, 5, i]), random.choice(["user", "assistant"]), random.choice(["a.", "b", "", f"{i}."]))
        for i in range(900)
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    check_report(df, 4)


def test_op13_costs_meet_in_the_middle():
    """Halving finds the same states as a pass from front to back."""
    random.seed(1)
    for _ in range(300):
        letters = "".join(chr(65 + random.randrange(16)) for _ in range(random.randrange(1, 12)))
        numbers = turns.summary(letters)
        cost, _, first, last = turns.bridged(tuple(numbers))
        walk = turns.walked(letters, first, last)
        audit = "".join(c for c in "".join(walk) if c not in "ua") + "I" * len(turns.TAIL[last])
        halves = [letters[: len(letters) // 2], letters[len(letters) // 2 :]]
        parts = [turns.summary(h) for h in halves if h]
        two = turns.bridged(tuple(n for p in parts for n in p))
        assert two[0] == cost
        joined = "".join(t for h, a, b in zip([h for h in halves if h], two[2:], two[3:]) for t in turns.walked(h, a, b))
        assert "".join(c for c in joined if c not in "ua") + "I" * len(turns.TAIL[two[-1]]) == audit
