"""The pipeline on nulls, empty tables, repeated rows and columns with the operators' own names."""

import pytest

import corpus_pipeline
from txrisk.llm.common import stored

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, n int, h string, "
    "bucket int, sequence string, start string, toxic string, gone string, kept string, lost string, doc string"
)
PASSAGE = " ".join(f"word{i}" for i in range(40))
LINE = "a line that many documents share, long enough"
ROWS = [
    (0, None), (1, ""), (2, " \n\t\n "), (3, "one two"), (3, "one two"), (None, "no id here"), (None, None),
    (4, "long words without end " * 5_000), (5, "é ü 日本語 \x1c x\x85y 𝒳"),
    *[(10 + i, f"{LINE}\nown words of number {'abcdefgh'[i]} " + f"filler{i} " * 9) for i in range(5)],
    # Copies that break their lines in other places.
    *[(20 + i, " ".join(f"copy{j}" + "\n" * (j == 9 * i + 5) for j in range(60))) for i in range(4)],
    (30, f"{PASSAGE} and a tail"), (30, "another text under the same id"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    def write(name, rows, benchmark, labels):
        path = str(tmp_path_factory.mktemp(name))
        full = [(*r, "en", "s", 1, "r", 2, "h", 3, "q", "b", "t", "g", "k", "l", "d") for r in rows]
        spark.createDataFrame(full, SCHEMA).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame(benchmark, "item_id string, text string").write.parquet(f"{path}/benchmark.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
        return path

    return write


def test_odd_documents(spark, folder):
    path = folder("odd", ROWS, [("a", PASSAGE), ("b", None), (None, "")], [(1, 1, 0), (3, 0, 1), (None, 1, 1), (99, 1, 1)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, path), name)
        if name != "packing":
            assert docs.columns == columns
            kept[name] = docs.select("doc_id", "text").collect()
    ids = lambda name: sorted((r.doc_id is not None, r.doc_id) for r in kept[name])
    assert len(kept["line_dedup"]) == len(kept["toxicity"])
    # The shared line stays in the last document that has it.
    assert [r.doc_id for r in kept["line_dedup"] if r.text and LINE in r.text] == [14]
    # One of the copies stays, and rows without words are no copies.
    near = [r.doc_id for r in kept["minhash_near_dedup"]]
    assert sum(20 <= (d or 0) < 24 for d in near) == 1 and {0, 1, 2} <= set(near) and near.count(None) == 2
    # The benchmark's passage goes, the other text of its id does not.
    clean = [(r.doc_id, r.text) for r in kept["benchmark_decontamination"]]
    assert not any(PASSAGE in (t or "") for _, t in clean) and (30, "another text under the same id") in clean
    assert {d for _, d in ids("benchmark_decontamination")} == {r.doc_id for r in docs.collect()}
    lengths = {}
    for r in docs.collect():
        lengths.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in lengths.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_tables(spark, folder):
    path = folder("empty", [], [], [])
    assert corpus_pipeline.run(spark, path).collect() == []


def test_empty_benchmark_and_labels(spark, folder):
    path = folder("alone", ROWS[:9], [], [])
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == {None, 0, 1, 2, 3, 4, 5}
