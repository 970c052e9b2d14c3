"""Row numbers of files, however files are split and packed into tasks."""

import pytest

from txrisk.sources import tables


@pytest.fixture
def split_small(spark):
    def put(size, cost):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)

    yield put
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


# Many blocks a file, one block a file, and several files in a task.
@pytest.mark.parametrize("size,cost", [("200", "1"), ("4k", "1"), ("1m", "1"), ("128m", "4m")])
def test_gapless_in_file_order(spark, tmp_path, split_small, size, cost):
    names, n = ["a", "b", "c", "d"], 0
    for name, rows in zip(names, (300, 1, 0, 77)):
        lines = ["number,text"] + [f"{n + i},{'x' * (i % 17)}" for i in range(rows)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
        n += rows
    split_small(size, cost)
    read = spark.read.csv(str(tmp_path), header=True, schema="number long, text string")
    rows = tables.with_row_number(read).collect()
    assert sorted(r.pos for r in rows) == list(range(n))
    assert all(r.pos == r.number for r in rows)


def test_blocks_are_counted_one_by_one(spark, tmp_path, split_small):
    (tmp_path / "a.csv").write_text("number\n" + "\n".join(map(str, range(500))) + "\n")
    split_small("300", "1")
    read = spark.read.csv(str(tmp_path), header=True, schema="number long")
    blocks = tables.block_offsets(read).orderBy("_at").collect()
    assert len(blocks) > 3
    assert [b._first for b in blocks] == [sum(x._rows for x in blocks[:i]) for i in range(len(blocks))]


def test_long_list_of_blocks_is_joined(spark, tmp_path, monkeypatch):
    for i in range(4):
        (tmp_path / f"{i}.csv").write_text("number\n" + "\n".join(str(10 * i + j) for j in range(10)) + "\n")
    monkeypatch.setattr(tables, "fits_broadcast", lambda df: False)
    read = spark.read.csv(str(tmp_path), header=True, schema="number long")
    assert all(r.pos == r.number for r in tables.with_row_number(read).collect())


def test_empty_table(spark, tmp_path):
    (tmp_path / "a.csv").write_text("number\n")
    read = spark.read.csv(str(tmp_path), header=True, schema="number long")
    assert tables.with_row_number(read).collect() == []
