"""State of streams by buckets: few calls whatever the number of accounts, and the same rows after any number of micro-batches."""

import random

import pandas as pd
from pyspark.sql import functions as F

from txrisk.schemas import HISTORY_COLUMNS
from txrisk.streaming import newest


class _State:
    """A map and a single value, with the calls counted."""

    def __init__(self):
        self.map, self.single, self.calls = {}, None, 0

    def getMapState(self, name, key, value):
        return _Map(self)

    def getValueState(self, name, schema):
        return _Value(self)


class _Map:
    def __init__(self, state):
        self.state = state

    def getValue(self, key):
        self.state.calls += 1
        return self.state.map[key]

    def updateValue(self, key, value):
        self.state.calls += 1
        self.state.map[key] = value

    def removeKey(self, key):
        self.state.calls += 1
        del self.state.map[key]


class _Value:
    def __init__(self, state):
        self.state = state

    def get(self):
        self.state.calls += 1
        return self.state.single

    def update(self, value):
        self.state.calls += 1
        self.state.single = value


def _frames(rows, size=700):
    for i in range(0, len(rows), size):
        yield pd.DataFrame(rows[i : i + size], columns=newest._IN)


def _tx(address, pos, ts, piece=0):
    return (address, piece, "", "", "" if pos is None else f"={pos}", ts, 0, 0, "=h", f'["{pos}"]')


def _ask(address, request, piece=0):
    return (address, piece, f"={request}", f"={address}", "", 0, 0, 0, "", "")


def _bucket(k):
    processor, state = newest._Bucket(k), _State()
    processor.init(state)
    return processor, state


def _run(processor, rows):
    return [r for out in processor.handleInputRows((0,), _frames(rows), None) for r in out.itertuples(index=False)]


def test_calls_do_not_grow_with_the_accounts():
    processor, state = _bucket(100)
    assert _run(processor, [_tx(f"0x{i}", i * 10 + j, j) for i in range(900) for j in range(3)]) == []
    out = _run(processor, [_ask(f"0x{i}", i) for i in range(900)])
    assert len(out) == 900 * 4
    # Every account had a state of its own: two calls and more for each.
    assert state.calls < 10


def test_values_are_merged_and_nothing_is_lost():
    random.seed(4)
    processor, state = _bucket(5)
    sent = {}
    for batch in range(3 * newest._VALUES):
        rows = []
        for _ in range(60):
            a, pos, ts = f"0x{random.randrange(12)}", random.randrange(10**6), random.randrange(50)
            rows.append(_tx(a, pos, ts))
            sent.setdefault(a, {}).setdefault(pos, ts)
        # A replayed row, and a request among rows that counts after them.
        rows.append(rows[0])
        wanted = f"0x{batch % 13}"
        out = _run(processor, [_ask(wanted, batch), *rows] if batch % 3 else rows)
        if batch % 3:
            best = sorted(sent.get(wanted, {}).items(), key=lambda r: (-r[1], r[0]))[:5]
            assert [(r.request, r.pos) for r in out] == [(str(batch), None), *[(None, p) for p, _ in best]]
        assert [*state.map] == [(i,) for i in range(len(state.map))] and len(state.map) <= newest._VALUES


def test_a_large_value_is_not_rewritten_for_small_ones():
    processor, state = _bucket(10_000)
    _run(processor, [_tx("0xa", i, i) for i in range(5_000)])
    large, values = state.map[(0,)], []
    for batch in range(60):
        _run(processor, [_tx("0xa", 10**6 + batch, batch)])
        assert state.map[(0,)] is large
        values.append(len(state.map))
    assert max(values) <= newest._VALUES and min(values[10:]) < newest._VALUES
    assert sorted(r.pos for r in _run(processor, [_ask("0xa", "q")])[1:]) == [*range(5_000), *range(10**6, 10**6 + 60)]


def test_rows_without_a_number_and_long_histories():
    processor, _ = _bucket(3)
    n = 2 * newest._CHUNK + 9
    rows = [_tx("0xa", i + 2**60, i) for i in range(n)] + [_tx("0xb", None, 1), _tx("0xb", 7, 0), _tx("0xb", None, 9)]
    _run(processor, rows)
    out = _run(processor, [_ask("0xa", "q"), _ask("0xb", ""), _ask("0xc", "r", piece=1), _ask("0xb", "s")])
    assert [(r.address, r.request, r.pos) for r in out] == [
        ("0xa", "q", None), *[("0xa", None, n - i + 2**60) for i in (1, 2, 3)],
        ("0xb", "", None), ("0xb", "s", None), ("0xb", None, None), ("0xb", None, 7),
    ]


def test_a_stream_that_is_started_again(spark, make_tx, tmp_path):
    """State has no more keys than buckets, and fields come back as they were."""
    odd = ['a"b\\', "", None, "é\n=", "[null]"]
    rows = [
        {"from_address": f"0xA{i % 40:02d}", "to_address": "0xhub" if i % 3 else None, "time_stamp": str(1000 + i % 90),
         "input": odd[i % 5], "hash": f"h{i}"}
        for i in range(400)
    ]
    tx = make_tx(*rows)
    asked = spark.createDataFrame(
        [(str(i), f"0xa{i:02d}") for i in range(45)] + [("h", "0xHUB"), ("n", None)], "request string, address string"
    )
    for part in range(10):
        tx.where(F.col("pos") % 10 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/tx")
    asked.limit(0).write.parquet(f"{tmp_path}/asked")

    def run():
        read = spark.readStream.option("maxFilesPerTrigger", 1)
        query = newest.answer_stream(
            read.schema(tx.schema).parquet(f"{tmp_path}/tx"), read.schema(asked.schema).parquet(f"{tmp_path}/asked"),
            lambda good, history: good.join(history, F.lower(good["address"]) == history["address"], "left").select(
                "request", "pos", *HISTORY_COLUMNS
            ),
            f"{tmp_path}/out", f"{tmp_path}/state", k=20, pieces=2, buckets=8,
        )
        query.awaitTermination()
        return query.lastProgress["stateOperators"][0]["numRowsTotal"]

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, newest.PROVIDER)
    try:
        run()
        asked.coalesce(1).write.mode("append").parquet(f"{tmp_path}/asked")
        # Some packed values and their sizes for every bucket; an account's piece had rows of its own.
        assert run() <= 8 * newest._VALUES
    finally:
        spark.conf.set(name, before)
    schema = "request string, pos bigint, " + ", ".join(f"`{c}` string" for c in HISTORY_COLUMNS)
    got = {}
    for r in spark.read.schema(schema).json(f"{tmp_path}/out/answers").collect():
        got.setdefault(r["request"], []).append(r)
    assert len(got) == 46
    for i in range(40):
        mine = [j for j in range(400) if j % 40 == i]
        assert sorted(r["pos"] for r in got[str(i)]) == mine
        for r in got[str(i)]:
            given = rows[r["pos"]]
            assert (r["input"], r["from_address"]) == (given["input"], given["from_address"].lower())
            assert r["to_address"] == (given["to_address"] or "") and r["gas"] == "21000"
    assert [r["pos"] for r in got["44"]] == [None]
    best = sorted((j for j in range(400) if j % 3), key=lambda j: (-(j % 90), f"h{j}"))[:20]
    assert set(best) <= {r["pos"] for r in got["h"]} and len(got["h"]) == 40
    refused = spark.read.schema("request string, address string, reason string").json(f"{tmp_path}/out/failed")
    assert [(r["request"], r["reason"]) for r in refused.collect()] == [("n", "missing")]
