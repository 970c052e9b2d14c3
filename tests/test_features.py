import random

import pytest
from loops import features as loop_features
from loops import newest, sequence, touches
from pyspark.sql import functions as F

from txrisk.operators.features import account_features, features_for
from txrisk.operators.history import batch_index, page, recent, tx_gaps
from txrisk.operators.incidence import account_rows, history_for, history_split, incidence, touching
from txrisk.operators.sequences import drop_malformed, first_n, latest_sequence, to_matrix
from txrisk.operators.skew import hot_keys, top_k
from txrisk.plans.scan import behaviour, profiles
from txrisk.schemas import COMPUTED_FEATURES

ETH = 10**18


def feats(tx, *addresses, spark=None, **kw):
    rows = account_features(history_for(None, tx), **kw).collect()
    return {r["address"]: r.asDict() for r in rows}


def test_single_transaction(make_tx):
    f = feats(make_tx({}))
    a, b = f["0xa"], f["0xb"]
    assert (a["sent_count"], a["received_count"], a["total_transactions"]) == (1, 0, 1)
    assert (b["sent_count"], b["received_count"]) == (0, 1)
    assert a["time_diff_first_last_mins"] == a["avg_min_between_sent"] == 0
    assert a["total_balance"] == -1.0 and b["total_balance"] == 1.0


def test_transfer_to_self_counts_in_both_roles_but_once(make_tx):
    a = feats(make_tx({"to_address": "0xA"}))["0xa"]
    assert (a["sent_count"], a["received_count"], a["total_transactions"]) == (1, 1, 1)
    assert (a["unique_sent_to"], a["unique_received_from"]) == (1, 1)
    assert a["total_balance"] == 0


def test_contract_creation_and_calls(make_tx):
    long_call = "0xa9059cbb" + "0" * 100 + "1"
    inputs = ["", "0x", "0x00", "deprecated", "0xzz"]
    tx = make_tx(
        {"to_address": "", "input": long_call},
        {"to_address": None, "input": long_call},
        {"input": long_call, "value": str(3 * ETH)},
        *[{"input": i} for i in inputs],
    )
    a = feats(tx)["0xa"]
    assert a["created_contracts"] == 2
    assert a["unique_sent_to"] == 1
    assert a["total_sent_contracts"] == a["min_sent_contract"] == 3.0


def test_mixed_case_is_one_account(make_tx):
    f = feats(make_tx({"from_address": "0xAB"}, {"from_address": "0xab"}))
    assert set(f) == {"0xab", "0xb"}
    assert f["0xab"]["sent_count"] == 2


def test_unreadable_value_counts_as_zero(make_tx):
    a = feats(make_tx({"value": "n/a"}, {"value": ""}, {}))["0xa"]
    assert a["sent_count"] == 3 and a["min_sent"] == 0 and a["total_sent"] == 1.0


def test_gaps_follow_list_order(make_tx):
    times = ["1000", "1120", "1300", "", "0"]
    tx = make_tx(*[{"time_stamp": t} for t in times])
    down, up = feats(tx)["0xa"], feats(tx, gap_order="asc")["0xa"]
    assert up["avg_min_between_sent"] == 2.5 and down["avg_min_between_sent"] == -2.5
    assert up["time_diff_first_last_mins"] == 5.0


def test_exclude_failed(make_tx):
    tx = make_tx({"is_error": "1"}, {})
    assert feats(tx)["0xa"]["sent_count"] == 2
    assert feats(tx, exclude_failed=True)["0xa"]["sent_count"] == 1


def test_no_history_gives_zeros_and_duplicates_stay(make_tx, listed):
    rows = features_for(listed("0xA", "0xA", "0xnone"), account_features(history_for(None, make_tx({}))))
    got = sorted((r["address"], r["sent_count"]) for r in rows.collect())
    assert got == [("0xA", 1), ("0xA", 1), ("0xnone", 0)]
    none = [r for r in rows.collect() if r["address"] == "0xnone"][0]
    assert all(none[c] == 0 for c in COMPUTED_FEATURES)


def some_rows(n=400, accounts=7, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        # One account is a party to most of the transactions.
        a = 0 if rnd.random() < 0.5 else rnd.randrange(accounts)
        rows.append(
            {
                "from_address": f"0x{a}",
                "to_address": rnd.choice(["", f"0x{rnd.randrange(accounts)}", f"0X{rnd.randrange(accounts)}"]),
                "value": rnd.choice(["", "n/a", str(rnd.randrange(10**20))]),
                "time_stamp": rnd.choice(["", str(1_700_000_000 + rnd.randrange(300) * 600)]),
                "gas": rnd.choice(["", "bad", "12.5", "21000"]),
                "is_error": rnd.choice(["0", "1"]),
                "block_number": str(rnd.randrange(50)),
                "transaction_index": str(rnd.randrange(5)),
                "confirmations": rnd.choice(["", "7"]),
                "input": rnd.choice(["0x", "0x00", "0x1", "deprecated"]),
            }
        )
    return rows


@pytest.fixture
def sample(make_tx):
    rows = some_rows()
    df = make_tx(*rows)
    return df.cache(), [r.asDict() for r in df.collect()]


ACCOUNTS = [f"0x{i}" for i in range(7)]


@pytest.mark.parametrize("hot_rows", [None, 20])
@pytest.mark.parametrize("k", [10, 1000])
def test_features_and_sequences_match_loops(sample, listed, k, hot_rows):
    tx, rows = sample
    hot = hot_keys(account_rows(tx), "address", hot_rows) if hot_rows else None
    got = {r["address"]: r for r in profiles(listed(*ACCOUNTS), tx, k, 15, hot=hot).collect()}
    lean = {r["address"]: r for r in behaviour(listed(*ACCOUNTS), tx, k, hot=hot).collect()}
    for a in ACCOUNTS:
        mine = newest(touches(rows, a), k)
        # Received rows of other spellings compare in lower case.
        expected = loop_features(a, mine)
        for c in COMPUTED_FEATURES:
            assert got[a][c] == pytest.approx(expected[c], rel=1e-9, abs=1e-9), (a, c)
            assert lean[a][c] == got[a][c], (a, c)
        flat = [v for step in got[a]["sequence"] for v in step]
        assert flat == pytest.approx([v for step in sequence(mine, 15) for v in step])
        assert [t["hash"] for t in got[a]["transactions_used"]] == [r["hash"] for r in mine]


@pytest.mark.parametrize("hot_rows", [1, 30])
def test_hot_path_changes_nothing(sample, listed, hot_rows):
    tx, _ = sample
    hot = hot_keys(account_rows(tx), "address", hot_rows)
    assert hot.count() > 0
    some = listed("0x0", "0X3", "0x9")

    def same(a, b):
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))

    plain = history_for(some, tx, fits=True)
    split = history_split(some, tx, hot, fits=False)
    same(plain, history_for(some, tx, hot, fits=False).select(plain.columns))
    same(plain, split.union().select(plain.columns))
    same(recent(plain, 9).select("address", "rank", "pos"), recent(split, 9).select("address", "rank", "pos"))
    same(page(plain, page=3, offset=4, sort="asc").select("address", "rank", "pos"),
         page(split, page=3, offset=4, sort="asc").select("address", "rank", "pos"))
    same(tx_gaps(plain), tx_gaps(split))
    same(latest_sequence(plain, 11), latest_sequence(split, 11))
    every = history_split(None, tx, hot)
    same(recent(history_for(None, tx), 9).select("address", "rank", "pos"),
         recent(every, 9).select("address", "rank", "pos"))


def test_mean_gap_equals_mean_of_gaps(sample):
    tx, _ = sample
    history = history_for(None, tx)
    means = {
        (r["address"], r["role"]): r["m"]
        for r in tx_gaps(history).groupBy("address", "role").agg(F.avg("gap_mins").alias("m")).collect()
    }
    for r in account_features(history, gap_order="asc").collect():
        for role in ("sent", "received"):
            expected = means.get((r["address"], role)) or 0
            assert r[f"avg_min_between_{role}"] == pytest.approx(expected)


def test_partitioning_changes_nothing(sample):
    tx, _ = sample
    one = account_features(history_for(None, tx.coalesce(1))).orderBy("address").collect()
    many = account_features(history_for(None, tx.repartition(9))).orderBy("address").collect()
    assert one == many


def test_pages(make_tx):
    tx = make_tx(*[{"time_stamp": str(1000 + i), "block_number": str(i)} for i in range(10)])
    a = history_for(None, tx).where("address = '0xa'")
    second = page(a, start_block=1, end_block=8, page=2, offset=3).orderBy("rank").collect()
    assert [r["block_number"] for r in second] == ["5", "4", "3"]
    first = page(a, page=1, offset=2, sort="asc").orderBy("rank").collect()
    assert [r["block_number"] for r in first] == ["0", "1"]
    assert page(a, page=5, offset=3).count() == 0


def test_ties_and_invalid_times(make_tx):
    tx = make_tx({"time_stamp": "5", "gas": "1"}, {"time_stamp": "5", "gas": "2"}, {"time_stamp": ""}, {"gas": "3"})
    steps = latest_sequence(history_for(None, tx).where("address = '0xa'")).orderBy("step").collect()
    assert [s["gas"] * 1e6 for s in steps] == pytest.approx([3, 1, 2, 21000])


def test_malformed_rows(make_tx):
    tx = make_tx({"gas": ""}, {"gas": "12.5"}, {"value": "n/a"}, {"gas_price": "x"}, {"gas_price": "9" * 25})
    assert sorted(r["pos"] for r in drop_malformed(tx).collect()) == [0, 4]


@pytest.mark.parametrize("n, real", [(49, 49), (50, 50), (51, 50), (0, 0)])
def test_padding(make_tx, n, real):
    tx = make_tx(*[{"time_stamp": str(1000 + i)} for i in range(n)], {"from_address": "0xz"})
    a = history_for(None, tx).where("address = '0xa'")
    rows = to_matrix(latest_sequence(a)).collect()
    if n == 0:
        assert rows == []
    else:
        assert len(rows[0]["sequence"]) == 50
        assert sum(1 for s in rows[0]["sequence"] if s[3] != 0) == real


def bulk(spark):
    rows = [
        (0, "0xa", "0xb", "0xa", "2024-01-01 00:00:00.5", 1.5, 7),
        (1, "0xb", "0xc", None, "2024-01-02 00:00:00.123456", 2.5, 8),
        (2, "0xc", "", "0xd", "2024-01-03 00:00:00.0", 3.5, 9),
        (3, "0xA", "0xe", "0xe", "2024-01-04 00:00:00.1", 4.5, 10),
    ]
    return spark.createDataFrame(
        rows,
        "pos bigint, from_address string, to_address string, source_address string, "
        "created_at string, value double, gas int",
    )


@pytest.mark.parametrize("fits", [True, False])
def test_touching_and_incidence(spark, listed, fits):
    tx, some = bulk(spark), listed("0xa", "0xd", "0xd", None)
    hit = touching(tx, some, fits=fits)
    assert hit.columns == tx.columns
    # Spelling counts here, and a row with two matching roles comes once.
    assert sorted(r["pos"] for r in hit.collect()) == [0, 2]
    pairs = incidence(tx, some, fits=fits).select("address", "pos").collect()
    assert sorted(map(tuple, pairs)) == [("0xa", 0), ("0xd", 2)]
    steps = first_n(incidence(tx, some, fits=fits), 5)
    assert steps.columns == ["address", "step", "value", "gas"]


def test_top_k_with_many_pieces(spark):
    df = spark.range(5000).select(F.col("id").alias("pos"), F.lit("x").alias("key"))
    hot = hot_keys(df, "key", 100)
    assert hot.first()["pieces"] == 50
    got = top_k(df, "key", [F.col("pos").desc()], 7, hot=hot).orderBy("rank").collect()
    assert [r["pos"] for r in got] == list(range(4999, 4992, -1))


def test_batch_index(listed):
    some = listed("c", "a", "b").coalesce(1)
    assert [tuple(r) for r in batch_index(some).orderBy("batch_index").collect()] == [
        ("c", 0), ("a", 1), ("b", 2),
    ]
