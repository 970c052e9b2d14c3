"""Deep pages, rollups, kept histories and landed responses."""

import json

import pytest
from conftest import SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from txrisk import proxy
from txrisk.operators import history as hist
from txrisk.operators import rollups
from txrisk.operators.incidence import account_rows
from txrisk.operators.skew import Hot, hot_keys, settled
from txrisk.plans import scan
from txrisk.sources import explorer, tables


# -- pages ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def hubs(spark):
    """Two accounts with many rows, among them many of one second, block and index."""
    tx = proxy.transactions(spark, SMALL).withColumn("address", proxy.address_of(F.col("pos") % 2))
    same = F.col("pos") % 5 == 0
    tied = {
        "time_stamp": F.when(same, "1700000000").otherwise(F.col("time_stamp")),
        "block_number": F.when(same, "7").otherwise(F.col("block_number")),
        "transaction_index": F.when(same, "1").otherwise(F.col("transaction_index")),
    }
    return tx.withColumns(tied).select("address", "pos", "hash", *tied)


@pytest.mark.parametrize("sort", ["asc", "desc"])
@pytest.mark.parametrize("most", [1, 10, 10_000])
@pytest.mark.parametrize("page,offset", [(1, 10), (20, 7), (3, 100), (100_000, 10)])
def test_deep_pages_are_those_of_a_full_ranking(spark, hubs, sort, most, page, offset):
    order = hist.newest_first() if sort == "desc" else hist.oldest_first()
    ranked = hubs.withColumn("rank", F.row_number().over(Window.partitionBy("address").orderBy(*order)))
    want = ranked.where(F.col("rank").between((page - 1) * offset + 1, page * offset))
    hot = hubs.select("address").distinct().withColumn("pieces", F.lit(3))
    got = hist.page(hubs, page=page, offset=offset, sort=sort, hot=hot, most=most)
    columns = ["address", "rank", "pos"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))


def test_a_deep_page_ranks_its_own_rows_only(spark, hubs):
    """The rows that meet in a ranking are those of the slices that the page is in."""
    most = 20
    rows = hist.rows_between(hubs, 151, 160, True, most)
    ranked = rows.sparkSession.createDataFrame(rows.collect(), rows.schema)
    assert ranked.groupBy("address").count().where("count <> 10").isEmpty()
    # The plan joins a table of slices before it ranks.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Join")


# -- hot keys ---------------------------------------------------------------------------


def test_settled_hot_keys(spark):
    df = spark.range(100).select(F.when(F.col("id") < 60, "hub").otherwise(F.col("id").cast("string")).alias("k"))
    known = settled(hot_keys(df, "k", 50))
    assert [r.k for r in known.keys.collect()] == ["hub"]
    assert settled(known) is known
    assert settled(hot_keys(df, "k", 1000)) == Hot(None)


# -- rollups ------------------------------------------------------------------------------


@pytest.fixture
def rolled(spark, make_tx, tmp_path):
    days = [{"time_stamp": str(86_400 * d + s), "from_address": f, "to_address": t, "value": v, "is_error": e}
            for d, s, f, t, v, e in [
                (1, 5, "0xa", "0xb", "5" + "0" * 18, "0"), (1, 9, "0xA", "0xb", "2" + "0" * 37, "0"),
                (2, 1, "0xb", "0xa", "bad", "1"), (2, 2, "0xa", "0xa", str(2**140), "0"),
                (3, 0, "0xa", "", "1", "0"), (3, 7, "0xc", "0xa", "3", "1"),
            ]]
    days.append({"time_stamp": "", "from_address": "0xa", "to_address": "0xd", "input": "0x1"})
    return make_tx(*days), str(tmp_path / "rollup")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("failed", [True, False])
@pytest.mark.parametrize("order", ["asc", "desc"])
def test_rollup_equals_a_full_scan(spark, rolled, failed, order):
    tx, path = rolled
    for day in (1, 2, 3, rollups.UNTIMED, 3, 1):
        rollups.write_rollup(rollups.period_totals(tx.where(rollups.day_of() == day)), path)
    totals = rollups.read_rollup(spark, path)
    want = scan.behaviour(None, tx, k=None, gap_order=order, exclude_failed=failed)
    got = rollups.rolled_features(totals, gap_order=order, exclude_failed=failed)
    assert rows(got) == rows(want)
    coarse = rollups.coarser(totals, F.lit(0))
    assert coarse.groupBy("failed", "address", "other").count().where("count > 1").isEmpty()
    assert rows(rollups.rolled_features(coarse, gap_order=order, exclude_failed=failed)) == rows(want)


def test_rollup_of_a_list(spark, rolled, listed):
    tx, path = rolled
    rollups.write_rollup(rollups.period_totals(tx), path)
    asked = listed("0xA", "0xnone", "0xb")
    got = rollups.rolled_features(rollups.read_rollup(spark, path), asked)
    assert rows(got) == rows(scan.behaviour(asked, tx, k=None))


def test_a_new_day_replaces_no_other(spark, rolled):
    tx, path = rolled
    rollups.write_rollup(rollups.period_totals(tx), path)
    before = {r["period"]: r["n"] for r in rollups.read_rollup(spark, path).groupBy("period").agg(F.sum("total").alias("n")).collect()}
    rollups.write_rollup(rollups.period_totals(tx.where(rollups.day_of() == 2).limit(1)), path)
    after = {r["period"]: r["n"] for r in rollups.read_rollup(spark, path).groupBy("period").agg(F.sum("total").alias("n")).collect()}
    assert {p: n for p, n in after.items() if p != 2} == {p: n for p, n in before.items() if p != 2}
    assert after[2] < before[2]


# -- kept histories --------------------------------------------------------------------------


def test_a_lookup_opens_files_of_its_folders_only(spark, tmp_path):
    tx, path = proxy.transactions(spark, SMALL), str(tmp_path / "h")
    tables.write_history(tx, path, shards=32)
    accounts = proxy.accounts(spark, SMALL).limit(2)
    folders = {r["s"] for r in accounts.select(tables.shard_of("address", 32).alias("s")).collect()}
    history = tables.read_history(spark, path, accounts)
    opened = {f.split("/shard=")[1].split("/")[0] for f in history.inputFiles() if path in f}
    assert opened and opened <= {str(s) for s in folders}
    keys = [r["address"] for r in accounts.collect()]
    want = account_rows(tx).where(F.col("address").isin(keys))
    assert sorted(r["pos"] for r in history.collect()) == sorted(r["pos"] for r in want.collect())


def test_a_lookup_of_unknown_accounts_opens_nothing(spark, tmp_path, listed):
    path = str(tmp_path / "h")
    tables.write_history(proxy.transactions(spark, SMALL), path, shards=4)
    assert tables.read_history(spark, path, listed("zzz")).collect() == []
    catalogue = tables.read_catalogue(spark, path)
    assert catalogue.agg(F.sum("rows")).first()[0] == spark.read.parquet(path).count()


def test_hubs_are_kept_with_a_history(spark, make_tx, listed, tmp_path):
    tx = make_tx(*[{"time_stamp": str(i + 1), "to_address": f"0x{i % 3}"} for i in range(30)])
    hot = listed("0xa").withColumn("pieces", F.lit(4))
    tables.write_history(tx, str(tmp_path / "h"), shards=4, hot=hot)
    assert tables.read_hubs(spark, str(tmp_path / "h")).collect() == hot.collect()
    tables.write_history(tx, str(tmp_path / "i"), shards=4, hot=Hot(None))
    assert tables.read_hubs(spark, str(tmp_path / "i")).collect() == []


# -- landed responses ----------------------------------------------------------------------------


def response(address, hashes, at, status="1", page=None):
    result = json.dumps([{"hash": h} for h in hashes]) if status == "1" else "Max rate limit reached"
    return {"address": address, "status": status, "message": "", "result": result, "page": page, "landed_at": at}


SCHEMA = "address string, status string, message string, result string, page int, landed_at long"


def test_the_newest_response_counts(spark, tmp_path):
    batches = [
        [response("0xa", ["1"], 1), response("0xb", ["9"], 1), response("0xc", ["5"], 1, page=1), response("0xc", ["6"], 1, page=2)],
        [response("0xa", ["1", "2"], 3), response("0xa", ["3"], 2)],
        [response("0xa", [], 4, status="0"), response("0xb", ["9"], 1)],
        [response(None, ["7"], 1), response(None, ["7"], 1), response("0xc", ["8"], 2, page=2)],
    ]
    folder = str(tmp_path)
    for _ in range(2):
        for i, batch in enumerate(batches):
            rows = [tuple(r[c] for c in ("address", "status", "message", "result", "page", "landed_at")) for r in batch]
            explorer.land(spark.createDataFrame(rows, SCHEMA), folder, "txlist", str(i))
    got = explorer.read_explorer(spark, folder)
    assert sorted(((r.address or "", r.pos, r.hash) for r in got.collect())) == [
        ("", 0, "7"), ("0xa", 0, "1"), ("0xa", 1, "2"), ("0xb", 0, "9"), ("0xc", 0, "5"), ("0xc", 0, "8"),
    ]
    # A strict reading takes the last word, and that of 0xa was a refusal.
    last = explorer.newest(explorer.read_envelopes(spark, folder), prefer_ok=False)
    assert [r.address for r in last.where(explorer.problem().isNotNull()).collect()] == ["0xa"]


def test_kinds_have_fields_of_their_own(spark, tmp_path):
    internal = [{"hash": "1", "traceId": "0_1", "type": "call", "errCode": ""}]
    token = [{"hash": "2", "tokenDecimal": "6", "value": "1500000", "tokenSymbol": "T"}, {"hash": "3", "value": "x"}]
    for kind, result in (("txlistinternal", internal), ("tokentx", token)):
        row = [("0xa", "1", "OK", json.dumps(result))]
        explorer.land(spark.createDataFrame(row, "address string, status string, message string, result string"), str(tmp_path), kind, "1")
    (r,) = explorer.read_explorer(spark, str(tmp_path), "txlistinternal").collect()
    assert (r.hash, r.trace_id, r.call_type) == ("1", "0_1", "call")
    rows = explorer.read_explorer(spark, str(tmp_path), "tokentx").withColumn("amount", explorer.token_amount())
    assert [(r.hash, r.token_symbol, r.amount) for r in rows.orderBy("pos").collect()] == [("2", "T", 1.5), ("3", None, 0.0)]
