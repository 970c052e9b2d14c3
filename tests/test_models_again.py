"""Weights in closed steps, quality counters, class cuts, state of streams."""

import io
import contextlib
import math
import random

import numpy as np
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from txrisk import proxy
from txrisk.operators import prep, quality
from txrisk.operators.sequences import pool, pool_names
from txrisk.plans import newton, scan


def points(n=400, seed=2):
    random.seed(seed)
    rows = []
    for _ in range(n):
        a, b = random.gauss(0, 1), random.gauss(1, 2)
        p = 1 / (1 + math.exp(-(0.3 + 1.5 * a - 0.7 * b)))
        rows.append((float(random.random() < p), a, b))
    return rows


def test_newton_weights_solve_the_likelihood(spark):
    rows = points()
    df = spark.createDataFrame(rows, "flag double, a double, b double")
    w = np.array(newton.newton_weights(df, ["a", "b"]))
    x = np.array([(1.0, a, b) for _, a, b in rows])
    y = np.array([r[0] for r in rows])
    gradient = x.T @ (y - 1 / (1 + np.exp(-x @ w)))
    assert np.abs(gradient).max() < 1e-8
    # Other partitions, the same weights.
    again = newton.newton_weights(df.repartition(7), ["a", "b"])
    assert np.allclose(w, again, atol=1e-12)
    # One flipped label moves them.
    flipped = [(1 - rows[0][0], *rows[0][1:]), *rows[1:]]
    other = newton.newton_weights(spark.createDataFrame(flipped, "flag double, a double, b double"), ["a", "b"])
    assert not np.allclose(w, other, atol=1e-4)


def test_newton_weights_of_odd_rows(spark):
    rows = [(1.0, 1.0, 5.0), (0.0, 2.0, 5.0), (1.0, 3.0, 5.0), (0.0, 0.5, 5.0), (None, 1.0, 1.0), (1.0, None, 1.0), (1.0, float("nan"), 2.0)]
    df = spark.createDataFrame(rows, "flag double, a double, b double")
    w = newton.newton_weights(df, ["a", "b"])
    assert all(map(math.isfinite, w))
    assert newton.newton_weights(df.limit(0), ["a", "b"]) == [0.0, 0.0, 0.0]


def test_quality_counters_beside_results(spark, make_tx, listed, tmp_path, fitted_two):
    tx = make_tx({}, {"from_address": None}, {"to_address": None, "value": "n/a"}, {"time_stamp": "", "gas": "bad"})
    asked = spark.createDataFrame([("0xa",), (None,), ("0xb",)], "address string")
    got = scan.batch_scan(asked, tx, fitted_two, save_to=str(tmp_path))
    assert got.count() == 2
    found = {r.counter: r.records for r in spark.read.json(str(tmp_path / "quality")).collect()}
    assert found == {
        "requests": 3, "failed_requests": 1, "transactions": 4, "null_from": 1, "null_to": 1,
        "unreadable_value": 1, "untimed": 1, "malformed": 2,
    }


@pytest.fixture(scope="module")
def fitted_two(spark):
    from txrisk.plans import model

    rows = [("0x" + str(i), i % 2, float(i % 2)) for i in range(20)]
    df = spark.createDataFrame(rows, "address string, flag int, sent_count double")
    df = df.withColumn("pooled", F.array_repeat(F.lit(0.0), len(pool_names())))
    return model.train_classifier(df, ["sent_count"], "logistic")


def test_pooled_aggregate_equals_the_pooled_matrix(spark):
    accounts, tx = proxy.accounts(spark, SMALL), proxy.transactions(spark, SMALL)
    for k, length in ((100, 50), (100, 7), (3, 5)):
        a = scan.profiles(accounts, tx, k, length, with_transactions=False, encoding="pooled").select("address", "pooled")
        b = scan.profiles(accounts, tx, k, length, with_transactions=False).select("address", pool(F.col("sequence")).alias("p"))
        rows = a.join(b, "address").collect()
        assert len(rows) == 150
        assert all(np.allclose(r.pooled, r.p, rtol=1e-7, atol=1e-7) for r in rows)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_no_list_is_longer_than_the_sequence(spark):
    """Steps are dropped where the rows are ranked; a pooled scan gathers no steps at all."""
    accounts, tx = proxy.accounts(spark, SMALL), proxy.transactions(spark, SMALL)
    text = plan(scan.profiles(accounts, tx, with_transactions=False, encoding="pooled"))
    assert "collect_list" not in text
    lists = scan.profiles(accounts, tx, 100, 4, with_transactions=False)
    assert "place" in plan(lists)
    assert {len(r.sequence) for r in lists.collect()} == {4}


def test_a_scan_without_hubs_has_one_path(spark):
    accounts, tx = proxy.accounts(spark, SMALL), proxy.transactions(spark, SMALL)
    text = plan(scan.profiles(accounts, tx, with_transactions=False, encoding="pooled"))
    reads = [line for line in text.splitlines() if "FileScan parquet" in line and "events.parquet" in line]
    assert len(reads) == 1 and "Union" not in text


@pytest.mark.parametrize("few", [True, False])
def test_cuts_do_not_shuffle_rows_on_their_class(spark, monkeypatch, few):
    rows = [(i, [None, "a", "b"][i % 3] if i % 7 else "a") for i in range(400)]
    df = spark.createDataFrame(rows, "key long, label string")
    want = {r.key: r.split for r in prep.stratified_split(df, "label", "key").collect()}
    monkeypatch.setattr(prep, "fits_broadcast", lambda d: few)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = prep.stratified_split(df, "label", "key")
        assert {r.key: r.split for r in split.collect()} == want
        if few:
            # Rows carry their key; only counts and the rows of cut prefixes are exchanged.
            exchanged = [line for line in plan(split).splitlines() if "Exchange hashpartitioning(label" in line]
            assert all("_prefix" in line for line in exchanged)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
