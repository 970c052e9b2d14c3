"""What the physical plans must and must not contain."""

import contextlib
import io

import pytest
from conftest import SMALL

from pyspark.sql import functions as F

from txrisk import proxy
from txrisk.catalog import QUERIES
from txrisk.operators.history import recent
from txrisk.operators.incidence import history_for, history_split, incidence
from txrisk.operators.sequences import latest_sequence


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def views(spark):
    return proxy.accounts(spark, SMALL), proxy.transactions(spark, SMALL)


@pytest.mark.parametrize("fits", [True, False])
def test_joins_are_equality_joins(spark, views, fits):
    accounts, tx = views
    for df in (
        history_for(accounts, tx, fits=fits),
        incidence(proxy.bulk_transactions(spark, SMALL), accounts, fits=fits),
    ):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text
        assert "HashJoin" in text


def test_rankings_stop_early(views):
    accounts, tx = views
    parts = history_split(accounts, tx, fits=False)
    assert "WindowGroupLimit" in plan(recent(parts, 100))
    assert "WindowGroupLimit" in plan(latest_sequence(parts, 50))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {
    # Whole jobs, with models, streams and files between their plans.
    "train_and_score", "score_static_only", "batch_scan", "scan_stream", "model_quality", "bulk_model",
    "model_predictions", "stream_failures", "saved_model", "feature_catalog", "model_info",
    "trained_weights", "model_evaluation", "newest_stream",
}))
def test_no_python_no_expand_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    for word in ("BatchEvalPython", "ArrowEvalPython", "Expand", "NestedLoop", "Cartesian"):
        assert word not in text


def test_call_data_stays_out_of_the_shuffle(spark, views):
    from txrisk.plans import scan

    accounts, tx = views
    text = plan(scan.profiles(accounts, tx.withColumn("input", F.concat("input", F.lit("x"))), with_transactions=False))
    exchanges = [line for line in text.splitlines() if "Window" in line or "Sort" in line]
    assert exchanges and not any("input" in line for line in exchanges)


def test_kept_history_is_joined_below_the_window(spark, views, tmp_path):
    from txrisk.plans import scan
    from txrisk.sources import tables

    accounts, tx = views
    tables.write_history(tx, str(tmp_path / "h"), shards=4)
    listed = accounts.limit(3)
    kept = tables.read_history(spark, str(tmp_path / "h"), listed)
    text = plan(scan.profiles(listed, kept, keyed=True, with_transactions=False))
    assert text.index("Window") < text.index("LeftSemi")
    assert "PushedFilters: [IsNotNull(address), GreaterThanOrEqual(address" in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(QUERIES["incidence_counts"](spark, SMALL))
    reads = [line for line in text.splitlines() if "ReadSchema" in line and "event_id" in line]
    assert reads and all("ts:" not in r and "value" not in r for r in reads)
