"""Predicted classes are checked cell by cell and row by row."""

import pytest
from check_oracle import compare, connect
from conftest import SMALL
from pyspark.sql import functions as F

import __spark_entry__ as entry
from txrisk import catalog
from txrisk.plans import model


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_wrong_cells_are_seen(spark, con, monkeypatch):
    right, sql = catalog._scored, entry.oracle_sql()["predicted_confusion"]
    assert compare(entry.queries()["predicted_confusion"](spark, SMALL), con, sql) == ""
    monkeypatch.setattr(catalog, "_scored", lambda s, d: right(s, d).withColumn("predicted", 1 - F.col("predicted")))
    assert compare(entry.queries()["predicted_confusion"](spark, SMALL), con, sql) != ""


def test_wrong_predictions_are_seen(spark, con, monkeypatch):
    right, sql = model.predictions, entry.oracle_sql()["model_agreement"]
    monkeypatch.setattr(model, "predictions", lambda df, m: right(df, m).withColumn("predicted", 1 - F.col("predicted")))
    assert compare(entry.queries()["model_agreement"](spark, SMALL), con, sql) != ""
