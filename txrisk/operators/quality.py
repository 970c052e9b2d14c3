"""Counters of what is wrong with the input, taken while it is read.

Blank parties and unreadable numbers do not stop a scan, so they are counted: the
counters are observed metrics of the same pass over the data, and cost no other one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from txrisk.functions.scalars import beyond_decimal, readable, safe_int, valid_ts
from txrisk.operators.sequences import is_well_formed


def transaction_counters() -> dict[str, Column]:
    """Conditions that are counted over transactions."""
    return {
        "transactions": F.lit(True),
        "null_from": F.col("from_address").isNull(),
        "null_to": F.col("to_address").isNull(),
        "unreadable_value": ~readable("value", "decimal(38,0)") & beyond_decimal("value").isNull(),
        "untimed": valid_ts(safe_int("time_stamp")).isNull(),
        "malformed": ~F.coalesce(is_well_formed(), F.lit(False)),
    }


def request_counters() -> dict[str, Column]:
    """Conditions that are counted over checked requests, which have a ``reason`` if they fail."""
    return {"requests": F.lit(True), "failed_requests": F.col("reason").isNotNull()}


def observed(df: DataFrame, counters: dict[str, Column]) -> tuple[DataFrame, Observation]:
    """``df`` with counters; they are known when the first action on it is over."""
    seen = Observation()
    return df.observe(seen, *[F.count_if(c).alias(name) for name, c in counters.items()]), seen


def counters_table(spark: SparkSession, *seen: Observation) -> DataFrame:
    """``counter, records``: one row per counter of finished observations."""
    rows = [(name, int(n)) for s in seen for name, n in s.get.items()]
    return spark.createDataFrame(rows, "counter string, records bigint")
