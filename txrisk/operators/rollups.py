"""Features of whole histories out of totals kept per period.

What a feature needs of a transaction can be merged: counts, sums in two decimal halves,
extremes, first and last time stamps, all per account and counterparty, so that distinct
counterparties are rows.  A rollup keeps these totals in a folder per period.  A new day
is added by reading that day alone, a scan of whole histories reads totals in place of
transactions, and old periods can be merged into coarser ones.

A period is replaced as a whole, so adding it twice is the same as adding it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.functions.scalars import safe_int, valid_ts
from txrisk.operators.features import (
    features_for,
    features_of,
    fold_pairs,
    level_one,
    merge_pairs,
    narrow,
    pair_totals,
)
from txrisk.operators.incidence import account_rows, distinct_addresses
from txrisk.operators.skew import fits_broadcast

#: Period of transactions without a valid time stamp.
UNTIMED = -1


def day_of(time_stamp: str = "time_stamp") -> Column:
    """Days since 1970 of a transaction."""
    return F.coalesce(F.floor(valid_ts(safe_int(time_stamp)) / 86_400), F.lit(UNTIMED)).cast("int")


def period_totals(tx: DataFrame, period: Column | None = None) -> DataFrame:
    """``period, failed, address, other`` and totals; a period is a day unless given.

    ``failed`` marks transactions that ``exclude_failed`` would leave out.
    """
    rows = narrow(tx, (day_of() if period is None else period).alias("period"))
    rows = account_rows(rows).withColumn("failed", safe_int("is_error") != 0)
    return pair_totals(level_one(rows, keep=("period", "failed")), "period", "failed")


def coarser(totals: DataFrame, period: Column) -> DataFrame:
    """Totals of longer periods, such as ``floor(period / 30)``."""
    return merge_pairs(totals.withColumn("period", period.cast("int")), "period", "failed")


def write_rollup(totals: DataFrame, path: str) -> None:
    """Puts totals into the folders of their periods, in place of what these held."""
    (
        totals.repartition("period", F.pmod(F.xxhash64("address", "other"), F.lit(32)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("period")
        .parquet(path)
    )


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Totals of all periods; a filter on ``period`` opens its folders only."""
    return spark.read.parquet(path)


def rolled_features(
    totals: DataFrame,
    addresses: DataFrame | None = None,
    gap_order: str = "desc",
    exclude_failed: bool = False,
) -> DataFrame:
    """A1-A13 over the periods of ``totals``, equal to those of the transactions themselves.

    Without a list the result holds all accounts that occur; with one, an account
    without history has zeros.
    """
    if exclude_failed:
        totals = totals.where(~F.col("failed"))
    fits = False
    if addresses is not None:
        keys = distinct_addresses(addresses.select(F.lower("address").alias("address")))
        fits = fits_broadcast(keys)
        totals = totals.join(F.broadcast(keys) if fits else keys.hint("shuffle_hash"), "address", "left_semi")
    found = features_of(fold_pairs(merge_pairs(totals)), gap_order)
    return found if addresses is None else features_for(addresses, found, fits)
