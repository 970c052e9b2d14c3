"""Ledger-shaped views over the driver's tables, for queries, tests and bench.

The given tables hold no ledger data, so ``events`` stands in for the bulk
transactions and ``customer`` for the registry of accounts.  Some rows are made
blank or unreadable on purpose, as explorer data is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# An amount of 40 digits, more than a decimal holds: 2 ** 130.
HUGE = str(2**130)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def address_of(number) -> F.Column:
    """Account address of a numeric key."""
    return F.concat(F.lit("0x"), F.lpad(number.cast("string"), 40, "0"))


def _epoch(ts):
    """Epoch seconds of a zone-less timestamp, whatever the session time zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def transactions(spark: SparkSession, sf_dir: str, huge: bool = False) -> DataFrame:
    """Explorer-shaped transactions over ``events``; ``huge`` adds amounts that only
    a double holds."""
    e = table(spark, sf_dir, "events")
    i, kind = F.col("event_id"), F.col("event_type")
    text = lambda c: c.cast("string")
    return e.select(
        i.alias("pos"),
        F.concat(F.lit("0x"), F.right(F.md5(text(i)), F.lit(32))).alias("hash"),
        address_of(F.col("user_id")).alias("from_address"),
        F.when(kind == "signup", "")
        .otherwise(address_of(F.regexp_extract("props", "([0-9]+)", 1)))
        .alias("to_address"),
        F.when(i % 103 == 0, "")
        .when(i % 107 == 0, "n/a")
        .when((i % 109 == 0) & F.lit(huge), HUGE)
        .otherwise(
            F.concat(text(F.round(F.col("value") * 100, 0).cast("bigint")), F.lit("0000000000000000"))
        )
        .alias("value"),
        F.when(i % 101 == 0, "").otherwise(text(_epoch(F.col("ts")))).alias("time_stamp"),
        F.when(i % 97 == 0, "bad").otherwise(text(21000 + i % 79000)).alias("gas"),
        F.concat(text(1 + i % 50), F.lit("000000000")).alias("gas_price"),
        text(20000 + i % 7000).alias("gas_used"),
        F.when(kind == "error", "1").otherwise("0").alias("is_error"),
        text(19000000 + F.floor(i / 10).cast("bigint")).alias("block_number"),
        text(i % 10).alias("transaction_index"),
        F.when(i % 89 == 0, "").otherwise(text(10000000 - i)).alias("confirmations"),
        F.when(kind == "purchase", "0xa9059cbb00000000000000000000000000000001")
        .when(kind == "click", "deprecated")
        .when(kind == "view", "0x00")
        .otherwise("0x")
        .alias("input"),
        F.concat(F.lit("0x"), F.md5(text(F.floor(i / 10)))).alias("block_hash"),
        text(i % 1000).alias("nonce"),
        F.when(kind == "purchase", "0xa9059cbb").otherwise("0x").alias("method_id"),
        F.when(kind == "purchase", "transfer(address,uint256)").otherwise("").alias("function_name"),
        F.when(kind == "signup", address_of(i + 1_000_000)).otherwise("").alias("contract_address"),
        text(30000 + i % 9000).alias("cumulative_gas_used"),
        F.when(kind == "error", "0").otherwise("1").alias("txreceipt_status"),
    )


def bulk_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulk-export shape over ``events``: three roles, text time, numeric columns."""
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    users = F.col("user_id")
    return e.select(
        i.alias("pos"),
        address_of(users).alias("from_address"),
        F.when(F.col("event_type") == "signup", "")
        .otherwise(address_of(F.regexp_extract("props", "([0-9]+)", 1)))
        .alias("to_address"),
        address_of(i % 150).alias("source_address"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("created_at"),
        F.col("value"),
        (21000 + i % 79000).alias("gas"),
        (20000 + i % 7000).alias("gas_used"),
        (19000000 + F.floor(i / 10).cast("bigint")).alias("block_number"),
        (i % 10).alias("transaction_index"),
        F.lit("0x").alias("function_name"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry of accounts over ``customer``; the label marks a negative balance."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        address_of(F.col("c_custkey")).alias("address"),
        F.when(F.col("c_acctbal") < 0, 1).otherwise(0).alias("flag"),
        F.col("c_custkey").alias("key"),
    )
