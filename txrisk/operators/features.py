"""The 22 behavioural features of an account.

Two aggregates do all of it.  The first has one row per account and
counterparty; the number of those rows is the number of distinct
counterparties, so no set of neighbours is ever held in memory.  The second
folds them into one row per account.  Both combine on the map side, so a hub
account sends one partial row per task and pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions.scalars import (
    beyond_decimal,
    exact_sums,
    hex_nonzero,
    is_contract_call,
    is_created_contract,
    safe_int,
    sum_to_ether,
    to_ether,
    valid_ts,
    wei,
)
from txrisk.operators.skew import join_on_key
from txrisk.schemas import COMPUTED_FEATURES

_GROUPS = ("sent", "received", "contract")


def narrow(tx: DataFrame, *more: Column) -> DataFrame:
    """What features and rankings need of a transaction, as numbers.

    Done before the first shuffle: call data is long, and text numbers would be
    parsed again in every step.  ``more`` are columns that go along.
    """
    return tx.select(
        "pos",
        "hash",
        "from_address",
        "to_address",
        wei("value").alias("value"),
        beyond_decimal("value").alias("beyond"),
        *[
            safe_int(c).alias(c)
            for c in ("time_stamp", "block_number", "transaction_index", "is_error")
        ],
        hex_nonzero("input").alias("has_data"),
        *more,
    )


def level_one(history: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Column preparation for the first aggregate; ``keep`` are columns that go along."""
    beyond = F.col("beyond") if "beyond" in history.columns else beyond_decimal("value")
    call = "has_data" if "has_data" in history.columns else hex_nonzero("input")
    return history.select(
        "address",
        # For a transfer to oneself this is the account itself, in both roles.
        # Rows of neither role still count as transactions.
        F.when(F.col("sent"), F.col("to_address"))
        .when(F.col("received"), F.col("from_address"))
        .alias("other"),
        F.col("sent").alias("is_sent"),
        F.col("received").alias("is_received"),
        is_contract_call("sent", "to_address", call).alias("is_contract"),
        is_created_contract("sent", "to_address").alias("is_created"),
        wei("value").alias("wei"),
        F.coalesce(beyond / 1e18, to_ether(wei("value"))).alias("ether"),
        beyond.alias("beyond"),
        valid_ts(safe_int("time_stamp")).alias("ts"),
        *keep,
    )


def _totals() -> dict[str, Column]:
    """Counts, sums and extremes over prepared rows."""
    out = {
        "total": F.count(F.lit(1)),
        "timed": F.count("ts"),
        "ts_first": F.min("ts"),
        "ts_last": F.max("ts"),
        "created": F.count_if("is_created"),
    }
    for g in _GROUPS:
        # Sums are decimal, so that their order does not matter; extremes are
        # the same in double, and cheaper.
        value = F.when(F.col(f"is_{g}"), F.col("ether"))
        out[f"{g}_n"] = F.count(value)
        out[f"{g}_min"] = F.min(value)
        out[f"{g}_max"] = F.max(value)
        high, low = exact_sums(F.when(F.col(f"is_{g}"), F.col("wei")))
        out[f"{g}_high"], out[f"{g}_low"] = high, low
        out[f"{g}_beyond"] = F.sum(F.when(F.col(f"is_{g}"), F.col("beyond")))
    for g in ("sent", "received"):
        ts = F.when(F.col(f"is_{g}"), F.col("ts"))
        out[f"{g}_timed"] = F.count(ts)
        out[f"{g}_first"] = F.min(ts)
        out[f"{g}_last"] = F.max(ts)
    return out


def pair_totals(rows: DataFrame, *by: str) -> DataFrame:
    """Level one: one row per account and counterparty (and ``by``)."""
    return rows.groupBy(*by, "address", "other").agg(*[c.alias(n) for n, c in _totals().items()])


def _merged(name: str) -> Column:
    """How totals of one name are put together."""
    if name.endswith(("_min", "_first")):
        return F.min(name)
    if name.endswith(("_max", "_last")):
        return F.max(name)
    return F.sum(name)


def merge_pairs(totals: DataFrame, *by: str) -> DataFrame:
    """Several rows of an account and counterparty as one; totals of totals are the same."""
    kinds = dict(totals.dtypes)
    # Sums of decimals grow by ten digits a time, which they do not need.
    merged = [_merged(n).cast(kinds[n]).alias(n) for n in _totals()]
    return totals.groupBy(*by, "address", "other").agg(*merged)


def fold_pairs(pairs: DataFrame) -> DataFrame:
    """Level two: one row per account, out of one row per account and counterparty."""
    return pairs.groupBy("address").agg(
        *[_merged(n).alias(n) for n in _totals()],
        F.count_if((F.col("sent_n") > 0) & (F.col("other") != "")).alias("unique_sent_to"),
        F.count_if(F.col("received_n") > 0).alias("unique_received_from"),
    )


def _fold_short(rows: DataFrame, beside: list[Column]) -> DataFrame:
    """The same for histories cut to the newest ``k``: at most ``k`` rows meet per
    account, so sets and lists of them are small."""
    other = F.col("other")

    def distinct(condition: Column) -> Column:
        return F.size(F.collect_set(F.when(condition, other))).cast("bigint")

    return rows.groupBy("address").agg(
        *[c.alias(n) for n, c in _totals().items()],
        distinct(F.col("is_sent") & (other != "")).alias("unique_sent_to"),
        distinct(F.col("is_received")).alias("unique_received_from"),
        *beside,
    )


def _mean_gap(role: str, gap_order: str) -> Column:
    """Consecutive gaps telescope to (last - first) / (n - 1).

    In a newest-first list the last row is the oldest, so gaps are negative.
    """
    span = (F.col(f"{role}_last") - F.col(f"{role}_first")) / 60
    signed = span if gap_order == "asc" else -span
    enough = (F.col(f"{role}_timed") > 1) & (F.col("timed") > 1)
    return F.when(enough, signed / (F.col(f"{role}_timed") - 1)).otherwise(0.0)


def account_features(
    history: DataFrame,
    gap_order: str = "desc",
    exclude_failed: bool = False,
    keep: tuple[str, ...] = (),
    beside: list[Column] | None = None,
) -> DataFrame:
    """One row per account with 22 features.

    ``history`` has ``address``, ``sent``, ``received`` and the raw columns.
    ``gap_order='desc'`` measures gaps along a newest-first list, which makes
    the two gap averages zero or negative; ``'asc'`` makes them positive.
    ``beside`` are further aggregates over the columns ``keep``; they may gather lists,
    so they are for histories cut to the newest ``k`` only.
    """
    if exclude_failed:
        history = history.where(safe_int("is_error") == 0)
    rows = level_one(history, keep)
    folded = _fold_short(rows, beside) if beside else fold_pairs(pair_totals(rows))
    return features_of(folded, gap_order)


def features_of(folded: DataFrame, gap_order: str = "desc") -> DataFrame:
    """The 22 features out of the totals of an account; columns beside them stay."""
    if gap_order not in ("asc", "desc"):
        raise ValueError(f"gap_order must be 'asc' or 'desc', not {gap_order!r}")
    known = {"address", "unique_sent_to", "unique_received_from", *_totals()}

    def amount(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit(0.0))

    def total(g: str) -> Column:
        return F.coalesce(sum_to_ether(f"{g}_high", f"{g}_low", f"{g}_beyond"), F.lit(0.0))

    def mean(g: str) -> Column:
        return F.when(F.col(f"{g}_n") > 0, total(g) / F.col(f"{g}_n")).otherwise(0.0)

    features = {
        "avg_min_between_sent": _mean_gap("sent", gap_order),
        "avg_min_between_received": _mean_gap("received", gap_order),
        "time_diff_first_last_mins": F.when(
            F.col("timed") > 1, (F.col("ts_last") - F.col("ts_first")) / 60
        ).otherwise(0.0),
        "sent_count": F.col("sent_n"),
        "received_count": F.col("received_n"),
        "created_contracts": F.col("created"),
        "unique_received_from": F.col("unique_received_from"),
        "unique_sent_to": F.col("unique_sent_to"),
        "min_received": amount("received_min"),
        "max_received": amount("received_max"),
        "avg_received": mean("received"),
        "min_sent": amount("sent_min"),
        "max_sent": amount("sent_max"),
        "avg_sent": mean("sent"),
        "min_sent_contract": amount("contract_min"),
        "max_sent_contract": amount("contract_max"),
        "avg_sent_contract": mean("contract"),
        "total_transactions": F.col("total"),
        "total_sent": total("sent"),
        "total_received": total("received"),
        "total_sent_contracts": total("contract"),
        "total_balance": total("received") - total("sent"),
    }
    return folded.select(
        "address",
        *[features[name].alias(name) for name in COMPUTED_FEATURES],
        *[c for c in folded.columns if c not in known],
    )


def features_for(
    addresses: DataFrame, features: DataFrame, fits: bool = False
) -> DataFrame:
    """Feature row for every listed account; one without history gets zeros.

    The list keeps its rows, spelling and other columns, duplicates included.
    ``fits`` says that the list passed the size check for a broadcast; no
    address of it can be frequent then.
    """
    requested = addresses.withColumn("requested", F.col("address")).withColumn(
        "address", F.lower("address")
    )
    if fits:
        joined = requested.join(features, "address", "left")
    else:
        joined = join_on_key(requested, features, "address", how="left")
    kinds = dict(features.dtypes)
    own = [F.col("requested").alias("address") if c == "address" else F.col(c) for c in addresses.columns]
    return joined.select(
        *own,
        *[
            F.coalesce(F.col(c), F.lit(0).cast(kinds[c])).alias(c) if c in COMPUTED_FEATURES else F.col(c)
            for c in features.columns
            if c != "address"
        ],
    )
