"""Which accounts a transaction belongs to.

"From or to or source equals the account" is a disjunction, and a join on a
disjunction runs as a nested loop.  Here every transaction is first expanded
into one row per distinct party, which turns the condition into an equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions.scalars import lower_address
from txrisk.operators.skew import (
    Hot,
    Split,
    fits_broadcast,
    hot_keys,
    join_on_key,
    join_split,
    split,
)

TRAINING_ROLES = ("from_address", "to_address", "source_address")


def distinct_addresses(addresses: DataFrame, column: str = "address") -> DataFrame:
    """U4: every account once."""
    return addresses.select(column).where(F.col(column).isNotNull()).distinct()


def _lookup(addresses: DataFrame) -> DataFrame:
    """A list as the small side of a join: unique keys spread evenly, so hashing
    a partition of them is cheap, and the transactions need no sort."""
    return distinct_addresses(addresses).hint("shuffle_hash")


def parties(tx: DataFrame, roles: tuple[str, ...] = TRAINING_ROLES) -> DataFrame:
    """One row per transaction and distinct party, exact spelling of addresses.

    A party that appears in two roles of a transaction appears once.
    """
    columns = [c for c in roles if c in tx.columns]
    first_seen = []
    for i, role in enumerate(columns):
        seen = F.lit(False)
        for earlier in columns[:i]:
            seen = seen | F.col(role).eqNullSafe(F.col(earlier))
        first_seen.append(F.when(~seen, F.col(role)))
    # The blank party of a contract creation is no account, but it can be the
    # most frequent value of the column, so it goes before any join.
    return tx.withColumn("address", F.explode(F.array(*first_seen))).where(F.col("address") != "")


def incidence(
    tx: DataFrame,
    addresses: DataFrame,
    roles: tuple[str, ...] = TRAINING_ROLES,
    hot: DataFrame | Hot | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """The transactions of every listed account, one row per pair.

    ``fits`` tells whether the list is short enough to be broadcast; without it
    the list is counted.  The same holds for the functions below.
    """
    fits = fits_broadcast(addresses) if fits is None else fits
    return join_on_key(parties(tx, roles), _lookup(addresses), "address", hot, fits)


def touching(
    tx: DataFrame,
    addresses: DataFrame,
    roles: tuple[str, ...] = TRAINING_ROLES,
    row_id: str = "pos",
    fits: bool | None = None,
) -> DataFrame:
    """the transactions with at least one listed party, each once.

    A party matches exactly, so a blank in the list matches the missing party of a
    contract creation.  With a short list nothing is shuffled: every role is
    looked up in the broadcast list.  With a long list only row numbers and addresses travel
    to find the matches, then the rows are fetched by row number, which is
    unique and so evenly spread.
    """
    listed = distinct_addresses(addresses)
    columns = [c for c in roles if c in tx.columns]
    if fits_broadcast(addresses) if fits is None else fits:
        out = tx
        for role in columns:
            lookup = F.broadcast(listed.select(F.col("address").alias(f"_{role}")))
            out = out.join(lookup, out[role] == lookup[f"_{role}"], "left")
        matched = F.coalesce(*[F.col(f"_{role}") for role in columns]).isNotNull()
        return out.where(matched).select(*tx.columns)
    if row_id not in tx.columns:
        raise ValueError(f"a long list needs a column that numbers the rows, {row_id!r}")
    pairs = parties(tx.select(row_id, *columns), roles).select(row_id, "address")
    rows = join_on_key(pairs, _lookup(addresses), "address").select(row_id)
    # The blank party may be in very many rows; they need no join.
    if not listed.where(F.col("address") == "").isEmpty():
        blank = F.lit(False)
        for role in columns:
            blank = blank | F.coalesce(F.col(role) == "", F.lit(False))
        rows = rows.unionByName(tx.where(blank).select(row_id))
    return tx.join(rows.distinct(), row_id, "left_semi").select(*tx.columns)


def account_rows(tx: DataFrame) -> DataFrame:
    """one row per transaction and party with lower-case keys and role flags.

    ``sent`` and ``received`` are both true for a transfer to oneself, and the
    transaction still is one row.  A missing party counts as the empty
    address, which is no account.
    """

    def party(column: str, sent: bool, received: bool) -> Column:
        return F.struct(
            F.col(column).alias("address"),
            F.lit(sent).alias("sent"),
            F.lit(received).alias("received"),
        )

    to_self = F.col("from_address") == F.col("to_address")
    return (
        tx.withColumn("from_address", lower_address("from_address"))
        .withColumn("to_address", lower_address("to_address"))
        .select(
            "*",
            F.inline(
                F.when(to_self, F.array(party("from_address", True, True))).otherwise(
                    F.array(party("from_address", True, False), party("to_address", False, True))
                )
            ),
        )
        .where(F.col("address") != "")
    )


def with_roles(history: DataFrame) -> DataFrame:
    """F3 for rows that already belong to an account (``address``)."""
    key = F.lower("address")
    return (
        history.withColumn("sent", lower_address("from_address") == key)
        .withColumn("received", lower_address("to_address") == key)
    )


def hot_accounts(tx: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Hub accounts of a transaction table, for reuse in several operators."""
    rows = account_rows(tx.select("from_address", "to_address"))
    return hot_keys(rows, "address", hot_rows) if hot_rows else hot_keys(rows, "address")


def history_split(
    addresses: DataFrame | None,
    tx: DataFrame,
    hot: DataFrame | Hot | None = None,
    fits: bool | None = None,
) -> Split:
    """J3 with the rows of hub accounts kept apart, for the rankings that follow.

    A short list is looked up first, so hubs are counted among its rows only.
    With a long list, or none, they are counted once over the address columns.
    """
    rows = account_rows(tx)
    if addresses is None:
        parts = split(rows, "address", hot_accounts(tx) if hot is None else hot)
        # Ordinary accounts seldom fill a ranking within one input split, so
        # their rows are not sorted before the shuffle as well as after it.
        return Split(parts.cold.repartition("address"), parts.hot)
    keys = addresses.select(F.lower("address").alias("address"))
    if fits_broadcast(addresses) if fits is None else fits:
        return split(rows.join(F.broadcast(distinct_addresses(keys)), "address"), "address", hot)
    return join_split(rows, _lookup(keys), "address", hot_accounts(tx) if hot is None else hot)


def history_for(
    addresses: DataFrame | None,
    tx: DataFrame,
    hot: DataFrame | Hot | None = None,
    fits: bool | None = None,
) -> DataFrame:
    """The history of every listed account, or of all accounts.

    Keys compare in lower case.
    """
    rows = account_rows(tx)
    if addresses is None:
        return rows
    keys = addresses.select(F.lower("address").alias("address"))
    fits = fits_broadcast(addresses) if fits is None else fits
    return join_on_key(rows, _lookup(keys), "address", hot, fits)
