"""Joins and rankings that stay balanced when one key holds much of the data.

A ledger has hub accounts: an exchange or a token contract can be a party to a
third of all transactions.  A plain join or window on the address would send
that third to one task.  Here such keys are found first, by a count with
map-side combine over the key column alone, and then take a path of their own:

* joins: the few hot keys are broadcast, so their rows are never shuffled;
* rankings: a hot key is cut into pieces by a hash, every piece is ranked in
  its own task, and only the best ``k`` of each piece meet in the final rank.

Which keys count as hot changes the plan, never the result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.sources.checkpoints import kept_rows

# A key with more rows than this is hot ...
HOT_ROWS = 1_000_000
# ... or than one in so many rows, if that is more: there are never more hot keys
# than this, which bounds what is broadcast.
HOT_SHARE = 200_000
# Largest list of keys that is broadcast (a key is a short text: below 20 MB).
# It is below HOT_ROWS, so a list that fits has no hot keys of its own.
BROADCAST_KEYS = 200_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``(key, pieces)`` for the heaviest keys of ``df``; at most ``HOT_SHARE`` rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    # The same 0 in every row, but no literal, which would make a nested loop of the join.
    counts = counts.withColumn("all", F.pmod(F.xxhash64(key), F.lit(1)))
    # One row: all rows of the table.
    total = counts.groupBy("all").agg(F.sum("rows").alias("total"))
    limit = F.greatest(F.lit(hot_rows).cast("double"), F.col("total") / HOT_SHARE)
    return (
        counts.join(F.broadcast(total), "all")
        .filter(F.col("rows") > limit)
        .select(key, F.ceil(F.col("rows") / limit).cast("int").alias("pieces"))
    )


def fits_broadcast(keys: DataFrame, max_rows: int = BROADCAST_KEYS) -> bool:
    """Size check before a broadcast; a longer list is not counted to its end."""
    return keys.limit(max_rows + 1).count() <= max_rows


@dataclass(frozen=True)
class Hot:
    """Hot keys that are known: a small table in the shared folder, or that there are none."""

    keys: DataFrame | None


def settled(hot: DataFrame | Hot) -> Hot:
    """Counts the hot keys once.  Without any, plans have one path and read their rows once."""
    if isinstance(hot, Hot):
        return hot
    keys = kept_rows(hot, "hot")
    return Hot(None if keys.isEmpty() else keys)


def _hot_of(df: DataFrame, key: str, hot: DataFrame | Hot | None) -> Hot:
    return settled(hot_keys(df, key) if hot is None else hot)


@dataclass(frozen=True)
class Split:
    """Rows of ordinary keys, and rows of hot keys with ``pieces`` if there are such keys."""

    cold: DataFrame
    hot: DataFrame | None

    def union(self) -> DataFrame:
        return self.cold if self.hot is None else self.cold.unionByName(self.hot.drop("pieces"))

    def each(self, change: Callable[[DataFrame], DataFrame]) -> Split:
        return Split(change(self.cold), None if self.hot is None else change(self.hot))


def split(df: DataFrame, key: str, hot: DataFrame | Hot | None = None) -> Split:
    """Takes the rows of hot keys apart from the rest."""
    known = _hot_of(df, key, hot).keys
    if known is None:
        return Split(df, None)
    return Split(
        df.join(F.broadcast(known.select(key)), key, "left_anti"), df.join(F.broadcast(known), key)
    )


def join_split(
    big: DataFrame,
    small: DataFrame,
    key: str,
    hot: DataFrame | Hot | None = None,
    how: str = "inner",
) -> Split:
    """Inner or left join on ``key``, which is unique in ``small``.

    The rows of hot keys meet a broadcast of the partners of those keys, at most
    ``HOT_SHARE`` rows; the rest is shuffled on the key.  A ``small`` side of keys alone
    may carry a ``shuffle_hash`` hint, which saves sorting the big side.
    """
    known = _hot_of(big, key, hot)
    parts = split(big, key, known)
    cold = parts.cold.join(small, key, how)
    if parts.hot is None:
        return Split(cold, None)
    partners = small.join(F.broadcast(known.keys.select(key)), key, "left_semi")
    return Split(cold, parts.hot.join(F.broadcast(partners), key, how))


def join_on_key(
    big: DataFrame,
    small: DataFrame,
    key: str,
    hot: DataFrame | Hot | None = None,
    fits: bool = False,
    how: str = "inner",
) -> DataFrame:
    """``join_split`` as one table.

    ``fits`` says that ``small`` passed the size check; it is broadcast then.
    """
    if fits:
        return big.join(F.broadcast(small), key, how)
    return join_split(big, small, key, hot, how).union()


def top_k(
    rows: DataFrame | Split,
    key: str,
    order: list[Column],
    k: int,
    rank: str = "rank",
    row_id: str = "pos",
    hot: DataFrame | Hot | None = None,
    running: dict[str, Column] | None = None,
) -> DataFrame:
    """First ``k`` rows per ``key`` in the given order, numbered from 1 in ``rank``.

    ``order`` must be total within a key.  ``row_id`` spreads the rows of a
    hot key over its pieces.  ``running`` adds columns with the number of rows, up to
    each one and in the same order, for which a condition holds.  The ranking of the ordinary keys keeps their
    partitioning; without hot keys there is nothing else.
    """
    parts = rows if isinstance(rows, Split) else split(rows, key, hot)

    def first(df: DataFrame, *keys: str, counts: dict[str, Column] | None = None) -> DataFrame:
        ranked = Window.partitionBy(*keys).orderBy(*order)
        upto = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counted = {name: F.count_if(c).over(upto) for name, c in (counts or {}).items()}
        return df.withColumns({rank: F.row_number().over(ranked), **counted}).filter(F.col(rank) <= k)

    cold = first(parts.cold.drop(rank), key, counts=running)
    if parts.hot is None:
        return cold
    piece = F.pmod(F.xxhash64(row_id), F.col("pieces"))
    best_of_pieces = first(parts.hot.drop(rank).withColumn("piece", piece), key, "piece")
    survivors = best_of_pieces.drop("piece", "pieces", rank)
    return cold.unionByName(first(survivors, key, counts=running))
