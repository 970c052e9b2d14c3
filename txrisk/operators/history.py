"""Newest rows, pages and gaps of account histories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.functions.scalars import safe_int
from txrisk.operators.skew import Hot, Split, fits_broadcast, split, top_k
from txrisk.sources.checkpoints import kept_rows


def newest_first() -> list[Column]:
    """Order of an explorer response sorted ``desc``, made total by hash and row."""
    return [
        safe_int("time_stamp").desc(),
        safe_int("block_number").desc(),
        safe_int("transaction_index").desc(),
        F.col("hash").asc(),
        F.col("pos").asc(),
    ]


def oldest_first() -> list[Column]:
    """Order of an explorer response sorted ``asc``."""
    return [
        safe_int("time_stamp").asc(),
        safe_int("block_number").asc(),
        safe_int("transaction_index").asc(),
        F.col("hash").asc(),
        F.col("pos").asc(),
    ]


def recent(
    history: DataFrame | Split,
    k: int | None = 100,
    hot: DataFrame | Hot | None = None,
    running: dict[str, Column] | None = None,
) -> DataFrame:
    """The newest ``k`` transactions of every account, position in ``rank``.

    ``running``: further counts along the same order (``top_k``).

    ``k=None`` keeps the whole history and adds no ``rank``, for that would
    mean to sort a hub account in one task.
    """
    if k is None:
        return history.union() if isinstance(history, Split) else history
    return top_k(history, "address", newest_first(), k, hot=hot, running=running)


def page(
    history: DataFrame | Split,
    start_block: int = 0,
    end_block: int | None = None,
    page: int = 1,
    offset: int = 10_000,
    sort: str = "desc",
    hot: DataFrame | Hot | None = None,
    most: int | None = None,
) -> DataFrame:
    """Page ``page`` of ``offset`` rows of every account in a block range.

    Without ``end_block`` the range has no end.  However deep the page of a hub account
    is, only its own rows are ranked (``rows_between``); ``most`` is the size of the
    slices that they are looked for in, a page by default.
    """
    if sort not in ("asc", "desc"):
        raise ValueError(f"sort must be 'asc' or 'desc', not {sort!r}")
    order = newest_first() if sort == "desc" else oldest_first()
    parts = history if isinstance(history, Split) else split(history, "address", hot)
    in_range = safe_int("block_number") >= start_block
    if end_block is not None:
        in_range = in_range & (safe_int("block_number") <= end_block)
    kept = parts.each(lambda rows: rows.where(in_range))
    low, high = (page - 1) * offset + 1, page * offset
    ranked = Window.partitionBy("address").orderBy(*order)
    cold = kept.cold.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank").between(low, high))
    if kept.hot is None:
        return cold
    return cold.unionByName(
        rows_between(kept.hot.drop("pieces"), low, high, sort == "desc", most or offset)
    )


def _levels(descending: bool) -> list[Column]:
    """Ever finer slices of the order of a history, as numbers and texts that sort alike.

    The hash decides last, upwards in both directions, and its slices are prefixes.
    """
    ts, hashed = safe_int("time_stamp"), F.col("hash")
    sign = F.lit(-1 if descending else 1)
    return [
        sign * F.floor(ts / 86_400),
        sign * F.floor(ts / 3_600),
        sign * ts,
        sign * safe_int("block_number"),
        sign * safe_int("transaction_index"),
        *[F.substring(hashed, 1, n) for n in (4, 8, 16)],
    ]


def rows_between(rows: DataFrame, low: int, high: int, descending: bool, most: int) -> DataFrame:
    """The rows of ranks ``low`` to ``high`` of every account, in ``rank``.

    An order-statistics table per account finds them: rows are counted per slice of the
    order, and a running total over these counts tells which slices hold wanted ranks.
    Slices of up to ``most`` rows are ranked by themselves, from the total before them on; only the
    rows of larger ones go on, to be counted in finer slices.  There are two of these an account at most
    where ``most`` is a page, so their rows are written to the shared folder, as tables of counts are,
    and however many levels there are, ``rows`` is read three times.
    """
    order = newest_first() if descending else oldest_first()
    columns = rows.columns
    # Slices so far, as one text per row, and the rows of the account before the slice.
    now = rows.withColumn("_slice", F.lit("")).withColumn("_before", F.lit(0).cast("bigint"))

    def within(held: DataFrame, value: Column) -> DataFrame:
        inside = held.select(
            F.col("address").alias("_address"), F.col("_slice").alias("_of"), "_held", "_first", "_next"
        )
        inside = F.broadcast(inside) if fits_broadcast(inside) else inside
        return (
            now.withColumn("_value", value)
            .join(inside, (F.col("address") == F.col("_address")) & (F.col("_slice") == F.col("_of"))
                  & F.col("_value").eqNullSafe(F.col("_held")))
            .select(*columns, F.col("_next").alias("_slice"), F.col("_first").alias("_before"))
        )

    found = []
    levels = _levels(descending)
    for value in levels:
        counts = now.withColumn("_value", value).groupBy("address", "_slice", "_before", "_value").agg(
            F.count(F.lit(1)).alias("_rows")
        )
        running = Window.partitionBy("address", "_slice").orderBy("_value")
        first = F.col("_before") + F.sum("_rows").over(running) - F.col("_rows")
        held = counts.withColumn("_first", first).where(
            (F.col("_first") < high) & (F.col("_first") + F.col("_rows") >= low)
        )
        held = kept_rows(
            held.select(
                "address", "_slice", F.col("_value").alias("_held"), "_first", "_rows",
                # Slices of one level and account are told apart by their number.
                F.concat_ws("/", "_slice", F.col("_first").cast("string")).alias("_next"),
            ),
            "page",
        )
        large = held.where(F.col("_rows") > most)
        if value is levels[-1] or large.isEmpty():
            found.append(within(held, value))
            break
        found.append(within(held.where(F.col("_rows") <= most), value))
        now = kept_rows(within(large, value), "sliced")
    ranked = Window.partitionBy("address", "_slice").orderBy(*order)
    out = reduce(DataFrame.unionByName, found)
    out = out.withColumn("rank", (F.col("_before") + F.row_number().over(ranked)).cast("int"))
    return out.where(F.col("rank").between(low, high)).select(*columns, "rank")


def tx_gaps(
    history: DataFrame | Split, slice_seconds: int = 3_600, hot: DataFrame | Hot | None = None
) -> DataFrame:
    """Minutes between consecutive transactions of an account, per role.

    Rows without a valid time stamp are left out; the first row of an account
    has a null gap.  The history of a hub account is cut into time slices, so
    that it is ordered in many tasks.
    """
    parts = history if isinstance(history, Split) else split(history, "address", hot)
    by_role = Window.partitionBy("address", "role").orderBy("ts", "pos")
    both = _timed_roles(parts.cold).withColumn("previous", F.lag("ts").over(by_role))
    if parts.hot is not None:
        both = both.unionByName(_previous_by_slice(_timed_roles(parts.hot), slice_seconds))
    gap = (F.col("ts") - F.col("previous")) / 60
    return both.select("address", "role", "pos", "ts", gap.alias("gap_mins"))


def _timed_roles(history: DataFrame) -> DataFrame:
    """One row per account, role and transaction with a valid time stamp."""
    ts = safe_int("time_stamp")
    role = (
        F.when(F.col("sent") & F.col("received"), F.array(F.lit("sent"), F.lit("received")))
        .when(F.col("sent"), F.array(F.lit("sent")))
        .when(F.col("received"), F.array(F.lit("received")))
    )
    return history.where(ts > 0).select(
        "address", F.explode(role).alias("role"), "pos", ts.alias("ts")
    )


def _previous_by_slice(rows: DataFrame, slice_seconds: int) -> DataFrame:
    """Time stamp before each row: ``lag`` inside a slice, and for the first row
    of a slice the last time stamp of the account's slice before."""
    sliced = rows.withColumn("slice", F.floor(F.col("ts") / slice_seconds))
    inside = Window.partitionBy("address", "role", "slice").orderBy("ts", "pos")
    across = Window.partitionBy("address", "role").orderBy("slice")
    before = (
        sliced.groupBy("address", "role", "slice")
        .agg(F.max("ts").alias("last_ts"))
        .withColumn("before", F.lag("last_ts").over(across))
        .drop("last_ts")
    )
    return (
        sliced.withColumn("previous", F.lag("ts").over(inside))
        .join(before, ["address", "role", "slice"])
        .withColumn("previous", F.coalesce("previous", "before"))
        .drop("slice", "before")
    )


def batch_index(addresses: DataFrame) -> DataFrame:
    """0-based position of every address in the request list.

    A list that brings ``batch_index`` keeps it.  Otherwise rows are numbered
    in the order of their partitions: one count per partition, whose running
    total is the first number of the next one.  Other columns stay.
    """
    if "batch_index" in addresses.columns:
        return addresses.withColumn("batch_index", F.col("batch_index").cast("bigint"))
    placed = addresses.withColumn("_p", F.spark_partition_id()).withColumn(
        "_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    first = (
        placed.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
        .select("_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_first"))
    )
    # One row per partition of the list.
    return placed.join(F.broadcast(first), "_p").select(
        *addresses.columns, (F.col("_first") + F.col("_i")).alias("batch_index")
    )
