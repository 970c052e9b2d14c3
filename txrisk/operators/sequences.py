"""Fixed-length transaction sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalars import beyond_decimal, ether, is_blank, readable, safe_int, wei
from txrisk.operators.skew import Hot, Split, split, top_k
from txrisk.schemas import SEQUENCE_FIELDS, SEQUENCE_LENGTH, SEQUENCE_WIDTH

_WHOLE_NUMBERS = (
    "time_stamp", "gas", "gas_used", "is_error", "block_number",
    "transaction_index", "confirmations",
)


def is_well_formed() -> Column:
    """F8: every number of the transaction is blank or parses."""
    # A gas price may exceed 64 bits; it still has to be a whole number.
    whole = F.col("gas_price").rlike(r"^\s*[+-]?[0-9]+\s*\z")
    amount = readable("value", "decimal(38,0)") | beyond_decimal("value").isNotNull()
    ok = (is_blank("gas_price") | whole) & amount
    for name in _WHOLE_NUMBERS:
        ok = ok & readable(name)
    return ok


def drop_malformed(tx: DataFrame) -> DataFrame:
    """F8 as a filter."""
    return tx.where(is_well_formed())


def sequence_values() -> dict[str, Column]:
    """The ten numbers of a transaction, in model order.

    Fixed values: the divisors and moduli are part of the model's input.
    """
    million = F.lit(1_000_000).cast("bigint")
    values = {
        "timestamp": F.pmod(safe_int("time_stamp"), million),
        "value": ether("value"),
        "gas": safe_int("gas") / 1e6,
        "gas_price": F.coalesce(beyond_decimal("gas_price"), wei("gas_price").cast("double")) / 1e9,
        "gas_used": safe_int("gas_used") / 1e6,
        "is_error": safe_int("is_error"),
        "tx_type": F.lit(0.0),
        "block_number": F.pmod(safe_int("block_number"), million),
        "transaction_index": safe_int("transaction_index"),
        "confirmations": safe_int("confirmations") / 100,
    }
    return {name: values[name].cast("double") for name in SEQUENCE_FIELDS}


def latest_sequence(
    history: DataFrame | Split, n: int = SEQUENCE_LENGTH, hot: DataFrame | Hot | None = None
) -> DataFrame:
    """The newest ``n`` well-formed transactions, one row per step.

    Equal time stamps keep the order of the list (``pos``).
    """
    order = [safe_int("time_stamp").desc(), F.col("pos").asc()]
    # Hubs are counted before the filter: that reads the address columns alone.
    parts = history if isinstance(history, Split) else split(history, "address", hot)
    kept = top_k(parts.each(drop_malformed), "address", order, n)
    return kept.select(
        "address",
        (F.col("rank") - 1).alias("step"),
        *[c.alias(name) for name, c in sequence_values().items()],
    )


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of the integer and floating-point columns (no decimals)."""
    kinds = (
        T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
    )
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def first_n(
    incident: DataFrame,
    n: int = SEQUENCE_LENGTH,
    row_id: str = "pos",
    hot: DataFrame | Hot | None = None,
) -> DataFrame:
    """The first ``n`` transactions in file order, numeric columns only.

    The row number of the file only orders the rows; it is no feature.
    """
    values = [c for c in numeric_columns(incident) if c != row_id]
    narrow = incident.select("address", row_id, *values)
    kept = top_k(narrow, "address", [F.col(row_id).asc()], n, row_id=row_id, hot=hot)
    return kept.select("address", (F.col("rank") - 1).alias("step"), *values)


def zero_row(width: int = SEQUENCE_WIDTH) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def pad_matrix(matrix: Column, length: int, width: int = SEQUENCE_WIDTH) -> Column:
    """Zero rows up to ``length``; a null matrix becomes all zeros."""
    rows = F.coalesce(matrix, F.array().cast("array<array<double>>"))
    missing = F.greatest(F.lit(length) - F.size(rows), F.lit(0))
    return F.concat(rows, F.array_repeat(zero_row(width), missing))


def to_matrix(steps: DataFrame, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """The steps of an account as a zero-padded matrix, one row per account.

    At most ``length`` rows meet per account, because the steps were cut before.
    """
    values = [c for c in steps.columns if c not in ("address", "step")]
    row = F.struct("step", F.array(*[F.col(c).cast("double") for c in values]).alias("row"))
    gathered = steps.groupBy("address").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    matrix = F.transform("rows", lambda r: r["row"])
    return gathered.select("address", pad_matrix(matrix, length, len(values)).alias("sequence"))


def step_of_row() -> Column:
    """F8 + X7: the ten numbers of a transaction, null if it is malformed."""
    return F.when(is_well_formed(), F.array(*sequence_values().values()))


def channel_names(width: int = SEQUENCE_WIDTH) -> list[str]:
    """Names of the channels of a sequence; those of a bulk export have numbers."""
    if width == SEQUENCE_WIDTH:
        return list(SEQUENCE_FIELDS)
    return [f"channel_{i}" for i in range(width)]


def pool_names(width: int = SEQUENCE_WIDTH) -> list[str]:
    """Names of the pooled values, in the order of ``pool``."""
    return [f"{kind}_{f}" for kind in ("mean", "max", "first", "std") for f in channel_names(width)]


def pooled_steps(step: Column, length: int, width: int = SEQUENCE_WIDTH) -> Column:
    """``pool`` as an aggregate over the rows of an account, of which ``step`` is null for
    all but the newest ``length`` well-formed ones.

    ``place`` numbers these from 1.  No list is gathered: sum, maximum, squared distance
    from the mean and the value of the newest row are merged like any aggregate, and
    the zeros of the padding are put in by arithmetic.
    """
    n = F.count(step)
    absent = F.lit(length) - n
    means, tops, firsts, stds = [], [], [], []
    for i in range(width):
        value = step[i]
        total = F.coalesce(F.sum(value), F.lit(0.0))
        own = total / F.greatest(n, F.lit(1))
        top = F.coalesce(F.max(value), F.lit(0.0))
        apart = F.coalesce(F.var_pop(value), F.lit(0.0)) * n + own * own * n * absent / length
        means.append(total / length)
        tops.append(F.when(absent > 0, F.greatest(top, F.lit(0.0))).otherwise(top))
        firsts.append(F.coalesce(F.max(F.when(F.col("place") == 1, value)), F.lit(0.0)))
        stds.append(F.sqrt(apart / length))
    return F.array(*means, *tops, *firsts, *stds)


def pool(matrix: Column, width: int = SEQUENCE_WIDTH) -> Column:
    """Mean, maximum, first value and standard deviation of every channel.

    Taken over the padded matrix, so an account without history gets zeros.
    """
    n = F.size(matrix)

    def total(f: Callable[[Column], Column]) -> Column:
        return F.aggregate(matrix, F.lit(0.0), lambda a, row: a + f(row))

    means, tops, firsts, stds = [], [], [], []
    for i in range(width):
        first = matrix[0][i]
        mean = total(lambda row: row[i]) / n
        # Squares are taken from the first value: raw ones would cancel out.
        square = total(lambda row: (row[i] - first) * (row[i] - first)) / n
        away = mean - first
        means.append(mean)
        tops.append(F.aggregate(matrix, first, lambda a, row: F.greatest(a, row[i])))
        firsts.append(first)
        stds.append(F.sqrt(F.greatest(square - away * away, F.lit(0.0))))
    return F.array(*means, *tops, *firsts, *stds)
