"""Scalar functions and predicates over raw transaction columns.

Outside data arrives as text, and ANSI mode makes plain casts of bad text
fail, so every cast of outside text is a ``try_cast``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WEI_PER_ETHER = 1e18

Col = Column | str


def _c(column: Col) -> Column:
    return F.col(column) if isinstance(column, str) else column


def is_blank(column: Col) -> Column:
    """A missing number: null or the empty string."""
    c = _c(column)
    return c.isNull() | (c == "")


def wei(column: Col) -> Column:
    """Wei amount as ``decimal(38,0)``; blank or unreadable text is 0.

    Amounts stay decimal until after the sum, so a total does not depend on
    the order in which partitions are added up.  An amount of more than 38
    digits is 0 here and not in ``beyond_decimal``.
    """
    return F.coalesce(_c(column).try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))


def beyond_decimal(column: Col) -> Column:
    """Amount that only a double can hold (39 digits and more), else null."""
    c = _c(column)
    value = c.try_cast("double")
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(c.try_cast("decimal(38,0)").isNull() & finite, value)


def exact_sums(amount: Column) -> tuple[Column, Column]:
    """Two aggregates of a ``decimal(38,0)`` that cannot overflow: the sum of the
    multiples of ``10 ** 20`` and the sum of the rest."""
    unit = F.lit("1" + "0" * 20).cast("decimal(21,0)")
    high = F.call_function("div", amount, unit).cast("decimal(19,0)")
    return F.sum(high), F.sum((amount % unit).cast("decimal(20,0)"))


def sum_to_ether(high: Col, low: Col, beyond: Col) -> Column:
    """Ether of two exact sums and the double sum of larger amounts."""
    unit = F.lit("1" + "0" * 20).cast("decimal(21,0)")
    whole = F.try_add(F.try_multiply(_c(high).cast("decimal(38,0)"), unit), _c(low))
    # A total above 38 digits has no exact form.
    rough = _c(high).cast("double") * F.lit(1e20) + _c(low).cast("double")
    total = F.coalesce(whole.cast("double"), rough) / F.lit(WEI_PER_ETHER)
    return total + F.coalesce(_c(beyond), F.lit(0.0)) / F.lit(WEI_PER_ETHER)


def to_ether(wei_amount: Col) -> Column:
    """Wei (any numeric type) to ether as double."""
    return _c(wei_amount).cast("double") / F.lit(WEI_PER_ETHER)


def ether(column: Col) -> Column:
    """Ether value of a wei text column, of any number of digits."""
    return F.coalesce(beyond_decimal(column) / F.lit(WEI_PER_ETHER), to_ether(wei(column)))


def safe_int(column: Col) -> Column:
    """Whole number; blank or unreadable text is 0."""
    return F.coalesce(_c(column).try_cast("bigint"), F.lit(0).cast("bigint"))


def hex_nonzero(column: Col) -> Column:
    """Does this hex text hold a value other than zero?

    A pattern test instead of a number: call data is far longer than 64 bits.
    """
    pattern = r"^(0[xX])?[0-9a-fA-F]*[1-9a-fA-F][0-9a-fA-F]*\z"
    return F.coalesce(_c(column).rlike(pattern), F.lit(False))


def lower_address(column: Col) -> Column:
    """Address key; a null party counts as the empty address."""
    return F.coalesce(F.lower(_c(column)), F.lit(""))


def date_int(column: Col) -> Column:
    """``'2024-01-31 10:00:00.123'`` -> ``20240131``.

    Unreadable text raises, as a strict parse should.  The zone-less
    timestamp type keeps the result independent of the session time zone.
    """
    ts = F.to_timestamp_ntz(_c(column), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return (F.year(ts) * 10000 + F.month(ts) * 100 + F.dayofmonth(ts)).cast("bigint")


def to_double_or_zero(column: Col) -> Column:
    """Lenient cast of a text column in a numeric feature list."""
    return F.coalesce(_c(column).try_cast("double"), F.lit(0.0))


def valid_ts(column: Col) -> Column:
    """epoch seconds above zero, else null."""
    return F.when(_c(column) > 0, _c(column))


def is_created_contract(sent: Col, to_address: Col) -> Column:
    """sent to nobody, that is a contract creation."""
    return _c(sent) & (F.coalesce(_c(to_address), F.lit("")) == "")


def is_contract_call(sent: Col, to_address: Col, has_data: Col) -> Column:
    """sent to somebody with call data that is not zero (``hex_nonzero``)."""
    return _c(sent) & (F.coalesce(_c(to_address), F.lit("")) != "") & _c(has_data)


def readable(column: Col, as_type: str = "bigint") -> Column:
    """F8: blank is fine, anything else has to parse."""
    c = _c(column)
    return is_blank(c) | c.try_cast(as_type).isNotNull()


def address_check(column: Col) -> Column:
    """``'ok'``, ``'empty'`` or ``'invalid'`` for a requested address.

    ``\\z`` and not ``$``, which would let a trailing newline through.
    """
    c = _c(column)
    return (
        F.when(c.isNull() | c.rlike(r"^\s*\z"), F.lit("empty"))
        .when(c.rlike(r"^0x[a-fA-F0-9]{40}\z"), F.lit("ok"))
        .otherwise(F.lit("invalid"))
    )


def is_valid_address(column: Col) -> Column:
    """F9 as a predicate."""
    return address_check(column) == "ok"


def run_stamp() -> Column:
    """Time stamp used in result folder names."""
    return F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")
