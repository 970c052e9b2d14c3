"""Display rules for a finished analysis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txrisk.functions.scalars import Col, _c


def risk_band(probability: Col) -> Column:
    """Band of a probability; the upper border belongs to the band.

    Fixed values: borders 30, 60 and 80 percent.
    """
    percent = _c(probability) * 100
    return (
        F.when(percent <= 30, F.lit("low"))
        .when(percent <= 60, F.lit("medium"))
        .when(percent <= 80, F.lit("high"))
        .otherwise(F.lit("very_high"))
    )


def percent_label(probability: Col) -> Column:
    """Whole percent, cut and not rounded."""
    return F.concat((_c(probability) * 100).cast("bigint").cast("string"), F.lit("%"))


def short_address(address: Col) -> Column:
    """``0x1234...abcd``."""
    a = _c(address)
    return F.concat(F.substring(a, 1, 6), F.lit("..."), F.right(a, F.lit(4)))


def status_class(prediction: Col) -> Column:
    """Display class of a verdict, whatever its case."""
    p = F.lower(_c(prediction))
    return F.when(p.isin("normal", "fraud"), p).otherwise(F.lit("unknown"))


def upper_verdict(prediction: Col) -> Column:
    """Verdict as shown on the badge."""
    return F.upper(_c(prediction))


def visible_explanations(is_fraud: Col, explanations: Col) -> Column:
    """reasons are shown for fraud only, and only if there are any."""
    e = _c(explanations)
    return F.when(_c(is_fraud) & (F.size(e) > 0), e)
