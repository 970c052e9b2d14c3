"""Functions over model outputs: logits, probabilities, verdicts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txrisk.functions.scalars import Col, _c


def softmax2(z0: Col, z1: Col) -> tuple[Column, Column]:
    """Two logits to two probabilities, without overflow."""
    a, b = _c(z0), _c(z1)
    top = F.greatest(a, b)
    ea, eb = F.exp(a - top), F.exp(b - top)
    return ea / (ea + eb), eb / (ea + eb)


def argmax(values: Col) -> Column:
    """Position of the largest element; the first one wins a tie."""
    v = _c(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def verdict(predicted_class: Col) -> Column:
    """X11: class 1 is ``Fraud``, everything else ``Normal``."""
    return F.when(_c(predicted_class) == 1, F.lit("Fraud")).otherwise(F.lit("Normal"))


def confidence(p0: Col, p1: Col) -> Column:
    """The larger of both probabilities."""
    return F.greatest(_c(p0), _c(p1))


def one_hot(label: Col) -> Column:
    """0/1 label to a two-element array."""
    c = _c(label).cast("double")
    return F.array(F.lit(1.0) - c, c)


def bce_with_logits(z: Col, y: Col) -> Column:
    """A17, one output: binary cross-entropy of a logit, stable at both ends."""
    zz, yy = _c(z), _c(y)
    return F.greatest(zz, F.lit(0.0)) - zz * yy + F.log1p(F.exp(-F.abs(zz)))
