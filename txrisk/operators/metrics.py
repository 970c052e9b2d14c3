"""Quality of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.functions.scores import bce_with_logits


def accuracy(df: DataFrame, prediction: str = "predicted", label: str = "flag") -> DataFrame:
    """Share of rows whose prediction is the label."""
    return df.agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def row_loss(z0: str = "z0", z1: str = "z1", label: str = "flag") -> Column:
    """Binary cross-entropy of one row, the mean over its two one-hot outputs."""
    y = F.col(label).cast("double")
    return (bce_with_logits(z0, F.lit(1.0) - y) + bce_with_logits(z1, y)) / 2


def bce_loss(df: DataFrame, z0: str = "z0", z1: str = "z1", label: str = "flag") -> DataFrame:
    """Mean binary cross-entropy over the two one-hot outputs of all rows."""
    return df.agg(F.avg(row_loss(z0, z1, label)).alias("loss"))


def confusion_matrix(
    df: DataFrame, prediction: str = "predicted", label: str = "flag"
) -> DataFrame:
    """All four cells of actual against predicted, empty ones as 0.

    One pass with four counters, turned into four rows at the end.
    """
    cells = [(a, p) for a in (0, 1) for p in (0, 1)]
    counted = df.agg(
        *[
            F.count_if((F.col(label) == a) & (F.col(prediction) == p)).alias(f"n{a}{p}")
            for a, p in cells
        ]
    )
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("actual"),
                        F.lit(p).alias("predicted"),
                        F.col(f"n{a}{p}").alias("records"),
                    )
                    for a, p in cells
                ]
            )
        )
    )
