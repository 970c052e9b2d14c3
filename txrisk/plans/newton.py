"""Logistic weights in closed steps (M2).

A step of Newton's method solves one small system of sums over all rows, so the weights
after a fixed number of steps are a plain function of the table: no seed, no order of
rows, no stopping rule.  They check what an iterative learner found, and serve
where a model must be the same on every cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.sources.checkpoints import kept_rows


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """Gauss elimination with the largest pivot; a direction without data stays 0."""
    n = len(right)
    rows = [[*line, right[i]] for i, line in enumerate(matrix)]
    free = set()
    for i in range(n):
        pivot = max(range(i, n), key=lambda r: abs(rows[r][i]))
        if abs(rows[pivot][i]) < 1e-12:
            free.add(i)
            continue
        rows[i], rows[pivot] = rows[pivot], rows[i]
        for r in range(i + 1, n):
            share = rows[r][i] / rows[i][i]
            rows[r] = [a - share * b for a, b in zip(rows[r], rows[i])]
    out = [0.0] * n
    for i in reversed(range(n)):
        if i not in free:
            out[i] = (rows[i][n] - sum(rows[i][j] * out[j] for j in range(i + 1, n))) / rows[i][i]
    return out


def newton_weights(
    df: DataFrame, columns: list[str], label: str = "flag", steps: int = 8
) -> list[float]:
    """The intercept and one weight per column after ``steps`` steps from 0.

    One aggregate over the rows a step: with ``n`` columns some ``n * n / 2`` sums reach the
    driver.  Rows without a label or a number are left out.
    """
    x = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in columns]]
    y = F.col(label).cast("double")
    whole = y.isNotNull()
    for c in x[1:]:
        whole = whole & c.isNotNull() & ~F.isnan(c)
    named = [f"x{i}" for i in range(len(x))]
    rows = df.where(whole).select(y.alias("y"), *[c.alias(n) for c, n in zip(x, named)])
    rows = kept_rows(rows, "newton")
    n = len(x)
    weights = [0.0] * n
    for _ in range(steps):
        z = F.lit(0.0)
        for w, c in zip(weights, named):
            z = z + F.lit(w) * F.col(c)
        p = 1 / (1 + F.exp(-z))
        sums = [F.sum((F.col("y") - p) * F.col(named[i])) for i in range(n)]
        sums += [F.sum(p * (1 - p) * F.col(named[i]) * F.col(named[j])) for i in range(n) for j in range(i, n)]
        found = [v or 0.0 for v in rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()]
        matrix = [[0.0] * n for _ in range(n)]
        at = n
        for i in range(n):
            for j in range(i, n):
                matrix[i][j] = matrix[j][i] = found[at]
                at += 1
        weights = [w + d for w, d in zip(weights, _solved(matrix, found[:n]))]
    return weights


def weights_table(spark: SparkSession, columns: list[str], **weights: list[float]) -> DataFrame:
    """``position, name`` and a column for each given list of weights."""
    rows = [
        (i, name, *[float(w[i]) for w in weights.values()])
        for i, name in enumerate(["intercept", *columns])
    ]
    kinds = ", ".join(f"{n} double" for n in weights)
    return spark.createDataFrame(rows, f"position int, name string, {kinds}")
