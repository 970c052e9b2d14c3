"""Building a training set: columns, imputing, scaling, sampling, splitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalars import to_double_or_zero
from txrisk.operators.skew import fits_broadcast, join_on_key
from txrisk.schemas import MAJORITY_SAMPLE, SEQUENCE_LENGTH, SEQUENCE_WIDTH
from txrisk.sources.checkpoints import kept_rows

# Percentile sketches are this exact (relative rank error 1 / ACCURACY).
ACCURACY = 10_000
# Slices of the bracket around a median.
SLICES = 1_000


# -- columns ----------------------------------------------------------------


def select_existing(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The listed columns that exist, in list order; names match exactly."""
    return df.select(*[f"`{c}`" for c in (*keep, *columns) if c in df.columns])


def drop_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop the listed columns that exist; names match exactly."""
    return df.select(*[f"`{c}`" for c in df.columns if c not in columns])


def filter_label(df: DataFrame, value: int, label: str = "flag") -> DataFrame:
    """rows of one class."""
    return df.where(F.col(label).isin(value))


def align_features(df: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the model's columns in model order, absent ones as 0.0."""
    return df.select(
        *keep,
        *[
            F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c)
            if c in df.columns
            else F.lit(0.0).alias(c)
            for c in columns
        ],
    )


# -- imputing (A14) -----------------------------------------------------------


def _number(column: str) -> Column:
    """Numeric column as double with NaN as null."""
    c = F.col(f"`{column}`").cast("double")
    return F.when(~F.isnan(c), c)


def medians(df: DataFrame, columns: list[str], exact: bool = True) -> dict[str, float]:
    """Median of every numeric column, nulls and NaN left out; 0 if all are.

    The exact median of a long column must not gather the column in one place.
    A percentile sketch brackets the median of every column; one more pass
    counts what lies below the bracket and groups the values inside it, which
    is a tiny share of the rows.  Repeated values are one group, however many
    rows hold them.  What reaches the driver is one number per column.
    """
    if not columns:
        return {}
    if not exact:
        picks = [F.percentile_approx(_number(c), 0.5, ACCURACY).alias(c) for c in columns]
        found = df.agg(*picks).first().asDict()
        return {c: float(found[c]) if found[c] is not None else 0.0 for c in columns}

    slack = 2 / ACCURACY
    sketch = df.agg(
        *[
            F.percentile_approx(_number(c), [0.5 - slack, 0.5 + slack], ACCURACY).alias(c)
            for c in columns
        ]
    ).first()
    brackets = {c: sketch[c] for c in columns if sketch[c] is not None}
    if not brackets:
        return dict.fromkeys(columns, 0.0)

    # One narrow row per column and value; values outside the bracket fall
    # together in one group per side.
    sides = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.when(_number(c) < lo, F.lit(-1)).when(_number(c) > hi, F.lit(1)).otherwise(0)
                .alias("side"),
                F.when(_number(c).between(lo, hi), _number(c)).alias("value"),
                _number(c).isNotNull().alias("known"),
            )
            for c, (lo, hi) in brackets.items()
        ]
    )
    groups = (
        df.select(F.explode(sides).alias("s"))
        .select("s.*")
        .where("known")
        .groupBy("feature", "side", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Running totals in two steps: over slices of the bracket, then inside the slice
    # that holds the median.  A slice is a thousandth of the bracket's width.
    width = F.create_map(
        *[F.lit(x) for c, (lo, hi) in brackets.items() for x in (c, (hi - lo) / SLICES or 1.0)]
    )
    lows = F.create_map(*[F.lit(x) for c, (lo, _) in brackets.items() for x in (c, float(lo))])
    cut = F.floor((F.col("value") - lows[F.col("feature")]) / width[F.col("feature")])
    sliced = groups.withColumn("slice", F.coalesce(cut, F.lit(0)))
    slices = sliced.groupBy("feature", "side", "slice").agg(F.sum("n").alias("slice_n"))
    upto = Window.partitionBy("feature").orderBy("side", "slice")
    totals = Window.partitionBy("feature")
    slices = slices.withColumn("slice_last", F.sum("slice_n").over(upto)).withColumn(
        "total", F.sum("slice_n").over(totals)
    )
    low = F.floor((F.col("total") + 1) / 2)
    high = F.floor((F.col("total") + 2) / 2)
    slice_first = F.col("slice_last") - F.col("slice_n") + 1
    holding = slices.where(
        low.between(slice_first, F.col("slice_last")) | high.between(slice_first, F.col("slice_last"))
    )
    within = Window.partitionBy("feature", "side", "slice").orderBy("value")
    # Two slices per column at most.
    ranked = (
        sliced.join(F.broadcast(holding), ["feature", "side", "slice"])
        .withColumn("last", F.col("slice_last") - F.col("slice_n") + F.sum("n").over(within))
        .withColumn("first", F.col("last") - F.col("n") + 1)
    )

    def at(position: Column) -> Column:
        return F.max(F.when(position.between(F.col("first"), F.col("last")), F.col("value")))

    rows = ranked.groupBy("feature").agg(at(low).alias("low"), at(high).alias("high")).collect()
    found = {r["feature"]: (r["low"] + r["high"]) / 2 for r in rows}
    return {c: found.get(c, 0.0) for c in columns}


def impute(
    df: DataFrame,
    columns: list[str],
    exact: bool = True,
    values: dict[str, float] | None = None,
) -> DataFrame:
    """Fill gaps of a feature table.

    Numeric columns get their median (0 if there is none); text columns are
    cast leniently and get 0.  ``values`` reuses medians found before.
    """
    numeric = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
    fill = medians(df, numeric, exact) if values is None else values
    out = []
    for c in df.columns:
        if c not in columns:
            out.append(F.col(f"`{c}`"))
        elif c in numeric:
            out.append(F.coalesce(_number(c), F.lit(fill[c])).alias(c))
        else:
            out.append(to_double_or_zero(F.col(f"`{c}`")).alias(c))
    return df.select(*out)


# -- scaling (A15, X13) -------------------------------------------------------


def population_std(value: Column) -> Column:
    """Population std; exactly 0 if all values are equal, where merged moments are
    a little off."""
    return F.when(F.min(value) == F.max(value), F.lit(0.0)).otherwise(F.stddev_pop(value))


def exact_mean(value: Column) -> Column:
    """Mean; the value itself if all are equal, so that it is scaled to 0."""
    return F.when(F.min(value) == F.max(value), F.min(value)).otherwise(F.avg(value))


def fit_scaler(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(position, feature, mean, std)``, the population std, in one pass."""
    stats = df.agg(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("feature"),
                exact_mean(F.col(f"`{c}`").cast("double")).alias("mean"),
                population_std(F.col(f"`{c}`").cast("double")).alias("std"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    return stats.select(F.inline(F.array(*stats.columns)))


def apply_scaler(df: DataFrame, scaler: DataFrame) -> DataFrame:
    """``(x - mean) / std``; a constant column has std 0 and is divided by 1.

    The scaler holds one row per column, so its values go into the plan.
    """
    stats = {r["feature"]: (r["mean"], r["std"] or 1.0) for r in scaler.collect()}
    return df.select(
        *[
            ((F.col(f"`{c}`").cast("double") - F.lit(stats[c][0])) / F.lit(stats[c][1])).alias(c)
            if c in stats
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


# -- sampling and splitting (U1-U3) -------------------------------------------


def hash_key(key: str, seed: int) -> Column:
    """Order of the sampling operators: fixed by seed and key alone."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def class_counts(df: DataFrame, by: str) -> DataFrame:
    """``by, n``: rows per class; null is a class like any other."""
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def cut_by_hash(
    df: DataFrame, key: str, by: str, cuts: DataFrame, seed: int
) -> DataFrame:
    """Adds ``part``: 0 for the first ``c0`` rows of a class in hash order, 1 up to
    ``c1``, and so on.  ``cuts``: ``by, c0, c1, ...``; classes not in it go.

    Equal to a rank over the whole class, but no class is ever sorted in one
    task.  Rows are counted per class and hash prefix; a running total over
    these at most 65,536 counts per class finds the prefix in which a cut
    falls.  Only rows of such prefixes are ranked, all others compare their
    prefix.  ``key`` must be unique.

    What a class is cut by is one row for it; up to ``BROADCAST_KEYS`` classes, counted, are
    broadcast, and rows are not shuffled on their class.
    """
    wanted = [c for c in cuts.columns if c != by]
    known = cuts.withColumnRenamed(by, "_class")
    rows = df.withColumn("_hash", hash_key(key, seed)).withColumn(
        "_prefix", F.substring("_hash", 1, 4)
    )
    running = Window.partitionBy(by).orderBy("_prefix")
    prefixes = (
        rows.groupBy(by, "_prefix")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("upto", F.sum("n").over(running))
        .withColumn("before", F.col("upto") - F.col("n"))
        .join(known, F.col(by).eqNullSafe(F.col("_class")))
    )
    # One row per class: the prefix of every cut and the rows it takes of it.
    edges = prefixes.groupBy("_class").agg(
        *[
            F.max(
                F.when(
                    (F.col("before") < F.col(c)) & (F.col(c) <= F.col("upto")),
                    F.struct("_prefix", (F.col(c) - F.col("before")).alias("take")),
                )
            ).alias(f"_e{i}")
            for i, c in enumerate(wanted)
        ]
    )
    placed = _with_edges(rows, edges, by)
    on_edge = F.lit(False)
    for i in range(len(wanted)):
        on_edge = on_edge | F.coalesce(F.col("_prefix") == F.col(f"_e{i}._prefix"), F.lit(False))
    within = Window.partitionBy(by, "_prefix").orderBy("_hash", key)
    ranked = placed.where(on_edge).withColumn("_rank", F.row_number().over(within))
    sure = placed.where(~on_edge).withColumn("_rank", F.lit(0))

    part = F.lit(len(wanted))
    for i in reversed(range(len(wanted))):
        prefix = F.col(f"_e{i}._prefix")
        taken = (F.col("_prefix") < prefix) | (
            (F.col("_prefix") == prefix) & (F.col("_rank") <= F.col(f"_e{i}.take"))
        )
        part = F.when(taken, F.lit(i)).otherwise(part)
    return sure.unionByName(ranked).select(*df.columns, part.cast("int").alias("part"))


def _with_edges(rows: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """Rows with what their class is cut by; rows of other classes go."""
    edges = kept_rows(edges, "edges")
    if fits_broadcast(edges):
        return rows.join(F.broadcast(edges), F.col(by).eqNullSafe(F.col("_class")))
    # Very many classes: most are small, and large ones meet a broadcast of their rows.
    key = lambda c: F.to_json(F.struct(F.col(c).alias("c")))
    joined = join_on_key(rows.withColumn("_key", key(by)), edges.withColumn("_key", key("_class")), "_key")
    return joined.drop("_key")


def undersample(
    df: DataFrame,
    n: int = MAJORITY_SAMPLE,
    label: str = "flag",
    key: str = "address",
    majority: int = 0,
    minority: int = 1,
    seed: int = 42,
) -> DataFrame:
    """U1 + U2: exactly ``n`` rows of the majority class and all of the minority."""
    large = filter_label(df, majority, label)
    available = large.count()
    if n > available:
        raise ValueError(f"cannot take {n} of {available} rows of class {majority}")
    cuts = large.select(label).limit(1).withColumn("c0", F.lit(n).cast("bigint"))
    sampled = cut_by_hash(large, key, label, cuts, seed).where("part = 0").drop("part")
    return sampled.unionByName(filter_label(df, minority, label))


def _shares(counts: DataFrame, by: str, n: str, want: Column, out: str) -> DataFrame:
    """Adds ``out``: shares of a total in proportion to ``n``, whole numbers that add up.

    What rounding down leaves goes to the largest remainders.
    """
    everything = Window.partitionBy()
    counts = counts.withColumn("_all", F.sum(n).over(everything)).withColumn("_want", want)
    exact = F.when(F.col("_all") > 0, F.col("_want") * F.col(n) / F.col("_all")).otherwise(0.0)
    counts = counts.withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = F.col("_want") - F.sum("_floor").over(everything)
    order = Window.orderBy(
        (F.col("_exact") - F.col("_floor")).desc(), F.col(by).cast("string").asc_nulls_first()
    )
    share = F.col("_floor") + (F.row_number().over(order) <= left).cast("bigint")
    return counts.withColumn(out, share).drop("_all", "_want", "_exact", "_floor")


def split_quotas(counts: DataFrame, by: str, holdout: float, test_share: float) -> DataFrame:
    """``by, train, val, test``, rows per class: cut off the holdout first, then
    divide it; every cut keeps the class proportions.

    One row per class, so the windows over all classes are short.
    """
    whole = F.col("_all")
    out = _shares(counts, by, "n", whole - F.ceil(F.lit(holdout) * whole), "train")
    out = out.withColumn("held", F.col("n") - F.col("train"))
    out = _shares(out, by, "held", whole - F.ceil(F.lit(test_share) * whole), "val")
    return out.select(by, "train", "val", (F.col("held") - F.col("val")).alias("test"))


def stratified_split(
    df: DataFrame,
    label: str = "flag",
    key: str = "address",
    holdout: float = 0.3,
    test_share: float = 0.5,
    seed: int = 42,
) -> DataFrame:
    """Adds ``split`` = ``train`` / ``val`` / ``test`` (70 / 15 / 15 %).

    Rows without a label are a class of their own.
    """
    quotas = split_quotas(class_counts(df, label), label, holdout, test_share)
    cuts = quotas.select(label, F.col("train").alias("c0"), (F.col("train") + F.col("val")).alias("c1"))
    names = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
    return (
        cut_by_hash(df, key, label, cuts, seed)
        .withColumn("split", F.get(names, F.col("part")))
        .drop("part")
    )


def sequence_stats(df: DataFrame, label: str = "flag") -> DataFrame:
    """Records per split and class."""
    return df.groupBy("split", label).agg(F.count(F.lit(1)).alias("records"))


# -- putting it together (J2) --------------------------------------------------


def assemble(
    addresses: DataFrame,
    matrices: DataFrame,
    length: int = SEQUENCE_LENGTH,
    width: int = SEQUENCE_WIDTH,
) -> DataFrame:
    """The sequence of every listed account; all zeros without transactions.

    The list decides the rows: duplicates stay, and each carries its own label
    and static features.
    """
    zeros = F.array_repeat(F.array_repeat(F.lit(0.0), width), length)
    joined = join_on_key(addresses, matrices, "address", how="left")
    return joined.withColumn("sequence", F.coalesce("sequence", zeros))
