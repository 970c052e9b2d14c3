import hashlib
import math
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from txrisk.operators import metrics, prep
from txrisk.operators.sequences import numeric_columns
from txrisk.schemas import IRRELEVANT_TX_COLUMNS


@pytest.fixture(scope="module")
def people(spark):
    rows = [(f"0x{i:03d}", 1 if i % 7 == 0 else 0) for i in range(200)]
    return spark.createDataFrame(rows, "address string, flag int").cache()


def by_hash(addresses, seed=42):
    return sorted(addresses, key=lambda a: hashlib.md5(f"{seed}:{a}".encode()).hexdigest())


def test_columns(spark):
    df = spark.createDataFrame([(1, "a", 2.0, None)], "A int, type string, `x.1` double, d decimal(9,2)")
    assert prep.select_existing(df, ["x.1", "a", "A"]).columns == ["x.1", "A"]
    assert prep.drop_existing(df, [*IRRELEVANT_TX_COLUMNS, "X.1"]).columns == ["A", "x.1", "d"]
    assert numeric_columns(df) == ["A", "x.1"]
    aligned = prep.align_features(df, ["b", "x.1"], keep=("A",)).first()
    assert tuple(aligned) == (1, 0.0, 2.0)


@pytest.mark.parametrize("n", [0, 1, 50, 171])
def test_undersample_is_an_exact_rank(people, n):
    majority = [r["address"] for r in people.where("flag = 0").collect()]
    got = prep.undersample(people, n).collect()
    assert sorted(r["address"] for r in got if r["flag"] == 0) == sorted(by_hash(majority)[:n])
    assert sum(r["flag"] for r in got) == 29
    assert prep.undersample(people, n).count() == len(got)


def test_undersample_refuses_too_many(people):
    with pytest.raises(ValueError, match="171"):
        prep.undersample(people, 172)


def test_split_is_a_partition_with_class_quotas(people):
    parts = prep.stratified_split(people, seed=7)
    rows = parts.collect()
    assert sorted(r["address"] for r in rows) == sorted(r["address"] for r in people.collect())
    counts = {(r["split"], r["flag"]): r["records"] for r in prep.sequence_stats(parts).collect()}
    # 200 rows: 140 / 30 / 30, and 29 of 200 in class 1.
    assert counts == {
        ("train", 0): 120, ("train", 1): 20, ("val", 0): 26, ("val", 1): 4,
        ("test", 0): 25, ("test", 1): 5,
    }
    for flag in (0, 1):
        order = by_hash([r["address"] for r in rows if r["flag"] == flag], 7)
        place = {r["address"]: r["split"] for r in rows}
        assert [place[a] for a in order] == sorted(
            (place[a] for a in order), key=["train", "val", "test"].index
        )


@settings(max_examples=12, deadline=None)
@given(st.dictionaries(st.integers(0, 4), st.integers(2, 500), min_size=1))
def test_quotas(spark, counts):
    table = spark.createDataFrame(list(counts.items()), "flag int, n long")
    quotas = {
        r["flag"]: (r["train"], r["val"], r["test"])
        for r in prep.split_quotas(table, "flag", 0.3, 0.5).collect()
    }
    total = sum(counts.values())
    assert all(sum(q) == counts[c] and min(q) >= 0 for c, q in quotas.items())
    assert sum(q[0] for q in quotas.values()) == total - math.ceil(0.3 * total)
    assert all(abs(q[0] - 0.7 * counts[c]) <= 2 for c, q in quotas.items())


def test_many_classes_and_rows_without_label(spark):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("address"),
        F.when(F.col("id") >= 100, (F.col("id") % 101).cast("int")).alias("flag"),
    )
    parts = prep.stratified_split(df)
    assert parts.count() == 1000
    sizes = {r["split"]: r["count"] for r in parts.where("flag is null").groupBy("split").count().collect()}
    assert sum(sizes.values()) == 100 and abs(sizes["train"] - 70) <= 1
    assert parts.where("flag is not null").select("flag").distinct().count() == 101


def test_constant_double_is_scaled_to_zero(spark):
    df = spark.range(1000).select(F.lit(7.3).alias("c"), F.col("id").cast("double").alias("x")).repartition(7)
    scaled = prep.apply_scaler(df, prep.fit_scaler(df, ["c", "x"]))
    assert scaled.agg(F.max(F.abs("c"))).first()[0] == 0.0


@settings(max_examples=12, deadline=None)
@given(
    st.lists(
        st.one_of(st.none(), st.just(float("nan")), st.floats(-1e6, 1e6), st.just(0.0)), min_size=1
    )
)
def test_median(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [v for v in values if v is not None and not math.isnan(v)]
    expected = statistics.median(known) if known else 0.0
    assert prep.medians(df, ["v"])["v"] == pytest.approx(expected)


def test_median_of_a_long_column(spark):
    n = 50_001
    df = spark.range(n).select(
        F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("v"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise(F.col("id").cast("double")).alias("z"),
    )
    got = prep.medians(df, ["v", "z"])
    rows = df.collect()
    assert got == {c: statistics.median(r[c] for r in rows) for c in ("v", "z")}
    near = prep.medians(df, ["v"], exact=False)["v"]
    assert near == pytest.approx(got["v"], rel=0.01)


def test_impute(spark):
    df = spark.createDataFrame(
        [(1, 1.0, "2.5"), (2, None, "x"), (10, float("nan"), None), (3, 5.0, "7")],
        "a int, b double, t string",
    )
    got = prep.impute(df, ["b", "t"]).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 2.5), (2, 3.0, 0.0), (3, 5.0, 7.0), (10, 3.0, 0.0)]


def test_scaler(spark):
    df = spark.createDataFrame([(1.0, 7), (2.0, 7), (6.0, 7)], "a double, c int")
    stats = {r["feature"]: (r["mean"], r["std"]) for r in prep.fit_scaler(df, ["a", "c"]).collect()}
    assert stats["a"] == (3.0, pytest.approx(math.sqrt(14 / 3)))
    assert stats["c"] == (7.0, 0.0)
    scaled = prep.apply_scaler(df, prep.fit_scaler(df, ["a", "c"])).collect()
    assert [r["c"] for r in scaled] == [0.0, 0.0, 0.0]
    assert sum(r["a"] for r in scaled) == pytest.approx(0)


def test_assemble(spark):
    listed = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "address string, flag int")
    matrices = spark.createDataFrame([("a", [[1.0, 2.0]])], "address string, sequence array<array<double>>")
    got = prep.assemble(listed, matrices, 1, 2).orderBy("address", "flag").collect()
    assert [(r["address"], r["flag"], r["sequence"]) for r in got] == [
        ("a", 0, [[1.0, 2.0]]), ("a", 1, [[1.0, 2.0]]), ("b", 1, [[0.0, 0.0]]),
    ]


def test_metrics(spark):
    df = spark.createDataFrame(
        [(0, 0, 2.0, -2.0), (0, 0, 2.0, -2.0), (1, 0, 0.0, 0.0), (1, 1, -3.0, 3.0)],
        "flag int, predicted int, z0 double, z1 double",
    )
    assert metrics.accuracy(df).first()["accuracy"] == 0.75
    cells = {(r["actual"], r["predicted"]): r["records"] for r in metrics.confusion_matrix(df).collect()}
    assert cells == {(0, 0): 2, (0, 1): 0, (1, 0): 1, (1, 1): 1}
    soft = [math.log1p(math.exp(-2))] * 2 + [math.log(2)] + [math.log1p(math.exp(-3))]
    assert metrics.bce_loss(df).first()["loss"] == pytest.approx(sum(soft) / 4)
