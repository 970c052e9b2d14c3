import datetime

import pytest
from pyspark.sql import functions as F

from txrisk.functions import presentation as show
from txrisk.functions import scalars as x
from txrisk.functions import scores


def one(spark, column, value, kind="string"):
    df = spark.createDataFrame([(value,)], f"c {kind}")
    return df.select(column("c")).first()[0]


@pytest.mark.parametrize(
    "text, expected",
    [(None, 0.0), ("", 0.0), ("n/a", 0.0), ("nan", 0.0), ("1500000000000000000", 1.5),
     ("123456789012345678901234567", 123456789.01234568), (" 1000000000000000000 ", 1.0)],
)
def test_ether(spark, text, expected):
    assert one(spark, x.ether, text) == pytest.approx(expected)


@pytest.mark.parametrize(
    "text, expected",
    [(None, 0), ("", 0), ("12", 12), ("-3", -3), ("12.5", 0), ("0x1f", 0), ("zz", 0)],
)
def test_safe_int(spark, text, expected):
    assert one(spark, x.safe_int, text) == expected


@pytest.mark.parametrize(
    "text, expected",
    [(None, False), ("", False), ("0x", False), ("0x00", False), ("deprecated", False),
     ("0xzz", False), ("0x1", True), ("0X0a", True), ("00f", True),
     ("0xa9059cbb" + "0" * 120 + "1", True), ("0x1\n", False)],
)
def test_hex_nonzero(spark, text, expected):
    assert one(spark, x.hex_nonzero, text) is expected


@pytest.mark.parametrize(
    "text, expected",
    [(None, "empty"), ("", "empty"), ("  \t", "empty"), ("0x" + "aB" * 20, "ok"),
     ("0x" + "a" * 39, "invalid"), ("0x" + "a" * 41, "invalid"), ("0X" + "a" * 40, "invalid"),
     ("0x" + "a" * 40 + "\n", "invalid"), ("0x" + "g" * 40, "invalid")],
)
def test_address_check(spark, text, expected):
    assert one(spark, x.address_check, text) == expected


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_date_int_does_not_depend_on_the_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert one(spark, x.date_int, "2024-03-10 02:30:00.123") == 20240310
        assert one(spark, x.date_int, "2024-01-31 23:59:59.999999") == 20240131
        assert one(spark, x.date_int, None) is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_date_int_is_strict(spark):
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP"):
        one(spark, x.date_int, "31/01/2024")


def test_to_double_or_zero(spark):
    assert [one(spark, x.to_double_or_zero, t) for t in ("1.5", " 2 ", "abc", None)] == [1.5, 2, 0, 0]


@pytest.mark.parametrize(
    "p, band, label",
    [(0.0, "low", "0%"), (0.3, "low", "30%"), (0.3001, "medium", "30%"), (0.6, "medium", "60%"),
     (0.601, "high", "60%"), (0.8, "high", "80%"), (0.8001, "very_high", "80%"),
     (0.999, "very_high", "99%"), (1.0, "very_high", "100%")],
)
def test_risk_band(spark, p, band, label):
    assert one(spark, show.risk_band, p, "double") == band
    assert one(spark, show.percent_label, p, "double") == label


def test_display(spark):
    address = "0x1234567890abcdef1234567890abcdef12345678"
    assert one(spark, show.short_address, address) == "0x1234...5678"
    assert [one(spark, show.status_class, v) for v in ("Fraud", "NORMAL", "other")] == [
        "fraud", "normal", "unknown",
    ]
    assert one(spark, show.upper_verdict, "Normal") == "NORMAL"
    rows = spark.createDataFrame(
        [(True, ["a"]), (True, []), (True, None), (False, ["a"])], "f boolean, e array<string>"
    )
    seen = [r[0] for r in rows.select(show.visible_explanations("f", "e")).collect()]
    assert seen == [["a"], None, None, None]


def test_scores(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, -1.0), (-1000.0, 1000.0)], "a double, b double")
    p0, p1 = scores.softmax2("a", "b")
    rows = df.select(p0.alias("p0"), p1.alias("p1"), scores.argmax(F.array("a", "b")).alias("c")).collect()
    assert all(r.p0 + r.p1 == pytest.approx(1) for r in rows)
    # A tie goes to the first class.
    assert [r.c for r in rows] == [0, 0, 1]
    assert rows[2].p1 == 1.0
    loss = df.select(scores.bce_with_logits("a", F.lit(1.0)).alias("l")).collect()
    assert loss[0].l == pytest.approx(0.6931471805599453)
    assert loss[2].l == pytest.approx(1000.0)


def test_run_stamp(spark):
    stamp = spark.range(1).select(x.run_stamp()).first()[0]
    assert datetime.datetime.strptime(stamp, "%Y%m%d_%H%M%S")


def test_amounts_beyond_38_digits(spark, make_tx, listed):
    from txrisk.plans import scan

    big = "9" * 38
    tx = make_tx({"value": big}, {"value": big}, {"value": "1" + "0" * 40})
    row = scan.behaviour(listed("0xa"), tx).first()
    assert row["sent_count"] == 3
    assert row["max_sent"] == pytest.approx(1e22) and row["total_sent"] == pytest.approx(1e22 + 2e20)
    steps = scan.profiles(listed("0xa"), tx).first()["sequence"]
    assert sorted(s[1] for s in steps)[-3:] == pytest.approx([1e20, 1e20, 1e22])


def test_page_has_no_last_block(spark, make_tx, listed):
    from txrisk.operators.history import page
    from txrisk.operators.incidence import history_for

    rows = history_for(listed("0xa"), make_tx({"block_number": "250000000"}))
    assert page(rows).count() == 1 and page(rows, end_block=99_999_999).count() == 0


def test_single_object_is_no_list(spark):
    from txrisk.plans.explain import parse_explanations

    df = spark.createDataFrame([("a", '{"title": "t"}'), ("b", '\n```json\n[{"title": "t"}]\n```')], "address string, reply string")
    got = {r["address"]: r["explanations"] for r in parse_explanations(df, on_error="null").collect()}
    assert got["a"] is None and got["b"][0]["title"] == "t"
