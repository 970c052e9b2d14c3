"""Bulk exports whose later lines do not fit the types of the first ones."""

import pytest

from txrisk.sources import tables


def export(tmp_path, first, later):
    path = tmp_path / "tx.csv"
    path.write_text("from_address,value,gas\n" + f"0xa,1,{first}\n" * 20 + f"0xb,2,{later}\n")
    return str(path)


@pytest.mark.parametrize(
    "first, later",
    [("21000", "3000000000"), ("21000", "1.5"), ("9000000000", "9e30"), ("1.5", "much"),
     ("1" * 25, "1.5"), ("true", "1"), ("21000", "x")],
)
def test_unfitting_value_stops(spark, tmp_path, first, later):
    path = export(tmp_path, first, later)
    for numbered in (False, True):
        with pytest.raises(Exception, match="column gas was guessed as .*, but holds: "):
            tables.read_transactions(spark, path, head=10, numbered=numbered).collect()
    assert tables.read_transactions(spark, path, head=10).select("value").count() == 21


@pytest.mark.parametrize("first, later", [("21000", ""), ("21000", "2147483647"), ("1.5", "NaN"), ("1.5", "2e300"), ("word", "7")])
def test_fitting_value_stays(spark, tmp_path, first, later):
    df = tables.read_transactions(spark, export(tmp_path, first, later), head=10, numbered=True)
    got = df.where("from_address = '0xb'").first()
    assert df.count() == 21 and got.value == 2.0 and got.pos == 20
    if not later:
        assert got.gas is None
    else:
        assert str(got.gas) == str(type(got.gas)(later))


def test_value_is_checked_too(spark, tmp_path):
    path = tmp_path / "tx.csv"
    path.write_text("from_address,value\n0xa,1\n0xb,lots\n")
    with pytest.raises(Exception, match="column value was guessed as double"):
        tables.read_transactions(spark, str(path)).collect()
