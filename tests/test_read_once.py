"""How often queries and operators go back to their input."""

from conftest import SMALL
from pyspark.sql import functions as F

from txrisk import catalog
from txrisk.operators import history as hist


def _counted(spark, rows):
    """``rows`` with their addresses, and a count of how many were made."""
    seen = spark.sparkContext.accumulator(0)

    def same(address):
        seen.add(1)
        return address

    return rows.withColumn("address", F.udf(same, "string").asNondeterministic()("address")), seen


def _rows(spark):
    """Two accounts of many rows a day, an hour, a second and a block; ties down to the hash."""
    i = F.col("id")
    return spark.range(600).select(
        F.concat(F.lit("0x"), (i % 2).cast("string")).alias("address"), i.alias("pos"),
        F.format_string("0x%016x", F.floor(i / 3) * 7).alias("hash"),
        F.floor(i / 400).cast("string").alias("time_stamp"), F.lit("7").alias("block_number"),
        F.floor(i / 300).cast("string").alias("transaction_index"),
    )


def test_a_deep_page_reads_its_rows_three_times(spark):
    rows = _rows(spark)
    for sort in ("asc", "desc"):
        counted, seen = _counted(spark, rows)
        got = hist.rows_between(counted, 21, 30, sort == "desc", 5)
        found = sorted((r.address, r.rank, r.pos) for r in got.collect())
        order = hist.newest_first() if sort == "desc" else hist.oldest_first()
        ranked = rows.withColumn("rank", F.row_number().over(hist.Window.partitionBy("address").orderBy(*order)))
        plain = ranked.where(F.col("rank").between(21, 30)).collect()
        assert found == sorted((r.address, r.rank, r.pos) for r in plain)
        assert seen.value <= 3 * 600


def test_training_rows_are_made_once(spark, monkeypatch):
    made = catalog._prepared(spark, SMALL).limit(40).localCheckpoint()
    for query in (catalog.train_and_score, catalog.model_predictions, catalog.model_agreement):
        rows, seen = _counted(spark, made)
        monkeypatch.setattr(catalog, "_prepared", lambda spark, d: rows)
        assert query(spark, SMALL).count() > 0
        assert seen.value == 40, query.__name__
