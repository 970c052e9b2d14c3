"""Classes of documents that verified links hold together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """``doc, label``: the smallest document that links ``(a, b)`` lead to.

    Each round gives every document the smallest label among itself and its
    neighbours, and then that label's own label, so the distance covered doubles. Only
    documents with links are in the result.
    """
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b")
    both = stored(both.distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("a").alias("b"), "label"), "b")
            .groupBy("a").agg(F.min("label").alias("near"))
        )
        hooked = labels.join(near, "a").select(
            "a", F.least("label", "near").alias("to"), F.col("label").alias("was")
        )
        jumped = labels.select(F.col("a").alias("to"), F.col("label").alias("next"))
        new = stored(
            hooked.join(jumped, "to").select("a", F.least("to", "next").alias("label"), "was"), "labels"
        )
        labels = new.drop("was")
        if new.where(F.col("label") != F.col("was")).isEmpty():
            return labels.withColumnRenamed("a", "doc")
