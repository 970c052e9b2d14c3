"""Explanations in words.

A language model outside of Spark writes the reasons: this module makes the
table of prompts and reads the table of replies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.operators.skew import join_on_key
from txrisk.plans.scan import to_analysis_row
from txrisk.schemas import EXPLANATION

INSTRUCTION = "Explain why this blockchain account looks fraudulent. Account: "
EVIDENCE = "\nIts transactions, as JSON: "
TASK = (
    "\nName three likely reasons. For each one give examples of well-known scams that work this way."
    "\nReply with a JSON list only, one object per reason: "
    '{"title": string, "description": string, "examples": [string]}'
)


def explanation_prompts(df: DataFrame, only_fraud: bool = True) -> DataFrame:
    """``(address, prompt)`` for scan results.

    Only accounts judged as fraud get a prompt, unless ``only_fraud=False``.
    """
    if only_fraud:
        df = df.where(F.col("prediction.is_fraud"))
    return df.select(
        "address",
        F.concat(
            F.lit(INSTRUCTION),
            F.col("address"),
            F.lit(EVIDENCE),
            F.to_json("transactions_used"),
            F.lit(TASK),
        ).alias("prompt"),
    )


def parse_explanations(replies: DataFrame, reply: str = "reply", on_error: str = "fail") -> DataFrame:
    """Adds ``explanations``, the list of reasons in a reply.

    A missing, blank or broken reply raises, or is null with
    ``on_error='null'``.  A reply wrapped in a fenced block is unwrapped.
    """
    if on_error not in ("fail", "null"):
        raise ValueError(f"on_error must be 'fail' or 'null', not {on_error!r}")
    bare = F.regexp_replace(F.regexp_replace(reply, r"^\s+|\s+\z", ""), r"^```[a-zA-Z]*\s*|\s*```\z", "")
    # from_json would wrap a single object into a list.
    single = F.coalesce(bare.rlike(r"^\s*[^\s\[]"), F.lit(False))
    blank = F.coalesce(F.length(bare) == 0, F.lit(True))
    if on_error == "fail":
        text = (
            F.when(blank, F.raise_error(F.lit("empty reply")))
            .when(single, F.raise_error(F.lit("the reply is no list")))
            .otherwise(bare)
        )
        return replies.withColumn(
            "explanations", F.from_json(text, EXPLANATION, {"mode": "FAILFAST"})
        )
    return replies.withColumn(
        "explanations", F.from_json(F.when(~blank & ~single, bare), EXPLANATION, {"mode": "PERMISSIVE"})
    )


def attach_explanations(results: DataFrame, explanations: DataFrame) -> DataFrame:
    """Analysis rows with their reasons; accounts without a reply keep null."""
    reasons = explanations.select("address", "explanations")
    joined = join_on_key(results, reasons, "address", how="left")
    return to_analysis_row(joined, "explanations")
