"""Landed responses of a block explorer.

A response is a JSON object ``{status, message, result}``.  Responses are
landed as JSON lines under ``kind=<kind>/`` with the requested ``address``
added, and may carry a ``page`` and the time ``landed_at``.  Fetching them is not part of
this library.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalars import safe_int, to_double_or_zero
from txrisk.operators.skew import fits_broadcast
from txrisk.schemas import ENVELOPE_SCHEMA, KIND_FIELDS, record_of

# Normal, internal and token transfers.
KINDS = tuple(KIND_FIELDS)
_COLUMNS = ENVELOPE_SCHEMA.fieldNames()


def _known(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
    return kind


def land(envelopes: DataFrame, path: str, kind: str, batch: str) -> None:
    """Lands responses as a batch, in a folder of its own that a replay replaces; its files are
    compressed, to about a sixth."""
    given = [c for c in _COLUMNS if c in envelopes.columns]
    folder = f"{path}/kind={_known(kind)}/batch={batch}"
    envelopes.select(*given).write.mode("overwrite").json(folder, compression="gzip")


def read_envelopes(spark: SparkSession, path: str, kind: str = "txlist") -> DataFrame:
    """The responses of one kind; ``result`` is still text."""
    return spark.read.schema(ENVELOPE_SCHEMA).json(f"{path}/kind={_known(kind)}").select(*_COLUMNS)


def newest(envelopes: DataFrame, prefer_ok: bool = True) -> DataFrame:
    """One response per account and page: the one that landed last.

    ``prefer_ok`` takes a good response before later ones that are not, so that a
    refused request does not erase what is known.  Responses of one time are ordered by
    their text.  Responses are counted by account and page first.  If there are several of
    few pages only, these alone meet, and the others stay where they are; else all responses
    meet once.  Each task sends on its newest one of a page alone.
    """
    keys = ["address", "page"]
    several = envelopes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    several = several.select(F.struct(*keys).alias("_key"))
    few = fits_broadcast(several)
    # Structs compare with nulls in them, so responses without a page have a page, too.
    same = F.struct(*keys) == F.col("_key")
    good = _is_good() if prefer_ok else F.lit(True)
    order = [good.desc(), F.col("landed_at").desc_nulls_last(), F.col("result").desc_nulls_last(),
             F.col("status").desc_nulls_last(), F.col("message").desc_nulls_last()]
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if not few:
        return envelopes.withColumn("_last", last).where("_last = 1").drop("_last")
    several = F.broadcast(several)
    again = envelopes.join(several, same, "left_semi").withColumn("_last", last).where("_last = 1")
    return envelopes.join(several, same, "left_anti").unionByName(again.drop("_last"))


def _is_list() -> Column:
    # from_json would wrap a single object into a list.
    return F.coalesce(F.col("result").rlike(r"^\s*\["), F.lit(False))


def _is_good() -> Column:
    return F.coalesce(F.col("status") == "1", F.lit(False)) & _is_list()


def _list_of(kind: str) -> Column:
    return F.from_json("result", T.ArrayType(record_of(kind)))


def problem(kind: str = "txlist") -> Column:
    """Why a strict reading refuses a response; null if it does not."""
    said = F.concat(
        F.lit("explorer response without a list for "), F.coalesce("address", F.lit("?"))
    )
    return F.when(~_is_list() | _list_of(kind).isNull(), said)


def records(envelopes: DataFrame, on_error: str = "empty", kind: str = "txlist") -> DataFrame:
    """One row per transaction with the requested ``address`` and ``pos``, its
    place in the response.

    ``on_error='empty'`` treats a response that is not OK as one without
    transactions (F7); ``'fail'`` raises when ``result`` is no list (``problem``).
    """
    if on_error not in ("empty", "fail"):
        raise ValueError(f"on_error must be 'empty' or 'fail', not {on_error!r}")
    parsed = envelopes.withColumn("list", _list_of(_known(kind)))
    if on_error == "fail":
        why = problem(kind)
        parsed = parsed.withColumn("list", F.when(why.isNull(), F.col("list")).otherwise(F.raise_error(why)))
    else:
        parsed = parsed.where(_is_good())
    return parsed.select("address", F.posexplode("list").alias("pos", "record")).select(
        "address",
        F.col("pos").cast("bigint").alias("pos"),
        *[F.col("record").getField(f).alias(name) for f, name in KIND_FIELDS[kind].items()],
    )


def token_amount(value: str = "value", decimals: str = "token_decimal") -> Column:
    """The amount of a token transfer in whole tokens."""
    return to_double_or_zero(value) / F.pow(F.lit(10.0), safe_int(decimals))


def read_explorer(
    spark: SparkSession, path: str, kind: str = "txlist", on_error: str = "empty"
) -> DataFrame:
    """The transactions of all landed responses of one kind, each response once
    however often it landed.

    Pages of an account that follow each other keep ``pos`` of their own.
    """
    landed = newest(read_envelopes(spark, path, kind), prefer_ok=on_error == "empty")
    return records(landed, on_error, kind)
