"""What the operators share: tables in the shared folder, and sizes of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.sources.checkpoints import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later steps start from files that every executor sees, so a lost executor
    costs only its own tasks, and the planner knows the real size.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only (null: empty), whatever else there is."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def free(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows, without counting all of a larger one."""
    return df.limit(rows + 1).count() <= rows


def slices(column, most: int):
    """Runs ``(low, high)`` of an Arrow string column of about ``most`` bytes.

    A longer text is a run of its own, so that whole texts stay together.
    """
    import numpy as np

    n = len(column)
    if not n:
        return
    ends = np.cumsum(np.diff(byte_offsets(column)))
    low = 0
    while low < n:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + most, "right")))
        yield low, high
        low = high


def byte_offsets(column):
    """Byte positions of an Arrow string column's values, n + 1 of them."""
    import numpy as np
    import pyarrow as pa

    kind = "<i8" if pa.types.is_large_string(column.type) else "<i4"
    raw = np.frombuffer(column.buffers()[1], kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def byte_values(column, low: int, high: int):
    """The bytes of values ``low`` to ``high``, and where each one starts in them."""
    import numpy as np

    offsets = byte_offsets(column)[low : high + 1]
    if offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), offsets[:-1] - offsets[0]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets[:-1] - offsets[0]
