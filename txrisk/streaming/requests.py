"""Answering scan requests as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from txrisk.operators.skew import Hot, settled
from txrisk.plans.model import RiskModel
from txrisk.plans.scan import check_requests, scan


def read_requests(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Requests as JSON lines ``{"address": ...}`` in files that keep coming."""
    return (
        spark.readStream.schema("address string").option("maxFilesPerTrigger", per_trigger).json(path)
    )


def scan_stream(
    requests: DataFrame,
    tx: DataFrame | Callable[[DataFrame], DataFrame],
    model: RiskModel,
    sink: str,
    checkpoint_dir: str,
    k: int | None = None,
    strict: bool = False,
    keyed: bool = False,
    available_now: bool = True,
    hot: DataFrame | Hot | None = None,
) -> StreamingQuery:
    """Scan every micro-batch of requests and write the answers as JSON.

    A batch goes to a folder named by its id, which a replay overwrites, so
    every request is answered once: in ``answers/``, or with a reason in ``failed/``.  Requests are independent of each other:
    there is no state and no watermark.  ``tx`` may be a function from the
    requested accounts to their transactions, such as ``read_history`` on a kept
    history, so that a batch does not read all transactions; ``hot``, a stored table
    of hub accounts, saves counting them in every batch.
    """

    # Counted once, not by every batch.
    hot = None if hot is None else settled(hot)

    def answer(batch: DataFrame, batch_id: int) -> None:
        good, failed = check_requests(batch, strict)
        rows = tx(good) if callable(tx) else tx
        answers = scan(good, rows, model, k, hot, keyed)
        answers.write.mode("overwrite").json(f"{sink}/answers/batch={batch_id}")
        failed.write.mode("overwrite").json(f"{sink}/failed/batch={batch_id}")

    writer = requests.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint_dir)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
