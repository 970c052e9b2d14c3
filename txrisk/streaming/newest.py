"""Answering requests out of stream state: the newest rows of every account.

Transactions arrive as a stream, and the newest ``k`` of every account are kept as state.
A request is answered from the state, so no micro-batch reads a table of transactions.
An account has pieces: the rows of a hub account go to several tasks, each of which keeps its own
newest ``k``, and the scan that follows takes the newest of these.

State is keyed by bucket, a hash of account and piece, because every key costs some calls between Spark and
Python.  What a micro-batch brings a bucket is added to its state as one packed value.  When there are ``_VALUES`` of
them, the last ones are merged, as far back as they are not much smaller than what they are merged into.

State needs the RocksDB provider: ``spark.sql.streaming.stateStore.providerClass`` set to
``PROVIDER``.
"""

from __future__ import annotations

import heapq
import pickle
import zlib
from collections import namedtuple
from collections.abc import Callable, Container, Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from txrisk.functions.scalars import lower_address, safe_int
from txrisk.operators.incidence import account_rows
from txrisk.plans.scan import check_requests
from txrisk.schemas import HISTORY_COLUMNS
from txrisk.sources.checkpoints import kept_rows

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Arriving rows that are held at once before the newest are kept.
_CHUNK = 10_000
#: Values that a bucket's state may have before some are merged.
_VALUES = 8
#: What is kept of a row: its number, its place in the order, and its fields as one JSON text,
#: which passes Python as it is.
_KEPT = T.StructType(
    [T.StructField("pos", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in ("order_ts", "order_block", "order_index")]
    + [T.StructField(c, T.StringType()) for c in ("order_hash", "fields")]
)
_OUT = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("address", "request", "asked")]
    + [T.StructField("pos", T.LongType()), T.StructField("fields", T.StringType())]
)
_Answer = namedtuple("_Answer", _OUT.names)
_NUMBER = T.StructType([T.StructField("number", T.IntegerType())])
_PACKED = T.StructType([T.StructField("packed", T.BinaryType())])
_SIZES = T.StructType([T.StructField("rows", T.StringType())])
#: What a bucket is handed of a row; nothing in it is null.
_IN = ["address", "piece", "request", "asked", "pos", "order_ts", "order_block", "order_index", "order_hash", "fields"]


def _newest_first(row: tuple) -> tuple:
    """The order of ``newest_first`` for a kept row; nulls come last."""
    pos, ts, block, index, hashed, _ = row
    return (
        ts is None, -(ts or 0), block is None, -(block or 0), index is None, -(index or 0),
        hashed is None, hashed or "", pos is None, pos or 0,
    )


class _Newest(StatefulProcessor):
    """The newest rows of an account's piece, and what is asked about it.

    A row is ``request, asked`` and then what is kept of it.
    """

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("newest", _KEPT)

    def handleInputRows(self, key, rows: Iterator[tuple], timerValues) -> Iterator[_Answer]:
        asks, new, held = [], False, None
        rows = iter(rows)
        while chunk := list(islice(rows, _CHUNK)):
            asks += [r[:2] for r in chunk if r[0] is not None]
            arrived = [tuple(r[2:]) for r in chunk if r[0] is None]
            if arrived:
                held, new = self._cut([*(self.rows.get() if held is None else held), *arrived]), True
        if new:
            self.rows.put(held)
        if not asks:
            return
        # The other pieces of an account send rows only.
        if key[1] == 0:
            for request, asked in asks:
                yield _Answer(key[0], request, asked, None, None)
        for row in self.rows.get() if held is None else held:
            yield _Answer(key[0], None, None, row[0], row[-1])

    def _cut(self, rows: Iterable[tuple]) -> list[tuple]:
        """The newest rows, each once: a replayed file brings known rows again."""
        once: dict = {}
        for row in rows:
            once.setdefault(row[0], row)
        return heapq.nsmallest(self.k, once.values(), key=_newest_first)

    def close(self) -> None:
        pass


class _Rows:
    """What is kept of one account's piece, in memory."""

    def __init__(self, rows: list[tuple] | None = None):
        self.rows = rows or []

    def getListState(self, name: str, schema: T.StructType) -> _Rows:
        return self

    def get(self) -> Iterator[tuple]:
        return iter(self.rows)

    def put(self, rows: list[tuple]) -> None:
        self.rows = rows


class _Bucket(StatefulProcessor):
    """All accounts' pieces of one bucket, each of them as ``_Newest`` keeps and answers it."""

    def __init__(self, k: int):
        self.k = k

    def init(self, handle: StatefulProcessorHandle) -> None:
        # Every value is an entry of its own, so the others stay as they are when one is added.
        self.values = handle.getMapState("newest", _NUMBER, _PACKED)
        self.sizes = handle.getValueState("sizes", _SIZES)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting, asks, new = {}, {}, {}
        for frame in rows:
            for address, piece, request, asked, *kept in frame[_IN].itertuples(index=False, name=None):
                of = (address, piece)
                if request:
                    asks.setdefault(of, []).append((_unmarked(request), _unmarked(asked)))
                    continue
                some = waiting.get(of)
                if some is None:
                    some = waiting[of] = []
                pos, ts, block, index, hashed, fields = kept
                pos = int(pos[1:]) if pos else None
                some.append((None, None, pos, ts, block, index, _unmarked(hashed), fields))
                if len(some) >= _CHUNK:
                    self._feed(of, new.setdefault(of, _Rows()), waiting.pop(of))
        for of, some in waiting.items():
            self._feed(of, new.setdefault(of, _Rows()), some)
        sizes = [int(n) for n in (self.sizes.get() or ("",))[0].split()]
        held = self._held(range(len(sizes)), asks) if asks else {}
        for of in asks.keys() & new.keys():
            self._add(held, of, new[of].rows)
        if new:
            self._keep(new, sizes)
        out = []
        for of, some in asks.items():
            out += self._feed(of, held.get(of, _Rows()), some)
            if len(out) >= _CHUNK:
                yield pd.DataFrame(out, columns=_OUT.names, dtype=object)
                out = []
        if out:
            yield pd.DataFrame(out, columns=_OUT.names, dtype=object)

    def _feed(self, of: tuple, kept: _Rows, rows: Iterable[tuple]) -> list[_Answer]:
        """Hands ``rows`` to one account's piece."""
        piece = _Newest(self.k)
        piece.init(kept)
        return list(piece.handleInputRows(of, iter(rows), None))

    def _add(self, held: dict[tuple, _Rows], of: tuple, rows: list[tuple]) -> None:
        if of in held:
            self._feed(of, held[of], ((None, None, *row) for row in rows))
        else:
            held[of] = _Rows(rows)

    def _held(self, numbers: range, wanted: Container | None = None) -> dict[tuple, _Rows]:
        """What values of the state, oldest first, keep of the ``wanted`` pieces or of all."""
        held: dict[tuple, _Rows] = {}
        for number in numbers:
            packed = self.values.getValue((number,))[0]
            for of, rows in pickle.loads(zlib.decompress(packed)).items():
                if wanted is None or of in wanted:
                    self._add(held, of, rows)
        return held

    def _keep(self, new: dict[tuple, _Rows], sizes: list[int]) -> None:
        """Adds ``new`` to values of ``sizes`` rows each."""
        first, size = len(sizes), _size(new)
        if first + 1 >= _VALUES:
            while first and sizes[first - 1] <= 2 * size:
                first -= 1
                size += sizes[first]
        merged = self._held(range(first, len(sizes)))
        for of, kept in new.items():
            self._add(merged, of, kept.rows)
        self.values.updateValue((first,), (_packed(merged),))
        for number in range(first + 1, len(sizes)):
            self.values.removeKey((number,))
        self.sizes.update((" ".join(map(str, [*sizes[:first], _size(merged)])),))

    def close(self) -> None:
        pass


def _size(kept: dict[tuple, _Rows]) -> int:
    return sum(len(rows.rows) for rows in kept.values())


def _packed(kept: dict[tuple, _Rows]) -> bytes:
    return zlib.compress(pickle.dumps({of: rows.rows for of, rows in kept.items()}), 1)


def _marked(column: Column) -> Column:
    """Text that is never null: columns of frames would take other types where some values are null."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def _unmarked(text: str) -> str | None:
    return text[1:] if text else None


def newest_rows(
    tx: DataFrame, requests: DataFrame, k: int = 1000, pieces: int = 8, buckets: int = 2048
) -> DataFrame:
    """Requests (``request``, ``asked`` and the account) and, with a null ``request``, up to ``k`` rows per piece
    of the accounts they ask for.

    ``tx``: a stream of transactions with ``pos``; ``requests``: a stream of ``request``,
    an id, and ``address``.  Transactions of a micro-batch count before its requests do.
    A task holds one bucket at a time in memory, what it keeps and what a micro-batch brings it, so ``buckets`` should
    leave each some 20,000 rows.  ``pieces`` and ``buckets`` are part of the state: a checkpoint goes on with the same only.
    """
    # Fields are written once per transaction, before its parties get rows of their own.
    tx = tx.withColumns({c: lower_address(c) for c in ("from_address", "to_address")})
    history = account_rows(tx.select(
        "pos", "from_address", "to_address", safe_int("time_stamp").alias("order_ts"),
        safe_int("block_number").alias("order_block"), safe_int("transaction_index").alias("order_index"),
        _marked(F.col("hash")).alias("order_hash"),
        F.to_json(F.array(*[F.col(c).cast("string") for c in HISTORY_COLUMNS])).alias("fields"),
    ))
    rows = history.select(
        "address", F.pmod(F.xxhash64("pos"), F.lit(pieces)).cast("int").alias("piece"),
        F.lit("").alias("request"), F.lit("").alias("asked"), _marked(F.col("pos")).alias("pos"),
        "order_ts", "order_block", "order_index", "order_hash", "fields",
    )
    none = {"order_ts": 0, "order_block": 0, "order_index": 0, "order_hash": "", "fields": ""}
    named = requests.select(
        F.coalesce(F.lower("address"), F.lit("")).alias("address"),
        F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece"),
        _marked(F.coalesce(F.col("request").cast("string"), F.lit(""))).alias("request"),
        _marked(F.col("address")).alias("asked"), F.lit("").alias("pos"),
        *[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in none.items()],
    )
    bucket = F.pmod(F.xxhash64("address", "piece"), F.lit(buckets)).cast("int")
    kept = rows.unionByName(named).withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_Bucket(k), outputStructType=_OUT, outputMode="Append", timeMode="None"
    )
    fields = F.from_json("fields", T.ArrayType(T.StringType()))
    return kept.withColumn("fields", fields).select(
        "address", "request", "asked", "pos", *[F.col("fields")[i].alias(c) for i, c in enumerate(HISTORY_COLUMNS)]
    )


def deduplicated(requests: DataFrame, asked_at: str = "asked_at", within: str = "1 hour") -> DataFrame:
    """Requests of which each ``request`` id counts once ``within`` the watermark."""
    once = requests.withWatermark(asked_at, within).dropDuplicatesWithinWatermark(["request"])
    return once.select("request", "address")


def answer_stream(
    tx: DataFrame,
    requests: DataFrame,
    answer: Callable[[DataFrame, DataFrame], DataFrame],
    sink: str,
    checkpoint_dir: str,
    k: int = 1000,
    pieces: int = 8,
    strict: bool = False,
    buckets: int = 2048,
) -> StreamingQuery:
    """Answers requests from state, as JSON in a folder per micro-batch.

    ``answer`` makes answers of requested accounts and their rows, which have an
    ``address`` already, e.g. ``lambda good, rows: scan(good, rows, model, keyed=True)``.
    A replayed batch overwrites its folder, and the checkpoint holds the state, so a
    restarted stream goes on where it stopped.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # The state is asked once; what follows reads the rows it gave.
        rows = kept_rows(batch, "newest")
        asked = rows.where(F.col("request").isNotNull()).select("request", F.col("asked").alias("address"))
        good, failed = check_requests(asked, strict)
        history = rows.where(F.col("request").isNull()).drop("request", "asked")
        answer(good, history).write.mode("overwrite").json(f"{sink}/answers/batch={batch_id}")
        failed.write.mode("overwrite").json(f"{sink}/failed/batch={batch_id}")

    return (
        newest_rows(tx, requests, k, pieces, buckets)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
