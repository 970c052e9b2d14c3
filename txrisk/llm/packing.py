"""Packing documents into windows without changing their order.

All ids of the documents in ascending doc_id order form one stream. Windows are
runs of at most ``window`` ids; a cut may be at the end of a document, at the end of
a sentence, or, for a much higher price, at a place of a grid inside a sentence, where no end of a
sentence is near. Dynamic programming finds the cuts with the least sum of padding and prices:

    cost[i] = price[i] + window - at[i] + min(cost[j] + at[j])   for at[i] - at[j] <= window

A monotone queue keeps the candidates of the minimum, so every place enters and
leaves it once. A stream is planned in blocks of whole documents; the last window of a
block is planned again with the next block. What is left at the end of a
partition is split into powers of two, which need no padding, where that is cheaper.

Which documents share a partition is up to the sampling of Spark's range partitioning, so
two runs may cut differently where partitions meet; each is a whole packing.

A null or empty text is the end id alone, texts have any length. Rows with the same doc_id stand
side by side in the order of a hash of their texts, repeated rows each with pieces of its own; a null doc_id comes
first. An empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import stored, texts
from txrisk.llm.tokens import encoder

WINDOW = 2048
#: Places inside sentences where a cut is allowed; divides the window.
GRID = 32
#: Price of a cut, in ids of padding: inside a document after a sentence, and inside a sentence.
SENTENCE, INSIDE = 4, 48
#: Pieces that a worker keeps the ids of, in each of two generations (some 80 MB in all, which the
#: stages of a pipeline that follow in the same workers have to do without).
PIECES = 200_000
#: Ids planned together, at least.
BLOCK = 1 << 19

SCHEMA = (
    "shard int, sequence long, offset long, doc_id long, start long, length long, "
    "ids_crc32 long, doc_tokens long"
)


def cuts(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW) -> list[int]:
    """The cheapest cuts of ``n`` ids, from 0 to ``n``; the last window costs no padding."""
    # Per place: no cut, or the kind of it that costs least.
    kind = np.zeros(n + 1, np.int8)
    kind[GRID:n:GRID] = 1
    kind[sentence_ends[sentence_ends <= n]] = 2
    kind[doc_ends[doc_ends <= n]] = 3
    kind[0], kind[n] = 0, 3
    at = np.flatnonzero(kind)
    price = np.array([0, INSIDE, SENTENCE, 0])[kind[at]] + window
    places, prices = [0, *at.tolist()], [0, *price.tolist()]
    # A queue of places from ``first`` on, rising in cost + place.
    queue, first = [0], 0
    back, values = [0] * len(places), [0] * len(places)
    for i in range(1, len(places)):
        least = places[i] - window
        j = queue[first]
        while places[j] < least:
            first += 1
            j = queue[first]
        back[i] = j
        values[i] = value = prices[i] + values[j]
        while len(queue) > first and values[queue[-1]] >= value:
            queue.pop()
        queue.append(i)
    out, i = [n], len(places) - 1
    while i:
        i = back[i]
        out.append(places[i])
    return out[::-1]


def tail(n: int, window: int = WINDOW) -> list[int]:
    """Sizes of the windows of the last ``n`` ids."""
    powers = [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]
    return powers if INSIDE * (len(powers) - 1) < window - n else [n]


class Packer:
    """Takes documents in order; gives pieces ``(sequence, offset, doc, start, length, crc, tokens)``."""

    def __init__(self, sentence_ids, window: int = WINDOW):
        self.window, self.sentence_ids = window, sentence_ids
        self.parts: list[tuple] = []  # doc, ids left, start of these in the document, its tokens
        self.size = self.sequence = 0

    def add(self, doc, ids: np.ndarray):
        self.parts.append((doc, ids, 0, len(ids)))
        self.size += len(ids)
        if self.size >= BLOCK + self.window:
            yield from self._plan(last=False)

    def finish(self):
        if self.size:
            yield from self._plan(last=True)

    def _plan(self, last: bool):
        ids = np.concatenate([p[1] for p in self.parts])
        ends = np.cumsum([len(p[1]) for p in self.parts])
        sentences = np.flatnonzero(np.isin(ids, self.sentence_ids)) + 1
        at = cuts(len(ids), ends, sentences, self.window)
        if last:
            sizes = tail(at[-1] - at[-2], self.window)
            at = [*at[:-1], *(at[-2] + np.cumsum(sizes)).tolist()]
        else:
            at = at[:-1]
        begins = (ends - [len(p[1]) for p in self.parts]).tolist()
        ends = ends.tolist()
        k = 0
        for low, high in zip(at, at[1:]):
            here = low
            while here < high:
                while ends[k] <= here:
                    k += 1
                doc, _, start, tokens = self.parts[k]
                stop = min(high, ends[k])
                yield (
                    self.sequence, here - low, doc, start + here - begins[k], stop - here,
                    zlib.crc32(ids[here:stop].data), tokens,
                )
                here = stop
            self.sequence += 1
        kept = []
        for (doc, part, start, tokens), begin, end in zip(self.parts, begins, ends):
            if end > at[-1]:
                skip = max(0, at[-1] - begin)
                kept.append((doc, part[skip:], start + skip, tokens))
        self.parts, self.size = kept, len(ids) - at[-1]


def _packed(path: str, end_id: int, window: int, drops_space: bool):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coder = encoder(path, drops_space, PIECES)
        ends = [np.frombuffer(coder.whole(x), "<u4") for x in ".!?"]
        packer = Packer(np.array([x[0] for x in ends if len(x) == 1], np.uint32), window)
        shard = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        names = ["sequence", "offset", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]

        def out(rows):
            columns = dict(zip(names, (pa.array(x, pa.int64()) for x in zip(*rows))))
            first = {"shard": pa.array([shard] * len(rows), pa.int32())}
            return pa.RecordBatch.from_pydict(first | columns)

        rows = []
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.ids(texts)):
                rows += packer.add(doc, np.frombuffer(ids + end, "<u4"))
                if len(rows) > 10_000:
                    yield out(rows)
                    rows = []
        rows += packer.finish()
        if rows:
            yield out(rows)

    return run


def in_order(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in ascending order over as many partitions as the input has.

    The texts of one id are ordered by a hash, so very many of them are several partitions.
    """
    plain = texts(docs).withColumn("h", F.xxhash64("text"))
    n = max(1, docs.rdd.getNumPartitions())
    return plain.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")


def pack(
    docs: DataFrame, path: str, end_id: int = 1, window: int = WINDOW, drops_space: bool = True
) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``path``: a tokenizer file; ``end_id`` goes behind each document. Sequences are
    numbered in the order of the stream.
    """
    pieces = stored(in_order(docs).mapInArrow(_packed(path, end_id, window, drops_space), SCHEMA), "pieces")
    # One row per shard: how many sequences the shards before it have.
    sizes = pieces.groupBy("shard").agg((F.max("sequence") + 1).alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return pieces.join(F.broadcast(first), "shard").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("sequence")).alias("sequence_id"), "offset",
    )
