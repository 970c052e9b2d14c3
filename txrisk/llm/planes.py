"""Token ids in files of compressed planes.

Ids of documents in ascending doc_id order, an end id behind each, are cut into blocks of a fixed
number of ids. A block is transposed into planes, one for each byte or bit of the
ids, and each plane is compressed by itself: the upper planes of small
vocabularies are nearly empty. The files are Parquet with one row per block:

    shard, block    the place of the block; shards are in doc_id order
    n_ids           ids in the block; all but a shard's last have the same number
    width           planes: 4 of bytes or 32 of bits
    planes          the compressed planes, lowest first
    index           array of (doc_id, first, from, to): the pieces of documents in the
                    block, with the document's first id in the shard

so that a reader finds documents by the index without decoding other blocks, and
no reader needs more than a block at once.

A null or empty text is the end id alone; a text of any length goes through as many blocks as it
needs. Rows with the same doc_id stand side by side in the order of a hash of their texts, repeated rows each
with ids of its own; a null doc_id comes first. An empty table gives files without blocks; other
columns are not looked at.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txrisk.llm.packing import in_order
from txrisk.llm.tokens import encoder

BLOCK_IDS = 1 << 16
#: Pieces that a worker keeps the ids of, in each of two generations (some 250 MB in all).
PIECES = 600_000
SCHEMA = (
    "shard int, block int, n_ids int, width int, planes array<binary>, "
    "index array<struct<doc_id: long, first: long, `from`: int, `to`: int>>"
)


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of unsigned 32-bit ids, lowest first."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        rows = np.unpackbits(rows, axis=1, bitorder="little")
        return [np.packbits(rows[:, i]).tobytes() for i in range(32)]
    return [rows[:, i].tobytes() for i in range(4)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 32:
        rows = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1)
        return np.packbits(rows, axis=1, bitorder="little").reshape(-1).view("<u4")
    return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")


def _encoded(path: str, end_id: int, block: int, bits: bool, level: int, drops_space: bool):
    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        coder, pack = encoder(path, drops_space, PIECES), zstandard.ZstdCompressor(level).compress
        shard, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        kind = pa.list_(pa.struct(
            [("doc_id", pa.int64()), ("first", pa.int64()), ("from", pa.int32()), ("to", pa.int32())]
        ))
        held, number = bytearray(), 0
        # Columns of the index: document, first id, from, to.
        index = [array("q"), array("q"), array("i"), array("i")]
        nulls = []

        def entry(doc, first, low, high):
            if doc is None:
                nulls.append(len(index[0]))
            for column, value in zip(index, (doc or 0, first, low, high)):
                column.append(value)

        def out(size):
            planes = [pack(p) for p in to_planes(np.frombuffer(held, "<u4", size), bits)]
            docs = np.frombuffer(index[0], "<i8")
            missing = np.zeros(len(docs), bool)
            missing[nulls] = True
            entries = pa.StructArray.from_arrays(
                [pa.array(docs, pa.int64(), mask=missing), pa.array(np.frombuffer(index[1], "<i8")),
                 *[pa.array(np.frombuffer(c, "<i4")) for c in index[2:]]],
                fields=list(kind.value_type),
            )
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([number], pa.int32()),
                "n_ids": pa.array([size], pa.int32()), "width": pa.array([len(planes)], pa.int32()),
                "planes": pa.array([planes], pa.list_(pa.binary())),
                "index": pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), entries),
            })

        for batch in batches:
            texts = batch.column("text").to_pylist()
            for doc, ids in zip(batch.column("doc_id").to_pylist(), coder.ids(texts)):
                ids += end
                first, done, left = number * block + len(held) // 4, 0, len(ids) // 4
                while left:
                    here = len(held) // 4
                    take = min(block - here, left)
                    held += ids[done * 4 : (done + take) * 4]
                    entry(doc, first, here, here + take)
                    done, left = done + take, left - take
                    if here + take == block:
                        made = out(block)
                        held, number = bytearray(), number + 1
                        index = [array("q"), array("q"), array("i"), array("i")]
                        nulls = []
                        yield made
        if held:
            yield out(len(held) // 4)

    return run


def write_ids(
    docs: DataFrame, folder: str, path: str, end_id: int = 0, block: int = BLOCK_IDS,
    bits: bool = False, level: int = 3, drops_space: bool = False,
) -> None:
    """Encode whole texts with the tokenizer file ``path`` and write the planes."""
    rows = in_order(docs).mapInArrow(_encoded(path, end_id, block, bits, level, drops_space), SCHEMA)
    rows.write.option("compression", "none").parquet(folder)


def read_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def _decoded(rows, want):
    """``want(ids, entry)`` of every piece of every block, block by block."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for row in rows:
        ids = from_planes([unpack(p) for p in row["planes"]], row["n_ids"])
        for e in row["index"]:
            yield row, e, want(ids[e["from"] : e["to"]])


def _records(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: batch.column(c)[i].as_py() for c in batch.schema.names}


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids``: whole documents, read back from the planes."""
    import pyarrow as pa

    def run(batches):
        for row, e, ids in _decoded(_records(batches), lambda x: x.tobytes()):
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([row["shard"]], pa.int32()), "block": pa.array([row["block"]], pa.int32()),
                "doc_id": pa.array([e["doc_id"]], pa.int64()), "first": pa.array([e["first"]], pa.int64()),
                "ids": pa.array([ids], pa.binary()),
            })

    pieces = read_blocks(spark, folder).mapInArrow(
        run, "shard int, block int, doc_id long, first long, ids binary"
    )
    whole = pieces.groupBy("shard", "first", "doc_id").agg(
        F.array_sort(F.collect_list(F.struct("block", "ids"))).alias("p")
    )
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return _from_start(spark, folder, whole.withColumn("ids", joined).drop("p"))


def _from_start(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Add ``start``, the ids before the document over all shards, and drop the shard."""
    # One row per shard, from the index columns alone.
    sizes = read_blocks(spark, folder).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(first), "shard").select(
        "doc_id", (F.col("before") + F.col("first")).alias("start"),
        *[c for c in rows.columns if c not in ("shard", "first", "doc_id")],
    )


def _times(matrix, vector: int) -> int:
    out = i = 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def crc_joined(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings one after the other; ``size``: bytes of the second.

    Running zero bytes through the register is linear, so it is a matrix over two
    elements, squared for each bit of ``size``.
    """
    matrix = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        matrix = [_times(matrix, x) for x in matrix]  # one zero byte
    while size:
        if size & 1:
            first = _times(matrix, first)
        matrix = [_times(matrix, x) for x in matrix]
        size >>= 1
    return first ^ second


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the files, without moving any ids.

    Pieces give their checksums; documents that span blocks join theirs.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("shard", "block", "doc_id", "first", "n", "crc")}
            for row, e, crc in _decoded(_records([batch]), lambda x: zlib.crc32(x.tobytes())):
                for k, v in zip(out, (row["shard"], row["block"], e["doc_id"], e["first"], e["to"] - e["from"], crc)):
                    out[k].append(v)
            kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, v), t in zip(out.items(), kinds)})

    pieces = read_blocks(spark, folder).mapInArrow(
        run, "shard int, block int, doc_id long, first long, n long, crc long"
    )

    @F.pandas_udf("long")
    def joined(parts: pd.Series) -> pd.Series:
        out = []
        for p in parts:
            if p is None:
                out.append(None)
                continue
            crc = p[0]["crc"]
            for x in p[1:]:
                crc = crc_joined(crc, x["crc"], x["n"] * 4)
            out.append(crc)
        return pd.Series(out, dtype="Int64")

    whole = pieces.groupBy("shard", "first", "doc_id").agg(
        F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("block", "n", "crc"))).alias("p"),
    )
    # Most documents are one piece, and its checksum is theirs.
    several = joined(F.when(F.size("p") > 1, F.col("p")))
    crc = F.coalesce(several, F.get("p", F.lit(0))["crc"])
    return _from_start(spark, folder, whole.withColumn("ids_crc32", crc).drop("p"))
