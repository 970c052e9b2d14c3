"""Lines that repeat across documents, found through two Bloom filters.

The key of a line is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in
lower case. Keys of at least ``least`` code points that stand in at least
``documents`` documents lose all their lines except in the largest doc_id.

1. The filters have a bit for every eight bytes of text, some ten a line, up to a fixed
   size; so what goes to the driver and back is bounded. With more keys than the
   filters are made for, more lines are suspects; the result is the same.
   Every task sets bits for the keys of its documents: in "once", or in "twice"
   where "once" had them before. The bit arrays are sent in segments, and per
   segment merged: what two tasks have in "once" is in "twice".
2. Only lines whose bits are all in "twice" leave their task, as keys, once per
   document. Counting the keys confirms the suspects and finds the document
   that keeps its lines.
3. Digests of the confirmed keys go back to the documents that lose them.

A null or empty text is one empty line. Each row is a document; rows with the
same doc_id count one by one, and all rows of the largest doc_id keep their lines.
A null doc_id is smaller than all others. Texts and lines have any length, an empty table gives an
empty result, and other columns stay as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import free, stored, texts

#: Bits of a filter, at least and at most (128 MB), and of a segment.
LEAST_BITS, MOST_BITS = 1 << 21, 1 << 30
SEGMENT_BITS = 1 << 21
PROBES = 3


def line_keys(text: str, least: int) -> list[tuple[int, bytes]]:
    """``(line number, key)`` of the lines whose key is long enough."""
    out = []
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").lower().split(b"\n")):
        key = line.strip()
        # Four bytes a code point at most, so only these need to be counted.
        if len(key) >= least and (
            len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least
        ):
            out.append((i, key))
    return out


def _places(keys, bits: int):
    """Bit positions of keys, one row each."""
    import numpy as np
    import xxhash

    h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
    step = (h >> np.uint64(32)) | np.uint64(1)
    probes = np.arange(PROBES, dtype=np.uint64)
    return (h[:, None] + probes * step[:, None]) & np.uint64(bits - 1)


def _get(array, places):
    import numpy as np

    return (array[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1


def _set(array, places) -> None:
    import numpy as np

    flat = places.ravel()
    np.bitwise_or.at(array, flat >> np.uint64(3), np.uint8(1) << (flat & np.uint64(7)).astype(np.uint8))


def _build(least: int, bits: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for text in batch.column("text"):
                keys = list({k for _, k in line_keys(text.as_py(), least)})
                if keys:
                    # The keys of a document are distinct, so they are asked before
                    # any of them is set.
                    places = _places(keys, bits)
                    seen = _get(once, places).all(axis=1)
                    _set(twice, places[seen])
                    _set(once, places[~seen])
        pack, size = zstandard.ZstdCompressor(1).compress, SEGMENT_BITS // 8
        for s in range(max(1, bits // SEGMENT_BITS)):
            a, b = once[s * size : (s + 1) * size], twice[s * size : (s + 1) * size]
            if a.any():
                yield pa.RecordBatch.from_pydict({
                    "segment": pa.array([s], pa.int32()),
                    "once": pa.array([pack(a.tobytes())], pa.binary()),
                    "twice": pa.array([pack(b.tobytes())], pa.binary()),
                })

    return run


def _merge(batches):
    """Segments come sorted; one at a time is held."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    pack = zstandard.ZstdCompressor(3).compress

    def out():
        return pa.RecordBatch.from_pydict({
            "segment": pa.array([at], pa.int32()), "twice": pa.array([pack(twice.tobytes())], pa.binary()),
        })

    at = once = twice = None
    for batch in batches:
        for s, a, b in zip(*(batch.column(i) for i in range(3))):
            a, b = (np.frombuffer(unpack(x.as_py()), np.uint8) for x in (a, b))
            if s.as_py() != at:
                if at is not None:
                    yield out()
                at, once, twice = s.as_py(), np.zeros_like(a), np.zeros_like(a)
            twice |= b | (once & a)
            once |= a
    if at is not None:
        yield out()


def filter_bits(docs: DataFrame) -> int:
    """A power of two for the size of the texts."""
    total = texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (int(total) // 8).bit_length()))


def repeat_filter(docs: DataFrame, least: int, bits: int) -> bytes:
    """The "twice" filter over all lines of ``docs``; at most ``bits / 8`` bytes."""
    import numpy as np
    import zstandard

    segments = (
        texts(docs).select("text")
        .mapInArrow(_build(least, bits), "segment int, once binary, twice binary")
        .repartition("segment").sortWithinPartitions("segment")
        .mapInArrow(_merge, "segment int, twice binary")
    )
    whole = np.zeros(bits // 8, np.uint8)
    size, unpack = SEGMENT_BITS // 8, zstandard.ZstdDecompressor().decompress
    # One job for all segments; together they are no larger than the filter.
    for row in segments.collect():
        part = np.frombuffer(unpack(bytes(row["twice"])), np.uint8)
        whole[row["segment"] * size : row["segment"] * size + len(part)] = part
    return zstandard.ZstdCompressor(3).compress(whole.tobytes())


def _suspects(shared, least: int, bits: int):
    """``doc_id, key`` of the lines that may repeat, once per document."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import zstandard

        twice = np.frombuffer(zstandard.ZstdDecompressor().decompress(shared.value), np.uint8)
        for batch in batches:
            ids, found = [], []
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                keys = list({k for _, k in line_keys(text.as_py(), least)})
                if keys:
                    maybe = _get(twice, _places(keys, bits)).all(axis=1)
                    found += [keys[j] for j in np.flatnonzero(maybe)]
                    ids += [doc.as_py()] * int(maybe.sum())
            yield pa.RecordBatch.from_pydict(
                {"doc_id": pa.array(ids, pa.int64()), "key": pa.array(found, pa.binary())}
            )

    return run


def losses(docs: DataFrame, least: int = 20, documents: int = 3, bits: int | None = None) -> DataFrame:
    """``doc_id, lost``: digests of the keys whose lines a document loses.

    ``documents`` is 2 or more; the filters do not mark keys of a single document.
    """
    if documents < 2:
        raise ValueError("lines of a single document are not repeats")
    bits = bits or filter_bits(docs)
    shared = docs.sparkSession.sparkContext.broadcast(repeat_filter(docs, least, bits))
    suspects = stored(
        texts(docs).mapInArrow(_suspects(shared, least, bits), "doc_id long, key binary"), "suspects"
    )
    confirmed = stored(
        suspects.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= documents).drop("n"),
        "confirmed",
    )
    lost = suspects.join(confirmed, "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    # 256 bits of each key: lines that only share a digest do not occur.
    lost = lost.groupBy("doc_id").agg(F.collect_set(F.unhex(F.sha2("key", 256))).alias("lost"))
    return stored(lost, "losses")


def _kept(least: int):
    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def kept(text: pd.Series, lost: pd.Series) -> pd.DataFrame:
        from hashlib import sha256

        out = []
        for t, gone in zip(text, lost):
            lines = t.split("\n")
            n = len(lines)
            if gone is not None and len(gone):
                gone = {bytes(x) for x in gone}
                drop = {i for i, k in line_keys(t, least) if sha256(k).digest() in gone}
                lines = [x for i, x in enumerate(lines) if i not in drop]
                t = "\n".join(lines)
            out.append((t, n, n - len(lines)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    return kept


def _applied(docs: DataFrame, name: str, least: int, documents: int, bits: int | None) -> DataFrame:
    """``docs`` with ``name``, a struct of text, n_lines and n_dropped."""
    doc, gone = free(docs, "doc"), free(docs, "lost")
    lost = losses(docs, least, documents, bits).select(F.col("doc_id").alias(doc), F.col("lost").alias(gone))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return (
        docs.join(lost.hint("shuffle_hash"), F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left")
        .withColumn(name, _kept(least)(text, gone))
        .drop(doc, gone)
    )


def clean(docs: DataFrame, least: int = 20, documents: int = 3, bits: int | None = None) -> DataFrame:
    """``docs``, all columns, with the texts that are left.

    A text that loses nothing stays as it is, null too. A column ``n_chars``
    gets the new length.
    """
    name = free(docs, "kept")
    new = _applied(docs, name, least, documents, bits)
    changed, left = F.col(name)["n_dropped"] > 0, F.col(name)["text"]
    out = new.withColumn("text", F.when(changed, left).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn(
            "n_chars",
            F.when(changed, F.length(left).cast(kind)).otherwise(F.col("n_chars")),
        )
    return out.select(*docs.columns)


def summary(docs: DataFrame, least: int = 20, documents: int = 3, bits: int | None = None) -> DataFrame:
    """Per document: ``doc_id, n_lines`` before, ``n_dropped, kept_sha256``."""
    return _applied(docs.select("doc_id", "text"), "kept", least, documents, bits).select(
        F.col("doc_id").cast("long").alias("doc_id"), "kept.n_lines", "kept.n_dropped",
        F.sha2("kept.text", 256).alias("kept_sha256"),
    )
