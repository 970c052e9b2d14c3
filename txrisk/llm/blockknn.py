"""Exact nearest neighbours by inner product, through int8 tiles with error bounds.

Vectors and queries are dealt into blocks; every block of vectors meets every block of
queries once, in a tile. A tile multiplies int8 codes: for ``x = s q + e`` with
codes ``q``, scale ``s`` and rest ``e`` the product of two vectors is

    sx sy <qx, qy>   up to   |ex| |y| + |sx qx| |ey|

so each pair has a lower and an upper bound. Pairs whose upper bound is below the
k-th largest lower bound of their query cannot be among its k nearest; the others are
computed again in double precision on the original vectors, and the k best of the
tile go on. The tiles' lists are merged per query, by a heap of k.

Tiles are bounded by ``ROWS`` vectors and ``QUERIES`` queries of one length, whatever the table
holds. Nearness ties go to the smaller id. Null or empty vectors, zero vectors, vectors with
null or non-finite components and rows with a null id take no part; vectors of
different lengths do not meet. Rows that share an id are vectors of their own,
told apart by their components; a query's own id is no candidate. Empty tables on either side
give an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import stored

ROWS, QUERIES = 8_192, 1_024
#: Most code components that 32-bit floats add up exactly: 127 * 127 * 1040 < 2 ** 24.
EXACT = 1040


def usable(vector: Column) -> Column:
    """Whether a vector is there, finite and not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _codes(x):
    """Codes, scales, norms of the coded parts, of the rests and of the whole vectors."""
    import numpy as np

    top = np.abs(x).max(axis=1)
    scale = top / 127.0
    scale = np.where(scale > 0, scale, np.finfo(float).tiny)
    code = np.rint(x / scale[:, None]).clip(-127, 127)
    rest = x - code * scale[:, None]
    norm = lambda v: np.linalg.norm(v, axis=1)
    # A little more than computed, for the rounding of the bounds themselves.
    return code.astype(np.int8), scale, norm(code) * scale, norm(rest) * (1 + 1e-9) + top * 1e-13, norm(x)


def _products(q, x):
    """Products of int8 codes, exact: runs of components that floats add without rounding."""
    import numpy as np

    out = np.zeros((len(q), len(x)))
    for at in range(0, q.shape[1], EXACT):
        out += q[:, at : at + EXACT].astype(np.float32) @ x[:, at : at + EXACT].astype(np.float32).T
    return out


def _scores(queries, vectors):
    """Inner products of rows in double precision, added in the order of the components."""
    import numpy as np

    out = np.zeros(len(queries))
    for i in range(queries.shape[1]):
        out += queries[:, i] * vectors[:, i]
    return out


def nearest_in_tile(q_ids, queries, ids, vectors, k: int):
    """``(query index, vector index, score)`` of the ``k`` nearest of each query in the tile."""
    import numpy as np

    qc, qs, qn, qe, qw = _codes(queries)
    xc, xs, xn, xe, xw = _codes(vectors)
    found = []
    for low in range(0, len(queries), 128):
        part = slice(low, low + 128)
        middle = _products(qc[part], xc) * qs[part, None] * xs
        error = qe[part, None] * xw + qn[part, None] * xe
        own = q_ids[part, None] == ids
        lower = np.where(own, -np.inf, middle - error)
        if len(ids) > k:
            kth = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k]
        else:
            kth = np.full(len(lower), -np.inf)
        i, j = np.nonzero(~own & (middle + error >= kth[:, None]))
        score = _scores(queries[low + i], vectors[j])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        found.append((low + i[keep], j[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _tile(k: int):
    def run(key, left, right):
        import numpy as np
        import pandas as pd

        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"}
        )
        if not len(left) or not len(right):
            return none
        queries, vectors = (np.stack(x["v"].to_numpy()).astype(np.float64) for x in (left, right))
        q_ids, ids = left["id"].to_numpy(np.int64), right["id"].to_numpy(np.int64)
        i, j, score = nearest_in_tile(q_ids, queries, ids, vectors, k)
        return pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[j], "score": score})

    return run


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, rows: int = ROWS, per_tile: int = QUERIES
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each query.

    Both inputs: ``vec_id, embedding``.
    """

    def plain(df):
        v = F.col("embedding").cast("array<double>")
        return df.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where(
            F.col("id").isNotNull() & usable(v)
        )

    left, right = plain(queries), plain(vectors)
    # Block numbers from a hash over as many blocks as the counts ask for.
    sizes = {
        name: {r["d"]: r["n"] for r in df.groupBy(F.size("v").alias("d")).count().withColumnRenamed("count", "n").collect()}
        for name, df in (("left", left), ("right", right))
    }

    def blocks(name, most):
        out = F.lit(1)
        for d, n in sorted(sizes[name].items()):
            out = F.when(F.size("v") == d, -(-n // most)).otherwise(out)
        return out

    def block(name, most):
        return F.pmod(F.xxhash64("id", "v"), blocks(name, most)).cast("int")

    q = left.select(
        F.size("v").alias("d"), block("left", per_tile).alias("qb"), "id", "v",
        F.explode(F.sequence(F.lit(0), blocks("right", rows) - 1)).alias("xb"),
    )
    x = right.select(
        F.size("v").alias("d"), block("right", rows).alias("xb"), "id", "v",
        F.explode(F.sequence(F.lit(0), blocks("left", per_tile) - 1)).alias("qb"),
    )
    keys = ["d", "qb", "xb"]
    tiles = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(
        _tile(k), "query_id long, vec_id long, score double"
    )
    return merged(stored(tiles, "tiles"), k)


def merged(lists: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query over the tiles' lists, with their ranks.

    The entries of a query pass through a heap of ``k``, the worst one on top.
    """

    def run(batches):
        import heapq

        import pyarrow as pa

        names = ["query_id", "rank", "vec_id", "score"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
        done: list[tuple] = []

        def out():
            columns = zip(*done) if done else [()] * 4
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            done.clear()
            return batch

        def close():
            for rank, (score, vec) in enumerate(sorted(heap, reverse=True), 1):
                done.append((query, rank, -vec, score))

        query, heap = None, []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("query_id", "vec_id", "score")]
            for q, vec, score in zip(*columns):
                if q != query:
                    close()
                    query, heap = q, []
                entry = (score, -vec)  # ties go to the smaller id
                if len(heap) < k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(done) > 10_000:
                yield out()
        close()
        yield out()

    rows = lists.repartition("query_id").sortWithinPartitions("query_id")
    return rows.mapInArrow(run, "query_id long, rank int, vec_id long, score double")
