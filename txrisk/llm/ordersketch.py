"""Order MinHash fingerprints, on DataFrame functions only.

A fingerprint has ``BINS`` components and tells how likely texts are alike up to
edits: it sees which pieces texts share, how often, and in which order.

1. A text is cut in tokens: up to eight characters without white space, with the white space
   before them. ``K`` tokens in a row, fewer at the end of the text, are a k-mer.
2. Every k-mer is numbered by its occurrence, the first, second and so on of its kind, and
   the pair is hashed. Equal k-mers are found by sorting; only repeated ones are counted.
3. Component ``j`` orders all hashes from ``j / BINS`` of their range on, and around to it
   again. It takes the ``TUPLE`` smallest occurrences of that order, puts them back
   into the order of the text and hashes them together. All components come out of
   one sorted list: where a bin is empty, the next one's smallest are its smallest.
4. The likeness of two texts is the share of equal components.

A text is one row, and no text is shuffled for its fingerprint. To see its successor, a
document goes to a bucket of neighbours by doc_id. Buckets begin at rows of a hashed
sample of keys, which decides on the layout and on no result; a bucket's first row is sent to the
bucket before as well.

Null texts are empty, and empty texts are alike. Rows of one doc_id are ordered by the hash of
their texts, null doc_ids come first (beside the smallest long). The last document's
successor is the first, a single one is its own. Texts have any length, equal rows have
equal fingerprints, an empty table gives an empty result, other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm.common import texts

TOKEN = "\\s*+\\S{1,8}+|\\s++"
K = 3
TUPLE = 2
#: Components; a power of two.
BINS = 64

#: Rows of a bucket of neighbours, and buckets at most.
BUCKET_ROWS = 512
BUCKETS = 65_536


def _bin(h: Column, bins: int) -> Column:
    """Which part of the range of longs a hash is in, ascending with it."""
    return F.shiftright(h, 65 - bins.bit_length()) + F.lit(bins // 2)


def _first_of(h: Column, repeats: Column, upto: Column) -> Column:
    """Index of the first of ``repeats``, which are sorted, with hash ``h``; at most ``upto``."""

    def half(acc, _):
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        less = F.get(repeats, middle)["h"] < h
        return F.struct(
            F.when(less, middle + 1).otherwise(acc["low"]).alias("low"),
            F.when(less, acc["high"]).otherwise(middle).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(repeats) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), upto.alias("high"))
    return F.aggregate(steps, start, half, lambda acc: acc["low"])


def with_sketch(
    df: DataFrame, text: str, name: str, k: int = K, size: int = TUPLE, bins: int = BINS
) -> DataFrame:
    """Adds ``name``: the components of the fingerprint of ``text``, as an array of ints."""
    if bins < 2 or bins & (bins - 1):
        raise ValueError("bins must be a power of two")
    own = df.columns
    t, s, r, a, c = (f"_{name}_{x}" for x in "tsrac")

    def starts(x, i, of: str) -> Column:
        """Whether no equal k-mer stands before place ``i``."""
        return (i == 0) | (F.get(F.col(of), i - 1)["h"] != x["h"])

    words = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    df = df.withColumn(t, F.transform(words, lambda w: F.xxhash64(w)))

    def kmer(x, i):
        rest = [F.get(F.col(t), i + d) for d in range(1, k)]
        return F.struct(F.xxhash64(x, *rest).alias("h"), i.alias("p"))

    df = df.withColumn(s, F.sort_array(F.transform(t, kmer)))
    df = df.withColumn(r, F.filter(s, lambda x, i: ~starts(x, i, s)))

    def numbered(x, i):
        # Counted from 0; the first occurrence keeps the hash of the k-mer.
        occurrence = i - _first_of(x["h"], F.col(r), i) + 1
        return F.struct(F.xxhash64(x["h"], occurrence).alias("h"), x["p"].alias("p"))

    firsts = F.filter(s, lambda x, i: starts(x, i, s))
    merged = F.sort_array(F.concat(firsts, F.transform(r, numbered)))
    df = df.withColumn(a, F.when(F.size(r) == 0, F.col(s)).otherwise(merged))
    n = F.size(a)

    def component(x, i):
        new = (i == 0) | (_bin(F.get(F.col(a), i - 1)["h"], bins) != _bin(x["h"], bins))
        taken = F.transform(
            F.sequence(F.lit(0), F.least(F.lit(size), n) - 1),
            lambda d: F.get(F.col(a), F.pmod(i + d, n)),
        )
        in_order = F.sort_array(F.transform(taken, lambda y: F.struct(y["p"], y["h"])))
        value = F.xxhash64(F.transform(in_order, lambda y: y["h"])).bitwiseAND(F.lit(0x7FFFFFFF))
        return F.when(new, F.struct(_bin(x["h"], bins).cast("int").alias("b"), value.cast("int").alias("c")))

    df = df.withColumn(c, F.array_compact(F.transform(a, component)))

    def spread(y, i):
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(F.col(c), i - 1)["b"])
        return F.array_repeat(y["c"], y["b"] - before)

    last = F.get(F.col(c), F.size(c) - 1)["b"]
    around = F.array_repeat(F.get(F.col(c), F.lit(0))["c"], F.lit(bins - 1) - last)
    full = F.concat(F.flatten(F.transform(c, spread)), around)
    # A hash has no sign, so no text with k-mers has these.
    empty = F.array_repeat(F.lit(-1), bins)
    return df.select(*own, F.when(F.size(c) == 0, empty).otherwise(full).alias(name))


def likeness(one: Column, two: Column) -> Column:
    """Share of equal components."""
    same = F.filter(F.zip_with(one, two, lambda x, y: x == y), lambda e: e)
    return F.size(same) / F.size(one)


def written(sketch: Column) -> Column:
    """Components as one text, eight hexadecimal digits each."""
    eight = F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.array_join(eight, "")


def with_next(docs: DataFrame, columns: list[str], rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``next_<column>`` of the next row by ``id, h``, which ``docs`` has; around the end.

    The texts are shuffled once, on the bucket.
    """
    total = docs.count()
    every = max(1, total // min(BUCKETS, max(1, total // rows)))
    # A hashed sample of about BUCKETS keys at most; rows are spread by it and none is left out.
    sampled = F.pmod(F.xxhash64("id", "h", F.lit(7)), F.lit(every)) == 0
    found = docs.agg(
        F.min(F.struct("id", "h")).alias("first"),
        F.collect_set(F.when(sampled, F.struct("id", "h"))).alias("cuts"),
    ).first()
    cuts = sorted({(c["id"], c["h"]) for c in [*found["cuts"], *([found["first"]] if total else [])]})
    cuts = cuts or [(0, 0)]
    ids, hashes = (
        F.split(F.lit(",".join(str(c[i]) for c in cuts)), ",").cast("array<bigint>") for i in (0, 1)
    )

    def half(acc, _):
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        cut, of = F.get(ids, middle), F.get(hashes, middle)
        reached = (acc["low"] < acc["high"]) & (
            (cut < F.col("id")) | ((cut == F.col("id")) & (of <= F.col("h")))
        )
        return F.struct(
            F.when(reached, middle + 1).otherwise(acc["low"]).alias("low"),
            F.when(reached, acc["high"]).otherwise(middle).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.lit(len(cuts).bit_length()))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    bucket = F.aggregate(steps, start, half, lambda acc: acc["low"] - 1)
    placed = docs.withColumn("bucket", bucket)
    opens = (F.get(ids, F.col("bucket")) == F.col("id")) & (F.get(hashes, F.col("bucket")) == F.col("h"))
    placed = placed.withColumn("guest", F.explode(F.when(opens, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    placed = placed.withColumn("bucket", F.pmod(F.col("bucket") - F.col("guest"), F.lit(len(cuts))))
    order = Window.partitionBy("bucket").orderBy("guest", "id", "h")
    led = placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where("guest = 0").drop("guest", "bucket")


def fingerprints(docs: DataFrame, k: int = K, size: int = TUPLE, bins: int = BINS) -> DataFrame:
    """Per document: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by the first
    as many, or all, of the next document.
    """
    rows = texts(docs).select(
        "doc_id", "text", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"), F.xxhash64("text").alias("h")
    )
    rows = with_next(with_sketch(rows, "text", "own", k, size, bins), ["text", "own"])
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left("text", n - half), F.left("next_text", half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    rows = with_sketch(rows, "edited", "changed", k, size, bins)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
