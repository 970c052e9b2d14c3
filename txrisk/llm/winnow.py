"""Benchmark decontamination by winnowing, on DataFrame functions only.

The words of a text are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became
lower case. A window is ``span`` words in a row of a benchmark item; an item of
fewer words, but not none, is one window. A document word inside an occurrence of a
window is hit.

1. Fingerprints: every run of ``span`` words is marked by the smallest of its four-word
   hashes, which is the same in any text that holds the run. Windows of fewer words
   are marked by the hash of all of them. Neighbouring runs mostly share their smallest
   hash, and a document keeps each one once.
2. The fingerprints of documents meet those of the benchmark. A benchmark of a counted,
   bounded size is broadcast, and documents are read once, words counted on the way, and
   not shuffled; for a larger one fingerprints are shuffled, each once per document.
3. A known fingerprint is extended over all runs that it marks: their words are taken
   from the text and compared with the windows' words. So every shared run is found.

Words are hashed in full lower case, which only adds candidates; what is compared is the
text with A-Z in lower case.

Null texts and texts without words have no hits; rows that share a doc_id are
judged one by one, equal rows alike. Texts have any length; windows that stand in many
items or places count for each of them. An empty benchmark contaminates nothing, an
empty table of documents gives an empty result. Nothing depends on other columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import at_most, free, stored

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same before A-Z became lower case.
RAW_WORD = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAM = 4

#: Benchmark windows that are broadcast (about 100 MB); more of them are shuffled.
BROADCAST_ROWS = 500_000


def words_of(text: str) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def raw_words_of(text: str) -> Column:
    """The words as they are written."""
    return F.regexp_extract_all(text, F.lit(RAW_WORD), F.lit(0))


def _pairs(left: Column, right: Column, skip: int, how) -> Column:
    """``how(left[i], right[i + skip])`` for all places that exist in both."""
    n = F.greatest(F.size(right) - skip, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, skip + 1, n), how)


def _hash(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def _less(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _grams(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``g<n>``: hash of ``n`` words from each place on, for all ``lengths``.

    Doubling: runs of 1, 2, 4, 8 words, and each length out of those.
    """
    df = df.withColumn("g1", F.transform("words", lambda w: F.xxhash64(F.lower(w))))
    size = 1
    made = {1}
    while size * 2 <= max(lengths):
        half = F.col(f"g{size}")
        df = df.withColumn(f"g{size * 2}", _pairs(half, half, size, _hash))
        size *= 2
        made.add(size)
    for n in sorted(set(lengths) - made):
        # From the largest run downwards, e.g. 13 = 8 + 4 + 1.
        sizes = [s for s in sorted(made & {1, 2, 4, 8, 16, 32, 64, 128}, reverse=True) if n & s]
        at, whole = sizes[0], F.col(f"g{sizes[0]}")
        for s in sizes[1:]:
            whole = _pairs(whole, F.col(f"g{s}"), at, _hash)
            at += s
        df = df.withColumn(f"g{n}", whole)
    return df


def _smallest(df: DataFrame, name: str, run: int) -> DataFrame:
    """Add ``m``: the minima of every ``run`` values in a row of ``name``."""
    df, size = df.withColumn("m", F.col(name)), 1
    while size * 2 <= run:
        df = df.withColumn("m", _pairs(F.col("m"), F.col("m"), size, _less))
        size *= 2
    if size < run:
        df = df.withColumn("m", _pairs(F.col("m"), F.col("m"), run - size, _less))
    return df


def minima(df: DataFrame, size: int, span: int) -> DataFrame:
    """Add ``m``: for each place the fingerprint of the ``size`` words from there on.

    ``df`` has ``words``. For ``span`` words it is the smallest gram among them, for a
    shorter window its only gram, mixed with the length.
    """
    if size == span:
        return _smallest(_grams(df, [GRAM]), f"g{GRAM}", span - GRAM + 1)
    return _grams(df, [size]).withColumn(
        "m", F.transform(f"g{size}", lambda g: F.xxhash64(g, F.lit(size)))
    )


def windows(benchmark: DataFrame, span: int) -> DataFrame:
    """``item_id, size, window``: every window once per item."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), words_of("text").alias("words")
    ).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(span))
    places = F.sequence(F.lit(1), F.size("words") - size + 1)
    return items.select(
        "item_id", size.alias("size"), F.explode(
            F.transform(places, lambda p: F.array_join(F.slice("words", p, size), " "))
        ).alias("window"),
    ).distinct()


def _row() -> Column:
    """What tells documents apart; equal rows share it, so they get equal results."""
    doc_id = F.col("doc_id").cast("long")
    return F.struct(
        doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"),
        F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("h"),
    )


def rows_of(docs: DataFrame) -> DataFrame:
    """``row, text``; a null text is empty."""
    return docs.select(_row().alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _windows_at(df: DataFrame, size: int) -> DataFrame:
    """Adds ``size`` and ``window``, the words from ``place`` on, for ``df`` with ``words, place``."""
    text = F.translate(F.array_join(F.slice("words", F.col("place") + 1, size), " "), UPPER, LOWER)
    return df.withColumns({"size": F.lit(size), "window": text})


#: Stands among the fingerprints of a document once, to count its words; no harm if one equals it.
_COUNT = 0x5EED


def _marked(docs: DataFrame, known: DataFrame, size: int, span: int) -> DataFrame:
    """``row, n_words, place, window``: places of known fingerprints, and one row without a place for
    every document.

    Each fingerprint is looked up once per document, and where it is known, extended over
    all its places.
    """
    df = minima(docs.select("row", raw_words_of("text").alias("words")), size, span)
    # The outer form keeps the planner from testing the array a second time.
    once = F.explode_outer(F.concat(F.array(F.lit(_COUNT).cast("long")), F.array_distinct("m")))
    df = df.select("row", "words", "m", once.alias("fp"))
    found = df.join(F.broadcast(known), "fp", "left_semi")
    every = F.sequence(F.lit(0), F.size("m") - 1)
    own = F.filter(every, lambda i: F.get(F.col("m"), i) == F.col("fp"))
    # A text shorter than a window has no places, and the row that counts has none.
    places = F.when((F.size("m") > 0) & (F.col("fp") != _COUNT), own)
    found = found.select("row", "words", "fp", F.explode_outer(places).alias("place"))
    counts = F.when(F.col("fp") == _COUNT, F.size("words"))
    found = found.withColumn("n_words", counts)
    return _windows_at(found, size).select("row", "n_words", "place", "window")


def occurrences(docs: DataFrame, benchmark: DataFrame, span: int = 13):
    """``(hits, wins, counts)`` for ``docs`` as ``rows_of`` gives them.

    ``hits``: ``row, place, size, window``, every place (from 0) where a window occurs;
    ``wins``: ``item_id, size, window``; ``counts``: ``row, n_words``, one for every document.
    """
    if not GRAM < span < 256:
        raise ValueError("span must be between 5 and 255 words")
    wins = stored(windows(benchmark, span), "windows")
    sides = stored(wins.select("size", "window").distinct(), "sides")
    # At most span numbers.
    sizes = sorted(r[0] for r in sides.select("size").distinct().collect())
    counts = docs.select("row", F.size(raw_words_of("text")).alias("n_words"))
    none = docs.select("row", F.lit(0).alias("place"), F.lit(0).alias("size"), F.col("text").alias("window"))
    small = at_most(sides, BROADCAST_ROWS)
    found = [none.limit(0)]
    for i, size in enumerate(sizes):
        own = sides.where(F.col("size") == size)
        known = minima(own.withColumn("words", F.split("window", " ")), size, span)
        known = known.select(F.explode_outer("m").alias("fp"))
        if small:
            # The first pass counts the words of all documents as well.
            if not i:
                known = known.union(known.sparkSession.range(1).select(F.lit(_COUNT).cast("long")))
            known = stored(known.distinct(), "known")
            marked = stored(_marked(docs, known, size, span), "marked")
            if not i:
                counts = marked.where(F.col("n_words").isNotNull()).select("row", "n_words")
            places = marked.where(F.col("place").isNotNull()).withColumn("size", F.lit(size))
            own = F.broadcast(own)
        else:
            places = _shuffled_places(docs, stored(known.distinct(), "known"), size, span)
            places = _windows_at(places, size)
        found.append(
            places.select("row", "place", "size", "window").join(own, ["size", "window"], "left_semi")
        )
    hits = reduce(DataFrame.union, [f.select("row", "place", "size", "window") for f in found])
    return stored(hits.distinct(), "hits"), wins, counts


def _shuffled_places(docs: DataFrame, known: DataFrame, size: int, span: int) -> DataFrame:
    """``row, words, place`` of the known fingerprints of a benchmark that is not small.

    Fingerprints travel without their texts: first each one once per document, to find
    the documents, then with their places, for these documents only.
    """
    def marked(df):
        return minima(df.select("row", raw_words_of("text").alias("words")), size, span)

    once = marked(docs).select("row", F.explode_outer(F.array_distinct("m")).alias("fp"))
    suspects = stored(once.join(known, "fp", "left_semi").select("row").distinct(), "suspects")
    some = stored(docs.join(suspects, "row", "left_semi").select("row", "text"), "suspects")
    places = marked(some).select("row", F.posexplode_outer("m").alias("place", "fp"))
    places = places.join(known, "fp", "left_semi").groupBy("row").agg(
        F.collect_set("place").alias("places")
    )
    return some.join(places, "row").select(
        "row", raw_words_of("text").alias("words"), F.explode("places").alias("place")
    )


def _covered(spans: Column) -> Column:
    """How many places the sorted spans ``(place, size)`` cover together."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def step(acc, s):
        end = s["place"] + s["size"]
        new = end - F.greatest(s["place"], acc["end"])
        return F.struct(
            (acc["n"] + F.greatest(new, F.lit(0))).alias("n"), F.greatest(end, acc["end"]).alias("end")
        )

    return F.aggregate(spans, start, step, lambda acc: acc["n"].cast("long"))


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 13) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    ``n_items``: items with windows that occur; ``contaminated``: ``n_hit > 0 and
    20 * n_hit >= n_words``.
    """
    return _judged(rows_of(docs), benchmark, span).drop("row")


def _judged(rows: DataFrame, benchmark: DataFrame, span: int) -> DataFrame:
    hits, wins, n_words = occurrences(rows, benchmark, span)
    words = hits.groupBy("row").agg(
        _covered(F.sort_array(F.collect_list(F.struct("place", "size")))).alias("n_hit")
    )
    # Per document and distinct window first, so that a window that stands in many
    # places meets its items once.
    items = (
        hits.select("row", "size", "window").distinct()
        .join(F.broadcast(wins) if at_most(wins, BROADCAST_ROWS) else wins, ["size", "window"])
        .select("row", "item_id").distinct()
        .groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    )
    counts = words.join(items, "row", "left")
    none = F.array().cast("array<string>")
    counts = stored(counts, "counts")
    doc_id = F.when(~F.col("row.none"), F.col("row.id"))
    return n_words.join(counts, "row", "left").select(
        "row", doc_id.alias("doc_id"),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.coalesce(
            (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")), F.lit(False)
        ).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, span: int = 13) -> DataFrame:
    """``docs``, all columns, without the contaminated documents."""
    name = free(docs, "row")
    bad = _judged(rows_of(docs), benchmark, span).where("contaminated").select(F.col("row").alias(name))
    bad = stored(bad.distinct(), "contaminated")
    return docs.join(bad, _row() == F.col(name), "left_anti")
