"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two different words are one inserted, deleted or replaced code point apart if their
common prefix and common suffix together reach the longer length minus one.

1. Tables of words and how often they occur come from whole texts, counted with map-side
   combine; only distinct words go on.
2. A word of ``l`` code points is cut in ``PIECES`` pieces. One edit leaves all pieces but
   one as they are, so near words agree on everything outside some piece. Words that
   do are a bucket; a word stands in the buckets of its own length, and in those of
   the length below, as the longer partner.
3. In a bucket, words are rows of a matrix of code points, padded once at the end and
   once at the start. Rows are compared block against block: where they first differ
   gives the common prefix, where they last differ the common suffix. A pair is taken
   in the first piece that explains it, so each one is found once.
4. A bucket of more than ``BLOCK`` words (fewer for very long words, by ``CELLS``) is cut
   into blocks by a hash of the word, and each pair of blocks is a tile of its own. No
   task holds more than a few blocks.

Nulls, empty texts and empty tables give no words; repeated rows count again, as their
occurrences do. Runs of any length are words; ties between forms go to the smallest word
in code-point order. Other columns of the documents are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import at_most, stored
from txrisk.llm.sqlparts import CRC_TABLE, crc32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of letters, A-Z being lower case by then.
RUN = "[a-z\\u00C0-\\u00FF]+"

#: Pieces of a word, of which near words share all but one.
PIECES = 4
#: Words of a block, and cells of its matrix.
BLOCK = 1_024
CELLS = 1 << 20
#: Large buckets that are broadcast as a list (two numbers each).
LISTED = 200_000


def runs(docs: DataFrame) -> DataFrame:
    """``doc_id, run``: the runs of letters of whole texts, in lower case as far as A-Z goes."""
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    # The outer form keeps the planner from finding the runs twice.
    return docs.select("doc_id", F.explode_outer(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0))).alias("run"))


def misspelt(rows: DataFrame, every: int = 31) -> DataFrame:
    """Runs as words, where one in ``every`` lost a code point: the one that the crc32 of
    ``<doc_id>:<run>`` points at. A null doc_id counts as empty."""
    said = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    h, size = F.col("h"), F.char_length("run")
    at = F.pmod(h, size).cast("int")
    short = F.concat(F.expr("left(run, int(pmod(h, char_length(run))))"), F.substring("run", at + 2, size))
    return rows.withColumn("h", F.crc32(F.encode(said, "UTF-8"))).select(
        F.when(F.pmod(h, F.lit(every)) == 0, short).otherwise(F.col("run")).alias("word")
    )


def counted(words: DataFrame, least_length: int = 7, least: int = 2) -> DataFrame:
    """``word, n``: distinct words of enough code points that occur often enough."""
    return (
        words.where(F.char_length("word") >= least_length)
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    )


def _bounds(size: Column, piece: Column, pieces: int) -> tuple[Column, Column]:
    """Where a piece of a word of ``size`` code points begins and ends."""
    low = F.floor(size * piece / pieces).cast("int")
    return low, F.floor(size * (piece + 1) / pieces).cast("int")


def _placed(words: DataFrame, pieces: int, least: int) -> DataFrame:
    """``word, n, size, piece, key``: every word in all its buckets."""
    rows = words.select(
        "word", "n", F.char_length("word").alias("chars"), F.explode(F.array(F.lit(0), F.lit(1))).alias("less")
    ).select("word", "n", "chars", (F.col("chars") - F.col("less")).alias("size"))
    rows = rows.where(F.col("size") >= least).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("piece")
    )
    low, high = _bounds(F.col("size"), F.col("piece"), pieces)
    before = F.substring("word", F.lit(1), low)
    rest = F.col("chars") - (F.col("size") - high)
    after = F.substring("word", rest + 1, F.col("chars"))
    return rows.select(
        "word", "n", "size", "piece", F.xxhash64("size", "piece", before, after).alias("key")
    )


def _tiled(rows: DataFrame, block: int, cells: int) -> DataFrame:
    """Adds ``block`` and ``tile``; a word of a large bucket stands in a tile with every block."""
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(cells) / (F.col("size") + 1))))
    counts = rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("words"))
    large = stored(
        counts.where(F.col("words") > most).select("key", F.ceil(F.col("words") / most).alias("blocks")),
        "buckets",
    )
    # Different buckets may share a hash.
    large = large.groupBy("key").agg(F.max("blocks").alias("blocks"))
    if at_most(large, LISTED):
        large = F.broadcast(large)
    rows = rows.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")))
    others = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return rows.withColumn("other", F.explode(others)).select(
        "key", "size", "piece", "word", "n", "block",
        (low * F.col("blocks") + high).alias("tile"), (low != high).alias("across"),
    )


def _compared(pieces: int):
    """The comparison of all tiles of a partition, sorted by ``size, piece, key, tile``."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 20_000:
                continue
            group, ends = _groups(held)
            # The last tile may go on in the next batch.
            whole = int(ends[-2]) if len(ends) > 1 else 0
            if whole:
                yield from _near(held.slice(0, whole), group[:whole], pieces)
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from _near(held, _groups(held)[0], pieces)

    def _groups(table):
        """Number of each row's tile, and where the tiles end."""
        import numpy as np

        change = np.zeros(table.num_rows, bool)
        for name in ("size", "piece", "key", "tile"):
            values = table.column(name).to_numpy()
            change[1:] |= values[1:] != values[:-1]
        group = np.cumsum(change)
        return group, np.append(np.flatnonzero(change), table.num_rows)

    return run


def _near(table, group, pieces: int):
    """``word, near, near_n`` of the near pairs of whole tiles, both ways round."""
    import numpy as np
    import pyarrow as pa

    sizes = np.bincount(group)
    last = np.cumsum(sizes)[group]
    keep = sizes[group] > 1
    if not keep.any():
        return
    at = np.flatnonzero(keep)
    shift = np.cumsum(~keep)
    last = last[at] - shift[last[at] - 1]
    table = table.take(pa.array(at))
    size = table.column("size").to_numpy()
    words = table.column("word").to_pylist()
    chars = np.fromiter(map(len, words), np.int64, len(words))
    block = table.column("block").to_numpy()
    across = table.column("across").to_numpy()
    piece = table.column("piece").to_numpy()
    n = table.column("n").to_numpy()
    left, right = [], []
    begin = 0
    while begin < len(words):
        # Rows of one width, whole tiles, about a million cells.
        width = int(size[begin]) + 1
        stop = int(np.searchsorted(size, size[begin], "right"))
        end = begin
        while end < stop and (end == begin or (last[end] - begin) * width <= CELLS):
            end = int(last[end])
        mine = words[begin:end]
        flat = "".join([w.ljust(width, "\0") for w in mine]).encode("utf-32-le", "surrogatepass")
        fore = np.frombuffer(flat, "<u4").reshape(len(mine), width)
        full = chars[begin:end] == width
        aft = np.zeros_like(fore)
        aft[full] = fore[full]
        aft[~full, 1:] = fore[~full, :-1]
        aft = aft[:, ::-1]
        stops = last[begin:end] - begin
        a = np.arange(len(mine))
        step = 0
        while True:
            step += 1
            a = a[a + step < stops[a]]
            if not len(a):
                break
            b = a + step
            go = ~(full[a] & full[b]) & (~across[begin + a] | (block[begin + a] != block[begin + b]))
            x, y = a[go], b[go]
            if not len(x):
                continue
            prefix = (fore[x] != fore[y]).argmax(1)
            suffix = (aft[x] != aft[y]).argmax(1)
            longer = np.maximum(chars[begin + x], chars[begin + y])
            hit = prefix + suffix >= longer - 1
            if not hit.any():
                continue
            x, y, prefix, suffix = x[hit], y[hit], prefix[hit], suffix[hit]
            first = np.full(len(x), pieces)
            for p in range(pieces - 1, -1, -1):
                low, high = (width - 1) * p // pieces, (width - 1) * (p + 1) // pieces
                first[(prefix >= low) & (suffix >= width - 1 - high)] = p
            mine_too = (first == piece[begin + x]) & (prefix < width)
            left.append(begin + x[mine_too])
            right.append(begin + y[mine_too])
        begin = end
    if not left:
        return
    a, b = np.concatenate(left), np.concatenate(right)
    one, two = np.concatenate([a, b]), np.concatenate([b, a])
    column = table.column("word").combine_chunks()
    for low in range(0, len(one), 50_000):
        part = slice(low, low + 50_000)
        yield pa.RecordBatch.from_arrays(
            [column.take(pa.array(one[part])), column.take(pa.array(two[part])), pa.array(n[two[part]])],
            ["word", "near", "near_n"],
        )


def near_pairs(
    words: DataFrame, pieces: int = PIECES, block: int = BLOCK, cells: int = CELLS, least_length: int = 7
) -> DataFrame:
    """``word, near, near_n`` for all pairs of words one edit apart, both ways round.

    ``words``: ``word, n``, each word once, of at least ``least_length`` code points, which
    must not be fewer than ``pieces``.
    """
    if least_length < pieces:
        raise ValueError("words must have at least as many code points as pieces")
    rows = _tiled(_placed(words, pieces, least_length), block, cells)
    rows = rows.select("size", "piece", "key", "tile", "across", "block", "word", "n")
    sorted_rows = rows.repartition("key", "tile").sortWithinPartitions("size", "piece", "key", "tile")
    return sorted_rows.mapInArrow(_compared(pieces), "word string, near string, near_n long")


def forms(words: DataFrame, factor: int = 10, **how) -> DataFrame:
    """``word, n, n_near, form, form_n`` for a table ``word, n``.

    ``form``: the near word that occurs most (ties: the smallest) if it occurs at least
    ``factor`` times as often.
    """
    near = near_pairs(words, **how).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"),
        F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"),
    )
    best_n = -F.col("best.less")
    often = best_n >= factor * F.col("n")
    return words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(often, F.col("best.near")).alias("form"), F.when(often, best_n).alias("form_n"),
    )


def roots(table: DataFrame) -> DataFrame:
    """``word, root`` of the words with a form: the last of its forms.

    Every round doubles the way, and counts grow tenfold a step, so rounds are few. A
    word has few near words, so no form is a hot key.
    """
    ways = stored(table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "roots")
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stored(
            ways.join(on, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "roots",
        )
        if new.where("moved").isEmpty():
            return ways
        ways = new.drop("moved")


def variants(words: DataFrame, factor: int = 10, **how) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of a table ``word, n``."""
    words = stored(words.select("word", F.col("n").cast("long").alias("n")), "words")
    table = stored(forms(words, factor, **how), "forms")
    return table.join(roots(table), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


#: The query in SQL: words are near that are the same without one code point each, in the same
#: place, or of which one is the other without one.
SQL = f"""
with recursive {CRC_TABLE},
runs as (
  select coalesce(cast(doc_id as varchar), '') id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-zÀ-ÿ]+')) run
  from documents),
hashed as (select run, {crc32("id || ':' || run")} h from runs, crc_table where length(run) >= 7),
typed as (
  select case when h % 31 = 0
    then left(run, cast(h % length(run) as bigint)) || substr(run, cast(h % length(run) as bigint) + 2)
    else run end word
  from hashed),
words as (select word, count(*) n from typed where length(word) >= 7 group by word having count(*) >= 2),
cut as (
  select word, i, left(word, i) || substr(word, i + 2) rest
  from (select word, unnest(range(length(word))) i from words)),
near as (
  select a.word, b.word other from cut a join cut b using (i, rest) where a.word <> b.word
  union select word, rest from cut where rest in (select word from words)
  union select rest, word from cut where rest in (select word from words)),
weighed as (
  select near.word, other, o.n, max(o.n) over (partition by near.word) most
  from near join words o on o.word = other),
best as (
  select word, count(*) n_near, max(n) best_n, min(other) filter (where n = most) best from weighed group by word),
forms as (
  select w.word, w.n, coalesce(n_near, 0) n_near, case when best_n >= 10 * w.n then best end form,
    case when best_n >= 10 * w.n then best_n end form_n
  from words w left join best using (word)),
ways as (
  select word, word root from forms
  union all
  select ways.word, forms.form from ways join forms on forms.word = ways.root where forms.form is not null),
ends as (select ways.word, root from ways join forms f on f.word = ways.root where f.form is null)
select forms.word, form, root, n, n_near, form_n from forms join ends using (word)
"""
