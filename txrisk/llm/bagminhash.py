"""Near copies by BagMinHash signatures, bands and exact multiset overlap.

The bag of a text holds its five-word shingles with their counts; a text of fewer
words is one shingle, a text without words has an empty bag and is no copy of
anything. The similarity of two bags is the sum of the smaller counts over the sum
of the larger ones.

1. Signature: every shingle x carries a Poisson process for each dyadic block of
   counts, [0,1), [1,2), [2,4), [4,8) and so on; the points of a block wider than one also
   have a level in it. A text with count w of x takes the points with a level
   below w, so it sees a Poisson process of rate w, and two texts share the part up to
   the smaller count. Each point falls into one of the signature's slots, which keeps
   its earliest point: two texts agree in a slot with the probability of
   their similarity. Points are made in time order in growing
   batches and only as long as a slot of the text can still take one.
2. Equal texts become one representative, the smallest doc_id.
3. Bands of slots make buckets. In each bucket all members are compared with the
   smallest one: first by the share of equal slots, a byte of each, and what is within
   five standard deviations of the similarity by the bags, exactly. Members of a
   bucket that are then in different classes are compared with each other by their
   bags, in tiles of a bounded number of bytes. A tile gives only the links that
   join classes, so a large bucket is many small pieces of work and few rows.
4. The classes are what the links hold together.

Rows with the same doc_id and text are one document; rows with the same doc_id
and other texts belong to one class. A null doc_id is a class of its own and is null. Null
texts are empty, texts have any length, an empty table gives an empty result, and other columns
are not looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import at_most, free, stored, texts
from txrisk.llm.components import components
from txrisk.llm.words import batches, mix, shingles

#: Ids that are broadcast, a few megabytes.
LISTED = 200_000
WORDS = 5
SIMILARITY = 0.8
#: At similarity 0.8 a pair shares no band with a probability of 5e-5.
BANDS, ROWS = 25, 5
#: Bytes of bags on either side of a tile.
TILE = 8 << 20

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _uniform(x: np.ndarray) -> np.ndarray:
    """Above 0, up to 1."""
    return ((x >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53


def signatures(shingle: np.ndarray, owner: np.ndarray, count: np.ndarray, n: int, slots: int):
    """``n x slots`` identities of the earliest points of ``n`` bags.

    ``shingle, owner, count``: the entries of the bags. Rows of empty bags are 0.
    """
    # One process per entry and dyadic block that its count reaches into.
    blocks = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0) + 1
    entry = np.repeat(np.arange(len(shingle)), blocks)
    block = np.arange(len(entry)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    low = np.where(block > 0, 2.0 ** (block - 1), 0.0)
    width = np.maximum(low, 1.0)
    seed = mix(shingle[entry] + (block.astype(np.uint64) + np.uint64(1)) * _SPREAD)
    doc, level = owner[entry], count[entry].astype(np.float64)
    clock = np.zeros(len(seed))

    times = np.full(n * slots, np.inf)
    ids = np.zeros(n * slots, np.uint64)
    done, size = 0, 1
    live = np.arange(len(seed))
    while len(live):
        step = np.arange(done + 1, done + size + 1, dtype=np.uint64)
        point = mix(seed[live][:, None] ^ (step * np.uint64(0xD1B54A32D192ED03)))
        when = clock[live][:, None] + np.cumsum(
            -np.log(_uniform(point)) / width[live][:, None], axis=1
        )
        clock[live] = when[:, -1]
        second = mix(point + _SPREAD)
        slot = ((second >> np.uint64(40)) * np.uint64(slots)) >> np.uint64(24)
        # The lower bits give the level inside the block.
        at = low[live][:, None] + width[live][:, None] * (
            (second & np.uint64((1 << 40) - 1)).astype(np.float64) * 2.0**-40
        )
        place = doc[live][:, None] * slots + slot.astype(np.int64)
        use = (at < level[live][:, None]) & (when < times[place])
        place, when, point = place[use], when[use], point[use]
        np.minimum.at(times, place, when)
        first = when == times[place]
        ids[place[first]] = point[first]
        latest = times.reshape(n, slots).max(axis=1)
        live = live[clock[live] < latest[doc[live]]]
        done += size
        size = min(size * 2, 256)
    return ids.reshape(n, slots)


def bags(found: np.ndarray, owner: np.ndarray, n: int):
    """``shingle, owner, count`` of the bags of ``n`` texts, by owner and shingle."""
    shingle, own = shingles(found, owner, n, WORDS)
    order = np.lexsort((shingle, own))
    shingle, own = shingle[order], own[order]
    if not len(shingle):
        return shingle, own, np.empty(0, np.int64)
    new = np.append(True, (shingle[1:] != shingle[:-1]) | (own[1:] != own[:-1]))
    at = np.flatnonzero(new)
    return shingle[at], own[at], np.diff(np.append(at, len(shingle)))


def _signed(bands: int, rows: int):
    def run(parts):
        import pyarrow as pa

        for batch in parts:
            for low, high, found, owner in batches(batch.column("text"), 1 << 19):
                n = high - low
                shingle, own, count = bags(found, owner, n)
                ids = signatures(shingle, own, count, n, bands * rows).reshape(n, bands, rows)
                key = np.zeros((n, bands), np.uint64)
                for r in range(rows):
                    key = mix(key ^ ids[:, :, r]) + _SPREAD
                key = mix(key + np.arange(bands, dtype=np.uint64))
                sketch = (ids.reshape(n, -1) & np.uint64(255)).astype(np.uint8)
                some = np.bincount(own, minlength=n) > 0
                offsets = np.append(0, np.cumsum(np.where(some, bands, 0)))
                yield pa.RecordBatch.from_pydict({
                    "doc": batch.column("doc_id").slice(low, n),
                    "same": batch.column("same").slice(low, n),
                    "bands": pa.ListArray.from_arrays(
                        pa.array(offsets, pa.int32()), pa.array(key[some].view(np.int64).ravel(), pa.int64())
                    ),
                    "sketch": pa.array([x.tobytes() for x in sketch], pa.binary()),
                })

    return run


def _bagged(parts):
    """Bags as bytes: for each shingle as many distinct hashes as its count, sorted."""
    for batch in parts:
        yield from _bags_of(batch)


def _bags_of(batch):
    import pyarrow as pa

    if batch.num_rows:
        for low, high, found, owner in batches(batch.column("text"), 1 << 19):
            n = high - low
            shingle, own, count = bags(found, owner, n)
            each = np.repeat(np.arange(len(shingle)), count)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            value, own = mix(shingle[each] + nth.astype(np.uint64) * _SPREAD), own[each]
            value = value[np.lexsort((value, own))]
            cuts = np.searchsorted(own, np.arange(n + 1))
            # A row without words is no copy of anything and has no bag.
            some = pa.array(cuts[1:] > cuts[:-1])
            yield pa.RecordBatch.from_pydict({
                "doc": batch.column("doc_id").slice(low, n).filter(some),
                "bag": pa.array([value[a:b].tobytes() for a, b in zip(cuts, cuts[1:]) if b > a], pa.binary()),
            })


def _similar(least: float):
    def run(parts):
        import pyarrow as pa

        for batch in parts:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = sorted((len(x), len(y)))
                both = 0
                if small >= least * large:
                    both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(both > 0 and both >= least * (small + large - both))
            mask = pa.array(keep, pa.bool_())
            yield batch.select(["a", "b"]).filter(mask)

    return run


def _floor(least: float, slots: int) -> float:
    """Share of equal slots that a pair of similarity ``least`` misses once in a million."""
    return least - 5 * (least * (1 - least) / slots) ** 0.5


def _table(column):
    """An Arrow column of equally long byte strings as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _promising(least: float):
    def run(parts):
        import pyarrow as pa

        for batch in parts:
            if batch.num_rows:
                x, y = _table(batch.column("x")), _table(batch.column("y"))
                keep = (x == y).mean(axis=1) >= _floor(least, x.shape[1])
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _verified(pairs: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """The pairs ``(a, b)`` whose bags are similar enough."""
    left = bags.select(F.col("doc").alias("a"), F.col("bag").alias("x"))
    right = bags.select(F.col("doc").alias("b"), F.col("bag").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(_similar(least), "a long, b long")


def _listed(ids: DataFrame) -> DataFrame:
    """Ids for a join: broadcast if they are counted to be few, else shuffled."""
    return F.broadcast(ids) if at_most(ids, LISTED) else ids


def _bags(plain: DataFrame, wanted: DataFrame) -> DataFrame:
    """``doc, bag`` of the ``wanted`` documents."""
    ids = stored(wanted.select(F.col("doc").alias("doc_id")).distinct(), "wanted")
    some = plain.join(_listed(ids), "doc_id", "left_semi")
    return stored(some.mapInArrow(_bagged, "doc long, bag binary"), "bags")


def _joining(rows: list, least: float):
    """Links of one tile that join classes, at most one fewer than its rows."""
    import pyarrow as pa

    doc, label, side = (np.array([r[i] for r in rows]) for i in (0, 1, 2))
    size = np.array([len(r[3]) // 8 for r in rows])
    _, entry = np.unique(np.frombuffer(b"".join(r[3] for r in rows), np.uint64), return_inverse=True)
    starts = np.cumsum(size) - size
    label = np.unique(label, return_inverse=True)[1]
    mark = np.zeros(entry.max() + 1, np.int64)
    # A tile of a block with itself has its rows once.
    crossed = bool(side.any())
    out = []
    for i in np.flatnonzero(side == 0):
        other = label != label[i]
        other &= (side == 1) if crossed else (np.arange(len(rows)) > i)
        other &= np.minimum(size, size[i]) >= least * np.maximum(size, size[i])
        if not other.any():
            continue
        own = entry[starts[i] : starts[i] + size[i]]
        mark[own] = 1
        both = np.add.reduceat(mark[entry], starts)
        mark[own] = 0
        for j in np.flatnonzero(other & (both >= least * (size + size[i] - both))):
            if label[j] != label[i]:
                out.append((min(doc[i], doc[j]), max(doc[i], doc[j])))
                label[label == label[j]] = label[i]
    a, b = zip(*out) if out else ((), ())
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _tiles(least: float):
    """Rows come sorted by tile; one tile is held at a time."""

    def run(parts):
        at, rows = None, []
        for batch in parts:
            keys = zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j")))
            values = zip(*(batch.column(c).to_pylist() for c in ("doc", "label", "side", "bag")))
            for key, row in zip(keys, values):
                if key != at:
                    if len(rows) > 1:
                        yield _joining(rows, least)
                    at, rows = key, []
                rows.append(row)
        if len(rows) > 1:
            yield _joining(rows, least)

    return run


def near_copies(
    docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per row of ``docs``: ``doc_id, class_id`` (the smallest doc_id of the class)."""
    plain = texts(docs)
    named = plain.withColumn("same", F.unhex(F.sha2("text", 256)))
    signed = stored(named.mapInArrow(_signed(bands, rows), "doc long, same binary, bands array<long>, sketch binary"), "signed")
    # Equal texts: one representative each. Partial sums keep a large group small.
    groups = signed.where(F.size("bands") > 0).groupBy("same").agg(
        F.min("doc").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    groups = stored(groups, "groups")
    members = (
        groups.where("rep is not null")
        .select(F.col("rep").alias("doc"), F.explode("bands").alias("bucket")).distinct()
    )
    sketches = groups.where("rep is not null").select(F.col("rep").alias("doc"), "sketch")
    links, classes = _links(plain, members, sketches, least)
    rep = signed.where("doc is not null").join(groups.select("same", "rep"), "same", "left")
    # A doc_id with several texts ties their classes together as well.
    several = rep.groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    several = stored(several.where("a <> b").select("a", "b"), "several")
    if not several.isEmpty():
        classes = components(links.unionByName(several))
    best = rep.join(classes.withColumnRenamed("doc", "rep"), "rep", "left").groupBy("doc").agg(
        F.min(F.coalesce("label", "rep", "doc")).alias("class_id")
    )
    return plain.select("doc_id").join(best.withColumnRenamed("doc", "doc_id"), "doc_id", "left")


def _links(
    plain: DataFrame, members: DataFrame, sketches: DataFrame, least: float
) -> tuple[DataFrame, DataFrame]:
    """Verified links and the classes they make, over all buckets of two and more."""
    hubs = members.groupBy("bucket").agg(F.min("doc").alias("hub"), F.count(F.lit(1)).alias("n"))
    left = stored(members.join(hubs.where("n > 1").drop("n"), "bucket"), "buckets")
    pairs = left.where("doc <> hub").select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    pairs = (
        pairs.join(sketches.select(F.col("doc").alias("a"), F.col("sketch").alias("x")), "a")
        .join(sketches.select(F.col("doc").alias("b"), F.col("sketch").alias("y")), "b")
        .mapInArrow(_promising(least), "a long, b long")
    )
    pairs = stored(pairs, "pairs")
    bag = _bags(plain, pairs.select(F.col("a").alias("doc")).union(pairs.select("b")))
    links = stored(_verified(pairs, bag, least), "links")
    classes = components(links)

    # Whoever is the smallest has been compared with all of its bucket; the others of
    # a bucket are compared with each other if they are in different classes.
    rest = left.where("doc <> hub").join(classes, "doc", "left").select(
        "bucket", "doc", F.coalesce("label", "doc").alias("label")
    )
    mixed = rest.groupBy("bucket").agg((F.min("label") < F.max("label")).alias("mixed"))
    open_ = stored(rest.join(mixed.where("mixed").select("bucket"), "bucket"), "mixed")
    if open_.isEmpty():
        return links, classes
    open_ = open_.join(_bags(plain, open_.select("doc")), "doc")
    blocks = open_.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("bag")) / TILE).alias("blocks"))
    open_ = open_.join(blocks, "bucket").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")))
    rows = open_.select(
        "bucket", "doc", "label", "bag",
        # A block is the left side of its tiles with itself and later ones, the right side of the others.
        F.inline(F.concat(
            F.transform(F.sequence("block", F.col("blocks") - 1), lambda j: F.struct(
                F.col("block").alias("i"), j.alias("j"), F.lit(0).alias("side"))),
            F.transform(
                F.when(F.col("block") > 0, F.sequence(F.lit(0).cast("long"), F.col("block") - 1))
                .otherwise(F.array().cast("array<long>")),
                lambda i: F.struct(i.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"))),
        )),
    )
    more = (
        rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        .mapInArrow(_tiles(least), "a long, b long").distinct()
    )
    links = stored(links.union(more), "links")
    return links, components(links)


def one_of_each(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``docs``, all columns, with the smallest doc_id of each class.

    Rows that share that doc_id all stay, and so do rows with a null doc_id.
    """
    gone = near_copies(docs, least).where("doc_id <> class_id").select("doc_id")
    name = free(docs, "gone")
    gone = stored(gone.select(F.col("doc_id").alias(name)).distinct(), "copies")
    return docs.join(_listed(gone), F.col("doc_id").cast("long") == F.col(name), "left_anti")
