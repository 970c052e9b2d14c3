"""Files in and out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk.functions.scalars import Col, _c, run_stamp
from txrisk.operators.incidence import account_rows, distinct_addresses, hot_accounts
from txrisk.operators.skew import Hot, fits_broadcast, settled
from txrisk.schemas import ADDRESS_SCHEMA, snake_case
from txrisk.sources.checkpoints import kept_rows, new_path


# Folders of a kept history.
SHARDS = 1_024


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV, taken from its first line."""
    return spark.read.csv(path, header=True).columns


def read_addresses(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """Labelled address table from CSV with header, one row per account.

    Columns may be absent or in another order, so the types are looked up by
    the names in the header.  Unknown columns are text.  ``infer=True`` lets
    Spark guess the types, at the price of one more pass.
    """
    if infer:
        return snake_case(spark.read.csv(path, header=True, inferSchema=True))
    known = {f.name: f.dataType for f in ADDRESS_SCHEMA.fields}
    schema = T.StructType(
        [T.StructField(c, known.get(c, T.StringType())) for c in _header(spark, path)]
    )
    return snake_case(spark.read.schema(schema).csv(path, header=True))


def read_transactions(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    head: int = 10_000,
    numbered: bool = False,
) -> DataFrame:
    """Bulk transaction table from CSV with header; ``value`` is a double.

    Without a schema the other types are guessed from the first ``head`` lines.
    A later value that does not fit them stops the job with its column and text;
    only blank values are null.  Give a schema where later lines differ.  A table that keeps its file order in a column should call it
    ``pos``; ``numbered`` adds one (``with_row_number``).
    """
    if schema is None:
        guessed = _guessed(spark, path, head)
        raw = T.StructType([T.StructField(f.name, T.StringType()) for f in guessed.fields])
        df = spark.read.schema(raw).csv(path, header=True)
    else:
        df = spark.read.schema(schema).csv(path, header=True)
    if numbered:
        df = with_row_number(df)
    if schema is None:
        df = df.withColumns({f.name: _fitting(f.name, f.dataType) for f in guessed.fields})
    return df


def _fitting(name: str, kind: T.DataType) -> Column:
    """The text of a column as ``kind``; an error if it is neither blank nor fits."""
    text = F.col(f"`{name}`")
    if isinstance(kind, T.StringType):
        return text
    typed, fits = text.try_cast(kind), F.lit(True)
    # These casts take more than the type's own texts: fractions, and 1 or yes.
    if isinstance(kind, T.DecimalType):
        fits = F.trim(text).rlike("^[+-]?[0-9]+$")
    elif isinstance(kind, T.BooleanType):
        fits = F.lower(F.trim(text)).isin("true", "false")
    said = F.concat(F.lit(f"column {name} was guessed as {kind.simpleString()}, but holds: "), text)
    return (
        F.when(text.isNull() | (F.trim(text) == ""), F.lit(None).cast(kind))
        .when(typed.isNotNull() & fits, typed)
        .otherwise(F.raise_error(said).cast(kind))
    )


def _guessed(spark: SparkSession, path: str, head: int) -> T.StructType:
    """Types of the columns by the first lines of the table."""
    names = _header(spark, path)
    lines = spark.read.text(path).limit(head + 1)
    guessed = spark.read.csv(lines.rdd.map(lambda r: r[0]), header=True, inferSchema=True)
    if guessed.columns != names:
        raise ValueError("the first lines of the table do not have its columns")
    return T.StructType(
        [
            T.StructField("value", T.DoubleType()) if f.name == "value"
            # Text as given: times are parsed strictly later on.
            else T.StructField(f.name, T.StringType())
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
            else f
            for f in guessed.schema.fields
        ]
    )


def block_offsets(df: DataFrame) -> DataFrame:
    """``_file, _at, _rows, _low, _first``: the blocks that the files of ``df`` are read in.

    ``_rows`` are a block's rows, ``_first`` the rows of all blocks before it by file name and
    place, ``_low`` the number that its first row has in its task. One row for each
    block, written to the shared folder.
    """
    blocks = _placed(df).groupBy("_file", "_at").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_low")
    )
    before = Window.orderBy("_file", "_at").rowsBetween(Window.unboundedPreceding, -1)
    return kept_rows(blocks.withColumn("_first", F.coalesce(F.sum("_rows").over(before), F.lit(0))), "blocks")


def _placed(df: DataFrame) -> DataFrame:
    return df.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
    )


def with_row_number(df: DataFrame) -> DataFrame:
    """Adds ``pos`` to a table read from files: 0, 1, 2 and so on without gaps, ascending by
    file name and place in the file.

    A task may hold blocks of several files, in an order of its own. So blocks are numbered
    by name and place (``block_offsets``), and a row by its place in the block: its place
    in the task less that of the block's first row. Nothing is sorted or shuffled as long
    as the list of blocks fits a broadcast.
    """
    offsets = block_offsets(df)
    few = fits_broadcast(offsets)
    shifts = offsets.select("_file", "_at", (F.col("_first") - F.col("_low")).alias("_shift"))
    shifts = F.broadcast(shifts) if few else shifts
    return _placed(df).join(shifts, ["_file", "_at"]).select(
        *[f"`{c}`" for c in df.columns], (F.col("_shift") + F.col("_row")).alias("pos")
    )


def write_features(df: DataFrame, path: str) -> None:
    """The prepared feature table (static features, sequence, label)."""
    df.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Read it back."""
    return spark.read.parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a feature table in the shared folder, read back by column.

    What follows starts from files that all executors see, however long the way to
    them was.
    """
    path = new_path(df.sparkSession, "features")
    write_features(df, path)
    return read_features(df.sparkSession, path)


def shard_of(address: Col, shards: int) -> Column:
    """Folder of an account in a kept history."""
    return F.pmod(F.xxhash64(F.lower(_c(address))), F.lit(shards)).cast("int")


def write_history(
    tx: DataFrame,
    path: str,
    shards: int = SHARDS,
    hot: DataFrame | Hot | None = None,
    rows_per_file: int = 2_000_000,
) -> None:
    """Keeps the histories of all accounts, in folders by a hash of the account.

    A later scan of a few accounts reads their folders only, the way an explorer
    looks accounts up by key; the number of folders is part of the path.  A
    folder is written by as many tasks as it has rows for, its accounts apart by
    another hash, and the rows of a hub account by tasks of their own.

    Two small tables go with it: a catalogue of the folders, and the hub accounts.
    """
    hubs = settled(hot_accounts(tx) if hot is None else hot).keys
    rows = account_rows(tx).withColumn("shard", shard_of("address", shards))
    # Two parties per transaction at most; a plain count, nearly free on Parquet.
    files = max(1, -(-2 * tx.count() // (shards * rows_per_file)))
    piece = F.pmod(F.xxhash64("address", F.lit(1)), F.lit(files))
    if hubs is not None:
        rows = rows.join(F.broadcast(hubs), "address", "left")
        piece = F.coalesce(F.pmod(F.xxhash64("pos"), F.col("pieces")) + F.lit(files), piece)
    (
        rows.withColumn("shards", F.lit(shards))
        .withColumn("piece", piece)
        .drop("pieces")
        .repartition("shard", "piece")
        .sortWithinPartitions("shard", "address")
        .drop("piece")
        .write.mode("overwrite")
        .partitionBy("shards", "shard")
        .parquet(path)
    )
    write_catalogue(tx.sparkSession, path)
    none = tx.sparkSession.createDataFrame([], "address string, pieces int")
    (none if hubs is None else hubs).write.mode("overwrite").parquet(f"{path}/{_HUBS}")


# Beside the folders of a history; readers of the history skip such names.
_CATALOGUE, _HUBS = "_catalogue", "_hubs"


def write_catalogue(spark: SparkSession, path: str) -> None:
    """``shards, shard, first, last, rows`` of every folder of a kept history, one row each."""
    folders = spark.read.parquet(path).groupBy("shards", "shard").agg(
        F.min("address").alias("first"), F.max("address").alias("last"), F.count(F.lit(1)).alias("rows")
    )
    folders.coalesce(1).write.mode("overwrite").parquet(f"{path}/{_CATALOGUE}")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The folders of a kept history, without a look at its files."""
    schema = "shards int, shard int, first string, last string, rows bigint"
    return spark.read.schema(schema).parquet(f"{path}/{_CATALOGUE}")


def read_hubs(spark: SparkSession, path: str) -> DataFrame:
    """The hub accounts of a kept history, for ``hot=`` of scans over it."""
    return spark.read.schema("address string, pieces int").parquet(f"{path}/{_HUBS}")


def read_history(
    spark: SparkSession, path: str, addresses: DataFrame | None = None
) -> DataFrame:
    """Reads kept histories; with a list, those of its accounts only.

    For a list that fits a broadcast, the catalogue tells the folders, which are as many
    at most as there are hashes; no other one is listed or opened.  Files are
    sorted by account, so most row groups are skipped as well.
    """
    if addresses is None:
        return spark.read.parquet(path).drop("shards", "shard")
    keys = distinct_addresses(addresses.select(F.lower("address").alias("address")))
    if not fits_broadcast(keys):
        history = spark.read.parquet(path).drop("shards", "shard")
        return history.join(keys, "address", "left_semi")
    folders = read_catalogue(spark, path).collect()
    # An account is in one folder for each number of folders that the history has.
    wanted = {}
    for n in sorted({f["shards"] for f in folders}):
        asked = keys.groupBy(shard_of("address", n).alias("shard")).agg(
            F.min("address").alias("low"), F.max("address").alias("high")
        )
        wanted |= {(n, r["shard"]): (r["low"], r["high"]) for r in asked.collect()}
    held = []
    for f in folders:
        low, high = wanted.get((f["shards"], f["shard"]), (None, None))
        if low is not None and low <= f["last"] and f["first"] <= high:
            held.append((f"{path}/shards={f['shards']}/shard={f['shard']}", low, high))
    if not held:
        # Any folder knows the columns; none of its rows are asked for.
        return spark.read.parquet(path).drop("shards", "shard").limit(0)
    history = spark.read.option("basePath", path).parquet(*[p for p, _, _ in held])
    ends = min(low for _, low, _ in held), max(high for _, _, high in held)
    history = history.where(F.col("address").between(*ends)).drop("shards", "shard")
    return history.join(F.broadcast(keys), "address", "left_semi")


def write_results(df: DataFrame, folder: str) -> str:
    """Results as JSON in a folder named by the time, and by a number that two
    runs in one second do not share."""
    stamp = df.sparkSession.range(1).select(run_stamp()).first()[0]
    path = f"{folder}/run={stamp}_{uuid.uuid4().hex[:8]}"
    df.write.json(path)
    return path
