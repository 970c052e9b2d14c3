"""Scanning accounts: history, features, sequence, score.

One account or millions take the same plan.  After the newest ``k`` rows of
every account are known, features, sequence and the list of used transactions
all come from the same two aggregates, which keep the partitioning of the
ranking: a scan shuffles the transactions once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from txrisk.functions.scalars import address_check
from txrisk.operators.features import account_features, features_for, narrow
from txrisk.operators.history import batch_index, recent
from txrisk.operators.incidence import (
    distinct_addresses,
    history_for,
    history_split,
    hot_accounts,
    with_roles,
)
from txrisk.operators.quality import (
    counters_table,
    observed,
    request_counters,
    transaction_counters,
)
from txrisk.operators.sequences import pad_matrix, pool_names, pooled_steps, step_of_row
from txrisk.operators.skew import Hot, fits_broadcast, settled
from txrisk.plans.model import RiskModel, score
from txrisk.schemas import COMPUTED_FEATURES, HISTORY_COLUMNS, SEQUENCE_LENGTH, SEQUENCE_WIDTH
from txrisk.sources.tables import write_results


def _raw_fields(df: DataFrame) -> list[str]:
    return [c for c in HISTORY_COLUMNS if c in df.columns]


def _used(ranked: Column, fields: list[str]) -> Column:
    """The raw fields of a list of ranked transactions, newest first."""
    used = F.transform(
        F.sort_array(ranked), lambda t: F.struct(*[t.getField(f).alias(f) for f in fields])
    )
    return F.coalesce(used, F.array())


def nest_transactions(df: DataFrame, ranked: DataFrame) -> DataFrame:
    """Attach the used transactions of every account, newest first.

    ``ranked`` was cut to the newest ``k`` before, which bounds the list.
    """
    fields = _raw_fields(ranked)
    lists = ranked.groupBy("address").agg(
        F.collect_list(F.struct("rank", *fields)).alias("transactions_used")
    )
    return df.join(lists, "address", "left").withColumn(
        "transactions_used", _used(F.col("transactions_used"), fields)
    )


def behaviour(
    addresses: DataFrame | None,
    tx: DataFrame,
    k: int | None = 100,
    gap_order: str = "desc",
    exclude_failed: bool = False,
    hot: DataFrame | Hot | None = None,
) -> DataFrame:
    """J3 + W1 + A1-A13: features over the newest ``k`` rows of every account.

    ``k=None`` takes whole histories.  Without a list the result holds all
    accounts that occur; with one, an account without history has zeros.
    """
    rows = narrow(tx)
    fits = addresses is not None and fits_broadcast(addresses)
    if k is None:
        history = history_for(addresses, rows, hot, fits)
    else:
        history = recent(history_split(addresses, rows, hot, fits), k)
    found = account_features(history, gap_order, exclude_failed)
    return found if addresses is None else features_for(addresses, found, fits)


def profiles(
    addresses: DataFrame,
    tx: DataFrame,
    k: int = 100,
    length: int = SEQUENCE_LENGTH,
    gap_order: str = "desc",
    hot: DataFrame | Hot | None = None,
    keyed: bool = False,
    with_transactions: bool = True,
    encoding: str | None = None,
    watch: Observation | None = None,
) -> DataFrame:
    """Features, sequence and used transactions of every listed account.

    ``tx`` is a bulk table of transactions; with ``keyed=True`` its rows already
    belong to an account, as those of ``read_explorer`` do, and those of other
    accounts are left out before the ranking.  The newest-first order of the
    ranking is the order of the sequence, too.

    Numbers and steps are made before the shuffle; raw fields, call data among them,
    travel only if the transactions are wanted.  Steps beyond ``length`` are dropped
    where the rows are ranked.  With ``encoding='pooled'`` there is a column ``pooled``
    in place of ``sequence``, and no list of steps is gathered.  ``watch`` gets counters of
    blank and unreadable input (``quality``) from the action that runs the scan.
    """
    fits = fits_broadcast(addresses)
    if watch is not None:
        # Hubs are counted before, so that the scan itself is the first to be observed.
        hot = settled(hot_accounts(tx) if hot is None else hot)
        counters = transaction_counters().items()
        tx = tx.observe(watch, *[F.count_if(c).alias(name) for name, c in counters])
    fields = _raw_fields(tx) if with_transactions else []
    raw = [F.struct(*fields).alias("raw")] if fields else []
    key = [F.lower("address").alias("address")] if keyed else []
    rows = narrow(tx, *key, step_of_row().alias("step"), *raw)
    if keyed:
        listed = distinct_addresses(addresses.select(F.lower("address").alias("address")))
        listed = F.broadcast(listed) if fits else listed.hint("shuffle_hash")
        history = with_roles(rows).join(listed, "address", "left_semi")
    else:
        history = history_split(addresses, rows, hot, fits)
    ranked = recent(history, k, hot, running={"place": F.col("step").isNotNull()})
    ranked = ranked.withColumn("step", F.when(F.col("place") <= length, F.col("step")))
    beside = [
        # Lists leave nulls out: at most ``length`` steps.
        pooled_steps(F.col("step"), length).alias("pooled")
        if encoding == "pooled"
        else F.collect_list(F.when(F.col("step").isNotNull(), F.struct("place", "step"))).alias("steps")
    ]
    if with_transactions:
        used = F.struct("rank", "raw") if fields else F.struct("rank")
        beside.append(F.collect_list(used).alias("used"))
    kept = ("rank", "place", "step", *(["raw"] if fields else []))
    listed = features_for(addresses, account_features(ranked, gap_order, keep=kept, beside=beside), fits)
    out = [c for c in listed.columns if c not in ("pooled", "steps", "used")]
    if encoding == "pooled":
        out.append(F.coalesce("pooled", F.array_repeat(F.lit(0.0), len(pool_names()))).alias("pooled"))
    else:
        steps = F.transform(F.sort_array("steps"), lambda t: t["step"])
        out.append(pad_matrix(steps, length).alias("sequence"))
    if with_transactions:
        raws = F.transform(F.sort_array("used"), lambda t: t["raw"] if fields else F.struct())
        out.append(F.coalesce(raws, F.array()).alias("transactions_used"))
    return listed.select(*out)


def scan(
    addresses: DataFrame,
    tx: DataFrame,
    model: RiskModel,
    k: int | None = None,
    hot: DataFrame | Hot | None = None,
    keyed: bool = False,
    watch: Observation | None = None,
) -> DataFrame:
    """M7: ``address``, nine-field ``prediction`` and ``transactions_used``.

    An account without history is scored too, from zeros.  Without ``k`` as many
    transactions are used as the model was trained with.
    """
    k = model.k if k is None else k
    encoding = "pooled" if model.encoding == "pooled" and model.sequence_width == SEQUENCE_WIDTH else None
    rows = profiles(
        addresses, tx, k, model.sequence_length, hot=hot, keyed=keyed, encoding=encoding, watch=watch
    )
    scored = score(rows, model)
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    full = F.col("prediction").withField(
        "total_transactions", F.col("total_transactions").cast("int")
    ).withField("timestamp", stamp)
    return scored.select(
        *[c for c in addresses.columns if c not in COMPUTED_FEATURES],
        full.alias("prediction"),
        "transactions_used",
    )


def check_requests(addresses: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """requests that can be analysed, and the others with a reason.

    A missing address always fails; ``strict`` also refuses malformed ones.
    """
    problem = F.when(F.col("address").isNull(), F.lit("missing"))
    if strict:
        state = address_check("address")
        problem = F.coalesce(problem, F.when(state != "ok", state))
    marked = addresses.withColumn("reason", problem)
    good = marked.where(F.col("reason").isNull()).drop("reason")
    return good, marked.where(F.col("reason").isNotNull())


def failed_requests(addresses: DataFrame, strict: bool = False) -> DataFrame:
    """``batch_index, address, reason`` of the requests that a batch leaves out."""
    _, failed = check_requests(batch_index(addresses), strict)
    return failed.select("batch_index", "address", "reason")


def batch_scan(
    addresses: DataFrame,
    tx: DataFrame,
    model: RiskModel,
    k: int | None = None,
    save_to: str | None = None,
    strict: bool = False,
    keyed: bool = False,
    hot: DataFrame | Hot | None = None,
) -> DataFrame:
    """M8: scan a list; adds ``batch_index`` and leaves out failed requests, which
    ``failed_requests`` lists.  With a folder, results and failures are written, and beside
    them, in ``quality``, how many parties, numbers and requests were missing or unreadable."""
    requests, failed = check_requests(batch_index(addresses), strict)
    listed = requests.select("address", "batch_index")
    if save_to is None:
        return scan(listed, tx, model, k, hot, keyed)
    refused = failed.select("batch_index", "address", "reason")
    both = requests.withColumn("reason", F.lit(None).cast("string")).unionByName(failed)
    asked, counted = observed(both, request_counters())
    asked.select("reason").write.format("noop").mode("overwrite").save()
    seen = [counted]
    if counted.get["failed_requests"]:
        write_results(refused, f"{save_to}/failed")
    watch = Observation()
    results = scan(listed, tx, model, k, hot, keyed, watch)
    # Every request has a result, so an empty list is known without a scan.
    if counted.get["requests"] > counted.get["failed_requests"]:
        path = write_results(results, save_to)
        results = results.sparkSession.read.schema(results.schema).json(path)
        seen.append(watch)
    write_results(counters_table(results.sparkSession, *seen), f"{save_to}/quality")
    return results


def to_analysis_row(df: DataFrame, explanations: str | None = None) -> DataFrame:
    """The flat eight-field analysis of a scan result."""
    p = F.col("prediction")
    reasons = F.col(explanations) if explanations else F.lit(None)
    return df.select(
        p["prediction"].alias("prediction"),
        p["is_fraud"].alias("is_fraud"),
        F.col("address"),
        p["total_transactions"].alias("total_transactions"),
        p["timestamp"].alias("analysis_timestamp"),
        p["confidence"].alias("confidence"),
        p["fraud_probability"].cast("string").alias("fraud_probability"),
        reasons.alias("explanations"),
    )
