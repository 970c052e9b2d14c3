"""The registered queries: every operator, run over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txrisk import proxy
from txrisk.functions import presentation as show
from txrisk.functions import scalars as x
from txrisk.functions import scores
from txrisk.operators import history as hist
from txrisk.operators import incidence as inc
from txrisk.operators import metrics, prep, quality, rollups
from txrisk.operators import sequences as seq
from txrisk.operators.skew import Split
from txrisk.plans import explain, model, newton, scan, training
from txrisk.schemas import (
    COMPUTED_FEATURES,
    FEATURES,
    HISTORY_COLUMNS,
    IRRELEVANT_TX_COLUMNS,
    KIND_FIELDS,
    SEQUENCE_FIELDS,
)
from txrisk.sources import explorer, tables
from txrisk.sources.checkpoints import kept_rows, new_path
from txrisk.streaming import newest, requests

Query = Callable[[SparkSession, str], DataFrame]


def _history(spark: SparkSession, d: str) -> DataFrame:
    return inc.history_for(proxy.accounts(spark, d), proxy.transactions(spark, d))


def _split(spark: SparkSession, d: str) -> Split:
    return inc.history_split(proxy.accounts(spark, d), proxy.transactions(spark, d))


def _recent(spark: SparkSession, d: str) -> DataFrame:
    """The newest 100 transactions of every registered account."""
    return hist.recent(_split(spark, d), 100)


def _features(spark: SparkSession, d: str) -> DataFrame:
    """Features of the newest 100 transactions for every registered account."""
    return scan.behaviour(proxy.accounts(spark, d), proxy.transactions(spark, d))


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    """Accounts of class 1, the list that histories are pulled for."""
    return prep.filter_label(proxy.accounts(spark, d), 1)


# -- features -----------------------------------------------------------------------


def account_features(spark: SparkSession, d: str) -> DataFrame:
    """W1 + A1-A13: 22 features over the newest 100 transactions."""
    return _features(spark, d).select("address", *COMPUTED_FEATURES)


def account_features_full(spark: SparkSession, d: str) -> DataFrame:
    """A1-A13 over whole histories of all accounts, oldest-first gaps, failed ones out."""
    tx = proxy.transactions(spark, d, huge=True)
    return scan.behaviour(None, tx, k=None, gap_order="asc", exclude_failed=True)


def _rolled(spark: SparkSession, d: str) -> str:
    """A rollup by days to which the newest day came last, and came twice."""
    tx = proxy.transactions(spark, d, huge=True)
    newest = tx.agg(F.max(rollups.day_of())).first()[0] or 0
    folder = new_path(spark, "rollup")
    last = rollups.day_of() == newest
    rollups.write_rollup(rollups.period_totals(tx.where(~last)), folder)
    for _ in range(2):
        rollups.write_rollup(rollups.period_totals(tx.where(last)), folder)
    return folder


def rolled_features(spark: SparkSession, d: str) -> DataFrame:
    """A1-A13 over whole histories, out of totals kept per day."""
    totals = rollups.read_rollup(spark, _rolled(spark, d))
    return rollups.rolled_features(totals, gap_order="asc", exclude_failed=True)


def rolled_features_coarse(spark: SparkSession, d: str) -> DataFrame:
    """The same with older days merged into periods of thirty."""
    totals = rollups.read_rollup(spark, _rolled(spark, d))
    folder = new_path(spark, "rollup")
    rollups.write_rollup(rollups.coarser(totals, F.floor(F.col("period") / 30)), folder)
    return rollups.rolled_features(rollups.read_rollup(spark, folder), gap_order="asc", exclude_failed=True)


def align_features(spark: SparkSession, d: str) -> DataFrame:
    """The model's 45 columns; those that nothing computes are 0."""
    return prep.align_features(_features(spark, d), FEATURES, keep=("address",))


# -- joins and filters ----------------------------------------------------------------


def touching_transactions(spark: SparkSession, d: str) -> DataFrame:
    """F1 + F2: transactions with a flagged account in any of three roles."""
    tx = proxy.bulk_transactions(spark, d)
    return inc.touching(tx, _flagged(spark, d)).select(
        "pos", "from_address", "to_address", "source_address", "value"
    )


def incidence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Transactions per flagged account over three roles."""
    pairs = inc.incidence(proxy.bulk_transactions(spark, d), _flagged(spark, d))
    return pairs.groupBy("address").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
    )


def _with_blank(spark: SparkSession, d: str) -> DataFrame:
    return _flagged(spark, d).select("address").unionByName(
        spark.range(1).select(F.lit("").alias("address"))
    )


def touching_blank(spark: SparkSession, d: str) -> DataFrame:
    """F2 with the missing party of contract creations in a short list."""
    tx = proxy.bulk_transactions(spark, d)
    return inc.touching(tx, _with_blank(spark, d), fits=True).select(
        "pos", "from_address", "to_address", "source_address", "value"
    )


def touching_long_list(spark: SparkSession, d: str) -> DataFrame:
    """The same by the join that a long list takes."""
    tx = proxy.bulk_transactions(spark, d)
    return inc.touching(tx, _with_blank(spark, d), fits=False).select(
        "pos", "from_address", "to_address", "source_address", "value"
    )


def incidence_long_list(spark: SparkSession, d: str) -> DataFrame:
    """J1 by the join that a long list takes."""
    tx = proxy.bulk_transactions(spark, d)
    pairs = inc.incidence(tx, _flagged(spark, d), fits=False)
    return pairs.groupBy("address").agg(
        F.count(F.lit(1)).alias("transactions"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
    )


def _with_hubs(spark: SparkSession, d: str) -> Split:
    """Histories by the long-list join, accounts of more than 50 rows taken as hubs."""
    tx = proxy.transactions(spark, d)
    hubs = inc.hot_accounts(tx, 50)
    return inc.history_split(proxy.accounts(spark, d), tx, hubs, fits=False)


def history_long_list(spark: SparkSession, d: str) -> DataFrame:
    """J3 + F3 by the long-list join, with hub accounts on their own path."""
    tx = proxy.transactions(spark, d)
    rows = inc.history_for(proxy.accounts(spark, d), tx, inc.hot_accounts(tx, 50), fits=False)
    return rows.select("address", "pos", "sent", "received")


def history_roles(spark: SparkSession, d: str) -> DataFrame:
    """J3 + F3 + F4 + F5: role flags of every row of the listed histories."""
    return _history(spark, d).select(
        "address",
        "pos",
        "sent",
        "received",
        x.is_created_contract("sent", "to_address").alias("created_contract"),
        x.is_contract_call("sent", "to_address", x.hex_nonzero("input")).alias("contract_call"),
    )


def distinct_accounts(spark: SparkSession, d: str) -> DataFrame:
    """U4: every account that is a party to a transaction, once."""
    return inc.distinct_addresses(inc.account_rows(proxy.transactions(spark, d)))


def filter_label(spark: SparkSession, d: str) -> DataFrame:
    """accounts of class 1."""
    return _flagged(spark, d).select("address", "flag")


def numeric_projection(spark: SparkSession, d: str) -> DataFrame:
    """P2 + P3: irrelevant columns dropped, numeric ones kept."""
    tx = prep.drop_existing(proxy.bulk_transactions(spark, d), IRRELEVANT_TX_COLUMNS)
    return tx.select(*seq.numeric_columns(tx))


def select_existing(spark: SparkSession, d: str) -> DataFrame:
    """Those of a list of columns that a table has."""
    listed = ["address", "flag", *FEATURES]
    table = _features(spark, d).drop("avg_sent", "key")
    return prep.select_existing(table, listed).select("address", "flag", "min_sent", "max_sent")


# -- rankings, pages, gaps -------------------------------------------------------------


def recent_k(spark: SparkSession, d: str) -> DataFrame:
    """The newest 100 transactions of every listed account."""
    return _recent(spark, d).select("address", "rank", "hash", "time_stamp")


def page_history(spark: SparkSession, d: str) -> DataFrame:
    """Second page of 25 rows, oldest first."""
    rows = hist.page(_split(spark, d), page=2, offset=25, sort="asc")
    return rows.select("address", "rank", "hash", "block_number")


def _hub_history(spark: SparkSession, d: str) -> DataFrame:
    """All transactions as the histories of three hub accounts."""
    hub = proxy.address_of(F.col("pos") % 3)
    rows = proxy.transactions(spark, d).withColumn("address", hub)
    return rows.select("address", "pos", "hash", "time_stamp", "block_number", "transaction_index")


def _deep_page(spark: SparkSession, d: str, sort: str) -> DataFrame:
    """Page 300 of 10 rows of every hub account, found in slices of 20 rows."""
    history = _hub_history(spark, d)
    hubs = history.select("address").distinct().withColumn("pieces", F.lit(2))
    rows = hist.page(history, page=300, offset=10, sort=sort, hot=hubs, most=20)
    return rows.select("address", "rank", "hash", "block_number")


def deep_page(spark: SparkSession, d: str) -> DataFrame:
    """A page far down the histories of hub accounts, newest first."""
    return _deep_page(spark, d, "desc")


def deep_page_oldest(spark: SparkSession, d: str) -> DataFrame:
    """The same from the oldest row on."""
    return _deep_page(spark, d, "asc")


def tx_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Minutes between consecutive transactions, per account and role."""
    return hist.tx_gaps(_split(spark, d))


def recent_k_hubs(spark: SparkSession, d: str) -> DataFrame:
    """W1 with hub accounts ranked in pieces."""
    return hist.recent(_with_hubs(spark, d), 100).select("address", "rank", "hash")


def page_history_hubs(spark: SparkSession, d: str) -> DataFrame:
    """W2 with hub accounts ranked in pieces."""
    rows = hist.page(_with_hubs(spark, d), page=2, offset=25, sort="asc")
    return rows.select("address", "rank", "hash")


def tx_gaps_hubs(spark: SparkSession, d: str) -> DataFrame:
    """W5 with the histories of hub accounts in time slices."""
    return hist.tx_gaps(_with_hubs(spark, d))


def latest_sequence_hubs(spark: SparkSession, d: str) -> DataFrame:
    """W4 with hub accounts ranked in pieces."""
    return seq.latest_sequence(_with_hubs(spark, d), 50)


def batch_index(spark: SparkSession, d: str) -> DataFrame:
    """Position of every account in the request list, counted."""
    return hist.batch_index(proxy.accounts(spark, d).select("address", "flag"))


# -- sequences ---------------------------------------------------------------------------


def first_n_sequence(spark: SparkSession, d: str) -> DataFrame:
    """F2 + J1 + X5 + W3: first 50 rows of a flagged account, in file order."""
    return training.bulk_sequences(_flagged(spark, d), proxy.bulk_transactions(spark, d))


def latest_sequence(spark: SparkSession, d: str) -> DataFrame:
    """F8 + W4 + X7: the newest 50 well-formed rows as ten numbers each."""
    tx = proxy.transactions(spark, d, huge=True)
    return seq.latest_sequence(inc.history_split(proxy.accounts(spark, d), tx), 50)


def padded_length(spark: SparkSession, d: str) -> DataFrame:
    """X8 + D6: matrices of 200 rows; how many rows are real and how many padding."""
    steps = seq.latest_sequence(_split(spark, d), 200)
    matrix = seq.to_matrix(steps, 200)
    # A gas price is never 0 in a real row, so it tells padding apart.
    real = F.size(F.filter("sequence", lambda r: r[3] != 0.0))
    return matrix.select(
        "address",
        F.size("sequence").alias("length"),
        real.alias("real_rows"),
        (F.size("sequence") - real).alias("padding"),
    )


def profile_sequence(spark: SparkSession, d: str) -> DataFrame:
    """J3 + W1 + W4 + X7 + X8 in the one-shuffle plan of a scan, as rows."""
    accounts, tx = proxy.accounts(spark, d), proxy.transactions(spark, d)
    rows = scan.profiles(accounts, tx, with_transactions=False)
    steps = rows.select("address", F.posexplode("sequence").alias("step", "row"))
    return steps.select(
        "address", "step", *[F.col("row")[i].alias(f) for i, f in enumerate(SEQUENCE_FIELDS)]
    )


def pooled_sequence(spark: SparkSession, d: str) -> DataFrame:
    """M1: mean, maximum, first and std of the channels of the newest 50 rows."""
    accounts, tx = proxy.accounts(spark, d), proxy.transactions(spark, d)
    rows = scan.profiles(accounts, tx, with_transactions=False, encoding="pooled")
    pooled = rows.select("address", F.col("pooled").alias("v"))
    # Means are fractions with few digits, which would tie at a coarse rounding.
    return pooled.select(
        "address",
        *[
            F.round(F.col("v")[i], 6 if n.startswith("std") else 9).alias(n)
            for i, n in enumerate(seq.pool_names())
        ],
    )


def nest_transactions(spark: SparkSession, d: str) -> DataFrame:
    """Used transactions of every account, with all their fields."""
    ranked = _recent(spark, d)
    nested = scan.nest_transactions(proxy.accounts(spark, d).select("address"), ranked)
    return nested.select("address", F.posexplode_outer("transactions_used").alias("at", "t")).select(
        "address", (F.col("at") + 1).alias("rank"), *[F.col("t")[c].alias(c) for c in HISTORY_COLUMNS]
    )


# -- scalars --------------------------------------------------------------------------------


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Texts a user might ask for: parties, blanks, names, other spellings."""
    tx = proxy.transactions(spark, d).select(F.col("to_address").alias("candidate"))
    c = proxy.table(spark, d, "customer")
    address = proxy.address_of(F.col("c_custkey"))
    texts = c.select(
        F.explode(
            F.array(address, F.upper(address), F.col("c_name"), F.concat(address, F.lit("\n")))
        ).alias("candidate")
    )
    return tx.unionByName(texts)


def validate_address(spark: SparkSession, d: str) -> DataFrame:
    """state of every requested text."""
    return (
        _candidates(spark, d)
        .groupBy("candidate")
        .agg(F.count(F.lit(1)).alias("times"))
        .withColumn("state", x.address_check("candidate"))
    )


def failed_requests(spark: SparkSession, d: str) -> DataFrame:
    """requests that are left out, by reason."""
    asked = _candidates(spark, d).withColumnRenamed("candidate", "address")
    good, failed = scan.check_requests(asked, strict=True)
    both = failed.unionByName(good.withColumn("reason", F.lit("analysed")))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("requests"))


def short_address(spark: SparkSession, d: str) -> DataFrame:
    """X16 + X4: display form of every account."""
    return proxy.accounts(spark, d).select(
        "address",
        show.short_address("address").alias("short"),
        x.lower_address(F.upper("address")).alias("key"),
    )


def date_int(spark: SparkSession, d: str) -> DataFrame:
    """Time stamp text as a number."""
    tx = proxy.bulk_transactions(spark, d)
    return tx.select("pos", "created_at", x.date_int("created_at").alias("day"))


def hex_nonzero(spark: SparkSession, d: str) -> DataFrame:
    """Call data and hashes that are not zero."""
    return proxy.transactions(spark, d).select(
        "pos",
        x.hex_nonzero("input").alias("input_set"),
        x.hex_nonzero("hash").alias("hash_set"),
        x.hex_nonzero("gas").alias("gas_set"),
    )


def safe_numbers(spark: SparkSession, d: str) -> DataFrame:
    """X1 + X2 + X6 + F6 + F8: numbers out of text."""
    return proxy.transactions(spark, d, huge=True).select(
        "pos",
        x.ether("value").alias("ether"),
        x.safe_int("time_stamp").alias("ts"),
        x.valid_ts(x.safe_int("time_stamp")).alias("valid_ts"),
        x.safe_int("gas").alias("gas"),
        x.to_double_or_zero("gas").alias("gas_double"),
        seq.is_well_formed().alias("well_formed"),
    )


# -- training set -----------------------------------------------------------------------------


def undersample(spark: SparkSession, d: str) -> DataFrame:
    """U1 + U2: 100 accounts of class 0 and all of class 1."""
    return prep.undersample(proxy.accounts(spark, d), 100).select("address", "flag")


def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    """Train, validation and test in class proportion."""
    return prep.stratified_split(proxy.accounts(spark, d)).select("address", "flag", "split")


def split_counts(spark: SparkSession, d: str) -> DataFrame:
    """Records per split and class."""
    return prep.sequence_stats(prep.stratified_split(proxy.accounts(spark, d)))


def _gappy_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders with missing, not-a-number and text values."""
    o = proxy.table(spark, d, "orders")
    return o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(float("nan")))
        .otherwise(F.col("o_custkey").cast("double"))
        .alias("customer"),
        F.lit(None).cast("double").alias("nothing"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey").cast("string"))
        .otherwise(F.col("o_orderpriority"))
        .alias("text"),
    )


def impute_median(spark: SparkSession, d: str) -> DataFrame:
    """A14 + X6: medians for numbers, 0 for unreadable text."""
    return prep.impute(_gappy_orders(spark, d), ["price", "customer", "nothing", "text"])


def fit_scaler(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population std per column."""
    o = proxy.table(spark, d, "orders").withColumn("constant", F.lit(7.3)).repartition(7)
    stats = prep.fit_scaler(o, ["o_totalprice", "o_custkey", "constant"])
    return stats.select(
        "position", "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std")
    )


def scale_features(spark: SparkSession, d: str) -> DataFrame:
    """A15 + X13: columns scaled by mean and population std."""
    o = proxy.table(spark, d, "orders").select(
        "o_orderkey", "o_totalprice", "o_custkey", F.lit(7.3).alias("constant")
    ).repartition(7)
    scaled = prep.apply_scaler(o, prep.fit_scaler(o, ["o_totalprice", "o_custkey", "constant"]))
    return scaled.select(
        "o_orderkey",
        F.round("o_totalprice", 6).alias("o_totalprice"),
        F.round("o_custkey", 6).alias("o_custkey"),
        "constant",
    )


def assemble_training(spark: SparkSession, d: str) -> DataFrame:
    """Label and file-order sequence of every account, as sums per account."""
    listed = proxy.accounts(spark, d).select("address", "flag")
    steps = training.bulk_sequences(listed, proxy.bulk_transactions(spark, d))
    rows = prep.assemble(listed, seq.to_matrix(steps), width=len(steps.columns) - 2)
    total = F.aggregate("sequence", F.lit(0.0), lambda a, r: a + r[1])
    return rows.select(
        "address",
        "flag",
        F.size("sequence").alias("length"),
        F.size(F.filter("sequence", lambda r: r[0] != 0.0)).alias("real_rows"),
        F.round(total, 6).alias("value_total"),
    )


def one_hot_labels(spark: SparkSession, d: str) -> DataFrame:
    """Label as two outputs."""
    y = scores.one_hot("flag")
    return proxy.accounts(spark, d).select("address", y[0].alias("y0"), y[1].alias("y1"))


# -- scores and display -----------------------------------------------------------------------


def _scored(spark: SparkSession, d: str) -> DataFrame:
    """A fixed formula in place of a trained model, so that SQL can follow it."""
    f = _features(spark, d)
    z0 = F.lit(0.0) + F.col("received_count") / 100
    z1 = F.col("created_contracts") / 10 + F.col("unique_sent_to") / 50 - F.col("sent_count") / 200
    p0, p1 = scores.softmax2("z0", "z1")
    # Logits sit on a grid, so that no engine's last digit decides a verdict.
    return (
        f.withColumn("z0", F.round(z0, 4))
        .withColumn("z1", F.round(z1, 4))
        .withColumn("p0", F.round(p0, 6))
        .withColumn("p1", F.round(p1, 6))
        .withColumn("predicted", scores.argmax(F.array("z0", "z1")))
    )


def softmax_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Logits to probabilities, class, verdict, confidence."""
    return _scored(spark, d).select(
        "address",
        "p0",
        "p1",
        "predicted",
        scores.verdict("predicted").alias("verdict"),
        scores.confidence("p0", "p1").alias("confidence"),
    )


def risk_band(spark: SparkSession, d: str) -> DataFrame:
    """X14 + X15 + X17 + X18: how a result is shown."""
    return _scored(spark, d).select(
        "address",
        show.risk_band("p1").alias("band"),
        show.percent_label("p1").alias("label"),
        show.status_class(scores.verdict("predicted")).alias("status"),
        show.upper_verdict(scores.verdict("predicted")).alias("badge"),
    )


def accuracy(spark: SparkSession, d: str) -> DataFrame:
    """Two labels of the same documents, one taken as the prediction."""
    rows = proxy.table(spark, d, "labels")
    return metrics.accuracy(rows, "quality", "toxic").select(F.round("accuracy", 6).alias("accuracy"))


def bce_loss(spark: SparkSession, d: str) -> DataFrame:
    """Mean loss over two outputs."""
    return metrics.bce_loss(_scored(spark, d)).select(F.round("loss", 6).alias("loss"))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Actual against predicted."""
    return metrics.confusion_matrix(proxy.table(spark, d, "labels"), "quality", "toxic")


def predicted_confusion(spark: SparkSession, d: str) -> DataFrame:
    """A18 on predicted classes of scored accounts."""
    return metrics.confusion_matrix(_scored(spark, d))


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Scan results with the fixed formula as the model."""
    ranked = _recent(spark, d)
    rows = _scored(spark, d).withColumn(
        "prediction",
        model.prediction_struct()
        .withField("total_transactions", F.col("total_transactions").cast("int"))
        .withField("timestamp", F.lit("2024-02-01T00:00:00")),
    )
    return scan.nest_transactions(rows.select("address", "prediction"), ranked)


def analysis_row(spark: SparkSession, d: str) -> DataFrame:
    """The flat analysis of every account."""
    return scan.to_analysis_row(_results(spark, d)).drop("explanations")


# -- explanations --------------------------------------------------------------------------------


def explanation_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A prompt for every account judged as fraud."""
    return explain.explanation_prompts(_results(spark, d))


def _replies(spark: SparkSession, d: str) -> DataFrame:
    """One reply per part: a list of one reason, some in a fenced block; and the
    texts of conversations, which are no JSON."""
    reason = F.struct(
        F.col("p_name").alias("title"),
        F.col("p_type").alias("description"),
        F.array("p_brand").alias("examples"),
    )
    p = proxy.table(spark, d, "part").select(
        F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("address"),
        F.when(F.col("p_size") > 25, F.to_json(F.array(reason)))
        .otherwise(F.concat(F.lit("```json\n"), F.to_json(F.array(reason)), F.lit("\n```")))
        .alias("reply"),
    )
    c = proxy.table(spark, d, "conversations").select(
        F.concat_ws("-", F.lit("turn"), "conv_id", "turn").alias("address"),
        F.col("text").alias("reply"),
    )
    return p.unionByName(c)


def parse_explanations(spark: SparkSession, d: str) -> DataFrame:
    """Reasons out of replies; broken ones give none."""
    parsed = explain.parse_explanations(_replies(spark, d), on_error="null")
    return parsed.select("address", F.explode_outer("explanations").alias("e")).select(
        "address",
        F.col("e.title").alias("title"),
        F.col("e.description").alias("description"),
        F.concat_ws("|", "e.examples").alias("examples"),
    )


def visible_explanations(spark: SparkSession, d: str) -> DataFrame:
    """F10 + E3: reasons per account, shown for fraud only."""
    reasons = proxy.accounts(spark, d).where("flag = 1").select(
        "address",
        F.from_json(
            F.concat(F.lit('[{"title":"'), F.col("address"), F.lit('","examples":[]}]')),
            "array<struct<title:string,description:string,examples:array<string>>>",
        ).alias("explanations"),
    )
    rows = explain.attach_explanations(_results(spark, d), reasons)
    shown = show.visible_explanations("is_fraud", "explanations")
    return rows.select(
        "address",
        "is_fraud",
        F.coalesce(F.size("explanations"), F.lit(0)).alias("reasons"),
        F.get(shown, F.lit(0))["title"].alias("shown_title"),
    )


# -- sources --------------------------------------------------------------------------------------


def _responses(accounts: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """Responses about ranked transactions of accounts, the way an explorer answers; an
    account without any gets an error response."""
    return _answered(_listed(accounts, rows, kind))


def _listed(accounts: DataFrame, rows: DataFrame, kind: str) -> DataFrame:
    """Accounts with their ranked records in one list, null without any."""
    fields = KIND_FIELDS[kind]
    record = F.struct(*[F.col(c).alias(f) for f, c in fields.items()])
    lists = rows.groupBy("address").agg(
        F.sort_array(F.collect_list(F.struct("rank", record.alias("record")))).alias("ranked")
    )
    return accounts.select("address").join(lists, "address", "left")


def _answered(given: DataFrame) -> DataFrame:
    """Responses out of ``_listed``."""
    return given.select(
        "address",
        F.when(F.col("ranked").isNull(), "0").otherwise("1").alias("status"),
        F.when(F.col("ranked").isNull(), "No transactions found").otherwise("OK").alias("message"),
        F.when(F.col("ranked").isNull(), "Max rate limit reached")
        .otherwise(F.to_json("ranked.record")).alias("result"),
    )


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Responses of the newest 100 rows of every account."""
    return _responses(proxy.accounts(spark, d), _recent(spark, d), "txlist")


def explorer_records(spark: SparkSession, d: str) -> DataFrame:
    """S3 + F7: transactions out of explorer responses, one per account."""
    return explorer.records(_envelopes(spark, d)).select(
        "address", "pos", "hash", "from_address", "to_address", "value", "time_stamp"
    )


def explorer_internal(spark: SparkSession, d: str) -> DataFrame:
    """Landed internal transfers: calls with data and created contracts, with their traces."""
    rows = _recent(spark, d)
    created = F.col("contract_address") != ""
    rows = rows.where(created | (F.col("method_id") != "0x")).select(
        "*", F.when(created, "create").otherwise("call").alias("call_type"),
        F.concat_ws("_", F.col("transaction_index"), F.lit("1")).alias("trace_id"),
        F.when(F.col("is_error") == "1", "out of gas").otherwise("").alias("error_code"),
    )
    folder = new_path(spark, "landed")
    explorer.land(_responses(proxy.accounts(spark, d), rows, "txlistinternal"), folder, "txlistinternal", "1")
    return explorer.read_explorer(spark, folder, "txlistinternal").select(
        "address", "pos", "hash", "value", "contract_address", "call_type", "trace_id", "error_code"
    )


def explorer_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Landed token transfers, with amounts in tokens of their own decimals."""
    number = x.safe_int("nonce") % 7
    rows = _recent(spark, d).where(F.col("function_name").startswith("transfer(")).select(
        "*", F.concat(F.lit("Token "), number.cast("string")).alias("token_name"),
        F.concat(F.lit("T"), number.cast("string")).alias("token_symbol"),
        (number * 3).cast("string").alias("token_decimal"),
    )
    folder = new_path(spark, "landed")
    explorer.land(_responses(proxy.accounts(spark, d), rows, "tokentx"), folder, "tokentx", "1")
    return explorer.read_explorer(spark, folder, "tokentx").select(
        "address", "pos", "hash", "token_name", "token_symbol", "token_decimal",
        explorer.token_amount().alias("amount"),
    )


def explorer_strict(spark: SparkSession, d: str) -> DataFrame:
    """A strict reading of landed responses, and those that it refuses with the reason."""
    folder = new_path(spark, "landed")
    explorer.land(_envelopes(spark, d), folder, "txlist", "1")
    landed = explorer.newest(explorer.read_envelopes(spark, folder), prefer_ok=False)
    judged = tables.kept(landed.withColumn("problem", explorer.problem()))
    # Written, for in one plan the reading may come before the filter.
    read = explorer.records(tables.kept(judged.where(F.col("problem").isNull())), "fail")
    refused = judged.where(F.col("problem").isNotNull())
    none = lambda kind: F.lit(None).cast(kind)
    return read.select("address", "pos", "hash", "value", none("string").alias("problem")).unionByName(
        refused.select("address", none("bigint").alias("pos"), none("string").alias("hash"),
                       none("string").alias("value"), "problem")
    )


def explorer_landed_again(spark: SparkSession, d: str) -> DataFrame:
    """S3: accounts that landed several times: an old list, a new one twice, then a refusal."""
    folder = new_path(spark, "landed")
    # Histories are ranked and gathered once; every batch is made of the same lists.
    listed = kept_rows(_listed(proxy.accounts(spark, d), _recent(spark, d), "txlist"), "listed")
    now = _answered(listed).withColumn("page", F.lit(1))
    older = F.filter("ranked", lambda t: t["rank"] > 40)
    older = listed.withColumn("ranked", F.when(F.size(older) > 0, older))
    old = _answered(older).withColumn("page", F.lit(1))
    refused = now.withColumns({"status": F.lit("0"), "result": F.lit("Max rate limit reached")})
    for batch, rows in enumerate([old, now, now, refused]):
        explorer.land(rows.withColumn("landed_at", F.lit(batch).cast("bigint")), folder, "txlist", str(batch))
    # A replay of a batch is the batch again.
    explorer.land(now.withColumn("landed_at", F.lit(2).cast("bigint")), folder, "txlist", "2")
    return explorer.read_explorer(spark, folder).select(
        "address", "pos", "hash", "from_address", "to_address", "value", "time_stamp"
    )


def read_addresses(spark: SparkSession, d: str) -> DataFrame:
    """The registry as CSV under the names of its files, read back."""
    folder = new_path(spark, "addresses")
    proxy.accounts(spark, d).join(
        proxy.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal"), "key"
    ).select(
        F.col("key").alias("Index"), F.col("address").alias("Address"), F.col("flag").alias("FLAG"),
        F.col("c_acctbal").alias("avg val sent"),
    ).write.csv(folder, header=True)
    return tables.read_addresses(spark, folder).select(
        F.col("index").cast("bigint").alias("index"), "address", "flag", "avg_sent"
    )


def read_transactions(spark: SparkSession, d: str) -> DataFrame:
    """A bulk export in several CSV files, read back with row numbers in file order."""
    folder = new_path(spark, "transactions")
    columns = ["from_address", "to_address", "value", "gas", "block_number"]
    bulk = proxy.bulk_transactions(spark, d).repartitionByRange(5, "pos").sortWithinPartitions("pos")
    bulk.select(*columns).write.option("emptyValue", "").csv(folder, header=True)
    read = tables.read_transactions(spark, folder, numbered=True)
    first = proxy.bulk_transactions(spark, d).agg(F.min("pos")).first()[0] or 0
    return read.select(
        (F.col("pos") + first).alias("pos"), "from_address",
        F.coalesce("to_address", F.lit("")).alias("to_address"),
        "value", F.col("gas").cast("bigint").alias("gas"),
        F.col("block_number").cast("bigint").alias("block_number"),
    )


def feature_table(spark: SparkSession, d: str) -> DataFrame:
    """The feature table, written and read back."""
    return tables.kept(_features(spark, d).select("address", "flag", *COMPUTED_FEATURES))


def written_results(spark: SparkSession, d: str) -> DataFrame:
    """S8 + X20: results as JSON in a folder named by the time."""
    results = _results(spark, d)
    path = tables.write_results(results, new_path(spark, "results"))
    stamped = F.regexp_like(F.lit(path), F.lit("run=[0-9]{8}_[0-9]{6}_[0-9a-f]{8}$"))
    return spark.read.schema(results.schema).json(path).select(
        "address", "prediction.is_fraud", "prediction.total_transactions", stamped.alias("stamped")
    )


def kept_history_scan(spark: SparkSession, d: str) -> DataFrame:
    """J3 + W1 + A1-A13 for the flagged accounts over a kept history."""
    folder = new_path(spark, "history")
    tables.write_history(proxy.transactions(spark, d), folder, shards=16)
    listed = _flagged(spark, d)
    kept = tables.read_history(spark, folder, listed)
    hubs = tables.read_hubs(spark, folder)
    rows = scan.profiles(listed, kept, hot=hubs, keyed=True, with_transactions=False)
    return rows.select("address", *COMPUTED_FEATURES)


# -- models: what does not depend on the weights ------------------------------------------------------


def _prepared(spark: SparkSession, d: str) -> DataFrame:
    return training.prepare(proxy.accounts(spark, d).drop("key"), proxy.transactions(spark, d))


def _fitted(spark: SparkSession, d: str) -> tuple[model.RiskModel, DataFrame]:
    return training.fit(_prepared(spark, d), algorithm="logistic")


def _sound() -> list[Column]:
    """Two statements that hold for every prediction."""
    p = F.col("prediction")
    p0, p1 = p["normal_probability"], p["fraud_probability"]
    agrees = (p["is_fraud"] == (p1 > p0)) & (p["confidence"] == F.greatest(p0, p1))
    verdict = p["prediction"] == F.when(p["is_fraud"], "Fraud").otherwise("Normal")
    return [(F.abs(p0 + p1 - 1) < 1e-9).alias("sums_to_one"), (agrees & verdict).alias("agrees")]


def _quality(rows: DataFrame) -> DataFrame:
    """Quality of a trained model per split, and whether it is what its stored predictions say."""
    rows = tables.kept(rows)
    fitted, quality = training.fit(rows, algorithm="logistic")
    stored = tables.kept(model.predictions(rows, fitted).select("address", "flag", "p0", "p1", "predicted"))
    chance = F.when(F.col("flag") == 1, F.col("p1")).otherwise(F.col("p0"))
    again = prep.stratified_split(stored).groupBy("split").agg(
        F.avg((F.col("predicted") == F.col("flag")).cast("double")).alias("share"),
        F.avg(-F.log(chance)).alias("loss_again"),
    )
    finite = F.col("loss").isNotNull() & ~F.isnan("loss") & (F.abs("loss") < float("inf"))
    return quality.join(again, "split").select(
        "split", "records", F.col("accuracy").between(0, 1).alias("in_range"), finite.alias("finite"),
        (F.abs(F.col("accuracy") - F.col("share")) < 1e-9).alias("same_accuracy"),
        (F.abs(F.col("loss") - F.col("loss_again")) < 1e-6).alias("same_loss"),
    )


def train_and_score(spark: SparkSession, d: str) -> DataFrame:
    """M1-M3: train on all registered accounts, then score them."""
    # Training and scoring read what was made of the histories once.
    rows = tables.kept(_prepared(spark, d))
    fitted, _ = training.fit(rows)
    return model.score(rows, fitted).select(
        "address", "flag", "prediction.features_used", "prediction.sequence_length", *_sound()
    )


def model_quality(spark: SparkSession, d: str) -> DataFrame:
    """M5 + A17: accuracy and loss per split."""
    return _quality(_prepared(spark, d))


def bulk_model(spark: SparkSession, d: str) -> DataFrame:
    """The training path from a bulk export: balance, impute, file-order sequences, fit."""
    listed = proxy.accounts(spark, d).join(_features(spark, d).drop("flag", "key"), "address")
    majority = prep.filter_label(listed, 0).count()
    rows = training.prepare_bulk(listed, proxy.bulk_transactions(spark, d), majority)
    return _quality(rows)


_WEIGHED = ["sent_count", "unique_sent_to"]


def _two_features(spark: SparkSession, d: str) -> DataFrame:
    """Accounts with two features, scaled on the training rows, and their split."""
    rows = prep.stratified_split(_features(spark, d).select("address", "flag", *_WEIGHED))
    scaler = prep.fit_scaler(rows.where("split = 'train'"), _WEIGHED)
    return tables.kept(prep.apply_scaler(rows, scaler))


def trained_weights(spark: SparkSession, d: str) -> DataFrame:
    """M2: weights of a trained model beside those of Newton's steps, which SQL repeats."""
    rows = _two_features(spark, d)
    train = rows.where("split = 'train'")
    closed = newton.newton_weights(train, _WEIGHED)
    # A sequence of nothing leaves the two features alone in the model.
    pooled = F.array_repeat(F.lit(0.0), len(seq.pool_names()))
    fitted = model.train_classifier(
        train.withColumn("pooled", pooled), _WEIGHED, "logistic", epochs=500, tolerance=1e-13
    )
    # The features were scaled before, so the model's own scaling changes nothing but rounding.
    learned = [c / s for c, s in zip(fitted.classifier.coefficients, fitted.stds)][: len(_WEIGHED)]
    base = fitted.classifier.intercept - sum(w * m for w, m in zip(learned, fitted.means))
    table = newton.weights_table(spark, _WEIGHED, newton=closed, trained=[base, *learned])
    return table.select(
        "position", "name", F.round("newton", 6).alias("newton"), F.round("trained", 3).alias("trained")
    )


def model_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """M5: accuracy and loss of a trained model per split, which SQL computes from weights of its own."""
    rows = _two_features(spark, d).withColumn("pooled", F.array_repeat(F.lit(0.0), len(seq.pool_names())))
    fitted = model.train_classifier(
        rows.where("split = 'train'"), _WEIGHED, "logistic", epochs=500, tolerance=1e-13
    )
    return model.evaluate(rows, fitted, by="split").select(
        "split", "records", F.round("accuracy", 6).alias("accuracy"), F.round("loss", 4).alias("loss")
    )


def model_predictions(spark: SparkSession, d: str) -> DataFrame:
    """M6: how many accounts of each actual class have a prediction."""
    # Training and scoring read what was made of the histories once.
    rows = tables.kept(_prepared(spark, d))
    fitted, _ = training.fit(rows, algorithm="gbt")
    stored = tables.kept(model.predictions(rows, fitted).select("flag", "p0", "p1"))
    likelier = (F.col("p1") > F.col("p0")).cast("int").alias("predicted")
    counted = stored.select(F.col("flag").alias("actual"), likelier).groupBy("actual", "predicted").count()
    cells = metrics.confusion_matrix(model.predictions(rows, fitted)).join(
        counted, ["actual", "predicted"], "left"
    )
    same = F.col("records") == F.coalesce("count", F.lit(0))
    return cells.groupBy("actual").agg(F.sum("records").alias("records"), F.bool_and(same).alias("same_cells"))


def model_agreement(spark: SparkSession, d: str) -> DataFrame:
    """M6: per account, whether the predicted class is the likelier one of a trained model."""
    # Training and scoring read what was made of the histories once.
    rows = tables.kept(_prepared(spark, d))
    fitted, _ = training.fit(rows, algorithm="gbt")
    p = tables.kept(model.predictions(rows, fitted).select("address", "flag", "p0", "p1", "predicted"))
    return p.select(
        "address", F.col("flag").alias("actual"), F.col("predicted").isin(0, 1).alias("is_class"),
        (F.col("predicted") == (F.col("p1") > F.col("p0")).cast("int")).alias("agrees"),
    )


def score_static_only(spark: SparkSession, d: str) -> DataFrame:
    """M4: scores from static features alone."""
    fitted, _ = _fitted(spark, d)
    return model.score_static_only(_features(spark, d), fitted).select("address", *_sound())


def batch_scan(spark: SparkSession, d: str) -> DataFrame:
    """M7 + M8: scan every registered account as one batch."""
    accounts, tx = proxy.accounts(spark, d), proxy.transactions(spark, d)
    fitted, _ = _fitted(spark, d)
    listed = accounts.select("address", F.col("key").alias("batch_index"))
    return scan.batch_scan(listed, tx, fitted).select(
        "batch_index",
        "address",
        "prediction.total_transactions",
        F.size("transactions_used").alias("used"),
        "prediction.features_used",
        "prediction.sequence_length",
        *_sound(),
    )


def batch_failures(spark: SparkSession, d: str) -> DataFrame:
    """M8 + F11: requests that a strict batch leaves out, with the reason."""
    c = proxy.table(spark, d, "customer")
    asked = c.select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("address"))
    return scan.failed_requests(asked, strict=True)


def _streamed(spark: SparkSession, d: str, asked: Column, schema: str, file: str) -> str:
    """Answers to requests that arrive as a file of a stream."""
    fitted, _ = _fitted(spark, d)
    arriving = (
        spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(d)
        .select(F.explode(asked).alias("address"))
    )
    folder = new_path(spark, "stream")
    tx = proxy.transactions(spark, d)
    query = requests.scan_stream(
        arriving, tx, fitted, folder, f"{folder}/state", strict=True, hot=inc.hot_accounts(tx)
    )
    query.awaitTermination()
    return folder


def scan_stream(spark: SparkSession, d: str) -> DataFrame:
    """The registered accounts arrive as a stream of requests."""
    asked = F.array(proxy.address_of(F.col("c_custkey")))
    folder = _streamed(spark, d, asked, "c_custkey bigint", "customer.parquet")
    answers = spark.read.json(f"{folder}/answers").select("address", "prediction", "transactions_used")
    return answers.select(
        "address", F.col("prediction.total_transactions").cast("int").alias("total_transactions"),
        F.size("transactions_used").alias("used"), *_sound(),
    )


def newest_stream(spark: SparkSession, d: str) -> DataFrame:
    """R1 + W1: transactions arrive in four files and are kept as state; then the stream is started
    again, and requests arrive, each of them twice."""
    folder = new_path(spark, "stream")
    columns = ["pos", *HISTORY_COLUMNS]
    tx = proxy.transactions(spark, d).select(*columns)
    # Small row groups: a micro-batch has one file, and a task reads a row group at least.
    tx.repartitionByRange(4, "pos").write.option("parquet.block.size", 8 << 20).parquet(f"{folder}/tx")
    accounts = proxy.accounts(spark, d)
    asked = accounts.select(
        F.col("key").cast("string").alias("request"), "address",
        F.lit("2024-01-01 00:00:00").cast("timestamp").alias("asked_at"),
    )
    asked.limit(0).write.parquet(f"{folder}/asked")

    def run() -> None:
        arriving = spark.readStream.schema(tx.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/tx")
        requested = (
            spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/asked")
        )
        newest.answer_stream(
            arriving, newest.deduplicated(requested),
            lambda good, rows: scan.profiles(good, rows, 100, keyed=True).select("address", "transactions_used"),
            f"{folder}/out", f"{folder}/state", k=100, pieces=2,
        ).awaitTermination()

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, newest.PROVIDER)
    try:
        run()
        for _ in range(2):
            asked.coalesce(1).write.mode("append").parquet(f"{folder}/asked")
        run()
    finally:
        spark.conf.set(name, before)
    used = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in HISTORY_COLUMNS]))
    schema = T.StructType([T.StructField("address", T.StringType()), T.StructField("transactions_used", used)])
    answers = spark.read.schema(schema).json(f"{folder}/out/answers")
    return answers.select("address", F.posexplode_outer("transactions_used").alias("at", "t")).select(
        "address", (F.col("at") + 1).alias("rank"), *[F.col("t")[c].alias(c) for c in HISTORY_COLUMNS]
    )


def quality_counters(spark: SparkSession, d: str) -> DataFrame:
    """what was blank or unreadable in the input of a scan, counted while it ran."""
    i = F.col("pos")
    tx = proxy.transactions(spark, d, huge=True).withColumns({
        "from_address": F.when(i % 113 != 0, F.col("from_address")),
        "to_address": F.when(i % 127 != 0, F.col("to_address")),
    })
    watch = Observation()
    rows = scan.profiles(proxy.accounts(spark, d), tx, with_transactions=False, encoding="pooled", watch=watch)
    rows.write.format("noop").mode("overwrite").save()
    good, failed = scan.check_requests(_candidates(spark, d).withColumnRenamed("candidate", "address"), strict=True)
    both = good.withColumn("reason", F.lit(None).cast("string")).unionByName(failed)
    asked, counted = quality.observed(both, quality.request_counters())
    asked.write.format("noop").mode("overwrite").save()
    return quality.counters_table(spark, watch, counted)


def stream_failures(spark: SparkSession, d: str) -> DataFrame:
    """R1 + F11: requests of a stream that get a reason instead of an answer."""
    c = F.col("c_custkey")
    asked = F.array(F.col("c_name"), F.concat(proxy.address_of(c), F.lit("\n")))
    folder = _streamed(spark, d, asked, "c_custkey bigint, c_name string", "customer.parquet")
    return spark.read.schema("address string, reason string").json(f"{folder}/failed").select("address", "reason")


def saved_model(spark: SparkSession, d: str) -> DataFrame:
    """A model that was saved and loaded scores like the first one."""
    rows = tables.kept(_prepared(spark, d))
    fitted, _ = training.fit(rows, algorithm="logistic")
    folder = new_path(spark, "model")
    model.save_model(spark, fitted, folder)
    again = model.predictions(rows, model.load_model(spark, folder)).select("address", F.col("p1").alias("q1"))
    return model.predictions(rows, fitted).join(again, "address").select(
        "address", (F.abs(F.col("p1") - F.col("q1")) < 1e-12).alias("same")
    )


def feature_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The features that a fitted model uses."""
    return model.feature_catalog(spark, _fitted(spark, d)[0])


def model_info(spark: SparkSession, d: str) -> DataFrame:
    """One row about a fitted model."""
    return model.model_info(spark, _fitted(spark, d)[0]).select(
        "model_type", "num_features", F.size("feature_columns").alias("listed")
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        account_features,
        account_features_full,
        rolled_features,
        rolled_features_coarse,
        align_features,
        touching_transactions,
        incidence_counts,
        history_roles,
        distinct_accounts,
        filter_label,
        numeric_projection,
        select_existing,
        recent_k,
        page_history,
        deep_page,
        deep_page_oldest,
        tx_gaps,
        batch_index,
        first_n_sequence,
        latest_sequence,
        padded_length,
        profile_sequence,
        pooled_sequence,
        nest_transactions,
        validate_address,
        failed_requests,
        short_address,
        date_int,
        hex_nonzero,
        safe_numbers,
        undersample,
        stratified_split,
        split_counts,
        impute_median,
        fit_scaler,
        scale_features,
        assemble_training,
        one_hot_labels,
        softmax_verdict,
        risk_band,
        accuracy,
        bce_loss,
        confusion_matrix,
        predicted_confusion,
        analysis_row,
        explanation_prompts,
        parse_explanations,
        visible_explanations,
        explorer_records,
        touching_blank,
        touching_long_list,
        incidence_long_list,
        history_long_list,
        recent_k_hubs,
        page_history_hubs,
        tx_gaps_hubs,
        latest_sequence_hubs,
        kept_history_scan,
        read_addresses,
        read_transactions,
        explorer_internal,
        explorer_tokens,
        explorer_strict,
        explorer_landed_again,
        feature_table,
        written_results,
        train_and_score,
        trained_weights,
        model_evaluation,
        model_quality,
        bulk_model,
        model_predictions,
        model_agreement,
        score_static_only,
        batch_scan,
        batch_failures,
        scan_stream,
        newest_stream,
        quality_counters,
        stream_failures,
        saved_model,
        feature_catalog,
        model_info,
    )
}
