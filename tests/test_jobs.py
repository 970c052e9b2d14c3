import json

import pytest
from pyspark.sql import functions as F

from txrisk.operators.incidence import account_rows
from txrisk.operators.sequences import pool
from txrisk.operators.skew import hot_keys
from txrisk.plans import explain, model, scan, training
from txrisk.schemas import COMPUTED_FEATURES, STATIC_FEATURES
from txrisk.sources import explorer, tables
from txrisk.sources.checkpoints import shared_folder
from txrisk.streaming import requests


# -- sources ------------------------------------------------------------------


def test_read_addresses(spark, tmp_path):
    names = list(STATIC_FEATURES)
    header = ["Index", "Address", "FLAG", *names[:10], "extra"]
    line = ["1", "0xa", "1", *["1.5"] * 10, "z"]
    path = tmp_path / "accounts.csv"
    path.write_text(",".join(header) + "\n" + ",".join(line) + "\n")
    df = tables.read_addresses(spark, str(path))
    assert df.columns == ["index", "address", "flag", *list(STATIC_FEATURES.values())[:10], "extra"]
    kinds = dict(df.dtypes)
    assert kinds["flag"] == "int" and kinds["max_received"] == "double" and kinds["extra"] == "string"
    assert df.schema["max_received"].metadata["original"] == "max value received "
    assert df.first()["max_received"] == 1.5
    assert tables.read_addresses(spark, str(path), infer=True).columns == df.columns


def test_read_transactions(spark, tmp_path):
    path = tmp_path / "tx.csv"
    path.write_text(
        "from_address,to_address,created_at,value,gas\n"
        "0xa,0xb,2024-01-01 00:00:00.5,7,21000\n0xb,,2024-01-02 00:00:00.25,1e20,5\n"
    )
    df = tables.with_row_number(tables.read_transactions(spark, str(path)))
    kinds = dict(df.dtypes)
    assert (kinds["value"], kinds["gas"], kinds["created_at"]) == ("double", "int", "string")
    assert [r["pos"] for r in df.collect()] == [0, 1]
    given = tables.read_transactions(spark, str(path), df.drop("pos").schema)
    assert given.collect() == df.drop("pos").collect()


def land(tmp_path, kind, *envelopes):
    folder = tmp_path / f"kind={kind}"
    folder.mkdir()
    (folder / "part.json").write_text("\n".join(json.dumps(e) for e in envelopes))
    return str(tmp_path)


def test_explorer(spark, tmp_path):
    good = [{"hash": "0x1", "from": "0xa", "to": "", "value": "5"}, {"hash": "0x2", "from": "0xb"}]
    path = land(
        tmp_path,
        "txlistinternal",
        {"address": "0xa", "status": "1", "message": "OK", "result": good},
        {"address": "0xb", "status": "0", "message": "NOTOK", "result": "Max rate limit reached"},
        {"address": "0xc", "status": "0", "message": "No transactions found", "result": []},
    )
    rows = explorer.read_explorer(spark, path, "txlistinternal").orderBy("pos").collect()
    assert [(r["address"], r["pos"], r["hash"], r["to_address"]) for r in rows] == [
        ("0xa", 0, "0x1", ""), ("0xa", 1, "0x2", None),
    ]
    with pytest.raises(Exception, match="without a list for 0xb"):
        explorer.read_explorer(spark, path, "txlistinternal", on_error="fail").collect()
    with pytest.raises(ValueError):
        explorer.read_explorer(spark, path, "blocks")


def test_keyed_history_is_scanned_like_a_bulk_table(spark, make_tx, listed):
    tx = make_tx({"time_stamp": "50"}, {"from_address": "0xb", "to_address": "0xA", "time_stamp": "90"})
    keyed = tx.withColumn("address", F.lit("0xa"))
    bulk = scan.profiles(listed("0xa"), tx).collect()
    assert scan.profiles(listed("0xa"), keyed, keyed=True).drop("transactions_used").collect() == [
        r for r in scan.profiles(listed("0xa"), tx).drop("transactions_used").collect()
    ]
    assert bulk[0]["sent_count"] == bulk[0]["received_count"] == 1


def test_features_round_trip(spark, tmp_path, make_tx, listed):
    df = scan.profiles(listed("0xa"), make_tx({}), with_transactions=False)
    tables.write_features(df, str(tmp_path / "f"))
    assert tables.read_features(spark, str(tmp_path / "f")).collect() == df.collect()


@pytest.mark.parametrize("hot_rows", [None, 1])
def test_kept_history_reads_only_the_folders_of_the_list(spark, make_tx, listed, tmp_path, hot_rows):
    tx = make_tx(*[{"from_address": f"0x{i % 5}", "time_stamp": str(i + 1)} for i in range(40)])
    hot = hot_keys(account_rows(tx), "address", hot_rows) if hot_rows else None
    tables.write_history(tx, str(tmp_path / "h"), shards=64, hot=hot)
    some = listed("0x1", "0X3")
    # The number of folders is kept with the data.
    kept = tables.read_history(spark, str(tmp_path / "h"), some)
    folders = F.regexp_extract(F.input_file_name(), "shard=([0-9]+)", 1)
    assert 1 <= kept.select(folders).distinct().count() <= 2
    a = scan.profiles(some, tx).orderBy("address").collect()
    assert scan.profiles(some, kept, keyed=True).orderBy("address").collect() == a
    assert tables.read_history(spark, str(tmp_path / "h")).count() == 80


# -- models -------------------------------------------------------------------


@pytest.fixture(scope="module")
def separable(spark):
    """Class 1 sends a lot, class 0 little."""
    df = spark.range(240).select(
        F.concat(F.lit("0x"), F.lpad(F.col("id").cast("string"), 40, "0")).alias("address"),
        (F.col("id") % 2).cast("int").alias("flag"),
    )
    noise = F.pmod(F.xxhash64("address"), F.lit(100)) / 100
    step = F.array(*[(F.col("flag") + noise).cast("double")] * 10)
    return df.select(
        "*",
        (F.col("flag") * 10 + noise).alias("sent_count"),
        noise.alias("received_count"),
        F.array_repeat(step, 50).alias("sequence"),
    ).cache()


@pytest.mark.parametrize(
    "algorithm, encoding", [("mlp", "pooled"), ("logistic", "flat"), ("gbt", "pooled")]
)
def test_train_score_save_load(spark, separable, tmp_path, algorithm, encoding):
    fitted, quality = training.fit(separable, algorithm=algorithm, encoding=encoding)
    rows = {r["split"]: r for r in quality.collect()}
    assert {s: r["records"] for s, r in rows.items()} == {"train": 168, "val": 36, "test": 36}
    assert rows["test"]["accuracy"] > 0.9 and rows["test"]["loss"] < 0.7
    scored = model.score(separable, fitted)
    p = scored.select("prediction.*").collect()
    assert all(r["fraud_probability"] + r["normal_probability"] == pytest.approx(1) for r in p)
    assert all(r["is_fraud"] == (r["prediction"] == "Fraud") for r in p)
    assert all(r["confidence"] == max(r["fraud_probability"], r["normal_probability"]) for r in p)
    assert (p[0]["features_used"], p[0]["sequence_length"]) == (2, 50)
    model.save_model(spark, fitted, str(tmp_path / "m"))
    loaded = model.load_model(spark, str(tmp_path / "m"))
    assert model.score(separable, loaded).select("prediction").collect() == scored.select("prediction").collect()
    assert model.feature_catalog(spark, loaded).where("group = 'static'").count() == 2
    assert model.model_info(spark, loaded).first()["num_features"] == 2


def test_static_only_equals_a_zero_sequence(spark, separable):
    fitted, _ = training.fit(separable, algorithm="logistic")
    zeros = separable.withColumn("sequence", F.array_repeat(F.array_repeat(F.lit(0.0), 10), 50))
    a = model.score(zeros, fitted).orderBy("address").select("prediction.fraud_probability").collect()
    only = model.score_static_only(separable.drop("sequence"), fitted).orderBy("address")
    assert only.select("prediction.fraud_probability").collect() == a
    assert only.select("prediction.*").columns == [
        "prediction", "fraud_probability", "normal_probability", "confidence", "is_fraud",
    ]


def test_load_refuses_a_wrong_width(spark, separable, tmp_path):
    fitted, _ = training.fit(separable, algorithm="logistic")
    fitted.means, fitted.stds = fitted.means[:-1], fitted.stds[:-1]
    model.save_model(spark, fitted, str(tmp_path / "m"))
    with pytest.raises(ValueError, match="scaler covers"):
        model.load_model(spark, str(tmp_path / "m"))


def test_pool(spark):
    df = spark.createDataFrame([([[1.0] + [0.0] * 9, [3.0] + [0.0] * 9],)], "m array<array<double>>")
    v = df.select(pool(F.col("m")).alias("v")).first()["v"]
    assert (v[0], v[10], v[20], v[30]) == (2.0, 3.0, 1.0, 1.0)


def test_prepare_bulk(spark, separable):
    tx = spark.range(500).select(
        F.col("id").alias("pos"),
        F.concat(F.lit("0x"), F.lpad((F.col("id") % 9).cast("string"), 40, "0")).alias("from_address"),
        F.lit("").alias("to_address"),
        F.lit(None).cast("string").alias("source_address"),
        F.lit("2024-01-05 00:00:00.0").alias("created_at"),
        F.col("id").cast("double").alias("value"),
        F.lit(1).alias("nonce"),
    )
    rows = training.prepare_bulk(separable.drop("sequence"), tx, majority=100).collect()
    assert len(rows) == 220
    by_address = {r["address"]: r for r in rows}
    one = by_address["0x" + "0" * 39 + "1"]["sequence"]
    assert len(one) == 50 and one[0] == [20240105.0, 1.0] and one[1] == [20240105.0, 10.0]


# -- scanning, explaining, streaming -----------------------------------------------


@pytest.fixture(scope="module")
def fitted(spark, separable):
    wide = separable.select(
        "address", "flag", "sequence", "sent_count", "received_count",
        *[F.lit(0.0).alias(c) for c in COMPUTED_FEATURES if c not in ("sent_count", "received_count")],
    )
    return training.fit(wide, algorithm="logistic")[0]


def test_scan_and_batch(spark, make_tx, listed, fitted, tmp_path):
    tx = make_tx({}, {"from_address": "0xb", "to_address": "0xA"})
    rows = {r["address"]: r for r in scan.scan(listed("0xA", "0xnone"), tx, fitted).collect()}
    assert rows["0xA"]["prediction"]["total_transactions"] == 2
    assert rows["0xnone"]["prediction"]["total_transactions"] == 0
    assert rows["0xnone"]["transactions_used"] == []
    assert list(rows["0xA"]["prediction"].asDict()) == [
        "prediction", "fraud_probability", "normal_probability", "confidence", "is_fraud",
        "features_used", "sequence_length", "total_transactions", "timestamp",
    ]
    asked = spark.createDataFrame([("0xA", 5), (None, 6), ("0xA", 7)], "address string, batch_index int")
    saved = scan.batch_scan(asked, tx, fitted, save_to=str(tmp_path))
    assert sorted((r["batch_index"], r["address"]) for r in saved.collect()) == [(5, "0xA"), (7, "0xA")]
    assert sorted(p.name[:4] for p in tmp_path.iterdir()) == ["fail", "qual", "run="]
    lost = spark.read.json(str(tmp_path / "failed")).collect()
    assert [(r["batch_index"], r["reason"]) for r in lost] == [(6, "missing")]
    none = scan.batch_scan(asked.where("address is null"), tx, fitted, save_to=str(tmp_path / "x"))
    assert none.count() == 0 and sorted(p.name for p in (tmp_path / "x").iterdir()) == ["failed", "quality"]
    _, failed = scan.check_requests(asked, strict=True)
    assert sorted(r["reason"] for r in failed.collect()) == ["invalid", "invalid", "missing"]


def test_explanations(spark, make_tx, listed, fitted):
    results = scan.scan(listed("0xa", "0xb"), make_tx({}), fitted)
    prompts = explain.explanation_prompts(results, only_fraud=False).collect()
    assert len(prompts) == 2 and all('"hash":"0xh0000"' in r["prompt"] for r in prompts)
    frauds = results.where("prediction.is_fraud").count()
    assert explain.explanation_prompts(results).count() == frauds
    reply = '[{"title":"t","description":"d","examples":["e1","e2"]},{"title":"u"}]'
    replies = spark.createDataFrame([("0xa", f" ```json\n{reply}\n``` ")], "address string, reply string")
    reasons = explain.parse_explanations(replies)
    assert reasons.first()["explanations"][0]["examples"] == ["e1", "e2"]
    assert reasons.first()["explanations"][1]["examples"] is None
    rows = {r["address"]: r for r in explain.attach_explanations(results, reasons).collect()}
    assert len(rows["0xa"]["explanations"]) == 2 and rows["0xb"]["explanations"] is None
    assert isinstance(rows["0xa"]["fraud_probability"], str)
    assert list(rows["0xa"].asDict()) == [
        "prediction", "is_fraud", "address", "total_transactions", "analysis_timestamp",
        "confidence", "fraud_probability", "explanations",
    ]


@pytest.mark.parametrize("reply", [None, "", "  ", "```json\n```", "[{broken", "no json"])
def test_bad_replies(spark, reply):
    df = spark.createDataFrame([("a", reply)], "address string, reply string")
    assert explain.parse_explanations(df, on_error="null").first()["explanations"] is None
    with pytest.raises(Exception):
        explain.parse_explanations(df).collect()


def test_stream_equals_batch_and_survives_a_replay(spark, make_tx, fitted, tmp_path):
    tx = make_tx({}, {"from_address": "0xb", "to_address": "0xa"})
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"address": "0xa"}\n{"address": "0xb"}\n{"other": 1}\n')

    def run(state):
        stream = requests.read_requests(spark, str(source))
        requests.scan_stream(stream, tx, fitted, str(tmp_path / "out"), str(tmp_path / state)).awaitTermination()
        failed = spark.read.json(str(tmp_path / "out" / "failed"))
        assert [r["reason"] for r in failed.collect()] == ["missing"]
        found = spark.read.json(str(tmp_path / "out" / "answers")).select("address", "prediction.fraud_probability")
        return sorted(map(tuple, found.collect()))

    asked = spark.createDataFrame([("0xa",), ("0xb",)], "address string")
    tables.write_history(tx, str(tmp_path / "h"), shards=8)
    lookup = lambda some: tables.read_history(spark, str(tmp_path / "h"), some)
    requests.scan_stream(
        requests.read_requests(spark, str(source)), lookup, fitted, str(tmp_path / "kept"),
        str(tmp_path / "s0"), keyed=True,
    ).awaitTermination()
    kept = spark.read.json(str(tmp_path / "kept" / "answers")).select("address", "prediction.fraud_probability")
    batch = scan.scan(asked, tx, fitted).select("address", "prediction.fraud_probability")
    first = run("s1")
    assert first == sorted(map(tuple, batch.collect())) == sorted(map(tuple, kept.collect()))
    # The same batch again, as after a lost acknowledgement.
    assert run("s2") == first
    (source / "2.json").write_text('{"address": "0xc"}\n')
    assert len(run("s1")) == 3


class Session:
    """As much of a session as the shared folder asks for."""

    def __init__(self, given=None, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}
        self.sparkContext = self
        self.getCheckpointDir = lambda: given


def test_shared_folder():
    named = Session("file:/given", spark_checkpoint_dir="hdfs://shared/x")
    assert shared_folder(named) == "hdfs://shared/x"
    assert shared_folder(Session("file:/given")) == "file:/given"
    # There is no folder of the machine's own.
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
