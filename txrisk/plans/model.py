"""Training, scoring and keeping a risk model with Spark ML.

A model sees an account as one vector: the static features, then the sequence,
either pooled per channel or flattened.  The vector is built as an array column
and scaled by constants, so scoring is a projection without a shuffle.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.functions.scores import argmax, confidence, verdict
from txrisk.operators.metrics import row_loss
from txrisk.operators.prep import exact_mean, population_std
from txrisk.operators.sequences import pool, pool_names, zero_row
from txrisk.schemas import (
    FEATURES,
    HIDDEN_LAYERS,
    SEQUENCE_LENGTH,
    SEQUENCE_WIDTH,
)
from txrisk.sources.checkpoints import new_path
from txrisk.sources.tables import kept

CLASSIFIERS = {
    "mlp": MultilayerPerceptronClassificationModel,
    "logistic": LogisticRegressionModel,
    "gbt": GBTClassificationModel,
}


@dataclass
class RiskModel:
    """A fitted classifier with all that is needed to feed it."""

    algorithm: str
    classifier: object
    feature_columns: list[str]
    encoding: str = "pooled"
    sequence_length: int = SEQUENCE_LENGTH
    sequence_width: int = SEQUENCE_WIDTH
    # Newest transactions of an account that features are made of; a scan takes as many.
    k: int = 1000
    means: list[float] = field(default_factory=list)
    stds: list[float] = field(default_factory=list)

    @property
    def config(self) -> dict:
        return {
            "algorithm": self.algorithm,
            "encoding": self.encoding,
            "sequence_input_size": self.sequence_width,
            "newest_transactions": self.k,
            "static_input_size": len(self.feature_columns),
            "sequence_length": self.sequence_length,
            "fc_hidden_sizes": HIDDEN_LAYERS if self.algorithm == "mlp" else [],
            "num_classes": 2,
        }


# -- vectors (M1) ---------------------------------------------------------------


def width_of(df: DataFrame) -> int:
    """Numbers in a step of ``sequence``; every row has as many.  ``pooled`` was made of
    ordinary steps."""
    if "pooled" in df.columns:
        return SEQUENCE_WIDTH
    row = df.where(F.size("sequence") > 0).select(F.size(F.get("sequence", F.lit(0)))).first()
    return row[0] if row else SEQUENCE_WIDTH


def _raw_values(df: DataFrame, columns: list[str], encoding: str, width: int) -> Column:
    static = F.array(
        *[
            F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0)
            for c in columns
        ]
    )
    if encoding != "pooled":
        sequence = F.flatten("sequence")
    elif "pooled" in df.columns:
        sequence = F.col("pooled")
    else:
        sequence = pool(F.col("sequence"), width)
    return F.concat(static, sequence)


def encode(
    df: DataFrame, columns: list[str], encoding: str = "pooled", width: int = SEQUENCE_WIDTH
) -> DataFrame:
    """Replaces features and ``sequence`` by ``raw_values``, one array of numbers.

    Absent or null features are 0.  The array is far smaller than the sequence.
    """
    kept = [f"`{c}`" for c in df.columns if c not in columns and c not in ("sequence", "pooled")]
    return df.select(*kept, _raw_values(df, columns, encoding, width).alias("raw_values"))


def assemble_vector(df: DataFrame, model: RiskModel) -> DataFrame:
    """M1: adds ``features``: scaled static features and the encoded sequence.

    Pooled sequences are scaled like the static features.  Flattened ones stay
    as they are, so the scaler covers the leading positions only.
    """
    encoded = "raw_values" in df.columns
    rows = df if encoded else df.withColumn(
        "raw_values", _raw_values(df, model.feature_columns, model.encoding, model.sequence_width)
    )
    n = len(model.means)
    means = F.array(*[F.lit(m) for m in model.means])
    stds = F.array(*[F.lit(s) for s in model.stds])
    scaled = F.transform(
        F.slice("raw_values", 1, n),
        lambda v, i: (v - F.get(means, i)) / F.get(stds, i),
    )
    rest = F.slice("raw_values", n + 1, F.size("raw_values"))
    out = rows.withColumn("features", array_to_vector(F.concat(scaled, rest)))
    return out if encoded else out.drop("raw_values")


def _fit_scaler(encoded: DataFrame, model: RiskModel) -> tuple[list, list]:
    """A15 over the vector: mean and population std of every scaled position."""
    pooled = len(pool_names(model.sequence_width)) if model.encoding == "pooled" else 0
    n = len(model.feature_columns) + pooled
    value = [F.get("raw_values", F.lit(i)) for i in range(n)]
    stats = encoded.agg(*[exact_mean(v) for v in value], *[population_std(v) for v in value]).first()
    return list(stats[:n]), [s if s else 1.0 for s in stats[n:]]


# -- training (M2) ----------------------------------------------------------------


def train_classifier(
    training: DataFrame,
    feature_columns: list[str] | None = None,
    algorithm: str = "mlp",
    encoding: str = "pooled",
    label: str = "flag",
    epochs: int = 10,
    seed: int = 42,
    fit_on: DataFrame | None = None,
    width: int | None = None,
    k: int = 1000,
    tolerance: float = 1e-6,
) -> RiskModel:
    """M2: fit a two-class model on rows with features, ``sequence`` and a label.

    The scaler is fitted on the training rows; ``fit_on`` names other rows.
    Training passes over the rows many times, so they are encoded and
    written first; rows that ``encode`` made are taken as they are, and need the
    ``width`` of their sequences.  ``tolerance`` ends the steps of logistic regression.
    """
    if algorithm not in CLASSIFIERS:
        raise ValueError(f"algorithm must be one of {sorted(CLASSIFIERS)}, not {algorithm!r}")
    if encoding not in ("pooled", "flat"):
        raise ValueError(f"encoding must be 'pooled' or 'flat', not {encoding!r}")
    columns = feature_columns or [c for c in FEATURES if c in training.columns]
    if not columns:
        raise ValueError("no static feature columns")
    if width is None:
        width = SEQUENCE_WIDTH if "raw_values" in training.columns else width_of(training)
    model = RiskModel(algorithm, None, columns, encoding, sequence_width=width, k=k)
    if "raw_values" not in training.columns:
        training = kept(encode(training, columns, encoding, width).select(label, "raw_values"))
    whole = training if fit_on is None else fit_on
    if "raw_values" not in whole.columns:
        whole = encode(whole, columns, encoding, width)
    model.means, model.stds = _fit_scaler(whole, model)
    vectors = assemble_vector(training, model).select(
        "features", F.col(label).cast("double").alias("label")
    )
    if algorithm == "mlp":
        tail = len(pool_names(width)) if encoding == "pooled" else SEQUENCE_LENGTH * width
        layers = [len(columns) + tail, *HIDDEN_LAYERS, 2]
        learner = MultilayerPerceptronClassifier(layers=layers, maxIter=epochs, seed=seed)
    elif algorithm == "logistic":
        learner = LogisticRegression(maxIter=epochs, standardization=False, tol=tolerance)
    else:
        learner = GBTClassifier(maxIter=epochs, seed=seed)
    # A fitted classifier holds on to the session by its training summary, and tasks could not
    # take it along; one that was written and read has none.
    path = new_path(training.sparkSession, "classifier")
    learner.fit(vectors).write().save(path)
    model.classifier = CLASSIFIERS[algorithm].load(path)
    return model


# -- scoring (M3-M6) ----------------------------------------------------------------


def predictions(df: DataFrame, model: RiskModel) -> DataFrame:
    """M6: adds ``p0``, ``p1``, the raw outputs ``z0``, ``z1``, and ``predicted`` (the
    first class wins a tie)."""
    scored = model.classifier.transform(assemble_vector(df, model))
    p, z = vector_to_array("probability"), vector_to_array("rawPrediction")
    kept = [c for c in df.columns if c not in ("sequence", "raw_values")]
    return scored.select(
        *[f"`{c}`" for c in kept],
        F.get(p, F.lit(0)).alias("p0"),
        F.get(p, F.lit(1)).alias("p1"),
        F.get(z, F.lit(0)).alias("z0"),
        F.get(z, F.lit(1)).alias("z1"),
        argmax(p).alias("predicted"),
    )


def prediction_struct(model: RiskModel | None = None) -> Column:
    """The prediction of a row with ``p0``, ``p1``, ``predicted``.

    With a model it also tells the number of features and the sequence length.
    """
    parts = [
        verdict("predicted").alias("prediction"),
        F.col("p1").alias("fraud_probability"),
        F.col("p0").alias("normal_probability"),
        confidence("p0", "p1").alias("confidence"),
        (F.col("predicted") == 1).alias("is_fraud"),
    ]
    if model is not None:
        parts += [
            F.lit(len(model.feature_columns)).alias("features_used"),
            F.lit(model.sequence_length).alias("sequence_length"),
        ]
    return F.struct(*parts)


def score(df: DataFrame, model: RiskModel) -> DataFrame:
    """M3: adds the seven-field ``prediction`` to rows with features and sequence."""
    scored = predictions(df, model).withColumn("prediction", prediction_struct(model))
    return scored.drop("z0", "z1")


def score_static_only(df: DataFrame, model: RiskModel) -> DataFrame:
    """M4: the five-field prediction from static features and a zero sequence."""
    zeros = F.array_repeat(zero_row(model.sequence_width), model.sequence_length)
    scored = predictions(df.withColumn("sequence", zeros), model)
    return scored.withColumn("prediction", prediction_struct())


def evaluate(
    df: DataFrame, model: RiskModel, label: str = "flag", by: str | None = None
) -> DataFrame:
    """M5: accuracy and loss (A17, over the raw outputs) on labelled rows, in one
    pass; ``by`` groups them."""
    scored = predictions(df, model)
    return scored.groupBy(*([by] if by else [])).agg(
        F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"),
        F.avg(row_loss("z0", "z1", label)).alias("loss"),
        F.count(F.lit(1)).alias("records"),
    )


# -- keeping a model (S9) -------------------------------------------------------------


def save_model(spark: SparkSession, model: RiskModel, path: str) -> None:
    """Classifier, scaler table and config under one folder."""
    model.classifier.write().overwrite().save(f"{path}/classifier")
    names = model.feature_columns + pool_names(model.sequence_width)
    scaler = [(i, names[i], m, s) for i, (m, s) in enumerate(zip(model.means, model.stds))]
    spark.createDataFrame(scaler, "position int, feature string, mean double, std double").coalesce(
        1
    ).write.mode("overwrite").parquet(f"{path}/scaler")
    config = json.dumps({**model.config, "feature_columns": model.feature_columns})
    spark.createDataFrame([(config,)], "value string").write.mode("overwrite").text(f"{path}/config")


def load_model(spark: SparkSession, path: str) -> RiskModel:
    """Read a model back; a scaler of another width than the config is an error."""
    config = json.loads(spark.read.text(f"{path}/config").first()[0])
    scaler = spark.read.parquet(f"{path}/scaler").orderBy("position").collect()
    columns = config["feature_columns"]
    pooled = len(pool_names(config["sequence_input_size"])) if config["encoding"] == "pooled" else 0
    width = len(columns) + pooled
    if len(scaler) != width or [r["feature"] for r in scaler][: len(columns)] != columns:
        raise ValueError(f"scaler covers {len(scaler)} columns, the model has {width}")
    return RiskModel(
        algorithm=config["algorithm"],
        classifier=CLASSIFIERS[config["algorithm"]].load(f"{path}/classifier"),
        feature_columns=columns,
        encoding=config["encoding"],
        sequence_length=config["sequence_length"],
        sequence_width=config["sequence_input_size"],
        k=config["newest_transactions"],
        means=[r["mean"] for r in scaler],
        stds=[r["std"] for r in scaler],
    )


# -- metadata (P8, P9) -----------------------------------------------------------------


def feature_catalog(spark: SparkSession, model: RiskModel) -> DataFrame:
    """The features a model uses: name, position, group."""
    tail = (
        pool_names(model.sequence_width)
        if model.encoding == "pooled"
        else [f"sequence_feature_{i}" for i in range(model.sequence_width)]
    )
    rows = [(n, i, "static") for i, n in enumerate(model.feature_columns)]
    rows += [(n, i, "sequence") for i, n in enumerate(tail)]
    return spark.createDataFrame(rows, "name string, position int, group string")


def model_info(spark: SparkSession, model: RiskModel) -> DataFrame:
    """One row about a model."""
    row = (
        type(model.classifier).__name__,
        json.dumps(model.config, sort_keys=True),
        len(model.feature_columns),
        model.feature_columns,
    )
    return spark.createDataFrame(
        [row], "model_type string, config string, num_features int, feature_columns array<string>"
    )
