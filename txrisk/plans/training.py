"""From labelled accounts and transactions to a training table and a model."""

from __future__ import annotations

from pyspark.sql import DataFrame

from txrisk.functions.scalars import date_int
from txrisk.operators.incidence import incidence
from txrisk.operators.prep import (
    assemble,
    drop_existing,
    impute,
    select_existing,
    stratified_split,
    undersample,
)
from txrisk.operators.sequences import first_n, to_matrix
from txrisk.plans.model import RiskModel, encode, evaluate, train_classifier, width_of
from txrisk.plans.scan import profiles
from txrisk.schemas import (
    FEATURES,
    IRRELEVANT_TX_COLUMNS,
    MAJORITY_SAMPLE,
    SEQUENCE_LENGTH,
)
from txrisk.sources.tables import kept


def bulk_sequences(addresses: DataFrame, tx: DataFrame, length: int = SEQUENCE_LENGTH) -> DataFrame:
    """Steps of the listed accounts from a bulk export: first rows in file order,
    all numeric columns, the time as a number like 20240131.

    A transaction that touches no listed account has no row in the join, so it
    needs no filter before.
    """
    narrow = drop_existing(tx, IRRELEVANT_TX_COLUMNS)
    rows = incidence(narrow, addresses).withColumn("created_at", date_int("created_at"))
    return first_n(rows, length)


def prepare_bulk(
    addresses: DataFrame,
    tx: DataFrame,
    majority: int = MAJORITY_SAMPLE,
    length: int = SEQUENCE_LENGTH,
    seed: int = 42,
) -> DataFrame:
    """Training table from a labelled feature table and a bulk export: class
    balance, imputed features, file-order sequences."""
    balanced = undersample(addresses, majority, seed=seed)
    listed = select_existing(balanced, FEATURES, keep=("address", "flag"))
    # Medians, joins and the result all read the sampled list.
    listed = kept(listed)
    imputed = impute(listed, [c for c in FEATURES if c in listed.columns])
    steps = bulk_sequences(listed, tx, length)
    width = len(steps.columns) - 2
    return assemble(imputed, to_matrix(steps, length), length, width)


def prepare(
    addresses: DataFrame,
    tx: DataFrame,
    k: int = 1000,
    length: int = SEQUENCE_LENGTH,
    encoding: str = "pooled",
) -> DataFrame:
    """Training table from labelled accounts and explorer transactions, with the
    features and sequences that scoring uses.  Sequences are pooled at once, unless
    another ``encoding`` asks for them as they are."""
    pooled = "pooled" if encoding == "pooled" else None
    return profiles(addresses, tx, k, length, with_transactions=False, encoding=pooled)


def fit(
    training: DataFrame,
    label: str = "flag",
    key: str = "address",
    algorithm: str = "mlp",
    encoding: str = "pooled",
    feature_columns: list[str] | None = None,
    epochs: int = 10,
    fit_on: str = "train",
    seed: int = 42,
    k: int = 1000,
) -> tuple[RiskModel, DataFrame]:
    """Split, train, test.  Returns the model and its quality per split.

    Everything after the encoding reads one feature table of key, label
    and vector.  ``fit_on='all'`` fits the scaler before the split.  ``k`` is the
    number of newest transactions that the features were made of (``prepare``).
    """
    columns = feature_columns or [c for c in FEATURES if c in training.columns]
    width = width_of(training)
    rows = kept(encode(training, columns, encoding, width).select(key, label, "raw_values"))
    parts = stratified_split(rows, label, key, seed=seed)
    model = train_classifier(
        parts.where("split = 'train'"),
        columns,
        algorithm,
        encoding,
        label,
        epochs,
        seed,
        fit_on=rows if fit_on == "all" else None,
        width=width,
        k=k,
    )
    return model, evaluate(parts, model, label, by="split")
