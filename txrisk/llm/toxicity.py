"""Toxic documents by cumulative-link ordinal regression on hashed words.

Grades are ordered: 0 for a document that is not toxic, 1 for a toxic one, 2 for a
toxic one of low quality. One weight vector serves all thresholds:
``P(grade > k) = sigmoid(w . x - theta_k)`` with rising thetas; the output is the
expected grade and a flag. Features are the hashed words of a whole text, each
counted once; only words whose share differs between the classes get a weight.

Fitting takes at most ``most`` labelled documents (``MOST_LABELS``), chosen by a hash of
ids and texts, each pair of these once, so that the sample is bounded and does not depend on the order of
files. Everything else covers all documents, texts of any length. Several labels of an id count as the worst one;
repeated rows are scored one by one; other columns are not looked at. A null or empty text has no words and
severity by the thresholds alone; it is never flagged. Labels that are null or whose
document is missing are left out; if no label of either kind is left, or no word tells the
kinds apart, nothing is flagged and the severity is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txrisk.llm.common import stored, texts
from txrisk.llm.words import batches

#: Word hashes are folded into this many features.
FEATURES = 1 << 18
GRADES = 3
#: Labelled documents that a model is fitted on, at most.
MOST_LABELS = 20_000
#: Words are features from this many standard deviations on.
CHANCE = 4.0


@dataclass
class OrdinalModel:
    weights: np.ndarray  # FEATURES
    thetas: np.ndarray  # GRADES - 1, rising
    cut: float = 0.5  # flagged from this P(grade > 0) on

    def above(self, score: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` for each threshold, one row a document."""
        return 1 / (1 + np.exp(-np.clip(score[:, None] - self.thetas, -40, 40)))


def features(column):
    """``(low, high, feature, owner)``: distinct features of each text of a run."""
    for low, high, found, owner in batches(column):
        key = owner * FEATURES + (found & np.uint64(FEATURES - 1)).astype(np.int64)
        key = np.unique(key)
        yield low, high, key % FEATURES, key // FEATURES


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """``grade`` and ``features`` of at most ``most`` labelled documents.

    Documents are chosen by a hash of id and text, each pair of these once, however many rows or
    labels share an id.
    """
    import pyarrow as pa

    grade = F.when(F.col("toxic") == 0, 0).otherwise(F.when(F.col("quality") == 0, 2).otherwise(1))
    graded = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))
        .groupBy("doc_id").agg(F.max("grade").alias("grade"))
        # No document beyond these could be chosen.
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    rows = texts(docs).withColumn("h", F.xxhash64("text"))
    chosen = (
        rows.select("doc_id", "h").join(F.broadcast(graded), "doc_id").distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("h"), "h").limit(most)
    )
    chosen = stored(chosen, "chosen")
    # Equal rows meet here, cut to one by the tasks that read them.
    rows = rows.join(F.broadcast(chosen), ["doc_id", "h"])
    sample = rows.groupBy("doc_id", "h").agg(F.first("grade").alias("grade"), F.first("text").alias("text"))

    def run(parts):
        for batch in parts:
            grades = batch.column("grade")
            for low, high, feature, owner in features(batch.column("text")):
                cuts = np.searchsorted(owner, np.arange(high - low + 1))
                yield pa.RecordBatch.from_pydict({
                    "grade": grades.slice(low, high - low),
                    "features": pa.array([
                        feature[a:b].astype(np.int32) for a, b in zip(cuts, cuts[1:])
                    ], pa.list_(pa.int32())),
                })

    return sample.select("grade", "text").mapInArrow(run, "grade int, features array<int>")


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS, rounds: int = 300) -> OrdinalModel:
    """Fit by gradient descent on the bounded sample; the same rows give the same model."""
    sample = labelled(docs, labels, most).toArrow()
    grade = np.asarray(sample.column("grade"), dtype=np.int64)
    lists = sample.column("features").combine_chunks()
    empty = OrdinalModel(np.zeros(FEATURES), np.full(GRADES - 1, 40.0) + np.arange(GRADES - 1))
    if len(grade) == 0 or grade.min() > 0 or grade.max() == 0:
        return empty
    flat = np.asarray(lists.values if hasattr(lists, "values") else lists.flatten(), dtype=np.int64)
    sizes = np.diff(np.asarray(lists.offsets, dtype=np.int64))
    owner = np.repeat(np.arange(len(grade)), sizes)
    bad = grade > 0
    # Only words whose share differs between the classes beyond chance are features.
    in_bad = np.bincount(flat[bad[owner]], minlength=FEATURES) / bad.sum()
    in_good = np.bincount(flat[~bad[owner]], minlength=FEATURES) / (~bad).sum()
    share = np.bincount(flat, minlength=FEATURES) / len(grade)
    spread = share * (1 - share) * (1 / bad.sum() + 1 / (~bad).sum())
    z = np.abs(in_bad - in_good) / np.sqrt(np.maximum(spread, 1e-12))
    used = np.flatnonzero(z >= CHANCE)
    if not len(used):
        return empty
    keep = np.isin(flat, used)
    column, row, n = np.searchsorted(used, flat[keep]), owner[keep], len(grade)
    over = (grade[:, None] > np.arange(GRADES - 1)).astype(float)

    # Both classes weigh the same, so that a few certain words are enough.
    weight = np.where(bad, 0.5 / bad.sum(), 0.5 / (~bad).sum())[:, None]
    w, theta = np.zeros(len(used)), np.linspace(1.0, 2.0, GRADES - 1)
    step, speed = np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))
    # Gradient steps with momentum on the cumulative-link loss with a small ridge.
    for i in range(1, rounds + 1):
        total = np.bincount(row, w[column], minlength=n)
        residual = (1 / (1 + np.exp(-np.clip(total[:, None] - theta, -40, 40))) - over) * weight
        g_w = np.bincount(column, residual.sum(axis=1)[row], minlength=len(used)) + 1e-3 * w
        g = np.concatenate([g_w, -residual.sum(axis=0)])
        step = 0.9 * step + 0.1 * g
        speed = 0.99 * speed + 0.01 * g * g
        move = 0.1 * (step / (1 - 0.9**i)) / (np.sqrt(speed / (1 - 0.99**i)) + 1e-8)
        w = w - move[: len(w)]
        theta = np.maximum.accumulate(theta - move[len(w) :])
    whole = np.zeros(FEATURES)
    whole[used] = w
    return OrdinalModel(whole, theta)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """Per document: ``doc_id, severity`` (expected grade), ``p_toxic, toxic``."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(parts):
        model = shared.value
        for batch in parts:
            for low, high, feature, owner in features(batch.column("text")):
                total = np.bincount(owner, model.weights[feature], minlength=high - low)
                some = np.bincount(owner, minlength=high - low) > 0
                above = model.above(total)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id").slice(low, high - low),
                    "severity": pa.array(above.sum(axis=1)),
                    "p_toxic": pa.array(above[:, 0]),
                    "toxic": pa.array((above[:, 0] >= model.cut) & some),
                })

    return texts(docs).mapInArrow(run, "doc_id long, severity double, p_toxic double, toxic boolean")


def clean(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``docs``, all columns, without the flagged documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(text: pd.Series) -> pd.Series:
        import pyarrow as pa

        model, out = shared.value, []
        for low, high, feature, owner in features(pa.array(text, pa.string())):
            total = np.bincount(owner, model.weights[feature], minlength=high - low)
            some = np.bincount(owner, minlength=high - low) > 0
            out.append((model.above(total)[:, 0] >= model.cut) & some)
        return pd.Series(np.concatenate(out) if out else [], dtype=bool)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where(~toxic(text))
