"""Bounded samples of labelled rows to fit a model on, and what both classifiers share."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a model is fitted on at most: those of the least hash of their id.
SAMPLE = 10_000
FOLDS = 5


def held_out(doc_id: object) -> bool:
    """Whether crc32 of the id as text leaves 0; a row without an id is not held out."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def sample(labels: DataFrame, label: str, rows: int = SAMPLE) -> DataFrame:
    """(id, label) of at most ``rows`` labelled ids outside the held-out fold; an id with several labels takes the greatest."""
    ours = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    training = ours.where(F.crc32(F.col("id").cast("string")) % FOLDS != 0)
    return training.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(rows)


def with_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen rows with their texts. ``chosen`` has at most SAMPLE rows of two numbers, hence the broadcast."""
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "label")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights (the last one is the constant) by Newton's method with a ridge."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    prior = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    w[-1] = np.log(prior / (1 - prior))
    if len(y) == 0 or y.min() == y.max():
        return w
    penalty = np.full(len(w), ridge * len(y))
    penalty[-1] = 1e-9
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
