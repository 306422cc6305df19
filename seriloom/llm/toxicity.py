"""Toxicity by class-conditional Kneser-Ney models.

Two letter models, of toxic and of ordinary documents, over letters inside words, share their lower orders, whose counts are
pooled: an expression that is rare in one class backs off to the same shares in both, and then says
nothing about the class. A document's evidence is the difference of both log-likelihoods,
normalised by length: over the whole document, over its most telling run of ``RUN`` words and over
its most telling word. A logistic rule turns these into a score.

What is learnt from: the models count every labelled document of folds 1 to 3 (all of them); the logistic
rule is fitted on fold 4, on at most ``calibration_rows`` documents chosen by a hash of doc_id.
Fold 0 is held out. A fold is crc32(doc_id as text) mod 5.

Edge cases: a null or empty text has no evidence and gets the score of zero evidence; a null doc_id is never labelled
and held_out is null; repeated rows get equal scores; labels that are null are
left out; without labels of both classes all scores are the share of toxic labels (0 without any).
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriloom.functions.storage import cut_lineage
from seriloom.llm import kneser_ney
from seriloom.llm.batches import sums_between

RUN = 8
CALIBRATION_ROWS = 20_000
FEATURES = ["whole", "run", "word", "excess"]


def remainder(doc_id: Column, n: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def evidence(docs: DataFrame, learnt: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, whole, run, word, excess): length-normalised log-likelihood differences by models of ``learnt(text, group)``."""

    def weigh(batch, events, lengths, logs):
        starts, gain = events.starts, logs[1] - logs[0]
        sizes = np.diff(starts)
        some = sizes > 0
        whole, best_run, word, excess = (np.zeros(len(sizes)) for _ in range(4))
        if len(gain):
            at = starts[:-1][some]
            whole[some] = sums_between(gain, starts)[some] / sums_between(lengths, starts)[some]
            word[some] = np.maximum.reduceat(gain, at)
            excess[some] = sums_between(np.maximum(gain - 2, 0), starts)[some] / sizes[some]
            total = np.concatenate([[0], np.cumsum(gain)])
            end = np.minimum(np.arange(len(gain)) + run, np.repeat(starts[1:], sizes))
            best_run[some] = np.maximum.reduceat((total[end] - total[:-1]) / run, at)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, (whole, best_run, word, excess))], ["doc_id", *FEATURES])

    given = docs.select(F.col("doc_id").cast("long"), "text")
    return kneser_ney.scored(given, weigh, "doc_id long, " + ", ".join(f"{c} double" for c in FEATURES), learnt, 2)


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression (Newton steps)."""
    share = float(y.mean()) if len(y) else 0.0
    if share in (0.0, 1.0):
        return np.zeros(x.shape[1]), 40.0 if share else -40.0
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(len(w)) / 100, z.T @ (p - y) + ridge * len(x) * w / 100)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame, calibration_rows: int = CALIBRATION_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of ``docs(doc_id, text)`` by ``labels(doc_id, toxic)``."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max((F.col("toxic") > 0).cast("int")).alias("group"))
    fold = remainder(F.col("doc_id"), 5)
    shown = docs.select(F.col("doc_id").cast("long"), "text").filter(fold.between(1, 3))
    # labels grow with the documents, so they are never broadcast
    learnt = shown.join(known.filter(fold.between(1, 3)).hint("merge"), "doc_id")
    weighed = cut_lineage(evidence(docs, learnt))
    sample = weighed.join(known.filter(fold == 4), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(calibration_rows)
    rows = sample.select(*FEATURES, "group").toArrow()
    x = np.column_stack([rows.column(c).to_numpy() for c in FEATURES]) if rows.num_rows else np.zeros((0, len(FEATURES)))
    weights, intercept = logistic(x, rows.column("group").to_numpy().astype(float))
    z = sum((F.col(c) * float(w) for c, w in zip(FEATURES, weights)), F.lit(intercept))
    scored = weighed.withColumn("score", 1 / (1 + F.exp(-z)))
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
