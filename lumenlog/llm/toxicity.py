"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import crc_mod, forget, lean, release, text_bytes

BITS = 20
#: Labelled rows to train on at most (chosen by a hash of their ids), and for each learner that shares them.
TRAIN_ROWS, LEARNER_ROWS, EPOCHS = 120_000, 10_000, 3
#: Bytes of a word's beginning that stand for words of one stem.
STEMS = (4, 5, 6)
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
#: A document counts as toxic from this score on.
CUTOFF = 0.3
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and characters beyond ASCII."""
    return text.translate(_FOLD).split()


def slots(text: bytes, bits: int = BITS) -> np.ndarray:
    """Slots of a whole text's word n-grams: words and their stems, pairs of neighbours, pairs with one word between."""
    found = words(text)
    w = np.array([zlib.crc32(x) for x in found], np.uint64)
    parts = [w * np.uint64(0x9E3779B97F4A7C15)]
    for size in STEMS:
        stem = np.array([zlib.crc32(x[:size], size) for x in found if len(x) > size], np.uint64)
        parts.append(stem * np.uint64(0xD6E8FEB86659FD93))
    for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        parts.append((w[:-gap] * np.uint64(salt) + w[gap:]) * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int32)


def features(text: bytes, bits: int = BITS) -> np.ndarray:
    """Distinct slots of a text, sorted; slot 0 is the bias and always there."""
    return np.unique(np.append(slots(text, bits), np.int32(0)))


class Ftrl:
    """Per-coordinate FTRL-proximal: w = 0 while |z| <= L1, else -(z - sign(z) L1) / ((beta + sqrt(n)) / alpha + L2)."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == 0, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def train(texts: DataFrame, learners: int = 1, bits: int = BITS) -> dict[int, float]:
    """Weights of the slots that L1 leaves. texts: a bounded sample (doc_id, text, label) with label 0 or 1.

    Each learner runs FTRL over its share, in the order of doc_id, EPOCHS times; the weights are averaged, slots that
    a learner lacks counting as zero. At most 2^bits numbers reach the driver, of which L1 leaves a few thousand.
    """
    share = (F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 4) % learners).cast("int")
    dealt = texts.select(share.alias("share"), "doc_id", text_bytes("text").alias("text"), F.col("label").cast("int").alias("label"))
    dealt = dealt.repartitionById(learners, F.col("share")).sortWithinPartitions("share", "doc_id", "label", "text")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        shares: dict[int, list[tuple[np.ndarray, int]]] = {}
        for b in batches:
            for share, text, label in zip(b.column(0), b.column(2), b.column(3), strict=True):
                shares.setdefault(share.as_py(), []).append((features(text.as_py(), bits), label.as_py()))
        for seen in shares.values():
            model = Ftrl(1 << bits)
            for _ in range(EPOCHS):
                for at, label in seen:
                    model.learn(at, label)
            w = model.weights(np.arange(1 << bits))
            at = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["slot", "weight"])
        shares.clear()
        release()

    found = dealt.mapInArrow(of, "slot long, weight double").groupBy("slot").agg(F.sum("weight").alias("weight"))
    return {r.slot: r.weight / learners for r in found.collect()}


def dense(weights: dict[int, float], bits: int) -> np.ndarray:
    w = np.zeros(1 << bits)
    w[list(weights)] = list(weights.values())
    return w


def scorer(spark: SparkSession, weights: dict[int, float], bits: int = BITS) -> Callable[[Column], Column]:
    """A column function: whole text -> score from 0 to 1. The weights are broadcast; 2^bits numbers bound them."""
    shared = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        w = dense(shared.value, bits)
        for part in parts:
            sums = []
            for text in part:
                at = slots(text, bits)
                sums.append(w[np.unique(np.append(at[w[at] != 0], 0))].sum())
            sums = np.array(sums)
            yield pd.Series(1 / (1 + np.exp(-np.clip(sums, -30, 30))), dtype="float64")

    return lambda text: of(F.coalesce(text.cast("binary"), F.lit(b"")))


def labelled(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS
) -> tuple[DataFrame, int]:
    """(doc_id, text, label) of the rows to learn from, and how many labels were chosen.

    Labels are 0 or 1 and their ids' crc32 modulo 4 is not 2; of more than ``rows`` of them a hash of the id chooses
    about that many. So the labels are few enough to broadcast, and no text moves to find its label.
    """
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where(F.col("label").isin(0, 1) & (crc_mod("doc_id", 4) != 2))
    total = marks.count()
    if total > rows:
        marks = marks.where((F.abs(F.xxhash64("doc_id")) % 1_000_000) < int(1_000_000 * rows / total))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(marks), "doc_id"), min(total, rows)


def with_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """All columns of ``docs``, then held_out boolean, score double, predicted int; those three names are replaced.

    Learns from the documents that have a label and are not held out, scores all. Null or empty texts score by the
    bias; a null id is not held out; repeated rows and further labels of one document each count; without any labels
    every score is 0.5.
    """
    lean(docs.sparkSession)
    texts, rows = labelled(docs, labels, label_col, id_col, text_col)
    weights = train(texts, max(1, -(-rows // LEARNER_ROWS)))
    score = scorer(docs.sparkSession, weights)(F.col(text_col))
    held = F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False))
    scored = docs.withColumns({"held_out": held, "score": score})
    return scored.withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))
