"""Toxicity: logistic regression over hashed word n-grams and skip-grams, trained by FTRL-proximal."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.tables import small_batches
from driftmark.llm.words import NOT_ALNUM, U64, Slice, mix, slices, words

BIAS = 0


def features(piece: Slice, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Document (index in the slice) and feature of every word, word pair and pair around one word; repeats included."""
    w = words(piece, NOT_ALNUM, lower=True)
    shift = U64(64 - bits)
    docs, found = [w.doc], [mix(w.hash + U64(1)) >> shift]
    for kind, gap in ((2, 1), (3, 2)):
        at = np.flatnonzero(w.doc[:-gap] == w.doc[gap:]) if len(w) > gap else np.zeros(0, np.int64)
        docs.append(w.doc[at])
        found.append(mix(w.hash[at] * U64(0x9FB21C651E98DF25) + w.hash[at + gap] + U64(kind)) >> shift)
    ids = np.concatenate(found)
    return np.concatenate(docs), np.where(ids == BIAS, U64(BIAS + 1), ids)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the bias takes no L1."""

    def __init__(self, bits: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)

    def weights(self, ids: np.ndarray) -> np.ndarray:
        z = self.z[ids]
        l1 = np.where(ids == BIAS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[ids])) / self.alpha + self.l2))

    def learn(self, ids: np.ndarray, label: int) -> None:
        w = self.weights(ids)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[ids]
        self.z[ids] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[ids] = n + g * g


def _rows_of_features(batches, bits):
    for batch in batches:
        keys, labels, out = batch.column(0), batch.column(1), []
        for piece in slices(batch.column(2)):
            doc, ids = features(piece, bits)
            pairs = np.unique((doc.astype(U64) << U64(bits)) | ids)
            cut = np.searchsorted(pairs, np.arange(len(piece) + 1, dtype=U64) << U64(bits))
            low = (pairs & U64((1 << bits) - 1)).astype("<u4")
            out += [low[cut[i]:cut[i + 1]].tobytes() for i in range(len(piece))]
        yield pa.RecordBatch.from_arrays([keys, labels, pa.array(out, pa.binary())], names=["h", "label", "ids"])


def _train(batches, bits, epochs, alpha, beta, l1, l2):
    rows = [(np.r_[np.uint32(BIAS), np.frombuffer(ids.as_py(), "<u4")], label.as_py()) for b in batches for label, ids in zip(b.column(1), b.column(2))]
    model = Ftrl(bits, alpha, beta, l1, l2)
    for _ in range(epochs):
        for ids, label in rows:
            model.learn(ids, label)
    all_ids = np.arange(1 << bits)
    w = model.weights(all_ids)
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["id", "w"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 12_000,
          bits: int = 20, epochs: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 12.0, l2: float = 1.0) -> dict[int, float]:
    """The weights that are not zero.

    About ``sample`` labelled rows are used, those with the smallest hashes of their id: the documented bound of the
    fit, which runs in one task in hash order.  Features come from whole texts.  Labels and ids that are null teach
    nothing; a document labelled twice counts as toxic if any label says so.  Without labels the model is empty.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = marked.count()
    below = min(1.0, sample / max(known, 1)) * 2**32
    hashed = F.pmod(F.xxhash64("id"), F.lit(2**32))
    texts = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.where(hashed < below).join(marked.where(hashed < below), "id").select(F.xxhash64("id").alias("h"), "label", "text")
    ids = rows.mapInArrow(lambda b: _rows_of_features(b, bits), "h long, label int, ids binary")
    fitted = ids.repartition(1).sortWithinPartitions("h", "label", "ids").mapInArrow(lambda b: _train(b, bits, epochs, alpha, beta, l1, l2), "id long, w double")
    return {r.id: r.w for r in fitted.collect()}


def _score(batches, ids, values, bits):
    weight = np.zeros(1 << bits)
    weight[ids] = values
    for batch in batches:
        out = []
        for piece in slices(batch.column(1)):
            doc, found = features(piece, bits)
            hit = np.flatnonzero(weight[found])
            pairs = np.unique((doc[hit].astype(U64) << U64(bits)) | found[hit])
            total = np.bincount((pairs >> U64(bits)).astype(np.int64), weight[pairs & U64((1 << bits) - 1)], len(piece))
            out.append(1.0 / (1.0 + np.exp(-np.clip(total + weight[BIAS], -35, 35))))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])


def score(docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text", bits: int = 20, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted (score >= threshold) of every row, from its whole text.

    Each feature counts once a document.  Null and empty texts get the bias alone.  Rows are scored one by one,
    null and repeated ids too; other columns are ignored, whatever their names; no rows give no rows.  The weights travel with the tasks: at most 2**bits of them, far fewer after L1.
    """
    ids, values = np.fromiter(weights.keys(), np.int64, len(weights)), np.fromiter(weights.values(), float, len(weights))
    narrow = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    scored = narrow.mapInArrow(lambda b: _score(b, ids, values, bits), f"doc_id {kind}, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
