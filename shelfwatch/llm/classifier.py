"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL.

Tokens are runs of word bytes and runs of signs; features are hashed single tokens and pairs, a pair of
equal tokens being one feature whatever the token. A text's vector is its counts, scaled to length 1.
Training takes at most ``max_rows`` labelled documents, those with the smallest hash of doc_id. They
are dealt to ``PARTS`` trainers by hash; each makes ``EPOCHS`` passes of follow-the-regularised-leader
updates in an order fixed by hash, and the model is the mean of their weights (``SLOTS`` floats, the
only thing broadcast). Scoring sees the text alone and reads all of it.

Results in special cases: documents whose labels disagree, or have no label, do not train; a document
labelled twice alike trains once; a NULL or empty text scores by the bias; with labels of one kind
only, or none, the model is its bias (0.5 without any); repeated rows score alike; an empty table
gives an empty result; input columns named like a result are replaced.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from shelfwatch.llm.common import map_batches, without

SLOTS = 1 << 18
MAX_ROWS = 16_000
PARTS = 8
EPOCHS = 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.02, 0.05
CUT = 0.7

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+")
_SAME, _BIAS = SLOTS, SLOTS + 1


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of the sparse vector."""
    tokens = _TOKEN.findall((text or "").encode("utf-8", "surrogatepass"))
    one = np.fromiter(map(crc32, tokens), np.uint64, len(tokens))
    if not len(one):
        return np.array([_BIAS], np.int64), np.array([1.0])
    mixed = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    pair = np.where(one[:-1] == one[1:], _SAME, (mixed >> np.uint64(40)) % np.uint64(SLOTS)).astype(np.int64)
    slots, counts = np.unique(np.concatenate(((one % np.uint64(SLOTS)).astype(np.int64), pair)), return_counts=True)
    values = counts / np.sqrt(np.square(counts, dtype=np.float64).sum())
    return np.append(slots, _BIAS), np.append(values, 1.0)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader with L1 and L2."""

    def __init__(self):
        self.z, self.n = np.zeros(SLOTS + 2), np.zeros(SLOTS + 2)

    def weights(self, slots=slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, slots: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        g = (_sigmoid(float(w @ values)) - label) * values
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = n + g * g


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(x, -35.0), 35.0)))


def _train(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["order", "text"])
    held = [(*features(t), int(y)) for t, y in zip(rows["text"], rows["label"])]
    model = Ftrl()
    for _ in range(EPOCHS):
        for slots, values, label in held:
            model.learn(slots, values, label)
    return pd.DataFrame({"rows": [len(held)], "weights": [model.weights().astype(np.float32).tobytes()]})


def train(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, max_rows: int = MAX_ROWS) -> np.ndarray:
    """Weights learned from the documents that ``allowed`` (over doc_id) lets in."""
    order = F.xxhash64(F.col("doc_id").cast("string"))
    sample = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & allowed)
              .groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("__most"))
              .where(F.col("label") == F.col("__most")).select("doc_id", F.col("label").cast("int").alias("label"))
              .orderBy(order, "doc_id").limit(max_rows))
    # At most max_rows ids are broadcast, so the texts of the sample are found without a shuffle of all texts.
    texts = (docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
             .select(F.pmod(order, F.lit(PARTS)).alias("part"), order.alias("order"), F.coalesce("text", F.lit("")).alias("text"), "label"))
    texts = texts.dropDuplicates()
    parts = texts.groupBy("part").applyInPandas(_train, "rows long, weights binary").collect()  # PARTS rows of SLOTS floats
    if not parts:
        return np.zeros(SLOTS + 2, np.float32)
    return np.mean([np.frombuffer(p["weights"], np.float32) for p in parts], axis=0, dtype=np.float64).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, cut: float = CUT) -> DataFrame:
    """``docs`` without the text, with score and predicted."""
    docs = without(docs, ["score", "predicted"])
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    kept = [i for i in range(len(docs.columns)) if i != at]
    schema = StructType([*[docs.schema.fields[i] for i in kept], StructField("score", DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(weights)

    def dot(batch: pa.RecordBatch) -> list[pa.Array]:
        w, scores = held.value, []
        for text in batch.column(at).to_pylist():
            slots, values = features(text)
            scores.append(_sigmoid(float(w[slots] @ values)))
        return [*[batch.column(i) for i in kept], pa.array(scores, pa.float64())]

    return map_batches(docs, dot, schema).withColumn("predicted", (F.col("score") >= cut).cast("int"))
