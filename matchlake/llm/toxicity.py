"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its hashed words, word pairs and pairs with one word between. Every
coordinate has its own learning rate, and the L1 term keeps most weights at zero, so the weights
that are broadcast to the scoring tasks are a short list. Training runs in rounds: each shard of a
bounded sample of labelled rows goes through FTRL from the common state, and the states are averaged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import by_batch, held_out, staged

BITS = 19
#: Labelled rows that are learned from at most: those with the smallest hash of their id.
TRAIN_ROWS = 10_000
SHARDS, EPOCHS = 2, 8
ALPHA, BETA, L1, L2 = 8.0, 1.0, 4.0, 0.0
THRESHOLD = 0.7
CACHE_WORDS = 400_000

_WORD = re.compile(r"\w+")


class Hasher:
    """Sorted distinct feature numbers of texts; hashes of words are kept up to a bound."""

    def __init__(self, bits: int = BITS):
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.uint64(64 - bits)
        self.known: dict[str, int] = {}

    def _word(self, word: str) -> int:
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        h = self.known[word] = crc32(word.encode("utf-8", "surrogatepass")) + 1
        return h

    def features(self, text: str | None) -> np.ndarray:
        words = _WORD.findall(text.lower()) if text else []
        if not words:
            return np.empty(0, np.int64)
        get, new = self.known.get, self._word
        h = np.array([get(w) or new(w) for w in words], np.uint64)
        with np.errstate(over="ignore"):
            mixed = [h * np.uint64(0x9E3779B97F4A7C15)]
            for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
                if len(h) > gap:
                    mixed.append((h[:-gap] * np.uint64(salt) ^ h[gap:]) * np.uint64(0xD6E8FEB86659FD93))
        f = np.sort(np.concatenate(mixed) >> self.shift)
        return f[np.append(True, f[1:] != f[:-1])].astype(np.int64)


class Ftrl:
    """State of all coordinates; the last one is the intercept, which has no L1 term."""

    def __init__(self, bits: int = BITS, z: np.ndarray | None = None, n: np.ndarray | None = None):
        self.z = np.zeros((1 << bits) + 1) if z is None else z
        self.n = np.zeros((1 << bits) + 1) if n is None else n

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        w = -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) <= l1, 0.0, w)

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, len(self.z) - 1)
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -35, 35))))


def train(documents: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, bits: int = BITS) -> dict:
    """Weights other than zero: {"at": numbers, "w": values, "bias": float, "bits": bits}.

    Only labelled rows that are not held out are used, of them the ``train_rows`` with the smallest
    hash of their id. Without such rows the weights are empty and every score is 0.5.
    """
    ids = (
        labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
        .filter(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(train_rows)
    )
    rows = documents.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))

    def features():
        hasher = Hasher(bits)
        return lambda r: {
            "shard": [crc32(str(i).encode()) % SHARDS for i in r["doc_id"]], "doc_id": r["doc_id"],
            "label": r["_label"], "features": [hasher.features(t).astype("<u4").tobytes() for t in r["text"]],
        }

    data = staged(by_batch(rows.select(F.col("doc_id").cast("long"), "text", "_label"), features,
                           "shard int, doc_id long, label int, features binary"))
    # every epoch reads the shards: dealt out once and kept
    shards = (
        data.repartition(SHARDS, "shard").sortWithinPartitions("shard", F.xxhash64("doc_id"), "features")
        .select("shard", "label", "features").persist(StorageLevel.MEMORY_AND_DISK)
    )
    context = documents.sparkSession.sparkContext
    state = Ftrl(bits)
    for _ in range(EPOCHS):
        common = context.broadcast((state.z.astype(np.float32), state.n.astype(np.float32)))

        def one_pass(parts: Iterator[pd.DataFrame], common=common) -> Iterator[pd.DataFrame]:
            models: dict[int, Ftrl] = {}
            for part in parts:
                for shard, label, raw in zip(part["shard"], part["label"], part["features"]):
                    if shard not in models:
                        z, n = common.value
                        models[shard] = Ftrl(bits, z.astype(float), n.astype(float))
                    models[shard].learn(np.frombuffer(raw, "<u4").astype(np.int64), label)
            for m in models.values():
                at = np.flatnonzero(m.n)
                yield pd.DataFrame({"at": [at.astype("<u4").tobytes()], "z": [m.z[at].astype("<f4").tobytes()],
                                    "n": [m.n[at].astype("<f4").tobytes()]})

        found = shards.mapInPandas(one_pass, "at binary, z binary, n binary").collect()
        if not found:
            shards.unpersist()
            return {"at": np.empty(0, np.int64), "w": np.empty(0), "bias": 0.0, "bits": bits}
        z, n = np.zeros_like(state.z), np.zeros_like(state.n)
        for r in found:  # SHARDS states of bounded size
            at = np.frombuffer(r["at"], "<u4")
            z[at] += np.frombuffer(r["z"], "<f4")
            n[at] += np.frombuffer(r["n"], "<f4")
        state = Ftrl(bits, z / len(found), n / len(found))
        common.unpersist()
    shards.unpersist()
    w = state.weights(np.arange(len(state.z)))
    at = np.flatnonzero(w[:-1])
    return {"at": at, "w": w[at], "bias": float(w[-1]), "bits": bits}


def score(documents: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The whole text is scored; null and empty texts get the intercept's score. Only the text is
    looked at, so repeated rows score alike, and null ids, ties or further columns change nothing.
    """
    small = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        m = small.value
        hasher = Hasher(m["bits"])
        weights = np.zeros(1 << m["bits"])
        weights[m["at"]] = m["w"]

        def run(rows: dict) -> dict:
            s = [sigmoid(m["bias"] + weights[hasher.features(t)].sum()) for t in rows["text"]]
            return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "score": s,
                    "predicted": [int(x >= threshold) for x in s]}

        return run

    return by_batch(
        documents.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id")).alias("held_out")), make,
        "doc_id long, held_out boolean, score double, predicted int",
    )
