"""Toxicity by logistic regression, trained with FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are its words, the stems of longer words (their first STEM bytes), word pairs, and pairs that skip
one or two words, hashed to 2^BITS places and counted once each. Training takes a bounded sample of labelled rows in a fixed order; every place has a rate of its
own, and the L1 term leaves most weights at zero. What is broadcast are the places and values of the others: at most
2^BITS of them, whatever the corpus.

A null or empty text has no features and gets the score of the bias, which starts at the smoothed log odds of the
labels. Labels of a null doc_id or a null toxic aren't used; a doc_id with several labels is toxic if one says so; of
several texts of a labelled doc_id, the one of smallest hash trains. Without any label all texts score alike, below
0.5. Repeated rows are scored alike, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_mod

BITS = 20
SKIPS = (1, 2, 3)
#: Labelled rows that training takes at most; those of smallest hash of their id.
SAMPLE = 20_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 4.0, 0.1
#: Bytes of a word's stem.
STEM = 5
#: How much a toxic row counts against one that isn't; there are far fewer of them.
TOXIC_WEIGHT = 2.0
#: Bytes of a text that are taken apart at once.
CHUNK = 1 << 20
#: A-Z to lower case, other ASCII but digits and letters to spaces. Bytes of further letters stay.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


class WordHashes(dict):
    """word -> hash; forgets when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


def chunks(text: bytes) -> Iterator[bytes]:
    """The text, cut at ASCII characters that are no letter or digit."""
    at = 0
    clean = text.translate(WORDS)
    while at < len(clean):
        end = at + CHUNK
        if end < len(clean):
            cut = clean.rfind(b" ", at, end)
            end = cut if cut > at else (clean.find(b" ", end) if clean.find(b" ", end) > 0 else len(clean))
        yield clean[at:end]
        at = end


def places(text: bytes | None, memo: WordHashes) -> Iterator[np.ndarray]:
    """Places of the features of each chunk of the text, repeats included; pairs reach across chunks."""
    before = np.empty(0, np.uint64)
    for chunk in chunks(text or b""):
        words = chunk.split()
        if not words:
            continue
        new = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        h = np.concatenate((before, new))
        stems = [b"^" + w[:STEM] for w in words if len(w) > STEM]
        out = [new, np.fromiter(map(memo.__getitem__, stems), np.uint64, len(stems))]
        for gap in SKIPS:
            own = max(len(before), gap)  # the second word is new
            if len(h) > own:
                out.append((h[own - gap : len(h) - gap] + np.uint64(gap)) * ODD[1] ^ h[own:])
        yield (np.concatenate(out) * ODD[0] >> np.uint64(64 - BITS)).astype(np.int32)
        before = h[-max(SKIPS) :]


def features(text: bytes | None, memo: WordHashes) -> np.ndarray:
    found = [np.unique(x) for x in places(text, memo)]
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int32)


class Ftrl:
    """Per-coordinate FTRL-proximal; the last place is the bias, without L1 and L2."""

    def __init__(self, bias: float):
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
        self.z[-1] = -bias * BETA / ALPHA

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def bias(self) -> float:
        return -self.z[-1] * ALPHA / (BETA + math.sqrt(self.n[-1]))

    def learn(self, at: np.ndarray, toxic: bool) -> None:
        w, b = self.weights(at), self.bias()
        p = sigmoid(w.sum() + b)
        g = (p - 1) * TOXIC_WEIGHT if toxic else p
        for i, v in ((at, w), (-1, b)):
            n = self.n[i]
            self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * v
            self.n[i] = n + g * g


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Places, their weights and the bias, from docs(doc_id, text) and labels(doc_id, toxic)."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = F.xxhash64("_id")
    chosen = known.orderBy(order, "_id").limit(sample)  # at most `sample` ids
    text = F.struct(F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("_id", "toxic").agg(F.min(text).alias("t"))

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = WordHashes()
        for b in batches:
            yield pd.DataFrame({"_id": b._id, "toxic": b.toxic, "at": [features(t, memo) for t in b.text]})

    rows = scratch.put("features", rows.select("_id", "toxic", F.col("t.text").alias("text")).mapInPandas(extract, "_id long, toxic int, at array<int>"))
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    prior = math.log((positive + 1) / (n - positive + 10))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Ftrl(prior)
        for b in batches:
            for at, toxic in zip(b["at"], b.toxic):
                model.learn(np.asarray(at, np.int64), bool(toxic))
        w = model.weights(slice(0, 1 << BITS))
        kept = np.flatnonzero(w)
        yield pd.DataFrame({"at": np.append(kept, -1), "w": np.append(w[kept], model.bias())})

    # one pass in a fixed order over `sample` rows at most, streamed batch by batch
    ordered = rows.repartition(1).sortWithinPartitions(order, "_id").select("at", "toxic")
    out = ordered.mapInPandas(fit, "at long, w double").toPandas()  # 2^BITS + 1 rows at most
    found, bias = out[out["at"] >= 0], out[out["at"] < 0].w
    return found["at"].to_numpy(np.int64), found.w.to_numpy(np.float64), float(bias.iloc[0]) if len(bias) else prior


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `cols` and `score` (0 to 1) of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, w, bias = sent.value
        dense = np.zeros(1 << BITS)
        dense[at] = w
        memo = WordHashes()
        for b in batches:
            out = []
            for t in b.pop("_text"):
                hits = [x[dense[x] != 0] for x in places(t, memo)]
                once = np.unique(np.concatenate(hits)) if hits else np.empty(0, np.int32)
                out.append(sigmoid(dense[once].sum() + bias))
            yield b.assign(score=np.array(out, np.float64))

    src = docs.select(*cols, F.col("text").cast("binary").alias("_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in src.schema if f.name != "_text")
    return src.mapInPandas(run, f"{fields}, score double")


def classify(docs: DataFrame, labels: DataFrame, split: int = 5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; labels whose crc32(doc_id) mod split is 0 are held out."""
    held_out = crc_mod("doc_id", split) == 0
    model = train(docs.where(~held_out), labels.where(~held_out), sample)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
