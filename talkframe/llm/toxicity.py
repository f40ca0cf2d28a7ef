"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words, pairs and pairs with one word between become hashed features, present or not. The optimiser
keeps a rate of its own per coordinate, and its L1 term leaves most weights at nought, so what is
sent to the executors is a short list of indices and weights whose length the table of hashes bounds.

Words are runs of bytes that are letters, digits or beyond ASCII, in lower case. They are hashed for
whole batches at once: the hash of a word is a difference of running sums of its bytes' terms.

Cases: null and empty texts have no features and get the bias alone; a null label teaches nothing;
several labels of a document count as their largest; with no labels, or one kind only, every score
is that of the bias; rows without an id are scored and never learned from; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import bounded_sample, held_out, learnable
from talkframe.session import runs_in_tasks

runs_in_tasks(__name__)

BITS = 20
#: Labelled documents of each label that the model learns from, at most.
SAMPLE = 3000
THRESHOLD = 0.3
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 16.0, 1.0

#: Log odds where there is nothing to learn from.
PRIOR = -4.0

PRIME = np.uint64(0x100000001B3)
INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
CHUNK = 1 << 21
WORD_BYTE = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME and its inverse to the powers 0 to n - 1, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        made = []
        for base in (PRIME, INVERSE):
            row = np.full(n, base)
            row[0] = 1
            made.append(np.multiply.accumulate(row))
        _powers[:] = made
    return _powers[0][:n], _powers[1][:n]


def batches_of(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(word hashes, document of each word, documents) for runs of texts of about CHUNK bytes."""
    held: list[bytes] = []
    size, first = 0, 0
    for i, text in enumerate(texts):
        line = (text or "").lower().encode("utf-8", "surrogatepass")
        held.append(line)
        size += len(line) + 1
        if size >= CHUNK or i == len(texts) - 1:
            yield *word_hashes(held, first), i + 1
            held, size, first = [], 0, i + 1


def word_hashes(lines: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(lines) + b" ", np.uint8)
    in_word = WORD_BYTE[data]
    edge = np.diff(np.r_[False, in_word].astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(data) + 1)
    running = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])]
    hashes = mixed((running[ends] - running[starts]) * down[starts])
    bounds = np.cumsum([len(x) + 1 for x in lines])
    return hashes, np.searchsorted(bounds, starts, side="right") + first


def features(hashes: np.ndarray, doc: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(document, index) of every word, pair and pair over a gap; not yet made distinct."""
    found, owner = [hashes], [doc]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = doc[gap:] == doc[:-gap] if len(doc) > gap else np.zeros(0, bool)
        found.append(mixed(hashes[:-gap][same] * np.uint64(factor) + hashes[gap:][same]) if len(doc) > gap else np.zeros(0, np.uint64))
        owner.append(doc[:-gap][same] if len(doc) > gap else np.zeros(0, np.int64))
    return np.concatenate(owner), (np.concatenate(found) & np.uint64((1 << bits) - 1)).astype(np.int64)


def ftrl(examples: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, l1: float = L1) -> tuple[np.ndarray, np.ndarray, float]:
    """(indices, weights, bias) learned one example after the other, in a fixed order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    order = np.random.default_rng(5)

    def weight(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            index, label = examples[k]
            w, bias = weight(z[index], n[index], l1), float(weight(bias_z, bias_n, 0.0))
            error = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - label
            sigma = (np.sqrt(n[index] + error**2) - np.sqrt(n[index])) / ALPHA
            z[index] += error - sigma * w
            n[index] += error**2
            bias_z += error - (np.sqrt(bias_n + error**2) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += error**2
    w = weight(z, n, l1)
    index = np.flatnonzero(w)
    return index, w[index], float(weight(bias_z, bias_n, 0.0))


def fitted(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates are chosen with the L1 term; their weights, which it has drawn to nought, are then learned anew without it."""
    chosen = np.zeros(1 << BITS, bool)
    chosen[ftrl(examples)[0]] = True
    return ftrl([(index[chosen[index]], label) for index, label in examples], epochs=2 * EPOCHS, l1=0.0)


MODEL = "indices array<int>, weights array<double>, bias double"


def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One model from (doc_id, text, label). The sample is bounded, so one task holds it."""
    rows = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "label": []}), *batches], ignore_index=True).sort_values(["doc_id", "text"])
    examples, first = [], 0
    labels = rows["label"].tolist()
    for hashes, doc, until in batches_of(rows["text"].tolist()):
        owner, index = features(hashes, doc)
        pairs = np.unique(owner * (1 << BITS) + index)
        owner, index = pairs >> BITS, pairs & ((1 << BITS) - 1)
        edges = np.searchsorted(owner, np.arange(first, until + 1))
        examples += [(index[edges[i] : edges[i + 1]], int(labels[first + i])) for i in range(until - first)]
        first = until
    index, weights, bias = fitted(examples) if len(set(labels)) > 1 else (np.zeros(0, int), np.zeros(0), PRIOR if set(labels) <= {0} else -PRIOR)
    yield pd.DataFrame({"indices": [index.astype(np.int32)], "weights": [weights], "bias": [bias]})


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """The model, from at most ``sample`` labelled documents of each label that may be learned from."""
    known = labels.where(learnable(F.col("doc_id")) & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = bounded_sample(known, "label", "doc_id", sample)
    # one row per id leaves the scan's tasks, whatever the table repeats; only these meet in one
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    row = rows.repartition(1).mapInPandas(train, MODEL).first()
    if row is None:
        return np.zeros(0, np.int64), np.zeros(0), PRIOR
    # the sample holds label 1 more often than the table does
    odds = [counts.get(k, 0) / max(1, min(sample, counts.get(k, 0))) for k in (0, 1)]
    shift = float(np.log(odds[1] / odds[0])) if min(odds) > 0 else 0.0
    return np.array(row["indices"], np.int64), np.array(row["weights"], np.float64), row["bias"] + shift


def scorer(model: tuple[np.ndarray, np.ndarray, float]):
    """Column function: the probability of label 1 for each whole text."""
    indices, weights, bias = model

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = np.zeros(1 << BITS)
        table[indices] = weights
        known = table != 0
        for texts in parts:
            total = np.full(len(texts), float(bias))
            for hashes, doc, _ in batches_of(texts.tolist()):
                owner, index = features(hashes, doc)
                hit = known[index]
                pairs = np.unique(owner[hit] * (1 << BITS) + index[hit])
                np.add.at(total, pairs >> BITS, table[pairs & ((1 << BITS) - 1)])
            yield pd.Series(1 / (1 + np.exp(-np.clip(total, -35, 35))))

    return score


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document its score and whether it was held out from learning."""
    score = scorer(learn(docs, labels))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not predicted to be toxic."""
    score = scorer(learn(docs, labels))
    return docs.select(F.struct(*docs.columns).alias("row"), score("text").alias("score")).where(F.col("score") < threshold).select("row.*")
