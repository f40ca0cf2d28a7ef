"""Language of texts by a convolutional network over bytes.

Bytes have a learned vector each; filters of widths two to four run over them, the largest answer
of each filter in a window counts, and a softmax over the languages follows. The network is trained
in numpy on windows of labelled texts. A text is cut to windows of fixed length, all of them are
applied in batches, and the text's answer is that of the mean logits.

Cases: a null text or one without a letter gives `und` with score 0; a short text is one padded
window; a null label teaches nothing, nor does a text without letters; with nothing to learn from
every answer is `und`; rows without an id are predicted and never learned from; an empty table gives
an empty result; other input columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkframe.llm.common import bounded_sample, held_out, learnable
from talkframe.session import runs_in_tasks

runs_in_tasks(__name__)

WINDOW = 128
WIDTHS = (2, 3, 4)
EMBED, FILTERS = 8, 12
#: Labelled texts of a language that the network learns from, and windows taken of each, at most.
SAMPLE, PER_TEXT = 800, 3
EPOCHS, BATCH, RATE = 10, 64, 5e-3
PIECE = 128
UNKNOWN = "und"

LETTER = regex.compile(r"\p{L}")


def windows_of(text: str) -> np.ndarray:
    """All windows of a text's bytes in lower case; the last one is padded with noughts."""
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    return np.pad(data, (0, n * WINDOW - len(data))).reshape(n, WINDOW)


class Network:
    def __init__(self, classes: list[str], arrays: dict[str, np.ndarray] | None = None):
        self.classes = classes
        if arrays is None:
            rng = np.random.default_rng(11)
            arrays = {"embed": rng.normal(0, 0.5, (256, EMBED))}
            for k in WIDTHS:
                arrays[f"w{k}"] = rng.normal(0, (2 / (k * EMBED)) ** 0.5, (k * EMBED, FILTERS))
                arrays[f"b{k}"] = np.zeros(FILTERS)
            arrays["out"] = rng.normal(0, 0.2, (len(WIDTHS) * FILTERS, len(classes)))
            arrays["bias"] = np.zeros(len(classes))
        self.arrays = {k: np.asarray(v, np.float32) for k, v in arrays.items()}
        self._tables = None

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """Largest answer of each filter, and where it was met."""
        seen = self.arrays["embed"][x]
        flat = seen.reshape(len(x), -1)
        parts, places = [], []
        for k in WIDTHS:
            view = np.lib.stride_tricks.as_strided(flat, (len(x), WINDOW - k + 1, k * EMBED), (flat.strides[0], 4 * EMBED, 4))
            answer = (view.reshape(-1, k * EMBED) @ self.arrays[f"w{k}"]).reshape(len(x), WINDOW - k + 1, FILTERS)
            places.append((view, answer))
            parts.append(answer.max(1) + self.arrays[f"b{k}"])
        return np.concatenate(parts, 1), places

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """What the first two bytes under each filter add to its answer, and what the next two add."""
        if self._tables is None:
            sides = []
            for first in (0, 2):
                parts = []
                for k in WIDTHS:
                    w = self.arrays[f"w{k}"].reshape(k, EMBED, FILTERS)
                    own = [self.arrays["embed"] @ w[j] if j < k else np.zeros((256, FILTERS), np.float32) for j in (first, first + 1)]
                    parts.append((own[0][:, None] + own[1][None]).reshape(65536, FILTERS))
                sides.append(np.ascontiguousarray(np.concatenate(parts, 1)))
            self._tables = sides[0], sides[1]
        return self._tables

    def logits(self, x: np.ndarray) -> np.ndarray:
        """One row per window. Filters are looked up by pairs of bytes, all widths at once."""
        front, back = self.pair_tables()
        rows = np.zeros((WINDOW + 3, len(x)), np.int32)
        rows[:WINDOW] = x.T
        pair = rows[:-1] * 256 + rows[1:]
        answer = np.take(front, pair[:WINDOW], axis=0)
        answer += np.take(back, pair[2:], axis=0)
        parts = [answer[: WINDOW - k + 1, :, i * FILTERS : (i + 1) * FILTERS].max(0) + self.arrays[f"b{k}"] for i, k in enumerate(WIDTHS)]
        return np.maximum(np.concatenate(parts, 1), 0) @ self.arrays["out"] + self.arrays["bias"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        a = self.arrays
        pre, places = self.pooled(x)
        hidden = np.maximum(pre, 0)
        logits = hidden @ a["out"] + a["bias"]
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        made = {"out": hidden.T @ p, "bias": p.sum(0), "embed": np.zeros_like(a["embed"])}
        back = (p @ a["out"].T) * (pre > 0)
        rows = np.arange(len(x))[:, None]
        for i, k in enumerate(WIDTHS):
            part, (view, answer) = back[:, i * FILTERS : (i + 1) * FILTERS], places[i]
            at = answer.argmax(1)
            met = view[rows, at]  # examples, filters, inputs
            made[f"w{k}"] = np.einsum("nfi,nf->if", met, part)
            made[f"b{k}"] = part.sum(0)
            spread = (part[:, :, None] * a[f"w{k}"].T[None]).reshape(len(x), FILTERS, k, EMBED)
            for j in range(k):
                np.add.at(made["embed"], x[rows, at + j], spread[:, :, j])
        return made

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> None:
        """Adam over shuffled batches in a fixed order."""
        rng = np.random.default_rng(3)
        first = {k: np.zeros_like(v) for k, v in self.arrays.items()}
        second = {k: np.zeros_like(v) for k, v in self.arrays.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for s in range(0, len(x), BATCH):
                pick = order[s : s + BATCH]
                step += 1
                for k, g in self.gradients(x[pick], y[pick]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.arrays[k] = (self.arrays[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)


NAMES = ["embed", *[f"{c}{k}" for k in WIDTHS for c in "wb"], "out", "bias"]
MODEL = "classes array<string>, " + ", ".join(f"{n} array<float>, {n}_shape array<int>" for n in NAMES)


def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A network from (doc_id, text, lang); the sample is bounded, so one task holds it."""
    rows = pd.concat([pd.DataFrame({"doc_id": [], "text": [], "lang": []}), *batches], ignore_index=True).sort_values(["lang", "doc_id", "text"])
    classes = sorted(set(rows["lang"]))
    rng, xs, ys = np.random.default_rng(7), [], []
    for text, lang in zip(rows["text"], rows["lang"]):
        found = windows_of(text)
        pick = rng.permutation(len(found))[:PER_TEXT]
        xs.append(found[pick])
        ys += [classes.index(lang)] * len(pick)
    if not classes:
        return
    net = Network(classes)
    net.train(np.concatenate(xs), np.array(ys))
    row = {"classes": [classes]}
    for n in NAMES:
        row |= {n: [net.arrays[n].ravel()], f"{n}_shape": [list(net.arrays[n].shape)]}
    yield pd.DataFrame(row)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """The network, from at most ``sample`` texts of each language among those that may be learned from."""
    rows = docs.where(learnable(F.col("doc_id")) & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    chosen = bounded_sample(rows.select("doc_id", "lang").distinct(), "lang", "doc_id", sample)
    # one row per id and language leaves the scan's tasks, whatever the table repeats; only these meet in one
    picked = rows.select("doc_id", "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    picked = picked.repartition(1).mapInPandas(train, MODEL).first()
    if picked is None:
        return None
    return Network(list(picked["classes"]), {n: np.array(picked[n], np.float32).reshape(picked[f"{n}_shape"]) for n in NAMES})


def answers(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability of each text; windows of all texts are applied together, piece by piece."""
    spoken = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    total = np.zeros((len(texts), len(net.classes)))
    count = np.zeros(len(texts))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []

    def apply() -> None:
        x, who = np.concatenate(held), np.concatenate(owner)
        for s in range(0, len(x), PIECE):
            np.add.at(total, who[s : s + PIECE], net.logits(x[s : s + PIECE]))
        np.add.at(count, who, 1)
        held.clear(), owner.clear()

    size = 0
    for i in spoken:
        held.append(windows_of(texts[i]))
        owner.append(np.full(len(held[-1]), i))
        size += len(held[-1])
        if size >= 64 * PIECE:
            apply()
            size = 0
    if held:
        apply()
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    for i in spoken:
        z = total[i] / count[i]
        p = np.exp(z - z.max())
        p /= p.sum()
        names[i], scores[i] = net.classes[int(p.argmax())], float(p.max())
    return names, scores


def languages(docs: DataFrame) -> DataFrame:
    """Per document the predicted language, its score, and whether it was held out from learning."""
    net = learn(docs)
    arrays, classes = (net.arrays, net.classes) if net else ({}, [])

    @F.pandas_udf("lang_pred string, score double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Network(classes, arrays) if classes else None
        for texts in batches:
            names, scores = answers(own, texts.tolist()) if own else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), told("text").alias("_x"))
    return rows.select("doc_id", "held_out", "_x.lang_pred", "_x.score")
