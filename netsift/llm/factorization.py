"""Quality scores by a factorisation machine.

Inputs of a text: its distinct words, hashed; statistics of its structure, each as the one of BINS bins it falls in; and
its length as metadata. The score is logistic(bias + sum of weights + all pairwise interactions), the interaction of
two inputs being the product of their low-rank vectors. With s = sum of x v and q = sum of (x v)^2 all pairs cost
(s^2 - q) / 2, so a text is scored in time linear in its inputs.

The machine learns by AdaGrad on the logistic loss, in one task, from a bounded sample of labelled texts.

Edge cases: a null text is empty; the empty text has statistics and no words. Without labels of both kinds the score is
the share of label 1 (0 without any label).
"""

from __future__ import annotations

import math
import zlib
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame

from netsift.llm import labelled

HASHED = 1 << 15
RANK = 8
BINS = 16
TRAIN_DOCS = 5000  # labelled documents to learn from, at most
STATISTICS = ("length", "words", "lines", "word_length", "upper", "lower", "digits", "signs", "stops", "distinct_words",
              "repeated_words", "distinct_lines", "line_words", "commonest_sign", "commonest_byte")
_KIND = np.zeros(256, np.int64)  # byte: 0 other, 1 upper, 2 lower, 3 digit, 4 white space, 5 sign
for _b in range(128):
    _c = chr(_b)
    _KIND[_b] = 1 if _c.isupper() else 2 if _c.islower() else 3 if _c.isdigit() else 4 if _c.isspace() else 5 if _c.isprintable() else 0
_SIGNS = np.flatnonzero(_KIND == 5)


def described(text: str) -> tuple[list[int], list[float]]:
    """The hashed distinct words and the statistics of a text."""
    data = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=6)
    solid = max(1.0, len(data) - kinds[4])
    words, lines = text.split(), text.split("\n")
    distinct, n, m = set(words), max(1, len(words)), max(1, len(lines))
    hashed = list({zlib.crc32(w.encode("utf-8", "surrogatepass")) & HASHED - 1 for w in distinct})
    return hashed, [
        math.log1p(len(text)), math.log1p(len(words)), math.log1p(len(lines)), solid / n, kinds[1] / solid, kinds[2] / solid, kinds[3] / solid,
        kinds[5] / solid, counts[46] / n, len(distinct) / math.sqrt(n), sum(map(eq, words, words[1:])) / n, len(set(lines)) / m, n / m,
        counts[_SIGNS].max() / solid, counts.max() / max(1, len(data))]


class Machine:
    def __init__(self, model: dict[str, np.ndarray]):
        self.edges, self.bias = model["edges"], float(model["bias"])
        self.weights, self.vectors = model["weights"], model["vectors"]

    def inputs(self, found: list[tuple[list[int], list[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers and values of the inputs of all texts, one after the other, and where each text begins."""
        sizes = np.array([len(h) for h, _ in found])
        table = np.array([s for _, s in found])
        bins = np.stack([HASHED + k * BINS + np.searchsorted(self.edges[k], table[:, k], side="right") for k in range(len(self.edges))], axis=1)
        rows = [np.concatenate([np.array(h, np.int64), b]) for (h, _), b in zip(found, bins)]
        values = [np.concatenate([np.full(n, 1 / math.sqrt(max(1, n)), np.float32), np.ones(len(self.edges), np.float32)]) for n in sizes]
        starts = np.cumsum(sizes + len(self.edges)) - sizes - len(self.edges)
        return np.concatenate(rows), np.concatenate(values), starts

    def raw(self, numbers: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value before the logistic function, and s of every text."""
        xv = self.vectors[numbers] * values[:, None]
        s = np.add.reduceat(xv, starts, axis=0)
        q = np.add.reduceat(xv * xv, starts, axis=0)
        return self.bias + np.add.reduceat(self.weights[numbers] * values, starts) + 0.5 * (s * s - q).sum(axis=1), s

    def scores(self, texts: list[str]) -> np.ndarray:
        return labelled.logistic(self.raw(*self.inputs([described(t) for t in texts]))[0].astype(np.float64))


def _edges(table: np.ndarray) -> np.ndarray:
    return np.quantile(table, np.arange(1, BINS) / BINS, axis=0).T


def fit(labels: np.ndarray, texts: list[str], epochs: int = 12, batch: int = 64, rate: float = 0.08, ridge: float = 2e-4, seed: int = 7) -> dict[str, np.ndarray]:
    random = np.random.default_rng(seed)
    inputs = HASHED + len(STATISTICS) * BINS
    share = float(np.clip(labels.mean() if len(labels) else 0.0, 1e-6, 1 - 1e-6))
    model = {"edges": np.zeros((len(STATISTICS), BINS - 1)), "bias": np.array(math.log(share / (1 - share))), "weights": np.zeros(inputs, np.float32),
             "vectors": np.zeros((inputs, RANK), np.float32)}
    if not len(labels) or labels.min() == labels.max():
        return model
    found = [described(t) for t in texts]
    model["edges"] = _edges(np.array([s for _, s in found]))
    machine = Machine(model)
    w, v = machine.weights, machine.vectors
    v[:] = random.normal(0, 0.05, v.shape)
    square_w, square_v, square_b = np.full(inputs, 1e-2, np.float32), np.full(v.shape, 1e-2, np.float32), 1e-2
    for _ in range(epochs):
        order = random.permutation(len(texts))
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            numbers, values, starts = machine.inputs([found[i] for i in some])
            raw, s = machine.raw(numbers, values, starts)
            error = labelled.logistic(raw) - labels[some]
            own = np.repeat(np.arange(len(some)), np.diff(np.append(starts, len(numbers))))
            unique, place = np.unique(numbers, return_inverse=True)
            x = values * error[own]
            grad_w = np.bincount(place, weights=x, minlength=len(unique)) / len(some) + ridge * w[unique]
            each = x[:, None] * (s[own] - v[numbers] * values[:, None])
            grad_v = np.stack([np.bincount(place, weights=each[:, f], minlength=len(unique)) for f in range(RANK)], axis=1) / len(some) + ridge * v[unique]
            square_w[unique] += grad_w**2
            square_v[unique] += grad_v**2
            w[unique] -= rate * grad_w / np.sqrt(square_w[unique])
            v[unique] -= rate * grad_v / np.sqrt(square_v[unique])
            square_b += error.mean() ** 2
            machine.bias -= rate * error.mean() / math.sqrt(square_b)
    return {"edges": model["edges"], "bias": np.array(machine.bias), "weights": w, "vectors": v}


def train(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = TRAIN_DOCS) -> Machine:
    return Machine(labelled.unpacked(labelled.trained(labelled.sample(docs, labels, "quality", allowed, most), fit)))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = TRAIN_DOCS) -> DataFrame:
    """Every document scored; labels are learnt only from documents that aren't held out."""
    machine = train(docs, labels, labelled.fold(5) != 0, most)
    return labelled.scored(docs, labelled.fold(5) == 0, machine.scores, threshold)


def of_quality(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = TRAIN_DOCS) -> DataFrame:
    """The rows of `docs` with a score of `threshold` or more; the machine learns from the labelled rows of `all_docs`."""
    machine = train(all_docs, labels, labelled.fold(5) != 0, most)
    return labelled.kept(docs, machine.scores, lambda s: s >= threshold)
