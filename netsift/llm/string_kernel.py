"""Toxicity by a support vector machine with a subsequence string kernel and Nyström landmarks.

The kernel of two words sums, over all subsequences of three characters that both hold, DECAY to the power of the
lengths they span; so inserted characters and gaps weaken a match but don't undo it. A sentence scores as its worst
word, a text as its worst sentence.

Training takes labelled texts as bags of sentences (multiple-instance learning): in a toxic text the words that
are in toxic texts beyond chance are its witnesses, or else the one that scores highest, at first by association with
the label, then by the machine itself; the words of other texts are negatives. Witnesses with inserted characters are added. Landmarks are the words most and least associated with
the label; the machine is linear in the Nyström features of the normalised kernel, with squared hinge loss. Since it
is linear in the kernel, its landmarks add up to one weight for each subsequence, which is what scoring uses.

Edge cases: a null text is empty; a text without words scores as its least possible; words longer than a window are
taken in overlapping windows; a word with signs inside is also read without them; single characters set apart by white space are also read as one word. Without labels of
both kinds the score is the share of label 1 (0 without any label).
"""

from __future__ import annotations

import functools
import math
import re
import string
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame

from netsift.llm import labelled

DECAY = 0.75
WINDOW, STEP = 24, 12
LANDMARKS = 96
TRAIN_DOCS = 2500  # labelled documents to learn from, at most
CODES = 64
WORDS = 300_000  # scores remembered by a task
_SPELT = re.compile(r"(?<!\S)(?:\S\s){2,}\S(?!\S)")
_SIGNS = string.punctuation + "¡¿«»„“”‘’…–—·§°"


@functools.cache
def _codes() -> np.ndarray:
    """Codes of characters below U+0250: 1-26 letters, 27-36 digits, 63 signs, other letters by a hash."""
    out = np.full(0x250, 63, np.int32)
    for c in range(0x250):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c < 123 else 37 + c % 26
        elif chr(c).isdigit():
            out[c] = 27 + c % 10
    return out


def coded(word: str) -> np.ndarray:
    points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<i4")
    return np.where(points < 0x250, _codes()[np.minimum(points, 0x24F)], 37 + points % 26).astype(np.int32)


@functools.cache
def _subsequences(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and weights of all subsequences of three of a word of `length`."""
    at = np.array(list(combinations(range(length), 3)), np.int64).reshape(-1, 3)
    return at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


@functools.cache
def _spread(length: int) -> np.ndarray:
    gap = np.arange(length)[:, None] - np.arange(length)[None, :]
    return np.where(gap > 0, DECAY ** np.maximum(gap, 0), 0.0).astype(np.float32)


def features(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers (words x subsequences) of words of one length, and the weight of each column."""
    at, weight = _subsequences(words.shape[1])
    return (words[:, at[:, 0]] * CODES + words[:, at[:, 1]]) * CODES + words[:, at[:, 2]], weight


def norms(words: np.ndarray) -> np.ndarray:
    """The square root of each word's kernel with itself."""
    same = (words[:, :, None] == words[:, None, :]).astype(np.float32)
    spread = _spread(words.shape[1])
    inner = same * np.float32(DECAY**2)
    for _ in range(2):  # `inner` is symmetric, so its rows may stand for its columns
        half = (inner.reshape(-1, words.shape[1]) @ spread.T).reshape(same.shape)
        inner = same * (np.ascontiguousarray(half.swapaxes(1, 2)).reshape(-1, words.shape[1]) @ spread.T).reshape(same.shape)
    return np.sqrt(inner.sum(axis=(1, 2), dtype=np.float64))


def windows(word: str) -> list[str]:
    if len(word) <= WINDOW:
        return [word]
    return [word[i:i + WINDOW] for i in range(0, len(word) - WINDOW + STEP, STEP)]


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        out.setdefault(len(w), []).append(i)
    return out


def word_scores(words: list[str], weights: np.ndarray, bias: float, at_once: int = 200_000) -> np.ndarray:
    """The machine's value for each word: weights . features / norm + bias."""
    out = np.full(len(words), bias)
    weights = weights.astype(np.float32)
    for length, rows in by_length(words).items():
        if length < 3:
            continue
        step = max(1, at_once // max(len(_subsequences(length)[1]), length * length))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            matrix = coded("".join([words[i] for i in some])).reshape(len(some), length)
            numbers, weight = features(matrix)
            out[some] += (weights[numbers] @ weight) / norms(matrix)
    return out


def words_of(text: str) -> set[str]:
    """What is scored of a text: its lower-cased words, and runs of single characters as words."""
    text = text.lower()
    found = set(text.split())
    found.update("".join(m.split()) for m in _SPELT.findall(text))
    return found


def trimmed(word: str) -> str:
    return word.strip(_SIGNS)


def squeezed(word: str) -> str:
    """The word without the signs inside it."""
    return word if word.isalnum() else "".join(filter(str.isalnum, word))


class Machine:
    def __init__(self, model: dict[str, np.ndarray]):
        self.weights = model["weights"].astype(np.float64)
        self.bias, self.slope, self.shift = (float(x) for x in model["scalars"])
        self.known: dict[str, float] = {}
        self.older: dict[str, float] = {}

    def _learn(self, words: set[str]) -> None:
        if len(self.known) > WORDS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new: dict[str, list[str]] = {}  # trimmed -> as written
        for w in words:
            if w not in known:
                t = trimmed(w)
                value = older.get(w) if w in older else known.get(t)
                if value is None:
                    new.setdefault(t, []).append(w)
                else:
                    known[w] = value
        cut = [windows(t) + windows(inner) * (inner != t) for t in new for inner in [squeezed(t)]]
        values = word_scores([p for ps in cut for p in ps], self.weights, self.bias).tolist()
        at = 0
        for (t, written), ps in zip(new.items(), cut):
            known[t] = value = max(values[at:at + len(ps)])
            at += len(ps)
            for w in written:
                known[w] = value

    def values(self, texts: list[str]) -> np.ndarray:
        found = [words_of(t) for t in texts]
        self._learn(set().union(*found))
        get = self.known.__getitem__
        return np.array([max(map(get, ws), default=self.bias) for ws in found])

    def scores(self, texts: list[str]) -> np.ndarray:
        return labelled.logistic(self.slope * self.values(texts) + self.shift)


def _kernel(words: list[str], numbers: np.ndarray, landmark: np.ndarray) -> np.ndarray:
    """Normalised kernel of words with the landmarks, whose normalised features are the columns of `landmark`."""
    out = np.zeros((len(words), landmark.shape[1]))
    padded = np.vstack([landmark, np.zeros(landmark.shape[1])])
    for length, rows in by_length(words).items():
        if length < 3:
            continue
        step = max(1, 20_000 // len(_subsequences(length)[1]))
        for at in range(0, len(rows), step):
            some = rows[at:at + step]
            matrix = np.stack([coded(words[i]) for i in some])
            found, weight = features(matrix)
            column = np.minimum(np.searchsorted(numbers, found), len(numbers) - 1)
            column[numbers[column] != found] = len(numbers)  # no landmark has it
            out[some] = np.tensordot(padded[column], weight, axes=(1, 0)) / norms(matrix)[:, None]
    return out


def _landmark_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    found = []
    for w in words:
        matrix = coded(w)[None, :]
        numbers, weight = features(matrix)
        found.append((numbers[0], weight / norms(matrix)[0]))
    numbers = np.unique(np.concatenate([n for n, _ in found]))
    out = np.zeros((len(numbers), len(words)))
    for j, (n, weight) in enumerate(found):
        np.add.at(out[:, j], np.searchsorted(numbers, n), weight)
    return numbers, out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Linear machine with squared hinge loss and a bias as its last weight, by Newton steps on the active rows."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        a, c = x[active], weight[active]
        new = np.linalg.solve((a * c[:, None]).T @ a + np.diag(penalty), (a * c[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            return new
        w = new
    return w


def _platt(values: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    x = np.column_stack([values, np.ones(len(values))])
    beta = np.zeros(2)
    for _ in range(50):
        p = labelled.logistic(x @ beta)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hessian, x.T @ (weight * (labels - p)) - np.array([1e-2, 1e-6]) * beta)
        beta += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return float(beta[0]), float(beta[1])


def _with_insertions(word: str) -> list[str]:
    """The word with signs between its characters, with one sign, with one character doubled."""
    middle = len(word) // 2
    return ["*".join(word), word[:middle] + "-" + word[middle:], word[:middle] + word[middle] + word[middle:]]


def fit(labels: np.ndarray, texts: list[str], rounds: int = 3, negatives: int = 4000) -> dict[str, np.ndarray]:
    nothing = {"weights": np.zeros(CODES**3, np.float32)}
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        share = min(max(share, 1e-6), 1 - 1e-6)
        return nothing | {"scalars": np.array([0.0, 0.0, math.log(share / (1 - share))])}
    bags = [{p for w in words_of(t) for p in windows(trimmed(w)) if len(p) >= 3} for t in texts]
    toxic, clean = Counter(), Counter()
    for bag, label in zip(bags, labels):
        (toxic if label else clean).update(bag)
    n1, n0 = int(labels.sum()), int((1 - labels).sum())

    def association(w: str) -> float:
        p = (toxic[w] + clean[w]) / (n1 + n0)
        return (toxic[w] / n1 - clean[w] / n0) / math.sqrt(max(p * (1 - p), 1e-12) * (1 / n1 + 1 / n0))

    z = {w: association(w) for w in toxic}
    ranked = sorted((w for w in z if toxic[w] * 2 > toxic[w] + clean[w]), key=lambda w: (-z[w], w))
    common = sorted(clean, key=lambda w: (-clean[w], w))
    landmarks = ranked[:LANDMARKS // 2] + [w for w in common if z.get(w, -1.0) < 1][:LANDMARKS // 2]
    numbers, landmark = _landmark_features(landmarks)
    values, vectors = np.linalg.eigh(landmark.T @ landmark)
    good = values > 1e-6 * values.max()
    half = vectors[:, good] / np.sqrt(values[good])  # Nyström: features = kernel with landmarks @ half

    # words that are in toxic texts so often that chance would give none of them
    share = n1 / (n1 + n0)

    def surprise(w: str) -> float:
        n, k = toxic[w] + clean[w], toxic[w]
        p = k / n
        if p <= max(share, 0.5):  # a word of clean texts, or of the language most toxic texts are in
            return 0.0
        return n * (p * math.log(p / share) + (math.log((1 - p) / (1 - share)) * (1 - p) if p < 1 else 0.0))

    telling = {w for w in toxic if surprise(w) > math.log(len(z)) + 2}
    positive_bags = [b for b, label in zip(bags, labels) if label and b]

    def witnesses_of(bag: set[str]) -> list[str]:
        return sorted(bag & telling) or [max(bag, key=lambda w: (score.get(w, -9.0), w))]

    never = sorted(w for w in clean if clean[w] >= toxic[w])
    step = max(1, len(never) // negatives)
    negative = sorted({*never[::step][:negatives], *[w for w in common if clean[w] >= toxic[w]][:negatives // 4]})
    score = {w: surprise(w) for w in toxic}
    weights, bias = np.zeros(CODES**3), 0.0
    for round_ in range(rounds):
        witnesses = Counter(w for b in positive_bags for w in witnesses_of(b))
        positive = [v for w in witnesses for v in (w, *_with_insertions(w))]
        weight1 = np.array([c / (4 if i else 1) for w, c in witnesses.items() for i in range(4)], float)
        words = positive + negative
        x = _kernel(words, numbers, landmark) @ half
        y = np.repeat([1.0, -1.0], [len(positive), len(negative)])
        weight = np.concatenate([weight1 / weight1.sum(), np.full(len(negative), 4.0 / len(negative))]) * 200
        w = _svm(x, y, weight)
        weights = np.zeros(CODES**3)
        weights[numbers] = landmark @ (half @ w[:-1])
        bias = float(w[-1])
        if round_ + 1 == rounds:
            break
        # who witnesses for texts without a telling word, and which words of clean texts the next round must learn
        asked = sorted({w for b in positive_bags if not b & telling for w in b} | set(never[::max(1, len(never) // (5 * negatives))]))
        score = dict(zip(asked, word_scores(asked, weights, bias).tolist()))
        hard = sorted((v for v in asked if clean[v] >= toxic[v] and clean[v]), key=lambda v: (-score[v], v))[:negatives // 4]
        negative = sorted(set(negative) | set(hard))
    machine = Machine({"weights": weights.astype(np.float32), "scalars": np.array([bias, 1.0, 0.0])})
    few = np.flatnonzero(labels == 0)[:2 * n1 + 500]
    rated = np.sort(np.concatenate([np.flatnonzero(labels == 1), few]))
    best = machine.values([texts[i] for i in rated])
    # all texts of label 1 and some of label 0: the shift is corrected to the share in the sample
    slope, shift = _platt(best, labels[rated].astype(float), np.where(labels[rated] == 1, 1.0, n0 / len(few)))
    return {"weights": weights.astype(np.float32), "scalars": np.array([bias, slope, shift])}


def train(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = TRAIN_DOCS) -> Machine:
    return Machine(labelled.unpacked(labelled.trained(labelled.sample(docs, labels, "toxic", allowed, most), fit)))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = TRAIN_DOCS) -> DataFrame:
    """Every document scored; labels are learnt only from documents that aren't held out."""
    machine = train(docs, labels, labelled.fold(4) != 2, most)
    return labelled.scored(docs, labelled.fold(4) == 2, machine.scores, threshold)


def without_toxic(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = TRAIN_DOCS) -> DataFrame:
    """The rows of `docs` that aren't toxic; the machine learns from the labelled rows of `all_docs`."""
    machine = train(all_docs, labels, labelled.fold(4) != 2, most)
    return labelled.kept(docs, machine.scores, lambda s: s < threshold)
