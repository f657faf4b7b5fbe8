"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document. Expectation-maximisation
over the counts of vote patterns estimates how often each of them is right, which turns every
pattern into a probability; these train a linear scorer on hashed trigrams, which then scores
all documents, whatever the heuristics said.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm.common import id_text, map_batches, stored, trigram_buckets
from tagloom.llm.fertility import repeated_words

BAD, GOOD, NONE = 0, 1, 2
_SYMBOLS = b"#*$%&|<>"
_ENDS = b".!?:;\"'"
_MARK = re.compile(rb"[#*$%&|<>~^=+_{}\[\]\\]|[!?]{2}")

#: name, bad from, good up to: what each heuristic measures and where it votes; between the two it abstains.
LABELLERS = [
    ("repeated", 0.30, 0.10), ("symbols", 0.15, 0.02), ("capitals", 0.30, 0.12), ("top_word", 0.25, 0.12),
    ("exclamations", 0.15, 0.03), ("separators", 0.15, 0.03), ("odd_length", 0.5, 0.25), ("unfinished_lines", 0.9, 0.5),
    ("short", 0.95, 0.8), ("marked_words", 0.3, 0.1),
]


@dataclass(frozen=True)
class Training:
    """The scorer is fitted on the ``sample`` different documents with the smallest hashes of id and text (features
    of this many rows, and no more, reach the driver); labels, votes and scores cover all rows."""

    sample: int = 4000
    bits: int = 14
    epochs: int = 30
    rate: float = 0.5
    decay: float = 1e-5


def measures(text: bytes) -> list[float]:
    """The value of every labeller, 0 (fine) to 1; a text without words is as bad as can be."""
    words = text.split()
    n = len(words)
    if not n:
        return [1.0] * len(LABELLERS)
    counts = Counter(words)
    names = {w: i for i, w in enumerate(counts)}
    ids = np.fromiter((names[w] for w in words), np.int64, n)
    raw = np.frombuffer(text, np.uint8)
    upper = int(((raw >= 65) & (raw <= 90)).sum())
    lower = int(((raw >= 97) & (raw <= 122)).sum())
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    mean = sum(map(len, words)) / n
    return [
        repeated_words(ids, len(names)) / n,
        sum(text.count(c) for c in _SYMBOLS) / n,
        upper / max(1, upper + lower),
        max(0, max(counts.values()) - 2) / n,
        text.count(b"!") / n,
        text.count(b"|") / n,
        min(1.0, abs(mean - 6) / 8),
        sum(line.rstrip()[-1] not in _ENDS for line in lines) / len(lines),
        1 - min(n, 100) / 100,
        sum(k for w, k in counts.items() if _MARK.search(w)) / n,
    ]


def vote(text: bytes) -> str:
    """One digit per labeller: 0 bad, 1 good, 2 no vote."""
    return "".join(str(BAD if value >= bad else GOOD if value <= good else NONE)
                   for value, (_, bad, good) in zip(measures(text), LABELLERS))


@dataclass(frozen=True)
class LabelModel:
    """``prior`` of a good document and ``outcome[labeller, class, vote]``."""

    prior: float
    outcome: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        logs = np.log([1 - self.prior, self.prior]) + sum(np.log(self.outcome[j][:, votes[:, j]]).T for j in range(votes.shape[1]))
        return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))

    def accuracy(self) -> np.ndarray:
        """How often each labeller is right when it votes."""
        share = np.array([1 - self.prior, self.prior])
        right = share[0] * self.outcome[:, 0, BAD] + share[1] * self.outcome[:, 1, GOOD]
        return right / (share[:, None] * self.outcome[:, :, :2].sum(axis=2).T).sum(axis=0)


def fit_labels(patterns: dict[str, int], rounds: int = 200, tolerance: float = 1e-9, smoothing: float = 1.0) -> LabelModel:
    """Expectation-maximisation on counts of vote patterns, started from the share of good votes."""
    keys = sorted(patterns)
    weight = np.array([patterns[k] for k in keys], float)
    votes = np.array([list(map(int, k)) for k in keys])
    good, bad = (votes == GOOD).sum(axis=1), (votes == BAD).sum(axis=1)
    belief = (good + 1.0) / (good + 2.5 * bad + 2.0)
    model, last = None, None
    for _ in range(rounds):
        both = np.stack([weight * (1 - belief), weight * belief])
        prior = (both[1].sum() + smoothing) / (weight.sum() + 2 * smoothing)
        outcome = np.array([[[row[votes[:, j] == v].sum() + smoothing for v in (BAD, GOOD, NONE)] for row in both] for j in range(votes.shape[1])])
        model = LabelModel(float(prior), outcome / outcome.sum(axis=2, keepdims=True))
        belief = model.posterior(votes)
        if last is not None and np.abs(belief - last).max() < tolerance:
            break
        last = belief
    return model


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of a text and their square-rooted shares, a vector of length one."""
    buckets, counts = np.unique(trigram_buckets(text, bits), return_counts=True)
    return buckets, np.sqrt(counts / max(1, counts.sum()))


def fit_scorer(rows: list[tuple[float, np.ndarray, np.ndarray]], training: Training) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels with per-weight step sizes; both classes weigh the same."""
    weights, bias = np.zeros(1 << training.bits), 0.0
    if not rows:
        return weights, bias
    labels = np.array([r[0] for r in rows])
    good = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    balance = np.where(labels >= 0.5, 0.5 / good, 0.5 / (1 - good))
    starts = np.cumsum([0] + [len(r[1]) for r in rows])
    columns, values = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    owner = np.repeat(np.arange(len(rows)), np.diff(starts))
    square, bias_square = np.full(len(weights), 1e-8), 1e-8
    for _ in range(training.epochs):
        margin = np.bincount(owner, values * weights[columns], len(rows)) + bias
        error = balance * (1 / (1 + np.exp(-margin)) - labels) / len(rows)
        gradient = np.bincount(columns, values * error[owner], len(weights)) + training.decay * weights
        square += gradient ** 2
        weights -= training.rate * gradient / np.sqrt(square)
        bias_square += error.sum() ** 2
        bias -= training.rate * error.sum() / np.sqrt(bias_square)
    return weights, bias


def _sample(docs: DataFrame, size: int) -> DataFrame:
    """text and _h of the ``size`` smallest hashes of id and text; rows that are equal in both count once."""
    hashed = docs.select("text", F.xxhash64("doc_id", "text").alias("_h"))
    hashes = stored(hashed.select("_h").distinct(), "sample-hashes")
    n = hashes.count()
    if n <= size:
        return hashed.dropDuplicates(["_h"])
    # twice as many as wanted, so that the sort below sees few rows
    few = stored(hashes.filter(F.col("_h") <= min((1 << 63) - 1, int(2 * size / n * (1 << 64)) - (1 << 63))), "sample-hashes")
    last = (few if few.count() >= size else hashes).orderBy("_h").limit(size).agg(F.max("_h").alias("h")).first()["h"]
    return hashed.filter(F.col("_h") <= last).dropDuplicates(["_h"])


def classify(docs: DataFrame, training: Training = Training(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, votes, weak_label, score and kept of every document.

    weak_label is the probability of a good document by the label model, score that of the linear
    scorer; kept asks both to be at least one half on average. Null and empty texts get the worst
    votes and no trigrams. Vote patterns (at most 3 to the number of labellers) are counted over
    all rows; an empty table gives no rows.
    """
    docs = id_text(docs, id_col, text_col)

    def patterns(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        counts = Counter(vote((t or "").encode()) for t in batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["votes", "n"])

    found = map_batches(docs, patterns, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    counts = {r["votes"]: r["n"] for r in found}
    if not counts:
        return docs.select("doc_id", F.lit("").alias("votes"), F.lit(0.0).alias("weak_label"), F.lit(0.0).alias("score"), F.lit(False).alias("kept"))
    model = fit_labels(counts)
    keys = sorted(counts)
    weak = dict(zip(keys, model.posterior(np.array([list(map(int, k)) for k in keys])).tolist()))
    sent = docs.sparkSession.sparkContext.broadcast(weak)

    def sampled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rows = [features(t, training.bits) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("_h"), pa.array([sent.value[vote(t.encode())] for t in texts], pa.float64()),
             pa.array([r[0].astype(np.int32) for r in rows], pa.list_(pa.int32())),
             pa.array([r[1].astype(np.float32) for r in rows], pa.list_(pa.float32()))], ["_h", "label", "buckets", "shares"])

    rows = map_batches(_sample(docs, training.sample), sampled, "_h long, label double, buckets array<int>, shares array<float>").toArrow().sort_by("_h")
    weights, bias = fit_scorer([(label, np.array(b, np.int64), np.array(s)) for label, b, s in
                                zip(*(rows[c].to_pylist() for c in ("label", "buckets", "shares")))], training)
    scorer = docs.sparkSession.sparkContext.broadcast((weights, bias))

    def scores(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        weights, bias = scorer.value
        votes, weaks, out = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            votes.append(vote(text.encode()))
            weaks.append(sent.value[votes[-1]])
            buckets, shares = features(text, training.bits)
            out.append(float(1 / (1 + np.exp(-np.clip(weights[buckets] @ shares + bias, -500, 500)))))
        kept = [w + s >= 1 for w, s in zip(weaks, out)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(votes, pa.string()), pa.array(weaks, pa.float64()), pa.array(out, pa.float64()), pa.array(kept, pa.bool_())],
            ["doc_id", "votes", "weak_label", "score", "kept"])

    return map_batches(docs, scores, "doc_id long, votes string, weak_label double, score double, kept boolean")
