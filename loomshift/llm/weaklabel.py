"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on each document. Expectation-maximisation over the counts of vote patterns
estimates how often each labeller is right and how often it votes, and gives each pattern a posterior. A linear scorer over
hashed features of the text is then fitted to these posteriors, so that it also judges what no labeller votes on.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut

#: Documents that the scorer is fitted on at most, and the hashed features.
FIT_ROWS, BUCKETS = 20_000, 4096
GOOD, BAD, NONE = 1, 0, 2
MARKED = re.compile(r"[#*$%&<>]{2}(?![#*$%&<>])")


def statistics(text: str | None) -> dict[str, float]:
    """Ratios that labellers and features are made of; all zero for a text without words."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    if not n:
        return dict.fromkeys(("words", "upper", "symbols", "marked", "bars", "shouts", "variety", "top", "stutter", "ends", "length"), 0.0)
    chars = sum(map(len, words))
    counts = Counter(words)
    return {
        "words": float(n),
        "upper": sum(map(str.isupper, words)) / n,
        "symbols": sum(map(text.count, "#*$%&<>")) / chars,
        "marked": len(MARKED.findall(text)) / n,
        "bars": text.count("|") / n,
        "shouts": (text.count("!") + text.count("?")) / n,
        "variety": len(counts) / n,
        "top": max(counts.values()) / n,
        "stutter": sum(map(eq, words, words[1:])) / n,
        "ends": sum(text.count(c) for c in ".:;") / n,
        "length": chars / n,
    }


def votes(s: dict[str, float]) -> tuple[int, ...]:
    """The labellers' votes, in fixed order: eight that only object and two that only approve; all may abstain."""
    n = s["words"]

    def bad(told: bool, least: int) -> int:
        return BAD if n >= least and told else NONE

    return (
        bad(s["upper"] >= 0.3, 5),
        bad(s["shouts"] >= 0.3, 5),
        bad(s["symbols"] >= 0.05, 3),
        bad(s["marked"] >= 0.2, 3),
        bad(s["bars"] >= 0.2, 5),
        bad(s["top"] >= 0.25, 30),
        bad(s["variety"] <= 0.2, 40),
        bad(s["stutter"] >= 0.15, 10),
        GOOD if n >= 10 and s["ends"] >= 0.02 and s["variety"] >= 0.4 else NONE,
        GOOD if n and 2 <= s["length"] <= 12 and s["upper"] < 0.1 and s["symbols"] < 0.01 else NONE,
    )


N_LABELLERS = 10


@dataclass
class LabelModel:
    prior: float
    table: np.ndarray  # labeller, true class, vote: probability
    patterns: dict[int, float]  # posterior of being good

    def accuracies(self) -> np.ndarray:
        """How often each labeller's vote is right when it votes."""
        p = np.array([1 - self.prior, self.prior])
        right = sum(p[c] * self.table[:, c, c] for c in (0, 1))
        return right / np.maximum(1e-12, sum(p[c] * self.table[:, c, :2].sum(axis=1) for c in (0, 1)))


def pattern_votes(pattern: int) -> list[int]:
    return [pattern // 3**k % 3 for k in range(N_LABELLERS)]


def fit_labels(counts: dict[int, int], rounds: int = 100) -> LabelModel:
    """Expectation-maximisation over all documents' vote patterns (at most 3^labellers of them)."""
    patterns = sorted(counts)
    if not patterns:
        return LabelModel(0.5, np.full((N_LABELLERS, 2, 3), 1 / 3), {})
    v = np.array([pattern_votes(p) for p in patterns])
    n = np.array([counts[p] for p in patterns], float)
    good = np.where((v == BAD).any(axis=1), 0.05, 0.95)  # an objection starts as bad
    for _ in range(rounds):
        weight = np.stack((n * (1 - good), n * good))  # class, pattern
        prior = (weight[1].sum() + 1) / (n.sum() + 2)
        table = np.stack([np.stack([(weight * (v[:, k] == x)).sum(axis=1) for x in range(3)], axis=1) for k in range(N_LABELLERS)])
        table = (table + 0.5) / (table.sum(axis=2, keepdims=True) + 1.5)
        log = np.log(np.array([1 - prior, prior]))[:, None] + sum(np.log(table[k][:, v[:, k]]) for k in range(N_LABELLERS))
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return LabelModel(float(prior), table, dict(zip(patterns, good.tolist())))


def _bucket(name: str) -> int:
    return xxhash.xxh32_intdigest(name) % BUCKETS


def _levels(s: dict[str, float]) -> dict[int, float]:
    out = {_bucket("bias"): 1.0}
    for name, value in s.items():
        level = int(np.log2(1 + value) * 2) if name == "words" else min(20, int(value * 20 + 0.5)) if name != "length" else min(20, int(value))
        out[_bucket(f"{name}={level}")] = 1.0
        out[_bucket(name)] = out.get(_bucket(name), 0.0) + (min(value, 2.0) if name not in ("words", "length") else min(3.0, np.log1p(value) / 3))
    return out


def features(text: str | None, s: dict[str, float] | None = None) -> dict[int, float]:
    """Hashed features: the ratios, in steps and as they are, and the shares of pairs of character kinds."""
    s = s or statistics(text)
    out = _levels(s)
    kinds = re.sub(r"[^\W\d_a-zA-Z]", "l", (text or "").translate(KINDS))
    total = max(1, len(kinds) - 1)
    for pair in PAIRS:
        share = kinds.count(pair) / total
        if share:
            b = _bucket("kinds " + pair)
            out[b] = out.get(b, 0.0) + min(2.0, 4 * share)
    return out


#: What each kind of character is written as.
KINDS = str.maketrans({**{c: "l" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "U" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}, **{c: "0" for c in "0123456789"}, "\t": " ", "\r": " ", "!": "!", "?": "!", **{c: "#" for c in "#*$%&<>~^=+@|"}})
PAIRS = ["ll", "lU", "l ", "UU", "Ul", "U ", "U!", "l!", "!!", "! ", "l#", "##", "# ", " #", " U", " l", ". ", ".\n", "l.", "l,", ", ", "00", "l0", "\n\n", "  "]


def fit_scorer(rows: list[dict[int, float]], target: np.ndarray, steps: int = 300, l2: float = 1e-4) -> np.ndarray:
    """Logistic weights for soft labels, by Adam over all rows."""
    weights = np.zeros(BUCKETS)
    if not rows:
        return weights
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column, value = np.array([i for r in rows for i in r], np.int64), np.array([x for r in rows for x in r.values()])
    first, second = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row_of, value * weights[column], minlength=len(rows)), -50, 50)))
        grad = np.bincount(column, value * ((target - p) / len(rows))[row_of], minlength=BUCKETS) - l2 * weights
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        weights = weights + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return weights


def train(docs: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[LabelModel, np.ndarray]:
    """The label model over all documents, and the scorer's weights.

    The scorer is fitted on at most ``fit_rows`` documents, those with the smallest hash of id and text, each labelled by
    its pattern's posterior. Repeated rows count once in that sample. Null texts count as empty, null ids like any other; an
    empty table gives a model that knows nothing. Other columns are ignored.
    """
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def vote(batches):
        for batch in batches:
            found: dict[int, int] = {}
            for text in batch.column("text").to_pylist():
                pattern = sum(x * 3**k for k, x in enumerate(votes(statistics(text))))
                found[pattern] = found.get(pattern, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])

    counted = frame.select("text").mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    labels = fit_labels({r[0]: r[1] for r in counted.collect()})

    def describe(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                s = statistics(text)
                out.append((sum(x * 3**k for k, x in enumerate(votes(s))), features(text, s)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([list(f) for _, f in out], pa.list_(pa.int64())), pa.array([[float(x) for x in f.values()] for _, f in out], pa.list_(pa.float64()))], ["pattern", "at", "value"])

    # Equal rows have one key and count once, so the cut-off lets through exactly the sample however many repeats there are.
    key = F.xxhash64("doc_id", "text")
    few = frame.select(key.alias("key")).distinct().orderBy("key").limit(fit_rows).agg(F.max("key")).first()[0]
    sample = frame.select(key.alias("key"), "text").where(F.col("key") <= F.lit(few)) if few is not None else frame.select(key.alias("key"), "text").limit(0)
    sample = sample.groupBy("key").agg(F.first("text").alias("text")).select("text").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    rows = cut(sample.mapInArrow(describe, "pattern long, at array<long>, value array<double>")).collect()
    weights = fit_scorer([dict(zip(r["at"], r["value"])) for r in rows], np.array([labels.patterns.get(r["pattern"], labels.prior) for r in rows]))
    return labels, weights


def score(docs: DataFrame, labels: LabelModel, weights: np.ndarray, keep_at: float = 0.5) -> DataFrame:
    """(doc_id, posterior, score, kept): the label model's posterior, the scorer's probability, and whether that reaches keep_at.

    Null, empty and wordless texts score by the bias alone and the labeller of length; rows come back one for one.
    """
    model = docs.sparkSession.sparkContext.broadcast((labels, weights))

    def run(batches):
        label, w = model.value
        for batch in batches:
            posterior, found = [], []
            for text in batch.column("text").to_pylist():
                s = statistics(text)
                posterior.append(label.patterns.get(sum(x * 3**k for k, x in enumerate(votes(s))), label.prior))
                found.append(sum(w[i] * v for i, v in features(text, s).items()))
            p = 1 / (1 + np.exp(-np.clip(np.array(found, float), -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(posterior, pa.float64()), pa.array(p), pa.array(p >= keep_at)], ["doc_id", "posterior", "score", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, posterior double, score double, kept boolean")
