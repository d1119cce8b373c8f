"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

One weight vector serves all ordered thresholds: P(grade >= k) = sigmoid(w.x - threshold_k). The result is the expected
severity, the sum of these probabilities.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import cut, numbered, renamed

LETTERS = re.compile(r"[^\W\d_]+")
#: Labelled documents that the weights are fitted on at most; features at most; words a worker keeps; features a task
#: counts before it passes them on.
FIT_ROWS, MAX_FEATURES, KEPT_WORDS, KEPT_COUNTS = 20_000, 4096, 300_000, 400_000
GRADES = 3
STEMS = (4, 5, 6)


def word_features(word: str) -> list[str]:
    """The word and its stems of fixed lengths; a stem ends with a mark that no word has."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class _Known(dict):
    """word -> numbers of its selected features."""

    def __init__(self, index: dict[str, int]):
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.index[f] for f in word_features(word) if f in self.index)
        if len(self) >= KEPT_WORDS:
            self.clear()
        if len(word) <= 40:
            self[word] = found
        return found


def sparse_row(text: str | None, known: _Known) -> tuple[dict[int, float], int]:
    """(feature -> 1 for each feature present, how many words bear a feature)."""
    words = LETTERS.findall((text or "").lower())
    hits = [f for f in map(known.__getitem__, words) if f]
    return dict.fromkeys((i for f in hits for i in f), 1.0), len(hits)


@dataclass
class OrdinalModel:
    features: list[str]
    weights: np.ndarray
    thresholds: np.ndarray
    grades: int

    def scores(self, rows: list[dict[int, float]]) -> np.ndarray:
        return np.array([sum(self.weights[i] * v for i, v in r.items()) for r in rows])

    def at_least(self, rows: list[dict[int, float]]) -> np.ndarray:
        """P(grade >= k) for k = 1.., a column each."""
        return 1 / (1 + np.exp(-np.clip(self.scores(rows)[:, None] - self.thresholds[None, :], -50, 50)))


def fit_ordinal(rows: list[dict[int, float]], grades: np.ndarray, n_columns: int, levels: int, steps: int = 400, l2: float = 2e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the penalised likelihood, by Adam over all rows."""
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([i for r in rows for i in r], np.int64)
    value = np.array([v for r in rows for v in r.values()])
    weights = np.zeros(n_columns)
    # thresholds = first + running sum of positive gaps, so that they stay in order
    raw = np.concatenate(([1.0], np.full(levels - 1, 0.0)))
    target = np.asarray(grades)
    moments = [np.zeros(n_columns + levels) for _ in range(2)]
    for step in range(1, steps + 1):
        gaps = np.exp(raw[1:])
        thresholds = raw[0] + np.concatenate(([0.0], np.cumsum(gaps)))
        score = np.bincount(row_of, value * weights[column], minlength=len(rows)) if len(column) else np.zeros(len(rows))
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds[None, :], -50, 50)))
        full = np.hstack((np.ones((len(rows), 1)), above, np.zeros((len(rows), 1))))
        at = np.arange(len(rows))
        p = np.maximum(full[at, target] - full[at, target + 1], 1e-12)
        slope = np.hstack((np.zeros((len(rows), 1)), above * (1 - above), np.zeros((len(rows), 1))))
        up, down = slope[at, target] / p, slope[at, target + 1] / p  # of the thresholds below and above the grade
        to_score = (up - down) / len(rows)
        to_threshold = np.zeros(levels)
        np.add.at(to_threshold, target[target > 0] - 1, -up[target > 0] / len(rows))
        np.add.at(to_threshold, target[target < levels], down[target < levels] / len(rows))
        grad_w = (np.bincount(column, value * to_score[row_of], minlength=n_columns) if len(column) else np.zeros(n_columns)) - l2 * weights
        grad_raw = np.concatenate(([to_threshold.sum()], [to_threshold[k + 1 :].sum() * gaps[k] for k in range(levels - 1)]))
        grad = np.concatenate((grad_w, grad_raw))
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad * grad
        move = 0.1 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights, raw = weights + move[:n_columns], raw + move[n_columns:]
    return weights, raw[0] + np.concatenate(([0.0], np.cumsum(np.exp(raw[1:]))))


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(id, text, toxic) of labelled documents; of contrary labels the highest counts.

    The labels are those ``rows`` with the smallest hash of their id, so they are broadcast and no text is shuffled.
    """
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).alias("toxic"))
    few = cut(marks.orderBy(F.xxhash64("id"), "id").limit(rows))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "id")


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, max_features: int = MAX_FEATURES, min_support: int = 3) -> OrdinalModel:
    """Fit on at most ``fit_rows`` labelled documents, those with the smallest hash of their id.

    Features are words and stems that toxic documents have significantly more often.
    Toxic documents are graded 1 to 3 by how many of their words bear such a feature, in terciles; others are 0. The
    features say which of these words there are, not how many.
    Without labels of both kinds the model has no features and calls nothing toxic. Null ids and labels do not count, null
    texts count as empty, and other columns are ignored.
    """
    marked = labelled(docs, labels, fit_rows)

    def count(batches):
        counts: tuple[Counter, Counter] = Counter(), Counter()

        def flush():
            names = list(counts[0].keys() | counts[1].keys())
            for k in range(0, len(names), 20000):
                part = names[k : k + 20000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([counts[1][x] for x in part], pa.int64()), pa.array([counts[0][x] for x in part], pa.int64())], ["feature", "toxic", "clean"])
            for c in counts:
                c.clear()

        for batch in batches:
            n = [0, 0]
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = set(LETTERS.findall((text or "").lower()))
                counts[toxic].update({f for w in words for f in word_features(w)})
                n[toxic] += 1
                if len(counts[0]) + len(counts[1]) > KEPT_COUNTS:
                    yield from flush()
            counts[1][""] += n[1]
            counts[0][""] += n[0]
        yield from flush()

    seen = marked.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where(f"toxic >= {int(min_support)} or feature = ''")
    seen = cut(seen)
    total = {r[0]: (r[1], r[2]) for r in seen.where("feature = ''").collect()}.get("", (0, 0))
    tried = max(1, seen.count() - 1)
    share = total[0] / max(1, sum(total))
    if not 0 < share < 1:
        return OrdinalModel([], np.zeros(1), np.arange(1, GRADES + 1) * 10.0, GRADES)
    # Twice the log-likelihood that the feature marks toxic documents over that it does not; the bar rises with the number tried.
    part = lambda c, rate: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / ((F.col("toxic") + F.col("clean")) * rate))).otherwise(0.0)
    gain = F.round(2 * (part("toxic", share) + part("clean", 1 - share)), 6)
    lift = (F.col("toxic") / total[0]) / ((F.col("clean") + 0.5) / total[1])
    best = seen.where("feature <> ''").select("feature", gain.alias("gain"), lift.alias("lift")).where((F.col("gain") >= 6 + 2 * math.log(tried)) & (F.col("lift") >= 30)).orderBy(F.desc("gain"), "feature").limit(max_features)
    features = [r[0] for r in best.collect()]
    index = {f: i for i, f in enumerate(features)}
    width = len(features)

    def rows_of(batches):
        known = _Known(index)
        for batch in batches:
            found = [sparse_row(x, known) for x in batch.column("text").to_pylist()]
            columns = [pa.array([list(r) for r, _ in found], pa.list_(pa.int64())), pa.array([list(r.values()) for r, _ in found], pa.list_(pa.float64())), pa.array([x for _, x in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), *columns], ["id", "toxic", "at", "value", "hits"])

    few = marked.mapInArrow(rows_of, "id long, toxic boolean, at array<long>, value array<double>, hits long").orderBy(F.xxhash64("id"), "id").limit(fit_rows).collect()
    rows = [dict(zip(r["at"], r["value"])) for r in few]
    toxic = np.array([r["toxic"] for r in few], bool)
    if not width or not toxic.any():
        return OrdinalModel([], np.zeros(1), np.arange(1, GRADES + 1) * 10.0, GRADES)
    hits = np.array([r["hits"] for r in few])
    borders = np.quantile(hits[toxic], [1 / 3, 2 / 3])
    grades = np.where(toxic, 1 + np.searchsorted(borders, hits, side="left"), 0)
    weights, thresholds = fit_ordinal(rows, grades, width, GRADES)
    return OrdinalModel(features, weights, thresholds, GRADES)


def score(docs: DataFrame, model: OrdinalModel, reject_at: float = 0.5) -> DataFrame:
    """docs with p_toxic, expected_severity, grade and toxic in place of columns of those names; their text is the last but these.

    Null, empty and wordless texts bear no feature and get the scores of the intercept. Rows come back one for one.
    """
    added = ("p_toxic", "expected_severity", "grade", "toxic")
    others = [c for c in docs.columns if c.lower() not in added]
    frame = numbered(docs, others, F.col("text").cast("string").alias("words"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        known = _Known({f: i for i, f in enumerate(m.features)})
        for batch in batches:
            rows = [sparse_row(t, known)[0] for t in batch.column(batch.num_columns - 1).to_pylist()]
            above = m.at_least(rows)
            p = above[:, 0] if len(rows) else np.zeros(0)
            columns = [pa.array(p), pa.array(above.sum(axis=1)), pa.array((above >= reject_at).sum(axis=1), pa.int32()), pa.array(p >= reject_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], *added])

    schema = StructType(frame.schema.fields[:-1]).add("p_toxic", "double").add("expected_severity", "double").add("grade", "integer").add("toxic", "boolean")
    return renamed(frame.mapInArrow(run, schema), others, *added)


def drop_toxic(docs: DataFrame, model: OrdinalModel, reject_at: float = 0.5) -> DataFrame:
    """The rows of docs, as they are, whose P(grade >= 1) is under reject_at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = [c.lower() for c in docs.columns].index("text")

    def run(batches):
        m = shared.value
        known = _Known({f: i for i, f in enumerate(m.features)})
        for batch in batches:
            rows = [sparse_row(t, known)[0] for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(m.at_least(rows)[:, 0] < reject_at)) if rows else batch

    frame = numbered(docs, docs.columns)
    return renamed(frame.mapInArrow(run, frame.schema), docs.columns)
