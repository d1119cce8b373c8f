"""Quality rules: how far a document's character kinds and common words are from its language's.

Each language's reference is its own documents' histogram over the whole corpus. A document is compared by Jensen-Shannon
distance, with guards for texts too short to judge.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: A word is common if it makes up this share of its language's words, so a language has at most a thousand.
COMMON = 0.001
#: Words that a language needs to be a reference; languages of which the references go to the tasks together; words a task
#: counts before it passes them on; words beyond which windows are compared as numbers.
LEAST_REFERENCE, TOGETHER, KEPT_COUNTS, LONG = 500, 256, 400_000, 50_000
#: Words that a document needs for either comparison, and the distances (0 to 1) beyond which it is rejected.
LEAST_KINDS, LEAST_COMMON, MAX_KINDS, MAX_COMMON = 40, 60, 0.3, 0.44
KINDS = ("lower", "upper", "digit", "blank", "stop", "shout", "symbol", "other", "mark")


def kind_counts(text: str, words: list[str]) -> dict[str, int]:
    """Characters by kind; other kinds of letters than a-z and A-Z are told apart by case."""
    found = Counter(text)
    out = dict.fromkeys(KINDS, 0)
    for c, n in found.items():
        if c.islower():
            kind = "lower"
        elif c.isupper():
            kind = "upper"
        elif c.isdigit():
            kind = "digit"
        elif c.isspace():
            kind = "blank"
        elif c in ".,;:'\"()-":
            kind = "stop"
        elif c in "!?":
            kind = "shout"
        elif c in SYMBOLS:
            kind = "symbol"
        elif c.isalpha():
            kind = "other"
        else:
            kind = "mark"
        out[kind] += n
    return out


def jensen_shannon(p: dict, q: dict) -> float:
    """Distance between two histograms in [0, 1]: the square root of the divergence in bits."""
    a, b = sum(p.values()), sum(q.values())
    if not a or not b:
        return 0.0
    total = 0.0
    for k in p.keys() | q.keys():
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0.0) + (y * math.log2(y / m) if y else 0.0)
    return math.sqrt(max(0.0, total / 2))


def base_counts(text: str | None) -> tuple[int, int, int, int, int, list[str]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, words) of a text."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    if len(words) > LONG:
        return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), long_repeats(words), words
    grams = list(zip(*(words[k:] for k in range(5))))
    repeated = 0
    if len(set(grams)) < len(grams):
        often, end = Counter(grams), 0
        for k, gram in enumerate(grams):
            if often[gram] > 1:
                repeated += k + 5 - max(k, end)
                end = k + 5
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, words


def long_repeats(words: list[str]) -> int:
    """Words in 5-word windows that come twice or more, with numbers in place of windows: 8 bytes a word and step."""
    numbers: dict[str, int] = {}
    one = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    pairs = lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)
    two = pairs(one[:-1], one[1:])
    four = pairs(two[:-2], two[2:])
    five = pairs(four[:-1], one[4:])
    often = np.flatnonzero(np.bincount(five)[five] > 1)
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, often, 1)
    np.add.at(covered, often + 5, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def common_counts(words: list[str], common: dict[str, float]) -> dict[str, int]:
    """Counts of the common words, and under "" of all others."""
    found = Counter(map(str.lower, words))
    out = {w: found[w] for w in found.keys() & common.keys()}
    out[""] = len(words) - sum(out.values())
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, key, n) over all documents: lower-cased words, and " words" and the kinds of characters after a blank."""

    def count(batches):
        held: dict[str, Counter] = {}

        def flush():
            names = [(lang, key) for lang, c in held.items() for key in c]
            for k in range(0, len(names), 20000):
                part = names[k : k + 20000]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.string()), pa.array([held[x[0]][x[1]] for x in part], pa.int64())], ["lang", "key", "n"])
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words = WORD.findall(text or "")
                c = held.setdefault(lang, Counter())
                c.update(map(str.lower, words))
                c[" words"] += len(words)
                for kind, n in kind_counts(text or "", words).items():
                    c[" " + kind] += n
                if sum(map(len, held.values())) > KEPT_COUNTS:
                    yield from flush()
        yield from flush()

    frame = docs.select(_language(docs).alias("lang"), F.col("text").cast("string").alias("text"))
    return cut(frame.mapInArrow(count, "lang string, key string, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).where("n > 0"))


def _between(first: str | None, last: str | None):
    """The languages from first up to but without last; null stands for no border."""
    after = F.lit(True) if first is None else F.col("lang") >= F.lit(first)
    return after if last is None else after & (F.col("lang") < F.lit(last))


def references(counts: DataFrame) -> list[tuple[str | None, str | None, dict]]:
    """(first, last, language -> (character kinds, common words)): ranges of languages with at most TOGETHER references.

    Languages of too few words have none. A reference has at most 1 / COMMON words, so each range is of a bounded size.
    """
    totals = counts.where("key = ' words'").select("lang", F.col("n").alias("all_words")).where(f"all_words >= {LEAST_REFERENCE}")
    names = sorted((r[0] for r in totals.select("lang").toLocalIterator()), key=lambda x: x.encode())
    borders = [None, *names[TOGETHER::TOGETHER], None]
    ranges = []
    for first, last in zip(borders, borders[1:]):
        met = counts.where(_between(first, last)).join(totals, "lang")
        out: dict[str, tuple[dict, dict]] = {}
        for lang, key, n, words in met.where((F.col("n") >= F.col("all_words") * COMMON) | F.col("key").startswith(" ")).collect():
            kinds, common = out.setdefault(lang, ({}, {"": words}))
            if key.startswith(" "):
                if key != " words":
                    kinds[key[1:]] = n
            else:
                common[key] = n
                common[""] -= n
        ranges.append((first, last, out))
    return ranges


def _language(docs: DataFrame):
    return F.coalesce(docs["lang"].cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")


def quality_rules(docs: DataFrame, max_kinds: float = MAX_KINDS, max_common: float = MAX_COMMON) -> DataFrame:
    """One row for each row of docs: doc_id, the base counts, base_failed, kept, and the two distances.

    base_failed: fewer than 10 words, or over 20 in 100 words within repeated 5-word windows. kept is false for these and
    for texts whose character kinds or common words are further from their language's reference than allowed. A distance
    is null, and does not reject, if the text has too few words for it or its language no reference. A null text counts as
    empty; a null or missing lang is a language of its own. Rows come back one for one; other columns are ignored. With more
    than TOGETHER languages, documents are judged range by range of their languages, each in a pass of its own. Texts may be
    of any length; an empty table gives an empty result.
    """
    frame = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _language(docs).alias("lang"), F.col("text").cast("string").alias("text"))
    passes = [_judged(frame.where(_between(first, last)), found, max_kinds, max_common) for first, last, found in references(word_counts(docs))]
    return reduce(DataFrame.union, passes)


def _judged(frame: DataFrame, references: dict, max_kinds: float, max_common: float) -> DataFrame:
    """quality_rules of frame (doc_id, lang, text), given the references of its languages."""
    known = frame.sparkSession.sparkContext.broadcast(references)
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kind_distance", "word_distance"]

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, lang, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "lang", "text"))):
                *base, words = base_counts(text)
                failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
                kinds = common = None
                if lang in known.value:
                    k_ref, c_ref = known.value[lang]
                    if base[0] >= LEAST_KINDS:
                        kinds = jensen_shannon(kind_counts(text, words), k_ref)
                    if base[0] >= LEAST_COMMON:
                        common = jensen_shannon(common_counts(words, c_ref), c_ref)
                kept = not failed and (kinds is None or kinds <= max_kinds) and (common is None or common <= max_common)
                rows.append((doc_id, *base, failed, kept, kinds, common))
            types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names)

    return frame.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kind_distance double, word_distance double")
