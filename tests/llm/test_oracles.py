"""Queries against their SQL, and operators against plain versions of what they promise."""

import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomshift.llm import embeddings, pii, quality, queries, weaklabel

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    result = con.execute(queries.SQL[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == columns
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[order.index(c)] for c in columns) for r in result.fetchall())


def test_many_pivots_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 40)
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(25, 6))
    vectors = [(centres[k % 25] + rng.normal(size=6) * 0.2).tolist() for k in range(400)] + [centres[0].tolist()] * 60
    rows = list(enumerate(vectors))
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embeddings.embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    m = np.array(vectors)
    m = m / np.linalg.norm(m, axis=1)[:, None]
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    top = np.arange(len(rows))
    while True:
        low = np.minimum(top, np.where(near, top[None, :], len(rows)).min(axis=1))
        if (low == top).all():
            break
        top = low
    assert found == {k: (int(near[k].sum()), int(top[k]), bool(top[k] == k)) for k in range(len(rows))}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    """The base of the contract, word for word."""
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    }
    return ",".join(f"{kind}:{m.start()}:{m.end()}" for kind, (pattern, ok) in rules.items() for m in re.finditer(pattern, text) if ok(m[0]))


def test_base_spans_of_odd_texts():
    field, pick = pii.trained(), random.Random(12)
    parts = ["4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "256.1.1.1", "a@b.c", "x.y+z@mail-1.example.org", "+1 (212) 555-0123", "+49", "12", ".", "-", " ", "@", "+", "é", "\n", "0", "(", ")", "999.1.2.3.4"]
    for _ in range(4000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 8)))
        base, more = pii.all_spans(text, field)
        assert pii.listed(base) == base_spans(text), text
        for kind, spans in base.items():
            assert set(spans) <= set(more[kind])


def distance(p, q):
    """Jensen-Shannon distance in bits, by entropies."""
    keys = sorted(set(p) | set(q))
    a, b = (np.array([h.get(k, 0) for k in keys], float) for h in (p, q))
    a, b = a / a.sum(), b / b.sum()
    entropy = lambda x: -sum(v * math.log2(v) for v in x if v)
    return math.sqrt(max(0.0, entropy((a + b) / 2) - (entropy(a) + entropy(b)) / 2))


@pytest.mark.parametrize("together", [256, 1])
def test_quality_verdicts(spark, monkeypatch, together):
    monkeypatch.setattr(quality, "TOGETHER", together)
    pick = random.Random(13)
    words = {"en": [f"en{k}" for k in range(60)], "de": [f"de{k}" for k in range(60)], None: [f"no{k}" for k in range(60)]}
    rows = []
    for k in range(150):
        lang = pick.choice(["en", "de", None])
        text = " ".join(pick.choice(words[lang]) for _ in range(pick.choice([8, 30, 50, 90])))
        if k % 10 == 0:
            text = " ".join(pick.choice(words["de" if lang == "en" else "en"]) for _ in range(90))
        if k % 10 == 1:
            text = text.upper().replace(" ", "!! ")
        rows.append((k, text, lang))
    kinds, common = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang in rows:
        found = quality.WORD.findall(text)
        kinds[lang].update(quality.kind_counts(text, found))
        common[lang].update(w.lower() for w in found)
    for lang, c in common.items():
        total = sum(c.values())
        often = {w: n for w, n in c.items() if n >= total * quality.COMMON}
        common[lang] = {**often, "": total - sum(often.values())}
    wanted = {}
    for k, text, lang in rows:
        found = quality.WORD.findall(text)
        n, one = len(found), Counter(w.lower() for w in found)
        mine = {w: one[w] for w in one if w in common[lang]}
        mine[""] = n - sum(mine.values())
        a = distance(quality.kind_counts(text, found), kinds[lang]) if n >= quality.LEAST_KINDS else None
        b = distance(mine, common[lang]) if n >= quality.LEAST_COMMON else None
        wanted[k] = (n >= 10 and (a or 0) <= quality.MAX_KINDS and (b or 0) <= quality.MAX_COMMON, a, b)
    found = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert len(found) == len(rows) and {v[0] for v in wanted.values()} == {True, False}
    for r in found:
        kept, a, b = wanted[r["doc_id"]]
        assert r["kept"] == kept
        for have, want in ((r["kind_distance"], a), (r["word_distance"], b)):
            assert (have is None) == (want is None) and (want is None or abs(have - want) < 1e-6)


def test_repeats_of_very_long_texts(monkeypatch):
    pick = random.Random(14)
    for _ in range(60):
        text = " ".join(pick.choice("abcd") for _ in range(pick.randint(6, 200)))
        monkeypatch.setattr(quality, "LONG", 10**9)
        short = quality.base_counts(text)
        monkeypatch.setattr(quality, "LONG", 5)
        assert quality.base_counts(text) == short


def test_weak_label_sample_of_repeats(spark):
    rows = [(None, None)] * 300 + [(None, "same")] * 300 + [(k, f"text number {k} of its own kind.") for k in range(50)]
    labels, weights = weaklabel.train(spark.createDataFrame(rows, "doc_id long, text string"), fit_rows=20)
    assert np.isfinite(weights).all() and sum(labels.patterns.values()) > 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_verdicts_on_labelled_documents(spark):
    """Against the labels of sf0.01, which hold some noise of their own: quality by rules and by the label model."""
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for name, bad, good in (("op3_quality_rules", 0.95, 0.95), ("op5_weak_label_quality", 0.95, 0.95)):
        kept = {r["doc_id"]: r["kept"] for r in queries.QUERIES[name](spark, folder).select("doc_id", "kept").collect()}
        caught = [not kept[d] for d, q in labels.items() if q == 0]
        left = [kept[d] for d, q in labels.items() if q == 1]
        assert sum(caught) >= bad * len(caught) and sum(left) >= good * len(left)
