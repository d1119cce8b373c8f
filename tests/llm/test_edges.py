"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomshift.llm import linededup, mixing, pieces, pii, quality, simhash, tokenbin, toxicity, weaklabel

#: Names that an operator uses inside or adds, a dotted one, and one with a backtick.
NAMES = (
    "payload doc row key tie hi lo keep copy flags lines left line size first both odd word pos id begin total at fingerprint component_id "
    "__key __total __text __doc __lines __left __stays __keep_id __keep_rank a.b c`d mix_block mix_copy n_lines n_removed_lines p_toxic grade toxic ids decoded score kept"
).split()
LONG = "long line of words with ends\n" * 20_000 + "x" * 100_000
ROWS = [(None, None), (None, "no id"), (None, "no id"), (1, ""), (2, " \n\t "), (3, None), (4, "same text of a few words\nsame text of a few words"), (4, "same text of a few words\nsame text of a few words"), (4, "another text of that id"), (5, "same text of a few words"), (6, LONG), (7, "é😀 ▁ mixed\r\n \x00 text")]


def model(name):
    return pytest.importorskip("public_tokenizers").path(name)


def table(spark, rows):
    frame = spark.createDataFrame([(d, t, "en" if d != 7 else None, "s" if d != 5 else None) for d, t in rows], "doc_id long, text string, lang string, source string")
    return frame.select("*", *(F.lit(f"in {n}").alias(n) for n in NAMES))


def graded(docs):
    labels = docs.sparkSession.createDataFrame([(1, 0), (None, 1), (4, 1), (4, 0), (99, 1)], "doc_id long, toxic int")
    return toxicity.score(docs, toxicity.train(docs, labels))


#: What an operator gives, the columns it must keep as they are, and whether rows come back one for one.
OPERATORS = {
    "pii": (lambda d: pii.find_pii(d), (), True),
    "quality": (lambda d: quality.quality_rules(d), (), True),
    "mixing": (lambda d: mixing.mixture(d), [n for n in NAMES if not n.startswith("mix_")], False),
    "weak": (lambda d: weaklabel.score(d, *weaklabel.train(d)), (), True),
    "pieces": (lambda d: pieces.piece_digests(d, model("piece_bpe_32k.model")), (), True),
    "simhash": (lambda d: simhash.simhash_components(d), (), True),
    "lines": (lambda d: linededup.line_dedup(d), [n for n in NAMES if not n.startswith("n_")], True),
    "toxicity": (graded, [n for n in NAMES if n not in ("p_toxic", "grade", "toxic")], True),
    "tokens": (lambda d: tokenbin.token_binary(d, model("word_bpe_49k.json")), (), True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(spark, name):
    operator, kept, one_for_one = OPERATORS[name]
    docs = table(spark, ROWS)
    out = operator(docs)
    assert set(kept) <= set(out.columns)
    rows = out.collect()
    wanted = Counter(d for d, _ in ROWS)
    found = Counter(r["doc_id"] for r in rows)
    assert found == wanted if one_for_one else set(found) == set(wanted) and all(found[d] >= n for d, n in wanted.items())
    assert all(r[c] == f"in {c}" for r in rows for c in kept)
    empty = operator(docs.limit(0))
    assert empty.count() == 0 and empty.dtypes == out.dtypes


def test_one_row_of_a_component_stays(spark):
    docs = table(spark, ROWS + [(8, "same text of a few words")])
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sum(d is None for d, _ in found) == 3 and not [d for d, _ in found if d == 8]
    prints = {}
    for d, t in found:
        if d is not None:
            prints.setdefault(simhash.fingerprint(t), []).append(d)
    assert all(len(ids) == 1 for ids in prints.values())
    rows = [(1, "a b c d"), (2, "a b c d"), (2, "quite another text here")]
    assert sorted(tuple(r)[:2] for r in simhash.simhash_dedup(table(spark, rows)).collect()) == [rows[0], rows[2]]
    assert simhash.simhash_dedup(docs.limit(0)).count() == 0


def test_lines_of_repeated_ids_and_rows(spark):
    rows = [(1, "one two three\nfour five six"), (1, "one two three\nseven eight nine"), (1, "one two three\nfour five six"), (2, "\nfour five six\n")]
    found = Counter(r["text"] for r in linededup.line_dedup(table(spark, rows)).collect())
    assert found["\n"] == 1 and found[""] == 1 and sum(found.values()) == 4
    lines = Counter(x for t in found.elements() for x in t.split("\n") if x)
    assert lines == {"one two three": 1, "four five six": 1, "seven eight nine": 1}


def test_a_document_of_many_lines(spark):
    text = "\n".join(f"line number {k} of many with the word w{k} at its end" for k in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_lines"], r["n_removed_lines"]) for r in linededup.line_dedup(docs, threshold=0.9).collect()}
    assert found == {1: (40_000, 0), 2: (40_000, 40_000)}


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES if s[0] != "sentencepiece"], ids=lambda s: s[0])
def test_stages_keep_columns(spark, tmp_path, stage):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table(spark, ROWS).withColumn("n_chars", F.length("text").cast("long"))
    out = stage[1](spark, docs, str(tmp_path))
    assert out.columns == docs.columns and out.count() >= 8
    assert stage[1](spark, docs.limit(0), str(tmp_path)).count() == 0
