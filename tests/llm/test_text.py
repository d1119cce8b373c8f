import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomshift.llm import mixing, pii, quality, tokenbin, toxicity, weaklabel
from loomshift.llm.pieces import PieceCodec, encode_pieces, load_model, piece_digests

EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "no id"), (5, "é😀 ▁ mixed\r\n text  with   runs"), (6, "long " * 20000)]


def path(name):
    return pytest.importorskip("public_tokenizers").path(name)


def test_pieces_equal_the_library(spark, docs):
    import sentencepiece

    model = path("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=model), PieceCodec(load_model(model))
    pick, chars = random.Random(1), "abtheing   ▁\n\t\x00éж中😀한.,!0123<s>"
    texts = ["".join(pick.choice(chars) for _ in range(pick.randint(0, 40))) for _ in range(5000)] + [" " * n for n in range(60)] + ["a" * 5000]
    for text in texts:
        ids = library.encode(text)
        assert codec.encode(text) == ids and codec.decode(ids) == library.decode(ids)
    for _ in range(3000):
        ids = [pick.choice([pick.randrange(32000), pick.randrange(3, 259)]) for _ in range(pick.randint(1, 6))]
        assert codec.decode(ids) == library.decode(ids)
    found = Counter(tuple(r) for r in piece_digests(docs(EDGES), model).collect())
    wanted = Counter()
    for d, t in EDGES:
        ids = library.encode(t or "")
        wanted[d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()] += 1
    assert found == wanted
    out = encode_pieces(docs(EDGES), model)
    assert out.columns == ["doc_id", "lang", "source", "ids", "decoded"] and out.count() == len(EDGES) and encode_pieces(docs([]), model).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(0, 400))
        ids = rng.integers(0, 2**63, n, dtype=np.uint64) * 2 + 1 >> rng.integers(0, 64, n).astype(np.uint64)
        assert (tokenbin.unpack(tokenbin.pack(ids), n) == ids).all()
    assert len(tokenbin.pack(np.zeros(60, np.uint64))) == 1


def test_token_files_hold_what_the_library_gives(spark, docs):
    from tokenizers import Tokenizer

    model = path("word_bpe_49k.json")
    library = Tokenizer.from_file(model)
    rows = [(9 - k, t) for k, (_, t) in enumerate(EDGES)] + [(None, "last"), (20, "It's <|endoftext|> über-STRASSE 42nd, don't!")]
    found = sorted((tuple(r) for r in tokenbin.token_binary(docs(rows), model).collect()), key=lambda r: r[1])
    at, wanted = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        wanted.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert found == wanted and tokenbin.token_binary(docs([]), model).count() == 0


def test_pii_base_and_added_spans(spark, docs):
    field = pii.trained()
    text = "call 4111111111111111 4111111111111111 or a.b@c.de, 1.2.3.400 and 10.0.0.1, +1 (212) 555-0123."
    base, more = pii.all_spans(text, field)
    assert pii.listed(base) == "email:42:50,ip:66:74,phone:76:93"
    assert [text[a:b] for a, b in more["card"]] == ["4111111111111111"] * 2
    assert pii.redacted(text, more).count("[CARD]") == 2
    found = pii.find_pii(docs(EDGES)).collect()
    assert len(found) == len(EDGES) and all(r["spans"] == "" for r in found) and pii.find_pii(docs([])).count() == 0
    right = sum({(a, b, k) for k, v in pii.field_spans(t, field).items() for a, b in v} == set(s) for t, s in pii.made_windows(400, 99))
    assert right >= 380


def test_pii_windows_hold_long_runs_whole():
    field = pii.trained()
    for kind, parts, sep in (("email", [f"user{c} (at) host{c} (dot) com" for c in "abcdefghij" * 3], ", "), ("phone", ["555-123-4567"] * 60, " "), ("phone", ["212 - 555 - 0123"], ""), ("email", ["christopher.alexander.montgomery.featherstone (at) host (dot) com"], "")):
        text = "reach " + sep.join(parts)
        assert [text[a:b] for a, b in pii.field_spans(text, field)[kind]] == parts
    tokens = pii.TOKEN.findall(text)
    assert pii.windows(text) == [(0, len(text))] and list(field.segments_by_end(tokens, "")) == field.segments(tokens, "")


def test_quality_base_against_brute_force(spark, docs):
    pick = random.Random(8)
    rows = EDGES + [(100 + k, "\n".join(" ".join(pick.choice("a b c d e f g# h|".split()) for _ in range(pick.randint(0, 9))) for _ in range(pick.randint(1, 8)))) for k in range(60)]
    found = quality.quality_rules(docs(rows)).collect()
    assert len(found) == len(rows) and quality.quality_rules(docs([])).count() == 0
    by = {}
    for d, t in rows:
        words, lines = quality.WORD.findall(t or ""), [x for x in (t or "").split("\n") if quality.WORD.search(x)]
        grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        often = Counter(grams)
        covered = {k + m for k, g in enumerate(grams) if often[g] > 1 for m in range(5)}
        by[d] = (len(words), sum(map(len, words)), sum(c in quality.SYMBOLS for c in t or ""), len(lines) - len(set(lines)), len(covered))
    assert all(tuple(r)[1:6] == by[r["doc_id"]] and not (r["base_failed"] and r["kept"]) for r in found)
    assert quality.jensen_shannon({"a": 1}, {"b": 1}) == 1 and quality.jensen_shannon({"a": 2}, {"a": 9}) == 0


def test_mixture_meets_its_weights(spark, docs):
    rows = [(k, "w " * (k % 7 + 1), "s", "big" if k % 3 else f"small{k % 5}", "x") for k in range(3000)] + [(9000, None, "s", None, "x"), (9001, "", "s", "big", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_copy string")
    out = mixing.mixture(df, entropy_gain=0.5, max_repeats=50, block_tokens=1000).cache()
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r[0] for r in rows}
    total = out.agg(F.sum("mix_tokens")).first()[0]
    for r in out.groupBy("source").agg(F.sum("mix_tokens").alias("n"), F.max("mix_weight").alias("w")).where("source is not null").collect():
        assert abs(r["n"] / total - r["w"]) < 0.01
    first = out.where("mix_block = 3").groupBy("source").agg(F.sum("mix_tokens").alias("n"), F.max("mix_weight").alias("w")).collect()
    assert all(abs(r["n"] - 1000 * r["w"]) <= 8 for r in first)
    shares = {r["source"]: r["w"] for r in out.where("mix_tokens > 0").groupBy("source").agg(F.max("mix_weight").alias("w")).collect()}
    token = Counter()
    for _, t, _, s, _ in rows:
        token[s] += len((t or "").split())
    p = {s: n / sum(token.values()) for s, n in token.items() if n}
    entropy = lambda q: -sum(x * np.log(x) for x in q.values())
    assert abs(entropy(shares) - (entropy(p) + 0.5 * (np.log(len(p)) - entropy(p)))) < 1e-6
    assert mixing.mixture(docs([])).count() == 0 and mixing.mixture(docs([(1, "a")])).count() == 1


def test_repetition_limit_and_ordinary_token_counts(spark, docs):
    rows = [(k, "w w", "s", "big" if k else "rare", "x") for k in range(200)]
    out = mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, y string"), entropy_gain=1.0, max_repeats=3.0)
    assert out.where("source = 'rare'").count() == 3
    got = docs([(1, " a  b\tc\n"), (2, None), (3, "\n"), (4, "x")]).select("doc_id", mixing.token_count(F.col("text")).alias("n")).collect()
    assert {r[0]: r[1] for r in got} == {1: 3, 2: 0, 3: 0, 4: 1}


def test_ordinal_regression(spark, docs):
    rng = np.random.default_rng(3)
    rows = [{0: float(x)} for x in rng.normal(size=2000)]
    grades = np.array([int(np.searchsorted([-1.0, 0.0, 1.0], 2 * r[0] + rng.logistic())) for r in rows])
    w, thresholds = toxicity.fit_ordinal(rows, grades, 1, 3)
    assert abs(w[0] - 2) < 0.3 and np.abs(thresholds - [-1, 0, 1]).max() < 0.3
    bad = ["moron", "scum", "idiot"]
    pick = random.Random(9)
    text = lambda toxic: " ".join(pick.choice([f"w{k}" for k in range(40)]) for _ in range(30)) + (" " + " ".join(pick.choice(bad) for _ in range(3)) if toxic else "")
    corpus = docs([(k, text(k % 8 == 0)) for k in range(600)] + EDGES[:3] + [(None, "no id")])
    labels = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(300)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.train(corpus, labels)
    found = toxicity.score(corpus, model)
    held = [(r["toxic"], r["doc_id"] % 8 == 0) for r in found.where("doc_id >= 300").collect()]
    assert sum(a == b for a, b in held) >= 0.98 * len(held) and found.count() == 604
    assert toxicity.drop_toxic(corpus, model).columns == corpus.columns
    none = toxicity.train(corpus, labels.limit(0))
    assert not toxicity.score(corpus, none).where("toxic").count()


def test_weak_labels(spark, docs):
    pick = random.Random(10)
    good = lambda: " ".join(" ".join(pick.choice([f"word{k}" for k in range(200)]) for _ in range(8)) + "." for _ in range(6))
    spoil = [lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "*** "), lambda t: t.replace(" ", " | "), lambda t: "same " * 60]
    rows = [(k, spoil[k % 4](good()) if k % 5 == 0 else good()) for k in range(800)] + EDGES
    corpus = docs(rows)
    labels, weights = weaklabel.train(corpus)
    assert (labels.accuracies()[:4] > 0.9).all()
    found = weaklabel.score(corpus, labels, weights).collect()
    held = [(r["kept"], r["doc_id"] % 5 != 0) for r in found if r["doc_id"] is not None and r["doc_id"] >= 20]
    assert len(found) == len(rows) and sum(a == b for a, b in held) >= 0.98 * len(held)
    assert weaklabel.score(docs([]), *weaklabel.train(docs([]))).count() == 0
