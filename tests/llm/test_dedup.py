import hashlib
import random
import re

import numpy as np

import corpus_pipeline
from loomshift.llm.components import connected_components
from loomshift.llm.embeddings import embedding_near_dedup
from loomshift.llm import linededup
from loomshift.llm.linededup import line_classes, line_dedup, rarity
from loomshift.llm.queries import QUERIES
from loomshift.llm.simhash import fingerprint, simhash_components, simhash_dedup


def roots(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    pick = random.Random(3)
    links = [(k, k + 1) for k in range(100, 130)] + [(1, k) for k in range(2, 40)] + [(pick.randint(200, 300), pick.randint(200, 300)) for _ in range(60)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == roots({x for link in links for x in link}, links)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_against_all_pairs(spark, docs):
    pick = random.Random(4)
    words = [f"w{k}" for k in range(50)]
    rows = [(None, "no id here at all"), (900, None), (901, ""), (902, " \t "), (903, "one"), (904, "ONE")]
    for k in range(40):
        text = [pick.choice(words) for _ in range(pick.choice([4, 60, 200]))]
        rows.append((k, " ".join(text)))
        text[pick.randrange(len(text))] = "changed"
        rows += [(100 + k, " ".join(text))] * 2
    found = simhash_components(docs(rows), radius=2).collect()
    assert len(found) == len(rows)
    prints = {d: fingerprint(t) for d, t in rows if d is not None}
    links = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2]
    wanted = roots(prints, links)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in found if r["doc_id"] is not None} == {(d, f"{prints[d]:016x}", wanted[d]) for d in prints}
    kept = simhash_dedup(docs(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "ids"]
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(d for d in prints if wanted[d] == d)
    assert simhash_components(docs([])).count() == 0


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 8))
    vectors = [v.tolist() for v in base] + [(v + rng.normal(size=8) * 0.15).tolist() for v in base[:40]] + [base[0].tolist()] * 5
    odd = [None, [], [0.0] * 8, [float("nan")] * 8, [1.0, None] + [0.0] * 6, [float("inf")] + [0.0] * 7, [1.0, 2.0], [2.0, 4.0]]
    rows = [(k, v) for k, v in enumerate(vectors + odd)]
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    ok = {k: np.array(v) for k, v in rows[: len(vectors)]} | {len(vectors) + 6: np.array([1.0, 2.0]), len(vectors) + 7: np.array([2.0, 4.0])}
    cosine = lambda a, b: len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.9
    links = [(a, b) for a in ok for b in ok if a < b and cosine(ok[a], ok[b])]
    wanted = roots(range(len(rows)), links)
    assert found == {k: (sum(k in link for link in links), wanted[k], wanted[k] == k) for k in range(len(rows))}
    assert embedding_near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_of_repeated_ids(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.99, 0.1, 0.0]), (1, [0.0, 0.0, 1.0]), (2, [1.0, 0.01, 0.0]), (3, [0.0, 0.1, 1.0]), (3, [0.0, 0.1, 1.0]), (4, [0.0, 1.0, 0.0]), (0, [0.0, 1.0, 0.01])]
    links = lambda k: [m for m in range(len(rows)) if m != k and np.dot(rows[k][1], rows[m][1]) >= 0.9 * np.linalg.norm(rows[k][1]) * np.linalg.norm(rows[m][1])]
    top = roots(range(len(rows)), [(k, m) for k in range(len(rows)) for m in links(k)])
    least = {t: min(rows[k][0] for k in top if top[k] == t) for t in top.values()}
    wanted = sorted((rows[k][0], len(links(k)), least[top[k]], rows[k][0] == least[top[k]]) for k in top)
    found = embedding_near_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted(tuple(r) for r in found) == wanted


def test_lines_against_all_pairs(spark, docs):
    pick = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    lines = [" ".join(pick.choice(words) for _ in range(pick.randint(1, 30))) for _ in range(60)]
    rows = []
    for d in range(40):
        text = []
        for _ in range(pick.randint(0, 8)):
            line = pick.choice(lines).split(" ")
            if pick.random() < 0.5:
                line[pick.randrange(len(line))] = pick.choice(words)
            text.append(" ".join(line))
        rows.append((d, "\n".join(text)))
    rows += [(100, None), (101, ""), (102, "a b\na b\n\n"), (None, lines[0])]
    found = {r["doc_id"]: r for r in line_dedup(docs(rows)).collect()}
    seen, wanted = [], {}
    for d, text in rows:
        if d is None or text is None:
            wanted[d] = text
            continue
        left = []
        for line in text.split("\n"):
            have = set(re.findall(r"[^\x20\x09-\x0D]+", line))
            if have:
                near = any(10 * len(have & s) >= 8 * len(have | s) for s in seen)
                seen.append(have)
                if near:
                    continue
            left.append(line)
        wanted[d] = "\n".join(left)
    assert {d: r["text"] for d, r in found.items()} == wanted
    assert sum(r["n_removed_lines"] for r in found.values()) == sum((t or "").count("\n") + 1 for d, t in rows if t is not None) - sum(r["n_lines"] - r["n_removed_lines"] for r in found.values() if r["text"] is not None)
    assert line_dedup(docs([])).count() == 0


def test_ranks_and_parities_of_lines_of_many_sizes(spark, docs):
    pick, words = random.Random(8), [f"w{k}" for k in range(4000)]
    lines = [[]]
    for size in [4, 55, 63, 64, 65, 73, 150] * 4:
        line = pick.sample(words, size)
        lines += [line, line[: -(size // 8) or None], line + pick.sample(words, size // 5), line[size // 6 :] + ["other"]]
    rows = [(d, "  ".join(line)) for d, line in enumerate(lines)]
    seen, left = [], {}
    for d, line in enumerate(map(set, lines)):
        near = any(10 * len(line & s) >= 8 * len(line | s) for s in seen if line)
        seen.append(line)
        left[d] = "" if near else rows[d][1]
    assert sum(t == "" for t in left.values()) > 40
    assert {r["doc_id"]: r["text"] for r in line_dedup(docs(rows)).collect()} == left
    able = docs(rows).selectExpr("doc_id doc", "xxhash64(text) row", "text")
    classes = line_classes(able, rarity(able), 0.8)
    assert not classes.schema["first"].dataType.containsNull  # else ranks are sorted as objects
    assert all(r["size"] == len(set(lines[r["doc"]])) for r in classes.collect())


def test_query_and_stage_settle_short_lines(spark, docs, tmp_path):
    rows = [(1, "Read more\nonly\n\nhttps://a.example/x"), (2, "more  Read\n \nonly only\nRead less"), (3, "https://a.example/x\n\u9019\u662f\u4e00\u53e5\u8a71\n\u9019\u662f\u4e00\u53e5\u8a71\nRead more now"), (4, "Read more\n")]
    wanted = {1: rows[0][1], 2: " \nRead less", 3: "\u9019\u662f\u4e00\u53e5\u8a71\nRead more now", 4: ""}
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["n_removed_lines"], r["text_sha256"]) for r in QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert found == {d: (t.count("\n") + 1 - len(wanted[d].split("\n")), hashlib.sha256(wanted[d].encode()).hexdigest()) for d, t in rows}
    assert {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs(rows), "").collect()} == wanted


def test_classes_left_and_settled_meet_in_one_shuffle(spark, docs, tmp_path):
    pick, words = random.Random(9), [f"w{k}" for k in range(3000)]
    lines = []
    for size in [5, 9, 30, 63, 64, 70] * 6:
        line = pick.sample(words, size)
        lines += [line, line[:-1] + ["other"], line[: -(size // 8) or None]]
    able = docs([(d, " ".join(line)) for d, line in enumerate(lines)]).selectExpr("doc_id doc", "xxhash64(text) row", "text")
    classes = line_classes(able, rarity(able), 0.8)
    classes.selectExpr("*", "doc id", "doc % 3 = 2 gone").write.parquet(f"{tmp_path}/classes")
    stored = spark.read.parquet(f"{tmp_path}/classes")
    assert all((r["odd"] == 0) == (r["size"] < linededup.LONG) for r in stored.collect())
    room = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(room)
    spark.conf.set(room, "-1")
    try:
        met = linededup.meeting(stored, 0.8)
        found = {frozenset(r) for r in met.collect()}
    finally:
        spark.conf.set(room, before)
    ids = sorted(r["id"] for r in stored.collect())  # of equal sets the first
    similar = {frozenset((a, b)) for a in ids for b in ids if b < a and 10 * len({*lines[a]} & {*lines[b]}) >= 8 * len({*lines[a]} | {*lines[b]})}
    gone = {d for d in range(len(lines)) if d % 3 == 2}
    assert {p for p in similar if not p <= gone} <= found and not any(p <= gone for p in found)
    assert "ReusedExchange" in met._jdf.queryExecution().executedPlan().toString()
