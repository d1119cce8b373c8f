import corpus_pipeline


def test_stages_on_a_small_corpus(spark, tmp_path):
    line = "this line of quite a few words is found in many documents"
    rows = [(k, f"{line}\nand number {k} says w{k} x{k} y{k} z{k} on its own", "en", f"s{k % 3}", 1) for k in range(30)]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, None, "en", "s1", 1), (102, "moron " * 5 + "scum idiot", "en", "s1", 1)]
    rows += [(200 + k, f"moron scum idiot a{k} b{k}", "en", "s2", 1) for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 0) for k in range(30)] + [(200 + k, 1) for k in range(20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    found = {r["doc_id"]: r for r in out.collect()}
    assert set(range(30)) <= set(found) and not {102, *range(200, 220)} & set(found)
    assert sum(line in (r["decoded"] or "") for r in found.values()) == 1 and found[0]["n_chars"] == len(found[0]["decoded"])
    assert 100 not in found or found[100]["decoded"] == ""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
