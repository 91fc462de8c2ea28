"""The pipeline on rows with nulls, repeats, clashing ids, long and empty texts, and on an empty table."""

import collections

import corpus_pipeline
from tessera.llm import toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def stages(spark, folder, rows, labels=()):
    docs = spark.createDataFrame(rows, KIND)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(folder)), name)
        out[name] = docs.collect()
        assert name == "packing" or docs.columns == corpus_pipeline.COLUMNS
    return out


def test_edge_rows(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(60))
    long = " ".join(f"w{i % 997}x{i}" for i in range(60_000))
    rows = [
        (1, text, "en", "a", 5), (2, text + " more", "en", "a", 5), (1, "another text of id one, told apart by its words", None, None, None), (3, None, "en", "b", 0), (4, "", None, "b", 0), (5, " \n", "en", None, 2),
        (6, "write to a.b@c.de or a.b@c.de", "en", "b", 9), (6, "write to a.b@c.de or a.b@c.de", "en", "b", 9), (None, long, "en", "a", 1), (None, "no id here but words", "en", "c", 3), (7, "one", "en", "c", 3),
    ]
    out = stages(spark, tmp_path, rows)
    key = lambda rs: collections.Counter((r.doc_id, r.text) for r in rs)
    given = collections.Counter((i, t) for i, t, *_ in rows)
    assert key(out["toxicity"]) == given  # nothing is known to be toxic
    kept = collections.Counter(k for k in given if k not in {(2, text + " more"), (4, ""), (5, " \n")})
    assert key(out["simhash_dedup"]) == kept
    masked = {(i, (t or "").replace("a.b@c.de", "<EMAIL>") if t is not None else None) for i, t in kept}
    assert set(key(out["pii"])) == masked and all(r.n_chars == (None if r.text is None else len(r.text)) for r in out["pii"])
    assert set(key(out["mixing"])) <= masked and max(key(out["mixing"]).values()) <= 2
    pieces = collections.Counter()
    for r in out["packing"]:
        pieces[r.doc_id] += r.length
    assert set(pieces) == {r.doc_id for r in out["mixing"]} and max(r.sequence_id for r in out["packing"]) == (sum(pieces.values()) - 1) // 2048


def test_empty_table(spark, tmp_path):
    assert not any(stages(spark, tmp_path, []).values())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_toxic_rows_go(spark, tmp_path):
    rows = [(i, f"text {i} of its own words number{i} about thing{i * 7} " + ("vile filth scum " * 3 if i % 3 == 0 else "kind good fine " * 3), "en", "s", 1) for i in range(120)]
    out = stages(spark, tmp_path, rows, [(i, 1, int(i % 3 == 0)) for i in range(120)])
    kept = {r.doc_id for r in out["toxicity"]}
    model = toxicity.train(spark.createDataFrame(rows, KIND), spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int"))
    assert kept == {i for i, t, *_ in rows if model.score(t) < 0.5} and len([i for i in kept if i % 3]) >= 78 and len([i for i in kept if i % 3 == 0]) <= 4
