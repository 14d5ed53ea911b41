import hashlib

import corpus_pipeline as C
from isoweave.llm import op1_langid, op5_toxicity, op7_sentencepiece


def test_stages_over_the_whole_table(spark, tmp_path):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "1 as score", "'x' as predicted", "2 as row")
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(C.STAGES):
        path = f"{tmp_path}/{i}"
        out = stage(spark, docs, d)
        if i < len(C.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        sizes.append(docs.count())
        if name == "toxicity":
            model = op5_toxicity.learn(before.select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet"))
            bad = {r.doc_id for r in op5_toxicity.predict(before.select("doc_id", "text"), model).where("predicted = 1").collect()}
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == bad and bad
        if name == "near_dedup":
            assert docs.count() == docs.select("text").distinct().count() == docs.select("doc_id").distinct().count()
            first = {}
            for r in before.collect():
                first[r.text] = min(r.doc_id, first.get(r.text, r.doc_id))
            assert {r.doc_id for r in docs.collect()} <= set(first.values())
        if name == "decontamination":
            items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
            kept = {" ".join(r.text.lower().split()) for r in docs.collect()}
            assert not any(x in t for x in items for t in kept)
            last = {r.doc_id: r.text for r in docs.collect()}
    print("\nkept", sizes)
    assert sizes[-2] == sizes[-1] and sizes[1] > 0.85 * sizes[0] and sizes[2] > 0.98 * sizes[1] and sizes[4] < sizes[3]
    sp = op7_sentencepiece.model_of(op7_sentencepiece.default_model()).processor
    for r in docs.collect():
        ids = sp.encode(last[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_run_is_registered_and_handles_odd_rows(spark, tmp_path):
    import __spark_entry__ as E

    assert E.queries()["pipeline"] is C.run and {f"op{n}_" for n in range(1, 11)} <= {q.split("_")[0] + "_" for q in E.queries()}
    rows = [(1, None, None), (2, "", "en"), (None, "the cat and the dog are in the house " * 5, "en"), (3, "the cat and the dog are in the house " * 5, "en"), (3, "the cat and the dog are in the house " * 5, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (3, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in C.run(spark, str(tmp_path)).collect()] == [3]
    assert op1_langid.MARGIN > 0


def test_stages_keep_columns_of_any_name(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").selectExpr("*", "1 as `my col`", "'q' as `a.b`", "2 as `back``tick`")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.count() > 0.5 * docs.count(), name
    assert stage is not C.STAGES[-1][1] and C.STAGES[-1][1](spark, docs, d).count() == docs.count()
