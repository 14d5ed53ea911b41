import zlib

from isoweave.llm import op1_langid as L


def test_held_out_accuracy_over_the_whole_table(spark):
    d = "/root/testdata/sf0.1"
    rows = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = L.op1_language(spark, d).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    right = sum(r.lang_pred == rows[r.doc_id].lang for r in held) / len(held)
    print("\nFALSE", [(rows[r.doc_id].lang, r.lang_pred, round(r.margin, 4), len(rows[r.doc_id].text), rows[r.doc_id].text[:40]) for r in got if r.rejected][:20])
    print("\naccuracy", right, "rejected", sum(r.rejected for r in got) / len(got))
    assert right > 0.975
    assert sum(r.rejected for r in got) < 0.01 * len(got)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    swapped = docs.selectExpr("doc_id", "text", "if(crc32(encode(cast(doc_id as string), 'UTF-8')) % 5 = 0, 'zz', lang) lang")
    a, b = L.fit(docs.where(L.remainder("doc_id", 5) != 0)), L.fit(swapped.where(L.remainder("doc_id", 5) != 0))
    assert a == b and {x for x, _ in a} == {"en", "de", "fr", "es"} and all(len(d) <= L.DICTIONARY for _, d in a)
    assert L.fit(docs.repartition(3)) == L.fit(docs)


def test_nulls_ties_long_and_empty(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 %%", None), (4, "the cat and the dog are here " * 20, "en"), (5, "le chat est dans la maison avec nous " * 20, "fr"), (6, "the and are " * 50000, None), (None, "le chat est dans", None), (4, "the cat and the dog", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as score", "'q' as margin", "2 as piece")
    model = L.fit(df)
    got = L.predict(df, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 and by[i].rejected for i in (1, 2, 3))
    assert by[6].lang_pred == "en" and by[5].lang_pred == by[None].lang_pred == "fr" and not by[5].rejected
    assert {r.lang_pred for r in L.predict(df, []).collect()} == {"und"}
    assert L.predict(df.limit(0), L.fit(df.limit(0))).count() == 0


def test_a_letter_is_of_a_unicode_letter_category(spark):
    rows = [(1, "²"), (2, "½ ③ 12"), (3, "中文 字"), (4, "a²b"), (5, "¼" * 3000)]
    df = spark.createDataFrame(rows, "`doc.id` long, `the text` string")
    model = L.fit(spark.createDataFrame([("the cat and the dog", "en"), ("le chat est", "fr")], "text string, lang string"))
    got = {r[0]: r.lang_pred for r in L.predict(df, model, "the text").collect()}
    assert got[1] == got[2] == got[5] == "und" and got[3] != "und" and got[4] != "und"
    assert L.letters("a²b  C-d") == " a b c d "


def test_no_language_is_left_out(spark):
    rows = spark.range(1200).selectExpr("concat('word', id, ' of language ', id) text", "concat('l', id) lang")
    model = L.fit(rows)
    assert len(model) == 1200 and sum(len(b) for _, b in model) <= L.MODEL
