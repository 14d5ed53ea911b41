import zlib

import numpy as np

from isoweave.llm import op5_toxicity as T


def quality(spark, d):
    gold = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    got = T.op5_toxicity(spark, d).collect()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in gold]
    hit = sum(r.predicted and gold[r.doc_id] for r in held)
    return hit / max(1, sum(r.predicted for r in held)), hit / max(1, sum(gold[r.doc_id] for r in held)), sum(r.predicted for r in got) / len(got)


def test_held_out_precision_and_recall(spark):
    for d in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        precision, recall, share = quality(spark, d)
        print("\n", d, precision, recall, share)
        # the small table has too few labelled rows in three of its four languages to learn their words from
        small = d.endswith("0.01")
        assert precision > (0.85 if small else 0.95) and recall > (0.6 if small else 0.88) and 0.02 < share < 0.2


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    n, a, b = 40000, np.array([0.6, 0.4, 0.5, 0.3, 0.5]), np.array([0.02, 0.01, 0.05, 0.01, 0.02])
    y = (rng.random(n) < 0.2).astype(int)
    votes = (rng.random((n, 5)) < np.where(y[:, None] == 1, a, b)).astype(float)
    votes = np.hstack([votes, votes[:, :1]])  # the last voter repeats the first
    fired = [np.flatnonzero(v) for v in votes]
    m = T.LabelModel(votes.T @ votes, n, fired[:2000], y[:2000])
    assert np.abs(m.a[:5] - a).max() < 0.12 and np.abs(m.b[:5] - b).max() < 0.03
    assert m.correlation[0, 5] > 0.3 and m.correlation[1:5, 1:5].max() < 0.1
    assert ((m.posterior(fired) > 0.5) == y).mean() > 0.9


def test_nulls_ties_long_empty_and_no_labels(spark):
    rows = [(i, "you idiot moron and clown " + "filler " * i if i % 3 == 0 else "plain words about nothing " + "filler " * i) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "idiot moron " * 30000), (None, "idiot moron"), (3, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as score", "1 as toxic")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(3, 0), (None, 1), (100, None)], "doc_id long, toxic int")
    got = T.predict(df, T.learn(df, labels)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.predicted for r in got}
    assert all(by[i] == (i % 3 == 0) for i in range(60)) and by[102] == by[None] == 1 and by[100] == by[101] == 0
    none = T.predict(df, T.learn(df, labels.limit(0))).collect()
    assert {r.doc_id: r.predicted for r in none}[3] == 1
    assert T.predict(df.limit(0), T.learn(df.limit(0), labels)).count() == 0
