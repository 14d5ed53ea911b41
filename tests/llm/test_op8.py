import random

import numpy as np

from isoweave.llm import op8_latent as L


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


def brute(docs, items):
    """Pairs by the same checks around every window of every document: no vectors, no candidates."""
    bench = L.Benchmark(items)
    seen = {}
    for _, t in docs:
        for w in set(L.words_of(t)):
            seen[w] = seen.get(w, 0) + 1
    bench.weigh(seen, len(docs))
    out = set()
    for i, t in docs:
        ids = L._ids(t, bench.terms)
        for k, (item, w) in enumerate(bench.items):
            own = [bench.terms[x] for x in w]
            if len(bench.answers[k] & set(ids.tolist())) < L.ANSWER * len(bench.answers[k]):
                continue
            for s in range(0, max(1, len(ids)), L.STRIDE):
                region = ids[max(0, s - len(w)):s + L.WINDOW + len(w)].tolist()
                if len(bench.answers[k].intersection(region)) >= L.ANSWER * len(bench.answers[k]) and slow_lcs(own, region) >= L.LCS * len(w):
                    out.add((i, item))
                    break
    return out


def test_recall_and_precision_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    want = brute(docs, items)
    rows = L.op8_latent_retrieval(spark, d).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    exact = {(i, k) for i, t in docs for k, x in items if " ".join(L.words_of(x)) in " ".join(L.words_of(t))}
    print("\npairs", len(got), "brute", len(want), "exact", len(exact))
    assert len(rows) == len(got) and got <= want and exact <= got
    assert len(got) >= 0.95 * len(want)


def paraphrase(rng, words):
    out = [w for w in words if rng.random() > 0.12]
    for _ in range(3):
        out.insert(rng.randrange(len(out)), "filler")
    return " ".join(out)


def test_paraphrases_nulls_long_texts_and_clashes(spark):
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(3000)]
    common = vocabulary[:40]
    sentence = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(n))
    items = [(i, sentence(rng.randint(14, 60))) for i in range(60)] + [(90, None), (91, ""), (92, "the the"), (5, "one more of the same number " + sentence(20))]
    docs, planted = [(i, sentence(rng.randint(1, 400))) for i in range(300)], set()
    for i in range(0, 300, 5):
        k, text = items[i // 5]
        words = docs[i][1].split()
        at = rng.randrange(len(words) + 1)
        docs[i] = (i, " ".join(words[:at] + [paraphrase(rng, text.split())] + words[at:]))
        planted.add((i, k))
    docs += [(1000, None), (1001, ""), (1002, "x " * 60000 + items[3][1]), (None, items[4][1]), (0, docs[0][1]), (1003, "the the the " * 2000)]
    planted |= {(1002, 3), (None, 4)}
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as lcs")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'q' as doc_id")
    got = [(r.doc_id, r.item_id) for r in L.contaminated(df, bench).collect()]
    assert len(planted - set(got)) <= 2 and set(got) - planted == set()
    left = {r.doc_id for r in L.decontaminate(df, bench).collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in got}
    assert L.contaminated(df, bench.limit(0)).count() == 0 and L.contaminated(df.limit(0), bench).count() == 0


def test_blocks_of_the_benchmark_give_the_same_pairs(spark, monkeypatch):
    d = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    one = {tuple(r)[:2] for r in L.contaminated(docs, items).collect()}
    monkeypatch.setattr(L, "BLOCK", 3000)
    assert {tuple(r)[:2] for r in L.contaminated(docs, items).collect()} == one and one


def test_thin_products_and_subsequences():
    rng = np.random.default_rng(2)
    term, row = rng.integers(0, 50, 400), np.sort(rng.integers(0, 30, 400))
    idf, x = rng.random(50) + 0.1, rng.standard_normal((50, 6))
    a = np.zeros((30, 50))
    np.add.at(a, (row, term), idf[term])
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
    z = np.zeros_like(x)
    L._thin(term, row, idf, x.astype(np.float32), z)
    assert np.allclose(z, a.T @ (a @ x), atol=1e-4)
    r = random.Random(1)
    for _ in range(200):
        p, q = [r.randrange(6) for _ in range(r.randint(1, 40))], [r.randrange(7) for _ in range(r.randint(0, 60))]
        mask = {}
        for i, t in enumerate(p):
            mask[t] = mask.get(t, 0) | 1 << i
        assert L.lcs(mask, len(p), np.array(q, int)) == slow_lcs(p, q)


def test_only_the_rows_that_hold_an_item_go(spark):
    item = "zebra quartz violin umbrella lantern cactus marble tornado saffron glacier"
    clean = [(None, f"clean text number {i} about the weather") for i in range(30)] + [(7, f"another clean text {i} about the sea") for i in range(30)]
    docs = spark.createDataFrame(clean + [(None, f"it says {item} here"), (7, item), (8, "fine")], "doc_id long, text string")
    left = L.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [*clean, (8, "fine")]))


def test_the_latent_space_is_that_of_all_documents(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"t{i}" for i in range(40)]
    docs = [" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(40)], k=rng.randint(1, 90))) for _ in range(5000)]
    monkeypatch.setattr(L, "RANK", 5)
    monkeypatch.setattr(L, "EXTRA", 40)
    bench = L.Benchmark([(1, " ".join(vocabulary))])
    df = spark.createDataFrame([(L._ids(t, bench.terms).tobytes(),) for t in docs], "ids binary").repartition(40)
    L.fit(df, bench)
    got = bench.basis / bench.idf[:, None]
    gram, n = np.zeros((40, 40)), 0
    for text in docs:
        term = L._ids(text, bench.terms)
        row, count = np.arange(len(term)) // L.WINDOW, -(-len(term) // L.WINDOW)
        a = np.zeros((count, 40))
        np.add.at(a, (row, term), bench.idf[term])
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
        gram, n = gram + a.T @ a, n + count
    term, row, count = bench.vectors()
    a = np.zeros((count, 40))
    np.add.at(a, (row, term), bench.idf[term])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    top = np.linalg.eigh(gram + a.T @ a * n / count)[1][:, -5:]
    assert np.allclose(got @ got.T, top @ top.T, atol=1e-4)


def test_short_items_count_word_for_word(spark):
    items = [(1, "six words that stand side by"), (2, "two words"), (3, "alone"), (4, "a b a b")]
    rows = [(1, "before six words that stand side by after"), (2, "six words that stand side and by"), (3, "Two words!"), (4, "two words more"), (5, "alone"), (6, "not alone"), (7, "x a b a b a"), (8, "a b a"), (9, "Six words, that stand: side by")]
    docs = spark.createDataFrame(rows, "`doc.id` long, `a text` string")
    got = L.contaminated(docs, spark.createDataFrame(items, "item_id int, text string"), "a text", "doc.id")
    assert got.columns[:2] == ["doc.id", "item_id"]
    assert sorted(tuple(r)[:2] for r in got.collect()) == [(1, 1), (3, 2), (5, 3), (7, 4), (9, 1)]
    left = L.decontaminate(docs, spark.createDataFrame(items, "item_id int, text string"), "a text", "doc.id")
    assert sorted(r[0] for r in left.collect()) == [2, 4, 6, 8] and left.columns == docs.columns
