import zlib
from collections import Counter, defaultdict

from isoweave.llm.op10_sharding import op10_sampled_splitters, shard_rows, write_shards


def verify(rows, texts, shards=16, slack=0.02):
    """rows: (key, size, crc, shard, slot); texts: key -> text, for unique keys."""
    sizes, slots = Counter(), defaultdict(list)
    for k, size, crc, shard, slot in rows:
        body = (texts[k] or "").encode()
        assert (size, crc) == (len(body) + 1, zlib.crc32(body))
        assert 0 <= shard < shards
        sizes[shard] += size
        slots[shard].append(slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    if rows:
        mean, largest = sum(sizes.values()) / shards, max(r[1] for r in rows)
        for s in range(shards):
            assert abs(sizes[s] - mean) <= slack * mean + largest, sizes


def test_whole_table(spark):
    for d in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
        got = op10_sampled_splitters(spark, d).collect()
        assert len(got) == len(texts) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
        verify([(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got], texts)


def test_hot_group_is_cut(spark):
    texts = {i: "copy " * 50 if i % 3 else f"text {i} " * (i % 40) for i in range(6000)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    verify([tuple(r) for r in shard_rows(df).collect()], texts)


def test_nulls_repeats_clashes_and_small_tables(spark):
    texts = {1: None, 2: "", 3: "é" * 70000, 4: "a", None: "b"}
    rows = [*texts.items(), (4, "a"), (4, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as size", "1 as shard", "2 as _range")
    got = shard_rows(df).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard_rows(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_whole_rows_are_cut_and_written_once(spark, tmp_path):
    rows = [(7, "the same row again")] * 4000 + [(i, f"small {i}") for i in range(198)]
    df = spark.createDataFrame(rows, "`my id` long, `a.text` string")
    got = shard_rows(df, text="a.text", key="my id").collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r["size"]
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 0.1 * max(sizes.values())
    write_shards(df, f"{tmp_path}/out", 4, "a.text", "my id")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.select("`my id`", "`a.text`").collect())) == sorted(rows)


def test_repeatable(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    a, b = shard_rows(docs), shard_rows(docs.repartition(7))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_written_shards_hold_every_record(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 4


def test_no_python(spark):
    plan = op10_sampled_splitters(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
