import gzip
import hashlib

import duckdb

from isoweave.llm import op3_warc as W


def brute(rows):
    """(page_id, bytes, digest, type, refers_to) of (page_id, html) rows."""
    rows = [(i, (h or "").encode()) for i, h in rows]
    top = {}
    for i, b in rows:
        if len(b) >= 1000 and i is not None:
            top[b] = max(i, top.get(b, i))
    out = []
    for i, b in rows:
        revisit = b in top and i != top[b]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", top[b] if revisit else None))
    return sorted(out, key=str)


def columns(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_whole_table_and_sql(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{d}/pages.parquet").collect()]
    assert columns(W.op3_warc(spark, d)) == brute(rows)
    con = duckdb.connect()
    con.sql(f"create view pages as select * from read_parquet('{d}/pages.parquet')")
    got = con.sql(W.ORACLES["op3_warc"]).df()
    assert list(got.columns) == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert len(got) == len(rows)


LONG = "é" * 600
PAGES = [(1, "u1", LONG), (5, None, LONG), (9, "u\r\nx", LONG), (None, "n", LONG), (9, "again", LONG), (2, "s", "short"), (3, "s", "short"), (4, "e", None), (6, "e", ""), (7, "z", LONG + "z"), (-8, "neg", "x" * 300000), (1 << 60, "far", "y")]


def test_copies_nulls_and_clashing_names(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "1 as shard", "2 as kind", "3 as payload", "4 as digest")
    W.write(df, f"file://{tmp_path}/a", shards=5)
    back = W.read(spark, f"file://{tmp_path}/a")
    assert columns(back) == brute([(i, h) for i, _, h in PAGES])
    assert {r.page_id: r.payload.decode() for r in back.collect() if r.record_type == "response" and r.page_id is not None} == {9: LONG, 2: "short", 3: "short", 4: "", 6: "", 7: LONG + "z", -8: "x" * 300000, 1 << 60: "y"}
    W.write(df.limit(0), f"file://{tmp_path}/none")
    assert W.read(spark, f"file://{tmp_path}/none").count() == 0


def test_files_are_repeatable_rolled_and_plain_gzip(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sums = []
    for name, df in (("a", pages), ("b", pages.repartition(5))):
        manifest = W.write(df, f"file://{tmp_path}/{name}", shards=4, roll=20000).collect()
        sums.append({r.name: (r.sha256, r.records, r.first_id, r.last_id) for r in manifest})
        assert {p.name for p in (tmp_path / name).glob("*.gz")} == set(sums[-1])
        assert not list((tmp_path / name / "_temporary").glob("*/*.gz"))
        for r in manifest:
            body = (tmp_path / name / r.name).read_bytes()
            assert hashlib.sha256(body).hexdigest() == r.sha256 and len(body) == r.bytes
            text = gzip.decompress(body)
            assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") and text.count(b"WARC/1.1\r\n") == r.records + 1
    assert sums[0] == sums[1] and len(sums[0]) > 8
    ordered = [sums[0][n] for n in sorted(sums[0])]
    assert all(a[3] < b[2] for a, b in zip(ordered, ordered[1:]))


def test_heavy_bins_are_refined(spark):
    rows = [(i, 100, 0) for i in range(1000)] + [(1 << 50, 1, 0)]
    slim = spark.createDataFrame(rows, "page_id long, bytes long, part long")
    edges = W.boundaries(slim, 10)
    assert len(edges) == 9 and all(abs(e - 100 * (i + 1)) <= 25 and p == 0 for i, (e, p) in enumerate(edges))


def test_a_hot_id_and_null_ids_are_divided_by_digest(spark, tmp_path):
    rows = [(None, f"u{i}", f"null {i} " + "x" * 2000) for i in range(200)] + [(7, f"v{i}", f"seven {i} " + "y" * 2000) for i in range(200)]
    rows += [(i, "w", f"own {i} " + "z" * 2000) for i in range(100, 250)] + [(300 + i, "c", rows[i][2]) for i in range(0, 40)] + [(7, "again", rows[250][2])] * 3
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = W.write(df, f"file://{tmp_path}/a", shards=8).collect()
    shares = {}
    for r in manifest:
        shares[r.shard] = shares.get(r.shard, 0) + r.records
    assert len(shares) == 8 and max(shares.values()) <= 1.5 * len(rows) / 8
    assert columns(W.read(spark, f"file://{tmp_path}/a")) == brute([(i, h) for i, _, h in rows])
    edges = W.boundaries(spark.createDataFrame([(-(1 << 63), 5, 0), ((1 << 63) - 1, 5, 0)], "page_id long, bytes long, part long"), 2)
    assert edges in ([], [((1 << 63) - 1, 0)]) or len(edges) == 1
