import hashlib
import random
import zlib

from isoweave.llm import op2_transport as T


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = T.op2_transport_stream(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        body = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]))
        assert r.media_bytes % 188 == 0 and r.media_bytes > len(body) and r.feature.endswith("counter_errors=0")


def test_round_trip_of_every_length_near_a_packet():
    rng = random.Random(1)
    for n in [*range(0, 800), 16384, 16385, 16384 * 9 + 7, 200000]:
        body = rng.randbytes(n)
        media = T.mux(body)
        assert len(media) % 188 == 0 and set(media[::188]) == {0x47}
        (stream,) = T.demux(media)
        assert stream["payload"] == body and stream["counter_errors"] == stream["table_errors"] == stream["duplicates"] == 0
        assert [u["pts"] for u in stream["units"]] == [i * 3600 for i in range(max(1, -(-n // 16384)))]
        assert [u["random_access"] for u in stream["units"]] == [i % 8 == 0 for i in range(len(stream["units"]))]


def test_damage():
    body = bytes(range(256)) * 40
    media = T.mux(body)
    packets = [media[i:i + 188] for i in range(0, len(media), 188)]
    (twice,) = T.demux(b"".join([*packets[:5], packets[4], *packets[5:]]))
    assert twice["payload"] == body and twice["duplicates"] == 1 and twice["counter_errors"] == 0
    (lost,) = T.demux(b"".join(packets[:5] + packets[6:]))
    assert lost["counter_errors"] == 1 and lost["payload"] != body
    (moved,) = T.demux(b"junk" + media[:188 * 6] + b"\x01\x02" + media[188 * 6:])
    assert moved["payload"] == body and moved["lost_sync"] == 2
    broken = bytearray(media)
    broken[10] ^= 1
    assert T.demux(bytes(broken)) == []
    assert T.demux(b"") == T.demux(None) == T.demux(b"not a stream" * 50) == []
    assert T.section_crc(T.PAT) == 0


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None), (2, b""), (3, b"a"), (3, b"a"), (None, b"b" * 300000)]
    df = spark.createDataFrame(rows, "doc_id long, payload binary").selectExpr("*", "1 as media", "'x' as streams")
    got = T.parse(T.store(df)).collect()
    assert [(r.doc_id, bytes(r.streams[0].payload)) for r in got] == [(i, T.pad(b)) for i, b in rows]
    assert T.parse(T.store(df.limit(0))).count() == 0
