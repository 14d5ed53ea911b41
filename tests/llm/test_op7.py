import hashlib
import struct

import numpy as np
import sentencepiece

from isoweave.llm import op7_sentencepiece as P

TEXTS = [None, "", " ", "  two  spaces ", "plain text", "é ü ñ 中文 \U0001f600 x", "\n\ttab\r\n", "▁ own mark", "a\0b", "é combining", "x" * 70000, "<s> </s> <unk> <0x41>", " lead", "trail "]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=P.default_model())


def digest(ids):
    return hashlib.sha256(b"".join(struct.pack("<I", i) for i in ids)).hexdigest()


def test_whole_table_against_the_library(spark):
    d, sp = "/root/testdata/sf0.01", library()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = P.op7_sentencepiece(spark, d).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = sp.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), digest(ids))
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest()


def test_spans_ids_and_round_trip(spark):
    sp = library()
    df = spark.createDataFrame(list(enumerate(TEXTS)) + [(None, "a b"), (4, "plain text")], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as decoded")
    rows = P.encode(df, P.default_model())
    by = {r.doc_id: r for r in rows.collect()}
    for i, t in [*enumerate(TEXTS), (None, "a b")]:
        raw, r = (t or "").encode(), by[i]
        ids = np.frombuffer(r.ids, "<u4")
        spans = np.frombuffer(r.spans, "<u4").reshape(-1, 2)
        assert ids.tolist() == sp.encode(t or "", add_bos=True, add_eos=True)
        assert len(spans) == r.n_tokens and (spans[:, 0] <= spans[:, 1]).all() and spans[-1, 1] == len(raw)
        assert (spans[1:, 0] >= spans[:-1, 0]).all()
        assert b"".join(raw[a:b] for a, b in spans) == raw
        if 0 < len(raw) < 1000:
            for n, ((a, b), i) in enumerate(zip(spans[1:-1], ids[1:-1].tolist())):
                if not sp.is_byte(i):
                    piece = sp.id_to_piece(i).replace("▁", " ") if "▁" not in t else sp.id_to_piece(i)
                    assert raw[a:b].decode().replace(" ", "▁" if "▁" in t else " ") == piece[n == 0:]
    assert {r.doc_id: r.decoded for r in P.decode(rows.select("doc_id", "ids"), P.default_model()).collect()} == {i: r.decoded for i, r in by.items()}
    assert P.encode(df.limit(0), P.default_model()).count() == 0


def unit(offset, label, leaf=False):
    assert offset < 1 << 21
    return offset << 10 | leaf << 8 | label


def test_longest_prefix_in_a_compiled_map():
    # a trie of "a" -> "X" and "ab" -> "YZ": root, a, ab and the values of both
    units = [0] * 512
    units[0] = unit(256, 0)
    units[256 ^ 97] = unit((256 ^ 97) ^ 128, 97, True)
    units[128] = 0x80000000 | 0
    units[128 ^ 98] = unit((128 ^ 98) ^ 400, 98, True)
    units[400] = 0x80000000 | 2
    blob = np.array(units, "<u4").tobytes()
    m = P.CharacterMap(struct.pack("<I", len(blob)) + blob + b"X\0YZ\0")
    assert m.longest(b"abc", 0) == (2, b"YZ")
    assert m.longest(b"ac", 0) == (1, b"X")
    assert m.longest(b"cab", 1) == (2, b"YZ")
    assert m.longest(b"c", 0) is None
    model = P.Model(P.default_model())
    model.map, model.plain, model.squeeze = m, False, True
    body, source = model.normalised(b"  ab a  c ")
    assert body.decode() == "▁YZ▁X▁c" and source.tolist() == [2, 2, 2, 2, 2, 4, 4, 4, 5, 6, 6, 6, 8, 9]
