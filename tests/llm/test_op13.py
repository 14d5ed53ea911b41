import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from isoweave.llm import op13_prefix_trie as T

SCHEMA = "conv_id long, turn int, role string, text string"


def trie(convs):
    """{(depth, conv_id): row} of conversations {id: [(role, text)]}."""
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    out = []

    def sums(way):
        leaves, saved = (0 if kids[way] else 1), (len(members[way]) - 1) * len(way[-1][1].encode()) if way else 0
        for k in kids[way]:
            a, b = sums(k)
            leaves, saved = leaves + a, saved + b
        ends = ",".join(map(str, sorted(c for c in members[way] if len(convs[c]) == len(way))))
        out.append((min(members[way]), len(way), min(members[way[:-1]]) if way else None, len(members[way]), len(kids[way]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if convs:
        sums(())
    return sorted(out, key=lambda r: (r[1], r[0]))


def spliced(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in own}
    return {c: own.get(c - int(math.fmod(c, 5)), [])[:h[c]] + own[c][h[c]:] for c in own}


def got(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=lambda r: (r[1], r[0]))


def direct(spark, convs, block):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    turns = T.digested(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as pos", "2 as digest", "3 as `a.b`"))
    return got(T.prefix_trie(turns, spark.createDataFrame([(c,) for c in convs], "conv_id long"), block))


@pytest.mark.parametrize("block", [1, 3, 4])
def test_equals_a_plain_trie(spark, block):
    draw = random.Random(block)
    convs = {c: [(draw.choice("ua"), draw.choice(["", "é", "xyz"]) * (d < 5)) for d in range(draw.randrange(12))] for c in range(120)}
    convs |= {500 + c: convs[7] for c in range(60)} | {700 + c: [("u", "same")] * 9 + [("a", str(c % 4))] for c in range(30)} | {900: [], 901: [("u", f"t{i}") for i in range(70)]}
    assert direct(spark, convs, block) == trie(convs)


def test_no_conversation_and_only_empty_ones(spark):
    assert direct(spark, {}, 4) == []
    assert direct(spark, {4: [], 2: []}, 4) == trie({4: [], 2: []})


def test_roles_and_texts_are_kept_apart(spark):
    convs = {1: [("ab", "c")], 2: [("a", "bc")], 3: [("", "abc")], 4: [("abc", "")]}
    assert len(direct(spark, convs, 4)) == 5


def test_query_on_odd_rows(spark, tmp_path):
    draw = random.Random(5)
    rows = [(c, t, draw.choice(["user", "assistant", None]), draw.choice([None, "", "a", "é" * 3])) for c in range(60) if c not in (20, 35) for t in range(draw.randrange(1, 14))]
    rows += [(None, 0, "user", "x"), (7, None, "user", "first"), (8, 1, "user", "same"), (8, 1, "user", "same"), (-3, 0, "user", "x")]
    # ties of the order go by a digest, so the rows that tie here are equal; the sign of the remainder is that of the id
    spark.createDataFrame(rows[::-1], SCHEMA).selectExpr("*", "1 as digest", "2 as `a.b`", "3 as n").write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(T.op13_prefix_trie(spark, str(tmp_path))) == trie(spliced(rows))


def test_splicing(spark):
    df = spark.createDataFrame([(0, i, "u", f"a{i}") for i in range(3)] + [(1, i, "u", f"b{i}") for i in range(6)] + [(2, 0, "u", "c0")], SCHEMA)
    turns, convs = T.rebuilt(T.digested(df), F.lit(0), F.lit(4))
    assert sorted((r.conv_id, r.pos) for r in turns.collect()) == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (2, 1), (2, 2), (2, 3)]
    assert {r.conv_id for r in convs.collect()} == {0, 1, 2}
