import hashlib
import json
from collections import defaultdict

import pytest

from isoweave.llm import op11_chat as C
from isoweave.llm.op11_chat import LAYOUTS, Layout, Say, Tell, escaped, fingerprint, format_records, known, paths_of, read_back, turns_in, unescaped, unmapped

HARD = ["", "a", "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n", "<\\|im_start|>", "<\\\\|x_1|>", "\\<|a|>", "<|é|>", "<||>", "<|a|><|b|>", "<<|a|>>", "\n\n", "𝄞é\u0000"]


def plain(turns):
    """{conversation: row of read_back} from (conversation, role, text) in order."""
    by = defaultdict(list)
    for c, role, text in turns:
        by[c].append((role, text))
    out = {}
    for c, said in by.items():
        loss = "".join(t for r, t in said if r == "assistant")
        out[c] = (len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def rows_of(df):
    return {r[0]: tuple(r)[1:5] for r in df.collect()}


def test_escapes_can_be_taken_back():
    for t in HARD:
        assert unescaped(escaped(t)) == t
        for k in range(4):
            deep = t
            for _ in range(k):
                deep = escaped(deep)
            assert unescaped(escaped(deep)) == deep
    assert "<|im_end|>" not in escaped(HARD[3])


def test_fingerprints_hash_paths_alone():
    a, b = {"messages": [{"role": "x", "content": "1"}, {"content": None, "role": "y"}]}, {"messages": [{"content": "z", "role": ""}], "id": 7}
    assert paths_of(a) == paths_of(b) == {"messages[].role", "messages[].content"}
    assert fingerprint(paths_of(a)) != fingerprint(paths_of({"messages": [{"role": "x"}]}))
    with pytest.raises(ValueError):
        known((Layout("a", (Say("user", ("q",)),)), Layout("b", (Say("assistant", ("q",)),))))


LAID = [
    ({"role": "user", "text": "hi"}, [("user", "hi")]),
    ({"role": None, "text": None}, [("", "")]),
    ({"system": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]}, [("system", "s"), ("user", "q"), ("assistant", "")]),
    ({"messages": []}, []),
    ({"messages": [{"role": "user", "content": [{"text": "a"}, {"text": "b"}]}]}, [("user", "ab")]),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "other", "value": "o"}]}, [("user", "q"), ("assistant", "a"), ("other", "o")]),
    ({"prompt": "p", "completion": "c", "meta": {"any": [1]}}, [("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "", "output": 3}, [("user", "i"), ("assistant", "3")]),
    ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"history": [["a", "b"], ["c", "d"]], "prompt": "p", "response": "r"}, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d"), ("user", "p"), ("assistant", "r")]),
    ({"data": {"prompt": {"text": "p"}, "response": {"text": "r"}}}, [("user", "p"), ("assistant", "r")]),
]


def test_layouts_become_canonical_turns(spark):
    rows = [(i, 0, json.dumps(r)) for i, (r, _) in enumerate(LAID)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, record string")
    got = {r.conv_id: [t for t in turns_in(r.formatted)] for r in format_records(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(LAID) if want}
    assert len({id(known()[fingerprint(paths_of(r))]) for r, _ in LAID}) == 8


def test_hard_texts_parts_and_order(spark):
    turns = [(c, r, t) for c in (1, 2, None) for r in ("user", "assistant", "a\nb\\<|im_end|>", "") for t in HARD]
    rows = [(c, i % 1000, json.dumps({"role": r, "text": t})) for i, (c, r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows[::-1], "`a.conv` long, turn int, record string").selectExpr("*", "1 as formatted", "2 as k", "3 as part")
    for size in (1, 60, 1 << 20):
        made = format_records(df, key="a.conv", size=size)
        assert rows_of(read_back(made, key="a.conv")) == rows_of(read_back(made, key="a.conv", ordered=True)) == plain(turns)
    assert max(r.part for r in format_records(df, key="a.conv", size=60).collect()) > 5
    for r in format_records(df, key="a.conv").collect():
        masked = "".join(unescaped(r.formatted[s.start:s.stop]) for s in r.loss)
        assert masked == "".join(HARD)


def test_ties_repeats_nulls_unknown_and_empty(spark):
    schema = "conv_id long, turn int, record string"
    one, two = json.dumps({"role": "user", "text": "b"}), json.dumps({"role": "user", "text": "a"})
    rows = [(1, None, one), (1, 0, one), (1, 0, two), (1, 0, two), (2, 0, None), (2, 1, "no json"), (2, 2, "[1]"), (2, 3, '{"q": 1}'), (2, 4, '{"q": "x"}'), (3, 0, "{}")]
    df = spark.createDataFrame(rows, schema)
    assert rows_of(read_back(format_records(df))) == plain([(1, "user", t) for t in "baab"])
    assert sorted(map(tuple, unmapped(df).collect()), key=str) == sorted([(None, None, 3), (f"{fingerprint({'q'}):016x}", "q", 2), (f"{fingerprint(set()):016x}", "", 1)], key=str)
    empty = spark.createDataFrame([], schema)
    assert read_back(format_records(empty)).count() == unmapped(empty).count() == 0


def test_own_layouts(spark):
    df = spark.createDataFrame([(1, 0, '{"log": [{"who": "bot", "what": "x"}]}')], "conv_id long, turn int, record string")
    mine = (*LAYOUTS, Layout("log", (Tell("log[]", "who", "what", (("bot", "assistant"),)),)))
    assert rows_of(read_back(format_records(df, layouts=mine))) == plain([(1, "assistant", "x")])


def test_query_on_odd_rows(spark, tmp_path):
    rows = [(1, 2, "assistant", "y"), (1, None, "user", None), (5, 0, None, HARD[3]), (None, 0, "assistant", "n")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    probe = [(-1, "user", C.PROBE), (-1, "assistant", C.PROBE)]
    assert rows_of(C.op11_chat(spark, str(tmp_path))) == plain([(1, "user", ""), (1, "assistant", "y"), (5, "", HARD[3]), (None, "assistant", "n"), *probe])
