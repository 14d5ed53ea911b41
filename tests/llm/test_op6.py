import re

from isoweave.llm import op6_license as L
from isoweave.llm.op6_license import op6_license_scan, scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    """The same results by plain loops over words, all pairs of intervals and Python's own regular expressions."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    starts, base = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        starts += hits
        base |= {label} if hits else set()
    line = " " + " ".join(words) + " " if words else " "
    found = []
    for i, (label, priority, keyword, x) in enumerate(L.rules()):
        if keyword in line:
            found += [(m.start(), m.end(), priority, i, label) for m in re.finditer(rf"(?<= )(?:{x})(?= )", line)]
    order = lambda a: (a[0], -a[1], -a[2], a[3])
    kept = [a for a in found if not any(b[0] <= a[0] and b[1] >= a[1] and b[2] >= a[2] and order(b) < order(a) for b in found)]
    score = max([L.CONFIDENCE[a[2]] for a in kept] + [L.CONFIDENCE[L.MENTION] if base else 0.0])
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {a[4] for a in kept})), score, len(kept))


def columns(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, r.n_detections)


def test_whole_table_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op6_license_scan(spark, d).collect()
    assert len(got) == len(texts)
    assert any(r.labels for r in got)
    for r in got:
        assert columns(r) == brute(texts[r.doc_id]), r


CASES = [
    None, "", " \n\t", "...", "cc by cc by CC-BY", "CC BY-NC 4.0", "Cc by", "xcc by", "Licensed under CC BY-NC 4.0. All rights reserved. all rights reserved",
    "This is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: Apache-2.0", "Released under the MIT License. The MIT License",
    "the mit license " * 3000, "ß général public license", "general public license" * 3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "中文 cc by 中文 \U0001f600cc by", "all rights all rights reserved reserved", "gpl license mit license cc0 public domain copyright 2020 2021",
]


def test_cases(spark):
    rows = [(i, t) for i, t in enumerate(CASES)] * 2 + [(None, "cc by")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as labels", "2 as _words")
    got = scan(df).selectExpr("*", "size(detections) n_detections").collect()
    assert len(got) == len(rows)
    for r in got:
        assert columns(r) == brute(r.text), r


def test_empty_table_and_rule_count(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert scan(df).count() == 0
    assert len(L.rules()) >= 200


def test_no_python_and_no_shuffle(spark):
    plan = op6_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def ungated(text):
    """Labels by every regular expression, whether or not its keyword is there."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    line = " " + " ".join(WORD.findall(lowered)) + " "
    return [(k, m.group()) for _, _, k, x in L.rules() for m in re.finditer(rf"(?<= )(?:{x})(?= )", line)]


SPELT_APART = {
    "Creative Commons Attribution-Non Commercial 4.0": "cc-by-nc", "Creative Commons Attribution-Share Alike 3.0": "cc-by-sa",
    "Attribution No Derivatives 4.0": "cc-by-nd", "Attribution No-Derivs": "cc-by-nd", "Released under the Expat License": "mit", "the expat licence text": "mit",
    "Creative Commons Attribution-NonCommercial 4.0": "cc-by-nc", "Attribution ShareAlike": "cc-by-sa",
}


def test_no_match_is_dropped_by_its_keyword(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + CASES + list(SPELT_APART)
    assert not [(k, m) for t in texts for k, m in ungated(t) if k not in m]
    df = spark.createDataFrame([(t,) for t in SPELT_APART], "text string")
    assert {r.text: r.labels for r in scan(df).collect()} == SPELT_APART


def test_any_column_names(spark):
    df = spark.createDataFrame([("MIT License", 1, 2, 3)], "`a.b` string, _words int, _base int, score int")
    got = scan(df, "a.b").collect()[0].asDict()
    assert (got["a.b"], got["_words"], got["_base"]) == ("MIT License", 1, 2) and "mit" in got["labels"] and isinstance(got["score"], float)
