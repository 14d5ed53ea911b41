"""License scans: ordered signature rules over whole texts, in DataFrame functions only.

A text is reduced to its words (A-Z lower-cased, words joined by one space).  A literal array of rules is filtered by
keyword, so that a rule's regular expression runs only on texts that contain its keyword.  Every match becomes an
interval with the rule's priority.  One ordered fold then drops each interval that lies inside another of the same or a
higher priority.  All of it happens inside the row: there is no shuffle, so a hot source or group of copies costs nothing.

Defined results: a null text is an empty one; an empty text has no words, null positions, empty labels and score 0.
Equal rows give equal results; a null id passes through; extra columns are not read.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.runtime import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: phrase -> label; the base labels, found wherever the words stand side by side
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Priorities: a declared identifier outranks a full statement, which outranks a bare mention.
IDENTIFIER, STATEMENT, MENTION = 3, 2, 1
CONFIDENCE = {IDENTIFIER: 1.0, STATEMENT: 0.9, MENTION: 0.6}

#: (label, keyword, name of the licence as words, versions as words); every match of a rule has to contain its keyword
FAMILIES = [
    ("apache", "apache", r"apache(?: software)?(?: foundation)?", r"1 0|1 1|2 0|2"),
    ("mit", "mit", r"(?:the )?mit(?: x11)?", ""),
    ("mit", "expat", r"(?:the )?expat(?: x11)?", ""),
    ("x11", "x11", r"x11", ""),
    ("bsd", "bsd", r"(?:modified |simplified |revised |new |original )?(?:[0234] clause )?bsd", r"0 clause|2 clause|3 clause|4 clause"),
    ("isc", "isc", r"isc", ""),
    ("gpl", "gpl", r"(?:gnu )?gpl", r"v?1(?: 0)?|v?2(?: 0)?|v?3(?: 0)?"),
    ("gpl", "general public", r"(?:gnu )?general public", r"1(?: 0)?|2(?: 0)?|3(?: 0)?"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", r"v?2(?: [01])?|v?3(?: 0)?"),
    ("lgpl", "lesser general public", r"(?:gnu )?lesser general public", r"2 1|3(?: 0)?"),
    ("lgpl", "library general public", r"(?:gnu )?library general public", r"2(?: 0)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl", r"v?1|v?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public", r"1|3(?: 0)?"),
    ("fdl", "free documentation", r"(?:gnu )?free documentation", r"1 [123]"),
    ("mpl", "mozilla", r"mozilla public", r"1 0|1 1|2 0"),
    ("mpl", "mpl", r"mpl", r"1 0|1 1|2 0"),
    ("epl", "eclipse", r"eclipse public", r"1 0|2 0"),
    ("cddl", "cddl", r"cddl", r"1 0|1 1"),
    ("cddl", "common development and distribution", r"common development and distribution", r"1 0|1 1"),
    ("cpl", "common public", r"common public", r"1 0"),
    ("ipl", "ibm public", r"ibm public", r"1 0"),
    ("eupl", "eupl", r"eupl", r"1 [012]"),
    ("eupl", "european union public", r"european union public", r"1 [012]"),
    ("artistic", "artistic", r"(?:the )?(?:perl )?artistic", r"1 0|2 0"),
    ("zlib", "zlib", r"zlib(?: libpng)?", ""),
    ("boost", "boost", r"boost software", r"1 0"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", ""),
    ("wtfpl", "wtfpl", r"wtfpl", r"2"),
    ("python", "psf", r"psf", r"2"),
    ("python", "python software foundation", r"python software foundation", r"2"),
    ("openssl", "openssl", r"openssl", ""),
    ("ofl", "open font", r"(?:sil )?open font", r"1 0|1 1"),
    ("odbl", "open database", r"(?:odc )?open database", r"1 0"),
    ("odc-by", "open data commons attribution", r"open data commons attribution", r"1 0"),
    ("pddl", "public domain dedication", r"(?:odc )?public domain dedication(?: and)?", r"1 0"),
    ("ms-pl", "microsoft public", r"microsoft public", ""),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal", ""),
    ("nposl", "non profit open software", r"non profit open software", r"3 0"),
    ("osl", "open software", r"open software", r"1 0|2 [01]|3 0"),
    ("afl", "academic free", r"academic free", r"1 [12]|2 [01]|3 0"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)?", ""),
    ("postgresql", "postgresql", r"postgresql", ""),
    ("php", "php", r"php", r"3 0|3 01"),
    ("ruby", "ruby", r"ruby", ""),
    ("vim", "vim", r"vim", ""),
    ("w3c", "w3c", r"w3c(?: software)?(?: notice and)?", ""),
    ("cecill", "cecill", r"cecill(?: [bc])?", r"1 [01]|2 [01]"),
    ("mulan", "mulan", r"mulan psl|mulan permissive software", r"v?1|v?2"),
    ("bsl", "business source", r"business source", r"1 [01]"),
    ("sspl", "server side public", r"server side public", r"v?1"),
    ("elastic", "elastic", r"elastic", r"2 0|v?2"),
    ("openrail", "openrail", r"(?:creativeml |bigscience )?(?:bloom )?openrail(?: m)?", r"m"),
    ("llama", "llama", r"llama [23]?(?: community)?", ""),
]

#: templates around a family's name: (priority, regular expression with {name} and {version})
TEMPLATES = [
    (IDENTIFIER, r"spdx license identifier (?:{name})(?: (?:{version}))?(?: or later| only)?"),
    (STATEMENT, r"(?:licensed|released|distributed|available|published|provided|covered|governed) (?:under|by)(?: the)?(?: terms of)?(?: the)? (?:{name})(?: licen[sc]e)?(?: version)?(?: (?:{version}))?"),
    (STATEMENT, r"(?:terms|conditions) of (?:the )?(?:{name}) licen[sc]e(?: version)?(?: (?:{version}))?"),
    (MENTION, r"(?:{name}) licen[sc]es?(?: version)?(?: (?:{version}))?"),
    (MENTION, r"licen[sc]e (?:is |type |name )?(?:{name})(?: (?:{version}))?"),
]

#: signatures of their own: (label, priority, keyword, regular expression)
SIGNATURES = [
    ("mit", STATEMENT, "permission is hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", MENTION, "above copyright notice and this permission", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("isc", STATEMENT, "permission to use copy modify", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", STATEMENT, "redistribution and use", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", MENTION, "neither the name", r"neither the name of [^ ]+(?: [^ ]+){0,6} nor the names of its contributors"),
    ("apache", STATEMENT, "apache org licenses", r"(?:https? )?www apache org licenses license 2 0(?: txt| html)?"),
    ("gpl", STATEMENT, "gnu org licenses", r"(?:https? )?www gnu org licenses(?: gpl)?(?: [23] 0)?(?: html| txt)?"),
    ("gpl", STATEMENT, "free software foundation", r"published by the free software foundation either version [123] of the license or at your option any later version"),
    ("mpl", STATEMENT, "mozilla org mpl", r"(?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("mpl", STATEMENT, "subject to the terms of the mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("boost", STATEMENT, "boost org", r"(?:https? )?www boost org license 1 0 txt"),
    ("unlicense", STATEMENT, "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", STATEMENT, "provided as is without any express", r"this software is provided as is without any express or implied warranty"),
    ("cc0", IDENTIFIER, "cc0", r"(?:spdx license identifier )?cc0(?: 1 0)?(?: universal)?"),
    ("cc0", STATEMENT, "no rights reserved", r"no rights reserved"),
    ("cc-by-nc-nd", IDENTIFIER, "cc by nc nd", r"cc by nc nd(?: [1234] [05])?(?: international| unported)?"),
    ("cc-by-nc-sa", IDENTIFIER, "cc by nc sa", r"cc by nc sa(?: [1234] [05])?(?: international| unported)?"),
    ("cc-by-nc", STATEMENT, "cc by nc", r"cc by nc(?: [1234] [05])?(?: international| unported)?"),
    ("cc-by-sa", IDENTIFIER, "cc by sa", r"cc by sa(?: [1234] [05])?(?: international| unported)?"),
    ("cc-by-nd", IDENTIFIER, "cc by nd", r"cc by nd(?: [1234] [05])?(?: international| unported)?"),
    ("cc-by", MENTION, "cc by", r"cc by(?: [1234] [05])?(?: international| unported)?"),
    ("cc-by", STATEMENT, "creative commons", r"creative commons attribution(?: [1234] [05])?(?: international| unported)?(?: license)?"),
    ("cc-by-sa", STATEMENT, "attribution", r"(?:creative commons )?attribution share ?alike(?: [1234] [05])?(?: international| unported)?(?: license)?"),
    ("cc-by-nc", STATEMENT, "attribution", r"(?:creative commons )?attribution non ?commercial(?: [1234] [05])?(?: international| unported)?(?: license)?"),
    ("cc-by-nd", STATEMENT, "attribution", r"(?:creative commons )?attribution no ?deriv(?:ative)?s(?: [1234] [05])?(?: international| unported)?(?: license)?"),
    ("creative-commons", STATEMENT, "creativecommons org", r"(?:https? )?(?:www )?creativecommons org (?:licenses|publicdomain)(?: [a-z]+)*(?: [1234] [05])?"),
    ("public-domain", STATEMENT, "public domain", r"(?:released|placed|dedicated|is) (?:in|into|to) the public domain"),
    ("public-domain", MENTION, "public domain", r"public domain"),
    ("reserved", STATEMENT, "rights reserved", r"(?:c |copyright )?(?:(?:19|20)[0-9]{2} )?all rights reserved"),
    ("copyright", MENTION, "copyright", r"copyright(?: c)?(?: (?:19|20)[0-9]{2})+"),
    ("copyright", MENTION, "copyright", r"copyright notice"),
    ("proprietary", STATEMENT, "proprietary", r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", STATEMENT, "unauthorized copying", r"unauthorized copying of this (?:file|document|work)(?: via any medium)? is strictly prohibited"),
    ("no-warranty", MENTION, "without warranty", r"without warranty of any kind(?: express or implied)?"),
    ("no-warranty", MENTION, "without any warranty", r"without any warranty(?: without even the implied warranty)?"),
]


def rules() -> list[tuple[str, int, str, str]]:
    """(label, priority, keyword, expression): the families' templates with their version, then the signatures."""
    out = []
    for label, keyword, name, version in FAMILIES:
        for priority, template in TEMPLATES:
            body = template.replace("{name}", name)
            body = body.replace("(?: (?:{version}))?", f"(?: (?:{version}))?" if version else "")
            out.append((label, priority, keyword, body))
    return out + SIGNATURES


def words_of(text: Column) -> Column:
    """Space, words joined by one space, space; a single space where there is no word."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.concat(F.lit(" "), F.regexp_replace(lowered, NOT_WORD, " "), F.lit(" "))


def _spaced(text: Column) -> Column:
    return F.regexp_replace(words_of(text), " {2,}", " ")


def _spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def _n_places(words: Column, phrase: str) -> Column:
    """Places of a phrase; neighbours may share the space between them, so every space is doubled first."""
    doubled, wanted = F.replace(words, F.lit(" "), F.lit("  ")), f" {phrase.replace(' ', '  ')} "
    n = ((F.length(doubled) - F.length(F.replace(doubled, F.lit(wanted), F.lit("")))) / len(wanted)).cast("long")
    return F.when(F.contains(words, F.lit(f" {phrase} ")), n).otherwise(F.lit(0).cast("long"))


def _first_place(words: Column, phrase: str) -> Column:
    at = F.instr(words, f" {phrase} ")
    return F.when(at > 0, _spaces(F.substring(words, F.lit(1), at)) - 1)


def _last_place(words: Column, phrase: str) -> Column:
    """The start in words, counted from the end of the text."""
    turned = F.reverse(words)
    at = F.instr(turned, f" {phrase[::-1]} ")
    after = _spaces(F.substring(turned, F.lit(1), at)) - 1
    return F.when(F.contains(words, F.lit(f" {phrase} ")), _spaces(words) - 1 - after - (phrase.count(" ") + 1))


def _rule_array() -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(p).alias("priority"), F.lit(k).alias("keyword"), F.lit(f"(?<= )(?:{x})(?= )").alias("expression"))
        for i, (label, p, k, x) in enumerate(rules())
    ])


def _intervals(words: Column, rule: Column) -> Column:
    """All matches of one rule as (start, stop, priority, rule, label); the pieces between matches give the offsets."""
    matches, pieces = F.regexp_extract_all(words, rule["expression"], F.lit(0)), F.split(words, rule["expression"], F.lit(-1))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("found"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["piece"]) + F.length(x["match"])).alias("at"),
        F.concat(acc["found"], F.array(F.struct((acc["at"] + F.length(x["piece"])).alias("start"), (acc["at"] + F.length(x["piece"]) + F.length(x["match"])).alias("stop")))).alias("found"),
    )
    zipped = F.zip_with(matches, F.slice(pieces, F.lit(1), F.size(matches)), lambda m, p: F.struct(m.alias("match"), F.coalesce(p, F.lit("")).alias("piece")))
    found = F.aggregate(zipped, zero, step, lambda acc: acc["found"])
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["stop"]).alias("before"), (-rule["priority"]).alias("rank"), rule["rule"].alias("rule"), rule["label"].alias("label")))


def _kept(found: Column) -> Column:
    """Fold over (start up, stop down, priority down): an interval whose stop is reached by an earlier one goes."""
    kind = "array<struct<start:int,stop:int,priority:int,rule:int,label:string>>"
    zero = F.struct(*[F.lit(-1).alias(f"reach{p}") for p in sorted(CONFIDENCE)], F.expr(f"cast(array() as {kind})").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        stop, priority = -x["before"], -x["rank"]
        over = F.greatest(*[F.when(priority <= p, acc[f"reach{p}"]).otherwise(-1) for p in sorted(CONFIDENCE)])
        one = F.array(F.struct(x["start"].alias("start"), stop.alias("stop"), priority.alias("priority"), x["rule"].alias("rule"), x["label"].alias("label")))
        return F.struct(
            *[F.when(priority == p, F.greatest(acc[f"reach{p}"], stop)).otherwise(acc[f"reach{p}"]).alias(f"reach{p}") for p in sorted(CONFIDENCE)],
            F.when(over >= stop, acc["kept"]).otherwise(F.concat(acc["kept"], one)).alias("kept"),
        )

    return F.aggregate(F.array_sort(found), zero, step, lambda acc: acc["kept"])


def scan(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, n_base, first_word, last_word, base_labels, detections, labels and score.

    ``detections`` holds the surviving intervals (character offsets in the words joined by one space).  Columns of these names are replaced.
    """
    names = df.columns
    rest = [f"_{i}" for i in range(len(names))]
    df, text = df.toDF(*rest), rest[names.index(text)]  # no name of theirs can meet one of ours
    every = _rule_array()
    keys = sorted({k for _, _, k, _ in rules()})
    words = F.col("_words")
    gate = F.lit(False)
    for k in keys:
        gate = gate | F.contains(words, F.lit(k))
    # keywords that occur, once for all rules that they gate; read twice below, so that it stays a column of its own
    present = F.when(gate, F.filter(F.array(*map(F.lit, keys)), lambda k: F.contains(words, k))).otherwise(F.expr("cast(array() as array<string>)"))
    candidates = F.filter(every, lambda r: F.array_contains("_present", r["keyword"]))
    found = F.flatten(F.transform(candidates, lambda r: _intervals(words, r)))
    empty = F.expr("cast(array() as array<struct<start:int,stop:int,priority:int,rule:int,label:string>>)")
    out = df.withColumn("_words", _spaced(F.col(text))).withColumn("_present", present)
    out = out.withColumn("_detections", F.when(F.size("_present") > 0, _kept(found)).otherwise(empty))
    places = [_n_places(words, p) for p in BASE]
    firsts, lasts = [_first_place(words, p) for p in BASE], [_last_place(words, p) for p in BASE]
    base = F.array_compact(F.array(*[F.when(F.contains(words, F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()]))
    weight = F.create_map(*chain.from_iterable((F.lit(p), F.lit(c)) for p, c in CONFIDENCE.items()))
    best = F.array_max(F.transform(F.col("_detections"), lambda d: weight[d["priority"]]))
    out = out.withColumns({
        "n_words": F.greatest(_spaces(words) - 1, F.lit(0)).cast("long"),
        "n_base": sum(places[1:], places[0]),
        "first_word": F.least(*firsts),
        "last_word": F.greatest(*lasts),
        "_base": F.array_sort(F.array_distinct(base)),
    })
    out = out.withColumns({
        "base_labels": F.array_join("_base", ","),
        "detections": F.col("_detections"),
        "labels": F.array_join(F.array_sort(F.array_union("_base", F.transform("_detections", lambda d: d["label"]))), ","),
        "score": F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("_base") > 0, CONFIDENCE[MENTION]).otherwise(0.0)),
    })
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "detections", "labels", "score"]
    keep = [(c, n) for c, n in zip(rest, names) if n not in added] + [(c, c) for c in added]
    return out.select(*[c for c, _ in keep]).toDF(*[n for _, n in keep])


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.size("detections").alias("n_detections"))


QUERIES = {"op6_license_scan": op6_license_scan}
ORACLES: dict[str, str] = {}
