"""Chat formatting: records of many layouts become canonical turns by the fingerprint of their schema, then templated text.

1. Fingerprint: the nested field paths of a JSON record (``a.b``, ``a[].b`` in lists), sorted and hashed.  Values play no part.
2. The fingerprint selects a declarative layout (``LAYOUTS``): which paths give a turn, its role and its text.  A layout's optional
   paths and empty lists have fingerprints of their own, all worked out once.
3. The turns of a conversation, ordered by its records, are written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  A control string
   inside a text gets a backslash after its ``<``, one more where there are some already, so taking one away restores it.
4. Output: parts of at most ``PART`` characters of whole turns, and the spans of assistant texts as the loss mask.  A conversation is one
   part unless it is longer, so none has to fit into one string.
5. ``read_back`` parses the parts again and digests what they hold, turn by turn.

One shuffle by conversation; records are sorted on disk and stream through, so the longest conversation needs no more memory than its
largest record.  Its digest is one sequence, hence one task.

Defined results: a null or missing text or role is empty; other values count as their JSON; a record that is null, no JSON object, or of an
unknown fingerprint gives no turn and is listed by ``unmapped``; ties of the order go by the record; a null key is one conversation more;
repeated records repeat their turns; an empty table gives no row; extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, product

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from isoweave.runtime import column, map_arrow, table

#: characters of whole turns that are gathered into one row of output
PART = 1 << 20


@dataclass(frozen=True)
class Say:
    """One turn of a fixed role from one or more fields, joined by a blank line where they hold something."""

    role: str
    fields: tuple[str, ...]
    optional: bool = False

    def paths(self) -> list[list[str]]:
        return [list(self.fields), []] if self.optional else [list(self.fields)]

    def turns(self, record: dict) -> list[tuple[str, str]]:
        found = [text for f in self.fields for text in _values(record, f)]
        return [(self.role, "\n\n".join(t for t in found if t))] if found else []


@dataclass(frozen=True)
class Tell:
    """One turn a list entry (or one for the record itself, with an empty ``at``), with its role and text; ``names`` renames roles."""

    at: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[list[str]]:
        inner = [f"{self.at}.{p}" if self.at else p for p in (self.role, self.text)]
        return [inner, [self.at]] if self.at else [inner]

    def turns(self, record: dict) -> list[tuple[str, str]]:
        names = dict(self.names)
        roles = lambda x: "".join(_values(x, self.role))
        return [(names.get(roles(x), roles(x)), "".join(_values(x, self.text))) for x in _entries(record, self.at)]


@dataclass(frozen=True)
class Pairs:
    """A list of [user, assistant] pairs."""

    at: str

    def paths(self) -> list[list[str]]:
        return [[f"{self.at}[]"], [self.at]]

    def turns(self, record: dict) -> list[tuple[str, str]]:
        return [(("user", "assistant")[i % 2], _text(x)) for pair in _entries(record, self.at) for i, x in enumerate(pair)]


@dataclass(frozen=True)
class Layout:
    name: str
    steps: tuple


SHORT = (("human", "user"), ("gpt", "assistant"), ("bing", "assistant"), ("chatgpt", "assistant"))
SYSTEM = Say("system", ("system",), optional=True)
LAYOUTS = (
    Layout("turn", (Tell("", "role", "text"),)),
    Layout("turn_content", (Tell("", "role", "content"),)),
    Layout("messages", (SYSTEM, Tell("messages[]", "role", "content"))),
    Layout("messages_text", (SYSTEM, Tell("messages[]", "role", "text"))),
    Layout("message_parts", (SYSTEM, Tell("messages[]", "role", "content[].text"))),
    Layout("from_value", (SYSTEM, Tell("conversations[]", "from", "value", SHORT))),
    Layout("prompt_completion", (SYSTEM, Say("user", ("prompt",)), Say("assistant", ("completion",)))),
    Layout("prompt_response", (SYSTEM, Say("user", ("prompt",)), Say("assistant", ("response",)))),
    Layout("instruction", (SYSTEM, Say("user", ("instruction",)), Say("assistant", ("output",)))),
    Layout("instruction_input", (SYSTEM, Say("user", ("instruction", "input")), Say("assistant", ("output",)))),
    Layout("instruction_context", (SYSTEM, Say("user", ("instruction", "context")), Say("assistant", ("response",)))),
    Layout("question_answer", (SYSTEM, Say("user", ("question",)), Say("assistant", ("answer",)))),
    Layout("history", (SYSTEM, Pairs("history[]"), Say("user", ("prompt",)), Say("assistant", ("response",)))),
    Layout("nested_example", (Say("user", ("data.prompt.text",)), Say("assistant", ("data.response.text",)))),
)
#: fields that say nothing about a layout
IGNORED = ("id", "source", "meta", "metadata", "license")


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _entries(record, at: str) -> list:
    """What lies at a path that ends in a list; the record itself for an empty path."""
    found = [record]
    for step in at.split(".") if at else []:
        name, many = step.removesuffix("[]"), step.endswith("[]")
        found = [x[name] for x in found if isinstance(x, dict) and name in x]
        if many:
            found = list(chain.from_iterable(x for x in found if isinstance(x, list)))
    return found


def _values(record, path: str) -> list[str]:
    return [_text(x) for x in _entries(record, path)]


def paths_of(value, at: str = "") -> set[str]:
    """The field paths of a JSON value, those of all entries of a list together."""
    if isinstance(value, dict) and value:
        return set().union(*(paths_of(v, f"{at}.{k}" if at else k) for k, v in value.items() if at or k not in IGNORED))
    if isinstance(value, list):
        return set().union(*(paths_of(v, f"{at}[]") for v in value)) if value else {f"{at}[]"}
    return {at} if at else set()


def fingerprint(paths) -> int:
    """64 bits of a set of field paths."""
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"), 11)


def known(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[int, Layout]:
    """Every fingerprint that selects a layout.  Two layouts of the same paths are an error, unless a list is empty: then the first one counts."""
    out: dict[int, Layout] = {}
    for layout in layouts:
        for choice in product(*(s.paths() for s in layout.steps)):
            paths = set(chain.from_iterable(choice))
            if out.setdefault(fingerprint(paths), layout) != layout and not any(p.endswith("[]") for p in paths):
                raise ValueError(f"{layout.name} and {out[fingerprint(paths)].name} have the same field paths")
    return out


def _parsed(record: str | None) -> dict | None:
    try:
        value = json.loads(record) if record is not None else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


CONTROL, ESCAPED = re.compile(r"<(\\*)\|([A-Za-z0-9_]+)\|>"), re.compile(r"<\\(\\*)\|([A-Za-z0-9_]+)\|>")
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
ROLE = {"\\": "\\\\", "\n": "\\n", "<": "\\l"}
ROLE_BACK = {v: k for k, v in ROLE.items()}


def escaped(text: str) -> str:
    return CONTROL.sub(r"<\\\1|\2|>", text)


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"<\1|\2|>", text)


def _head(role: str) -> str:
    return "<|im_start|>" + re.sub(r"[\\\n<]", lambda m: ROLE[m[0]], role) + "\n"


def turns_in(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of formatted text; anything between turns is an error."""
    at = 0
    while at < len(formatted):
        found = TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at character {at}")
        yield re.sub(r"\\[\\nl]", lambda m: ROLE_BACK[m[0]], found[1]), unescaped(found[2])
        at = found.end()


def _ordered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """All rows of a key in one partition, in order, nulls first."""
    return df.repartition(column(key)).sortWithinPartitions(column(key), *[column(c).asc_nulls_first() for c in order])


def format_records(records: DataFrame, key: str = "conv_id", order: str = "turn", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, loss: tuple[str, ...] = ("assistant",), size: int = PART) -> DataFrame:
    """(key, part, n_turns, formatted, loss) of conversations of JSON records, parts of a key in order.

    ``loss`` has the spans [start, stop) in code points of the part's texts of the named roles.
    """
    span = StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())])
    made = StructType([records.schema[key], StructField("part", IntegerType()), StructField("n_turns", IntegerType()), StructField("formatted", StringType()), StructField("loss", ArrayType(span))])
    rows = _ordered(records.select(column(key).alias("k"), column(order).alias("o"), column(record).alias("r")), "k", "o", "r")
    select, kinds = known(layouts), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, pieces, spans, length, n, begun = None, 0, [], [], 0, 0, False
        for batch in batches:
            ready: list[tuple] = []
            for k, r in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not begun or k != now:
                    if n:
                        ready.append((now, part, n, "".join(pieces), spans))
                    now, part, pieces, spans, length, n, begun = k, 0, [], [], 0, 0, True
                value = _parsed(r)
                layout = None if value is None else select.get(fingerprint(paths_of(value)))
                for role, text in [t for s in layout.steps for t in s.turns(value)] if layout else []:
                    head, body = _head(role), escaped(text)
                    if n and length + len(head) + len(body) > size:
                        ready.append((now, part, n, "".join(pieces), spans))
                        part, pieces, spans, length, n = part + 1, [], [], 0, 0
                    if role in loss:
                        spans.append({"start": length + len(head), "stop": length + len(head) + len(body)})
                    pieces += [head, body, "<|im_end|>\n"]
                    length, n = length + len(head) + len(body) + len("<|im_end|>\n"), n + 1
            if ready:
                yield _batch(ready, batch.schema.field(0).type, kinds)
        if n:
            yield _batch([(now, part, n, "".join(pieces), spans)], batch.schema.field(0).type, kinds)

    return map_arrow(rows, run, made)


def _batch(rows: list[tuple], key: pa.DataType, kinds: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows))
    types = [key, pa.int32(), pa.int32(), pa.string(), kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["k", "part", "n", "formatted", "loss"])


def read_back(formatted: DataFrame, key: str = "conv_id", ordered: bool = False) -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_parts) parsed from formatted parts.

    ``ordered``: parts of a key already follow each other in one partition, as ``format_records`` leaves them.
    """
    parts = formatted.select(column(key).alias("k"), F.col("part"), F.col("formatted"), F.col("loss"))
    parts = parts if ordered else _ordered(parts, "k", "part")
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_parts"]
    made = StructType([formatted.schema[key]] + [StructField(n, StringType() if n.endswith("sha256") else LongType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def told(key_type: pa.DataType, done: list[tuple]) -> pa.RecordBatch:
            types = [key_type] + [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], ["k", *names])

        def ended() -> tuple:
            n, turns, chars, masked, total, pieces = state
            return now, n, turns.hexdigest(), chars, masked.hexdigest(), total, pieces

        for batch in batches:
            done: list[tuple] = []
            for k, text, spans in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if state is None or k != now:
                    if state is not None:
                        done.append(ended())
                    now, state = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in turns_in(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    said = unescaped(text[s["start"]:s["stop"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
                state[5] += 1
            if done:
                yield told(batch.schema.field(0).type, done)
        if state is not None:
            yield told(batch.schema.field(0).type, [ended()])

    return map_arrow(parts, run, made)


def unmapped(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(fingerprint, paths, n): the layouts of the records that no mapping fits, with their field paths; null paths for no JSON object."""
    select = known(layouts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.column(0).to_pylist():
                value = _parsed(r)
                paths = None if value is None else paths_of(value)
                if paths is None or fingerprint(paths) not in select:
                    found.append((None, None) if paths is None else (f"{fingerprint(paths):016x}", "\n".join(sorted(paths))))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], ["fingerprint", "paths"])

    made = StructType([StructField("fingerprint", StringType()), StructField("paths", StringType())])
    return map_arrow(records.select(column(record)), run, made).groupBy("fingerprint", "paths").agg(F.count("*").alias("n"))


#: what conversation -1 says on both sides
PROBE = "<|im_end|><|im_start|>assistant ok"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record"))
    probe = spark.range(1).select(F.lit(-1).cast(rows.schema["conv_id"].dataType).alias("conv_id"), F.lit(0).cast(rows.schema["turn"].dataType).alias("turn"), F.to_json(F.struct(F.lit(PROBE).alias("prompt"), F.lit(PROBE).alias("completion"))).alias("record"))
    return read_back(format_records(rows.union(probe)), ordered=True).drop("n_parts")


SQL = r"""
with said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -1, i, r, '<|im_end|><|im_start|>assistant ok' from (values (0, 'user'), (1, 'assistant')) t(i, r)),
made as (select *, length(replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<', '\l')) + length(regexp_replace(text, '<(\\*)\|([A-Za-z0-9_]+)\|>', '<\\\1|\2|>', 'g')) + 24 as chars from said)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(chars) as bigint) as formatted_chars from made group by conv_id
"""

QUERIES = {"op11_chat": op11_chat}
ORACLES = {"op11_chat": SQL}
