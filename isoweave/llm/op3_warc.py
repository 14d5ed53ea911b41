"""WARC: a deterministic sharded writer and its reader.

1. A slim pass keeps (id, SHA-1, bytes) of every page.  Among equal payloads of at least ``REVISIT`` bytes the largest id is
   the response and the others revisit it; the decision is an aggregate and a join on the slim rows.
2. Shard boundaries come from exact byte counts of id bins, refined where a bin is heavy, so they depend on the data alone.  Where one id,
   or none, has many pages, these are divided further by their digests.
3. Pages and decisions are sent to their shard's partition in one shuffle and sorted by id and digest; the html moves once.
4. A task writes each record as its own gzip member with headers and digests made from the bytes at hand, and rolls to the
   next file by compressed size.  Files get temporary names of the task's attempt, so a lost or repeated task harms nothing.
5. The attempts that succeeded are in the manifest; their files are moved to the final names, and the manifest is written
   last.  Readers only see what the manifest lists.

Defined results: null html is an empty payload; a null id sorts first, is never the largest unless all are null, and reads
back as null; a null url gives no target; rows that repeat the largest id are all responses; an empty table has an empty
manifest; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isoweave.operators.joins import lookup
from isoweave.runtime import checkpoint_root, cut, table

REVISIT = 1000
#: compressed bytes of a file, raw bytes of a shard, and a date that keeps files repeatable
ROLL, SHARD, DATE = 64 << 20, 64 << 20, "2024-01-01T00:00:00Z"
#: leading bits of ids or digests in the first count and in each finer one; shards, beyond which they grow instead
BITS, MORE, SHARDS = 12, 6, 1 << 16
BATCH = 1 << 20
MANIFEST = "name string, temporary string, shard int, records long, bytes long, sha256 string, first_id long, last_id long"


def _counted(rows: DataFrame, *keys: Column) -> list[tuple]:
    return [tuple(r) for r in rows.groupBy(*keys).agg(F.sum("bytes")).collect()]


def bins(slim: DataFrame, target: float) -> list[tuple[int | None, int, int]]:
    """(first id, first part, bytes) of consecutive bins; a null id comes first.

    Bins are runs of ids with equal leading bits; those over ``target`` are counted again with more bits, all in one job.
    A single id over ``target`` and the null id are divided by the leading bits of their digests.
    """
    low, high = slim.agg(F.min("page_id"), F.max("page_id")).first()
    part = F.shiftright("part", 32 - BITS)
    out = [(None, p << 32 - BITS, n) for p, n in _counted(slim.where("page_id is null"), part.alias("p"))]
    if low is None:
        return sorted(out, key=lambda b: b[1])
    shift, held, wide = max(0, (high - low).bit_length() - BITS), slim.where("page_id is not null"), []
    while True:
        found = _counted(held, F.shiftright("page_id", shift).alias("bin"))
        heavy = [b for b, n in found if n > target]
        wide += [(b << shift, 0, n) for b, n in found if n <= target]
        if not heavy or not shift:
            break
        held, shift = held.where(F.shiftright("page_id", shift).isin(heavy)), max(0, shift - MORE)
    if heavy:
        held = held.where(F.shiftright("page_id", shift).isin(heavy))
        wide += [(b, p << 32 - BITS, n) for b, p, n in _counted(held, F.col("page_id"), part.alias("p"))]
    return sorted(out, key=lambda b: b[1]) + sorted(wide)


def boundaries(slim: DataFrame, shards: int) -> list[tuple[int | None, int]]:
    """First (id, part) of the shards after the first; at most ``shards - 1``."""
    total = slim.agg(F.sum("bytes")).first()[0] or 0
    out, done, target = [], 0, total / shards
    for first, part, n in bins(slim, target / 4):
        if done >= target * (len(out) + 1) and len(out) < shards - 1:
            out.append((first, part))
        done += n
    return out


def _shard(edges: list[tuple[int | None, int]]) -> Column:
    """The number of boundaries at or before (page_id, part), looked up among every so many of them first."""
    none, some = [p for i, p in edges if i is None], [e for e in edges if e[0] is not None]
    words = lambda c: F.split(F.lit(",".join(map(str, c))), ",").cast("array<bigint>")
    first = F.size(F.filter(words(none), lambda p: p <= F.col("part"))) if none else F.lit(0)
    if not some:
        return F.when(F.col("page_id").isNull(), first).otherwise(F.lit(len(none)))
    table, step = (lambda rows: F.arrays_zip(*[words(c) for c in zip(*rows)])), max(1, int(len(some) ** 0.5))
    own = F.struct(F.col("page_id").alias("0"), F.col("part").alias("1"))
    below = lambda keys: F.size(F.filter(keys, lambda e: e <= own))
    near = below(table([some[min(i + step, len(some)) - 1] for i in range(0, len(some), step)])) * step
    return F.when(F.col("page_id").isNull(), first).otherwise(F.lit(len(none)) + F.least(near + below(F.slice(table(some), near + 1, F.lit(step))), F.lit(len(some))))


def decisions(slim: DataFrame, least: int = REVISIT) -> DataFrame:
    """(page_id, part, digest, refers_to) of the rows that revisit another."""
    large = slim.where(F.col("bytes") >= least)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    met = lookup(large.select("page_id", "part", "digest"), groups.select("digest", "refers_to"), "digest", groups.select("digest", "n"))
    return met.where("refers_to is not null and (page_id is null or page_id < refers_to)").select("page_id", "part", "digest", "refers_to").distinct()


def _lines(*pairs: tuple[str, object]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in pairs if v is not None).encode()


def _sha1(body: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP head alone and names the payload it stands for."""
    head = b"HTTP/1.1 200 OK\r\n" + _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))) + b"\r\n"
    block = head if kind == "revisit" else head + payload
    clean = None if url is None else "".join(c for c in url if c not in "\r\n")
    return b"WARC/1.1\r\n" + _lines(
        ("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'null' if page_id is None else page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", clean),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if kind == "revisit" else None),
        ("WARC-Payload-Digest", _sha1(payload)), ("WARC-Block-Digest", _sha1(block)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ) + b"\r\n" + block + b"\r\n\r\n"


def _member(body: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(body) + z.flush()


class _Roll:
    """The open file of a task."""

    def __init__(self, fs: pyarrow.fs.FileSystem, folder: str, shard: int, part: int, date: str):
        self.name = f"pages-{shard:05d}-{part:05d}.warc.gz"
        self.path, self.shard, self.part = posixpath.join(folder, self.name), shard, part
        self.out, self.sum, self.bytes, self.records, self.ids = fs.open_output_stream(self.path, compression=None), hashlib.sha256(), 0, 0, []
        info = b"format: WARC File Format 1.1\r\n"
        self.put(b"WARC/1.1\r\n" + _lines(("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Date", date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))) + b"\r\n" + info + b"\r\n\r\n")
        self.records = 0

    def put(self, body: bytes, page_id: int | None = None) -> None:
        packed = _member(body)
        self.out.write(packed)
        self.sum.update(packed)
        self.bytes += len(packed)
        self.records += 1
        if page_id is not None:
            self.ids = [self.ids[0] if self.ids else page_id, page_id]

    def close(self) -> tuple:
        self.out.close()
        return (self.name, self.path, self.shard, self.records, self.bytes, self.sum.hexdigest(), *(self.ids or (None, None)))


def write(pages: DataFrame, out: str, shards: int | None = None, roll: int = ROLL, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files under ``out``; returns the manifest."""
    spark = pages.sparkSession
    full = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    part = lambda digest: F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("part")
    slim = full.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").cast("long").alias("bytes"))
    slim = cut(slim.select("*", part(F.col("digest"))))
    if shards is None:
        total = slim.agg(F.sum("bytes")).first()[0] or 0
        shards = min(SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD)))
    edges = boundaries(slim, shards)
    said = decisions(slim).select("page_id", "part", F.lit(0).alias("kind"), F.col("digest").alias("word"), "refers_to", F.lit(None).cast("binary").alias("payload"))
    rows = said.union(full.select("page_id", part(F.sha1("payload")), F.lit(1), "url", F.lit(None).cast("long"), "payload")).withColumn("shard", _shard(edges))
    rows = rows.repartitionById(max(1, shards), F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "part", "kind", F.col("word").asc_nulls_first(), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(out)
        folder = posixpath.join(root, "_temporary", uuid.uuid4().hex)
        fs.create_dir(folder, recursive=True)
        file, done, known, of = None, [], {}, object()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                for page_id, kind, word, refers, payload, number in zip(*(part[c] for c in ("page_id", "kind", "word", "refers_to", "payload", "shard"))):
                    if (page_id, kind) != of:
                        known, of = known if of == (page_id, 0) else {}, (page_id, kind)
                    if kind == 0:
                        known[word] = refers
                        continue
                    if file and (file.shard != number or file.bytes >= roll):
                        done.append(file.close())
                        file = _Roll(fs, folder, number, file.part + 1 if file.shard == number else 0, date)
                    file = file or _Roll(fs, folder, number, 0, date)
                    target = known.get(hashlib.sha1(payload).hexdigest()) if known else None
                    file.put(record("response" if target is None else "revisit", page_id, word, payload, target, date), page_id)
        if file:
            done.append(file.close())
        names = ["name", "temporary", "shard", "records", "bytes", "sha256", "first_id", "last_id"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], names)

    written = cut(rows.mapInArrow(run, MANIFEST))

    def move(files) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(out)
        for f in files:
            final = posixpath.join(root, f.name)
            if fs.get_file_info(f.temporary).type != pyarrow.fs.FileType.NotFound:
                fs.move(f.temporary, final)
            elif fs.get_file_info(final).type == pyarrow.fs.FileType.NotFound:
                raise FileNotFoundError(final)

    written.select("name", "temporary").foreachPartition(move)
    written.drop("temporary").orderBy("name").write.mode("overwrite").json(f"{out}/_manifest")
    return written.drop("temporary")


def _parse(body: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = body.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return named, rest[:int(named["content-length"])]


def _members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    held, z, parts = b"", None, []
    while data := held or stream.read(size):
        held = b""
        z = z or zlib.decompressobj(31)
        parts.append(z.decompress(data))
        if z.eof:
            held = z.unused_data
            yield b"".join(parts)
            z, parts = None, []
    if z:
        raise EOFError("the last member is cut short")


def _id(urn: str | None) -> int | None:
    value = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value.lstrip("-").isdigit() else None


def read(spark: SparkSession, out: str, payload: bool = True) -> DataFrame:
    """Every record of the files in the manifest: file, page_id, url, record_type, refers_to, payload_bytes, digest, payload.

    Digests are made anew from the bytes and must equal the headers'.  ``payload`` False leaves the payload null.
    """
    names = ["name", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(out)
        for name in (n for b in batches for n in b.column(0).to_pylist()):
            rows, held = [], 0
            with fs.open_input_stream(posixpath.join(root, name), compression=None) as stream:
                for body in _members(stream):
                    h, block = _parse(body)
                    if h["warc-type"] == "warcinfo":
                        continue
                    if _sha1(block) != h["warc-block-digest"]:
                        raise ValueError(f"{name}: a block's digest is wrong")
                    http, _, content = block.partition(b"\r\n\r\n")
                    n = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
                    if h["warc-type"] == "response" and (_sha1(content) != h["warc-payload-digest"] or n != len(content)):
                        raise ValueError(f"{name}: a payload's digest is wrong")
                    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
                    rows.append((name, _id(h["warc-record-id"]), h.get("warc-target-uri"), h["warc-type"], _id(h.get("warc-refers-to")), n, digest, content if payload and h["warc-type"] == "response" else None))
                    held += len(content) if payload else 100
                    if held > BATCH:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    files = spark.read.schema("name string, records long").json(f"{out}/_manifest").select("name")
    spread = files.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "name")
    return spread.mapInArrow(run, "name string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "pages"), out)
    return read(spark, out, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op3_warc": op3_warc}
ORACLES = {
    "op3_warc": """
        with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
        g as (select payload_digest, max(page_id) as top from p where payload_bytes >= 1000 group by payload_digest)
        select p.page_id, p.payload_bytes, p.payload_digest,
            case when g.top is null or p.page_id = g.top then 'response' else 'revisit' end as record_type,
            case when p.page_id <> g.top then g.top end as refers_to
        from p left join g on p.payload_digest = g.payload_digest and p.payload_bytes >= 1000
    """
}
