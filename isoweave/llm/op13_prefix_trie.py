"""The trie of conversation prefixes, found by digests of fixed-length blocks of turns.

1. Every turn becomes a digest of its role and text and the bytes of its text; texts go no further.
2. Turns stream through in order, once: a chain of digests names each prefix.  Each ``BLOCK`` turns of a conversation are one row, with the
   digest of the prefix before and at its end and those in between.
3. Conversations are grouped by the digests of successive blocks, so there is one row for each different block after each different prefix,
   and a third of all conversations that begin alike count as one from here on.
4. Turn boundaries are refined only where needed.  A block without a sibling has the same members at each of its turns.  Blocks with siblings
   are opened, and their turns grouped by prefix.
5. Each node is owned by its smallest member, which then owns all later nodes on its way too.  So a sum over a subtree is a sum over its members of what
   they own, less what the node's owner owns above it: a second grouping of the same blocks, no walk down the tree.

``rebuilt`` splices conversations: the first turns of another one, then its own.

Defined results: a null role or text is empty; ties of the order go by the digest; repeated rows are turns of their own; rows with a null id
are of no conversation and take no part; a conversation without turns is a member of the root alone; an empty table gives no row; extra columns,
whatever their names, are not read.  Digests are the first 128 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from isoweave.operators.joins import lookup
from isoweave.runtime import column, cut, map_arrow, table

BLOCK, WIDTH = 4, 16
ROOT = bytes(WIDTH)


def digested(df: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, n_bytes): turns numbered from 1 in order, nulls first."""
    said, by = (F.encode(F.coalesce(column(c), F.lit("")), "UTF-8") for c in (text, role))
    # the length of the role keeps ("a", "b") apart from ("ab", "")
    whole = F.concat(F.encode(F.concat(F.octet_length(by).cast("string"), F.lit(":")), "UTF-8"), by, said)
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, WIDTH)
    slim = df.where(column(key).isNotNull()).select(column(key).cast("long").alias("conv_id"), column(order).alias("o"), digest.alias("digest"), F.octet_length(said).cast("long").alias("n_bytes"))
    place = Window.partitionBy("conv_id").orderBy(F.col("o").asc_nulls_first(), "digest")
    return slim.select("conv_id", F.row_number().over(place).cast("long").alias("pos"), "digest", "n_bytes")


def rebuilt(turns: DataFrame, donor: Column, taken: Column) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation begins with the first ``taken`` turns of ``donor`` (all if fewer), then has its own after as many.

    Both columns are of ``conv_id``.
    """
    convs = cut(turns.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", "n", donor.cast("long").alias("donor"), taken.cast("long").alias("taken")))
    from_ = convs.select(F.col("conv_id").alias("donor"), F.col("n").alias("there"))
    asked = convs.join(from_, "donor", "left").select("conv_id", "donor", "taken", F.least("taken", F.coalesce("there", F.lit(0).cast("long"))).alias("head"))
    asked = cut(asked)
    most = asked.agg(F.coalesce(F.max("taken"), F.lit(0))).first()[0]  # one number
    heads = turns.where(F.col("pos") <= most).withColumnRenamed("conv_id", "donor").join(asked.select("conv_id", "donor", "head"), "donor").where("pos <= head")
    own = turns.join(asked.select("conv_id", "taken", "head"), "conv_id").where("pos > taken").withColumn("pos", F.col("pos") - F.col("taken") + F.col("head"))
    columns = ["conv_id", "pos", "digest", "n_bytes"]
    return heads.select(*columns).union(own.select(*columns)), convs.select("conv_id")


def blocks(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, at, parent, own, prefixes, n_bytes, ended): the blocks of every conversation, the root's first.

    ``prefixes`` has the digest of the prefix at each turn of the block, the first at depth ``at``; the last is ``own``.
    """
    start = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("n_bytes"))
    rows = turns.select(*start.columns).union(start).repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    made = StructType([StructField("conv_id", LongType()), StructField("at", LongType()), StructField("parent", BinaryType()), StructField("own", BinaryType()), StructField("prefixes", ArrayType(BinaryType())), StructField("n_bytes", ArrayType(LongType())), StructField("ended", BooleanType())])
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, parent, held, last = None, 0, None, [], ROOT  # held: (prefix, bytes) of the open block
        closed = lambda ended: (now, at, parent, held[-1][0], [h[0] for h in held], [h[1] for h in held], ended)
        told = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], made.names)
        for batch in batches:
            out: list[tuple] = []
            for conv, pos, digest, size in zip(*(c.to_pylist() for c in batch.columns)):
                if not pos:
                    if held:
                        out.append(closed(True))
                    now, at, parent, held, last = conv, 0, None, [(ROOT, 0)], ROOT
                    continue
                if (pos - 1) % block == 0:
                    out.append(closed(False))
                    at, parent, held = pos, held[-1][0], []
                last = hashlib.sha256(last + digest).digest()[:WIDTH]
                held.append((last, size))
            if out:
                yield told(out)
        if held:
            yield told([closed(True)])

    return map_arrow(rows, run, made)


def _opened(groups: DataFrame, sums: list[str], least: tuple[str, ...] = ()) -> DataFrame:
    """(prefix, before, depth, n_bytes, ...): the turns of different blocks, grouped only where a block has siblings.

    ``groups`` has at, own, parent, prefixes, n_bytes, alone and the columns to add up or take the least of.
    """
    turns = groups.select("at", "parent", "prefixes", "n_bytes", "alone", *sums, *least, F.posexplode("prefixes").alias("_i", "prefix"))
    before = F.when(F.col("_i") == 0, F.col("parent")).otherwise(F.get("prefixes", F.col("_i") - 1))
    turns = turns.select("prefix", before.alias("before"), (F.col("at") + F.col("_i")).alias("depth"), F.get("n_bytes", F.col("_i")).alias("n_bytes"), "alone", *sums, *least)
    shared = turns.where("not alone").groupBy("prefix", "before", "depth", "n_bytes").agg(*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least])
    return turns.where("alone").select(*shared.columns).union(shared)


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of every prefix.

    ``turns`` (conv_id, pos, digest, n_bytes) with pos 1, 2, ... in each conversation; ``convs`` (conv_id) has all of them once.
    """
    rows = cut(blocks(turns, convs, block))
    of = [F.first(c).alias(c) for c in ("at", "parent", "prefixes", "n_bytes")]
    groups = rows.groupBy("own").agg(*of, F.count("*").alias("n_convs"), F.min("conv_id").alias("first"))
    only = groups.groupBy("parent").agg(F.count("*").alias("n"), F.first("own").alias("own")).where("n = 1").select("own", F.lit(True).alias("alone"))
    groups = cut(groups.join(only, "own", "left").withColumn("alone", F.coalesce("alone", F.lit(False))))
    nodes = cut(_opened(groups, ["n_convs"], ("first",)))
    kids = nodes.where("before is not null").groupBy(F.col("before").alias("prefix")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(kids, "prefix", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    # what a node saves, and what its owner has saved above it: the owner's nodes are one run of depths
    path = cut(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")))
    owned = path.groupBy("first").agg(F.sum("saved").alias("total"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    values = rows.select("conv_id", "own").join(owned.withColumnRenamed("first", "conv_id"), "conv_id").groupBy("own").agg(F.sum("total").alias("total"), F.sum("leaf").alias("n_leaves"))
    sums = _opened(groups.join(values, "own", "left").fillna(0, ["total", "n_leaves"]), ["total", "n_leaves"]).select("prefix", "total", "n_leaves")
    full = path.join(sums, "prefix")
    above = Window.partitionBy("first").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    full = cut(full.withColumn("above", F.coalesce(F.sum("saved").over(above), F.lit(0).cast("long"))))
    # the root is the parent of a large share of the nodes
    parents = nodes.select(F.col("prefix").alias("before"), F.col("first").alias("parent_conv_id"))
    full = lookup(full, cut(parents), "before", kids.select(F.col("prefix").alias("before"), F.col("n_children").alias("n")))
    full = full.join(_ends(rows), "prefix", "left")
    none = hashlib.sha256(b"").hexdigest()
    return full.select(
        F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("total") - F.col("above")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def _ends(rows: DataFrame) -> DataFrame:
    """(prefix, ends_sha256): the digest of the ids of the conversations that end at a prefix; they stream through in order."""
    made = StructType([StructField("prefix", BinaryType()), StructField("ends_sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = own, hashlib.sha256(str(conv).encode())
                else:
                    state.update(b"," + str(conv).encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], made.names)
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], made.names)

    return map_arrow(rows.where("ended").select("own", "conv_id").repartition("own").sortWithinPartitions("own", "conv_id"), run, made)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = cut(digested(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    c = F.col("conv_id")
    return prefix_trie(*rebuilt(turns, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9))


SQL = """
with given as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first) as pos from conversations where conv_id is not null),
conv as (select c, c - c % 5 as donor, list_reduce(list_prepend(4294967295, flatten(list_transform(encode(cast(c as varchar))::bit::varchar.regexp_extract_all('.{8}'), lambda b: [list_reduce(list_transform(range(1, 9), lambda i: cast(b[i] as bigint)), lambda x, y: x * 2 + y), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda acc, x: case when x >= 0 then xor(acc, x) when acc % 2 = 1 then xor(acc // 2, 3988292384) else acc // 2 end) as crc from (select distinct c from given)),
asked as (select c, donor, (4294967295 - crc) % 9 as h, least((4294967295 - crc) % 9, (select count(*) from given g where g.c = donor)) as head from conv),
spliced as (select a.c, g.pos, role, text from asked a join given g on g.c = a.donor where g.pos <= head union all select a.c, g.pos - h + head, role, text from asked a join given g on g.c = a.c where g.pos > h),
whole as (select a.c, coalesce(list(struct_pack(r := role, t := text) order by pos) filter (pos is not null), []) as turns from asked a left join spliced s on s.c = a.c group by a.c),
node as (select turns[:d] as way, cast(d as bigint) as depth, min(c) as conv_id, count(*) as n_convs, coalesce(string_agg(cast(c as varchar), ',' order by c) filter (len(turns) = d), '') as ends from (select c, turns, unnest(range(0, len(turns) + 1)) as d from whole) group by 1, 2),
own as (select a.*, case when depth = 0 then 0 else (n_convs - 1) * octet_length(encode(way[depth].t)) end as saved, (select count(*) from node b where b.depth = a.depth + 1 and b.way[:a.depth] = a.way) as n_children from node a)
select a.conv_id, a.depth, (select p.conv_id from node p where p.depth = a.depth - 1 and p.way = a.way[:a.depth - 1]) as parent_conv_id, a.n_convs, a.n_children,
    count(*) filter (b.n_children = 0) as n_leaves, cast(sum(b.saved) as bigint) as saved_tokens, sha256(any_value(a.ends)) as ends_sha256
from own a join own b on b.depth >= a.depth and b.way[:a.depth] = a.way group by a.way, a.conv_id, a.depth, a.n_convs, a.n_children
"""

QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {"op13_prefix_trie": SQL}
