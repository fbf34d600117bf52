"""Trie of rebuilt conversations, by composable fingerprints.

A rebuilt conversation is a head of its base conversation followed by a tail of its own turns. The fingerprint of a sequence of
turns is the pair (B^n, sum of t_i B^i) modulo a prime, in four lanes; such pairs form a monoid, so the fingerprint of every
prefix of a rebuilt conversation follows from the prefixes of the two stored ones by one product and one difference. No
rebuilt text is ever made. Prefixes with one fingerprint form a node; the turns they refer to (by 256-bit digests) and
their parents must agree, or the work is done again with other bases.

Sums over a subtree need no walk: a conversation that is the smallest member of a node is so in all deeper ones, so the nodes
below a node are counted once by the members of that node, each from the depth on where it is the smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import give_back, mix64, partitions, table
from dossier.session import stage

PRIME = (1 << 31) - 1
LANES = 4
HEAD = 3
#: A key is hot with at least one row in HOT_SHARE; there are no more than HOT_SHARE such keys.
HOT_SHARE = 512
ID_BLOCK_BITS = 16
WORD = r"[^\x20\x09-\x0D]+"

NODE = ["depth", "a", "b"]


def base_of(conv: Column) -> Column:
    return conv - conv % 20


def head_of(conv: Column) -> Column:
    """How many turns the base gives."""
    return (F.crc32(conv.cast("string")) % 4).cast("long")


def _bases(seed: int) -> list[int]:
    mixed = mix64(np.arange(LANES, dtype=np.uint64) + np.uint64(seed * LANES))
    return [65_537 + int(m) % (PRIME - 131_074) for m in mixed]


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    out, square, left = np.ones(len(exponents), np.int64), base, exponents.copy()
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        square = square * square % PRIME
        left >>= 1
    return out


_SCAN_SCHEMA = (
    "part int, idx long, conv_id long, k long, "
    + ", ".join(f"g{i} long, t{i} long" for i in range(LANES))
    + ", words long, before long, digest binary"
)


def _scan(seed: int):
    """Running fingerprints and word totals of each conversation inside one sorted partition."""
    bases = _bases(seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        conv, k_end, g_end, w_end = None, 0, [0] * LANES, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column("conv_id").to_numpy()
            words = batch.column("words").to_numpy()
            digest = np.frombuffer(b"".join(batch.column("digest").to_pylist()), "<u8").reshape(n, LANES)
            row = np.arange(n)
            fresh = np.concatenate([[ids[0] != conv], ids[1:] != ids[:-1]])
            start = np.maximum.accumulate(np.where(fresh, row, 0))
            carried = np.cumsum(fresh) == 0
            k = row - start + 1 + np.where(carried, k_end, 0)

            def running(x: np.ndarray, at_end: int) -> np.ndarray:
                total = np.concatenate([[0], np.cumsum(x)])
                return total[1:] - total[start] + np.where(carried, at_end, 0)  # noqa: B023

            columns = [pa.array(np.full(n, part, np.int32)), pa.array(seen + row), pa.array(ids), pa.array(k)]
            for i, base in enumerate(bases):
                turn = (mix64(digest[:, i] ^ np.uint64(seed)) % np.uint64(PRIME - 1)).astype(np.int64) + 1
                term = turn * _powers(base, k) % PRIME
                g = running(term, g_end[i]) % PRIME
                g_end[i] = int(g[-1])
                columns += [pa.array(g), pa.array(term)]
            before = running(words, w_end)
            w_end, k_end, conv = int(before[-1]), int(k[-1]), ids[-1]
            seen += n
            names = [f.split()[0] for f in _SCAN_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(words), pa.array(before), batch.column("digest")], names)
        give_back()

    return run


def _compose(left: list[int], count_left: int, right: list[int], bases: list[int]) -> list[int]:
    """The monoid's product: sums of a sequence of ``count_left`` turns and of the one that follows it."""
    return [(x + pow(b, count_left, PRIME) * y) % PRIME for x, y, b in zip(left, right, bases)]


def _numbered_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """Every turn with its place in its conversation and the fingerprint of the prefix that it ends.

    The turns are sorted over range partitions, so that one conversation may cover many of them; one row per partition
    (the state of its last conversation) comes to the driver and is carried into the next partitions.
    """
    spark, bases = conversations.sparkSession, _bases(seed)
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.sha2(text, 256).alias("text_sha"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("row"),
    ).filter("conv_id is not null")
    order = ["conv_id", "turn", "role", "text_sha", "row"]
    ranged = plain.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    local = stage(ranged.select("conv_id", "words", "digest").mapInArrow(_scan(seed), _SCAN_SCHEMA))

    last = F.struct("conv_id", "k", *[f"g{i}" for i in range(LANES)], "before")
    ends = local.groupBy("part").agg(F.min_by("conv_id", "idx").alias("first"), F.max_by(last, F.col("idx")).alias("last")).orderBy("part").collect()
    carries, conv, held, sums, words = [], None, 0, [0] * LANES, 0
    for e in ends:
        if e.first == conv:
            carries.append((e.part, conv, held, *sums, *[pow(b, held, PRIME) for b in bases], words))
        mine = [e.last[f"g{i}"] for i in range(LANES)]
        if e.last.conv_id == conv:
            sums, held, words = _compose(sums, held, mine, bases), held + e.last.k, words + e.last.before
        else:
            conv, held, sums, words = e.last.conv_id, e.last.k, mine, e.last.before
    schema = "part int, conv_id long, ck long, " + ", ".join(f"cg{i} long" for i in range(LANES)) + ", " + ", ".join(f"cp{i} long" for i in range(LANES)) + ", cw long"
    carried = local.join(F.broadcast(spark.createDataFrame(carries, schema)), ["part", "conv_id"], "left")
    shift = lambda c, i: F.coalesce(F.col(f"cp{i}"), F.lit(1)) * F.col(c)
    return carried.select(
        "part", "idx", "conv_id", (F.col("k") + F.coalesce("ck", F.lit(0))).alias("k"),
        *[((F.coalesce(F.col(f"cg{i}"), F.lit(0)) + shift(f"g{i}", i)) % PRIME).alias(f"g{i}") for i in range(LANES)],
        *[(shift(f"t{i}", i) % PRIME).alias(f"t{i}") for i in range(LANES)],
        "words", (F.col("before") + F.coalesce("cw", F.lit(0))).alias("before"), "digest",
    )


def _attach(rows: DataFrame, sides: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """Inner join with a table of one row per key; rows of hot keys meet them by broadcast, which holds HOT_SHARE rows at most."""
    heavy = F.broadcast(sides.filter(hot))
    rest = rows.join(F.broadcast(sides.filter(hot).select(*keys)), keys, "left_anti")
    return rows.join(heavy, keys).unionByName(rest.join(sides.filter(~hot), keys))


def _pack(lanes: list[Column]) -> list[Column]:
    return [F.shiftleft(lanes[0], 31).bitwiseOR(lanes[1]).alias("a"), F.shiftleft(lanes[2], 31).bitwiseOR(lanes[3]).alias("b")]


def _conversation_table(turns: DataFrame) -> DataFrame:
    """One row per conversation: its length, its own first turns and those of its base."""
    state = F.struct("k", *[f"g{i}" for i in range(LANES)], *[f"t{i}" for i in range(LANES)], "words", "before", "digest")
    convs = stage(
        turns.groupBy("conv_id").agg(
            F.max("k").alias("n"),
            F.array_sort(F.collect_list(F.when(F.col("k") <= HEAD, state))).alias("heads"),
            F.min(F.struct("part", F.shiftright("idx", ID_BLOCK_BITS).alias("blk"))).alias("block"),
        )
    )
    c = convs.withColumn("h", head_of(F.col("conv_id"))).withColumn("base", base_of(F.col("conv_id")))
    b = convs.select(F.col("conv_id").alias("base"), F.col("heads").alias("base_heads"))
    joined = c.join(b, "base", "left")
    taken = F.slice(F.coalesce("base_heads", F.slice("heads", 1, 0)), F.lit(1), F.col("h").cast("int"))
    joined = joined.withColumn("taken", taken).withColumn("m", F.size("taken").cast("long"))
    return stage(joined.withColumn("own", F.get("heads", F.least("h", "n").cast("int") - 1)).withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).drop("heads", "base_heads"))


def _members(turns: DataFrame, convs: DataFrame, seed: int) -> DataFrame:
    """One row per rebuilt conversation and depth: the node's fingerprint, its parent's, and what its last turn refers to."""
    bases = _bases(seed)
    spare = ["conv_id", "length", "block"]

    def shaped(df: DataFrame, depth: Column, lanes: list[Column], parent: list[Column], words: Column, before: Column, digest: Column) -> DataFrame:
        pa_, pb_ = _pack(parent)
        return df.select(
            "conv_id", depth.alias("depth"), *_pack(lanes), pa_.alias("pa"), pb_.alias("pb"), words.alias("words"), before.alias("before"),
            digest.alias("digest"), (depth == F.col("length")).alias("is_end"), "block",
        )

    zero = [F.lit(0).cast("long")] * LANES
    none = [F.lit(None).cast("long")] * LANES
    root = shaped(convs, F.lit(0).cast("long"), zero, none, zero[0], zero[0], F.lit(None).cast("binary"))
    heads = convs.select(*spare, F.explode("taken").alias("t"))
    minus = lambda x, y: (x - y + PRIME) % PRIME
    head_lanes = [F.col(f"t.g{i}") for i in range(LANES)]
    head_rows = shaped(heads, F.col("t.k"), head_lanes, [minus(F.col(f"t.g{i}"), F.col(f"t.t{i}")) for i in range(LANES)], F.col("t.words"), F.col("t.before"), F.col("t.digest"))

    total = turns.count()
    narrow = convs.filter("n > h").select(*spare, "n", "h", "m", "own", F.get("taken", F.col("m").cast("int") - 1).alias("top"))
    tails = _attach(turns.drop("part", "idx"), narrow, ["conv_id"], F.col("n") * HOT_SHARE >= total).filter("k > h")
    of = lambda name, field: F.coalesce(F.col(f"{name}.{field}"), F.lit(0).cast("long"))
    back = [F.array(*[F.lit(pow(b, -j, PRIME)).cast("long") for j in range(HEAD + 1)]) for b in bases]

    def rebuilt(i: int, end: Column) -> Column:
        factor = F.get(back[i], (F.col("h") - F.col("m")).cast("int"))
        return (of("top", f"g{i}") + factor * minus(end, of("own", f"g{i}"))) % PRIME

    lanes = [rebuilt(i, F.col(f"g{i}")) for i in range(LANES)]
    parent = [rebuilt(i, minus(F.col(f"g{i}"), F.col(f"t{i}"))) for i in range(LANES)]
    tail_rows = shaped(
        tails, F.col("m") + F.col("k") - F.col("h"), lanes, parent, F.col("words"), of("top", "before") + F.col("before") - of("own", "before"), F.col("digest")
    )
    return root.unionByName(head_rows).unionByName(tail_rows)


def _end_hashes(members: DataFrame) -> DataFrame:
    """SHA-256 of the ids that end at a node, ascending: joined in blocks of ids, then hashed block after block."""
    blocks = stage(
        members.filter("is_end").groupBy(*NODE, "block").agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    )
    sizes = blocks.groupBy(*NODE).agg(F.count("*").alias("blocks"), F.max(F.sha2("ids", 256)).alias("ends_sha256"))
    one = sizes.filter("blocks = 1").drop("blocks")
    more = blocks.join(sizes.filter("blocks > 1").select(*NODE), NODE, "left_semi")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        out = lambda: pa.RecordBatch.from_pylist([dict(zip(NODE, key), ends_sha256=digest.hexdigest())])
        for batch in batches:
            for depth, a, b, ids in zip(*[batch.column(c).to_pylist() for c in [*NODE, "ids"]]):
                if key == (depth, a, b):
                    digest.update(b",")
                else:
                    if key:
                        yield out()
                    key, digest = (depth, a, b), hashlib.sha256()
                digest.update(ids.encode())
        if key:
            yield out()

    streamed = more.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids").mapInArrow(chain, "depth long, a long, b long, ends_sha256 string")
    return one.unionByName(streamed)


def prefix_trie(conversations: DataFrame, seed: int = 0) -> DataFrame:
    """The nodes of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, null first, then role, then the digest of the text; repeated rows count as turns each. Null roles
    and texts are empty. Rows with a null conv_id belong to no conversation. An empty table has no nodes. Extra
    columns are not read.
    """
    for attempt in count(seed):
        turns = _numbered_turns(conversations, attempt)
        members = stage(_members(turns, _conversation_table(turns), attempt))
        up = F.struct("pa", "pb")
        nodes = stage(
            members.groupBy(*NODE).agg(
                F.min("conv_id").alias("least"), F.count("*").alias("n_convs"), F.max("words").alias("words"),
                F.min("digest").alias("d0"), F.max("digest").alias("d1"), F.min(up).alias("u0"), F.max(up).alias("u1"),
            )
        )
        if nodes.filter("d0 <> d1 or u0 <> u1").isEmpty():
            break
    total = members.count()
    hot = F.col("n_convs") * HOT_SHARE >= total
    below = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("u0.pa").alias("a"), F.col("u0.pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes.select(*NODE, "least", "n_convs", "words", "u0.pa", "u0.pb").join(below, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    seen = _attach(members.select("conv_id", *NODE, "words", "before", "is_end"), nodes.select(*NODE, "least", "n_convs", "n_children"), NODE, hot)
    first = F.col("conv_id") == F.col("least")
    seen = stage(seen.select("conv_id", *NODE, "words", "before", first.alias("first"), (first & F.col("is_end") & (F.col("n_children") == 0)).alias("leaf")))
    per_conv = stage(
        seen.groupBy("conv_id").agg(
            F.coalesce(F.max(F.when(~F.col("first"), F.col("before"))), F.lit(0)).alias("shared"), F.max(F.col("leaf").cast("long")).alias("ends_leaf"), F.count("*").alias("rows")
        )
    )
    saved = F.when(~F.col("first"), F.col("shared") - F.col("before") + F.col("words")).otherwise(0)
    sums = (
        _attach(seen, per_conv, ["conv_id"], F.col("rows") * HOT_SHARE >= total)
        .groupBy(*NODE)
        .agg(F.sum("ends_leaf").alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    )
    out = nodes.join(sums, NODE).join(_end_hashes(members), NODE, "left")
    upper = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("least").alias("parent_conv_id"), "n_convs")
    parents = _attach(nodes.filter("depth > 0").select(*NODE, "pa", "pb"), upper, ["depth", "pa", "pb"], hot).select(*NODE, "parent_conv_id")
    return out.join(parents, NODE, "left").select(
        F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL = r"""
with turns as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as k
  from conversations where conv_id is not null),
convs as (select conv_id as c, max(k) as n, cast(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(conv_id as varchar), ''), lambda x: cast(ascii(x) as bigint))),
    lambda crc, x: list_reduce([xor(crc, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))) as bigint) as crc from turns group by conv_id),
heads as (select c, n, xor(crc, 4294967295) % 4 as h, c - c % 20 as base from convs),
sizes as (select h.c, h.n, h.h, h.base, least(h.h, coalesce(b.n, 0)) as m from heads h left join convs b on b.c = h.base),
rebuilt as (
  select s.c, t.k as d, t.role, t.text from sizes s join turns t on t.conv_id = s.base and t.k <= s.h
  union all select s.c, s.m + t.k - s.h, t.role, t.text from sizes s join turns t on t.conv_id = s.c and t.k > s.h),
chain as (select c, d, text, list(sha256(role || chr(0) || text)) over (partition by c order by d) as path from rebuilt),
members as (select c, 0 as d, '' as text, cast([] as varchar[]) as path from convs union all select c, d, text, path from chain),
ends as (select c, max(d) as len from members group by c),
nodes as (
  select path, d, min(m.c) as conv_id, count(*) as n_convs, any_value(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) as words,
    coalesce(string_agg(cast(m.c as varchar), ',' order by m.c) filter (where e.len = m.d), '') as ids
  from members m join ends e on e.c = m.c group by path, d),
kids as (select path[1:len(path) - 1] as path, count(*) as n from nodes where d > 0 group by 1),
full_nodes as (select nodes.*, coalesce(kids.n, 0) as n_children from nodes left join kids on kids.path = nodes.path),
below as (select path[1:a.u] as top, n_convs, words, n_children from full_nodes, unnest(range(0, d + 1)) as a(u)),
sums as (select top, sum(case when n_children = 0 then 1 else 0 end) as n_leaves, sum((n_convs - 1) * words) as saved from below group by top)
select f.conv_id, cast(f.d as bigint) as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, cast(s.n_leaves as bigint) as n_leaves, cast(s.saved as bigint) as saved_tokens, sha256(f.ids) as ends_sha256
from full_nodes f join sums s on s.top = f.path left join full_nodes p on f.d > 0 and p.d = f.d - 1 and p.path = f.path[1:len(f.path) - 1]
"""
