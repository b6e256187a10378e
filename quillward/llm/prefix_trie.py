"""The prefix trie of conversations, named by prefix doubling.

A node is a distinct sequence of first turns. Turns become fingerprints of role and text; then whole
numbers name what is equal: first single turns, then blocks of 2, 4, 8, ... turns, each round joining the
names of two neighbours to the name of their pair. Blocks begin at multiples of their size, so the first d
turns are one block for every bit that d has, the largest first, and the names of these blocks name the
prefix. A conversation of n turns takes log2(n) rounds, and rounds shrink by half.

Members are grouped by (depth, name of the prefix). What is summed over a subtree goes along the
conversations: a node stands in the path of its smallest member, the sums from a depth to the end of a path
are taken per conversation, and a node adds up those of its members.

No conversation, turn, node or root is gathered in one task: windows lie within RUN turns, groups are
summed before they are shuffled, and joins to names deal out the keys that hold more than one in HOT of
all rows (so at most HOT keys are broadcast). The ids that end in a node are put together in pieces of
IDS, which one digest then reads in order. Tables of a round are written to the shared folder.

Turns go by their number, null first; repeated numbers go by the fingerprint. Null role and text are
empty. Rows without conv_id belong to no conversation. Texts of any length count whole. An empty table
has no nodes, not even a root. Columns beside those named do not matter.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillward.llm import common

#: Turns of a conversation that a window orders at once, keys dealt out as frequent, names of a bucket, ids of a piece.
RUN, HOT, BUCKET, IDS = 4096, 1000, 1 << 20, 1000
#: Blocks of turns without a number go first.
FIRST = -(1 << 63)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def fingerprint(role: Column, text: Column) -> Column:
    """SHA-256 of role and text, told apart by the length of the role."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)


def attach(rows: DataFrame, known: DataFrame, keys: list[str], total: int, spread: list[str]) -> DataFrame:
    """rows with the columns of known, which has each key once and, as n, how many rows have it. Keys with more
    than one in HOT of the rows are dealt out over several tasks by the columns of spread."""
    limit = max(1, total // HOT)
    often = known.where(F.col("n") > limit).select(*keys, F.ceil(F.col("n") / limit).cast("int").alias("_parts"))  # HOT rows at most
    salted = rows.join(F.broadcast(often), keys, "left").withColumn("_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*spread), F.col("_parts")).cast("int")))
    copies = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") > limit, F.ceil(F.col("n") / limit).cast("int") - 1).otherwise(0)))).drop("n")
    return salted.drop("_parts").join(copies, [*keys, "_salt"]).drop("_salt")


def named(rows: DataFrame, keys: list[str], total: int, spread: list[str], scratch: common.Scratch, tag: str) -> DataFrame:
    """rows with `name` in place of the keys: whole numbers, the same for equal keys, without gaps but for the
    unevenness of the buckets in which they are counted."""
    buckets = max(8, -(-total // BUCKET))
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    place = F.row_number().over(Window.partitionBy("_bucket").orderBy(*keys))
    names = scratch.keep(found.withColumn("name", (place.cast("long") - 1) * buckets + F.col("_bucket")).drop("_bucket"), f"names-{tag}")
    return attach(rows, names, keys, total, spread).drop(*keys)


def numbered(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, block, at, print, bytes), numbered from 1 within blocks of RUN turn numbers, and the blocks
    (conv_id, block, before, size): how many turns stand before a block, and in the conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    turn = F.col(turn_col).cast("long")
    own = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), turn.alias("turn"), F.coalesce(F.floor(turn / RUN), F.lit(FIRST)).alias("block"), fingerprint(role, text).alias("print"), F.octet_length(text).cast("long").alias("bytes"))
    turns = own.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.asc_nulls_first("turn"), "print")).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("block")
    blocks = own.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return turns.drop("turn"), blocks.select("conv_id", "block", before.alias("before"), F.sum("n").over(Window.partitionBy("conv_id")).alias("size"))


def rebuilt(conversations: DataFrame, scratch: common.Scratch, group: int = 5, heads: int = 9, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, idx from 0, size, print, bytes) and conversations (conv_id, size) in which the first
    h = crc32(conv_id) % heads turns come from the first conversation of a group of ids."""
    turns, blocks = numbered(conversations, **columns)
    turns, blocks = scratch.keep(turns, "turns"), scratch.keep(blocks, "blocks")
    one = blocks.groupBy("conv_id").agg(F.max("size").alias("own"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(heads))
    convs = one.withColumn("base", F.col("conv_id") - F.col("conv_id") % group).withColumn("h", h)
    first = one.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(first, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = scratch.keep(convs.select("conv_id", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    places = blocks.drop("size").join(convs.drop("base"), "conv_id")
    known = turns.join(places, ["conv_id", "block"]).withColumn("at", F.col("at") + F.col("before"))
    kept = known.where(F.col("at") > F.col("h")).select("conv_id", (F.col("at") - F.col("h") + F.col("lent") - 1).alias("idx"), "size", "print", "bytes")
    heading = known.where(F.col("at") < heads).select(F.col("conv_id").alias("base"), "at", "print", "bytes")
    lent = heading.join(convs.drop("lent"), "base").where(F.col("at") <= F.col("h")).select("conv_id", (F.col("at") - 1).alias("idx"), "size", "print", "bytes")
    return kept.unionByName(lent), convs.select("conv_id", "size")


def members(turns: DataFrame, convs: DataFrame, scratch: common.Scratch) -> DataFrame:
    """(conv_id, depth, size, key, bytes): every prefix of every conversation, the empty one too. Two prefixes are
    equal when depth and key are. Turns are (conv_id, idx from 0, size, print, bytes)."""
    longest, total = convs.agg(F.max("size"), F.sum("size")).first()
    level = scratch.keep(named(turns, ["print"], total or 0, ["conv_id", "idx"], scratch, "0"), "level-0")
    parts = [level.select("conv_id", (F.col("idx") + 1).alias("depth"), "size", F.lit(-1).alias("bit"), F.col("bytes").alias("value"))]
    level, bit = level.drop("bytes"), 0
    while True:
        # A block stands in the prefixes that end in it or in the block after it, at its even places.
        step = F.col("idx") + 1
        ends = F.sequence(F.shiftleft(step, bit), F.least(F.shiftleft(step + 1, bit) - 1, F.col("size")))
        parts.append(level.where(F.col("idx") % 2 == 0).select("conv_id", F.explode(ends).alias("depth"), "size", F.lit(bit).alias("bit"), F.col("name").alias("value")))
        bit += 1
        if not longest or longest >> bit == 0:
            break
        side = lambda odd: F.max(F.when(F.col("idx") % 2 == odd, F.col("name")))
        pairs = level.groupBy("conv_id", F.floor(F.col("idx") / 2).alias("next"), "size").agg(side(0).alias("left"), side(1).alias("right")).where("right is not null").withColumnRenamed("next", "idx")
        level = scratch.keep(named(pairs, ["left", "right"], (total or 0) >> bit, ["conv_id", "idx"], scratch, str(bit)), f"level-{bit}")
    rows = reduce(DataFrame.unionByName, parts)
    of_blocks = F.collect_list(F.when(F.col("bit") >= 0, F.struct("bit", "value")))
    key = F.concat_ws(",", F.transform(F.sort_array(of_blocks, asc=False), lambda x: x["value"].cast("string")))
    paths = rows.groupBy("conv_id", "depth", "size").agg(key.alias("key"), F.max(F.when(F.col("bit") < 0, F.col("value"))).alias("bytes"))
    none = F.lit(0).cast("long")
    return scratch.keep(paths.unionByName(convs.select("conv_id", none.alias("depth"), "size", F.lit("").alias("key"), none.alias("bytes"))), "members")


def ends(paths: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256) of the nodes in which conversations end: the digest of their ids in order."""
    last = paths.where(F.col("depth") == F.col("size"))
    pieces = last.groupBy("depth", "key", F.floor(F.col("conv_id") / IDS).alias("piece")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def rows(batches):
        at, digest, done = None, None, []

        def given():
            keys = [k for k, _ in done]
            return pa.RecordBatch.from_arrays([pa.array([d for d, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.string()), pa.array([x for _, x in done], pa.string())], ["depth", "key", "ends_sha256"])

        for batch in batches:
            for depth, key, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "key", "ids")), strict=True):
                if (depth, key) != at:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = (depth, key), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield given()
                done.clear()
        if at is not None:
            done.append((at, digest.hexdigest()))
            yield given()

    sorted_ = pieces.repartition("depth", "key").sortWithinPartitions("depth", "key", "piece")
    return sorted_.select("depth", "key", "ids").mapInArrow(common.trimmed(rows), "depth long, key string, ends_sha256 string")


def grouped(paths: DataFrame, convs: DataFrame, scratch: common.Scratch) -> DataFrame:
    """The nodes of paths, as prefix_trie returns them."""
    over = F.col("depth") == F.col("size")
    nodes = paths.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.when(over, 1).otherwise(0)).alias("n_ends"), F.max("bytes").alias("bytes"))
    saved, leaf = ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), F.when(F.col("n_convs") == F.col("n_ends"), 1).otherwise(0).cast("long").alias("leaf")
    nodes = scratch.keep(nodes.select("depth", "key", "conv_id", "n_convs", saved, leaf), "nodes")
    # Along each conversation: the sums of its own nodes from a depth to the end, block by block.
    block = F.floor(F.col("depth") / RUN)
    by_block = nodes.groupBy("conv_id", block.alias("block")).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    blocks = convs.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("size") / RUN))).alias("block")).join(by_block, ["conv_id", "block"], "left")
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", *(F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"later_{c}") for c in ("saved", "leaf")))
    own = paths.select("conv_id", "depth", "key").join(nodes.select("conv_id", "depth", "saved", "leaf"), ["conv_id", "depth"], "left").na.fill(0, ["saved", "leaf"])
    within = Window.partitionBy("conv_id", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    own = own.withColumn("block", block).join(blocks, ["conv_id", "block"])
    own = own.select("depth", "key", *((F.sum(c).over(within) + F.col(f"later_{c}")).alias(c) for c in ("saved", "leaf")))
    below = own.groupBy("depth", "key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    # The parent of a node is the prefix before it on the path of its smallest member.
    prior = paths.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"))
    kids = scratch.keep(nodes.where("depth > 0").select("conv_id", "depth", "key").join(prior, ["conv_id", "depth"]), "kids")
    counts = kids.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_key").alias("key")).agg(F.count("*").alias("n"))
    parents = scratch.keep(nodes.select("depth", "key", "conv_id").join(counts, ["depth", "key"]), "parents")
    above = parents.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"), "n")
    placed = attach(kids.select("depth", "key", "parent_key"), above, ["depth", "parent_key"], kids.count(), ["key"])
    # All that is known of a node meets in one group.
    sides = [nodes.select("depth", "key", "conv_id", "n_convs"), below, placed.select("depth", "key", "parent_conv_id"), parents.select("depth", "key", F.col("n").alias("n_children")), ends(paths)]
    columns = ["conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sides)
    out = rows.groupBy("depth", "key").agg(*(F.max(c).alias(c) for c in columns))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def prefix_trie(spark: SparkSession, conversations: DataFrame, group: int = 5, heads: int = 9, **columns: str) -> DataFrame:
    """The nodes of the rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), a row for each node. heads = 1 leaves the conversations as they are."""
    common.ready(spark)
    scratch = common.Scratch(spark, "trie")
    turns, convs = rebuilt(conversations, scratch, group, heads, **columns)
    return grouped(members(turns, convs, scratch), convs, scratch)


def oracle(group: int = 5, heads: int = 9) -> str:
    """The same in DuckDB, from the texts of every prefix."""
    code = "list_transform(range(1, length(c) + 1), lambda i: ascii(substr(c, i, 1)))"
    steps = f"flatten(list_transform({code}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_prepend(4294967295::bigint, {steps}), lambda x, s: case when s >= 0 then xor(x, s) when x % 2 = 1 then xor(x // 2, 3988292384::bigint) else x // 2 end), 4294967295::bigint)"
    return f"""
with own as (select conv_id, turn, coalesce(text, '') as text, sha256(length(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as print from conversations where conv_id is not null),
turns as (select *, row_number() over (partition by conv_id order by turn nulls first, print) as at from own),
sizes as (select conv_id, conv_id::varchar as c, count(*) as own from own group by all),
convs as (select s.conv_id, s.conv_id - s.conv_id % {group} as base, h, least(h, coalesce(b.own, 0)) as lent from (select *, {crc} % {heads} as h from sizes) s left join sizes b on b.conv_id = s.conv_id - s.conv_id % {group}),
again as (select c.conv_id, t.at as depth, t.print, t.text from convs c join turns t on t.conv_id = c.base and t.at <= c.h
  union all select c.conv_id, t.at - c.h + c.lent, t.print, t.text from convs c join turns t on t.conv_id = c.conv_id and t.at > c.h),
paths as (select conv_id, depth, sha256(string_agg(print, '') over (partition by conv_id order by depth)) as key, strlen(text)::bigint as bytes from again union all select conv_id, 0, '', 0 from convs),
sized as (select *, max(depth) over (partition by conv_id) as size from paths),
nodes as (select depth, key, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes, count(*) filter (where depth = size) as n_ends, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where depth = size), '')) as ends_sha256 from sized group by all),
below as (select p.depth, p.key, sum((u.n_convs - 1) * u.bytes)::bigint as saved_tokens, count(*) filter (where u.n_convs = u.n_ends) as n_leaves from nodes u join paths p on p.conv_id = u.conv_id and p.depth <= u.depth group by all),
kids as (select u.depth, u.key, p.key as parent_key from nodes u join paths p on p.conv_id = u.conv_id and p.depth = u.depth - 1),
counted as (select depth - 1 as depth, parent_key as key, count(*) as n_children from kids group by all)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
from nodes n join below b using (depth, key) left join counted c using (depth, key) left join kids k using (depth, key) left join nodes p on p.depth = n.depth - 1 and p.key = k.parent_key
"""
