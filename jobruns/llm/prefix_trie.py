"""The trie of conversation prefixes, by hashes of blocks of turns.

A node is a distinct sequence of first turns. Conversations are cut into blocks of ``BLOCK`` turns, each with a digest of its
turns, and a block's *chain* is a digest of all blocks up to it, formed by doubling: a round joins each block with the
one 1, 2, 4, ... blocks before it, so a conversation of n turns takes log n rounds and no task holds it whole. Blocks with one
chain are one *class*, whatever the number of conversations. Classes that follow the same chain are siblings. A class
without siblings has the same members at each of its turns, and none is compared there; only where siblings diverge, the
turns of their classes are told apart by digests of their beginnings.

What a node says of its subtree is a sum over its members, so no level waits for the one below. A conversation *owns* the
nodes whose smallest member it is, always the deepest ones of its path; q is the number of bytes above them. Then a node
with m bytes above its last turn saves the sum of q - m over its members but its owner, and has as many leaves as members
that own one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobruns.llm.common import filled, table, written

BLOCK = 4
#: Turns, by number, that are put in order together; and ids, by value, that are listed together.
TURNS, IDS = 1024, 4096
#: First turns that a conversation can take from another, and of how many conversations one is the giver.
HEAD, GIVEN = 8, 5
ROOT, NOTHING = "root", hashlib.sha256(b"").hexdigest()


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv, pos, digest, bytes): each turn with its place from 1, by turn (null first), then role and text. Turns are put in
    order within slices of ``TURNS`` numbers, so that a long conversation is spread."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        "turn",
        F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-(2**62))).cast("long").alias("slice"),
        filled("role").alias("role"),
        filled("text").alias("text"),
    )
    earlier = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("conv", "slice").agg(F.count(F.lit(1)).alias("n")).select(
        "conv", "slice", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("conv", "slice").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return (
        rows.withColumn("nth", F.row_number().over(inside))
        .join(before, ["conv", "slice"])
        .select(
            "conv",
            (F.col("before") + F.col("nth")).alias("pos"),
            F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"),
            F.octet_length("text").cast("long").alias("bytes"),
        )
    )


def _taken(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % (HEAD + 1)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, digest, bytes) of the rebuilt conversations, and (conv, n_turns, total) of all of them. Conversation c takes
    its first h turns, h = crc32(c) % 9, from c - c % 5, as far as there are any, instead of its own."""
    own = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    named = own.select("conv", "n", _taken(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % GIVEN).alias("giver"))
    givers = own.select(F.col("conv").alias("giver"), F.col("n").alias("given"))
    plans = written(
        named.join(givers, "giver", "left").select(
            "conv", "giver", "h", F.when(F.col("giver") == F.col("conv"), F.col("h")).otherwise(F.least("h", F.coalesce("given", F.lit(0)))).alias("taken")
        ),
        "plans",
    )
    heads = turns.where(F.col("pos") <= HEAD).withColumnRenamed("conv", "giver")
    first = heads.join(plans.where("giver <> conv"), "giver").where("pos <= h").select("conv", "pos", "digest", "bytes")
    # One's own head is kept by the giver itself only.
    rest = turns.join(plans, "conv").where("giver = conv OR pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "digest", "bytes")
    rows = written(first.unionByName(rest), "rebuilt")
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("bytes").alias("total"))
    every = plans.select("conv").join(sizes, "conv", "left").na.fill(0, ["n_turns", "total"])
    return rows, written(every, "conversations")


def _blocks(rows: DataFrame) -> DataFrame:
    """(conv, b, above, chain, turns, before): blocks with the chain they follow and the bytes before them."""
    blocks = written(
        rows.groupBy("conv", F.floor((F.col("pos") - 1) / BLOCK).alias("b")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("turns")),
        "blocks",
    )
    digest = F.sha2(F.concat_ws("", F.transform("turns", lambda t: t["digest"])), 256)
    size = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["bytes"])
    chains = written(blocks.select("conv", "b", digest.alias("chain"), size.alias("upto")), "chains")
    top, step = blocks.agg(F.max("b")).first()[0] or 0, 1
    while step <= top:
        before = chains.select("conv", (F.col("b") + step).alias("b"), F.col("chain").alias("_chain"), F.col("upto").alias("_upto"))
        chains = written(
            chains.join(before, ["conv", "b"], "left").select(
                "conv",
                "b",
                F.when(F.col("_chain").isNull(), F.col("chain")).otherwise(F.sha2(F.concat("_chain", "chain"), 256)).alias("chain"),
                (F.col("upto") + F.coalesce("_upto", F.lit(0))).alias("upto"),
            ),
            "chains",
        )
        step *= 2
    above = chains.select("conv", (F.col("b") + 1).alias("b"), F.col("chain").alias("above"), F.col("upto").alias("before"))
    return blocks.join(chains.select("conv", "b", "chain"), ["conv", "b"]).join(above, ["conv", "b"], "left").select(
        "conv", "b", F.coalesce("above", F.lit(ROOT)).alias("above"), "chain", "turns", F.coalesce("before", F.lit(0)).alias("before")
    )


def _steps(classes: DataFrame) -> DataFrame:
    """(chain, above, ids, forked, ...): ``ids`` names the node of each turn of a class. Where a class has no siblings its turns are
    named by their number; where siblings diverge, by a digest of the turns up to them."""
    forks = classes.groupBy("above").agg((F.count(F.lit(1)) > 1).alias("forked"))

    def name(t: Column) -> Column:
        start = F.concat_ws("", F.transform(F.slice("turns", F.lit(1), t), lambda x: x["digest"]))
        part = F.when(F.col("forked"), F.sha2(start, 256)).otherwise(F.lit(""))
        return F.when(t == BLOCK, F.col("chain")).otherwise(F.sha2(F.concat("above", F.lit(":"), t.cast("string"), F.lit(":"), part), 256))

    return classes.join(forks, "above").withColumn("ids", F.transform(F.sequence(F.lit(1), F.size("turns")), name))


def _members(steps: DataFrame) -> DataFrame:
    """One row for each turn of each class: (chain, forked, id, up, depth, before)."""
    at = F.col("t") - 1
    spread = steps.withColumn("t", F.explode(F.sequence(F.lit(1), F.size("turns"))))
    earlier = F.aggregate(F.slice("turns", F.lit(1), at), F.lit(0).cast("long"), lambda s, x: s + x["bytes"])
    return spread.select(
        "chain",
        "forked",
        F.get("ids", at).alias("id"),
        F.when(F.col("t") == 1, F.col("above")).otherwise(F.get("ids", at - 1)).alias("up"),
        (F.col("b") * BLOCK + F.col("t")).alias("depth"),
        (F.col("before") + earlier).alias("before"),
    )


def _ends(last: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the nodes where conversations end, from (id, conv). Ids are listed by ranges of their values; the
    lists of a node go through one hash in order, one at a time."""
    listed = last.groupBy("id", F.floor(F.col("conv") / IDS).alias("part")).agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))).alias("convs")
    )

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for part in parts:
            done: list[tuple[str, str]] = []
            for i, convs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if i == node:
                    digest.update(b"," + convs.encode())
                else:
                    if node is not None:
                        done.append((node, digest.hexdigest()))
                    node, digest = i, hashlib.sha256(convs.encode())
            yield pa.record_batch([pa.array([x for x, _ in done], pa.string()), pa.array([y for _, y in done], pa.string())], names=["id", "ends_sha256"])
        if node is not None:
            yield pa.record_batch([pa.array([node]), pa.array([digest.hexdigest()])], names=["id", "ends_sha256"])

    return listed.repartition("id").sortWithinPartitions("id", "part").select("id", "convs").mapInArrow(batches, "id string, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    Null roles and texts are empty; turns of one number, repeated rows among them, follow each other by role and text, a
    null number first. Rows without an id take no part. A conversation that is left without turns is a member of the root
    only. An empty frame has no nodes. Other columns are not looked at.
    """
    rows, every = rebuilt(written(ordered_turns(conversations.select("conv_id", "turn", "role", "text")), "turns"))
    blocks = written(_blocks(rows).join(every, "conv"), "placed")
    classes = blocks.groupBy("above", "chain", "b").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("conv").alias("least"),
        F.max("n_turns").alias("longest"),
        F.any_value("turns").alias("turns"),
        F.min("before").alias("before"),
    )
    steps = written(_steps(classes), "steps")
    member = _members(steps)
    counted = member.join(steps.select("chain", "n", "least", "longest"), "chain")
    single = counted.where("NOT forked").select("id", "up", "depth", "before", "n", "least", "longest")
    forked = counted.where("forked").groupBy("id").agg(
        F.any_value("up").alias("up"),
        F.min("depth").alias("depth"),
        F.min("before").alias("before"),
        F.sum("n").alias("n"),
        F.min("least").alias("least"),
        F.max("longest").alias("longest"),
    )
    root = every.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("least"), F.max("n_turns").alias("longest")).where("n > 0").select(
        F.lit(ROOT).alias("id"), F.lit(None).cast("string").alias("up"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("before"), "n", "least", "longest"
    )
    nodes = written(single.unionByName(forked).unionByName(root), "nodes")
    own = nodes.groupBy(F.col("least").alias("conv")).agg(F.min("before").alias("q"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf"))
    worth = written(every.join(own, "conv", "left").select("conv", F.coalesce("q", "total").alias("q"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "worth")
    sums = [F.sum("q").alias("q"), F.sum("leaf").alias("leaves")]
    of_class = blocks.select("conv", "chain").join(worth, "conv").groupBy("chain").agg(*sums)
    below = member.join(of_class.withColumnRenamed("leaves", "leaf"), "chain").groupBy("id").agg(*sums)
    below = below.unionByName(worth.agg(*sums).select(F.lit(ROOT).alias("id"), "q", "leaves"))
    children = nodes.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    final = steps.select("chain", F.element_at("ids", -1).alias("id"))
    ending = blocks.where(F.col("b") == F.floor((F.col("n_turns") - 1) / BLOCK)).select("conv", "chain").join(final, "chain").select("id", "conv")
    ends = _ends(ending.unionByName(every.where("n_turns = 0").select(F.lit(ROOT).alias("id"), "conv")))
    parents = nodes.select(F.col("id").alias("up"), F.col("least").alias("parent_conv_id"))
    owners = worth.select(F.col("conv").alias("least"), F.col("q").alias("own_q"))
    return (
        nodes.join(parents, "up", "left")
        .join(below, "id")
        .join(children, "id", "left")
        .join(ends, "id", "left")
        .join(owners, "least")
        .select(
            F.col("least").alias("conv_id"),
            "depth",
            "parent_conv_id",
            F.col("n").alias("n_convs"),
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.col("leaves").alias("n_leaves"),
            (F.col("q") - F.col("own_q") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        )
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'r': r, 'x': x} ORDER BY pos) AS l,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
      lambda a, s: list_reduce(list_concat([xor(a, s)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda p, z: xor(p >> 1, 3988292384 * (p & 1)))),
      4294967295) % 9 AS h
  FROM t GROUP BY conv_id),
b AS (
  SELECT c.conv_id, CASE WHEN c.conv_id % 5 = 0 THEN c.l ELSE list_concat(coalesce(g.l[1:c.h], []), c.l[c.h + 1:]) END AS l
  FROM c LEFT JOIN c g ON g.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, len(l) AS size, unnest(range(0, len(l) + 1)) AS depth, l FROM b),
n AS (
  SELECT l[1:depth] AS k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(strlen(any_value(l)[depth].x), 0) AS bytes,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '') AS ends
  FROM p GROUP BY l[1:depth], depth),
leaves AS (SELECT k FROM n EXCEPT SELECT k[1:depth - 1] FROM n WHERE depth > 0)
SELECT u.conv_id, u.depth, any_value(up.conv_id) AS parent_conv_id, any_value(u.n_convs) AS n_convs,
  count(*) FILTER (v.depth = u.depth + 1) AS n_children,
  count(*) FILTER (v.k IN (SELECT k FROM leaves)) AS n_leaves,
  sum((v.n_convs - 1) * v.bytes)::BIGINT AS saved_tokens, any_value(sha256(u.ends)) AS ends_sha256
FROM n u JOIN n v ON v.depth >= u.depth AND v.k[1:u.depth] = u.k
LEFT JOIN n up ON up.depth = u.depth - 1 AND up.k = u.k[1:u.depth - 1]
GROUP BY u.conv_id, u.depth
"""
