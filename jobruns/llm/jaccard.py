"""Near copies by five-word shingles: every pair whose Jaccard similarity is at least ``LEAST``.

Texts with equal shingle sets are one node. All shingles have one order: by hash, those that repeat in a sample of texts last.
Two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each, so only these prefixes are dealt
by shingle, and a passage that many otherwise different texts share is in few of them. A pair with a shingle in common is
compared exactly, on the whole sets, if their *profiles* allow the similarity: a profile counts a set's shingles in ``BINS`` bins by
hash, and two sets share no more of a bin than the smaller count.

Pairs are formed in two steps, whatever the size of the groups. First the nodes of each shingle that at most ``FEW`` nodes have, all
of them, and in larger groups ``REPS`` nodes with all others; this joins most of a large group of near copies. Then, in
larger groups that are still in several components, blocks of nodes are held against each other in numpy, and pairs of
different components whose profiles allow it go on.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobruns.llm.common import filled, small_batches, text_hash, tidy, written
from jobruns.llm.components import components
from jobruns.llm.simhash import near_duplicates

WORDS, SEED, LEAST = 5, 42, 0.8
FEW, REPS = 64, 8
#: Bins of a profile, and nodes that are held against others together.
BINS, BLOCK = 128, 1024
#: Documents in which common shingles are looked for, and in how many of them a shingle is common.
SAMPLE, COMMON = 20_000, 2


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct hashes of the text's five-word shingles, sorted; a shorter text is one shingle, an empty one has none."""
    words = text.lower().split()
    if len(words) < WORDS:
        shingles = iter([b" ".join(words)] if words else [])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all shingles; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - both
    return both / every if every else 1.0


def prefix(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which two sets of similarity ``LEAST`` share one; ``common`` is sorted."""
    at = np.searchsorted(common, own)
    last = at < len(common)
    last[last] = common[at[last]] == own[last]
    keep = len(own) - int(np.ceil(LEAST * len(own) - 1e-9)) + 1
    return np.concatenate([own[~last], own[last]])[:keep]


def _common(slim: DataFrame) -> np.ndarray:
    """The shingles that are in ``COMMON`` or more of some ``SAMPLE`` different texts."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for text in part.column(0):
                yield pa.record_batch([pa.array(shingle_set(text.as_py()).view(np.int64))], names=["shingle"])

    rows = slim.count()
    some = slim.where(F.pmod(F.xxhash64(F.col("text_hash"), F.lit(SEED)), F.lit(rows // SAMPLE + 1)) == 0).dropDuplicates(["text_hash"])
    held = some.select("text").mapInArrow(batches, "shingle long").groupBy("shingle").count().where(F.col("count") >= COMMON)
    return np.sort(held.select("shingle").toArrow()["shingle"].to_numpy().view(np.uint64))


def profile(own: np.ndarray) -> np.ndarray:
    """How many of the shingles are in each bin; as many as can be if one bin has more than can be counted."""
    counts = np.bincount((own >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=BINS)
    most = np.iinfo(np.uint16).max
    return (counts if counts.max() < most else np.full(BINS, most)).astype("<u2")


def allowed(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Which profiles, row by row, may belong to sets of similarity ``LEAST``."""
    shared = np.minimum(a, b).sum(axis=-1, dtype=np.int64)
    return shared * (1 + LEAST) >= LEAST * (size_a + size_b) - 1e-6


def _nodes(slim: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, node, size, prefix, profile) for every row; a node is a hash of the whole set."""
    sent = slim.sparkSession.sparkContext.broadcast(common)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            nodes, sizes, firsts, profiles = [], [], [], []
            for text in part.column(2):
                own = shingle_set(text.as_py())
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                firsts.append(prefix(own, sent.value).view(np.int64))
                profiles.append(profile(own).tobytes())
            made = pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(firsts, pa.list_(pa.int64())), pa.array(profiles, pa.binary())
            yield pa.record_batch([part.column(0), part.column(1), *made], names=["doc_id", "text_hash", "node", "size", "prefix", "profile"])

    schema = "doc_id long, text_hash long, node long, size int, prefix array<long>, profile binary"
    return slim.select("doc_id", "text_hash", "text").mapInArrow(batches, schema)


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        sets = [shingle_set(unpack.decompress(t.as_py())).view(np.int64) for t in batch.column(1)]
        yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])


def _near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, y = batch.column(2), batch.column(3)
        near = [jaccard(a.values.to_numpy(), b.values.to_numpy()) >= LEAST - 1e-12 for a, b in zip(x, y, strict=True)]
        yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = pa.array([pack.compress(t.as_py()) for t in batch.column(1)], pa.binary())
        yield pa.record_batch([batch.column(0), texts], names=["text_hash", "text"])


def _compared(pairs: DataFrame, slim: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes that are similar; shingle sets are formed again only for nodes in pairs."""
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    wanted = written(nodes.join(ends, "node").select("node", "text_hash"), "wanted")
    packed = slim.select("text_hash", "text").mapInArrow(_packed, "text_hash long, text binary")
    # Merged, with an exchange, whatever the sizes: joined by broadcast, a task would hold two Python workers at once, and
    # an executor keeps the most workers it ever had.
    texts = packed.join(wanted.hint("merge"), "text_hash").select("node", "text")
    sets = written(texts.mapInArrow(_set_batches, "node long, shingles array<long>").dropDuplicates(["node"]), "shingles")
    tidy(slim.sparkSession)
    left = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("x")), "u")
    both = left.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("y")), "v")
    found = written(both.select("u", "v", "x", "y").mapInArrow(_near_batches, "u long, v long"), "similar")
    tidy(slim.sparkSession)
    return found


def _profiles(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BINS)


def _allowed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        size_u, size_v = batch.column(2).to_numpy(), batch.column(4).to_numpy()
        on = allowed(_profiles(batch.column(3)), size_u, _profiles(batch.column(5)), size_v)
        yield batch.select(["u", "v"]).filter(pa.array(on, pa.bool_()))


def _across_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of two blocks, or within the first, that are in different components and may be similar."""
    for batch in batches:
        for i in range(batch.num_rows):
            sides = []
            for c in (0, 1 if batch.column(1)[i].is_valid else 0):
                own = batch.column(c)[i].values
                numbers = [own.field(n).to_numpy() for n in ("node", "size", "root")]
                sides.append((*numbers, _profiles(own.field("profile"))))
            (u, size_u, root_u, prof_u), (v, size_v, root_v, prof_v) = sides
            rows_u, rows_v = [], []
            for k in range(len(u)):
                on = (root_v != root_u[k]) & (np.minimum(size_v, size_u[k]) >= LEAST * np.maximum(size_v, size_u[k]) - 1e-9)
                at = np.flatnonzero(on)
                at = at[allowed(prof_v[at], size_v[at], prof_u[k], size_u[k])]
                rows_u.append(np.full(len(at), u[k]))
                rows_v.append(v[at])
            a, b = np.concatenate(rows_u), np.concatenate(rows_v)
            yield pa.record_batch([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["u", "v"])


#: Sizes that allow the similarity.
CAN = f"least(size, b_size) >= {LEAST} * greatest(size, b_size) - 1e-9"


def _others(members: DataFrame) -> DataFrame:
    return members.select("shingle", F.col("node").alias("b"), F.col("size").alias("b_size"))


def _components(links: DataFrame) -> DataFrame:
    return components(links).select(F.col("u").alias("node"), F.col("v").alias("root"))


def similar(slim: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, v): nodes that are not the smallest of their component, and that smallest node."""
    firsts = [F.min("text_hash").alias("text_hash"), F.min("size").alias("size"), F.any_value("profile").alias("profile")]
    nodes = written(rows.groupBy("node").agg(*firsts), "nodes")
    keys = rows.select("node", "size", F.explode("prefix").alias("shingle"))
    # Rows of one node repeat its keys; they are told from others by the node.
    shared = written(keys.groupBy("shingle").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("shingle"), "shared")
    alive = written(keys.join(shared, "shingle").distinct(), "alive")
    tidy(slim.sparkSession)
    picks = [F.min(F.struct(F.xxhash64("node", F.lit(j)).alias("h"), "node"))["node"] for j in range(REPS)]
    groups = written(alive.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.array(*picks)).alias("reps")), "groups")
    few = alive.join(groups.where(F.col("n") <= FEW).select("shingle"), "shingle")
    small = few.join(_others(few), "shingle").where("node > b").where(CAN).select(F.col("node").alias("u"), F.col("b").alias("v"))
    members = written(alive.join(groups.where(F.col("n") > FEW), "shingle"), "members")
    reps = _others(members.where(F.array_contains("reps", F.col("node"))))
    star = members.join(reps, "shingle").where("node <> b").where(CAN).select(F.greatest("node", "b").alias("u"), F.least("node", "b").alias("v"))
    own = nodes.select(F.col("node").alias("u"), F.col("size").alias("size_u"), F.col("profile").alias("profile_u"))
    other = nodes.select(F.col("node").alias("v"), F.col("size").alias("size_v"), F.col("profile").alias("profile_v"))
    formed = small.unionByName(star).distinct().join(own, "u").join(other, "v").select("u", "v", "size_u", "profile_u", "size_v", "profile_v")
    links = _compared(written(formed.mapInArrow(_allowed_batches, "u long, v long"), "pairs"), slim, nodes)

    roots = written(_components(links), "roots")
    rooted = members.select("shingle", "n", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = written(rooted, "rooted")
    open_groups = rooted.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("shingle")
    block = F.pmod(F.xxhash64("node"), F.floor(F.col("n") / BLOCK) + 1)
    blocks = written(
        rooted.join(open_groups, "shingle").join(nodes.select("node", "size", "profile"), "node")
        .groupBy("shingle", block.alias("block"))
        .agg(F.collect_list(F.struct("node", "size", "root", "profile")).alias("rows")),
        "blocks",
    )
    two = blocks.select("shingle", F.col("block").alias("a"), F.col("rows").alias("x")).join(
        blocks.select("shingle", F.col("block").alias("b"), F.col("rows").alias("y")), "shingle"
    ).where("a <= b")
    across = written(two.select("x", F.when(F.col("a") < F.col("b"), F.col("y")).alias("y")).mapInArrow(_across_batches, "u long, v long").distinct(), "across")
    return components(links.unionByName(_compared(across, slim, nodes)))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, group) for every row: the components over links of ``near_duplicates`` and over pairs whose
    five-word shingles have a Jaccard similarity of at least ``LEAST``.

    Null, empty and blank texts are one group; case and blanks do not count; repeated rows come back repeated.
    """
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), text_hash(text).alias("text_hash"), filled(text).cast("binary").alias("text"))
    with small_batches(docs.sparkSession):
        rows = written(_nodes(slim, _common(slim)), "sets")
        roots = similar(slim, rows).select(F.col("u").alias("node"), F.col("v").alias("root"))
        own = rows.select("doc_id", "text_hash", "node").join(roots, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
        own = written(own, "copies")
        # Equal texts have equal fingerprints, so a text's hash leads from one kind of link to the other.
        prints = near_duplicates(docs, key, text).select("text_hash", F.xxhash64(F.lit("fingerprint"), "group").alias("near")).distinct()
        across = written(own.select("text_hash", "root").distinct().join(prints, "text_hash").select(F.col("root").alias("u"), F.col("near").alias("v")).distinct(), "across")
        joined = components(across).select(F.col("u").alias("root"), F.col("v").alias("group"))
    return own.join(joined, "root", "left").select("doc_id", "text_hash", F.coalesce("group", "root").alias("group"))
