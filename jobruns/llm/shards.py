"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows are dealt over logical partitions by a hash of their content, so a task that runs twice deals alike.
How many rows each partition sends to each shard is drawn first, from the law that a uniform shuffle has:
given the row counts of partitions and the shard sizes, the matrix is multivariate hypergeometric. It is
drawn by halving the range of partitions until single partitions are left. Then each partition permutes its
rows and cuts them at the running sums of its matrix row, rows are exchanged, and each shard permutes what
it got, in blocks of a random key whose counts give the first slot of each block.

Only DataFrame functions are used. Whole rows are exchanged twice, once for each permutation; the counts between the
two come from their hashes alone. No window holds more than one partition or block (about ``ROWS_PER_PARTITION``
rows); sorting a whole shard in one task is never needed. Rows that are equal in every column share a hash; where more of
them than a partition holds do, they are counted, numbered and dealt by that number too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobruns.llm.common import filled, table, written

ROWS_PER_PARTITION = 16_384


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash of ``parts``."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) * F.lit(2.0**-53)


def hypergeometric(pop: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` rows, taken from ``pop`` rows, are among ``good``: the quantile ``u`` of that law.

    The weights are worked out from the mode outwards by their ratios and need no factorials. Beyond
    twelve standard deviations and forty steps from the mode they are below the precision of ``u``.
    """
    n, k, r = (c.cast("double") for c in (pop, good, draws))
    mode = F.floor((r + 1) * (k + 1) / (n + 2)).cast("double")
    mode = F.greatest(F.greatest(F.lit(0.0), r - (n - k)), F.least(F.least(r, k), mode))
    share = k / F.greatest(n, F.lit(1.0))
    spread = F.sqrt(r * share * (1 - share) * (n - r) / F.greatest(n - 1, F.lit(1.0)))
    steps = F.sequence(F.lit(1), (F.ceil(spread * 12) + 40).cast("int"))

    def outward(acc: Column, i: Column) -> tuple[Column, Column]:
        """The weights of mode + i and mode - i; beyond the support they are 0."""
        up, down = mode + i - 1, mode - i + 1
        more = acc["up"] * (k - up) * (r - up) / ((up + 1) * (n - k - r + up + 1))
        less = acc["down"] * down * (n - k - r + down) / ((k - down + 1) * (r - down + 1))
        return F.greatest(more, F.lit(0.0)), F.greatest(less, F.lit(0.0))

    def add(acc: Column, i: Column) -> Column:
        up, down = outward(acc, i)
        return F.struct(up.alias("up"), down.alias("down"), (acc["total"] + up + down).alias("total"))

    one = F.lit(1.0)
    start = F.struct(one.alias("up"), one.alias("down"), one.alias("total"))
    total = F.aggregate(steps, start, add, lambda acc: acc["total"])

    def find(acc: Column, i: Column) -> Column:
        up, down = outward(acc, i)
        left = acc["left"]
        at = F.when(left < 0, acc["at"]).when(left < up, mode + i).when(left < up + down, mode - i).otherwise(acc["at"])
        return F.struct(
            up.alias("up"), down.alias("down"), F.when(left < 0, left).otherwise(left - up - down).alias("left"), at.alias("at")
        )

    first = F.struct(one.alias("up"), one.alias("down"), (u * total - 1).alias("left"), mode.alias("at"))
    return F.aggregate(steps, first, find, lambda acc: acc["at"]).cast("long")


def _left_half(shards: int, seed: int) -> Column:
    """The shard counts of the left half of a node (columns ``node``, ``rows``, ``rows_left``, ``counts``)."""
    numbers = F.sequence(F.lit(0), F.lit(shards - 1))

    def draw(acc: Column, s: Column) -> Column:
        good = F.element_at("counts", s + 1)
        x = hypergeometric(acc["pop"], good, acc["draws"], _uniform(F.lit(seed), F.col("node"), F.col("depth"), s))
        return F.struct(
            (acc["pop"] - good).alias("pop"), (acc["draws"] - x).alias("draws"), F.concat(acc["out"], F.array(x)).alias("out")
        )

    start = F.struct(
        F.col("rows").alias("pop"), F.col("rows_left").alias("draws"), F.array().cast("array<bigint>").alias("out")
    )
    return F.aggregate(numbers, start, draw, lambda acc: acc["out"])


def communication_matrix(sizes: DataFrame, shards: int, seed: int) -> DataFrame:
    """(part, counts): rows that each partition of ``sizes`` (part, rows) sends to each shard.

    Shard sizes differ by one at most. Each level of the halving is one small written table.
    """
    ends = sizes.agg(F.coalesce(F.max("part"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    depth, total = int(ends[0]).bit_length(), ends[1]
    spark = sizes.sparkSession
    counts = [total // shards + (s < total % shards) for s in range(shards)]
    start = F.array(*[F.lit(n).cast("bigint") for n in counts])
    nodes = spark.range(1).select(F.col("id").alias("node"), F.lit(total).cast("bigint").alias("rows"), start.alias("counts"))
    for level in range(depth):
        left = (
            sizes.groupBy(F.shiftright("part", depth - level - 1).alias("half"))
            .agg(F.sum("rows").alias("rows_left"))
            .where("half % 2 = 0")
            .select(F.shiftright("half", 1).alias("node"), "rows_left")
        )
        drawn = (
            nodes.join(left, "node", "left")
            .fillna(0, ["rows_left"])
            .withColumn("depth", F.lit(level))
            .withColumn("left", _left_half(shards, seed))
        )
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("rows_left").alias("rows"), F.col("left").alias("counts")),
            F.struct(
                (F.col("node") * 2 + 1).alias("node"),
                (F.col("rows") - F.col("rows_left")).alias("rows"),
                F.zip_with("counts", "left", lambda a, b: a - b).alias("counts"),
            ),
        )
        nodes = written(drawn.select(F.inline(halves)).where("rows > 0"), f"halves-{level}")
    return nodes.select(F.col("node").alias("part"), "counts")


def _running(counts: Column) -> Column:
    return F.transform(
        counts, lambda _, i: F.aggregate(F.slice(counts, F.lit(1), i + 1), F.lit(0).cast("bigint"), lambda a, b: a + b)
    )


def _numbered(packed: DataFrame, rows_per_partition: int) -> DataFrame:
    """(row, h, copy): rows with a hash of their content, and a number for those that repeat more than a partition holds.

    Only such contents, at most one for each partition, are grouped by their columns; a task sends each of them once.
    """
    counts = packed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    hot = written(counts.where(F.col("n") > rows_per_partition).select("h"), "hot")
    few = packed.join(hot, "h", "left_anti").select("row", "h", F.lit(0).cast("bigint").alias("copy"))
    same = packed.join(hot, "h", "left_semi").groupBy("row", "h").agg(F.count(F.lit(1)).alias("n"))
    step = F.lit(rows_per_partition).cast("bigint")
    cut = same.withColumn("first", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, step))).repartition("h", "first")
    last = F.least(F.col("first") + step, F.col("n")) - 1
    return few.unionByName(cut.select("row", "h", F.explode(F.sequence("first", last)).alias("copy")))


def uniform_shards(rows: DataFrame, shards: int = 8, seed: int = 9, rows_per_partition: int = ROWS_PER_PARTITION) -> DataFrame:
    """The rows with two more columns: ``shard`` (0 to ``shards`` - 1, sizes at most one apart) and ``slot``
    (the place in the shard, gapless from 0). Every order of all rows is equally likely over seeds.

    Columns of the frame called ``shard`` or ``slot`` are replaced. An empty frame stays empty; nulls and
    repeated rows are dealt like others, however often they repeat.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"))
    packed = packed.withColumn("h", F.xxhash64(F.lit(seed), *[F.col(f"row.`{c}`") for c in kept]))
    parts = rows.count() // rows_per_partition + 1

    def key(n: int) -> Column:
        return F.xxhash64(F.lit(seed + n), "h", "copy")

    block = F.pmod(key(3), F.lit(parts // shards + 1))
    dealt = _numbered(packed, rows_per_partition).select(
        "row", F.pmod(key(1), F.lit(parts)).alias("part"), key(2).alias("order"), block.alias("block"), key(4).alias("then")
    )
    sizes = written(dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    matrix = written(communication_matrix(sizes, shards, seed).select("part", _running(F.col("counts")).alias("until")), "matrix")
    # Rows that tie share their block too, so counts and rows agree however ties fall.
    local = Window.partitionBy("part").orderBy("order", "block")
    sent = (
        dealt.withColumn("place", F.row_number().over(local) - 1)
        .join(matrix, "part")
        .withColumn("shard", F.size(F.filter("until", lambda end: end <= F.col("place"))).cast("int"))
    )
    first = written(sent.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n")), "blocks")
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    own = Window.partitionBy("shard", "block").orderBy("then")
    return (
        sent.select("row", "shard", "block", "then")
        .withColumn("place", F.row_number().over(own) - 1)
        .join(first.select("shard", "block", before.alias("before")), ["shard", "block"])
        .select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "shard", (F.col("before") + F.col("place")).alias("slot"))
    )


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are dealt; sizes and checksums are worked out from the rows as they lie in their shards."""
    return uniform_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.octet_length(filled("text")) + 1).cast("long").alias("size"),
        F.crc32(filled("text").cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
