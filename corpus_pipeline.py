"""The corpus pipeline: documents that are good, different, mixed to target shares, as token counts and digests.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns they were given, with rows left out, or repeated by the mixing. Rows that repeat a
document whole (id and text) are one document. Ids and texts may be null; tables may be empty; columns beside doc_id,
text, source and lang are carried along, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobruns.llm.bpe import default_tokenizer
from jobruns.llm.common import table, text_hash, written
from jobruns.llm.exact import dedup_documents
from jobruns.llm.jaccard import near_copies
from jobruns.llm.mixing import mix
from jobruns.llm.quality import accepted, fit

#: No SQL: the classifier, SimHash and the tokenizer are not expressible in it; tests hold the run to brute force.
ORACLE_SQL = None


def _only(docs: DataFrame, keepers: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (doc_id, text_hash) is among ``keepers``, each once. Texts are dealt once, by one key of both."""

    def key(i: str, h: str) -> Column:
        return F.xxhash64(i, h, F.col(i).isNull())

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("k"), text_hash("text").alias("h"))
    rows = rows.withColumn("key", key("k", "h"))
    wanted = keepers.select(F.col("doc_id").alias("wanted_id"), F.col("text_hash").alias("wanted_hash")).withColumn("wanted_key", key("wanted_id", "wanted_hash"))
    # Differences, not equalities: those would be keys of the join as well, and the window's rows be dealt anew.
    other = F.col("h").bitwiseXOR(F.col("wanted_hash")).bitwiseOR(F.coalesce("k", F.lit(0)).bitwiseXOR(F.coalesce("wanted_id", F.lit(0))))
    same = (F.col("key") == F.col("wanted_key")) & (other == 0)
    held = rows.join(wanted, same, "left_semi")
    one = Window.partitionBy("key", "k", "h").orderBy("h")
    return held.withColumn("n", F.row_number().over(one)).where("n = 1").select("row.*")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs, fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, blanks apart, the one with most code points, then the smallest id."""
    found = dedup_documents(docs).where("kept")
    best = found.groupBy("text_sha256").agg(F.min(F.struct(-F.col("points"), F.col("text_hash"), F.col("doc_id"))).alias("best"))
    return _only(docs, best.select("best.doc_id", "best.text_hash"))


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (op1's links, and five-word similarity of 0.8 or more) the document with the smallest id."""
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_hash"))
    best = near_copies(docs).groupBy("group").agg(F.min(order).alias("best"))
    return _only(docs, best.select("best.doc_id", "best.text_hash"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which sources, languages and topics have their target shares of tokens; documents of rare ones can repeat."""
    return mix(docs).where("chosen").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number of its tokens, and digests of them and of what they decode to."""
    return default_tokenizer().digests(docs)


STAGES = [
    ("quality", good),
    ("exact dedup", distinct),
    ("near dedup", different),
    ("mixing", mixed),
    ("encoding", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
