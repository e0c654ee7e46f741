"""Mixing documents to target shares of tokens, by iterative proportional fitting.

Documents are counted into cells (one per combination of categories). The cells' token weights are raked:
scaled to each margin's target shares in turn until all margins hold. A cell's weight over its tokens is the
rate at which its documents are wanted. A sample has a target size, a share of all tokens: a document is taken as
often as its rate times that share says, the whole part for certain and the rest by a draw, so the expected tokens have
the target shares and size, and a small cell far below its target is repeated and leaves the others as they are.
``probability`` is the law without repeats: rates scaled so that the largest is 1, so that the rarest cell decides how
much is left. Only cell tables are shuffled, after counting per
task. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobruns.llm.common import WORD, filled, table, written

TOLERANCE = 1e-10
SWEEPS = 50
#: Tokens of a sample as a share of the tokens there are.
SIZE = 0.9
#: Exponents on the tokens of a category; the targets are the shares of the results.
TEMPERATURES = {"source": 0.8, "lang": 0.9, "topic": 1.0}


def topic(text: str = "text") -> Column:
    """A rough subject from the form of a text: listing, licence, contact or prose."""
    t = filled(text)
    return (
        F.when(F.contains(t, F.lit(" | ")), "listing")
        .when(F.contains(F.lower(t), F.lit("license")), "licence")
        .when(F.contains(t, F.lit("@")), "contact")
        .otherwise("prose")
    )


def tokens(text: str = "text") -> Column:
    """The words of a text and its end."""
    return (F.regexp_count(filled(text), F.lit(WORD)) + 1).cast("long")


def tempered(cells: DataFrame, column: str, exponent: float) -> DataFrame:
    """(column, target): the share of a category's tokens raised to ``exponent``."""
    return _shares(cells.groupBy(column).agg(F.pow(F.sum("tokens").cast("double"), F.lit(exponent)).alias("target")))


def _shares(targets: DataFrame) -> DataFrame:
    total = targets.agg(F.sum("target")).first()[0]
    return targets.withColumn("target", F.col("target") / F.lit(total or 1.0))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = TOLERANCE, sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (categories, tokens) with ``weight``: a share of all tokens, fitted to the margins.

    ``targets``: by column, its (category, target) shares. Categories without a target get weight 0; targets
    of categories without documents are shared among the others. Fitting stops when every margin is met to
    ``tolerance``, or after ``sweeps`` where the margins contradict each other in the cells there are.
    """
    columns = list(targets)
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    for c in columns:
        present = targets[c].join(cells.select(c).distinct(), c, "left_semi")
        now = now.join(_shares(present).withColumnRenamed("target", f"target_{c}"), c, "left").fillna(0.0, [f"target_{c}"])
    now = written(now, "cells")
    for sweep in range(sweeps):
        worst = F.lit(0.0)
        for c in columns:
            sums = now.groupBy(c).agg(F.sum("weight").alias("has"))
            wanted = F.col(f"target_{c}") / F.nullif(F.col("has"), F.lit(0.0))
            fitted = now.join(sums, c).withColumn("weight", F.coalesce(F.col("weight") * wanted, F.lit(0.0)))
            if c != columns[0]:
                worst = F.col("worst")
            off = F.when(F.col(f"target_{c}") > 0, F.coalesce(F.abs(F.col("has") / F.col(f"target_{c}") - 1), F.lit(0.0))).otherwise(0.0)
            now = written(fitted.withColumn("worst", F.greatest(worst, off)).drop("has"), f"sweep-{sweep}-{c}")
        if (now.agg(F.max("worst")).first()[0] or 0.0) <= tolerance:
            break
    return now.select(*columns, "tokens", "weight")


def chances(cells: DataFrame) -> DataFrame:
    """Raked cells with ``rate`` (weight over tokens, as shares) and ``probability`` (rate over the largest rate); ``wanted`` is the rate as it is."""
    total, peak = cells.agg(F.sum("tokens"), F.max(F.col("weight") / F.col("tokens"))).first()
    rate = F.col("weight") / F.col("tokens")
    return cells.select(
        "*",
        (rate * F.lit(float(total or 1))).alias("wanted"),
        F.round(rate * F.lit(float(total or 1)), 6).alias("rate"),
        F.round(rate / F.lit(peak or 1.0), 9).alias("probability"),
    )


def draw(seed: int, key: Column) -> Column:
    """A number in [0, 1) that depends on the key and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), filled(key.cast("string"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    lang: str = "lang",
    seed: int = 4,
    size: float | None = SIZE,
    targets: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """The frame as column ``row`` (a struct), with topic, tokens, rate, probability, ``copies`` and ``chosen`` (any copies).

    ``size``: the expected tokens of all copies as a share of all tokens, where every cell with documents has a target;
    None for the largest sample without repeats, drawn by ``probability``. ``targets``: (category, target) shares by
    column source, lang or topic, in place of the tempered shares of the data.

    Null categories count as the empty string, null texts as empty (they have one token, the end). Rows with
    equal ids are chosen together. An empty frame stays empty.
    """
    columns = list(TEMPERATURES)
    marked = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        filled(source).alias("source"),
        filled(lang).alias("lang"),
        topic(text).alias("topic"),
        tokens(text).alias("tokens"),
        draw(seed, F.col(key)).alias("u"),
    )
    cells = written(marked.groupBy(*columns).agg(F.sum("tokens").alias("tokens")), "counts")
    given = targets or {}
    fitted = {c: given[c] if c in given else tempered(cells, c, e) for c, e in TEMPERATURES.items()}
    rates = written(chances(rake(cells, fitted)).drop("tokens", "weight"), "rates")
    times = F.col("probability") if size is None else F.col("wanted") * F.lit(float(size))
    whole = F.lit(0) if size is None else F.floor(times).cast("int")
    copies = whole + (F.col("u") < times - whole).cast("int")
    return marked.join(rates, columns).withColumn("copies", copies).drop("wanted").withColumn("chosen", F.col("copies") > 0)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return mix(docs, size=None).select("row.doc_id", "source", "lang", "topic", "tokens", "rate", "probability", "chosen")


def _target_sql(column: str) -> str:
    return (
        f"t_{column} AS (SELECT {column}, pow(sum(tokens)::DOUBLE, {TEMPERATURES[column]}) "
        f"/ sum(pow(sum(tokens)::DOUBLE, {TEMPERATURES[column]})) OVER () AS target FROM cells GROUP BY {column})"
    )


def marked_sql(docs: str) -> str:
    """DuckDB's form of the categories, tokens and draws of a table of documents."""
    return f"""
  SELECT *, coalesce(source, '') AS c_source, coalesce(lang, '') AS c_lang,
         CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'listing'
              WHEN contains(lower(coalesce(text, '')), 'license') THEN 'licence'
              WHEN contains(coalesce(text, ''), '@') THEN 'contact' ELSE 'prose' END AS c_topic,
         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) + 1 AS tokens,
         ('0x' || substr(md5('4|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / pow(2, 52) AS u
  FROM {docs}"""


SQL = f"""
WITH RECURSIVE m AS ({marked_sql("documents")})
, cells AS (SELECT c_source AS source, c_lang AS lang, c_topic AS topic, sum(tokens) AS tokens FROM m GROUP BY ALL)
, {_target_sql("source")}, {_target_sql("lang")}, {_target_sql("topic")}
, start AS (
  SELECT c.*, s.target AS t_s, l.target AS t_l, t.target AS t_t
  FROM cells c JOIN t_source s USING (source) JOIN t_lang l USING (lang) JOIN t_topic t USING (topic))
, w AS (
  SELECT 0 AS i, source, lang, topic, tokens, t_s, t_l, t_t, tokens::DOUBLE AS weight FROM start
  UNION ALL
  SELECT i + 1, source, lang, topic, tokens, t_s, t_l, t_t, weight * t_t / sum(weight) OVER (PARTITION BY topic)
  FROM (SELECT * REPLACE (weight * t_l / sum(weight) OVER (PARTITION BY lang) AS weight)
        FROM (SELECT * REPLACE (weight * t_s / sum(weight) OVER (PARTITION BY source) AS weight) FROM w WHERE i < {SWEEPS})))
, r AS (
  SELECT source, lang, topic, round(weight / tokens * sum(tokens) OVER (), 6) AS rate,
         round(weight / tokens / max(weight / tokens) OVER (), 9) AS probability
  FROM w WHERE i = {SWEEPS})
SELECT m.doc_id, r.source, r.lang, r.topic, m.tokens::BIGINT AS tokens, r.rate, r.probability, m.u < r.probability AS chosen
FROM m JOIN r ON m.c_source = r.source AND m.c_lang = r.lang AND m.c_topic = r.topic
"""
