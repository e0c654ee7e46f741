"""Phrases whose words come together oftener than by themselves, by language.

Level by level, as in Apriori. A phrase of k words is a candidate if it was met ``LEAST`` times behind counted phrases of
k - 1 words and its last k - 1 words are such a phrase too, so no frequent phrase is missed.

Words met ``LEAST`` times have numbers. A double-array trie of them cuts the texts down to these numbers once, some bytes for each word
and as many zeros where a piece ends or a rarer word was, and the levels read that instead of the texts. The candidates of a level become
a double-array trie over those bytes, which is broadcast; a task lets the states of all word positions advance byte by byte
together, adds up the accepting states with ``bincount``, and Spark adds up the tasks. The same walk yields the phrases of the next
level: accepted phrases that overlap in all words but one. They are summed as numbers of their words, two to a column.

A trie holds at most ``PART`` bytes of phrases (one of words twice that), so what a worker holds and what the driver sees at once is
bounded; candidates beyond that, dealt by their first two words, get tries of their own. They do not get walks of their own: a task holds
``BLOCK`` bytes of numbers and walks each position in the one trie that can have its phrase, so the time for a text does not grow
with the number of frequent phrases. A task's table of words is passed on whenever it holds ``HELD`` of them. ``TOGETHER`` partitions
of texts are one task's, where there are enough for all cores: phrases that both hold are added up before the shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobruns.llm.common import filled, small_batches, table, tidy, written
from jobruns.llm.double_array import build

LEAST, LONGEST, TOP = 30, 4, 2000
PART, HELD, AT_ONCE, TOGETHER, BLOCK = 1 << 22, 300_000, 1 << 20, 2, 1 << 22
#: Parts that the phrases of a language are ranked in first.
RANKED = 64
#: Positions walked, rows passed on at a time.
_WALKED, _PASSED = 1 << 18, 1 << 16
#: Rows of counts of words: the key is a language, a line end and a word, or nothing for all words.
COUNTS = "key binary, n long"
#: Rows of counts of phrases: the numbers of two words in a, of the others in b, 32 bits each, 0 behind the last.
PHRASES = "a long, b long, n long"

_SPACE, _END = 0x20, 0x0A
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("A") : ord("Z") + 1] += 32
_CLASS[list(b".,;:!?\n\x0b\x0c\r")] = _END
_CLASS[list(b" \t")] = _SPACE


def tokens(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text with one blank after each word, or a line end where its piece ends; and where words start and end."""
    raw = _CLASS[np.frombuffer(text + b"\n", np.uint8)]
    breaks = raw == _END
    blank = (raw == _SPACE) | breaks
    behind = blank.copy()
    behind[0] = False
    behind[1:] &= ~blank[:-1]
    at = np.flatnonzero(behind)
    if not len(at):
        return np.zeros(1, np.uint8), at, at
    kept = behind | ~blank
    out, end = raw[kept], np.flatnonzero(behind[kept])
    out[end] = _SPACE
    # A line end anywhere in the blanks behind a word.
    word = np.searchsorted(at, np.flatnonzero(breaks), "right") - 1
    out[end[word[word >= 0]]] = _END
    return out, np.append(0, end[:-1] + 1), end


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, text): texts of one language put together, about ``AT_ONCE`` bytes at a time."""
    for batch in batches:
        held: dict[str, list[bytes]] = {}
        sizes: Counter[str] = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            held.setdefault(lang, []).append(t := text.as_py())
            sizes[lang] += len(t)
            if sizes[lang] >= AT_ONCE:
                yield lang, b"\n".join(held.pop(lang))
                del sizes[lang]
        for lang, texts in held.items():
            yield lang, b"\n".join(texts)


def _flushed(held: dict[str, Counter[bytes]], limit: int) -> Iterator[pa.RecordBatch]:
    """The counts as rows, once they are more than ``limit``."""
    if sum(map(len, held.values())) <= limit:
        return
    for lang, counts in held.items():
        name = pa.scalar(lang.encode() + b"\n", pa.binary())
        keys = pc.binary_join_element_wise(name, pa.array(list(counts), pa.binary()), b"")
        yield pa.record_batch([keys, pa.array(list(counts.values()), pa.int64())], names=["key", "n"])
    held.clear()


def _word_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of all of them under the empty phrase."""
    held: dict[str, Counter[bytes]] = {}
    for lang, text in _chunks(batches):
        words = tokens(text)[0].tobytes().split() if text else []
        counts = held.setdefault(lang, Counter())
        counts.update(words)
        counts[b""] += len(words)
        yield from _flushed(held, HELD)
    yield from _flushed(held, 0)


def _value(sent: Broadcast, alone: bool) -> tuple:
    """What was broadcast. The worker keeps it for its next text if it is the only one, else one after the other would add up."""
    value = sent.value
    if not alone:
        vars(sent).pop("_value", None)
    return value


def _digits(numbers: np.ndarray, width: int) -> np.ndarray:
    """The numbers as ``width`` bytes each, the highest first."""
    return np.ascontiguousarray(numbers.astype(">i4").view(np.uint8).reshape(-1, 4)[:, 4 - width :])


def _numbers(digits: np.ndarray, width: int) -> np.ndarray:
    full = np.zeros((len(digits) // width, 4), np.uint8)
    full[:, 4 - width :] = digits.reshape(-1, width)
    return full.view(">i4").ravel().astype(np.int32)


def _line(found: np.ndarray, ended: np.ndarray) -> np.ndarray:
    """The numbers of a text's words, with one 0 for words without a number and for the ends of pieces, however many."""
    line = np.full((len(found), 2), -1, np.int32)
    line[:, 0] = found
    line[ended, 1] = 0
    line = line[line >= 0]
    kept = line > 0
    kept[1:] |= kept[:-1]
    return line[kept]


def _coded(docs: DataFrame, sent: list[Broadcast], width: int) -> DataFrame:
    """The texts as the numbers of their words; ``sent`` has tries of the words, and the words' numbers."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def lines() -> pa.RecordBatch:
            found = [np.zeros(len(first), np.int32) for _, _, first, _ in held]
            for one in sent:
                trie, ids = _value(one, len(sent) == 1)
                for (lang, out, first, end), numbers in zip(held, found, strict=True):
                    root, left = trie.after(lang.encode() + b"\n"), np.flatnonzero(numbers == 0)
                    if root >= 0:
                        which, key, behind = trie.walk(out, first[left], np.full(len(left), root, np.int32))
                        whole = behind == end[left[which]]
                        numbers[left[which[whole]]] = ids[key[whole]]
                del trie, ids
            coded = [_digits(_line(x, out[end] == _END), width).tobytes() for x, (_, out, _, end) in zip(found, held, strict=True)]
            held.clear()
            return pa.record_batch([pa.array(coded, pa.binary())], names=["line"])

        for lang, text in _chunks(parts):
            out, first, end = tokens(text)
            if len(first):
                held.append((lang, out, first, end))
                size += len(text)
            if size >= (AT_ONCE if len(sent) == 1 else BLOCK):
                yield lines()
                size = 0
        if held:
            yield lines()

    return docs.mapInArrow(batches, "line binary")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    held, size = [], 0
    for batch in batches:
        for line in batch.column(0):
            held.append(line.as_py())
            size += len(held[-1])
            if size >= BLOCK:
                yield np.frombuffer(b"".join(held), np.uint8)
                held, size = [], 0
    if size:
        yield np.frombuffer(b"".join(held), np.uint8)


def _columns(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two words to a column; words that the phrase does not have are 0."""
    a, b = words[0].astype(np.int64), np.zeros(len(words[0]), np.int64)
    a <<= 32
    a |= words[1]
    if len(words) > 2:
        b |= words[2]
        b <<= 32
    if len(words) > 3:
        b |= words[3]
    return a, b


def _counted(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The columns of the phrases, each once, and how often each was there."""
    a, b = _columns(words)
    new = np.ones(len(a), bool)
    if len(words) == 2:
        a.sort()
        np.not_equal(a[1:], a[:-1], out=new[1:])
    else:
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.flatnonzero(new)
    return a[first], b[first], np.diff(np.append(first, len(a)))


def _passed(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), _PASSED):
        yield pa.record_batch([pa.array(x[i : i + _PASSED]) for x in (a, b, n)], names=["a", "b", "n"])


def _walked(coded: DataFrame, sent: list[Broadcast], words: int, width: int) -> DataFrame:
    """Counts of the tries' phrases, and of the phrases that are one word longer whose first and last words the tries have.
    Words have no trie here: what has a number is one."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text in _blocks(parts):
            ids = _numbers(text, width)
            met = ids > 0
            if words > 1:
                whole = met.copy()
                for k in range(1, words):
                    whole[:-k] &= met[k:]
                    whole[-k:] = False
                starts = np.flatnonzero(whole)
                part = (_columns([ids[starts], ids[starts + 1]])[0] % len(sent)).astype(np.int32)
                met = np.zeros(len(ids), bool)
                for i, one in enumerate(sent):
                    trie, a, b = _value(one, len(sent) == 1)
                    own, total = starts[part == i], np.zeros(len(a), np.int64)
                    for at in range(0, len(own), _WALKED):
                        some = own[at : at + _WALKED]
                        which, key, _ = trie.walk(text, some * width, np.zeros(len(some), np.int32))
                        total += np.bincount(key, minlength=len(a))
                        met[some[which]] = True
                    there = np.flatnonzero(total)
                    yield from _passed(a[there], b[there], total[there])
                    del trie, a, b
            if words < LONGEST:
                longer = np.flatnonzero(met[:-1] & met[1:])
                yield from _passed(*_counted([ids[longer + k] for k in range(words + 1)]))

    return coded.mapInArrow(batches, PHRASES)


def _summed(rows: DataFrame, label: str) -> DataFrame:
    return written(rows.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST), label)


def _of(words: int) -> Column:
    """Whether a row has a phrase of so many words."""
    fourth = F.col("b").bitwiseAND(F.lit(0xFFFFFFFF)) != 0
    return {2: F.col("b") == 0, 3: (F.col("b") != 0) & ~fourth, 4: fourth}[words]


def _named(rows: DataFrame) -> DataFrame:
    """(lang, phrase, n) of the keys, a language of which may hold line ends itself; a word has none."""
    key = F.expr("CAST(key AS STRING)")
    lang, phrase = F.regexp_replace(key, "\n[^\n]*\\z", ""), F.substring_index(key, "\n", -1)
    return rows.select(lang.alias("lang"), phrase.cast("binary").alias("phrase"), "n")


def _numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """The words with a number ``id`` from 1 and the ``part`` that their trie is, and the number of tries."""
    size = words.agg(F.sum(F.length("phrase") + F.octet_length("lang") + 1)).first()[0] or 0
    parts = size // (2 * PART) + 1
    dealt = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "phrase"), F.lit(64 * parts)))
    sizes = dealt.groupBy("bucket").count()
    begins = sizes.select("bucket", (F.sum("count").over(Window.orderBy("bucket")) - F.col("count")).alias("begin"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "phrase"))
    numbered = dealt.withColumn("place", place).join(begins, "bucket")
    numbered = numbered.select("lang", "phrase", "n", (F.col("begin") + F.col("place")).alias("id"), F.pmod("bucket", F.lit(parts)).alias("part"))
    return written(numbered, "numbers"), parts


def _word_tries(words: DataFrame, parts: int) -> list[Broadcast]:
    sent = []
    for part in range(parts):
        name = F.concat(F.col("lang").cast("binary"), F.lit(b"\n"), "phrase")
        found = words.where(F.col("part") == part).select(name.alias("key"), "id").toArrow().sort_by("key")
        made = build(found["key"].to_pylist()), found["id"].to_numpy().astype(np.int32)
        sent.append(words.sparkSession.sparkContext.broadcast(made))
        del found, made
    return sent


def _phrase_tries(candidates: DataFrame, words: int, width: int) -> list[Broadcast]:
    """Tries of the candidates, an odd number of them, so that both words of a number decide in which a phrase is."""
    parts = candidates.count() * words * width // PART + 1 | 1
    sent = []
    for part in range(parts):
        found = candidates.where(F.pmod("a", F.lit(parts)) == part).select("a", "b").toArrow()
        a, b = (found[x].to_numpy() for x in ("a", "b"))
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        digits = np.concatenate([_digits(x, width) for x in (a >> 32, a & 0xFFFFFFFF, b >> 32, b & 0xFFFFFFFF)[:words]], axis=1)
        keys = digits.view(f"V{words * width}").ravel().tolist()
        sent.append(candidates.sparkSession.sparkContext.broadcast((build(keys), a, b)))
        del found, keys
    return sent


def _words(words: int) -> list[Column]:
    """The numbers of the words of a row."""
    low = lambda x: F.col(x).bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.shiftright("a", 32), low("a"), F.shiftright("b", 32), low("b")][:words]


def _packed(words: list[Column], a: str, b: str) -> list[Column]:
    """The columns of a phrase of these words, as a row of counts has them."""
    w = [x.cast("long") for x in words] + [F.lit(0).cast("long")] * (4 - len(words))
    return [F.shiftleft(w[0], 32).bitwiseOR(w[1]).alias(a), F.shiftleft(w[2], 32).bitwiseOR(w[3]).alias(b)]


def _spelled(level: DataFrame, numbers: DataFrame, words: int) -> DataFrame:
    """(a, b, n, lang, phrase) of the rows of numbers."""
    out = level.select("a", "b", "n", *[x.alias(f"w{i}") for i, x in enumerate(_words(words))])
    for i in range(words):
        own = numbers.select(F.col("id").cast("long").alias(f"w{i}"), F.col("phrase").cast("string").alias(f"p{i}"), *["lang"] * (i == 0))
        out = out.join(own, f"w{i}")
    return out.select("a", "b", "n", "lang", F.concat_ws(" ", *[f"p{i}" for i in range(words)]).alias("phrase"))


def _fewer(docs: DataFrame) -> DataFrame:
    parts, cores = docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism
    return docs.coalesce(max(parts // TOGETHER, min(parts, cores), 1))


def counted_phrases(docs: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables (a, b, n, lang, phrase) of the phrases of 1 to ``LONGEST`` words met ``LEAST`` times, and (lang, n) of all words.
    ``docs`` has lang, and text as bytes."""
    spark = docs.sparkSession
    with small_batches(spark):
        ends = F.expr("hex(substring(key, -1, 1)) = '0A'")
        words = _fewer(docs).mapInArrow(_word_batches, COUNTS).groupBy("key").agg(F.sum("n").alias("n")).where((F.col("n") >= LEAST) | ends)
        words = _named(written(words, "words"))
        totals = words.where(F.length("phrase") == 0).select("lang", "n")
        numbers, parts = _numbered(words.where(F.length("phrase") > 0))
        most = numbers.agg(F.max("id")).first()[0] or 0
        width = max(1, (most.bit_length() + 7) // 8)
        levels = [numbers.select(*_packed([F.col("id")], "a", "b"), "n", "lang", F.col("phrase").cast("string").alias("phrase"))]
        sent = _word_tries(numbers, parts)
        coded = _fewer(written(_coded(docs, sent, width), "coded"))
        for k in range(1, LONGEST + 1):
            for one in sent:
                one.destroy()
            tidy(spark)
            sent = _phrase_tries(candidates, k, width) if k > 1 else []
            sums = _summed(_walked(coded, sent, k, width), f"level-{k}")
            if k > 1:
                levels.append(written(_spelled(sums.where(_of(k)), numbers, k), f"counts-{k}"))
            candidates = sums.where(_of(k + 1)) if k < LONGEST else None
        for one in sent:
            one.destroy()
    return levels, totals


def collocations(docs: DataFrame, key: str = "lang", text: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``TOP`` phrases of each language.

    A null language is ``und``; null, empty and blank texts have no words; repeated rows count as often as they are there; ties
    are settled by the phrase. A language without a frequent phrase has no rows, nor has an empty frame.
    """
    slim = docs.select(F.coalesce(F.col(key), F.lit("und")).alias("lang"), filled(text).cast("binary").alias("text"))
    levels, totals = counted_phrases(slim)
    every = _all(levels)
    cut = _all([_cut(level, k) for k, level in enumerate(levels[1:], 2)])
    lefts = every.select(F.col("a").alias("la"), F.col("b").alias("lb"), F.col("n").alias("l"))
    rights = every.select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("n").alias("r"))
    score = F.expr("(CAST(n AS DECIMAL(19, 0)) * 2000000) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    scored = cut.join(lefts, ["la", "lb"]).join(rights, ["ra", "rb"]).withColumn("score", score)
    best = scored.groupBy("a", "b", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = _all([_within(level, k) for k, level in enumerate(levels[2:], 3)])
    covered = inner.groupBy("a", "b").agg(F.max("longer").alias("longer"))
    hidden = F.expr("100 * CAST(longer AS DECIMAL(19, 0)) >= 80 * CAST(n AS DECIMAL(19, 0))")
    left = best.join(covered, ["a", "b"], "left").where(F.col("longer").isNull() | ~hidden)
    left = left.select("a", "b", "best").join(_all(levels[1:]), ["a", "b"]).select("lang", "phrase", F.col("n").alias("a"), "best")
    # A language's first are among the first of each part of it, so no task sorts a whole language.
    order = [F.desc("best.score"), F.desc("a"), "phrase"]
    own = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANKED))).orderBy(*order)
    some = left.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= TOP).drop("rank")
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= TOP)
    return top.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score")
    )


def _all(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    return every


def _cut(level: DataFrame, words: int) -> DataFrame:
    """The phrases of a level cut in two at each place ``k``: the columns of what is left and right of it."""
    w = _words(words)
    cuts = [F.struct(F.lit(k).alias("k"), *_packed(w[:k], "la", "lb"), *_packed(w[k:], "ra", "rb")) for k in range(1, words)]
    return level.select("a", "b", "n", F.inline(F.array(*cuts)))


def _within(level: DataFrame, words: int) -> DataFrame:
    """All shorter phrases of two words and more inside the phrases of a level."""
    w = _words(words)
    spans = [F.struct(*_packed(w[i : i + k], "a", "b")) for k in range(2, words) for i in range(words - k + 1)]
    return level.select(F.inline(F.array(*spans)), F.col("n").alias("longer"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


SQL = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM documents),
p AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM d)),
t AS (SELECT lang, p, unnest(w) AS w1, unnest(range(len(w))) AS i FROM p),
s AS (
  SELECT lang, w1, lead(w1) OVER x AS w2, lead(w1, 2) OVER x AS w3, lead(w1, 3) OVER x AS w4
  FROM t WINDOW x AS (PARTITION BY p ORDER BY i)),
g AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM s UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM s WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM s WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM s WHERE w4 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM g GROUP BY lang, k, phrase HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
e AS (
  SELECT lang, phrase, k, f, cut, array_to_string(ws[1:cut], ' ') AS left_part, array_to_string(ws[cut + 1:], ' ') AS right_part
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM f)),
c AS (
  SELECT e.lang, e.phrase, e.f AS a, l.f AS l, r.f AS r, cut, ((2000000::HUGEINT * e.f) // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM e JOIN f l ON l.lang = e.lang AND l.phrase = left_part JOIN f r ON r.lang = e.lang AND r.phrase = right_part),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (
  SELECT lang, array_to_string(ws[s:s + m - 1], ' ') AS phrase, max(f) AS longer
  FROM f, (VALUES (1), (2), (3)) x(s), (VALUES (2), (3)) y(m) WHERE m < k AND s + m - 1 <= k GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN n USING (lang) LEFT JOIN i USING (lang, phrase)
WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT
QUALIFY rank <= 2000
"""
