"""Byte-level BPE with DuckDB inside Spark tasks.

Texts are cut into words by the tokenizer's pattern. Words that are not tokens themselves become rows
(word, position, token), one per byte, and a recursive query joins neighbours to the merge table and contracts each
word's leftmost pair of least rank until no pair can be merged. A task encodes each distinct word of what it
holds at a time once. Decoding joins token rows to the vocabulary and aggregates the pieces in order.

There is no shuffle. A worker keeps one DuckDB connection; a task keeps the words it met last in two generations: when the younger holds
``CACHED``, it becomes the elder, and of the elder before it only words met again since are kept. At a task's end both are let go of,
as an idle worker keeps its memory while other stages run beside it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobruns.llm.common import filled, table

#: Words of a generation; two are held.
CACHED, WORDS_AT_ONCE, TOKENS_AT_ONCE, BYTES_AT_ONCE = 125_000, 25_000, 100_000, 2 << 20
#: Longer words are contracted at all places of their least rank at once, where that gives the same tokens.
LONG = 48

SHORT_WORDS = """
WITH RECURSIVE t AS (
  SELECT word, pos, id, lead(id) OVER w AS nxt, coalesce(lead(pos) OVER w, 255) AS npos, false AS done
  FROM start WINDOW w AS (PARTITION BY word ORDER BY pos)
  UNION ALL
  (WITH pair AS (
     SELECT t.word, t.pos, t.id, t.nxt, t.npos, m.id AS new FROM t LEFT JOIN merges m ON m.pair = t.id * 4294967296::BIGINT + t.nxt
     WHERE NOT t.done)
   , least AS (SELECT word, min(new * 65536::BIGINT + pos * 256 + npos) AS best FROM pair GROUP BY word)
   , met AS (
     SELECT pair.*, best, (best // 65536)::INTEGER AS made, ((best // 256) % 256)::INTEGER AS spot, (best % 256)::INTEGER AS gap
     FROM pair JOIN least ON pair.word = least.word)
   , gone AS (SELECT word, nxt, npos FROM met WHERE pos = gap)
   SELECT met.word, pos, CASE WHEN pos = spot THEN made ELSE id END,
          CASE WHEN pos = spot THEN gone.nxt WHEN met.npos = spot THEN made ELSE met.nxt END,
          CASE WHEN pos = spot THEN gone.npos ELSE met.npos END, best IS NULL
   FROM met LEFT JOIN gone ON met.word = gone.word WHERE best IS NULL OR pos <> gap))
SELECT word, id FROM t WHERE done ORDER BY word, pos
"""

LONG_WORDS = """
WITH RECURSIVE t AS (
  SELECT word, pos, id, false AS done FROM start
  UNION ALL
  (WITH pair AS (
     SELECT x.word, x.pos, x.id, x.i, m.id AS new
     FROM (SELECT *, lead(id) OVER w AS nxt, row_number() OVER w AS i FROM t WHERE NOT done
           WINDOW w AS (PARTITION BY word ORDER BY pos)) x LEFT JOIN merges m ON m.pair = x.id * 4294967296::BIGINT + x.nxt)
   , best AS (SELECT *, min(new) OVER (PARTITION BY word) AS best FROM pair)
   , hit AS (SELECT *, new IS NOT DISTINCT FROM best AND best IS NOT NULL AS hit FROM best)
   , run AS (
     SELECT *, i - sum(hit::INTEGER) OVER (PARTITION BY word ORDER BY i) AS run,
            min(CASE WHEN hit THEN i END) OVER (PARTITION BY word) AS first FROM hit)
   , took AS (
     SELECT *, hit AND CASE WHEN best IN (SELECT id FROM single) THEN i = first
                       ELSE row_number() OVER (PARTITION BY word, run, hit ORDER BY i) % 2 = 1 END AS take FROM run)
   , cut AS (SELECT *, lag(take) OVER (PARTITION BY word ORDER BY i) AS gone FROM took)
   SELECT word, pos, CASE WHEN take THEN best ELSE id END, best IS NULL FROM cut WHERE gone IS NOT true))
SELECT word, id FROM t WHERE done ORDER BY word, pos
"""

DECODE = """
SELECT doc, string_agg(piece, '' ORDER BY pos) AS text FROM tokens JOIN vocabulary USING (id) GROUP BY doc
"""


def read_ranks(lines: bytes) -> dict[bytes, int]:
    """A vocabulary file: a token in base64 and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines()) if a}


class Codec:
    """Encoder and decoder of one vocabulary, over a DuckDB connection of its own."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.words: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "256MB"})
        self.con.execute("SET enable_progress_bar = false")
        parts = [
            (ranks[t[:i]], ranks[t[i:]], r)
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        l, r, new = np.array(parts or np.zeros((0, 3)), np.int32).reshape(-1, 3).T
        self._create("merges", pair=l.astype(np.int64) * 4294967296 + r, id=new)
        # Tokens after which a pair of lower rank can arise: these are contracted one place at a time.
        self._create("single", id=np.unique(np.concatenate([l[new < l], r[new < r]])))
        ids = np.fromiter(ranks.values(), np.int32, len(ranks))
        self._create("vocabulary", id=ids, piece=[t.decode("latin-1") for t in ranks])
        self.of_byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int32)

    def _create(self, name: str, **columns) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _contract(self, words: list[bytes], sql: str) -> list[bytes]:
        """The tokens of each word, as little-endian 32-bit numbers."""
        sizes = np.array([len(w) for w in words])
        each = np.frombuffer(b"".join(words), np.uint8)
        start = {
            "word": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
            "pos": (np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32),
            "id": self.of_byte[each],
        }
        self.con.register("start", pa.table(start))
        found = self.con.execute(sql).fetchnumpy()
        self.con.unregister("start")
        ids = np.ascontiguousarray(found["id"], "<u4").tobytes()
        ends = np.cumsum(np.bincount(found["word"], minlength=len(words))) * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def learn(self, words: list[str]) -> None:
        """Encode the words not met before."""
        for sql, few, fits in ((SHORT_WORDS, WORDS_AT_ONCE, lambda n: n <= LONG), (LONG_WORDS, 500, lambda n: n > LONG)):
            todo = [w for w in words if fits(len(w.encode()))]
            for i in range(0, len(todo), few):
                part = todo[i : i + few]
                self.words.update(zip(part, self._contract([w.encode() for w in part], sql), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.pattern.findall(t) for t in texts]
        if len(self.words) > CACHED:
            self.words, self.elder = {}, self.words
        new = set().union(*cut).difference(self.words)
        again = {w: self.elder[w] for w in new if w in self.elder}
        new.difference_update(again)
        whole = {w: self.ranks[b].to_bytes(4, "little") for w in new if (b := w.encode()) in self.ranks}
        self.words |= again | whole
        self.learn(sorted(new.difference(whole)))
        known = self.words.__getitem__
        return [b"".join(map(known, ws)) for ws in cut]

    def forget(self) -> None:
        """Let go of the words met."""
        self.words, self.elder = {}, {}

    def decode(self, encoded: list[bytes]) -> list[bytes]:
        """The bytes that the tokens stand for; a list of many tokens is decoded in runs."""
        out: list[list[bytes]] = [[] for _ in encoded]
        runs: list[tuple[int, bytes]] = []
        held = 0

        def flush() -> None:
            sizes = [len(b) // 4 for _, b in runs]
            ids = np.frombuffer(b"".join(b for _, b in runs), "<u4").astype(np.int32)
            tokens = {"doc": np.repeat(np.arange(len(runs), dtype=np.int32), sizes), "pos": np.arange(len(ids), dtype=np.int32), "id": ids}
            self.con.register("tokens", pa.table(tokens))
            pieces = dict(self.con.execute(DECODE).fetchall())
            self.con.unregister("tokens")
            for n, (doc, _) in enumerate(runs):
                out[doc].append(pieces.get(n, "").encode("latin-1"))

        step = TOKENS_AT_ONCE * 4
        for doc, ids in enumerate(encoded):
            for i in range(0, len(ids), step):
                runs.append((doc, ids[i : i + step]))
                held += len(runs[-1][1])
                if held >= step:
                    flush()
                    runs, held = [], 0
        if runs:
            flush()
        return [b"".join(parts) for parts in out]


_CODECS: dict[tuple[int, str], Codec] = {}


def _codec(lines: bytes, pattern: str) -> Codec:
    """The worker's codec for this vocabulary; made once per worker."""
    key = (hash(lines), pattern)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(read_ranks(lines), pattern)
    return _CODECS[key]


def _let_go() -> None:
    """Free what a task needs no more; a worker that waits keeps all that it has."""
    for codec in _CODECS.values():
        codec.forget()
    pa.default_memory_pool().release_unused()


def _runs(column: pa.Array) -> Iterator[tuple[int, list]]:
    """The values of a column in runs of a bounded number of bytes (one value at least): (first row, values)."""
    first, values, held = 0, [], 0
    for i, scalar in enumerate(column):
        values.append(scalar.as_py())
        held += len(values[-1])
        if held >= BYTES_AT_ONCE:
            yield first, values
            first, values, held = i + 1, [], 0
    if values:
        yield first, values


class Tokenizer:
    """A vocabulary file and its pattern, on the driver; its methods run in tasks."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.lines = f.read()
        self.pattern = pattern

    def _mapped(self, docs: DataFrame, schema: str, of_run) -> DataFrame:
        # About a megabyte, whatever the input.
        lines, pattern = docs.sparkSession.sparkContext.broadcast(self.lines), self.pattern

        def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                for part in parts:
                    codec = _codec(lines.value, pattern)
                    for first, values in _runs(part.column(1)):
                        own = part.column(0).slice(first, len(values))
                        yield pa.RecordBatch.from_arrays([own, *of_run(codec, values)], names=names)
            finally:
                _let_go()

        names = [c.split()[0] for c in schema.split(", ")]
        return docs.mapInArrow(batches, schema)

    def encode(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, ids): the tokens of each row's whole text as little-endian unsigned 32-bit numbers."""
        slim = docs.select(F.col(key).cast("long").alias("doc_id"), filled(text).alias("text"))
        return self._mapped(slim, "doc_id long, ids binary", lambda codec, texts: [pa.array(codec.encode(texts), pa.binary())])

    def decode(self, encoded: DataFrame) -> DataFrame:
        """(doc_id, text): the bytes of each row of ``encode``."""
        slim = encoded.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids"))
        return self._mapped(slim, "doc_id long, text binary", lambda codec, ids: [pa.array(codec.decode(ids), pa.binary())])

    def digests(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row: encoded and decoded in one pass.

        Null texts count as empty, and an empty text has no tokens. Repeated rows come back repeated, empty frames empty.
        """

        def of_run(codec: Codec, texts: list[str]) -> list[pa.Array]:
            ids = codec.encode(texts)
            back = codec.decode(ids)
            return [
                pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
            ]

        slim = docs.select(F.col(key).cast("long").alias("doc_id"), filled(text).alias("text"))
        return self._mapped(slim, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", of_run)


def default_tokenizer() -> Tokenizer:
    import public_tokenizers

    return Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return default_tokenizer().digests(table(spark, sf_dir, "documents").select("doc_id", "text"))
