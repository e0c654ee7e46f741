"""Repeated passages by recompression: which words lie in a window that an earlier document has as well.

*Naming.* ``ROUNDS`` rounds name runs of equal words and then pairs of neighbours. A symbol is left or right by a bit of its
hash, and a left one joins the right one that follows it, up to ``LONGEST`` words. A name is a hash of what it names, so
all tasks give equal substrings the same names without an exchange. Each symbol carries the span of words that decides it
(its *context*): wherever these words stand, the symbol stands there too, so equal windows share all symbols whose context
they hold.

*Revealing.* Of these symbols a window takes the longest, of equal ones the one with the larger name, then the first, as
its anchor. Neighbouring windows mostly share one, so a text has about one anchor in five or six words. A window that no
symbol serves (inside a long run) is its own anchor. Equal windows have equal anchors: an anchor in one document only
settles all its windows, and that is all that is exchanged for text that does not repeat.

*Verifying.* Windows of one anchor in one place are compared whole, as one *stretch* of words. A stretch that a document
with a smaller id has repeats altogether. Only for an anchor that stands in different stretches, where a passage begins
or ends, the windows are compared one by one, once for each different stretch. What is compared are hashes of the words: 64 bits of
the anchor and 64 of the stretch or window together; the stretch is compared once more with the text when its words go.

Nothing is collected beyond the places of one document, and joins are plain ones whose hot keys Spark splits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobruns.llm.common import filled, table, written

WINDOW, ROUNDS, LONGEST = 13, 2, 4
#: Words worked on at a time; a longer text is worked on alone.
AT_ONCE = 200_000
#: The place of a null id in the order of ids: behind all others.
LAST = 2**63 - 1
_FAR = 1 << 40
_ODD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every bit depends on all bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
#: Gives each round bits of its own.
_ROUND = _mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def symbols(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(name, start, end, from, to) of every symbol over the words of some texts; ``first`` marks where a text begins.
    Words ``from`` to ``to`` are the symbol's context; beyond a text's ends it is never met."""
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & ~first[1:]
    start = np.flatnonzero(~same)
    end = np.append(start[1:], len(words))
    size = end - start
    name = np.where(size > 1, _mixed(words[start] + size.astype(np.uint64) * _ODD), words[start])
    begins = first[start]
    ends = np.append(begins[1:], True)
    # A run, or a word that is none, is known with its neighbours.
    lo, hi = np.where(begins, -_FAR, start - 1), np.where(ends, _FAR, end + 1)
    found = [(name.copy(), start, end.copy(), lo, hi)]
    for k in range(ROUNDS):
        left = (_mixed(name ^ _ROUND[k]) & np.uint64(1)).astype(bool)
        ends = np.append(begins[1:], True)
        size = end - start
        joined = np.zeros(len(name), bool)
        joined[:-1] = left[:-1] & ~left[1:] & ~ends[:-1] & (size[:-1] + size[1:] <= LONGEST)
        # A left symbol that stays depends on the next one, a right one on the one before.
        at = np.arange(len(name))
        other = np.where(left, np.minimum(at + 1, len(name) - 1), np.maximum(at - 1, 0))
        new_lo, new_hi = np.minimum(lo, lo[other]), np.maximum(hi, hi[other])
        new_hi[left & ends], new_lo[~left & begins] = _FAR, -_FAR
        i = np.flatnonzero(joined)
        name[i] = _mixed(_mixed(name[i]) + name[i + 1] * _ODD)
        new_lo[i], new_hi[i] = np.minimum(lo[i], lo[i + 1]), np.maximum(hi[i], hi[i + 1])
        end[i] = end[i + 1]
        found.append((name[i], start[i], end[i], new_lo[i], new_hi[i]))
        stay = np.ones(len(name), bool)
        stay[i + 1] = False
        name, start, end, lo, hi, begins = (x[stay] for x in (name, start, end, new_lo, new_hi, begins))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Spans:
    """Hashes of spans of words, equal for equal words: differences of one running sum, moved to the same power."""

    def __init__(self, words: np.ndarray) -> None:
        powers = np.full(len(words) + 1, _ODD)
        powers[0] = 1
        self.back = np.full(len(words) + 1, _INVERSE)
        self.back[0] = 1
        np.cumprod(powers, out=powers)
        np.cumprod(self.back, out=self.back)
        self.sums = np.append(np.uint64(0), np.cumsum(words * powers[:-1]))

    def of(self, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[start + size] - self.sums[start]) * self.back[start])


def stretches(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(anchor, start, windows, stretch): windows in a row with one anchor, by the first one's start. ``stretch`` is a hash
    of all their words; for windows that are their own anchor, which are equal, it is the anchor."""
    n = len(words)
    begin, spans = np.flatnonzero(first), Spans(words)
    end = np.append(begin[1:], n)
    text_start, text_end = np.repeat(begin, end - begin), np.repeat(end, end - begin)
    name, s, e, lo, hi = symbols(words, first)
    usable = hi - lo <= WINDOW
    name, s, e, lo, hi = (x[usable] for x in (name, s, e, lo, hi))
    # The best comes last and stays.
    order = np.lexsort((-s, name, e - s))
    name, s, lo, hi = (x[order] for x in (name, s, lo, hi))
    since, until = np.maximum(hi - WINDOW, text_start[s]), np.minimum(lo, text_end[s] - WINDOW)
    count = np.maximum(until - since + 1, 0)
    which = np.repeat(np.arange(len(s)), count)
    window = since[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    best = np.full(n, -1)
    best[window] = which
    starts = np.flatnonzero(np.arange(n) + WINDOW <= text_end)
    best = best[starts]
    served = best >= 0
    key = np.zeros(len(starts), np.uint64)
    used = best[served]
    key[served] = _mixed(name[used] + spans.of(lo[used], (hi - lo)[used]))
    key[~served] = spans.of(starts[~served], np.full((~served).sum(), WINDOW))
    new = np.ones(len(starts), bool)
    follows = (starts[1:] == starts[:-1] + 1) & (text_start[starts[1:]] == text_start[starts[:-1]])
    new[1:] = ~follows | (best[1:] != best[:-1]) | (~served[1:] & (key[1:] != key[:-1]))
    at = np.flatnonzero(new)
    windows = np.diff(np.append(at, len(starts)))
    own = ~served[at]
    whole = spans.of(starts[at], windows + WINDOW - 1)
    return key[at], starts[at], windows, np.where(own, key[at], whole)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[int], list[list[bytes]]]]:
    """Rows of a batch, a bounded number of words at a time, with their words."""
    for batch in batches:
        rows, texts, held = [], [], 0
        for i in range(batch.num_rows):
            words = batch.column(column)[i].as_py().split()
            rows.append(i)
            texts.append(words)
            held += len(words)
            if held >= AT_ONCE:
                yield batch, rows, texts
                rows, texts, held = [], [], 0
        if rows:
            yield batch, rows, texts


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _stretch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, rows, texts in _texts(batches, 1):
        kept = [(i, w) for i, w in zip(rows, texts, strict=True) if len(w) >= WINDOW]
        if not kept:
            continue
        sizes = np.array([len(w) for _, w in kept])
        begin = np.cumsum(sizes) - sizes
        first = np.zeros(int(sizes.sum()), bool)
        first[begin] = True
        anchor, start, windows, stretch = stretches(np.concatenate([word_hashes(w) for _, w in kept]), first)
        text = np.searchsorted(begin, start, "right") - 1
        doc = batch.column(0).to_numpy()[np.array([i for i, _ in kept])][text]
        columns = [_signed(anchor), pa.array(doc), pa.array((start - begin[text]) << 32 | windows), _signed(stretch)]
        yield pa.record_batch(columns, names=["anchor", "doc", "place", "stretch"])


def _slim(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("doc"), filled(text).cast("binary").alias("text"), F.col(key).cast("long").alias("doc_id")
    )


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the way to the places found in them."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        texts = pa.array([pack.compress(t.as_py()) for t in batch.column(1)], pa.binary())
        yield pa.record_batch([batch.column(0), texts, batch.column(2)], names=["doc", "text", "doc_id"])


def _with_places(slim: DataFrame, places: DataFrame, how: str, each: Callable, schema: str) -> DataFrame:
    """Columns that ``each(words, doc, doc_id, places)`` gives for the documents, put together; places are those of one document."""
    fields = [c for c in places.columns if c != "doc"]
    listed = places.groupBy("doc").agg(F.collect_list(F.struct(*fields)).alias("places"))
    packed = slim.mapInArrow(_packed, "doc long, text binary, doc_id long")
    names = [x.split()[0] for x in schema.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for part in parts:
            kinds = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]
            rows = []
            for i in range(part.num_rows):
                words = unpack.decompress(part.column(1)[i].as_py()).split()
                columns = each(words, part.column(0)[i].as_py(), part.column(2)[i].as_py(), part.column(3)[i])
                rows.append(pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names))
            yield from pa.Table.from_batches(rows).combine_chunks().to_batches()

    return packed.join(listed, "doc", how).select("doc", "text", "doc_id", "places").mapInArrow(batches, schema)


def _held(words: list[bytes], found: pa.Scalar) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, Spans]]:
    """The fields of the places whose stretch the text really has, their starts and windows, and the hashes of spans. Rows that
    share an id but not a text thus get only places of their own."""
    if not found.is_valid or not len(found.values) or len(words) < WINDOW:
        return
    hashes = word_hashes(words)
    spans = Spans(hashes)
    fields = {f.name: found.values.field(f.name).to_numpy(zero_copy_only=False) for f in found.values.type}
    start, windows = fields["place"] >> 32, fields["place"] & 0xFFFFFFFF
    inside = start + windows + WINDOW - 1 <= len(words)
    own = fields["stretch"] == fields["anchor"]
    # Of windows that are their own anchor, and equal, one stands for all; two in a row are of one word throughout.
    size = np.where(own, WINDOW, windows + WINDOW - 1)
    real = spans.of(np.where(inside, start, 0), np.where(inside, size, 0)).view(np.int64)
    changes = np.append(0, np.cumsum(hashes[1:] != hashes[:-1]))
    last = np.where(inside & own, start + windows + WINDOW - 2, 0)
    run = ~own | (windows == 1) | (changes[last] == changes[np.where(inside, start, 0)])
    true = inside & run & (real == fields["stretch"])
    yield {k: v[true] for k, v in fields.items()}, start[true], windows[true], spans


def _window_rows(words: list[bytes], doc: int, _: int | None, found: pa.Scalar) -> tuple:
    for fields, start, windows, spans in _held(words, found):
        which = np.repeat(np.arange(len(start)), windows)
        step = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
        value = spans.of(start[which] + step, np.full(len(which), WINDOW)).view(np.int64)
        return fields["anchor"][which], fields["stretch"][which], step, value, np.full(len(which), doc)
    return ([],) * 5


def _kept(words: list[bytes], _: int, doc_id: int | None, found: pa.Scalar) -> tuple:
    change = np.zeros(len(words) + 1, np.int64)
    for fields, start, windows, _hashes in _held(words, found):
        every = fields["steps"] == -1
        np.add.at(change, start[every], 1)
        np.add.at(change, start[every] + windows[every] + WINDOW - 1, -1)
        for i in np.flatnonzero(~every):
            steps = np.array([b for b in range(min(63, int(windows[i]))) if int(fields["steps"][i]) >> b & 1], np.int64)
            np.add.at(change, start[i] + steps, 1)
            np.add.at(change, start[i] + steps + WINDOW, -1)
    gone = np.cumsum(change)[:-1] > 0
    left = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
    return [doc_id], [len(words)], [int(gone.sum())], [hashlib.sha256(left).hexdigest()]


def repeated_places(slim: DataFrame) -> DataFrame:
    """(doc, place, anchor, stretch, steps): stretches of documents that a smaller ``doc`` has too; ``steps`` has a bit for
    each window that is meant, all bits for all windows."""
    found = written(slim.select("doc", "text").mapInArrow(_stretch_batches, "anchor long, doc long, place long, stretch long"), "found")
    shared = found.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("anchor")
    # Written, so that the join's sides come straight from exchanges and a hot anchor can be split.
    shared = written(shared, "shared")
    again = written(found.join(shared, "anchor"), "again")
    same = written(again.groupBy("anchor", "stretch").agg(F.min(F.struct("doc", "place")).alias("least")), "stretches")
    different = written(same.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor"), "different")
    asked = same.join(different, "anchor").select("least.doc", "least.place", "anchor", "stretch")
    windows = written(
        _with_places(slim, asked, "inner", _window_rows, "anchor long, stretch long, step long, value long, doc long"), "windows"
    )
    least = windows.groupBy("anchor", "value").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("anchor", "value", "lo")
    late = windows.join(least, ["anchor", "value"]).where("doc > lo")
    steps = late.groupBy("anchor", "stretch").agg(F.bit_or(F.expr("shiftleft(1L, CAST(step AS INT))")).alias("steps"))
    known = same.join(steps, ["anchor", "stretch"], "left").select("anchor", "stretch", F.col("least.doc").alias("owner"), "steps")
    placed = again.join(written(known, "known"), ["anchor", "stretch"])
    steps_of = F.when(F.col("doc") > F.col("owner"), F.lit(-1).cast("long")).otherwise(F.col("steps"))
    return placed.select("doc", "place", "anchor", "stretch", steps_of.alias("steps")).where("steps IS NOT NULL")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row: the words outside all windows of ``WINDOW`` words that start in a
    document with a smaller id as well, joined by one blank.

    Windows are judged on the input. A null text has no words; a text of fewer than ``WINDOW`` words keeps them. Rows of one
    id never take words from each other, whether they are repeated rows or not; a null id counts as larger than all
    others, and null ids as one. Rows come back as often as they are there; an empty frame gives an empty result.
    """
    slim = _slim(docs, key, text)
    places = written(repeated_places(slim), "places")
    return _with_places(slim, places, "left", _kept, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op13_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS t FROM p),
least AS (SELECT t, min(doc_id) AS lo, max(doc_id) AS hi FROM k GROUP BY t),
late AS (SELECT k.doc_id, k.i FROM k JOIN least USING (t) WHERE lo < hi AND k.doc_id > lo),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM (SELECT doc_id, unnest(range(i, i + 13)) AS j FROM late) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(js), 0) AS n_removed,
  sha256(CASE WHEN js IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_filter(w, lambda x, i: NOT list_contains(js, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
"""
