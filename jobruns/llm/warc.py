"""Writing pages as WARC archives and reading archives back in parallel, from any byte on.

Writing is one pass: a page whose payload (of at least ``MIN_REVISIT`` bytes) another page has as well becomes
a revisit of the page with the largest id. Reading cuts the files wherever Spark does and splits them at the
magic ``WARC/1.``, which may also stand inside a payload. Each task lists candidate records with the offset
where the record's own length says that its successor begins. Where a block's chains leave it is worked out
per block; pointer jumping over these exits, from each file's first byte, finds the one true entry of each
block in a logarithmic number of rounds, and the chain from there keeps the true records. What is left over
is payload, and goes back to the record around it.

Offsets are those of the file and do not depend on how Spark cuts it: a block's first offset is the sum of
what the blocks before it hold. Files are read and written by Spark alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobruns.llm.common import filled, folder, table, written

MAGIC = b"WARC/1."
MIN_REVISIT = 1000
#: Repeated payloads up to this number are sent to every task (a row is under 100 bytes); more are joined.
BROADCAST_ROWS = 200_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


# Writing


def _name(key: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), filled(key.cast("string")), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    return F.concat(*[F.concat(F.lit(f"{n}: "), filled(v.cast("string")), F.lit("\r\n")) for n, v in fields], F.lit("\r\n"))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """One WARC record per page, in column ``value``, without the newline that ends it.

    Null bodies are empty. Pages that repeat the id of the response of their payload are responses too; a page
    without an id is a revisit where another page with its payload has one. Line ends in addresses are escaped.
    """
    slim = pages.select(
        F.col(key).cast("long").alias("key"),
        F.replace(F.replace(filled(url), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("url"),
        filled(body).alias("body"),
    ).withColumn("size", F.octet_length("body"))
    equal = F.when(F.col("size") >= MIN_REVISIT, F.sha2(F.col("body").cast("binary"), 256))
    shared = written(
        slim.select("key", equal.alias("equal"))
        .where("equal IS NOT NULL")
        .groupBy("equal")
        .agg(F.max("key").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .select("equal", "first"),
        "shared",
    )
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    known = slim.withColumn("equal", equal).join(shared, "equal", "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("key"))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\n"), _lines(("Content-Type", F.lit("text/html; charset=utf-8")), ("Content-Length", F.col("size")))
    )
    sent = F.when(again, F.lit("")).otherwise(F.col("body"))
    kind = F.when(again, F.lit("revisit")).otherwise(F.lit("response"))
    revisit = F.when(
        again,
        F.concat(F.lit("WARC-Refers-To: "), _name(F.col("first")), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n")),
    ).otherwise(F.lit(""))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), kind, F.lit("\r\n"), revisit,
        _lines(
            ("WARC-Record-ID", _name(F.col("key"))),
            ("WARC-Date", F.lit(DATE)),
            ("WARC-Target-URI", F.col("url")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("body").cast("binary")))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length(http) + F.octet_length(sent)),
        ),
    )
    return known.select(F.concat(head, http, sent, F.lit("\r\n\r")).alias("value"))


def write_warc(pages: DataFrame, path: str, **columns: str) -> None:
    """The pages' records as uncompressed archives, one file per task."""
    records(pages, **columns).write.text(path)


# Reading

CHUNK = (
    "file string, block long, rel long, size long, next long, type string, name string, refers_to string, "
    "url string, payload_bytes long, payload_digest string, raw binary"
)
_FIELDS = [f.split()[0] for f in CHUNK.split(", ")]
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
CHUNK_ARROW = pa.schema([(n, _KINDS[k]) for n, k in (f.split() for f in CHUNK.split(", "))])
_VERSION = re.compile(rb"[01]\r\n")
_LENGTH = re.compile(rb"[ \t]*[0-9]{1,18}[ \t]*")


def _fields(head: bytes) -> dict[bytes, bytes]:
    """Header fields by lower-case name; the first of a name counts."""
    out: dict[bytes, bytes] = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def extent(raw: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    """For what follows the magic: how far the record reaches (with its end), and its fields; None if it is no record."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not _VERSION.match(raw):
        return None
    fields = _fields(raw[:end])
    length = fields.get(b"content-length", b"")
    return (end + 4 + int(length) + 4, fields) if _LENGTH.fullmatch(length) else None


def payload(record: bytes, fields: dict[bytes, bytes]) -> tuple[int | None, str | None, bytes]:
    """Size, SHA-1 and bytes of a whole record's payload; a revisit's size and digest are those it declares."""
    block = record[record.find(b"\r\n\r\n") + 4 : -4]
    http, body = {}, block
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        end = block.find(b"\r\n\r\n")
        http, body = _fields(block[:end]), block[end + 4 :]
    if fields.get(b"warc-type") == b"revisit":
        size = http.get(b"content-length", b"")
        declared = fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:").lower()
        return (int(size) if _LENGTH.fullmatch(size) else None), declared or None, b""
    return len(body), hashlib.sha1(body).hexdigest(), body  # noqa: S324


def _text(fields: dict[bytes, bytes], name: bytes) -> str | None:
    value = fields.get(name)
    return value.decode("utf-8", "replace") if value is not None else None


def _described(fields: dict[bytes, bytes]) -> dict[str, str | None]:
    return {
        "type": _text(fields, b"warc-type"),
        "name": _text(fields, b"warc-record-id"),
        "refers_to": _text(fields, b"warc-refers-to"),
        "url": _text(fields, b"warc-target-uri"),
    }


def _chunk_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What lies between two magics, with its place in its block. A record that is whole is digested here."""
    at, rel = None, 0
    for batch in batches:
        rows = []
        for file, block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            raw = raw.as_py()
            if at != (file, block):
                at, rel = (file, block), 0
            row = dict.fromkeys(_FIELDS) | {"file": file, "block": block, "rel": rel, "size": len(raw), "raw": raw}
            if found := extent(raw):
                reach, fields = found
                row |= _described(fields) | {"next": rel + reach}
                if reach == len(raw):
                    row["payload_bytes"], row["payload_digest"], _ = payload(raw, fields)
            rows.append(row)
            rel += len(raw) + len(MAGIC)
        yield pa.RecordBatch.from_pylist(rows, CHUNK_ARROW)


def _chain(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A block's chunks in order, their offsets, their successors (-1: none), and the successors' rows (-1: not here)."""
    rows = rows.sort_by("at")
    at, to = rows["at"].to_numpy(), rows["to"].to_numpy()
    row = np.searchsorted(at, to).clip(max=len(at) - 1)
    return rows, at, to, np.where((at[row] == to) & (to >= 0), row, -1)


def _exits(rows: pa.Table) -> pa.Table:
    """For every candidate, the offset outside its block that its chain leads to (-1: it ends at what is no record)."""
    rows, at, to, row = _chain(rows)
    out = to.copy()
    for i in range(len(at) - 1, -1, -1):
        if row[i] > i:
            out[i] = out[row[i]]
    valid = to >= 0
    return pa.table({"file": rows["file"].filter(pa.array(valid)), "at": at[valid], "to": out[valid]})


def _owners(rows: pa.Table) -> pa.Table:
    """For every chunk of a block the true record it belongs to, where that begins in this block."""
    rows, at, to, row = _chain(rows)
    true = np.zeros(len(at), bool)
    i = int(np.searchsorted(at, rows["entry"][0].as_py())) if rows["entry"][0].is_valid else -1
    while i >= 0 and to[i] >= 0:
        true[i] = True
        i = int(row[i]) if row[i] > i else -1
    owner = np.maximum.accumulate(np.where(true, at, -1))
    return pa.table(
        {"file": rows["file"], "block": rows["block"], "at": at, "owner": pa.array(owner, mask=owner < 0)}
    )


def _reached(exits: DataFrame) -> DataFrame:
    """(file, at): the offsets among the blocks' exits that the chain from each file's first byte comes by."""
    heads = exits.where("at = 0").select("file", "at")
    entered = exits.select("file", F.col("to").alias("at")).distinct()
    jumps = written(exits.join(entered.unionByName(heads).distinct(), ["file", "at"], "left_semi"), "jumps-0")
    reached, n, step = written(heads, "reached-0"), -1, 0
    while (m := reached.count()) != n:
        n, step = m, step + 1
        there = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = written(reached.unionByName(there).distinct(), f"reached-{step}")
        onward = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("further"))
        jumps = written(jumps.join(onward, ["file", "to"]).select("file", "at", F.col("further").alias("to")), f"jumps-{step}")
    return reached


def _assembled(rows: pa.Table) -> pa.Table:
    """The record that a run of chunks makes."""
    rows = rows.sort_by("at")
    whole = MAGIC.join(rows["raw"].to_pylist())
    reach, fields = extent(whole)
    out = {"file": rows["file"][0].as_py(), "at": rows["owner"][0].as_py(), **_described(fields)}
    out |= {"payload_bytes": None, "payload_digest": None, "payload": None}
    if reach <= len(whole):
        out["payload_bytes"], out["payload_digest"], out["payload"] = payload(whole[:reach], fields)
    kinds = {"at": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.table({k: pa.array([v], kinds.get(k, pa.string())) for k, v in out.items()})


RECORD = "file string, at long, type string, name string, refers_to string, url string, payload_bytes long, payload_digest string"


def _payload_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [x.as_py() for x in batch.column(batch.num_columns - 1)]
        bodies = [payload(r, extent(r)[1])[2] for r in raw]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bodies, pa.binary())], names=[*batch.schema.names[:-1], "payload"])


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under ``path``: ``RECORD`` and, if asked for, ``payload``.

    ``at`` is the record's first byte in its file. Files that do not begin with a record give none; a record
    whose file ends before it does has no payload columns. Records are those of the chain from the file's
    start, whatever their payloads contain.
    """
    parts = spark.read.option("lineSep", MAGIC.decode()).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw")
    )
    store = folder(spark, "chunks")
    parts.mapInArrow(_chunk_batches, CHUNK).write.option("compression", "zstd").parquet(store)
    chunks = spark.read.schema(CHUNK).parquet(store)

    sums = chunks.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("held"))
    earlier = F.sum("held").over(Window.partitionBy("file").orderBy("block")) - F.col("held")
    bases = written(sums.select("file", "block", (earlier - len(MAGIC)).alias("base")), "bases")
    # The offset of a chunk is that of the magic before it; the first chunk of a file has none and lies before 0.
    placed = chunks.join(bases, ["file", "block"]).withColumn("at", F.col("base") + F.col("rel"))
    after = F.coalesce(F.col("base") + F.col("next") + len(MAGIC), F.lit(-1))
    chain = written(placed.where("at >= 0").select("file", "block", "at", after.alias("to"), "size"), "chain")

    exits = chain.select("file", "block", "at", "to").groupBy("file", "block").applyInArrow(_exits, "file string, at long, to long")
    reached = _reached(written(exits, "exits"))
    entries = chain.join(reached, ["file", "at"], "left_semi").groupBy("file", "block").agg(F.min("at").alias("entry"))
    owners = chain.select("file", "block", "at", "to").join(entries, ["file", "block"], "left")
    owned = written(
        owners.groupBy("file", "block").applyInArrow(_owners, "file string, block long, at long, owner long"), "owned"
    )
    true = owned.where("owner = at").join(chain, ["file", "block", "at"]).select(
        "file", "block", "at", (F.col("to") - F.col("at") == F.col("size") + len(MAGIC)).alias("whole")
    )
    true = written(true, "true")
    described = [c for c in RECORD.split(", ")[2:]]
    columns = ["file", "at", *[c.split()[0] for c in described]]
    own = placed.join(true.where("whole").select("file", "block", "at"), ["file", "block", "at"])
    if payloads:
        schema = f"{RECORD}, payload binary"
        plain = own.select(*columns, "raw").mapInArrow(_payload_batches, schema)
    else:
        plain = own.select(*columns)
    broken = true.where("NOT whole").select("file", F.col("at").alias("owner"))
    if broken.isEmpty():
        return plain
    last = owned.groupBy("file", "block").agg(F.max("owner").alias("last"))
    before = F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select("file", "block", before.alias("before"))
    inside = (
        owned.join(carried, ["file", "block"])
        .select("file", "block", "at", F.coalesce("owner", "before").alias("owner"))
        .join(broken, ["file", "owner"], "left_semi")
    )
    pieces = placed.select("file", "block", "at", "raw").join(inside, ["file", "block", "at"])
    joined = pieces.groupBy("file", "owner").applyInArrow(_assembled, f"{RECORD}, payload binary")
    return plain.unionByName(joined if payloads else joined.drop("payload"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "archive")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read_warc(spark, path, payloads=False).select(
        page("name").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        page("refers_to").alias("refers_to"),
    )


SQL = f"""
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages)
, f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT} AND top <> page_id THEN top END AS refers_to
FROM f
"""
