"""Archives: exact round trips, whatever payloads contain and wherever Spark cuts."""

import uuid

import pytest

from jobruns.llm import warc
from jobruns.llm.common import folder

SCHEMA = "page_id long, url string, html string, type string, at long, raw binary"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, b"") for r in rows], SCHEMA)


def record(payload, name="inner"):
    return (
        f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{name}>\r\nContent-Length: {len(payload.encode())}\r\n\r\n"
        f"{payload}\r\n\r\n"
    )


@pytest.fixture(params=["134217728", "6000"])
def cut(spark, request):
    """Files as one block, and cut every few hundred bytes, inside magics and payloads."""
    names = {"spark.sql.files.maxPartitionBytes": request.param, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_round_trip(spark, cut):
    nested = "before " + record("in " + record("deep", "9")) + record("x" * 900, "8") + "WARC/1.0\r\n no header" + "WARC/1." * 50
    rows = [
        (0, "http://a/", None),
        (1, None, ""),
        (2, "http://b/\r\nWARC-Type: request", "é" * 499 + "xy"),
        (3, "http://c/", "é" * 499 + "xy"),
        (4, "http://d/", "short"),
        (5, "http://e/", "short"),
        (6, "http://f/", nested),
        (7, "http://g/", nested * 4 + "\r\n\r\n"),
        (None, "http://h/", "é" * 499 + "xy"),
        (12, "http://i/", "WARC/1.0\r\nContent-Length: 999999999\r\n\r\n" + "y" * 3000),
        *[(100 + i, "http://z/", f"{i} " * (i % 300)) for i in range(120)],
    ]
    path = folder(spark, "warc")
    warc.write_warc(pages(spark, rows).coalesce(2), path)
    found = {r.name: r for r in warc.read_warc(spark, path).collect()}
    assert len(found) == len(rows)
    for key, _, html in rows:
        r = found[f"<urn:page:{'' if key is None else key}>"]
        again = key in (2, None)
        assert r.type == ("revisit" if again else "response")
        assert r.refers_to == ("<urn:page:3>" if again else None)
        assert r.payload_bytes == len((html or "").encode())
        assert bytes(r.payload) == (b"" if again else (html or "").encode())
    assert found["<urn:page:2>"].url == "http://b/%0D%0AWARC-Type: request"
    assert found["<urn:page:2>"].payload_digest == found["<urn:page:3>"].payload_digest
    light = {r.name: r.payload_digest for r in warc.read_warc(spark, path, payloads=False).collect()}
    assert light == {n: r.payload_digest for n, r in found.items()}


def test_empty_table(spark):
    path = folder(spark, "warc")
    warc.write_warc(pages(spark, []), path)
    assert warc.read_warc(spark, path).count() == 0


def test_the_chain_ends_at_what_is_no_record(spark):
    path = f"{folder(spark, uuid.uuid4().hex)}"
    body = record("one", "1") + record("two", "2")[:-9]
    spark.createDataFrame([(body[:-1],)], "value string").write.option("lineSep", body[-1]).text(path)
    (found,) = warc.read_warc(spark, path).collect()
    assert bytes(found.payload) == b"one"


def test_a_record_that_its_file_cuts_off_has_no_payload(spark):
    path = f"{folder(spark, uuid.uuid4().hex)}"
    body = record("one", "1") + record("two and more", "2")[:-9]
    spark.createDataFrame([(body[:-1],)], "value string").write.option("lineSep", body[-1]).text(path)
    found = {r.name: r.payload for r in warc.read_warc(spark, path).collect()}
    assert found == {"<urn:page:1>": b"one", "<urn:page:2>": None}
