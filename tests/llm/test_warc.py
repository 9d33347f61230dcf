"""ARC to WARC: versions, revisits, identifiers and awkward rows."""

import base64
import gzip
import hashlib

import pytest

from quillon.llm import op01_warc as warc
from quillon.llm import queries
from quillon.llm._common import shared_dir


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute_force(pages):
    """(page_id, bytes, digest, type, refers_to) by the contract, of rows (page_id, url, html) with distinct ids."""
    smallest = {}
    for i, _, t in pages:
        smallest[t or ""] = min(i, smallest.get(t or "", i))
    return sorted((i, len((t or "").encode()), digest(t), "response" if smallest[t or ""] == i else "revisit", None if smallest[t or ""] == i else smallest[t or ""]) for i, _, t in pages)


def test_round_trip_equals_brute_force(spark):
    rows = [(3, "http://a/ b", "same"), (1, "http://a", "same"), (2, None, None), (5, "u", ""), (4, "http://é", "unique\r\n\r\nWARC/1.0"), (6, "\n\r", "\x00\x1f\x8b é" * 5000), (7, "v", "same")]
    got = rows_of(warc.pages_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)))
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == brute_force(rows)


def test_all_pages_with_copies_equal_brute_force(spark):
    """The whole table, a third of it copied under new ids and half of those with one payload."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    more = pages.where("page_id % 3 = 0").selectExpr("page_id + 1000000 as page_id", "url", "case when page_id % 2 = 0 then 'hot' else html end as html")
    table = pages.select("page_id", "url", "html").union(more)
    got = rows_of(warc.pages_round_trip(table))
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == brute_force([tuple(r) for r in table.collect()])
    assert any(r["record_type"] == "revisit" for r in got)


def test_revisits_name_a_record_that_exists(spark):
    rows = [(i, f"http://{i}", "same" if i % 2 else "other") for i in range(8)]
    got = rows_of(warc.pages_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")))
    by_id = {r["record_id"]: r for r in got}
    assert len(by_id) == 8
    for r in got:
        if r["record_type"] == "revisit":
            first = by_id[r["refers_to_id"]]
            assert (first["page_id"], first["record_type"], first["payload_digest"]) == (r["refers_to"], "response", r["payload_digest"])


def test_null_and_repeated_keys_and_clashing_columns(spark):
    rows = [(None, "a", "same", "d", 1), (2, "b", "same", "d", 2), (2, "b", "same", "d", 2), (None, "c", None, "d", 3), (9, "e", "x", None, None)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, key int")
    got = rows_of(warc.pages_round_trip(table))
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == [("2", "response", None), ("2", "revisit", 2), ("9", "response", None), ("None", "response", None), ("None", "revisit", 2)]
    assert rows_of(warc.pages_round_trip(spark.createDataFrame([], "page_id long, url string, html string"))) == []


def test_archives_of_others_are_deduplicated_across_files(spark, tmp_path):
    """Records without a key: told apart by file and place, so that ids don't clash and copies are found."""
    record = {"url": "http://x", "ip": "1.2.3.4", "date": "20010203040506", "mime": "text/html", "block": b"HTTP/1.0 200 OK\r\nServer: s\r\n\r\nabc\ndef"}
    bare = {**record, "block": b"no header"}
    (tmp_path / "one.arc").write_bytes(warc.arc_file([record, bare], 1))
    (tmp_path / "two.arc.gz").write_bytes(gzip.compress(warc.arc_file([record, record], 2)))
    out = shared_dir(spark)
    warc.write_members(warc.convert(warc.read_arc(spark, str(tmp_path))), out)
    got = rows_of(warc.read_warc(warc.read_members(spark, out)))
    assert sorted(r["record_type"] for r in got) == ["resource", "response", "revisit", "revisit"]
    ids = {r["record_id"] for r in got}
    assert len(ids) == 4 and {r["refers_to_id"] for r in got if r["record_type"] == "revisit"} == {r["record_id"] for r in got if r["record_type"] == "response"}
    assert all(r["warc_date"] == "2001-02-03T04:05:06Z" for r in got) and sorted(r["payload_bytes"] for r in got) == [7, 7, 7, 9]
    assert len(rows_of(warc.read_warc_files(spark, out))) == 4


def test_arc_versions_and_declared_lengths():
    record = {"url": "http://x y", "ip": "1.2.3.4", "date": "20010203040506", "mime": "text/html", "block": b"abc\ndef"}
    for version in (1, 2):
        data = warc.arc_file([record, record], version)
        for blob in (data, gzip.compress(data)):
            assert [r["block"] for r in warc.parse_arc(blob)] == [b"abc\ndef"] * 2
            assert next(warc.parse_arc(blob))["URL"] == "http://x y"
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-5]))
    assert "Result-code" in next(warc.parse_arc(warc.arc_file([record], 2)))


def test_query_has_a_row_per_page(spark):
    got = queries.op1_warc(spark, "/root/testdata/sf0.001")
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] and got.count() == 50
