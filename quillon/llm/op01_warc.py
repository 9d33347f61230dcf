"""Legacy archive converter: ARC files in, WARC files out, and a reader for both.

ARC files open with a version block whose body names the fields of every later header line; a header
line ends with the declared length of its record. The converter follows that declaration, then makes
what WARC asks for and ARC lacks: record identifiers, ISO timestamps, types and digests. A record is
identified by its file and place there. Of records with equal payloads the one of smallest key (none
last, then by identifier) is the response; the others become revisits that refer to its identifier.
Only digests meet to find it; payloads are packed where they were read, unless the revisits are too
many to be broadcast.

Written archives hold one gzip member per record, parted by an empty member, so that Spark reads them
back member by member however large a file is. Other archives are read a file at a time: 2 GB at most,
the usual cut being 1 GB.

Defined results: a null payload is an empty one; a null key is written as none and read back as null.
Rows that repeat a key are records of their own: with equal payloads one is the response and the others
revisit it. An empty table gives an archive without records; columns other than those named are
ignored. A record shorter than it declares raises ValueError.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm._common import salted_join, shared_dir, slices, small_batches, stage

#: Fields of a header line by ARC version; fixed values of the format.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
#: A gzip member without content: Spark's text writer puts it between members, and readers skip it.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ARC ------------------------------------------------------------------------------------------------
def arc_record(names: list[str], fields: dict[str, str], block: bytes) -> bytes:
    line = " ".join({**fields, "Archive-length": str(len(block))}.get(n, "-") or "-" for n in names)
    return line.encode("utf-8") + b"\n" + block + b"\n"


def arc_start(version: int, origin: str = "quillon") -> bytes:
    """The version block that an ARC file opens with."""
    body = f"{version} 0 {origin}\n{' '.join(ARC_FIELDS[version])}\n".encode()
    first = {"URL": f"filedesc://{origin}.arc", "IP-address": "0.0.0.0", "Archive-date": "20240101000000", "Content-type": "text/plain"}
    return arc_record(ARC_FIELDS[version], first, body)


def arc_entry(r: dict, version: int) -> bytes:
    fields = {"URL": r["url"], "IP-address": r["ip"], "Archive-date": r["date"], "Content-type": r["mime"], "Result-code": str(r.get("code", 200))}
    return arc_record(ARC_FIELDS[version], fields, r["block"])


def arc_file(records: list[dict], version: int, origin: str = "quillon") -> bytes:
    """An ARC file of records with url, ip, date (14 digits), mime, code and block (bytes)."""
    return arc_start(version, origin) + b"".join(arc_entry(r, version) for r in records)


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file (plain or gzip): a dict of the version's header fields, and block."""
    raw = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    names, f = ARC_FIELDS[1], io.BufferedReader(raw)
    while line := f.readline():
        if not line.strip():
            continue
        parts = line.decode("utf-8", "replace").rstrip("\r\n").rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header line: {line[:80]!r}")
        block = f.read(int(parts[-1]))
        if len(block) != int(parts[-1]):
            raise ValueError(f"record of {parts[0][:80]} has {len(block)} of {parts[-1]} bytes")
        if parts[0].startswith("filedesc://"):
            version, fields = block.split(b"\n")[:2]
            names = fields.decode("ascii").split() or ARC_FIELDS[int(version.split()[0])]
            continue
        yield dict(zip(names, parts, strict=True)) | {"block": block}


# WARC -----------------------------------------------------------------------------------------------
def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_id(file: str, place: int) -> str:
    """The same for the same record of a file however often it is read, so that a lost task can be done again."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{file}#{place}").urn


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header and payload; a block without an HTTP header is all payload."""
    end = block.find(b"\r\n\r\n") if block.startswith(b"HTTP/") else -1
    return (block[: end + 4], block[end + 4 :]) if end >= 0 else (b"", block)


def key_of(head: bytes) -> int | None:
    """The key that an HTTP header carries, as those of written pages do."""
    for line in head.split(b"\r\n"):
        name, _, value = line.partition(b":")
        if name.lower() == KEY_HEADER.encode() and value.strip().lstrip(b"-").isdigit():
            return int(value)
    return None


def iso_date(arc_date: str) -> str:
    d = (arc_date if arc_date.isdigit() else "").ljust(14, "0")
    return f"{d[:4]}-{d[4:6].replace('00', '01')}-{d[6:8].replace('00', '01')}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def packed(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def warc_member(r: dict) -> bytes:
    """The WARC record of a parsed ARC record as a gzip member; a revisit, if r names the record that it repeats."""
    head, payload = split_http(r["block"])
    again = r.get("first_id") is not None
    block = head if again else r["block"]
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response' if head else 'resource'}", f"WARC-Record-ID: <{r['id']}>", f"WARC-Date: {iso_date(r['date'])}"]
    lines += [f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha1:{r['digest']}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if again:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{r['first_id']}>", f"WARC-Refers-To-Target-URI: {r['first_url']}", f"WARC-Refers-To-Date: {iso_date(r['first_date'])}", f"X-Payload-Length: {len(payload)}"]
        lines += [f"X-Refers-To-Key: {r['first_key']}"] if r["first_key"] is not None else []
    lines += ["Content-Type: " + ("application/http; msgtype=response" if head else "application/octet-stream")]
    lines += [f"X-Record-Key: {r['key']}"] if r["key"] is not None else []
    return packed("\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode("utf-8", "replace") + block + b"\r\n\r\n")


def iter_warc(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers (lower-case names) and block of each record of a WARC file or member, plain or gzip."""
    raw = gzip.GzipFile(fileobj=io.BytesIO(data)) if data[:2] == b"\x1f\x8b" else io.BytesIO(data)
    f = io.BufferedReader(raw, 1 << 16)
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC version line: {line[:80]!r}")
        head = {}
        while (line := f.readline().decode("utf-8", "replace").rstrip("\r\n")) != "":
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        n = int(head["content-length"])
        block = f.read(n)
        if len(block) != n:
            raise ValueError(f"record {head.get('warc-record-id')} has {len(block)} of {n} bytes")
        yield head, block


# DataFrames -----------------------------------------------------------------------------------------
#: The HTTP header in which a page's key travels.
KEY_HEADER = "x-page-id"
#: Bytes of records after which a parsed batch is passed on, and revisits that may be broadcast.
PASS_ON, FEW_REVISITS = 8 << 20, 200_000


def write_members(members: DataFrame, path: str) -> None:
    """Writes (member), gzip members, in their order, through Spark's own committer and file systems."""
    text = members.select(F.col("member").cast("string").alias("value"))
    with small_batches(members.sparkSession):
        text.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """(member) of the files that write_members wrote; a file is read in parts like any text."""
    text = spark.read.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)
    return text.select(F.col("value").cast("binary").alias("member")).where(F.octet_length("member") > 0)


def write_arc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """An ARC file for each partition of pages, of version 1 and 2 in turn; records are gzip members."""
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(url), F.lit("about:blank")).alias("url"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))

    def make(batches):
        from pyspark import TaskContext

        version = 1 + TaskContext.get().partitionId() % 2
        started = False
        for b in slices(batches):
            out = [] if started else [packed(arc_start(version), 1)]
            started = True
            for k, u, p in zip(*(b[c].to_pylist() for c in ("key", "url", "payload")), strict=True):
                own = b"" if k is None else b"%s: %d\r\n" % (KEY_HEADER.encode(), k)
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (own, len(p)) + p
                u = "%0A".join(u.splitlines()) or "about:blank"
                out.append(packed(arc_entry({"url": u, "ip": "0.0.0.0", "date": "20240101000000", "mime": "text/html", "block": block}, version), 1))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    write_members(rows.mapInArrow(make, "member binary"), path)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(file, arc) of ARC files, plain or gzip, in any store that Spark reads."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    return files.select(F.col("path").alias("file"), F.col("content").alias("arc"))


_RECORD = "id string, key long, url string, ip string, date string, digest string, n long"
_SLIM = pa.schema([("id", pa.string()), ("key", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("n", pa.int64())])


def arc_records(arc: DataFrame, blocks: bool) -> DataFrame:
    """The records of ARC files (file, arc): id, key, url, ip, date, digest and bytes of the payload, and if wanted the block."""
    schema = pa.schema([*_SLIM, ("block", pa.binary())]) if blocks else _SLIM

    def parse(batches):
        for b in batches:
            for file, blob in zip(b["file"], b["arc"], strict=True):
                rows, size, file = [], 0, file.as_py()
                for place, r in enumerate(parse_arc(blob.as_py())):
                    head, payload = split_http(r["block"])
                    rows.append({"id": record_id(file, place), "key": key_of(head), "url": r["URL"], "ip": r["IP-address"], "date": r["Archive-date"], "digest": sha1_base32(payload), "n": len(payload), "block": r["block"] if blocks else None})
                    size += len(r["block"]) if blocks else 200
                    if size > PASS_ON:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return arc.mapInArrow(parse, _RECORD + (", block binary" if blocks else ""))


def convert(arc: DataFrame, min_bytes: int = 0) -> DataFrame:
    """ARC files (file, arc) to WARC records (member); equal payloads of min_bytes or more become revisits of one response."""
    records = stage(arc_records(arc, False).drop("ip"))
    order = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "id", "url", "date")).alias("f")
    first = records.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(order, F.count("*").alias("c")).where("c > 1")
    first = first.select("digest", "n", F.col("f.id").alias("first_id"), F.col("f.key").alias("first_key"), F.col("f.url").alias("first_url"), F.col("f.date").alias("first_date"))
    again = salted_join(records.select("id", "digest", "n"), first, ["digest", "n"], F.col("id")).where("id <> first_id").drop("digest", "n")
    again = stage(again)
    again = F.broadcast(again) if again.count() <= FEW_REVISITS else again
    full = arc_records(arc, True).join(again, "id", "left")

    def make(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([warc_member(r) for r in b.to_pylist()], pa.binary())], names=["member"])

    return full.mapInArrow(make, "member binary")


_ROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_id", pa.string()), ("url", pa.string()), ("warc_date", pa.string())])


def warc_row(head: dict, block: bytes) -> dict:
    """What a WARC record says, by its keys; a payload that its digest doesn't fit raises ValueError."""
    http, payload = split_http(block)
    digest, kind, n = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"], len(payload)
    if kind == "revisit":
        declared = [x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        declared = [head["x-payload-length"]] if "x-payload-length" in head else declared
        n = int(declared[0]) if declared else None
    elif sha1_base32(payload) != digest:
        raise ValueError(f"record {head['warc-record-id']}: its payload has another digest")
    key, ref = head.get("x-record-key"), head.get("x-refers-to-key")
    return {"page_id": key and int(key), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": ref and int(ref), "record_id": head["warc-record-id"], "refers_to_id": head.get("warc-refers-to"), "url": head["warc-target-uri"], "warc_date": head["warc-date"]}


def read_warc(archives: DataFrame) -> DataFrame:
    """One row per record of WARC files or members, the binary first column; digests of full payloads are checked."""

    def read(batches):
        for b in slices(batches):
            rows = []
            for blob in b.column(0):
                for head, block in iter_warc(blob.as_py()):
                    if "warc-payload-digest" in head:
                        rows.append(warc_row(head, block))
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ROW)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    return archives.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_id string, url string, warc_date string")


def read_warc_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files of others, plain or gzip, a file at a time."""
    return read_warc(spark.read.format("binaryFile").load(path).where("length > 0").select("content"))


def pages_round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as ARC files, those converted to WARC files, all in the shared folder, and these read back."""
    spark = pages.sparkSession
    arc, warc = shared_dir(spark), shared_dir(spark)
    write_arc(pages, arc)
    write_members(convert(read_arc(spark, arc)), warc)
    return read_warc(read_members(spark, warc))
