"""WARC archives: one gzip member per record, written and read in splits by Spark's own text source.

Writing. Payloads that occur more than once, and have at least ``LEAST_REVISIT`` bytes, are stored once, with the largest
page id; the other pages get revisit records that name it. A text file of Spark may hold any bytes: a member's last byte,
the highest of its length, is zero for records under 16 MiB, so members go out without it and a line separator of one
zero byte puts it back. A larger record is followed by an empty member, which ends in zero as well.

Reading. Spark deals out byte ranges of the files; its line reader looks for the gzip magic as line separator and gives
each range the pieces that begin inside it, so a range may begin anywhere. A piece is only a candidate: it is a record if
its header decodes and its first bytes inflate to a WARC version line. A magic inside compressed data cuts a member; it
goes on in the next piece until the member's checksum ends it. Where a member goes on beyond its range, its parts are
kept with the range's place and put together in a second, small step: of the following ranges, what stands before their
own first record.

Defined results: a null payload is empty, a null url has no header, a null page id has an empty place in the record id
and is read as null. Equal rows are records each; if the largest page id of equal payloads occurs twice, both are
responses, and if all ids are null, all are. Extra columns are not stored. Bytes that belong to no record are skipped.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import table
from corpusloom.session import ship
from corpusloom.storage import stage, work_dir

MAGIC = b"\x1f\x8b\x08"
LEAST_REVISIT = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff0300") + bytes(8)
#: Parts of a hot payload's rows in the join.
SALT = 16


def member(record: bytes) -> bytes:
    """A record as gzip member whose last byte is zero and left out."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = deflate.compress(record) + deflate.flush()
    if out[-1]:
        out += _EMPTY_MEMBER
    return out[:-1]


def _head(version: str, fields: list[tuple[str, object]]) -> bytes:
    lines = [version, *(f"{k}: {v}" for k, v in fields if v is not None)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8")


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit of ``refers_to``, whose block ends after the HTTP header."""
    http = _head("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))])
    block = http if refers_to is not None else http + payload
    place = url if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Target-URI", place), ("WARC-Date", DATE),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
              ("WARC-Refers-To", None if refers_to is None else _urn(refers_to)), ("WARC-Profile", None if refers_to is None else PROFILE),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    return _head("WARC/1.1", fields) + block + b"\r\n\r\n"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    info = b"software: corpusloom\r\n"
    out = [member(_head("WARC/1.1", [("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<urn:info>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n")]
    for batch in batches:
        out += [member(record(*row)) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        yield pa.RecordBatch.from_pydict({"member": pa.array(out, pa.binary())})
        out = []


def write(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """Archive files of (page_id, url, html) below ``path``."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    again = rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # the planner knows the size of this table, so it is broadcast only if small; else a hot payload's rows meet it in several places
    again = stage(again, "repeated").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int"))
    refers_to = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    joined = salted.join(again, ["digest", "size", "salt"], "left").select("page_id", "url", "payload", "digest", refers_to.alias("refers_to"))
    made = joined.mapInArrow(_members, "member binary")
    made.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def _inflate(data: bytes, least: int = 0) -> tuple[object, bytes] | None:
    """The inflater and its output so far; none if the data can't be a member."""
    flate = zlib.decompressobj(31)
    try:
        return flate, flate.decompress(data, least) if least else flate.decompress(data)
    except zlib.error:
        return None


def is_record(candidate: bytes) -> bool:
    """Whether a member begins here whose first bytes are a WARC version line."""
    if len(candidate) < 10 or candidate[3] & 0xE0:
        return False
    begun = _inflate(candidate, 32)
    return begun is not None and (begun[1].startswith(b"WARC/1.") or (len(begun[1]) < 7 and b"WARC/1.".startswith(begun[1]) and not begun[0].eof))


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parsed(raw: bytes) -> dict:
    """Fields of one inflated record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = _fields(head)
    block = rest[:int(warc.get("content-length", len(rest)))]
    http_head, _, payload = block.partition(b"\r\n\r\n") if warc.get("content-type", "").startswith("application/http") else (b"", b"", block)
    http = _fields(http_head) if http_head else {}
    kind = warc.get("warc-type")
    stated = warc.get("warc-payload-digest", "").removeprefix("sha1:")
    stated = base64.b32decode(stated).hex() if len(stated) == 32 else stated.lower() or None
    digest = stated if kind == "revisit" else hashlib.sha1(payload).hexdigest()
    length = int(http["content-length"]) if kind == "revisit" and http.get("content-length", "").isdigit() else len(payload)
    return {"record_id": warc.get("warc-record-id"), "record_type": kind, "url": warc.get("warc-target-uri"), "refers_to": warc.get("warc-refers-to"),
            "payload_bytes": length, "payload_digest": digest, "digest_holds": stated is None or stated == digest, "payload": payload}


_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()),
                     ("payload_digest", pa.string()), ("digest_holds", pa.bool_()), ("payload", pa.binary())])
_PART = pa.schema([("file", pa.string()), ("range", pa.int64()), ("part", pa.int64()), ("kind", pa.string()), ("data", pa.binary())])
_RECORD_SQL = "record_id string, record_type string, url string, refers_to string, payload_bytes long, payload_digest string, digest_holds boolean, payload binary"
#: Bytes of records in an output batch.
_FULL = 8 << 20


class _Scan:
    """The pieces of one byte range, in order."""

    def __init__(self, file: str, start: int):
        self.file, self.start, self.flate, self.out, self.held, self.parts, self.began = file, start, None, b"", [], 0, start == 0

    def piece(self, data: bytes) -> Iterator[dict]:
        if self.flate is None:
            if not is_record(MAGIC + data):
                if not self.began:  # may go on a member of an earlier range
                    yield self._part("head", MAGIC + data)
                return
            self.began, self.out, self.flate, self.held = True, [], zlib.decompressobj(31), []
        self.held.append(MAGIC + data)
        try:
            self.out.append(self.flate.decompress(MAGIC + data))
        except zlib.error:
            self.flate = None
            return
        if self.flate.eof:
            self.flate = None
            yield parsed(b"".join(self.out)) | {"kind": "record"}

    def end(self) -> Iterator[dict]:
        if self.flate is not None:
            yield self._part("tail", b"".join(self.held))
        elif self.began:
            yield self._part("whole", b"")

    def _part(self, kind: str, data: bytes) -> dict:
        self.parts += 1
        return {"file": self.file, "range": self.start, "part": self.parts, "kind": kind, "data": data}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds, rows, size, scan = pa.schema([*_PART, *_RECORD]), [], 0, None
    for batch in batches:
        for file, start, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = []
            if scan is None or (scan.file, scan.start) != (file, start):
                found += scan.end() if scan else []
                scan = _Scan(file, start)
                if start == 0:
                    continue  # what stands before the first magic of a file
            found += scan.piece(data)
            rows += found
            size += sum(len(x.get("payload") or x.get("data") or b"") for x in found)
            if size >= _FULL:
                yield pa.RecordBatch.from_pylist(rows, kinds)
                rows, size = [], 0
    rows += scan.end() if scan else []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, kinds)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for (data,) in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            begun = _inflate(data)
            if begun and begun[0].eof:
                rows.append(parsed(begun[1]))
        yield pa.RecordBatch.from_pylist(rows, _RECORD)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archive files below ``path``, whatever their names."""
    lines = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path)
    pieces = lines.select(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.col("value").cast("binary"))
    kind = "file string, range long, part long, kind string, data binary, " + _RECORD_SQL
    scanned = stage(pieces.mapInArrow(_scan, kind), "scanned")
    records = scanned.where("kind = 'record'").select(*_RECORD.names)
    parts = scanned.where("kind != 'record'").select(*_PART.names)
    # a head belongs to the last range before it in which a record began, if that was left unfinished
    before = Window.partitionBy("file").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("kind") != "head", F.struct("range", "kind")), ignorenulls=True).over(before)
    whole = (parts.withColumn("owner", owner).where("owner.kind = 'tail'").groupBy("file", "owner.range")
             .agg(F.sort_array(F.collect_list(F.struct(parts["range"], "part", "data"))).alias("p")))
    data = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["data"]))
    return records.union(whole.select(data.alias("data")).mapInArrow(_stitch, _RECORD_SQL))


def op3_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, written as archives and read back."""
    ship(spark)
    path = f"{work_dir(spark)}/archive"
    write(table(spark, sf_dir, "pages"), path)
    page = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) as bigint)")
    return read(spark, path).where("record_type in ('response', 'revisit')").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"), "digest_holds")
