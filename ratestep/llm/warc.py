"""WARC archives: writer with revisit records, and a reader that salvages what follows damage.

Writing is a DataFrame plan: a record is one string (header block and payload) and the record terminator is the line
separator of Spark's text sink, so the files are plain WARC/1.1 and go to any store that Spark can write. Reading takes
whole files (the writer bounds their size) and parses each in a worker. When a check fails (version line, header block,
Content-Length, terminator, payload digest, gzip member), the reader searches for the next valid version line or gzip
member, goes on there, and returns the bytes between as a quarantined gap; the same search goes on inside what a member holds, and what a
broken member gave before its break is kept.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratestep.runtime import Scratch, bounded_batches, ensure_importable

END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_MEMBER = b"\x1f\x8b\x08"
#: Payload bytes up to which so many records go to one file: no file grows past 64 MiB but for a single record.
FILE_CLASSES = ((1 << 16, 1 << 10), (1 << 22, 1 << 4), (None, 1))


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: five hex digits make four symbols."""
    digest, out = F.sha1(payload), []
    for k in range(8):
        v = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def record_strings(pages: DataFrame, scratch: Scratch, id_col: str, url_col: str, payload_col: str, date: str, min_revisit_bytes: int) -> DataFrame:
    """(record, payload_bytes) of each row; rows whose payload an earlier id holds become revisits without a block."""
    base = pages.select(
        F.col(id_col).alias("id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), "[\\x00-\\x20\\x7F]", "%20").alias("url"),
        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).withColumns({"n": F.octet_length("payload").cast("long"), "digest": base32_sha1(F.col("payload"))})
    # Only payloads with two ids or more have revisits; the first id of each comes from a partial aggregate. It is
    # written first: Spark then knows its size, and payloads are only shuffled if it is too large to broadcast.
    first = scratch.cut(
        base.where(F.col("n") >= min_revisit_bytes).groupBy("digest", "n").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))
        .where("first_id < last_id").select("digest", "n", "first_id"),
        "first",
    )
    revisit = F.col("first_id").isNotNull() & F.col("id").isNotNull() & (F.col("id") != F.col("first_id"))
    named = base.join(first, ["digest", "n"], "left").withColumn("revisit", revisit)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("id"))),
        F.lit(f"WARC-Date: {date}\r\n"),
        F.when(F.col("url") != "", line("WARC-Target-URI", F.col("url"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("X-Payload-Length", F.col("n").cast("string")),
        F.when(
            F.col("revisit"),
            F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", urn(F.col("first_id")))),
        ).otherwise(F.lit("")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(F.col("revisit"), "0").otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
    )
    block = F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload"))
    return named.select(F.concat(head, block).alias("value"), F.when(F.col("revisit"), F.lit(0).cast("long")).otherwise(F.col("n")).alias("size"))


def write_warc(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    min_revisit_bytes: int = 0,
) -> list[str]:
    """Write a record for each row under ``path`` and return the folders written.

    Of rows with equal payloads of at least ``min_revisit_bytes`` bytes, those of the smallest id are responses, the
    others revisits of it; rows that repeat that id are responses too. A null payload is empty; a null id is never a
    revisit nor revisited; a null url has no target line. Sizes are classed first, so that the largest record alone
    decides how many passes are made, and files stay small enough to be read whole.
    """
    records = record_strings(pages, Scratch(pages.sparkSession, "warc"), id_col, url_col, payload_col, date, min_revisit_bytes)
    most = pages.agg(F.max(F.octet_length(payload_col))).first()[0] or 0
    out, least = [], -1
    for limit, per_file in FILE_CLASSES:
        if most <= least:
            break
        part = records
        if least >= 0 or (limit is not None and most > limit):
            part = part.where((F.col("size") > least) & (F.col("size") <= (limit if limit is not None else 1 << 62)))
        folder = f"{path}/class-{len(out)}"
        part.select("value").write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(folder)
        out.append(folder)
        if limit is not None:
            least = limit
    return out


def parse_headers(raw: bytes) -> dict[str, str] | None:
    out: dict[str, str] = {}
    for k in raw.split(b"\n"):
        k = k.rstrip(b"\r")
        if not k:
            continue
        name, colon, value = k.partition(b":")
        if not colon or not name.strip():
            return None
        out[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _one(buf: bytes, at: int) -> tuple[dict | None, int, str]:
    """(record, end, fault) of the record that starts at ``at``."""
    v = _VERSION.match(buf, at)
    if not v:
        return None, at, "no version line"
    h = re.compile(rb"\r?\n\r?\n").search(buf, v.end() - 2)
    if not h:
        return None, at, "header block not ended"
    headers = None if _VERSION.search(buf, v.end(), h.end()) else parse_headers(buf[v.end() : h.start()])
    if headers is None:
        return None, at, "malformed header"
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None, at, "no content length"
    start, end = h.end(), h.end() + int(length)
    if end > len(buf):
        return None, at, "record truncated"
    tail = buf[end : end + 4]
    if tail != b"\r\n\r\n" and not (tail[:2] == b"\n\n"):
        return None, at, "terminator missing"
    block = buf[start:end]
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and digest.lower().startswith("sha1:"):
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != digest[5:].upper():
            return None, at, "payload digest differs"
    return {"headers": headers, "block": block}, end + (4 if tail == b"\r\n\r\n" else 2), ""


def _inflate(buf: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int, bool]:
    """(output, end, whole) of the gzip member at ``at``; of a broken one, what came out before the break. Reads no further than the member."""
    d, out, pos, view = zlib.decompressobj(31), [], at, memoryview(buf)
    try:
        while pos < len(buf) and not d.eof:
            out.append(d.decompress(view[pos : pos + step]))
            pos += step
    except zlib.error:
        # The slice that broke is tried byte by byte, so that no output before the break is lost.
        d, tail = zlib.decompressobj(31), []
        d.decompress(view[at:pos]) if pos > at else None
        try:
            for k in range(pos, min(pos + step, len(buf))):
                tail.append(d.decompress(view[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(out + tail), min(pos + step, len(buf)), False
    if not d.eof:
        return b"".join(out), len(buf), False
    return b"".join(out), min(pos, len(buf)) - len(d.unused_data), True


class _Marks:
    """Where the next version line or gzip member is; what has been found is kept, so that the buffer is searched once."""

    def __init__(self, buf: bytes, zipped: bool):
        self.buf, self.zipped = buf, zipped
        self.line = self.member = -1

    def after(self, at: int) -> int:
        n = len(self.buf)
        if self.line < at:
            m = _VERSION.search(self.buf, at)
            self.line = m.start() if m else n
        if self.zipped and self.member < at:
            k = self.buf.find(_MEMBER, at)
            self.member = k if k >= 0 else n
        return min(self.line, self.member) if self.zipped else self.line


def _plain(buf: bytes) -> Iterator[dict]:
    """Records and gaps of bytes that are not zipped."""
    at, gap, why, marks = 0, None, "", _Marks(buf, False)
    while at < len(buf):
        if gap is None and buf[at : at + 1] in b"\r\n":
            at += 1
            continue
        rec, end, fault = _one(buf, at)
        if rec is None:
            if gap is None:
                gap, why = at, fault
            at = marks.after(at + 1)
            continue
        if gap is not None:
            yield {"offset": gap, "length": at - gap, "fault": why}
            gap = None
        yield {"offset": at, "length": end - at, **rec}
        at = end
    if gap is not None:
        yield {"offset": gap, "length": len(buf) - gap, "fault": why}


def salvage(buf: bytes) -> Iterator[dict]:
    """Records and gaps of an archive, in order; plain records and gzip members may be mixed.

    Every byte belongs to exactly one record, gap, member, or blank line between records. What a member holds is salvaged in the same way:
    its records and gaps have the ``offset`` and ``length`` of the member and, as ``inner``, their offset in its output. A broken member
    gives the records that come out before the break, then a gap from its start to the next valid member or version line.
    """
    at, gap, why, marks = 0, None, "", _Marks(buf, True)
    while at < len(buf):
        if gap is None and buf[at : at + 1] in b"\r\n":
            at += 1
            continue
        if buf.startswith(_MEMBER, at):
            out, end, whole = _inflate(buf, at)
            found = list(_plain(out))
            ok = whole and any("headers" in x for x in found)
            fault = "no record in gzip member" if whole else "gzip member broken"
        else:
            rec, end, fault = _one(buf, at)
            found, ok = [], rec is not None
        if ok and gap is not None:
            yield {"offset": gap, "length": at - gap, "fault": why}
            gap = None
        if ok and not found:
            yield {"offset": at, "length": end - at, **rec}
        # The last gap of a broken member is where the output ends: the gap of the member itself says so.
        for k, x in enumerate(found):
            if ok or "headers" in x or k < len(found) - 1:
                yield {**x, "offset": at, "length": end - at if ok else 0, "inner": x["offset"], "inner_length": x["length"]}
        if ok:
            at = end
            continue
        if gap is None:
            gap, why = at, fault
        at = marks.after(at + 1)
    if gap is not None:
        yield {"offset": gap, "length": len(buf) - gap, "fault": why}


SCHEMA = (
    "path string, offset long, length long, inner long, inner_length long, record_type string, record_id string, target_uri string, refers_to_id string, "
    "payload_digest string, payload_bytes long, payload binary, fault string"
)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = {**dict.fromkeys(("offset", "length", "inner", "inner_length"), pa.int64()), "payload_bytes": pa.int64(), "payload": pa.binary()}
    for batch in batches:
        for k in range(batch.num_rows):
            path, rows, size = batch.column("path")[k].as_py(), [], 0
            for x in salvage(batch.column("content")[k].as_py()):
                h, block = x.get("headers", {}), x.get("block")
                said = h.get("x-payload-length", "")
                digest = h.get("warc-payload-digest", "")
                rows.append({
                    "path": path, "offset": x["offset"], "length": x["length"], "inner": x.get("inner"), "inner_length": x.get("inner_length"), "record_type": h.get("warc-type") if block is not None else None,
                    "record_id": h.get("warc-record-id"), "target_uri": h.get("warc-target-uri"), "refers_to_id": h.get("warc-refers-to"),
                    "payload_digest": digest[5:].upper() if digest.lower().startswith("sha1:") else None,
                    "payload_bytes": (int(said) if said.isdigit() else len(block)) if block is not None else None, "payload": block, "fault": x.get("fault"),
                })
                size += len(block or b"")
                if len(rows) >= 1024 or size >= 1 << 24:
                    yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)


def read_warc(spark: SparkSession, *paths: str) -> DataFrame:
    """Records and quarantined gaps (rows with a ``fault`` and no type) of the archives under ``paths``.

    An empty file gives no rows. A revisit has an empty block; its digest and length are those of the full payload.
    """
    ensure_importable(spark)
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInArrow(_rows, SCHEMA)


def encode_record(kind: str, record_id: str, payload: bytes, *, headers: dict[str, str] | None = None, gzip: bool = False) -> bytes:
    """One record as bytes, as a gzip member of its own if asked; for fixtures and small archives."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    lines = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Payload-Digest": f"sha1:{digest}", **(headers or {}), "Content-Length": str(len(payload))}
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items()).encode() + b"\r\n" + payload + b"\r\n\r\n"
    if not gzip:
        return raw
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def page_records(records: DataFrame) -> DataFrame:
    """The digest row of each page record read back."""
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    whole = lambda c: F.when(number(c) != "", number(c).cast("long"))
    return records.where(F.col("fault").isNull()).select(
        whole(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", whole(F.col("refers_to_id")).alias("refers_to")
    )
