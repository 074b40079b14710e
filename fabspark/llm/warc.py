"""WARC archives: a de-duplicating writer and a salvage reader.

The writer turns rows into WARC/1.0 records, each a gzip member of its own, and
leaves the files to Spark's text writer, so archives are written, retried and
committed on any store that Spark reaches. Damage to a member costs one record.

The reader walks an archive record by record and checks version line, header
block, length, closing separator and digests. Where a check fails it looks for
the next place that starts a valid record (a version line, or a gzip member in
compressed archives), goes on from there and logs the bytes between as a gap.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stream_folder
from .common import col, map_batches, slices

END = b"\r\n\r\n"
VERSION = re.compile(rb"WARC/\d+\.\d+\r\n")
MEMBER = b"\x1f\x8b\x08"
PIECE = 65536
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: five hex digits are four letters."""
    part = lambda i: F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("int")
    letter = lambda n, shift: F.substring(F.lit(BASE32), F.shiftright(n, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*[letter(part(i), s) for i in range(8) for s in (15, 10, 5, 0)])


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0) -> DataFrame:
    """Rows with ``digest``, ``n_bytes`` and ``refers_to``.

    Of rows with equal payloads of at least ``least`` bytes the smallest id is
    kept as a response; the others refer to it. Null payloads count as empty,
    null ids sort last, rows that repeat the smallest id are all responses.
    """
    body = F.coalesce(col(body_col), F.lit(""))
    rows = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), body.alias("body"), F.sha1(body.cast("binary")).alias("hex"), F.octet_length(body).cast("long").alias("n_bytes"))
    first = rows.filter(F.col("n_bytes") >= least).groupBy("hex").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("hex", "first")
    joined = rows.join(first, "hex", "left")
    again = F.when(F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first"))), F.col("first"))
    return joined.select("id", "url", "body", base32(F.col("hex")).alias("digest"), "n_bytes", again.alias("refers_to"))


def _clean(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\r\n]+", " ")


def _member(record: bytes) -> bytes:
    """A gzip member without its last byte, which is 0: the highest byte of the
    length below 16 MB; an empty member follows a longer record."""
    packed = gzip.compress(record, 9, mtime=0)
    return (packed if packed[-1] == 0 else packed + gzip.compress(b"", mtime=0))[:-1]


def write_archives(rows: DataFrame, path: str, per_file: int = 4_000) -> None:
    """Writes rows of :func:`records` as archives of at most ``per_file``
    records, a gzip member each; ids go into the record ids."""
    uri = lambda c: F.concat(F.lit("<urn:record:"), c.cast("string"), F.lit(">"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("refers_to").isNull(), F.concat(head, F.col("body"))).otherwise(head)
    fields = [
        F.lit("WARC/1.0"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("refers_to").isNull(), F.lit("response")).otherwise(F.lit("revisit"))),
        F.concat(F.lit("WARC-Record-ID: "), uri(F.coalesce(F.col("id").cast("string"), F.lit("")))),
        F.concat(F.lit("WARC-Target-URI: "), _clean(F.col("url"))),
        F.concat(F.lit("WARC-Date: 1970-01-01T00:00:00Z")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(F.col("refers_to").isNotNull(), F.concat(F.lit("WARC-Refers-To: "), uri(F.col("refers_to")))),
        F.when(F.col("refers_to").isNotNull(), F.lit("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    out = rows.select(F.concat(F.concat_ws("\r\n", *fields), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n")).cast("binary").alias("value"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            yield pa.RecordBatch.from_arrays([pa.array([_member(x.as_py()) for x in b.column(0)], pa.binary())], names=["value"])

    # The line separator is the last byte of every member.
    packed = map_batches(out, run, "value binary").select(F.col("value").cast("string"))
    packed.write.option("lineSep", "\0").option("maxRecordsPerFile", per_file).option("compression", "none").text(path)


class Damaged(ValueError):
    """A record that fails a check."""


def _header_end(data: bytes, at: int) -> int:
    """Where the header that starts at ``at`` ends, however long it is: before
    the next version line at the latest. -1 without an end."""
    stop = data.find(END, at, at + PIECE)
    if stop < 0:
        after = VERSION.search(data, at + 1)
        stop = data.find(END, at, after.start() if after else len(data))
    return stop


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that starts at ``at`` and the place after it."""
    if not VERSION.match(data, at):
        raise Damaged("no version line")
    stop = _header_end(data, at)
    if stop < 0:
        raise Damaged("header without end")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,18}", length):
        raise Damaged("no content length")
    start = stop + len(END)
    end = start + int(length)
    if end > len(data):
        raise Damaged("cut off")
    if data[end : end + 4] != END:
        raise Damaged("no separator after the block")
    block = data[start:end]
    kind = headers.get("warc-type", "")
    if not kind:
        raise Damaged("no record type")
    payload, declared = block, None
    if headers.get("content-type", "").lower().startswith("application/http"):
        front, found, payload = block.partition(END)
        if not found:
            raise Damaged("no end of the HTTP header")
        declared = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", front)
    digest = headers.get("warc-payload-digest", "")
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if kind != "revisit" and digest.lower().startswith("sha1:") and digest[5:].upper() != sha:
        raise Damaged("payload digest differs")
    whole = headers.get("warc-block-digest", "")
    if whole.lower().startswith("sha1:") and whole[5:].upper() != base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise Damaged("block digest differs")
    n_bytes = int(declared[1]) if kind == "revisit" and declared else len(payload)
    return {
        "type": kind, "record_id": headers.get("warc-record-id"), "uri": headers.get("warc-target-uri"), "refers_to": headers.get("warc-refers-to"),
        "digest": digest[5:].upper() if kind == "revisit" and digest else sha, "n_bytes": n_bytes, "payload": payload,
        "verified": kind != "revisit" and digest.lower().startswith("sha1:"),
    }, end + len(END)


def _plain(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, end, record or None, reason) over an uncompressed archive."""
    at = 0
    while at < len(data):
        try:
            record, end = parse_record(data, at)
            yield at, end, record, None
            at = end
        except Damaged as e:
            reason, look = str(e), at + 1
            while True:
                found = VERSION.search(data, look)
                if not found:
                    end = len(data)
                    break
                try:
                    parse_record(data, found.start())
                    end = found.start()
                    break
                except Damaged:
                    look = found.start() + 1
            yield at, end, None, reason
            at = end


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """One gzip member: its content, the place after it, and what is wrong with
    it; a damaged member gives all that comes out before the damage."""
    d, view, out = zlib.decompressobj(31), memoryview(data), []
    while not d.eof and at < len(data):
        before = d.copy() if at + PIECE < len(data) or out else None
        try:
            out.append(d.decompress(view[at : at + PIECE]))
        except zlib.error as e:
            out.append(_up_to_error(before or zlib.decompressobj(31), view[at : at + PIECE]))
            return b"".join(out), min(at + PIECE, len(data)), f"member: {e}"
        at = min(at + PIECE, len(data))
    return b"".join(out), at - len(d.unused_data), None if d.eof else "member cut off"


def _up_to_error(d: zlib._Decompress, piece: memoryview) -> bytes:
    """What comes out of a piece before zlib raises, but for the last byte: zlib
    gives nothing of the call that raises, so the last stretch is taken byte by
    byte."""
    out = []
    for at in range(0, len(piece), 256):
        before, step = d.copy(), piece[at : at + 256]
        try:
            out.append(d.decompress(step))
        except zlib.error:
            tail: bytes | memoryview = step
            try:
                while not before.eof:
                    byte = before.decompress(tail, 1)
                    if not byte and not before.unconsumed_tail:
                        break
                    out.append(byte)
                    tail = before.unconsumed_tail
            except zlib.error:
                pass
            break
    return b"".join(out)


def _recovered(content: bytes, wrong: str) -> list[dict]:
    """Records of a damaged member: whole ones (closing separator included) up
    to the first that fails, behind it those with a digest that agrees. Where
    only the check sum differs and nothing fails, any record without a digest
    may be the damaged one; where only the length differs, none is."""
    found = list(_plain(content + b"\n" if content.endswith(END[:3]) else content))  # the byte that zlib keeps
    bad = next((n for n, (_, _, r, _) in enumerate(found) if r is None), None)
    if bad is None:
        bad = 0 if "incorrect data check" in wrong else len(found)
    return [r for n, (_, _, r, _) in enumerate(found) if r and (n < bad or r["verified"])]


def _next_member(data: bytes, at: int) -> int:
    """The next place from ``at`` on where a member starts that is whole or
    gives a record; the end of the data without one."""
    while (at := data.find(MEMBER, at)) >= 0:
        content, _, wrong = _inflate(data, at)
        if wrong is None or _recovered(content, wrong):
            return at
        at += 1
    return len(data)


def _members(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """The same over gzip members, each with one or more whole records."""
    at = 0
    while at < len(data):
        content, end, wrong = _inflate(data, at)
        if wrong is None:
            for _, _, record, reason in _plain(content):
                yield at, end, record, reason
        else:
            end = _next_member(data, at + 1)
            for record in _recovered(content, wrong):
                yield at, end, record, None
            yield at, end, None, wrong
        at = end


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    if data[:3] == MEMBER:
        return _members(data)
    if not VERSION.match(data):
        # The start is damaged: what comes first behind it tells the kind.
        lost = next(iter(_plain(data)), (0, len(data)))[1]
        if _next_member(data, 0) < lost:
            return _members(data)
    return _plain(data)


ROW = "path string, start long, end long, reason string, type string, record_id string, uri string, refers_to string, digest string, n_bytes long, payload binary"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per record, and one per quarantined gap (with its ``reason`` and
    null record fields). A file is one task's unit and must be below 2 GB."""
    from pyspark.sql.types import StructType

    arrow = None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("type", "record_id", "uri", "refers_to", "digest", "n_bytes", "payload")
        for b in batches:
            for i in range(b.num_rows):
                name, data = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                held = []
                for start, end, record, reason in salvage(data):
                    row = {"path": name, "start": start, "end": end, "reason": reason, **{k: (record or {}).get(k) for k in fields}}
                    held.append(row if payloads else {**row, "payload": None})
                    if len(held) == 256:
                        yield pa.RecordBatch.from_pylist(held, schema=arrow)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(ROW))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return map_batches(files.select("path", "content"), run, ROW)


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least: int = 0, per_file: int = 4_000) -> DataFrame:
    """Writes rows as archives below the shared checkpoint folder and reads
    them back: the rows of :func:`read_archives`. An empty table gives none."""
    path = stream_folder(pages.sparkSession, "archives")
    write_archives(records(pages, id_col, url_col, body_col, least), path, per_file)
    return read_archives(pages.sparkSession, path, payloads=False)


