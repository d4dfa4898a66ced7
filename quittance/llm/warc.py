"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Records are WARC/1.1, each a gzip member of its own, in files that Spark's text writer commits: a
task that is repeated or lost never leaves a record twice or half a file. That writer ends every
line with a separator, so each member must end in the separator, a zero byte. The last four bytes
of a member are its length, whose highest byte is zero below 16 MiB; a longer record is followed
by an empty member, which ends in zeros as well.

The reader checks every record: the member's own checksum, the version line, the length and the
digest of the block. After a failed check it looks for the next place where a member begins that
unpacks to a version line, or where a version line stands in the open, goes on from there, and
reports the bytes in between as a gap with the reason.

A member may hold many records. After a failed check within one, the reader goes on at the next
version line in its content, and the gap's reason says where in the content it lies. Of a member
that is cut short or fails its checksum, what could be unpacked is read in the same way: from a cut
one, the records with a good digest and those before the last one begun; from one with wrong
bytes, which may be anywhere, only the records whose own digest is good.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quittance.llm.shared import ship, slices, stored

VERSION = b"WARC/1."
MAGIC = b"\x1f\x8b\x08"
#: What a revisit says of itself: its payload is that of another record.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = "\0"
#: Bytes unpacked at a time.
STEP = 1 << 20


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None, copy: str) -> str:
    return f"<urn:quittance:{'none' if key is None else key}:{copy}>"


def member(record: bytes) -> bytes:
    """A record as a gzip member that ends in a zero byte."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = pack.compress(record) + pack.flush()
    if out[-1]:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += pack.flush()
    return out


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{k}: {' '.join(v.split())}" for k, v in headers]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(
    pages: DataFrame,
    folder: str,
    least_bytes: int = 0,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> None:
    """Write a record for every row of ``pages`` under ``folder``.

    Of the pages with equal payloads of at least ``least_bytes`` bytes, that with the smallest id
    becomes a response and the others revisits of it; rows that repeat that id are responses too.
    A missing page has an empty payload. Rows without an id revisit one that has an id, and are
    responses where none has. Other columns are never read.

    Only digests are grouped, partially on every task first. The pages themselves meet the table
    of repeated digests, which Spark broadcasts if it is below the session's threshold; otherwise
    both sides are shuffled and adaptive execution splits a digest that many pages share.
    """
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(F.col(html_column), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_column).cast("long").alias("id"), F.col(url_column).alias("url"), payload.alias("payload")
    )
    digest = F.unhex(F.sha1("payload"))
    first = (
        rows.where(F.length("payload") >= least_bytes)
        .select("id", digest.alias("digest"))
        .groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("pages"))
        .where("pages > 1")
        .select("digest", "first")
    )
    first = stored(first, "repeated-payloads")
    known = rows.withColumn("digest", digest).join(first, "digest", "left")
    again = (F.length("payload") >= least_bytes) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    known = known.select("id", "url", "payload", F.when(again, F.col("first")).alias("refers_to"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, payloads in slices(batch, 2):
                part = batch.slice(at, len(payloads))
                made = [
                    member(_page_record(*row))
                    for row in zip(
                        part.column(0).to_pylist(),
                        part.column(1).to_pylist(),
                        payloads,
                        part.column(3).to_pylist(),
                        strict=True,
                    )
                ]
                yield pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in made], pa.binary())], ["member"])

    # A string of Spark may hold any bytes, and the text writer passes them on as they are.
    members = known.mapInArrow(packed, "member binary").select(F.col("member").cast("string"))
    members.write.option("lineSep", SEPARATOR).text(folder)


def _page_record(key: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base32_sha1(payload)
    block = payload if refers_to is None else b""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(key, digest)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "text/html; charset=utf-8"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", url))
    if key is not None:
        headers.append(("X-Page-ID", str(key)))
    if refers_to is not None:
        headers.append(("WARC-Profile", PROFILE))
        headers.append(("WARC-Refers-To", record_id(refers_to, digest)))
    return record(headers, block)


@dataclass
class Gap:
    """Bytes of a file that belong to no record that passes its checks."""

    start: int
    end: int
    reason: str


class Damaged(Exception):
    """A record fails a check."""


#: What is wrong with a member whose end is missing.
CUT = "member: cut short"


def _unpack_member(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """The content of the member at ``at``, where it ends, and what is wrong with it.

    Of a damaged member, the content is what could be unpacked, and its end is unknown: ``at``.
    """
    unpack, out, here, wrong = zlib.decompressobj(31), [], at, None
    step = STEP
    while not unpack.eof and here < len(data):
        before = unpack.copy()  # the output of a failed step is lost: smaller ones up to the byte
        try:
            out.append(unpack.decompress(data[here : here + step]))
        except zlib.error as e:
            if step == 1:
                wrong = f"member: {str(e).split(': ')[-1]}"
                break
            unpack, step = before, max(1, step // 32)
            continue
        here = min(here + step, len(data))
    if wrong or not unpack.eof:
        return b"".join(out), at, wrong or CUT
    return b"".join(out), here - len(unpack.unused_data), None


def parse_record(data: bytes | memoryview, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers (names in lower case), block and end of the record at ``at``."""
    if bytes(data[at : at + len(VERSION)]) != VERSION:
        raise Damaged("no version line")
    window, size = b"", 1 << 12
    while (end := window.find(b"\r\n\r\n")) < 0:
        if window and len(window) < size // 4:  # all there is
            raise Damaged("headers do not end")
        window, size = bytes(data[at : at + size]), size * 4
    try:
        lines = window[:end].decode().split("\r\n")[1:]
    except UnicodeDecodeError as e:
        raise Damaged("headers are no UTF-8") from e
    headers = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header without a colon")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit():
        raise Damaged("no length")
    first = at + end + 4
    last = first + int(length)
    if bytes(data[last : last + 4]) != b"\r\n\r\n":
        raise Damaged("length does not lead to the end of a record")
    block = bytes(data[first:last])
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha1:") and said[5:].upper() != base32_sha1(block):
        raise Damaged("block digest differs")
    return headers, block, last + 4


def _begins_record(data: memoryview, at: int) -> bool:
    """Whether the bytes at ``at`` begin a version line, packed or in the open."""
    if bytes(data[at : at + len(VERSION)]) == VERSION:
        return True
    try:
        return zlib.decompressobj(31).decompress(data[at : at + STEP], len(VERSION)) == VERSION
    except zlib.error:
        return False


def _next_start(data: bytes, at: int) -> int:
    """The next place from ``at`` on where a record begins; the end of the file if there is none."""
    view = memoryview(data)
    while True:
        places = [p for p in (data.find(MAGIC, at), data.find(VERSION, at)) if p >= 0]
        if not places:
            return len(data)
        at = min(places)
        if _begins_record(view, at):
            return at
        at += 1


def _content_records(content: bytes, wrong: str | None) -> Iterator[tuple[dict[str, str], bytes] | Gap]:
    """Records and gaps, as offsets in it, of a member's content; ``wrong``: of what remains of it."""
    at, gap = 0, None
    while at < len(content):
        try:
            headers, block, end = parse_record(content, at)
            proven = headers.get("warc-block-digest", "").startswith("sha1:")
            if wrong and not proven and (wrong != CUT or end >= len(content)):
                raise Damaged("no digest to tell whether the record is whole")
        except Damaged as e:
            further = content.find(VERSION, at + 1)
            further = len(content) if further < 0 else further
            gap = Gap(gap.start if gap else at, further, gap.reason if gap else str(e))
            at = further
            continue
        if gap:
            yield gap
            gap = None
        yield headers, block
        at = end
    if gap:
        yield gap


def read_file(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes] | Gap]:
    """Records (offset, headers, block) and gaps of one archive, packed or not, in order.

    Gaps are bytes of the file. That of a record within a member is the whole member; its reason
    says which bytes of the content are meant.
    """
    view, at, gap = memoryview(data), 0, None
    salvaged: list[tuple[dict[str, str], bytes]] = []  # of the damaged member that the gap begins with
    while at < len(data):
        start = at
        if data[at : at + 3] == MAGIC:
            content, at, wrong = _unpack_member(view, at)
            items = list(_content_records(content, wrong))
            found = [(start, *item) for item in items if not isinstance(item, Gap)]
            lost = [item for item in items if isinstance(item, Gap)]
            if wrong or (lost and not found):
                at = _next_start(data, start + 1) if wrong else at
                reason = wrong or lost[0].reason
                if wrong and found:
                    reason += f", after {len(content)} bytes of content and {len(found)} records"
                if found:
                    if gap:
                        yield gap
                    yield from found
                    gap, salvaged = None, [record[1:] for record in found]
                gap = Gap(gap.start if gap else start, at, gap.reason if gap else reason)
                continue
            if gap:
                yield gap
                gap = None
            yield from found
            for inner in lost:
                yield Gap(start, at, f"{inner.reason} (bytes {inner.start} to {inner.end} of the content)")
            continue
        try:
            headers, block, at = parse_record(view, at)
        except Damaged as e:
            at = _next_start(data, start + 1)
            gap = Gap(gap.start if gap else start, at, gap.reason if gap else str(e))
            continue
        if gap and (headers, block) in salvaged:  # stored in the member as it is, not packed
            gap.end = at
            continue
        if gap:
            yield gap
            gap = None
        yield start, headers, block
    if gap:
        yield gap


def read_archives(spark: SparkSession, folder: str, whole: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, gaps) of all files under ``folder``; with ``whole``, a gap fails the job.

    Records are (file, offset, record_type, record_id, page_id, url, refers_to, payload_bytes,
    payload_digest, payload): the payload of a revisit is missing, its size and digest are those
    of the full one, and ``refers_to`` is the page_id it names. Gaps are (file, start, end,
    reason). A file is read by one task, so files should be of a size that fits its memory, as
    those of ``write_archives`` are, one for each input partition.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(folder).select("path", "content")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                held, size = [], 0
                for item in read_file(content.as_py()):
                    if whole and isinstance(item, Gap):
                        raise Damaged(f"{path.as_py()}, bytes {item.start} to {item.end}: {item.reason}")
                    held.append(_row(path.as_py(), item))
                    size += len(held[-1].get("payload") or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=kind)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=kind)

    kind = pa.schema(
        [
            ("file", pa.string()),
            ("offset", pa.int64()),
            ("gap_end", pa.int64()),
            ("reason", pa.string()),
            ("record_type", pa.string()),
            ("record_id", pa.string()),
            ("page_id", pa.int64()),
            ("url", pa.string()),
            ("refers_to", pa.int64()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("payload", pa.binary()),
        ]
    )
    rows = files.mapInArrow(
        read,
        "file string, offset bigint, gap_end bigint, reason string, record_type string, "
        "record_id string, page_id bigint, url string, refers_to bigint, payload_bytes bigint, "
        "payload_digest string, payload binary",
    )
    records = rows.where("reason IS NULL").drop("gap_end", "reason")
    gaps = rows.where("reason IS NOT NULL").select(
        "file", F.col("offset").alias("start"), F.col("gap_end").alias("end"), "reason"
    )
    return records, gaps


def _number(text: str | None) -> int | None:
    return int(text) if text and text.lstrip("-").isdigit() else None


def _row(path: str, item: tuple[int, dict[str, str], bytes] | Gap) -> dict:
    if isinstance(item, Gap):
        return {"file": path, "offset": item.start, "gap_end": item.end, "reason": item.reason}
    offset, headers, block = item
    revisit = headers.get("warc-type") == "revisit"
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    size = _number(headers.get("x-payload-length"))
    referred = headers.get("warc-refers-to", "").removeprefix("<urn:quittance:").split(":")[0]
    return {
        "file": path,
        "offset": offset,
        "record_type": headers.get("warc-type"),
        "record_id": headers.get("warc-record-id"),
        "page_id": _number(headers.get("x-page-id")),
        "url": headers.get("warc-target-uri"),
        "refers_to": _number(referred) if revisit else None,
        "payload_bytes": size if revisit else len(block),
        "payload_digest": (digest or None) if revisit else base32_sha1(block),
        "payload": None if revisit else block,
    }
