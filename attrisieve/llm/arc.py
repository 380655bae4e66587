"""Operator 10: converting legacy ARC archives to WARC.

An ARC file opens with a version block, whose last line names the fields of every later header line: five in version 1,
ten in version 2. The declared length, not any separator, says where a record ends. The converter turns each record into a
WARC record with an identifier made from its place, an ISO date, a type, digests, and a revisit in place of a payload that
an earlier record already has.

An archive holds about FILE_BYTES of records, each a gzip member of its own, so records can be sought and are read one by one
whatever an archive's size. Archives are written by Spark's text sink (which writes a string's bytes as they are, and behind
an archive a zero byte, which gzip takes for padding) to a folder that all executors share, and read back as whole files, so
no executor touches a file system itself. Which records are revisits is decided from digests alone; payloads aren't dealt
out again, an archive is converted as a whole, its warcinfo first.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import checkpoint, discard, fresh_path, own_columns, slices

#: Bytes of records after which an archive ends; a longer record has one to itself.
FILE_BYTES = 16 << 20
#: How hard members are compressed.
LEVEL = 1
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: Fields of an ARC header line by version (fixed values).
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
MISSING_URL = "urn:missing"
CRAWL_DATE = "20240101000000"


@dataclass
class ArcRecord:
    offset: int
    fields: dict[str, str]
    content: bytes
    truncated: bool = False


@dataclass
class WarcRecord:
    headers: dict[str, str]
    block: bytes = field(default=b"")


def _escape(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or MISSING_URL


def version_block(version: int, name: str, date: str = CRAWL_DATE) -> bytes:
    body = f"{version} 0 attrisieve\n{' '.join(FIELDS[version])}\n".encode()
    values = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/plain", "Archive-length": str(len(body))}
    return " ".join(values.get(f, "-") for f in FIELDS[version]).encode() + b"\n" + body


def arc_record(version: int, page_id: int | str | None, url: str | None, payload: bytes, date: str = CRAWL_DATE) -> bytes:
    """An ARC record of an HTTP response with the payload; the page's id travels in an HTTP header."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n"
    head += f"X-Page-Id: {quote(str(page_id), safe='')}\r\n\r\n" if page_id is not None else "\r\n"
    content = head.encode() + payload
    values = {"URL": _escape(url), "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": "text/html", "Result-code": "200", "Archive-length": str(len(content))}
    return " ".join(values.get(f, "-") for f in FIELDS[version]).encode() + b"\n" + content


class _Source:
    """Bytes that come in pieces; ``held[at:]`` is what has come and isn't used up, ``place`` where that begins."""

    def __init__(self, data: bytes | Iterable[bytes]):
        self.pieces = iter([data]) if isinstance(data, bytes) else iter(data)
        self.held, self.at, self.before = b"", 0, 0

    @property
    def place(self) -> int:
        return self.before + self.at

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.before += self.at
        self.held, self.at = self.held[self.at :] + piece, 0
        return True

    def has(self, n: int) -> bool:
        """Whether n bytes are at hand, or can be had."""
        while len(self.held) - self.at < n:
            if not self.more():
                return False
        return True

    def find(self, mark: bytes) -> int:
        """How far off a mark begins; -1 if there is none."""
        while (found := self.held.find(mark, self.at)) < 0:
            if not self.more():
                return -1
        return found - self.at

    def take(self, n: int) -> bytes:
        self.has(n)
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out


def parse_arc(data: bytes | Iterable[bytes]) -> Iterator[ArcRecord]:
    """Records of an ARC file (its bytes, or pieces of them), the version block first.

    A record whose declared length runs past the end of the file is marked truncated. Raises ValueError where a header
    line doesn't have the fields its version names.
    """
    source, names = _Source(data), None
    while source.has(1):
        if source.held[source.at] in b"\r\n":  # what separates records
            source.at += 1
            continue
        place, stop = source.place, source.find(b"\n")
        if stop < 0:
            raise ValueError(f"header line at {place} has no end")
        line = source.take(stop + 1).rstrip(b"\r\n").decode("utf-8", "replace")
        if names is None:
            values = line.split(" ")
            size = int(values[-1])
            content = source.take(size)
            body = content.decode("utf-8", "replace").splitlines()
            if not line.startswith("filedesc://") or len(body) < 2 or not body[0].split(" ")[0].isdigit():
                raise ValueError("the file doesn't open with a version block")
            names = tuple(body[1].split(" "))
            fields = {"URL": values[0], "version": body[0].split(" ")[0], "Archive-date": next((v for v in values[1:] if re.fullmatch(r"\d{14}", v)), CRAWL_DATE)}
        else:
            values = line.rsplit(" ", len(names) - 1)  # only the URL can hold spaces
            if len(values) != len(names) or not values[-1].isdigit():
                raise ValueError(f"header line at {place} has not the fields {names}")
            fields = dict(zip(names, values, strict=True))
            size = int(values[-1])
            content = source.take(size)
        yield ArcRecord(place, fields, content, len(content) < size)


def split_http(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields (lower-cased names), head and body of an HTTP message."""
    end = block.find(b"\r\n\r\n")
    head = block if end < 0 else block[: end + 4]
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}, head, block[len(head) :]


def record_id(place: str, offset: int) -> str:
    """The identifier of the record at an offset of a file, the same each time it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{place}#{offset}')}>"


def to_warc(record: ArcRecord, place: str) -> WarcRecord:
    """The equivalent WARC record; place names the file."""
    d = record.fields.get("Archive-date", CRAWL_DATE)
    date = f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"
    url = record.fields["URL"]
    http = record.content.startswith(b"HTTP/")
    kind = "warcinfo" if url.startswith("filedesc://") else "response" if http or url.startswith("dns:") else "resource"
    payload = split_http(record.content)[2] if http else record.content
    headers = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(place, record.offset),
        "WARC-Date": date,
        **({"WARC-Filename": url.removeprefix("filedesc://")} if kind == "warcinfo" else {"WARC-Target-URI": url}),
        "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}",
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(record.content).hexdigest()}",
        "Content-Type": "application/http; msgtype=response" if http else "application/warc-fields" if kind == "warcinfo" else record.fields.get("Content-type", "application/octet-stream"),
    }
    address = record.fields.get("IP-address", "-")
    if address not in ("-", "0.0.0.0"):
        headers["WARC-IP-Address"] = address
    if record.truncated:
        headers["WARC-Truncated"] = "length"
    return WarcRecord(headers, record.content)


def revisit(record: WarcRecord, of: str) -> WarcRecord:
    """The record as a revisit of the one with identifier ``of``: HTTP head only, payload digest as it was."""
    head = split_http(record.block)[1]
    changed = {"WARC-Type": "revisit", "WARC-Refers-To": of, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Block-Digest": f"sha256:{hashlib.sha256(head).hexdigest()}"}
    return WarcRecord(record.headers | changed, head)


def write_warc(record: WarcRecord) -> bytes:
    """A record without the blank lines that end it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in (record.headers | {"Content-Length": str(len(record.block))}).items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + record.block


def parse_warc(data: bytes | Iterable[bytes]) -> Iterator[WarcRecord]:
    """Records of a WARC file (its bytes, or pieces of them) by their declared lengths.

    Raises ValueError where one doesn't begin or end as it should.
    """
    source = _Source(data)
    while source.has(1):
        place, end = source.place, source.find(b"\r\n\r\n")
        if end < 0 or not source.held.startswith(b"WARC/1.", source.at):
            raise ValueError(f"no WARC record at {place}")
        lines = source.take(end + 4)[:-4].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k: v.strip() for k, _, v in (x.partition(":") for x in lines)}
        block = source.take(int(headers["Content-Length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {place} doesn't end after its declared length")
        yield WarcRecord(headers, block)


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _members(content: bytes) -> Iterator[bytes]:
    """What an archive's gzip members hold, one by one; the archive itself if it isn't gzipped."""
    if content[:2] != b"\x1f\x8b":
        yield content.rstrip(b"\0")
        return
    view = memoryview(content)
    while len(view) and view[0]:
        parts, member = [], zlib.decompressobj(31)
        while not member.eof and len(view):
            parts.append(member.decompress(view[: 1 << 16]))
            left = len(member.unused_data)
            view = view[min(len(view), 1 << 16) - left :]
        yield b"".join(parts)


def _files(docs: DataFrame, path: str) -> DataFrame:
    reader = docs.sparkSession.read.format("binaryFile").option("pathGlobFilter", "part-*")
    return reader.load(path).select("path", "content")


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about ``size`` bytes of whatever is binary."""
    held, held_bytes = [], 0
    for row in rows:
        held.append(row)
        held_bytes += sum(len(x) for x in row if isinstance(x, bytes)) + 64
        if held_bytes >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, held_bytes = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _archives(lines: DataFrame, path: str) -> None:
    """Write a file for each row's bytes."""
    lines.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", 1).text(path)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int | None = None) -> None:
    """Write ARC files of pages, a gzip member for each record.

    A task fills one archive of either version at a time and a hash of its id says which a page goes to, so both versions
    are written whatever the number of pages.
    """
    file_bytes = file_bytes or FILE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, room = {v: [] for v in FIELDS}, dict.fromkeys(FIELDS, 0)
        task, count = TaskContext.get().partitionId(), 0

        def archive(version: int) -> pa.RecordBatch:
            whole, members[version] = b"".join(members[version]), []
            return pa.RecordBatch.from_arrays([pa.array([whole], pa.binary())], names=["value"])

        for batch in slices(batches, 64):
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                version = 1 + zlib.crc32(str(page_id).encode()) % 2
                if not members[version]:
                    members[version], room[version] = [_member(version_block(version, f"part-{task}-{count}.arc") + b"\n")], file_bytes
                    count += 1
                record = arc_record(version, page_id, url, (html or "").encode())
                members[version].append(_member(record + b"\n"))
                room[version] -= len(record)
                if room[version] <= 0:
                    yield archive(version)
        for version in FIELDS:
            if members[version]:
                yield archive(version)

    source = own_columns(pages, page_id=id_col, url=url_col, html=html_col)
    _archives(source.mapInArrow(run, "value binary"), path)


def _page(head: dict[str, str], whole: bool) -> int | str | None:
    """The page id an HTTP head carries, as a whole number or a text."""
    told = head.get("x-page-id")
    return None if told is None else int(told) if whole else unquote(told)


def _id_kind(whole: bool) -> tuple[str, pa.DataType]:
    return ("bigint", pa.int64()) if whole else ("string", pa.string())


def convert(source: DataFrame, arc_path: str, warc_path: str, least_revisit: int = LEAST_REVISIT, whole_ids: bool = True) -> None:
    """Write a WARC file for each ARC file under arc_path, a gzip member for each record (source only lends its session).

    Of records with equal payloads of at least least_revisit bytes, that with the smallest page id stays a response (no id
    comes last, then the record's place decides) and the others become revisits of it.
    """
    files = _files(source, arc_path)

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path, content in zip(*batch.columns, strict=True):
                    for record in parse_arc(_members(content.as_py())):
                        if record.content.startswith(b"HTTP/"):
                            head, _, payload = split_http(record.content)
                            if len(payload) >= least_revisit:
                                yield path.as_py(), record.offset, hashlib.sha256(payload).digest(), _page(head, whole_ids)

        yield from _batches(rows(), pa.schema([("path", pa.string()), ("offset", pa.int64()), ("digest", pa.binary()), ("page_id", _id_kind(whole_ids)[1])]))

    found = checkpoint(files.mapInArrow(facts, f"path string, offset bigint, digest binary, page_id {_id_kind(whole_ids)[0]}"))
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "path", "offset")
    firsts = found.groupBy("digest").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select("digest", F.col("first.path").alias("of_path"), F.col("first.offset").alias("of_offset"))
    again = found.join(firsts, "digest").where("path <> of_path or offset <> of_offset")
    # an archive's records are bounded by its bytes
    again = checkpoint(again.groupBy("path").agg(F.collect_list(F.struct("offset", "of_path", "of_offset")).alias("again")))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, known in zip(*batch.columns, strict=True):
                place = path.as_py()
                of = {x["offset"]: record_id(x["of_path"], x["of_offset"]) for x in known.as_py() or ()}
                members = []
                for record in parse_arc(_members(content.as_py())):
                    made = to_warc(record, place)
                    members.append(_member(write_warc(revisit(made, of[record.offset]) if record.offset in of else made) + b"\r\n\r\n"))
                if members:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(members)], pa.binary())], names=["value"])

    _archives(files.join(again, "path", "left").select("path", "content", "again").mapInArrow(records, "value binary"), warc_path)


def read_warc(source: DataFrame, path: str, whole_ids: bool = True) -> DataFrame:
    """(record_id, page_id, url, payload_bytes, payload_digest, record_type, refers_to_id, refers_to) per page in WARC files.

    A response's length and digest are those of its payload, and its stated digest must agree; a revisit's are those it
    states. refers_to is the page id of the record a revisit refers to. The result no longer reads the files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for content in batch.column(1):
                    for record in parse_warc(_members(content.as_py())):
                        kind, stated = record.headers["WARC-Type"], record.headers["WARC-Payload-Digest"]
                        if kind not in ("response", "revisit"):
                            continue
                        head, _, payload = split_http(record.block)
                        size = int(head.get("content-length", len(payload)))
                        if kind == "response":
                            size = len(payload)
                            if f"sha256:{hashlib.sha256(payload).hexdigest()}" != stated:
                                raise ValueError(f"payload of {record.headers['WARC-Record-ID']} isn't what was written")
                        yield record.headers["WARC-Record-ID"], _page(head, whole_ids), record.headers["WARC-Target-URI"], size, stated.removeprefix("sha256:"), kind, record.headers.get("WARC-Refers-To")

        names = [("record_id", pa.string()), ("page_id", _id_kind(whole_ids)[1]), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to_id", pa.string())]
        yield from _batches(rows(), pa.schema(names))

    found = checkpoint(_files(source, path).mapInArrow(run, f"record_id string, page_id {_id_kind(whole_ids)[0]}, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to_id string"))
    # only revisits are joined: all others would meet in one task, as they refer to nothing
    revisits = found.where("refers_to_id is not null")
    referred = revisits.select(F.col("refers_to_id").alias("r")).distinct()
    originals = found.join(referred, F.col("record_id") == F.col("r"), "left_semi").select(F.col("record_id").alias("o"), F.col("page_id").alias("refers_to"))
    resolved = revisits.join(originals, F.col("refers_to_id") == F.col("o"), "left").drop("o")
    return found.where("refers_to_id is null").withColumn("refers_to", F.lit(None).cast(_id_kind(whole_ids)[0])).unionByName(resolved)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive pages as ARC, convert to WARC and read back: read_warc's rows, one per row of pages.

    A null html is an empty payload, a null url becomes urn:missing, a null id stays null and ids that aren't whole numbers
    come back as texts; repeated rows are records of
    their own, all but one of them revisits where the payload is long enough. An empty table gives no rows; other columns
    are ignored. A payload of any length is one record, in an archive of its own past FILE_BYTES. The archives are deleted
    once they have been read back.
    """
    spark = pages.sparkSession
    old, new = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    write_arc(pages, old, id_col, url_col, html_col)
    whole = isinstance(pages.schema[id_col].dataType, IntegralType)
    convert(pages, old, new, whole_ids=whole)
    discard(spark, old)
    found = read_warc(pages, new, whole)
    discard(spark, new)
    return found
