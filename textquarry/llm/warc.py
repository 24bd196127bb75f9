"""WARC files from legacy ARC files.

An ARC file starts with a version block, whose second line gives the version and whose third line names the fields of every
record's header line: five in version 1, ten in version 2. Each record is its header line, as many bytes as the line declares,
and a newline. The version block becomes a warcinfo record; a server's whole answer, HTTP head and all, a response; an answer
with the payload of another a revisit; anything else (dns: and other schemes, a body without a head) a resource. Ids, dates,
types and digests are made from the file's path, the header line and the bytes alone, so that a second run gives the same.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from http import HTTPStatus
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Equal payloads of at least so many bytes become revisits.
LEAST_REVISIT = 1000
#: Bytes of records in one file, about; a longer record has a file to itself.
FILE_BYTES = 256 << 20
LEVEL = 3
#: Field names of the two versions' header lines.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:textquarry:warc")


_HTTP = re.compile(rb"HTTP/\d(?:\.\d)? (\d{3})")
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_IP = re.compile(r"\d+\.\d+\.\d+\.\d+|[0-9A-Fa-f]*:[0-9A-Fa-f:.]*|-")
#: Schemes whose records are no answers of web servers, whatever their bytes.
_OTHER = ("dns:", "filedesc:", "warcinfo:")


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    length: int
    status: int | None
    checksum: str | None
    body: bytes


@dataclass
class VersionBlock:
    """What an ARC file says of itself: its version, its name, its date, who made it, and all of the block's text."""

    version: int
    name: str
    date: str
    origin: str
    text: str


def _field(value: str | None) -> str:
    """A header field can't be empty or hold white space: such characters are percent-encoded, and nothing is a hyphen."""
    return "".join(c if c > " " and not c.isspace() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value or "") or "-"


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 textquarry\n{FIELDS[version]}\n"
    size = len(body.encode())
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain {size}" if version == 1 else f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {size}"
    return f"{line}\n{body}\n".encode()


def arc_record(version: int, url: str, date: str, content_type: str, body: bytes, ip: str = "0.0.0.0", status: int = 200, checksum: str = "-", offset: int = 0, name: str = "-") -> bytes:
    fields = [_field(url), ip, date, _field(content_type)]
    if version == 2:
        fields += [str(status), checksum, "-", str(offset), name]
    return " ".join([*fields, str(len(body))]).encode() + b"\n" + body + b"\n"


def _named(parts: list[str], version: int) -> dict[str, str]:
    """The fields of a header line by their names; a URL may hold spaces, and so may a content type.

    The fields behind the content type are counted from the end; the date is known by its digits behind an IP address.
    """
    names = FIELDS[version].split(" ")
    tail = len(names) - 4
    front, rest = parts[:-tail], parts[-tail:]
    at = next((i for i in range(2, len(front)) if front[i].isdigit() and _IP.fullmatch(front[i - 1])), max(2, len(front) - 2))
    return dict(zip(names, [" ".join(front[: at - 1]), front[at - 1], front[at], " ".join(front[at + 1 :]) or "-", *rest], strict=True))


def parse_arc(file) -> Iterator[VersionBlock | ArcRecord]:
    """The version block and the records of an uncompressed ARC stream, read one at a time by their declared lengths.

    The version block says which fields a header line has. Blank lines between records are passed over; a line with too few
    fields, a length that is no number, or a body that ends early is an error.
    """
    version = 0
    while line := file.readline():
        if not line.strip():
            continue
        parts = line.rstrip(b"\r\n").decode("utf-8", "replace").split(" ")
        try:
            length = int(parts[-1])
        except ValueError:
            raise ValueError(f"no declared length in the header line {line[:200]!r}") from None
        body = file.read(length)
        if length < 0 or len(body) < length:
            raise ValueError(f"{parts[0][:200]}: {length} bytes declared, {len(body)} there")
        if not version:
            text = body.decode("utf-8", "replace")
            first, names = [*text.splitlines(), "", ""][:2]
            said = first.split(" ")
            version = int(said[0]) if said[0].isdigit() else 0
            if version not in FIELDS or len(names.split()) != len(FIELDS[version].split(" ")):
                raise ValueError(f"a version block {text[:200]!r} isn't known")
            row = dict(zip(("url", "ip", "date"), [*parts, "", ""], strict=False))
            yield VersionBlock(version, row["url"].removeprefix("filedesc://"), row["date"], " ".join(said[2:]), text)
            continue
        if len(parts) < len(FIELDS[version].split(" ")):
            raise ValueError(f"{len(parts)} fields in the header line {line[:200]!r}")
        row = _named(parts, version)
        known = {k: None if v == "-" else v for k, v in row.items()}
        status = known.get("Result-code")
        yield ArcRecord(row["URL"], row["IP-address"], row["Archive-date"], row["Content-type"], length, int(status) if status and status.isdigit() else None, known.get("Checksum"), body)


def warc_date(date: str, other: str = "") -> str:
    """An ARC date of 4 to 14 digits as a WARC date: of the longest part of it that is a time, what is not there is the least.

    Where no part is a time, as in a date of zeros, it is the other date, and without that the start of 1970.
    """
    for size in (14, 12, 10, 8, 6, 4):
        if len(date) >= size and date[:size].isdecimal() and date[:size].isascii():
            try:
                made = datetime.strptime(date[:size] + "00000101000000"[size:], "%Y%m%d%H%M%S")
            except ValueError:
                continue
            return f"{made.year:04d}{made:-%m-%dT%H:%M:%SZ}"
    return warc_date(other) if other else "1970-01-01T00:00:00Z"


def digest32(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record_id(path: str, at: int, url: str, date: str) -> str:
    """The same for the same record of the same file; at is its place in it."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{path} {at} {date} {url}')}>"


def split_answer(record: ArcRecord) -> tuple[bytes, bytes] | None:
    """(HTTP head, payload) of a server's answer, None for other records.

    The head is that in the body. A body without one, of a web URL whose line has a result code, gets one with that code.
    """
    url = record.url.lower()
    if url.startswith(_OTHER):
        return None
    if _HTTP.match(record.body):
        end = _HEAD_END.search(record.body)
        return (record.body[: end.end()], record.body[end.end() :]) if end else (record.body, b"")
    if record.status is not None and url.startswith(("http:", "https:")):
        reason = HTTPStatus(record.status).phrase if record.status in set(HTTPStatus) else ""
        return f"HTTP/1.0 {record.status} {reason}\r\nContent-Type: {record.content_type}\r\nContent-Length: {len(record.body)}\r\n\r\n".encode(), record.body
    return None


def head_field(head: bytes, name: str) -> str | None:
    """The first field of this name in an HTTP head."""
    for line in head.split(b"\n")[1:]:
        k, _, v = line.partition(b":")
        if k.strip().lower() == name.lower().encode():
            return v.strip().decode("utf-8", "replace")
    return None


def head_number(head: bytes, name: str | None) -> int | None:
    """The field's whole number, if it has one that fits 64 bits."""
    value = head_field(head, name) if name else None
    return int(value) if value and re.fullmatch(r"-?[0-9]{1,19}", value) and -(2**63) <= int(value) < 2**63 else None


def warc_record(kind: str, ident: str, date: str, block: bytes, block_type: str, fields: dict[str, str]) -> bytes:
    """A record as a gzip member."""
    head = {"WARC-Type": kind, "WARC-Record-ID": ident, "WARC-Date": date, **fields, "WARC-Block-Digest": digest32(hashlib.sha1(block).digest()), "Content-Type": block_type, "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in head.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", LEVEL, mtime=0)


def warcinfo(path: str, block: VersionBlock) -> tuple[str, bytes]:
    """The record id and the record that an ARC file's version block becomes."""
    date = warc_date(block.date)
    ident = record_id(path, 0, block.name, date)
    fields = {"software": "textquarry", "format": "WARC File Format 1.1", "description": f"converted from ARC version {block.version}", "isPartOf": block.name, "operator": block.origin}
    body = "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields.items() if v).encode()
    return ident, warc_record("warcinfo", ident, date, body, "application/warc-fields", {"WARC-Filename": block.name or "-"})


def warc_of(record: ArcRecord, ident: str, date: str, info: str, to: dict | None = None) -> bytes:
    """The WARC record of an ARC record; to is the response (ident, uri, date) that a revisit refers to."""
    fields = {"WARC-Target-URI": record.url, "WARC-Warcinfo-ID": info}
    if record.ip and record.ip != "-":
        fields["WARC-IP-Address"] = record.ip
    if record.checksum:
        fields["X-Arc-Checksum"] = record.checksum
    answer = split_answer(record)
    if answer is None:
        kind = record.content_type if "/" in record.content_type else "application/octet-stream"
        return warc_record("resource", ident, date, record.body, kind, fields | {"WARC-Payload-Digest": digest32(hashlib.sha1(record.body).digest())})
    head, payload = answer
    fields["WARC-Payload-Digest"] = digest32(hashlib.sha1(payload).digest())
    if to is None:
        return warc_record("response", ident, date, head + payload, "application/http; msgtype=response", fields)
    fields |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": to["ident"], "WARC-Refers-To-Target-URI": to["uri"], "WARC-Refers-To-Date": to["date"], "X-Payload-Length": str(len(payload))}
    return warc_record("revisit", ident, date, head, "application/http; msgtype=response", fields)


def parse_warc(file) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields in lower case, block) of each record of an uncompressed WARC stream."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:80]!r}")
        head = {}
        while (line := file.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head["content-length"])
        block = file.read(size)
        if len(block) < size:
            raise ValueError("a WARC record ends early")
        yield head, block


class _Gzip(io.RawIOBase):
    """A gzip file of many members as a stream, a piece at a time."""

    def __init__(self, file):
        self._file, self._left, self._z, self._out = file, b"", None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while not self._out:
            data = self._left or self._file.read(1 << 20)
            self._left = b""
            if not data:
                return 0
            self._z = self._z or zlib.decompressobj(31)
            self._out = self._z.decompress(data, 1 << 22)
            self._left = self._z.unconsumed_tail
            if self._z.eof:
                self._left, self._z = self._z.unused_data, None
        n = min(len(target), len(self._out))
        target[:n], self._out = self._out[:n], self._out[n:]
        return n


def gunzipped(file) -> io.BufferedReader:
    """The file's bytes, decompressed if it begins as gzip."""
    start = file.read(2)
    file.seek(0)
    return io.BufferedReader(_Gzip(file) if start == b"\x1f\x8b" else _Plain(file), 1 << 20)


class _Plain(io.RawIOBase):
    def __init__(self, file):
        self._file = file

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        data = self._file.read(len(target))
        target[: len(data)] = data
        return len(data)


class _Files:
    """Writes gzip members one after the other, and a new file now and then."""

    def __init__(self, folder: str, kind: str):
        self._folder, self._kind, self._out, self._size = folder, kind, None, 0
        self.name, self.made = "", []

    def start(self) -> str:
        """Opens a file if none is open; its name then, else nothing."""
        if self._out is not None:
            return ""
        self.name = f"part-{TaskContext.get().partitionId():06d}-{len(self.made):04d}-{uuid.uuid4().hex}.{self._kind}.gz"
        self._out, self._size = shared.open_new(f"{self._folder}/{self.name}"), 0
        self.made.append(f"{self._folder}/{self.name}")
        return self.name

    def add(self, data: bytes) -> None:
        self._out.write(data)
        self._size += len(data)
        if self._size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self._out is not None:
            self._out.close()
            self._out = None


#: The HTTP field that carries a page's key.
KEY = "X-Page-Id"


def write_arc(pages: DataFrame, folder: str, payload: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Pages as gzipped ARC files, rows by turns in version 1 and 2; one row (path) for each file.

    A record's body is a server's answer: an HTTP head, with the page's key in the field KEY unless null, and the payload. A
    version 2 line carries the payload's SHA-1 as its checksum. The pages give no time, so the date counts seconds from the
    year 2000 by the key.
    """
    rows = pages.select(F.col(key).cast("long").alias("key"), shared.valid(url).alias("url"), shared.valid(payload).alias("body"))

    def write(batches: Iterable[dict[str, list]]) -> Iterator[pd.DataFrame]:
        files, turn = {version: _Files(folder, "arc") for version in FIELDS}, 0
        for batch in batches:
            for page, u, body in zip(batch["key"], batch["url"], batch["body"], strict=True):
                version, turn = 1 + turn % 2, turn + 1
                data = (body or "").encode()
                if name := files[version].start():
                    files[version].add(gzip.compress(arc_version_block(version, name, "20000101000000"), LEVEL, mtime=0))
                head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}\r\n" + ("" if page is None else f"{KEY}: {page}\r\n") + "\r\n"
                made = arc_record(version, u, arc_date(page), "text/html", head.encode() + data, checksum=hashlib.sha1(data).hexdigest(), name=files[version].name)
                files[version].add(gzip.compress(made, LEVEL, mtime=0))
        for f in files.values():
            f.close()
        yield pd.DataFrame({"path": [path for f in files.values() for path in f.made]}, dtype=object)

    return shared.materialize(shared.map_lists(rows, write, "path string"), "arc-files")


def arc_date(key: int | None) -> str:
    return (datetime(2000, 1, 1, tzinfo=UTC) + timedelta(seconds=(key or 0) % (1 << 31))).strftime("%Y%m%d%H%M%S")


def _each_file(spark: SparkSession, files: DataFrame) -> DataFrame:
    return files.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")


def _placed(path: str) -> Iterator[tuple[int, str, str, VersionBlock | ArcRecord]]:
    """(place, record id, date, what is there) for each part of an ARC file; place 0 is the version block."""
    with shared.open_old(path) as f:
        other = ""
        for at, r in enumerate(parse_arc(gunzipped(f))):
            if isinstance(r, VersionBlock):
                other = r.date
                yield at, "", "", r
            else:
                date = warc_date(r.date, other)
                yield at, record_id(path, at, r.url, date), date, r


def convert(files: DataFrame, folder: str, least: int = LEAST_REVISIT, order: str | None = None) -> DataFrame:
    """Converts ARC files (column path), gzipped or not, into WARC files under folder; one row (path) for each.

    Of answers with equal payloads of at least this many bytes one is a response and the others revisits of it: that with the
    greatest number in the HTTP field named by order, then the latest date, then the last by path and place. The first reading
    lists the payloads' digests; the revisits among them are then dealt to the tasks that read the ARC files again and write
    the WARC records, with their ARC file's path, so that a task holds its files' revisits only. A broken file is an error.
    """
    spark = files.sparkSession
    names = ["path", "at", "place", "ident", "uri", "date", "payload_bytes", "sha1"]

    def index(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows = []
                for at, ident, date, r in _placed(path):
                    answer = None if isinstance(r, VersionBlock) else split_answer(r)
                    if answer is not None and len(answer[1]) >= least:
                        rows.append((path, at, head_number(answer[0], order), ident, r.url, date, len(answer[1]), hashlib.sha1(answer[1]).hexdigest()))
                yield pd.DataFrame(rows, columns=names, dtype=object)

    listed = shared.materialize(_each_file(spark, files).mapInPandas(index, "path string, at long, place long, ident string, uri string, date string, payload_bytes long, sha1 string"), "payloads")
    place = F.struct(F.coalesce("place", F.lit(-(2**63))).alias("place"), "date", "path", "at", "ident", "uri")
    groups = listed.groupBy("sha1", "payload_bytes").agg(F.max(place).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = shared.materialize(groups.select(F.col("sha1").alias("_s"), F.col("payload_bytes").alias("_n"), "best"), "responses")
    joined = listed.join(groups, (listed["sha1"] == groups["_s"]) & (listed["payload_bytes"] == groups["_n"])).filter(F.col("ident") != F.col("best.ident"))
    revisits = joined.groupBy("path").agg(F.collect_list(F.struct("at", "best.ident", "best.uri", "best.date")).alias("revisits"))  # a file's records bound the list
    revisits = shared.materialize(revisits.withColumnRenamed("path", "_p"), "revisits")
    dealt = files.select("path").join(revisits, F.col("path") == F.col("_p"), "left").select("path", "revisits")

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = _Files(folder, "warc")
        for batch in batches:
            for path, found in zip(batch["path"], batch["revisits"], strict=True):
                again, info = {} if found is None else {int(x["at"]): x for x in found}, ""
                for at, ident, date, r in _placed(path):
                    out.start()
                    if isinstance(r, VersionBlock):
                        info, data = warcinfo(path, r)
                        out.add(data)
                    else:
                        out.add(warc_of(r, ident, date, info, again.get(at)))
        out.close()
        yield pd.DataFrame({"path": out.made}, dtype=object)

    return shared.materialize(dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").mapInPandas(write, "path string"), "warc-files")


_RECORD = "record_type string, record_id string, uri string, date string, payload_bytes long, payload_digest string, refers_to_id string, status int, key long"


def read_warc(files: DataFrame, key: str | None = None) -> DataFrame:
    """A row for each record of the WARC files: record_type, record_id, uri, date, payload_bytes, payload_digest, refers_to_id, status (of HTTP) and key (the number in the HTTP field of this name).

    A payload's digest is computed, and an error if the header has another; a revisit has no payload, so its digest and length
    are the header's. What a record doesn't have is null.
    """

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                rows = []
                with shared.open_old(path) as f:
                    for head, block in parse_warc(gunzipped(f)):
                        kind, said = head["warc-type"], head.get("warc-payload-digest")
                        digest, size, http = said and base64.b32decode(said.partition(":")[2]).hex(), None, b""
                        if kind == "revisit":
                            http, size = block, int(head.get("x-payload-length", 0))
                        elif kind in ("response", "resource"):
                            end = _HEAD_END.search(block) if kind == "response" else None
                            http, payload = (block[: end.end()], block[end.end() :]) if end else (block, b"") if kind == "response" else (b"", block)
                            size, own = len(payload), hashlib.sha1(payload).hexdigest()
                            if digest != own:
                                raise ValueError(f"{head['warc-record-id']}: its payload digest is wrong")
                        status = _HTTP.match(http)
                        rows.append((kind, head["warc-record-id"], head.get("warc-target-uri"), head["warc-date"], size, digest, head.get("warc-refers-to"), status and int(status[1]), head_number(http, key)))
                yield pd.DataFrame(rows, columns=[x.split(" ")[0] for x in _RECORD.split(", ")], dtype=object)

    return _each_file(files.sparkSession, files).mapInPandas(read, _RECORD)


def pages_to_warc(pages: DataFrame, folder: str, **columns) -> DataFrame:
    """Pages by way of ARC files to WARC files and back; one row for each page: page_id, payload_bytes, payload_digest,
    record_type, refers_to (the response's page_id), uri, date, record_id.

    Of pages with one payload of LEAST_REVISIT bytes or more, that with the greatest key is the response. A null payload is
    empty, a null URL an empty one; rows that repeat a page are records of their own; a null key stays null, and is the least;
    ill-formed UTF-8 is U+FFFD; other columns are left out; an empty table gives no rows. Files that a lost task leaves are in
    no list and are not read.
    """
    files = convert(write_arc(pages, f"{folder}/arc", **columns), f"{folder}/warc", order=KEY)
    records = shared.materialize(read_warc(files, KEY).filter("record_type <> 'warcinfo'"), "records")
    responses = records.filter("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("key").alias("refers_to"))
    both = records.join(responses, records["refers_to_id"] == responses["_id"], "left")
    return both.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "uri", "date", "record_id")


def op2_arc_to_warc(spark, sf_dir: str) -> DataFrame:
    """A row for each page, read back from the WARC files. Odd rows as in pages_to_warc."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages_to_warc(pages, shared.new_folder(spark, "op2")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle_op2() -> str:
    return f"""
    with p as (select page_id, encode(coalesce(html, '')) as body from pages),
    q as (select page_id, octet_length(body)::bigint as payload_bytes, sha1(body) as payload_digest from p),
    g as (select *, max(page_id) over (partition by payload_digest, payload_bytes) as top from q)
    select page_id, payload_bytes, payload_digest, case when payload_bytes >= {LEAST_REVISIT} and page_id < top then 'revisit' else 'response' end as record_type,
      case when payload_bytes >= {LEAST_REVISIT} and page_id < top then top end as refers_to from g"""
