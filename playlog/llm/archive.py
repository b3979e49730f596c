"""Legacy ARC archives: writing, parsing by version, and conversion to WARC.

An ARC file opens with a version block whose last line names the fields of every record's header
line (five in version 1, ten in version 2).  A record is that line, then as many bytes as
its last field declares, then a line end.  Conversion synthesises what WARC wants and ARC lacks: record
ids, ISO timestamps, record types and payload digests; records with an equal payload of at least
MIN_REVISIT bytes become revisits of the one with the smallest page id.

Both kinds of file are written by Spark's text writer and read by its binaryFile source, so they may lie in any file
system that Spark knows.  Every record is a gzip member of its own, so that it can be opened by its
offset.  A row is a member without its last byte, which is the highest byte of the record's size and zero, and
the row separator puts that byte back; a record of 16 MB or more is followed by an empty member.

A record that does not parse is set aside with its place and the reason; reading goes on at the next header.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlog.llm.common import BROADCAST_BYTES, saved, trimmed, work_folder

MIN_REVISIT = 100
DATE = "20240101000000"
IP = "0.0.0.0"
# The header fields of either ARC version, as its version block spells them.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 4 << 20
GZIP_LEVEL = 2
READ_BYTES = 64 << 10
ARC_ROW = "file string, offset long, error string, version int, url string, ip string, date string, mime string, page_id long, record_id string, digest string, head binary, payload binary"
WARC_ROW = "file string, offset long, error string, record_id string, record_type string, url string, date string, refers_to_id string, payload_digest string, page_id long, n long, payload binary"
_ARC_LINE = re.compile(rb"^\S[^\n]* \S+ \d{12,14} \S+(?: \S+ \S+ \S+ \d+ \S+)? \d+$", re.M)


def _url(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"


def _member(record: bytes) -> bytes:
    """A record as a gzip member without the last zero byte."""
    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    out = packer.compress(record) + packer.flush()
    if out[-1]:
        packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
        out += packer.flush()
    return out[:-1]


def _strings(rows: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
    """Batches of one binary column, each of about BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])


def write_arc(pages: DataFrame, folder: str, date: str = DATE) -> None:
    """An ARC file for each partition of pages(page_id, url, html); odd partitions use version 2.

    A null html is an empty payload, a null url is written as urn:none, a null page_id as '-'.
    """

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version = 1 + part % 2

        def rows() -> Iterator[bytes]:
            block = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
            offset = 0

            def record(url: str, mime: str, body: bytes) -> bytes:
                nonlocal offset
                middle = "" if version == 1 else f" 200 - - {offset} part-{part:05d}.arc"
                out = f"{url} {IP} {date} {mime}{middle} {len(body)}\n".encode() + body + b"\n"
                offset += len(out)
                return _member(out)

            yield record(f"filedesc://part-{part:05d}.arc", "text/plain", block)
            for batch in stream:
                for page, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                    page, payload = page.as_py(), (html.as_py() or "").encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'-' if page is None else page}\r\n\r\n"
                    yield record(_url(url.as_py()), "text/html", head.encode() + payload)

        yield from _strings(rows())

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    _write(source.mapInArrow(trimmed(run), "value binary"), folder)


def _write(members: DataFrame, folder: str) -> None:
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").text(folder)


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset in the file, bytes) of each member of a gzip file; a plain file is one."""
    if content[:2] != b"\x1f\x8b":
        yield 0, content
        return
    at = 0
    while content[at : at + 2] == b"\x1f\x8b":
        unzip, begin, out = zlib.decompressobj(31), at, []
        while not unzip.eof and at < len(content):
            some = content[at : at + READ_BYTES]
            out.append(unzip.decompress(some))
            at += len(some) - len(unzip.unused_data)
        yield begin, b"".join(out)


def arc_records(data: bytes, state: dict) -> Iterator[tuple[int, str | None, int, dict[str, str], bytes]]:
    """(offset, error, version, header fields, body) of each record; a version block is kept in state, not given out.

    The URL may hold blanks: the other fields are counted from the end of the line.  Without a version block the
    number of fields tells the version.  After a record that does not parse (error says why) the next line that
    looks like a header is sought.
    """
    at = 0
    while at < len(data):
        end = data.find(b"\n", at)
        end = len(data) if end < 0 else end
        line = data[at:end].decode("utf-8", "replace").rstrip("\r")
        if not line.strip():
            at = end + 1
            continue
        body, error, version, fields = b"", None, state.get("version", 0), {}
        size = line.rsplit(" ", 1)[-1]
        if not size.isdecimal() or not size.isascii() or " " not in line:
            error = "no header line"
        elif end + 1 + int(size) > len(data):
            error = f"declares {size} bytes and has {max(0, len(data) - end - 1)}"
        else:
            body = data[end + 1 : end + 1 + int(size)]
            if line.startswith("filedesc://"):
                first, _, rest = body.decode("utf-8", "replace").partition("\n")
                number, names = first.split(" ", 1)[0], rest.split("\n", 1)[0].strip().split(" ")
                if number in ("1", "2") and len(names) >= 5:
                    state |= {"version": int(number), "names": names}
                    at = end + 1 + int(size)
                    continue
                error = f"version block of version {number[:20]!r}"
            else:
                names = state.get("names") or ARC_FIELDS[2 if len(line.split(" ")) >= 10 else 1].split(" ")
                version = version or (2 if len(names) == 10 else 1)
                values = line.rsplit(" ", len(names) - 1)
                if len(values) == len(names):
                    fields = dict(zip(names, values, strict=True))
                else:
                    error = f"{len(values)} header fields, version {version} has {len(names)}"
        yield at, error, version, fields, body
        if error is None:
            at = end + 1 + int(size)
        else:
            after = _ARC_LINE.search(data, min(end + 1, len(data)))
            at = after.start() if after else len(data)


def _http(body: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload); a body that is no HTTP message is all payload."""
    if not body.startswith(b"HTTP/") or (end := body.find(b"\r\n\r\n")) < 0:
        return b"", body
    return body[: end + 4], body[end + 4 :]


def _page_id(head: bytes) -> int | None:
    found = re.search(rb"\r\nX-Page-Id: (-?\d+)\r\n", head)
    return int(found[1]) if found else None


def _rows(stream: Iterable[pa.RecordBatch], parse, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    held, size = [], 0
    for batch in stream:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            for row in parse(path.as_py(), content.as_py()):
                held.append(row)
                size += 300 + len(row[-1] or b"")
                if size >= BATCH_BYTES:
                    yield batch_of(held)
                    held, size = [], 0
    if held:
        yield batch_of(held)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (f.split(" ") for f in ddl.split(", "))])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")


def parsed_arc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of every ARC file in a folder, those set aside with an error; a file is one task's, so files bound
    the memory.  Without payloads only their digests are given."""

    def parse(path: str, content: bytes) -> Iterator[tuple]:
        state: dict = {}
        for start, data in members(content):
            for at, error, version, fields, body in arc_records(data, state):
                if error:
                    yield path, start + at, error, *[None] * 10
                    continue
                head, payload = _http(body)
                place = "\n".join([path.rsplit("/", 1)[-1], str(start + at), fields["URL"], fields["Archive-date"]])
                name = uuid.uuid5(uuid.NAMESPACE_URL, place).urn
                yield path, start + at, None, version, fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], _page_id(head), name, hashlib.sha256(payload).hexdigest() if len(payload) >= MIN_REVISIT or payloads else None, head if payloads else None, payload if payloads else None

    return _files(spark, folder).mapInArrow(trimmed(lambda s: _rows(s, parse, _schema(ARC_ROW))), ARC_ROW)


def read_arc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of every ARC file in a folder that parse."""
    return parsed_arc(spark, folder).where("error is null").drop("error")


def faults(parsed: DataFrame) -> DataFrame:
    """(file, offset, error) of the records that were set aside."""
    return parsed.where("error is not null").select("file", "offset", "error")


def converted(spark: SparkSession, folder: str, work: str) -> DataFrame:
    """The records of a folder's ARC files with the synthesised WARC fields: record_id, warc_date, digest, record_type, refers_to_id.

    The decision which record others refer to is made on narrow rows.  Its answer is broadcast if
    its counted rows are few, and joined by place otherwise.
    """
    places = parsed_arc(spark, folder, payloads=False).where("digest is not null").select("file", "offset", "digest", "page_id", "record_id")
    places = saved(places, work, "places")
    first = places.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    refers = places.join(first, "digest").where(F.col("record_id") != F.col("first.record_id")).select("file", "offset", F.col("first.record_id").alias("refers_to_id"))
    refers = saved(refers, work, "refers")
    size = refers.agg(F.sum(F.length("file") + 100)).first()[0] or 0
    kind = F.when(F.length("head") == 0, "resource").when(F.col("refers_to_id").isNull(), "response").otherwise("revisit")
    day = F.regexp_replace(F.rpad("date", 14, "0"), r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3T$4:$5:$6Z")
    joined = read_arc(spark, folder).join(F.broadcast(refers) if size < BROADCAST_BYTES else refers, ["file", "offset"], "left")
    return joined.withColumns({"warc_date": day, "record_type": kind})


def write_warc(records: DataFrame, folder: str) -> None:
    """A WARC file, opened by a warcinfo record, for each partition of converted records."""

    def run(stream: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
            lines = "".join(f"{k}: {v}\r\n" for k, v in fields)
            return _member(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")

        def rows() -> Iterator[bytes]:
            opened = False
            for batch in stream:
                for r in batch.to_pylist():
                    if not opened:
                        opened = True
                        about = b"software: playlog\r\nformat: WARC File Format 1.1\r\n"
                        yield record([("WARC-Type", "warcinfo"), ("WARC-Date", r["warc_date"]), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'part-{part:05d}')}>"), ("WARC-Filename", f"part-{part:05d}.warc.gz"), ("Content-Type", "application/warc-fields")], about)
                    revisit = r["record_type"] == "revisit"
                    block = r["head"] if revisit else r["head"] + r["payload"]
                    fields = [("WARC-Type", r["record_type"]), ("WARC-Target-URI", r["url"]), ("WARC-Date", r["warc_date"]), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", f"sha256:{r['digest']}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}")]
                    if revisit:
                        fields += [("WARC-Refers-To", f"<{r['refers_to_id']}>"), ("WARC-Profile", REVISIT_PROFILE)]
                    fields.append(("Content-Type", "application/http; msgtype=response" if r["head"] else r["mime"]))
                    yield record(fields, block)

        yield from _strings(rows())

    wanted = records.select("record_type", "url", "warc_date", "record_id", "ip", "digest", "refers_to_id", "mime", "head", "payload")
    _write(wanted.mapInArrow(trimmed(run), "value binary"), folder)


def warc_records(data: bytes) -> Iterator[tuple[int, str | None, dict[str, str], bytes]]:
    """(offset, error, header fields by lower-case name, block) of each record; errors as in arc_records."""
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end, error, fields, block = data.find(b"\r\n\r\n", at), None, {}, b""
        if not data.startswith(b"WARC/", at) or end < 0:
            error = "no WARC record"
        else:
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
            size = fields.get("content-length", "")
            if not (size.isascii() and size.isdecimal()):
                error = "no Content-Length"
            elif end + 4 + int(size) > len(data):
                error = f"declares {size} bytes and has {len(data) - end - 4}"
            elif missing := [f for f in ("warc-type", "warc-record-id") if not fields.get(f)]:
                error = f"no {missing[0]}"
            else:
                block = data[end + 4 : end + 4 + int(size)]
        yield at, error, fields, block
        if error is None:
            at = end + 4 + len(block)
        else:
            after = data.find(b"\r\nWARC/", at + 1)
            at = after + 2 if after >= 0 else len(data)


def _agrees(stated: str, payload: bytes, own: str) -> bool:
    """Whether a stated digest (sha256 in hex, sha1 in base 32) is the payload's; other kinds are not judged."""
    kind, _, value = stated.partition(":")
    if kind == "sha256" and len(value) == 64:
        return value.lower() == own
    if kind == "sha1" and len(value) == 32:
        return value.upper() == base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return True


def parsed_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record of every WARC file in a folder but for warcinfo, those set aside with an error.

    payload_digest is the SHA-256 of the payload (n bytes), for a revisit the one that it states; a stated digest that a
    payload at hand does not have is an error.
    """

    def parse(path: str, content: bytes) -> Iterator[tuple]:
        for start, data in members(content):
            for at, error, fields, block in warc_records(data):
                kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest", "")
                if error is None and kind == "warcinfo":
                    continue
                head, payload = _http(block)
                own = stated.removeprefix("sha256:") if kind == "revisit" else hashlib.sha256(payload).hexdigest()
                if error is None and kind != "revisit" and not _agrees(stated, payload, own):
                    error = "the payload does not have its digest"
                if error:
                    yield path, start + at, error, *[None] * 9
                    continue
                yield path, start + at, None, fields["warc-record-id"].strip("<>"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-refers-to", "").strip("<>") or None, own, _page_id(head), len(payload), payload if payloads else None

    return _files(spark, folder).mapInArrow(trimmed(lambda s: _rows(s, parse, _schema(WARC_ROW))), WARC_ROW)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of every WARC file in a folder that parse, but for warcinfo."""
    return parsed_warc(spark, folder).where("error is null").drop("error")


def round_trip(pages: DataFrame) -> DataFrame:
    """pages to ARC, ARC to WARC, WARC back to rows: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Repeated rows are records of their own: of equal payloads the first place in the archive of the smallest
    page_id is the response.  An empty table gives an empty result; other columns are not read.
    """
    spark = pages.sparkSession
    folder = work_folder(spark)
    write_arc(pages, f"{folder}/arc")
    write_warc(converted(spark, f"{folder}/arc", folder), f"{folder}/warc")
    found = parsed_warc(spark, f"{folder}/warc", payloads=False).where("error is null")
    rows = saved(found.select("record_id", "record_type", "refers_to_id", "payload_digest", "page_id", "n"), folder, "rows")
    whole = rows.where("refers_to_id is null")
    target = whole.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("n").alias("payload_bytes"))
    revisits = rows.where("refers_to_id is not null").join(target, "refers_to_id")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return whole.select("page_id", F.col("n").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).unionByName(revisits.select(*columns))
