"""Legacy archive converter: ARC files of either version to WARC records.

``parse_arc`` walks an ARC file by its version block, its header lines (5 fields
in version 1, 10 in version 2) and the lengths they declare. ``convert`` turns
each record into a WARC record with a synthesised identifier, ISO timestamp,
type and SHA-1 digests. ``repeated`` finds the response that stays for each
payload that is there more than once, from digests alone; ``mark_revisits`` lets
the others refer to it. ``write_warc`` writes WARC files in which each record is
a gzip member of its own, so that tools can seek, and ``read_warc`` reads them
back by declared lengths. Both formats go through Spark's text writer, so any
file system will do; its files end in .txt or .txt.gz.

Null page ids sort below all others and stay null; a null html is an empty
payload; a null URL becomes ``urn:null``, an empty one ``urn:empty``; white space
in URLs is percent-encoded. Repeated rows become records of their own, of which one
is the response; of equal page ids it is that of the greatest record id. Record
ids come from the name that an archive declares, its file's name without what a
writing job adds to it, and the record's place, so a rerun over the same rows in the
same order gives the same ones. The first record of a file is its version block,
whatever the URLs of others. Very
long pages are records like any other: files are cut by bytes and read record by
record. A header line that cannot be read, a length beyond the file's end or
compression that breaks off ends that file with a row of type ``error``, after
the records before it; later files are still read. No
pages, no files, no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The header lines that ARC version blocks declare.
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
PAGE_ID = re.compile(rb"\r\nX-Page-Id: (-?\d{1,18})\r\n")
RECORDS_PER_FILE = 2000
#: Bytes after which an ARC file ends, or a batch of rows.
FILE_BYTES = 48_000_000
#: Repeated payloads up to this number are announced to all tasks; beyond it the commonest are, and the other records are dealt by digest.
ANNOUNCED = 100_000
#: What a Spark job adds to the names of the files that it writes.
_WRITER = re.compile(r"-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}-c")
RECORD = "record_id string, warc_type string, target_uri string, warc_date string, ip string, content_type string, page_id long, payload_bytes long, payload_digest string, block_digest string, header_bytes int, block binary"
READ = "record_id string, warc_type string, target_uri string, warc_date string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, payload binary, error string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _word(text: str | None) -> str:
    if not text:
        return "urn:null" if text is None else "urn:empty"
    return re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), text)


def _number(text: str) -> int | None:
    """A length of plain digits; null for anything else."""
    return int(text) if text.isascii() and text.isdigit() and len(text) <= 18 else None


def http_block(payload: bytes, page_id: int | None) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_file(name: str, version: int, date: str, records: list[tuple[str, bytes]]) -> bytes:
    """One ARC file of (url, block) records."""
    about = f"{version} 0 helpbooks\n{V1_FIELDS if version == 1 else V2_FIELDS}\n".encode()
    out = bytearray()

    def put(url: str, kind: str, block: bytes) -> None:
        middle = "" if version == 1 else f"200 - - {len(out)} {name} "
        out.extend(f"{url} 0.0.0.0 {date} {kind} {middle}{len(block)}\n".encode() + block + b"\n")

    put(f"filedesc://{name}", "text/plain", about)
    for url, block in records:
        put(url, "text/html", block)
    return bytes(out)


def arc_archives(pages: DataFrame, date: str = "20000101000000", page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(archive, content): pages as ARC files of version 1 or 2 by their content, cut by records and bytes.

    Names hold partition and number, so that equal files differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        rows, held = [], 0

        def file() -> pa.RecordBatch:
            content = hashlib.sha1(b"".join(hashlib.sha1(u.encode() + b).digest() for u, b in rows)).hexdigest()[:20]
            name = f"{content}-{task}-{number}"
            return pa.RecordBatch.from_arrays([pa.array([f"{name}.arc"]), pa.array([arc_file(name, 1 + int(content, 16) % 2, date, rows)], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for i, u, h in zip(*batch.columns, strict=True):
                rows.append((_word(u.as_py()), http_block(h.as_py(), i.as_py())))
                held += len(rows[-1][1])
                if len(rows) == RECORDS_PER_FILE or held >= FILE_BYTES:
                    yield file()
                    rows, held, number = [], 0, number + 1
        if rows:
            yield file()

    common.small_batches(pages.sparkSession)
    return pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), common.text_bytes(html).alias("html")).mapInArrow(run, "archive string, content binary")


def write_arc(archives: DataFrame, path: str) -> None:
    """Each archive as a gzip-compressed ARC file below ``path``; its last line end is the writer's."""
    whole = F.substring("content", F.lit(1), F.octet_length("content") - 1).cast("string")
    archives.select(whole.alias("value")).write.option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _unpacked(content: bytes) -> tuple[bytes, str | None]:
    """A file's bytes without compression, as far as they go, and what stopped them."""
    if content[:2] != b"\x1f\x8b":
        return content, None
    file, out = gzip.GzipFile(fileobj=io.BytesIO(content)), []
    try:
        while part := file.read1(1 << 16):
            out.append(part)
    except (EOFError, OSError, zlib.error) as e:  # cut off or damaged
        return b"".join(out), str(e)
    return b"".join(out), None


def arc_records(archive: str, content: bytes) -> Iterator[tuple]:
    """The records of an ARC file, compressed or not, as rows of ``RECORD``."""
    data, stopped = _unpacked(content)
    name, failed, at = _WRITER.sub("-c", archive), False, 0
    for r in parse_arc(data):
        if r.get("version"):
            name = f"{r['url'].partition('//')[2]}#{name}"
        failed, at = r["error"] is not None, r["at"]
        yield warc_record(name, r | ({"error": stopped} if failed and stopped else {}))
    if stopped and not failed:
        yield warc_record(name, {"at": at + 1, "error": stopped})


def parse_arc(content: bytes) -> Iterator[dict]:
    """Records in file order: url, ip, date, type, block, at; or, last, an error."""
    at, fields = 0, None
    while at < len(content):
        if content[at : at + 1] in b"\r\n":
            at += 1
            continue
        stop = content.find(b"\n", at)
        parts = content[at : stop if stop >= 0 else len(content)].decode("utf-8", "replace").rstrip("\r").split(" ")
        n = fields or (5 if len(parts) == 5 else 10)
        length = _number(parts[-1])
        if stop < 0 or len(parts) != n or length is None:
            yield {"at": at, "error": "header line"}
            return
        begin = stop + 1
        if begin + length > len(content):
            yield {"at": at, "error": "declared length"}
            return
        block = content[begin : begin + length]
        version = fields is None
        if version:  # the version block says which header lines follow
            lines = block.split(b"\n")
            fields = 10 if lines[0][:1] == b"2" else 5 if lines[0][:1] == b"1" else 0
            if not parts[0].startswith("filedesc:") or not fields or len(lines) < 2 or len(lines[1].split()) != fields:
                yield {"at": at, "error": "version block"}
                return
        yield {"at": at, "url": parts[0], "ip": parts[1], "date": parts[2], "type": parts[3], "block": block, "version": version, "error": None}
        at = begin + length


def iso_date(date: str) -> str | None:
    """14 digits, or fewer that are filled up, as an ISO timestamp; else null."""
    if not re.fullmatch(r"[0-9]{4}([0-9]{2}){0,5}", date):
        return None
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(archive: str, r: dict) -> tuple:
    """One parsed ARC record as a row of ``RECORD``."""
    record_id = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{r["at"]}')}>"
    if r["error"]:
        return (record_id, "error", None, None, None, r["error"], None, None, None, None, None, None)
    block, kind, header, page = r["block"], "resource", 0, None
    if r["version"]:
        kind = "warcinfo"
    elif block.startswith(b"HTTP/"):
        kind, cut = "response", block.find(b"\r\n\r\n")
        header = cut + 4 if cut >= 0 else len(block)
        m = re.search(PAGE_ID, block[:header])
        page = int(m[1]) if m else None
    payload = block[header:]
    types = {"warcinfo": "application/warc-fields", "response": "application/http;msgtype=response"}
    return (record_id, kind, r["url"], iso_date(r["date"]), r["ip"], types.get(kind, r["type"]), page, len(payload), digest(payload), digest(block), header, block)


def _rows(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)], names=list(names))


def _packed(rows: Iterator[tuple], schema: str, size: int = 256) -> Iterator[pa.RecordBatch]:
    out, held = [], 0
    for r in rows:
        out.append(r)
        held += sum(len(x) for x in r if isinstance(x, bytes))
        if len(out) == size or held >= FILE_BYTES:
            yield _rows(out, schema)
            out, held = [], 0
    yield _rows(out, schema)


def convert(archives: DataFrame, block: bool = True) -> DataFrame:
    """WARC records (``RECORD``) of ARC files given as (archive, content) rows; without ``block`` all but the bytes."""
    schema = RECORD if block else RECORD.removesuffix(", block binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for a, c in zip(*b.columns, strict=True) for r in arc_records(a.as_py() or "", c.as_py() or b""))
        yield from _packed(rows if block else (r[:-1] for r in rows), schema)

    return archives.select("archive", "content").mapInArrow(run, schema)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(archive, content) of the ARC files below a folder, named by their files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.substring_index("path", "/", -1).alias("archive"), "content")


def _eligible(min_payload: int) -> Column:
    return (F.col("warc_type") == "response") & (F.col("payload_bytes") >= min_payload)


def repeated(records: DataFrame, min_payload: int = 0) -> DataFrame:
    """(digest, kept): for each payload of at least ``min_payload`` bytes that several responses have, the record id of the one with the largest page id.

    Only digests are grouped, with partial sums, so a payload that a third of all records share is one row per task.
    """
    best = F.max(F.struct(F.coalesce("page_id", F.lit(-(2**63))), "record_id"))["record_id"].alias("kept")
    return records.filter(_eligible(min_payload)).groupBy(F.col("payload_digest").alias("digest")).agg(best, F.count("*").alias("n")).filter("n > 1").select("digest", "kept", "n")


def mark_revisits(records: DataFrame, again: DataFrame, min_payload: int = 0) -> DataFrame:
    """``records`` plus ``refers_to_id``: of the payloads in ``again``, a table of ``repeated``, all responses but one become revisits without payload."""
    n, rows = again.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    own = F.when(_eligible(min_payload), F.col("payload_digest"))
    if n <= ANNOUNCED:
        joined = records.withColumn("digest", own).join(F.broadcast(again), "digest", "left")
    else:  # a record without a digest of its own is dealt by its id
        joined = common.looked_up(records.withColumn("digest", F.coalesce(own, "record_id")), again, "digest", rows, how="left")
    revisit = F.col("kept").isNotNull() & (F.col("kept") != F.col("record_id"))
    changed = {"warc_type": F.when(revisit, "revisit").otherwise(F.col("warc_type")), "refers_to_id": F.when(revisit, F.col("kept")), "block": F.when(revisit, F.substring("block", F.lit(1), F.col("header_bytes"))).otherwise(F.col("block"))}
    return joined.withColumns(changed).drop("digest", "kept", "n")


def warc_member(r: dict) -> bytes:
    """A record (a row of ``RECORD`` with ``refers_to_id``) as a gzip member that ends in a zero byte."""
    revisit = r["warc_type"] == "revisit"
    lines = {
        "WARC-Type": r["warc_type"], "WARC-Record-ID": r["record_id"], "WARC-Date": r["warc_date"], "WARC-Target-URI": r["target_uri"], "WARC-IP-Address": r["ip"],
        "WARC-Payload-Digest": f"sha1:{r['payload_digest']}", "WARC-Block-Digest": None if revisit else f"sha1:{r['block_digest']}", "WARC-Refers-To": r["refers_to_id"],
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None, "Content-Type": r["content_type"], "Content-Length": len(r["block"]),
    }
    head = "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None)
    out = gzip.compress(f"WARC/1.1\r\n{head}\r\n".encode() + r["block"] + b"\r\n\r\n", 4, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", mtime=0)  # a record of 16 MB or more; an empty member says nothing


def write_warc(records: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """WARC files below ``path``, a gzip member a record; error rows are not written.

    The text writer must end each value; it ends it with the zero byte that is a member's last.
    """
    names = [*(x.split()[0] for x in RECORD.split(", ")), "refers_to_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((warc_member(dict(zip(names, (x.as_py() for x in r), strict=True)))[:-1],) for b in batches for r in zip(*b.columns, strict=True))
        yield from _packed(rows, "value binary")

    packed = records.filter("warc_type != 'error'").select(*names).mapInArrow(run, "value binary")
    packed.select(F.col("value").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(file: BinaryIO) -> Iterator[tuple]:
    """Rows of ``READ`` of a WARC file, one record in memory at a time."""
    number = 0
    while first := file.readline():
        if first == b"\r\n":
            continue
        number += 1
        field = {}
        while (line := file.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            field[k.lower()] = v.strip()
        length = _number(field.get("content-length", ""))
        block = file.read(length) if length is not None else b""
        if not line or not first.startswith(b"WARC/") or len(block) != length:
            yield (None, "error", None, None, None, None, None, None, None, f"record {number}")
            return
        cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
        payload = block[cut:]
        m = re.search(PAGE_ID, block[:cut])
        kind, said = field.get("warc-type"), field.get("warc-payload-digest", "").removeprefix("sha1:")
        own = None if kind == "revisit" else digest(payload)
        yield (field.get("warc-record-id"), kind, field.get("warc-target-uri"), field.get("warc-date"), int(m[1]) if m else None, None if own is None else len(payload), own or said, field.get("warc-refers-to"), None if own is None else payload, None if own in (None, said) else "payload digest")


def opened(content: bytes) -> BinaryIO:
    """A file's bytes, gzip members or plain, to be read bit by bit."""
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def _records(content: bytes) -> Iterator[tuple]:
    try:
        yield from parse_warc(opened(content))
    except (EOFError, OSError, zlib.error) as e:  # cut off or damaged
        yield (None, "error", None, None, None, None, None, None, None, str(e))


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the WARC files below a folder; without ``payload`` the bytes themselves are left out."""
    schema = READ if payload else READ.replace("payload binary, ", "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for c in b.column(0) for r in _records(c.as_py()))
        yield from _packed(rows if payload else (r[:8] + r[9:] for r in rows), schema)

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(run, schema)


def convert_files(spark: SparkSession, arc: str, warc: str, min_payload: int = 0) -> None:
    """The ARC files below ``arc`` as WARC files below ``warc``. The files are read twice, so that no payload is shuffled: once for digests, once to be written."""
    archives = read_arc(spark, arc)
    again = common.cut(repeated(convert(archives, block=False), min_payload))
    write_warc(mark_revisits(convert(archives), again, min_payload), warc)


def round_trip(pages: DataFrame, folder: str, min_payload: int = 0) -> DataFrame:
    """Pages to ARC files below ``folder``, to WARC files there, and back: a row per page."""
    spark = pages.sparkSession
    write_arc(arc_archives(pages), f"{folder}/arc")
    convert_files(spark, f"{folder}/arc", f"{folder}/warc", min_payload)
    back = common.cut(read_warc(spark, f"{folder}/warc", payload=False).filter("warc_type in ('response', 'revisit', 'error')"))
    again = back.filter("refers_to_id is not null")
    asked = again.groupBy(F.col("refers_to_id").alias("kept_id")).agg(F.count("*").alias("n"))
    kept = back.filter("warc_type = 'response'").select(F.col("record_id").alias("kept_id"), F.col("page_id").alias("kept_page"), F.col("payload_bytes").alias("kept_bytes")).join(asked, "kept_id")
    revisits = common.looked_up(again.withColumn("kept_id", F.col("refers_to_id")), kept, "kept_id", back.count(), how="left")
    none = F.lit(None).cast("long")
    out = back.filter("refers_to_id is null").withColumns({"kept_page": none, "kept_bytes": none}).unionByName(revisits.drop("kept_id", "n"))
    return out.select("page_id", F.coalesce("payload_bytes", "kept_bytes").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), F.col("kept_page").alias("refers_to"), "record_id", "target_uri", "warc_date", "error")
