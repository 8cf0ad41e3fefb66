"""Operator 5: a converter from legacy ARC archives to WARC.

ARC files are gzip members, mostly one record each, or not packed: a header line whose fields depend on the version that the
``filedesc`` record states (1: url, ip, date, type, length; 2: also result code, checksum, location, offset, file
name), then as many bytes as the line declares. The converter synthesises WARC headers: identifiers from the archive's name and
the record's offset, ISO timestamps, types (warcinfo, response, resource, revisit) and digests. Of records with equal
payloads of at least ``min_revisit`` bytes one is the response, that with the largest page id; the others become
revisits that refer to it.

A first pass makes an index (archive, offset, page id, digest) of the records that can have copies; copies are found in the index alone, so payloads are never
exchanged, and an archive's revisits go to its conversion as one list. Archives are read as streams, record by record, so a task holds one record, however they are packed.

The fields of a header line are cut from the right, so URLs may hold spaces. Records that can't be read are errors, or, where ``strict`` is False, rows with a status and without a body:
"no length", "too few fields", "no version", "cut off" (fewer bytes than declared) or "broken gzip" (nothing after it in the file is read). After one, the reader goes on at the next member of a packed file, in one that isn't packed at
the next line that ends like a header (a date of 14 digits and a length).

Archives are written below the shared folder, through pyarrow's file systems, under names that hold the task attempt's number; the
manifest, a table that Spark commits, names those of the attempts that count. Readers go by the manifest, so files left by lost executors are never read; a
folder without one (archives from elsewhere) is listed. An archive is closed at ``ARCHIVE`` bytes of payload or ``RECORDS`` records.

Defined results: null html is an empty payload; a null url is ``-``; rows with a null page id are never referred to;
rows that share the largest page id of a group of copies are all responses; repeated rows are records of their own; payloads of any length are one record;
an empty table gives no archives; extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import uuid
import zlib
from urllib.parse import quote, unquote_to_bytes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Bytes of payload and records after which an archive is closed; zlib level; bytes read at a time; bytes of rows handed over at a time.
ARCHIVE, RECORDS, LEVEL, PIECE, HANDED = 64 << 20, 50_000, 1, 1 << 16, 4 << 20
MIN_REVISIT, LINE = 1000, 1 << 20
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
#: Printable ASCII without white space and %, which needs quoting for the way back.
SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def _fs(path: str):
    from pyarrow import fs

    path = re.sub("^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


def member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(source):
    """(offset, data) of each gzip member of bytes or of a stream."""
    f = io.BytesIO(source) if isinstance(source, bytes) else source
    left, at = b"", 0
    while left := left or f.read(PIECE):
        z, data, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not left and not (left := f.read(PIECE)):
                raise ValueError(f"the member at {at} is cut off")
            data.append(z.decompress(left))
            used += len(left)
            left = z.unused_data
        used -= len(left)
        yield at, b"".join(data)
        at += used


class _Archive:
    """One file, in sight when it is whole. Its name for records is ``name``; on disk it has the attempt's number, too."""

    def __init__(self, folder: str, name: str):
        from pyspark import TaskContext

        stem, kind = name.split(".", 1)
        self.name, self.file = name, f"{stem}-a{TaskContext.get().taskAttemptId()}.{kind}"
        self.fs, self.path = _fs(f"{folder}/{self.file}")
        self.payload = self.records = self.at = 0
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = f"{self.path.rsplit('/', 1)[0]}/_{self.file}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.part, compression=None)

    def add(self, data: bytes, payload: int = 0) -> None:
        packed = member(data)
        self.out.write(packed)
        self.at += len(packed)
        self.payload += payload
        self.records += 1

    def full(self) -> bool:
        return self.payload >= ARCHIVE or self.records >= RECORDS

    def close(self) -> tuple[str, str, int, int]:
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.name, self.file, self.records, self.at


def _wrote(done) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[j] for d in done], t) for j, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["archive", "file", "records", "bytes"])


WROTE = "archive string, file string, records long, bytes long"
MANIFEST = "manifest"


def _committed(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    manifest.write.parquet(f"{folder}/{MANIFEST}")
    return spark.read.schema(WROTE).parquet(f"{folder}/{MANIFEST}")


def archives(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """(archive, path) of a folder's archives, dealt out to a task each (up to 50,000 tasks)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        found = spark.read.schema(WROTE).parquet(f"{folder}/{MANIFEST}").select("archive", F.concat(F.lit(folder + "/"), "file").alias("path"))
    else:
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{kind}.gz,{kind}}}").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "path")
    return found.repartition(max(1, min(found.count(), 50_000)))


def _rows(paths, read, schema: str, weight=lambda row: 200):
    """Batches of read(archive, stream)'s rows, over all archives."""
    rows, size = [], 0
    for name, path in paths:
        fs, at = _fs(path)
        with fs.open_input_stream(at, compression=None) as f:
            for row in read(name, f):
                rows.append(row)
                size += weight(row)
                if size > HANDED:
                    yield _batch(rows, schema)
                    rows, size = [], 0
    yield _batch(rows, schema)


def _paths(batches):
    for b in batches:
        yield from zip(b.column("archive").to_pylist(), b.column("path").to_pylist(), strict=True)


# -- ARC


def arc_header(version: int, name: str) -> bytes:
    lines = f"{version} 0 tokenloom\n{FIELDS[version]}\n\n".encode()
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 20240101000000 text/plain{extra} {len(lines)}\n".encode() + lines


def arc_record(version: int, name: str, offset: int, url: str | None, date: str, mime: str, body: bytes) -> bytes:
    u = "-" if url is None else "%2D" if url == "-" else quote(url, safe=SAFE) or "%"
    extra = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{u} 0.0.0.0 {date} {mime}{extra} {len(body)}\n".encode() + body + b"\n"


def write_arc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes pages as ARC files, version 1 and 2 by turns; returns the manifest."""
    spark = pages.sparkSession
    shared.text_batches(spark)
    source = pages.select(pages[page_id].cast("long").alias("id"), pages[url].alias("url"), pages[html].alias("html"))

    def run(batches):
        from pyspark import TaskContext

        part, done, arc, version = TaskContext.get().partitionId(), [], None, 1
        for b in shared.small(batches):
            for i, u, h in zip(*(b.column(c).to_pylist() for c in ("id", "url", "html")), strict=True):
                if arc is None:
                    version = 1 + (part + len(done)) % 2
                    arc = _Archive(folder, f"part-{part:06d}-{len(done):05d}.arc.gz")
                    arc.add(arc_header(version, arc.name))
                payload = (h or "").encode("utf-8", "surrogatepass")
                http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {i}\r\n" if i is not None else "") + f"Content-Length: {len(payload)}\r\n\r\n"
                arc.add(arc_record(version, arc.name, arc.at, u, "20240101000000", "text/html", http.encode() + payload), len(payload))
                if arc.full():
                    done.append(arc.close())
                    arc = None
        if arc:
            done.append(arc.close())
        yield _wrote(done)

    return _committed(spark, source.mapInArrow(run, WROTE), folder)


class _Unpacked:
    """The bytes of an ARC file (a stream), gzip members or not, a piece at a time; ``at``: how many were given out or passed over."""

    def __init__(self, f):
        self.f, self.at, self.buffer = f, 0, b""
        self.raw = f.read(PIECE)
        self.z = zlib.decompressobj(31) if self.raw[:2] == b"\x1f\x8b" else None
        self.packed = self.z is not None

    def more(self) -> bool:
        """Another piece into the buffer; False at the end of a member, or of a file that isn't packed."""
        if not self.packed:
            piece, self.raw = self.raw or self.f.read(PIECE), b""
            self.buffer += piece
            return bool(piece)
        while not self.z.eof:
            self.raw = self.raw or self.f.read(PIECE)
            if not self.raw:
                raise zlib.error("cut off")
            piece = self.z.decompress(self.raw, PIECE)
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if piece:
                self.buffer += piece
                return True
        return False

    def member(self) -> bool:
        """Passes over what is left of a member; False after the last."""
        while self.buffer or self.more():
            self.at += len(self.buffer)
            self.buffer = b""
        self.raw = self.raw or self.f.read(PIECE)
        if not self.packed or not self.raw.strip(b"\0"):
            return False
        self.z = zlib.decompressobj(31)
        return True

    def take(self, n: int) -> bytes:
        """n bytes, or what a member has."""
        pieces = []
        while n and (self.buffer or self.more()):
            piece, self.buffer = self.buffer[:n], self.buffer[n:]
            pieces.append(piece)
            n -= len(piece)
        data = b"".join(pieces)
        self.at += len(data)
        return data

    def line(self) -> bytes | None:
        """Up to a line feed, without it; None at a member's end. Of a line of more than LINE bytes, which is no header, the start and a mark."""
        line, end = None, -1
        while end < 0 and (self.buffer or self.more()):
            end = self.buffer.find(b"\n")
            piece = self.take(end + 1 if end >= 0 else len(self.buffer))
            if line is None or len(line) <= LINE:
                line = (line or b"") + piece
        return line if line is None else line[:80] + b" ..." if len(line) > LINE else line.removesuffix(b"\n")


HEADER_END = re.compile(rb" \d{14} (?:\S+ )+\d+$")


def parse_arc(name: str, content, strict: bool = True):
    """The records of an ARC file (bytes or a stream): dicts by field, with offset (where the header begins in the unpacked file), body and status; the declared length decides where a record ends."""
    source, fields = _Unpacked(io.BytesIO(content) if isinstance(content, bytes) else content), []

    def bad(at, status, url=None, more=""):
        if strict:
            raise ValueError(f"{name}: the record at {at}: {status}{more}")
        return {"URL": url, "IP-address": None, "Archive-date": None, "Content-type": None, "offset": at, "body": None, "status": status}

    try:
        lost = False  # in a file that isn't packed, after a record that can't be read
        while True:
            at = source.at
            line = source.line()
            if line is None:
                if not source.member():
                    return
                lost = False
                continue
            if not line.strip(b"\r") or lost and not HEADER_END.search(line):
                continue
            lost, problem, body, length = False, None, None, line.rsplit(b" ", 1)[-1].strip(b"\r")
            named = line.strip(b"\r").decode("utf-8", "replace")
            if not length.isdigit():
                problem = "no length"
            elif named.startswith("filedesc://"):
                body = source.take(int(length))
                version = body.split(b" ", 1)[0]
                if len(body) < int(length):
                    problem = "cut off"
                elif not version.isdigit() or int(version) not in FIELDS:
                    problem = "no version"
                else:
                    fields = FIELDS[int(version)].split()
                    url, ip, date, mime = (named.split(" ") + [""] * 4)[:4]
                    yield {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": mime, "offset": at, "body": body, "status": "ok"}
                    continue
            elif not fields:
                problem = "no version"
            elif len(parts := named.rsplit(" ", len(fields) - 1)) < len(fields):
                problem = "too few fields"
            else:
                body = source.take(int(length))
                if len(body) == int(length):
                    yield dict(zip(fields, parts, strict=True)) | {"offset": at, "body": body, "status": "ok"}
                    continue
                problem = "cut off"
            yield bad(at, problem, named.split(" ", 1)[0], f", declares {int(length)} bytes and has {len(body)}" if problem == "cut off" else "")
            if not source.packed:
                lost = True
            elif not source.member():
                return
    except zlib.error:
        yield bad(source.at, "broken gzip")


def _url(field: str) -> str | None:
    return None if field == "-" else "" if field == "%" else unquote_to_bytes(field).decode("utf-8", "replace")


def _parsed(name: str, content, strict: bool = True):
    """The records of an ARC file: dicts with what the converter needs; file descriptions have no HTTP header, records that can't be read no payload."""
    for r in parse_arc(name, content, strict):
        if r["status"] != "ok":
            yield dict.fromkeys(("archive", "offset", "url", "ip", "date", "mime", "page_id", "http", "payload")) | {"archive": name, "offset": r["offset"], "url": r["URL"], "status": r["status"]}
            continue
        http, gap, payload = r["body"].partition(b"\r\n\r\n") if r["body"].startswith(b"HTTP/") else (None, b"", r["body"])
        own = re.search(rb"(?im)^X-Page-Id: (-?\d+)", http or b"")
        yield {"archive": name, "offset": r["offset"], "url": _url(r["URL"]), "ip": r["IP-address"], "date": r["Archive-date"], "mime": r["Content-type"], "page_id": int(own[1]) if own else None, "http": http and http + gap, "payload": payload, "status": "ok"}


PARSED = "archive string, offset long, url string, ip string, date string, mime string, page_id long, http binary, payload binary, status string"
INDEX = "archive string, offset long, page_id long, digest binary"


def read_arc(spark: SparkSession, folder: str, strict: bool = True) -> DataFrame:
    """One row per record of a folder's ARC files; strict: False gives records that can't be read a status instead of an error."""
    read = lambda name, f: (tuple(r.values()) for r in _parsed(name, f, strict))
    return archives(spark, folder, "arc").mapInArrow(lambda batches: _rows(_paths(batches), read, PARSED, lambda r: 500 + len(r[-2] or b"")), PARSED)


def index_arc(spark: SparkSession, folder: str, least: int, strict: bool = True) -> DataFrame:
    """(archive, offset, page_id, digest) of the responses with payloads of at least that many bytes."""

    def read(name, f):
        for r in _parsed(name, f, strict):
            if r["http"] is not None and len(r["payload"]) >= least:
                yield name, r["offset"], r["page_id"], hashlib.sha1(r["payload"]).digest()

    return archives(spark, folder, "arc").mapInArrow(lambda batches: _rows(_paths(batches), read, INDEX), INDEX)


KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    named = [c.split(" ") for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], KINDS[t]) for j, (_, t) in enumerate(named)], names=[n for n, _ in named])


# -- WARC


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'arc:{archive}#{offset}')}>"


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("WARC-Block-Digest", base32(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _iso(date: str) -> str:
    d = re.sub(r"\D", "", date).ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert_record(r: dict) -> bytes:
    """The WARC record of one ARC record; ``refers_to`` (page id), with ``refers_archive`` and ``refers_offset``, makes it a revisit."""
    digest = base32(hashlib.sha1(r["payload"]).digest())
    fields = [("WARC-Record-ID", record_id(r["archive"], r["offset"])), ("WARC-Date", _iso(r["date"]))]
    if (r["url"] or "").startswith("filedesc://"):
        return warc_record([("WARC-Type", "warcinfo"), *fields, ("Content-Type", "application/warc-fields"), ("WARC-Filename", r["archive"])], b"software: tokenloom\r\nformat: WARC File Format 1.1\r\n")
    uri = [] if r["url"] is None else [("WARC-Target-URI", quote(r["url"], safe=SAFE))]
    own = [] if r["page_id"] is None else [("X-Page-Id", str(r["page_id"]))]
    fields += uri + own + [("WARC-IP-Address", r["ip"]), ("WARC-Payload-Digest", digest), ("X-Payload-Length", str(len(r["payload"])))]
    if r["http"] is None:
        return warc_record([("WARC-Type", "resource"), *fields, ("Content-Type", r["mime"])], r["payload"])
    fields.append(("Content-Type", "application/http; msgtype=response"))
    if r.get("refers_to") is None:
        return warc_record([("WARC-Type", "response"), *fields], r["http"] + r["payload"])
    to = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(r["refers_archive"], r["refers_offset"])), ("X-Refers-To-Page-Id", str(r["refers_to"]))]
    return warc_record([("WARC-Type", "revisit"), *fields, *to], r["http"])


def convert(spark: SparkSession, arc: str, warc: str, min_revisit: int = MIN_REVISIT, strict: bool = True) -> DataFrame:
    """Converts all ARC files of a folder, each to a WARC file; returns the manifest of those. strict: False leaves out records that can't be read, which ``read_arc`` lists."""
    index = shared.written(index_arc(spark, arc, min_revisit, strict), "arc-index")
    # the response of each payload that occurs more than once; counts are summed before the exchange
    first = index.groupBy("digest").agg(F.max(F.struct("page_id", "archive", "offset")).alias("of"), F.count("*").alias("n")).where("n > 1 AND of.page_id IS NOT NULL").select("digest", "of")
    others = index.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("of.page_id")))
    row = F.struct("offset", F.col("of.page_id").alias("refers_to"), F.col("of.archive").alias("refers_archive"), F.col("of.offset").alias("refers_offset"))
    revisits = shared.written(others.groupBy("archive").agg(F.collect_list(row).alias("revisits")), "arc-revisits")  # at most RECORDS of an archive of ours
    files = archives(spark, arc, "arc")
    plan = files.join(revisits, "archive", "left").repartition(files.rdd.getNumPartitions())

    def run(batches):
        done = []
        for b in batches:
            for name, path, revisits in zip(*(b.column(c).to_pylist() for c in ("archive", "path", "revisits")), strict=True):
                refers = {r.pop("offset"): r for r in revisits or ()}
                fs, at = _fs(path)
                out = _Archive(warc, name.removesuffix(".arc.gz") + ".warc.gz")
                with fs.open_input_stream(at, compression=None) as f:
                    for r in _parsed(name, f, strict):
                        if r["status"] != "ok":
                            continue
                        out.add(convert_record(r | refers.get(r["offset"], {})), len(r["payload"]))
                done.append(out.close())
        yield _wrote(done)

    manifest = _committed(spark, plan.mapInArrow(run, WROTE), warc)
    shared.drop(index, revisits)
    return manifest


READ = "archive string, offset long, record_type string, record_id string, date string, url string, page_id long, payload_bytes long, payload_digest string, refers_to_id string, refers_to long, payload binary"


def parse_warc(content):
    """(offset, fields, block) of each record of bytes or a stream."""
    for offset, data in members(content):
        head, _, rest = data.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at {offset}")
        fields = dict(x.split(": ", 1) for x in lines)
        block = rest[: int(fields["Content-Length"])]
        if base32(hashlib.sha1(block).digest()) != fields["WARC-Block-Digest"]:
            raise ValueError(f"the block at {offset} doesn't match its digest")
        yield offset, fields, block


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of the archives of a folder; digests are recomputed for records that hold their payload."""

    def read(name, stream):
        for offset, f, block in parse_warc(stream):
            kind = f["WARC-Type"]
            size = digest = payload = None
            if kind in ("response", "resource"):
                payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else block
                digest, size = hashlib.sha1(payload), len(payload)
                if base32(digest.digest()) != f["WARC-Payload-Digest"]:
                    raise ValueError(f"{name}: the payload at {offset} doesn't match its digest")
                digest = digest.hexdigest()
            elif kind == "revisit":
                digest, size = base64.b32decode(f["WARC-Payload-Digest"][5:]).hex(), int(f["X-Payload-Length"])
            number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
            uri = unquote_to_bytes(f["WARC-Target-URI"]).decode() if "WARC-Target-URI" in f else None
            yield name, offset, kind, f["WARC-Record-ID"], f["WARC-Date"], uri, number("X-Page-Id"), size, digest, f.get("WARC-Refers-To"), number("X-Refers-To-Page-Id"), payload if payloads else None

    return archives(spark, folder, "warc").mapInArrow(lambda batches: _rows(_paths(batches), read, READ, lambda r: 500 + len(r[-1] or b"")), READ)


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT, keep_arc: bool = False) -> str:
    """pages through ARC files into WARC files; returns the folder of the latter. The ARC files go, unless kept."""
    spark = pages.sparkSession
    arc, warc = shared.fresh(spark, "arc"), shared.fresh(spark, "warc")
    write_arc(pages, arc, page_id, url, html)
    convert(spark, arc, warc, min_revisit)
    if not keep_arc:
        shared.delete(spark, arc)
    return warc
