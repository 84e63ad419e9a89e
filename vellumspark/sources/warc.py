"""Web archive files as a data source: a row for each kept record, one partition for each file.

    spark.dataSource.register(WarcDataSource)
    spark.read.format("warc").option("path", folder_or_file).load()

Plain and per-record gzip files are read a record at a time; offsets and lengths are those of the
stored record, so that it can be read again alone. Strict framing: a broken record fails the
read unless ``mode`` is ``permissive``, which ends that file with the records before it.
"""

import gzip
import hashlib
import os
import shutil
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "filename string, offset long, length long, type string, url string, date string, status int, mime string, digest string, location string, entity binary"
MAX_RECORD = 512 << 20
BLOCK = 1 << 20
#: Bytes of a part that one task copies.
COPY_BYTES = 64 << 20
# Record types that an index keeps.
KEPT = {"response", "resource", "revisit"}


class WarcError(ValueError):
    """A file is not framed as it must be."""


def gzip_members(path: str, limit: int = MAX_RECORD, start: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(offset, stored length, bytes) of each member of a gzip file from a member's start on."""
    with open(path, "rb") as f:
        f.seek(start)
        data, offset = f.read(BLOCK), start
        while data:
            d, out, size, used = zlib.decompressobj(16 + zlib.MAX_WBITS), [], 0, 0
            while True:
                piece = d.decompress(data, limit + 1 - size)
                out.append(piece)
                size += len(piece)
                if size > limit:
                    raise WarcError(f"a record is over {limit} bytes")
                if d.eof:
                    used += len(data) - len(d.unused_data)
                    data = d.unused_data
                    break
                used += len(data) - len(d.unconsumed_tail)
                data = d.unconsumed_tail or f.read(BLOCK)
                if not data:
                    raise WarcError("a gzip member is cut short")
            yield offset, used, b"".join(out)
            offset += used
            data = data or f.read(BLOCK)


def header_end(data: bytes, start: int = 0) -> tuple[int, int]:
    """Where a header block ends and what follows it begins: an empty line, with or without CR."""
    at = data.find(b"\r\n\r\n", start)
    bare = data.find(b"\n\n", start, at if at >= 0 else len(data))  # no need to look through the payload
    if bare >= 0:
        return bare, bare + 2
    if at < 0:
        raise WarcError("a header has no end")
    return at, at + 4


def header_lines(block: bytes, strict: bool = True) -> dict[str, str]:
    """Names in lower case. Strictly a repeated name is an error, else the last one counts."""
    out = {}
    for line in block.replace(b"\r\n", b"\n").split(b"\n"):
        name, colon, value = line.decode("utf-8", "replace").partition(":")
        name = name.strip().lower()
        if not colon or not name:
            if strict:
                raise WarcError("a header line has no name")
            continue
        if strict and name in out:
            raise WarcError(f"header {name} is repeated")
        out[name] = value.strip()
    return out


def http_metadata(kind: str, headers: dict, block: bytes) -> tuple[int | None, str | None, str | None, bytes]:
    """status, mime, location and entity of a record's block."""
    if kind == "resource" or not headers.get("content-type", "").lower().startswith("application/http"):
        return None, headers.get("content-type", "").split(";")[0].strip().lower() or None, None, block
    try:
        end, body = header_end(block)
    except WarcError:
        return None, None, None, b""
    first, _, rest = block[:end].partition(b"\n")
    words = first.decode("latin-1").split()
    http = header_lines(rest, strict=False) if rest else {}
    status = int(words[1]) if len(words) > 1 and words[1].isdigit() else None
    return status, http.get("content-type", "").split(";")[0].strip().lower() or None, http.get("location"), block[body:]


def record(data: bytes, start: int = 0) -> tuple[dict, bytes, int]:
    """Headers, block and end of the record that begins at ``start``."""
    if not data.startswith(b"WARC/", start):
        raise WarcError("a record does not begin with its version")
    end, body = header_end(data, start)
    first = data.index(b"\n", start) + 1
    headers = header_lines(data[first:end])
    size = headers.get("content-length", "")
    if not size.isdigit():
        raise WarcError("a record has no Content-Length")
    stop = body + int(size)
    if stop > len(data):
        raise WarcError("a record is cut short")
    return headers, data[body:stop], stop


def rows_of(data: bytes, filename: str, offset: int, length: int | None) -> Iterator[tuple]:
    """Index rows of the records in ``data``; length None: of each record in a plain file."""
    at = 0
    while at < len(data):
        headers, block, stop = record(data, at)
        after = stop
        while after < len(data) and data[after] in b"\r\n":
            after += 1
        kind, url = headers.get("warc-type", ""), headers.get("warc-target-uri", "").strip("<>")
        if kind in KEPT and url.lower().startswith(("http://", "https://")):
            status, mime, location, entity = http_metadata(kind, headers, block)
            digest = headers.get("warc-payload-digest", "").lower() or "sha256:" + hashlib.sha256(entity).hexdigest()
            yield filename, offset + at if length is None else offset, after - at if length is None else length, kind, url, headers.get("warc-date"), status, mime, digest, location, entity
        at = after


def plain_records(path: str, limit: int = MAX_RECORD, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of each record of an uncompressed file from a record's start on, one at a time."""
    with open(path, "rb") as f:
        f.seek(start)
        offset, held = start, b""
        while True:
            while b"\r\n\r\n" not in held and b"\n\n" not in held:
                more = f.read(BLOCK)
                if not more:
                    break
                held += more
            if not held.strip():
                return
            end, body = header_end(held)
            headers = header_lines(held[held.index(b"\n") + 1 : end])
            size = int(headers.get("content-length", "0") or 0)
            if size > limit:
                raise WarcError(f"a record is over {limit} bytes")
            while len(held) < body + size + 4 and (more := f.read(max(BLOCK, body + size + 4 - len(held)))):
                held += more
            stop = min(body + size, len(held))
            while stop < len(held) and held[stop] in b"\r\n":
                stop += 1
            yield offset, held[:stop]
            offset, held = offset + stop, held[stop:]


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.permissive = options["path"], options.get("mode", "failfast").lower() == "permissive"
        self.prefix = int(options.get("prefixbytes", options.get("prefixBytes", "0")))

    def partitions(self):
        if os.path.isfile(self.path):
            return [_File(self.path)]
        return [_File(os.path.join(d, f)) for d, _, names in sorted(os.walk(self.path)) for f in sorted(names) if f.lower().endswith((".warc", ".warc.gz"))] or [_File("")]

    def read(self, part):
        if not part.path:
            return
        name = os.path.basename(part.path)
        try:
            if part.path.lower().endswith(".gz"):
                for offset, length, data in gzip_members(part.path):
                    if self.prefix and offset >= self.prefix:
                        return
                    yield from rows_of(data, name, offset, length)
            else:
                for offset, data in plain_records(part.path):
                    if self.prefix and offset >= self.prefix:
                        return
                    yield from rows_of(data, name, offset, len(data))
        except (WarcError, zlib.error, gzip.BadGzipFile):
            if not self.permissive:
                raise


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)


def read_at(path: str, offset: int, length: int) -> tuple:
    """The index row of exactly one record at (offset, length)."""
    with open(path, "rb") as f:
        f.seek(offset)
        return record_of(f.read(length), path, offset, length)


def record_of(data: bytes, path: str, offset: int, length: int) -> tuple:
    """The index row of the only record in stored bytes; the name tells whether they are packed."""
    if path.lower().endswith(".gz"):
        d = zlib.decompressobj(16 + zlib.MAX_WBITS)
        data = d.decompress(data, MAX_RECORD)
        if not d.eof or d.unused_data:
            raise WarcError("not exactly one gzip member")
    found = list(rows_of(data, os.path.basename(path), offset, length))
    if len(found) != 1:
        raise WarcError("not exactly one record")
    return found[0]


def record_bytes(url: str, date: str, status: int, mime: str, body: bytes, location: str | None = None, digest: str | None = None) -> bytes:
    """A response record with its HTTP header."""
    http = f"HTTP/1.1 {status} X\r\nContent-Type: {mime}\r\n" + (f"Location: {location}\r\n" if location else "") + "\r\n"
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nWARC-Date: {date}\r\n" + (f"WARC-Payload-Digest: {digest}\r\n" if digest else "")
    block = http.encode() + body
    return f"{head}Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def write_warcs(records: DataFrame, folder: str) -> DataFrame:
    """Write records (file, url, date, status, mime, location, digest, body) by file, in order of url and
    date; returns file and how many records it has. Files whose names end in .gz are packed a record at
    a time. A file is written by many tasks: each packs a range of records as a part, and the parts are copied to
    their places in a file that appears whole."""
    from vellumspark.operators.package_writer import placed

    spark, stage = records.sparkSession, os.path.join(folder, f".parts-{uuid.uuid4().hex}")

    def run(batches):
        part, at = TaskContext.get().partitionId(), os.path.join(stage, f"{TaskContext.get().partitionId():08d}-{TaskContext.get().taskAttemptId()}")
        held, out = None, None
        made = []
        for b in batches:
            for r in b.itertuples():
                if r.file != held:
                    if held is not None:
                        out.close()
                    held, out = r.file, open(f"{at}-{len(made)}", "wb")  # noqa: SIM115
                    made.append([part, held, 0, out.name, 0])
                data = record_bytes(r.url, r.date, int(r.status), r.mime, r.body, r.location, r.digest)
                made[-1][4] += out.write(gzip.compress(data, mtime=0) if held.lower().endswith(".gz") else data)
                made[-1][2] += 1
        if held is not None:
            out.close()
        yield pd.DataFrame(made, columns=["part", "file", "records", "path", "size"])

    os.makedirs(stage)
    os.chmod(stage, 0o777)
    order = ["file", "url", "date"]
    try:
        chosen = records.select(*order, "status", "mime", "location", "digest", "body").repartitionByRange(*order).sortWithinPartitions(*order)
        parts = chosen.mapInPandas(run, "part int, file string, records long, path string, size long").collect()  # a row for each part
        counts, ends, copies, whole = {}, {}, [], {}
        for r in sorted(parts, key=lambda r: r["part"]):
            name, size, to = r["file"], r["size"], ends.get(r["file"], 0)
            if name not in whole:
                whole[name] = os.path.join(stage, f"{len(whole)}.whole")
                with open(whole[name], "xb"):
                    os.chmod(whole[name], 0o666)
            copies += [(r["path"], k, min(COPY_BYTES, size - k), to + k, whole[name], None, False) for k in range(0, size, COPY_BYTES)]
            ends[name], counts[name] = to + size, counts.get(name, 0) + r["records"]
        placed(spark, copies)
        for name, temp in whole.items():
            os.replace(temp, os.path.join(folder, name))
    finally:
        shutil.rmtree(stage)
    return spark.createDataFrame(list(counts.items()), "file string, records long")
