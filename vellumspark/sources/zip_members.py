"""ZIP members as a data source, one row each, with the facts that safety checks need.

An archive is read by several tasks: each takes a run of its central directory with about ``partitionBytes``
packed bytes, and reads no other entries of it. The directory is streamed once to find where runs begin. With ``xml`` a member is parsed while it is read: whether it is well formed, the name of its
root and the root's xml:id; nothing of the document is kept, however large it is.

    spark.dataSource.register(ZipMembersDataSource)
    spark.read.format("zip_members").option("path", p).option("content", "true").load()

Members are read in blocks whatever their size: ``hash`` gives their digest, and ``content`` their bytes, of
members up to ``contentBytes`` if that is stated. What a corpus allows is for ``member_problems``.
"""

import hashlib
import io
import operator
import os
import stat
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from xml.parsers import expat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, ordinal int, name string, file_size long, compress_size long, crc long, is_dir boolean, is_symlink boolean, is_encrypted boolean, crc_ok boolean, sha256 string, content binary, xml_ok boolean, root string, root_id string"
BLOCK = 1 << 20
# What text collections allow of a member, an archive, its entries, and the ratio of sizes.
COLLECTION_LIMITS = {"member": 64 << 20, "total": 2 << 30, "entries": 10_000, "ratio": 200.0}


PARTITION_BYTES, RUN_BUFFER = 32 << 20, 1 << 17
#: An archive makes so many tasks; a task costs as much as reading a thousand small members.
MOST_RUNS = 1000
XML = "http://www.w3.org/XML/1998/namespace"


class XmlRoot:
    """Takes a document in blocks and keeps what its root element says."""

    def __init__(self):
        self.ok, self.root, self.root_id = None, None, None
        self.parser = expat.ParserCreate(namespace_separator="}")
        self.parser.StartElementHandler = self.start

    def start(self, tag: str, attrs: dict) -> None:
        self.root, self.root_id = "{" + tag if "}" in tag else tag, attrs.get(f"{XML}}}id")
        self.parser.StartElementHandler = None

    def feed(self, block: bytes, last: bool = False) -> None:
        if self.ok is None:
            try:
                self.parser.Parse(block, last)
            except expat.ExpatError:
                self.ok = False
            else:
                self.ok = True if last else None


# Signatures of the ZIP format, an entry of the directory up to its name, and its end records.
ENTRY, END64, LOCATOR, END = b"PK\x01\x02", b"PK\x06\x06", b"PK\x06\x07", b"PK\x05\x06"
FACTS, FULL, MANY = struct.Struct("<4s16xIIHHH8xI"), struct.Struct("<4sQHHIIQQQQ"), 0xFFFFFFFF
SHORT = struct.Struct("<4sHHHHIIH")


def placed_runs(entries: Iterable[tuple[int, int]], limit: int) -> list[tuple[int, int, int, int]]:
    """Runs of neighbours (place, size) with about ``limit`` in all, at least one run: the first, the one after the last,
    the place of the first and the place after the one that follows the run (0: none does)."""
    starts, after, total, k, second = [], [], limit + 1, -1, False
    for k, (place, n) in enumerate(entries):
        if second:
            after.append(place)
            second = False
        total += n
        if total > limit:
            starts.append((k, place))
            total, second = n, True
    starts = starts or [(0, 0)]
    ends, after = [*(first for first, _ in starts[1:]), k + 1], [*after[1:], 0, 0]
    return [(first, end, place, then) for (first, place), end, then in zip(starts, ends, after)]


def runs_of(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Runs of neighbours with about ``limit`` in all, at least one run."""
    return [run[:2] for run in placed_runs(((0, n) for n in sizes), limit)]


def directory_place(f) -> tuple[int, int, int]:
    """Where an archive's directory begins and ends, and how far offsets in it are from places in the file."""
    size = f.seek(0, os.SEEK_END)
    f.seek(max(0, size - (1 << 16) - SHORT.size - 20))
    tail = f.read()
    at = len(tail) - SHORT.size
    if at < 0 or tail[at : at + 4] != END or tail[-2:] != b"\0\0":
        at = tail.rfind(END)
    if at < 0 or len(tail) < at + SHORT.size:
        raise zipfile.BadZipFile("no end of a central directory")
    *_, length, offset, _ = SHORT.unpack_from(tail, at)
    end = size - len(tail) + at
    if at >= 20 and tail[at - 20 : at - 16] == LOCATOR:
        f.seek(end - 20 - FULL.size)
        full = f.read(FULL.size)
        if full[:4] == END64:
            *_, length, offset = FULL.unpack(full)
            end -= 20 + FULL.size
    if length > end:
        raise zipfile.BadZipFile("a central directory is cut short")
    return end - length, end, end - length - offset


def wide(extra: bytes, values: list[int]) -> list[int]:
    """Size, packed size and offset of an entry whose values of 32 bits may say that those of 64 bits count."""
    while len(extra) >= 4:
        kind, n = struct.unpack_from("<HH", extra)
        if kind == 1:
            rest = iter(struct.unpack_from(f"<{min(n, len(extra) - 4) // 8}Q", extra, 4))
            return [next(rest, v) if v == MANY else v for v in values]
        extra = extra[4 + n :]
    return values


def entries(f, start: int, end: int) -> Iterator[tuple[list[int], list[int], list[int]]]:
    """Places, packed sizes and offsets of a directory's entries, a block at a time."""
    f.seek(start)
    held, base, facts, fixed = b"", start, FACTS.unpack_from, FACTS.size
    while base < end:
        more = f.read(min(BLOCK, end - base - len(held)))
        if not more:
            raise zipfile.BadZipFile("a central directory is cut short")
        held += more
        at, places, sizes, offsets = 0, [], [], []
        while at + fixed <= len(held):
            sign, packed, size, n, m, k, offset = facts(held, at)
            if sign != ENTRY:
                raise zipfile.BadZipFile("an entry of a central directory has no signature")
            after = at + fixed + n + m + k
            if after > len(held):
                break
            if offset == MANY or packed == MANY:
                size, packed, offset = wide(held[at + fixed + n : at + fixed + n + m], [size, packed, offset])
            places.append(base + at)
            sizes.append(packed)
            offsets.append(offset)
            at = after
        held, base = held[at:], base + at
        yield places, sizes, offsets


class _Run(io.RawIOBase):
    """An archive whose directory is a run of its entries only."""

    def __init__(self, path: str, a: int, b: int):
        self.file, self.at = open(path, "rb"), 0  # noqa: SIM115
        self.start, _, shift = directory_place(self.file)
        self.file.seek(a)
        self.tail = self.file.read(b - a)
        self.tail += FULL.pack(END64, 44, 45, 45, 0, 0, 0, 0, len(self.tail), self.start - shift) + struct.pack("<4sIQI", LOCATOR, 0, self.start - shift + len(self.tail), 1) + SHORT.pack(END, 0, 0, 0xFFFF, 0xFFFF, MANY, MANY, 0)

    def readable(self):
        return True

    def seekable(self):
        return True

    def seek(self, n, whence=os.SEEK_SET):
        self.at = n + (0, self.at, self.start + len(self.tail))[whence]
        return self.at

    def readinto(self, out):
        if self.at < self.start:
            self.file.seek(self.at)
            data = self.file.read(min(len(out), self.start - self.at))
        else:
            data = self.tail[self.at - self.start :][: len(out)]
        out[: len(data)] = data
        self.at += len(data)
        return len(data)

    def close(self):
        self.file.close()
        super().close()


class _Archive(InputPartition):
    """A run of entries: the number of the first, how many, and between which places of the file they and the one behind
    them stand (which tells where the last member has to end); before: entries there that are another run's."""

    def __init__(self, path: str, first: int = 0, n: int = 0, a: int = 0, b: int = 0, before: int = 0):
        self.path, self.first, self.n, self.a, self.b, self.before = path, first, n, a, b, before


def runs(path: str, limit: int) -> list[_Archive]:
    """The runs of an archive's directory, ``MOST_RUNS`` or so at most. If its members don't stand in the directory's order, each run reads all of it."""
    with open(path, "rb") as f:
        start, end, _ = directory_place(f)
        last, ordered = -1, True

        def sizes():
            nonlocal last, ordered
            for places, packed, offsets in entries(f, start, end):
                ordered = ordered and last <= min(offsets, default=last) and all(map(operator.le, offsets, offsets[1:]))
                last = max(offsets, default=last)
                yield from zip(places, packed)

        found = placed_runs(sizes(), max(limit, start // MOST_RUNS))
    if not ordered:
        return [_Archive(path, first, to - first, start, end, first) for first, to, *_ in found]
    return [_Archive(path, first, to - first, a or start, b or end) for first, to, a, b in found]


class ZipReader(DataSourceReader):
    def __init__(self, options):
        chosen = lambda name: options.get(name, "false").lower() == "true"
        self.path, self.content, self.hash, self.xml = options["path"], chosen("content"), chosen("hash"), chosen("xml")
        self.limit = int(options.get("partitionbytes", options.get("partitionBytes", PARTITION_BYTES)))
        most = options.get("contentbytes", options.get("contentBytes"))
        self.most = int(most) if most else None

    def partitions(self):
        paths = [self.path] if os.path.isfile(self.path) else [os.path.join(d, f) for d, _, names in sorted(os.walk(self.path)) for f in sorted(names) if f.lower().endswith((".zip", ".wacz"))]
        out = []
        for p in paths:
            out += runs(p, self.limit)
        return out or [_Archive("")]

    def read(self, part):
        if not part.path:
            return
        with io.BufferedReader(_Run(part.path, part.a, part.b), RUN_BUFFER) as f, zipfile.ZipFile(f) as z:
            for i, m in enumerate(z.infolist()[part.before : part.before + part.n], part.first):
                link, locked = stat.S_ISLNK(m.external_attr >> 16), bool(m.flag_bits & 1)
                data, digest, ok, xml = [], hashlib.sha256(), None, XmlRoot()
                keep = self.content and (self.most is None or m.file_size <= self.most)
                parse = self.xml and m.filename.lower().endswith(".xml")
                if (keep or self.hash or parse) and not m.is_dir() and not link and not locked:
                    try:
                        with z.open(m) as f:
                            while block := f.read(BLOCK):
                                digest.update(block)
                                if keep:
                                    data.append(block)
                                if parse:
                                    xml.feed(block)
                        ok = True
                    except (zipfile.BadZipFile, OSError, zlib.error):
                        ok = False
                    if parse:
                        xml.feed(b"", last=True)
                about = (bool(xml.ok and ok), xml.root, xml.root_id) if parse and ok is not None else (None, None, None)
                yield os.path.basename(part.path), i, m.filename, m.file_size, m.compress_size, m.CRC, m.is_dir(), link, locked, ok, digest.hexdigest() if ok else None, b"".join(data) if ok and keep else None, *about


class ZipMembersDataSource(DataSource):
    @classmethod
    def name(cls):
        return "zip_members"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ZipReader(self.options)


def ratio(size: Column, packed: Column) -> Column:
    return size / F.nullif(packed, F.lit(0))


def member_problems(members: DataFrame, limits: dict | None = None) -> DataFrame:
    """archive, name and problem of unsafe members and archives. ``limits``: what may be no larger, by the
    names of ``COLLECTION_LIMITS``; nothing is too large without."""
    limits = limits or {}
    over = lambda column, name: column > limits[name] if name in limits else F.lit(False)
    from vellumspark.functions.urls import safe_archive_member

    rules = [
        (~safe_archive_member(F.col("name")), "unsafe path"), (F.col("is_symlink"), "symbolic link"), (F.col("is_encrypted"), "encrypted"),
        (over(F.col("file_size"), "member"), "too large"), (over(ratio(F.col("file_size"), F.col("compress_size")), "ratio"), "compression ratio"), (F.col("crc_ok") == F.lit(False), "checksum"),
    ]
    each = members.select("archive", "name", F.explode(F.array_compact(F.array(*[F.when(r, F.lit(p)) for r, p in rules]))).alias("problem"))
    twice = members.groupBy("archive", "name").count().where("count > 1").select("archive", "name", F.lit("duplicate").alias("problem"))
    totals = members.groupBy("archive").agg(F.sum("file_size").alias("bytes"), F.count("*").alias("n"))
    whole = totals.select("archive", F.lit(None).cast("string").alias("name"), F.explode(F.array_compact(F.array(F.when(over(F.col("bytes"), "total"), F.lit("total size")), F.when(over(F.col("n"), "entries"), F.lit("entry count"))))).alias("problem"))
    return each.unionByName(twice).unionByName(whole)
