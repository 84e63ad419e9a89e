"""Packages written by the cluster: bags, web archive collections as one ZIP file, and ZIP files of a table's rows.

Texts that are sorted (index, pages, manifest) are written as parts by the tasks that sort them. The sizes
of parts and archives give the place of everything in the package; then tasks copy runs of bytes to their
places in one file that is made beforehand, so a task that runs twice writes the same bytes, and
nothing but sizes, digests and the package's directory comes to the driver. What was written is read again
before the package appears under its name.
"""

import hashlib
import json
import os
import shutil
import struct
import uuid
import zlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.sources import files
from vellumspark.sources.shared import written

#: Bytes that one task copies.
RUN_BYTES = 64 << 20
# Of the ZIP format, with sizes of 64 bits throughout; dates are the earliest there are.
LOCAL, CENTRAL, END64, LOCATOR, END = 0x04034B50, 0x02014B50, 0x06064B50, 0x07064B50, 0x06054B50
VERSION, UTF8, DEFLATED, DATE, MANY = 45, 0x800, 8, 0x21, 0xFFFFFFFF


def write_parts(rows: DataFrame, column: str, folder: str) -> list[tuple[str, int]]:
    """Path and size of the files that hold a sorted table's lines (each with a line break), in order."""

    def run(batches):
        part, n = TaskContext.get().partitionId(), 0
        at = os.path.join(folder, f"part-{part:08d}")
        with open(f"{at}.{TaskContext.get().taskAttemptId()}", "wb") as f:
            for b in batches:
                n += f.write("".join(f"{x}\n" for x in b[column]).encode())
        os.replace(f.name, at)
        yield pd.DataFrame({"part": [part], "path": [at], "size": [n]})

    os.makedirs(folder)
    got = rows.select(column).mapInPandas(run, "part int, path string, size long").collect()  # a row for each partition
    return [(r["path"], r["size"]) for r in sorted(got, key=lambda r: r["part"]) if r["size"]]


def fingerprint(path: str) -> str:
    s = os.stat(path)
    return f"{s.st_ino}-{s.st_size}-{s.st_mtime_ns}"


def measured(spark: SparkSession, members: dict[str, list[str]]) -> dict[str, tuple]:
    """sha256, crc, size and fingerprints of each member, read from its parts in order, a task for each member."""

    def run(batches):
        for b in batches:
            out = []
            for name, paths in zip(b["name"], b["paths"]):
                h, crc, size, marks = hashlib.sha256(), 0, 0, [fingerprint(p) for p in paths]
                for p in paths:
                    with open(p, "rb") as f:
                        while block := f.read(files.BLOCK):
                            h.update(block)
                            crc, size = zlib.crc32(block, crc), size + len(block)
                if [fingerprint(p) for p in paths] != marks:
                    raise files.ListingError(f"{name} changed while it was read")
                out.append((name, h.hexdigest(), crc, size, list(marks)))
            yield pd.DataFrame(out, columns=["name", "sha256", "crc", "size", "marks"])

    rows = spark.createDataFrame(list(members.items()), "name string, paths array<string>").repartition(max(1, len(members)))
    got = rows.mapInPandas(run, "name string, sha256 string, crc long, size long, marks array<string>").collect()
    return {r["name"]: (r["sha256"], r["crc"], r["size"], r["marks"]) for r in got}


def local_header(name: str, crc: int, size: int) -> bytes:
    raw = name.encode()
    return struct.pack("<IHHHHHIIIHH", LOCAL, VERSION, UTF8, 0, 0, DATE, crc, MANY, MANY, len(raw), 20) + raw + struct.pack("<HHQQ", 1, 16, size, size)


def directory(entries: list[tuple[str, int, int, int]], at: int) -> bytes:
    """The central directory of members (name, crc, size, offset), and the end records behind it."""
    out = b""
    for name, crc, size, offset in entries:
        raw = name.encode()
        out += struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, VERSION, VERSION, UTF8, 0, 0, DATE, crc, MANY, MANY, len(raw), 28, 0, 0, 0, 0o644 << 16, MANY) + raw + struct.pack("<HHQQQ", 1, 24, size, size, offset)
    return out + end_records(len(entries), len(out), at)


def end_records(n: int, size: int, at: int) -> bytes:
    """What ends an archive whose directory has n entries and so many bytes from a place on."""
    out = struct.pack("<IQHHIIQQQQ", END64, 44, VERSION, VERSION, 0, 0, n, n, size, at) + struct.pack("<IIQI", LOCATOR, 0, at + size, 1)
    return out + struct.pack("<IHHHHIIH", END, 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), MANY, MANY, 0)


def copy_runs(spark: SparkSession, runs: list[tuple], dest: str) -> None:
    """Copy (source, mark, from, length, to) into a file that is there already."""

    def run(batches):
        for b in batches:
            with open(dest, "r+b") as out:
                for source, mark, start, length, to in zip(b["source"], b["mark"], b["start"], b["length"], b["to"]):
                    with open(source, "rb") as f:
                        f.seek(int(start))
                        out.seek(int(to))
                        left = int(length)
                        while left and (block := f.read(min(left, files.BLOCK))):
                            left -= out.write(block)
                    if left or fingerprint(source) != mark:
                        raise files.ListingError(f"{source} changed while it was copied")
                out.flush()
                os.fsync(out.fileno())
            yield pd.DataFrame({"n": [len(b)]})

    if runs:
        rows = spark.createDataFrame(runs, "source string, mark string, start long, length long, to long")
        rows.repartition(min(len(runs), 10_000)).mapInPandas(run, "n long").agg(F.sum("n")).collect()


def stored_zip(spark: SparkSession, dest: str, members: dict[str, list[str]], facts: dict[str, tuple], small: dict[str, bytes]) -> None:
    """A ZIP of stored members: those made of files, then the small ones. It appears whole or not at all."""
    temp, at, entries, heads, runs = f"{dest}.part-{os.getpid()}", 0, [], [], []
    for name, paths in members.items():
        _, crc, size, marks = facts[name]
        head = local_header(name, crc, size)
        heads.append((at, head))
        entries.append((name, crc, size, at))
        at += len(head)
        for p, mark in zip(paths, marks):
            whole = int(mark.split("-")[1])
            runs += [(p, mark, k, min(RUN_BYTES, whole - k), at + k) for k in range(0, whole, RUN_BYTES)]
            at += whole
    for name, data in small.items():
        head = local_header(name, zlib.crc32(data), len(data)) + data
        heads.append((at, head))
        entries.append((name, zlib.crc32(data), len(data), at))
        at += len(head)
    heads.append((at, directory(entries, at)))
    try:
        with open(temp, "xb") as f:
            for place, data in heads:
                f.seek(place)
                f.write(data)
        copy_runs(spark, runs, temp)
        verify(spark, temp, {n: facts[n][0] for n in members})
        os.link(temp, dest)
    finally:
        if os.path.exists(temp):
            os.unlink(temp)


#: From so many bytes on, a directory tells offsets in 64 bits.
FAR = MANY
#: What a task notes of each member until the place of its part is known: sizes of name, content and packed bytes, crc, offset.
NOTE = "<HIIIQ"
# An entry of a directory up to its name, and what follows the name of a member beyond 4 GB.
CENTRAL_ENTRY, WIDE = "<IHHHHHHIIIHHHHHII", "<HHQ"


def packed_zips(members: DataFrame, folder: str, content: Column | None = None) -> None:
    """Write members (archive, name and what ``content`` is made of, by default a column of that name) into archives, in order of
    name and each by many tasks. Rows are dealt and sorted before their content is made. Tasks pack ranges of members as parts; the parts' sizes give their places, and tasks copy them into files that are made
    beforehand, their directories with offsets of the whole. An archive appears whole."""
    spark, stage = members.sparkSession, os.path.join(folder, f".parts-{uuid.uuid4().hex}")

    def run(batches):
        at = os.path.join(stage, f"{TaskContext.get().partitionId():08d}-{TaskContext.get().taskAttemptId()}")
        held, n, size, noted, data, notes, made = None, 0, 0, 0, None, None, []

        def finish():
            made.append((TaskContext.get().partitionId(), held, data.name, size, notes.name, noted, n))
            data.close()
            notes.close()

        for b in batches:
            for archive, name, content in zip(b["archive"], b["name"], b["content"]):
                if archive != held:
                    if held is not None:
                        finish()
                    held, n, size, noted = archive, 0, 0, 0
                    data, notes = open(f"{at}-{len(made)}", "wb"), open(f"{at}-{len(made)}.notes", "wb")  # noqa: SIM115
                raw, content = name.encode(), content.encode() if isinstance(content, str) else content
                c, crc = zlib.compressobj(wbits=-zlib.MAX_WBITS), zlib.crc32(content)
                packed = c.compress(content) + c.flush()
                noted += notes.write(struct.pack(NOTE, len(raw), len(content), len(packed), crc, size) + raw)
                size += data.write(struct.pack("<IHHHHHIIIHH", LOCAL, VERSION, UTF8, DEFLATED, 0, DATE, crc, len(packed), len(content), len(raw), 0) + raw + packed)
                n += 1
        if held is not None:
            finish()
        yield pd.DataFrame(made, columns=["part", "archive", "data", "size", "notes", "noted", "n"])

    os.makedirs(stage)
    os.chmod(stage, 0o777)
    order = ["archive", "name"]
    try:
        parts = members.repartitionByRange(*order).sortWithinPartitions(*order).select(*order, (F.col("content") if content is None else content).alias("content")).mapInPandas(run, "part int, archive string, data string, size long, notes string, noted long, n long")
        archives, copies = {}, []
        for r in sorted(parts.collect(), key=lambda r: r["part"]):  # a row for each part
            archives.setdefault(r["archive"], []).append(r)
        for name, made in archives.items():
            temp, start, n = os.path.join(stage, f"{len(copies)}.whole"), sum(r["size"] for r in made), sum(r["n"] for r in made)
            entry, at, place = struct.calcsize(CENTRAL_ENTRY) + (struct.calcsize(WIDE) if start >= FAR else 0), 0, start
            for r in made:
                copies += [(r["data"], k, min(RUN_BYTES, r["size"] - k), at + k, temp, None, False) for k in range(0, r["size"], RUN_BYTES)]
                copies.append((r["notes"], 0, r["noted"], place, temp, at, start >= FAR))
                at, place = at + r["size"], place + r["noted"] + r["n"] * (entry - struct.calcsize(NOTE))
            with open(temp, "xb") as f:
                f.seek(place)
                f.write(end_records(n, place - start, start))
            os.chmod(temp, 0o666)
            archives[name] = temp
        placed(spark, copies)
        for name, temp in archives.items():
            os.replace(temp, os.path.join(folder, name))
    finally:
        shutil.rmtree(stage)


def placed(spark: SparkSession, copies: list[tuple]) -> None:
    """Copy runs of parts (source, from, length, to, dest), or write the directory of a part's notes, whose members stand ``shift`` further on."""

    def entries(f, shift: int, far: bool):
        while head := f.read(struct.calcsize(NOTE)):
            length, size, packed, crc, at = struct.unpack(NOTE, head)
            more = struct.pack(WIDE, 1, 8, at + shift) if far else b""
            yield struct.pack(CENTRAL_ENTRY, CENTRAL, VERSION, VERSION, UTF8, DEFLATED, 0, DATE, crc, packed, size, length, len(more), 0, 0, 0, 0o644 << 16, MANY if far else at + shift) + f.read(length) + more

    def run(batches):
        for b in batches:
            for source, start, length, to, dest, shift, far in b.itertuples(index=False):
                with open(source, "rb") as f, open(dest, "r+b") as out:
                    out.seek(int(to))
                    if not pd.isna(shift):
                        out.writelines(entries(f, int(shift), far))
                        continue
                    f.seek(int(start))
                    left = int(length)
                    while left and (block := f.read(min(left, files.BLOCK))):
                        left -= out.write(block)
                    if left:
                        raise files.ListingError(f"{source} is cut short")
            yield pd.DataFrame({"n": [len(b)]})

    if copies:
        rows = spark.createDataFrame(copies, "source string, start long, length long, to long, dest string, shift long, far boolean")
        rows.repartition(min(len(copies), 10_000)).mapInPandas(run, "n long").agg(F.sum("n")).collect()


def verify(spark: SparkSession, path: str, sums: dict[str, str]) -> None:
    """The members of a package have the digests that their sources had."""
    from vellumspark.sources.zip_members import ZipMembersDataSource

    spark.dataSource.register(ZipMembersDataSource)
    there = spark.read.format("zip_members").option("path", path).option("hash", "true").option("partitionBytes", RUN_BYTES).load()
    stated = spark.createDataFrame(list(sums.items()), "name string, stated string")
    bad = stated.join(there.select("name", "sha256"), "name", "left").where("not (stated <=> sha256)").select("name").first()
    if bad:
        raise files.ListingError(f"{bad['name']} changed while it was copied")


def create_wacz(spark: SparkSession, warc_folder: str, dest: str, title: str = "", split_bytes: int = RUN_BYTES) -> None:
    """A WACZ of a folder's WARC files: stored archives, sorted index, pages and a package description."""
    from shutil import rmtree

    from vellumspark.operators.catalogue import pages
    from vellumspark.operators.packages import index_lines, page_lines
    from vellumspark.sources.warc_splits import archives, scan

    if os.path.exists(dest):
        raise FileExistsError(dest)
    stage = f"{dest}.parts-{os.getpid()}"
    os.makedirs(stage)
    try:
        records = written(scan(spark, warc_folder, split_bytes).drop("entity"))
        index = write_parts(index_lines(records), "line", os.path.join(stage, "index"))
        html = records.where("status = 200 and mime = 'text/html'").select("url", F.col("date").alias("timestamp"), "filename", "offset")
        page = F.concat(F.lit('{"id":'), quoted("id"), F.lit(',"ts":'), quoted("timestamp"), F.lit(',"url":'), quoted("url"), F.lit("}")).alias("line")
        header = os.path.join(stage, "header")
        with open(header, "wb") as f:
            f.write(page_lines([]))
        listed = write_parts(pages(html).orderBy("url", "timestamp").select(page), "line", os.path.join(stage, "pages"))
        members = {f"archive/{os.path.basename(p)}": [p] for p in archives(warc_folder)}
        members |= {"indexes/index.cdx": [p for p, _ in index], "pages/pages.jsonl": [header, *(p for p, _ in listed)]}
        facts = measured(spark, members)
        resources = [{"name": os.path.basename(n), "path": n, "hash": f"sha256:{facts[n][0]}", "bytes": facts[n][2]} for n in members]
        package = json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "title": title, "resources": resources}, sort_keys=True, indent=2).encode()
        said = json.dumps({"path": "datapackage.json", "hash": f"sha256:{hashlib.sha256(package).hexdigest()}"}, sort_keys=True).encode()
        stored_zip(spark, dest, members, facts, {"datapackage.json": package, "datapackage-digest.json": said})
    finally:
        rmtree(stage)


def quoted(column: str):
    """A string as JSON writes it, characters beyond ASCII as they are."""
    one = F.to_json(F.array(F.col(column)))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def create_bag(spark: SparkSession, source: str, dest: str, paths: DataFrame, info: list[tuple[str, str]], algorithm: str = "sha256") -> None:
    """Copy the chosen files (path, below ``source``) into a new bag; the folder appears whole or not at all. Tasks copy and
    hash; the manifest's lines pass the driver a partition at a time."""
    from vellumspark.operators.packages import DECLARATION, bag_info

    if os.path.exists(dest):
        raise FileExistsError(dest)
    stage = f"{dest}.part-{os.getpid()}"
    os.makedirs(os.path.join(stage, "data"))

    def run(batches):
        for b in batches:
            out = []
            for p in b["path"]:
                there, to = os.path.join(source, p), os.path.join(stage, "data", p)
                os.makedirs(os.path.dirname(to), exist_ok=True)
                temp, h, size = f"{to}.{TaskContext.get().taskAttemptId()}", hashlib.new(algorithm), 0
                mark = fingerprint(there)
                with open(there, "rb") as f, open(temp, "wb") as copy:
                    while block := f.read(files.BLOCK):
                        h.update(block)
                        size += copy.write(block)
                if fingerprint(there) != mark or files.hash_file(temp, algorithm) != h.hexdigest():
                    raise files.ListingError(f"{p} changed while it was copied")
                os.replace(temp, to)
                out.append((p, h.hexdigest(), size))
            yield pd.DataFrame(out, columns=["path", "digest", "size"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = written(paths.select("path").distinct().repartition(parts, "path").mapInPandas(run, "path string, digest string, size long"))
    total = made.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    manifest, h = f"manifest-{algorithm}.txt", hashlib.new(algorithm)
    with open(os.path.join(stage, manifest), "wb") as f:
        for r in made.orderBy("path").toLocalIterator():
            name = r["path"].replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
            line = f"{r['digest']}  data/{name}\n".encode()
            h.update(line)
            f.write(line)
    tags = {"bagit.txt": DECLARATION.encode(), "bag-info.txt": bag_info([*info, ("Payload-Oxum", f"{total['bytes']}.{total['n']}")])}
    sums = {k: hashlib.new(algorithm, v).hexdigest() for k, v in tags.items()} | {manifest: h.hexdigest()}
    tags[f"tagmanifest-{algorithm}.txt"] = "".join(f"{s}  {k}\n" for k, s in sorted(sums.items())).encode()
    for name, data in tags.items():
        with open(os.path.join(stage, name), "wb") as f:
            f.write(data)
    os.rename(stage, dest)
