"""Folders, manifests and text indexes as DataFrames.

Spark's own file sources hide names that begin with a dot or underscore and empty folders, so
folders are listed (``tree``) and files hashed by the cluster, which needs the folder
mounted on the executors as a preservation archive is.
"""

import hashlib
import itertools
import json
import os
import stat
import tomllib
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.operators.inventory import EMPTY_SHA256

LISTING = "path string, type string, size long, mtime_ns long, inode long"
WARNINGS = "path string, warning string"
BLOCK = 1 << 20
#: Paths that a task holds at once.
LISTED = 10_000


class ListingError(ValueError):
    """A folder holds what a manifest can't describe."""


def walk(root: str, exclude: tuple = ()) -> tuple[list[tuple], list[tuple]]:
    """Entries (path, type, size, mtime, inode) of files and folders, and warnings for the rest."""
    rows, odd, todo = [], [], [""]
    while todo:
        at = todo.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, at)), key=lambda e: e.name)
        except OSError as e:
            odd.append((at or ".", f"unreadable: {e.strerror}"))
            continue
        for e in entries:
            path = f"{at}/{e.name}" if at else e.name
            if path in exclude:
                continue
            s = e.stat(follow_symlinks=False)
            if stat.S_ISLNK(s.st_mode):
                odd.append((path, "symbolic link"))
            elif stat.S_ISDIR(s.st_mode):
                rows.append((path, "directory", 0, s.st_mtime_ns, s.st_ino))
                todo.append(path)
            elif stat.S_ISREG(s.st_mode):
                rows.append((path, "file", s.st_size, s.st_mtime_ns, s.st_ino))
            else:
                odd.append((path, "special file"))
    return sorted(rows), sorted(odd)


def hash_file(path: str, algorithm: str = "sha256", size: int | None = None, mtime_ns: int | None = None, inode: int | None = None) -> str:
    """Digest in blocks; a file that changes meanwhile is an error."""
    h = hashlib.new(algorithm)
    with open(path, "rb") as f:
        before = os.fstat(f.fileno())
        while block := f.read(BLOCK):
            h.update(block)
        after = os.fstat(f.fileno())
    same = (before.st_size, before.st_mtime_ns) == (after.st_size, after.st_mtime_ns)
    stated = [(size, after.st_size), (mtime_ns, after.st_mtime_ns), (inode, after.st_ino)]
    if not same or any(x is not None and x != y for x, y in stated):
        raise ListingError(f"{path} changed while it was read")
    return h.hexdigest()


def objects(spark: SparkSession, root: str, exclude: tuple = (), strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(path, type, size, sha256) of every file and folder, and (path, warning). Strictly, a link
    or special file is an error."""
    from vellumspark.sources import tree

    listed = tree.listing(spark, root, exclude)
    odd = tree.problems(listed).orderBy("path")
    if strict and (first := odd.first()):
        raise ListingError(f"{first['path']}: {first['warning']}")
    hashed = tree.hashed(listed, root).select("path", "type", "size", F.coalesce("digest", F.lit(EMPTY_SHA256)).alias("sha256"))
    return hashed.orderBy("path"), odd


def named_files(listing: DataFrame, suffix: str = "") -> tuple[DataFrame, DataFrame]:
    """(name, path) of files by their bare name, and the names that stand more than once."""
    f = listing.where("type = 'file'").withColumn("name", F.split_part(F.element_at(F.split("path", "/"), -1), F.lit("?"), F.lit(1)))
    f = f.where(F.col("name").endswith(suffix)) if suffix else f
    n = f.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("path"))
    return n.where("n = 1").select("name", "path"), n.where("n > 1").select("name", "n")


MANIFEST = "schema_version int, algorithm string, files array<struct<path:string,type:string,size:long,sha256:string>>"


def fixity_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON manifest; wrong types fail, and so do repeated or unsafe paths and digests
    that are no sha256."""
    from vellumspark.functions.urls import safe_relative

    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.inline("files"))
    bad = rows.agg(F.count("*").alias("n"), F.count_distinct("path").alias("d"), F.count_if(~safe_relative(F.col("path")) | ~F.col("sha256").rlike("^[0-9a-f]{64}$")).alias("bad")).first()
    if bad["n"] != bad["d"] or bad["bad"]:
        raise ListingError("the manifest has repeated or malformed entries")
    return rows


def write_manifest(objects_: DataFrame, folder: str) -> None:
    """manifest-sha256.json and SHA256SUMS, each written once: an existing file is an error. The
    rows stream to the driver in order, a partition at a time."""
    os.makedirs(folder, exist_ok=True)
    temp = [os.path.join(folder, f".{n}.part") for n in ("manifest-sha256.json", "SHA256SUMS")]
    with open(temp[0], "w", encoding="utf-8") as manifest, open(temp[1], "w", encoding="utf-8") as sums:
        manifest.write('{"schema_version":1,"algorithm":"sha256","files":[')
        for i, r in enumerate(objects_.orderBy("path").toLocalIterator()):
            manifest.write("," * bool(i) + json.dumps({"path": r["path"], "sha256": r["sha256"], "size": r["size"], "type": r["type"]}, separators=(",", ":")))
            if r["type"] == "file":
                sums.write(f"{r['sha256']}  {r['path']}\n")
        manifest.write("]}\n")
    for t, name in zip(temp, ("manifest-sha256.json", "SHA256SUMS")):
        os.link(t, os.path.join(folder, name))  # fails if it is there
        os.unlink(t)


def cdx_counts(spark: SparkSession, path: str, header: bool = True, limit: int = 10_000_000) -> DataFrame:
    """file and records (null: unknown) of CDX files. With ``header`` the first line must be one;
    otherwise header lines are ignored wherever they stand."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"))
    head = F.col("value").rlike("^ ?CDX ")
    n = lines.groupBy("file").agg(F.count_if(~head & (F.col("value") != "")).alias("n"), F.count_if(head).alias("heads"))
    fine = (F.col("heads") == 1) if header else F.lit(True)
    return n.select("file", F.when(fine & (F.col("n") <= limit), F.col("n")).alias("records"))


def cdx_total(counts: DataFrame) -> DataFrame:
    """One row: the sum, null as soon as one file's count is unknown."""
    return counts.agg(F.when(F.count_if(F.col("records").isNull()) == 0, F.coalesce(F.sum("records"), F.lit(0))).alias("records"))


def bag_manifest(spark: SparkSession, path: str) -> DataFrame:
    """line, digest and path of a BagIt manifest; path is null where a line is malformed."""
    from vellumspark.functions.urls import manifest_path_decoded, safe_relative

    pattern = r"^([0-9A-Fa-f]+)[ \t]+(.+)$"
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.lower(F.regexp_extract("value", pattern, 1)).alias("digest"), manifest_path_decoded(F.regexp_extract("value", pattern, 2)).alias("path"))
    return rows.withColumn("path", F.when(safe_relative(F.col("path")), F.col("path")))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Raw lines beside their parsed record; a line that does not parse is an error."""
    return spark.read.text(path).select("value", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("record"))


def config(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Collections and sources of a TOML file. Settings go down from defaults to collections to
    sources; the nearest one counts."""
    with open(path, "rb") as f:
        doc = tomllib.load(f)
    base = doc.get("defaults", {})
    collections, sources = [], []
    for i, c in enumerate(doc.get("collections", [])):
        own = base | {k: v for k, v in c.items() if k != "sources"}
        collections.append((own["id"], own.get("label", own["id"]), bool(own.get("enabled", True)), i))
        for j, s in enumerate(c.get("sources", [])):
            all_ = {k: v for k, v in own.items() if k not in ("id", "label")} | s
            sources.append((own["id"], all_["id"], all_.get("kind", "web"), bool(all_.get("required", True)), [str(u) for u in all_.get("seeds", [])], [str(h) for h in all_.get("hosts", [])], j))
    return (
        spark.createDataFrame(collections, "collection_id string, label string, enabled boolean, ordinal int"),
        spark.createDataFrame(sources, "collection_id string, source_id string, kind string, required boolean, seeds array<string>, hosts array<string>, ordinal int"),
    )


def strict_json(text: str):
    """JSON without repeated keys or numbers that JSON lacks."""

    def pairs(items):
        if len({k for k, _ in items}) != len(items):
            raise ValueError("a key is repeated")
        return dict(items)

    def constant(name):
        raise ValueError(f"{name} is no JSON number")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


def captured(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Records (capture, document) and files (capture, path) of the captures right below a mounted ``root``.
    The driver lists the captures, the cluster each one's files; a link or special file is an error, a record that is missing or no UTF-8 null."""
    names = sorted(e.name for e in os.scandir(root) if e.is_dir(follow_symlinks=False))

    def paths(name):
        todo = [""]
        while todo:
            at = todo.pop()
            with os.scandir(os.path.join(root, name, at)) as entries:
                for e in entries:
                    if e.is_dir(follow_symlinks=False):
                        todo.append(f"{at}{e.name}/")
                    elif e.is_file(follow_symlinks=False):
                        yield name, f"{at}{e.name}"
                    else:
                        raise ListingError(f"{e.path} is no regular file")

    def run(batches):
        for b in batches:
            rows = (row for name in b["capture"] for row in paths(name))
            while some := list(itertools.islice(rows, LISTED)):
                yield pd.DataFrame(some, columns=["capture", "path"])

    def document(name):
        try:
            with open(os.path.join(root, name, "capture.json"), encoding="utf-8") as f:
                return f.read()
        except (FileNotFoundError, UnicodeDecodeError):
            return None

    def read(batches):
        for b in batches:
            yield b.assign(document=pd.Series([document(n) for n in b["capture"]], index=b.index, dtype=object))

    n = max(1, min(len(names), spark.sparkContext.defaultParallelism * 4))
    captures = spark.createDataFrame([(n,) for n in names], "capture string").repartition(n)
    return captures.mapInPandas(read, "capture string, document string"), captures.mapInPandas(run, "capture string, path string")


# Fixed value: a file larger than this is no catalogue.
MAX_CATALOGUE = 20 << 20


def sniffed(files: DataFrame, phrases: list[str], folder: str) -> DataFrame:
    """path and what: 'catalogue' if a file holds all phrases, 'zip' if it ends like an archive. ``files``:
    path, size, below a mounted ``folder``. Archives are told by their end, whatever their size."""
    marks = [p.encode() for p in phrases]

    def what(path, size):
        full = os.path.join(folder, path)
        if os.path.islink(full) or not os.path.isfile(full):
            return None
        if zipfile.is_zipfile(full):
            return "zip"
        if size <= MAX_CATALOGUE:
            with open(full, "rb") as f:
                data = f.read()
            return "catalogue" if all(m in data for m in marks) else None
        return None

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "what": [what(p, n) for p, n in zip(b["path"], b["size"])]}, dtype=object)

    return files.select("path", "size").mapInPandas(run, "path string, what string").where("what is not null")


def only_one(found: DataFrame) -> DataFrame:
    """what, n and path of what was sniffed: the path only if there is one such file."""
    return found.groupBy("what").agg(F.count("*").alias("n"), F.min("path").alias("path")).withColumn("path", F.when(F.col("n") == 1, F.col("path")))
