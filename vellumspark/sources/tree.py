"""Folders of any size: listed round by round, a level of folders at a time, and hashed by the cluster."""

import hashlib
import os
import stat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.sources.shared import written

ENTRIES = "path string, type string, size long, mtime_ns long, inode long, warning string"


def entries_of(root: str, folder: str, exclude: frozenset) -> list[tuple]:
    """The entries of one folder; what is neither file nor folder, or can't be read, has a warning instead of a type."""
    try:
        found = list(os.scandir(os.path.join(root, folder)))
    except OSError as e:
        return [(folder or ".", None, None, None, None, f"unreadable: {e.strerror}")]
    out = []
    for e in found:
        path = f"{folder}/{e.name}" if folder else e.name
        if path in exclude:
            continue
        s = e.stat(follow_symlinks=False)
        if stat.S_ISDIR(s.st_mode):
            out.append((path, "directory", 0, s.st_mtime_ns, s.st_ino, None))
        elif stat.S_ISREG(s.st_mode):
            out.append((path, "file", s.st_size, s.st_mtime_ns, s.st_ino, None))
        else:
            out.append((path, None, None, None, None, "symbolic link" if stat.S_ISLNK(s.st_mode) else "special file"))
    return out


def listing(spark: SparkSession, root: str, exclude: tuple = ()) -> DataFrame:
    """path, type, size, mtime_ns, inode and warning of everything below a folder. Links are not followed.
    A round for each level; only whether it had folders comes to the driver."""
    left, out = frozenset(exclude), None
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for b in batches:
            yield pd.DataFrame([x for p in b["path"] for x in entries_of(root, p, left)], columns=[c.split()[0] for c in ENTRIES.split(", ")]).astype({"size": "Int64", "mtime_ns": "Int64", "inode": "Int64"})

    level = spark.createDataFrame([("",)], "path string")
    while True:
        found = written(level.mapInPandas(run, ENTRIES))
        out = found if out is None else out.unionByName(found)
        level = found.where("type = 'directory'").select("path")
        if level.isEmpty():
            return out
        level = level.repartition(parts, "path")


def hashed(listed: DataFrame, root: str, algorithm: str = "sha256") -> DataFrame:
    """path, type, size and digest (null for folders) of a ``listing``; a file that is another one than was listed is an error."""
    from vellumspark.sources.files import hash_file

    def run(batches):
        for b in batches:
            sums = [hash_file(os.path.join(root, p), algorithm, int(s), int(m), int(i)) if t == "file" else None for p, t, s, m, i in zip(b["path"], b["type"], b["size"], b["mtime_ns"], b["inode"])]
            yield pd.DataFrame({"path": b["path"], "type": b["type"], "size": b["size"], "digest": sums})

    spread = listed.where("warning is null").drop("warning").repartition(int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")
    return spread.mapInPandas(run, "path string, type string, size long, digest string")


def problems(listed: DataFrame) -> DataFrame:
    return listed.where("warning is not null").select("path", "warning")


def digest(spark: SparkSession, root: str, exclude: tuple = ()) -> str:
    """SHA-256 over the canonical JSON list of all entries in order of their paths. Entries are written as JSON by the
    cluster and pass the driver a partition at a time."""
    from vellumspark.operators.publish import canonical_json
    from vellumspark.sources.files import ListingError

    listed = listing(spark, root, exclude)
    odd = problems(listed).orderBy("path").first()
    if odd:
        raise ListingError(f"{odd['path']}: {odd['warning']}")

    def run(batches):
        for b in batches:
            rows = [{"path": p, "type": t} if t == "directory" else {"path": p, "type": t, "size": int(s), "sha256": d} for p, t, s, d in zip(b["path"], b["type"], b["size"], b["digest"])]
            yield pd.DataFrame({"path": b["path"], "json": [canonical_json(r) for r in rows]})

    h, first = hashlib.sha256(b"["), True
    for r in hashed(listed, root).mapInPandas(run, "path string, json binary").orderBy("path").select("json").toLocalIterator():
        h.update(r["json"] if first else b"," + r["json"])
        first = False
    h.update(b"]")
    return h.hexdigest()


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path and change (added, removed, changed) between two ``hashed`` listings."""
    a = before.select("path", F.struct("type", "size", "digest").alias("was"))
    b = after.select("path", F.struct("type", "size", "digest").alias("now"))
    what = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "changed")
    return a.join(b, "path", "full_outer").select("path", what.alias("change")).where("change is not null")
