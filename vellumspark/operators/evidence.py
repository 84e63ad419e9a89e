"""What captures prove: redirects, web records, recovered payloads, stable folders and bundles."""

import hashlib
import json
import os
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions import urls
from vellumspark.operators.inventory import fixity_diff
from vellumspark.operators.publish import bundle_digest
from vellumspark.operators.numbering import dense_ids, running_sum
from vellumspark.sources.files import ListingError, hash_file, walk
from vellumspark.sources.shared import written

# Limits of probes, bundles and recovered payloads.
PROBE_BYTES, PROBE_FILES, PROBE_TOTAL = 1 << 20, 256, 64 << 20
BUNDLE_FILES, BUNDLE_FILE_BYTES, BUNDLE_BYTES = 1_000, 16 << 20, 64 << 20
RECOVERED_BYTES = 10 << 20


def observed_redirects(records: DataFrame) -> DataFrame:
    """src and dst of the redirects in web archive records, targets resolved and plain http(s)."""
    r = records.where("status between 300 and 399 and location is not null")
    out = r.select(F.col("url").alias("src"), urls.resolved(F.col("url"), F.col("location")).alias("dst"))
    return out.where(urls.observed_safe(F.col("src")) & urls.observed_safe(F.col("dst"))).distinct()


# Bytes of a file, bytes of all files and records that the search for redirects looks at.
REDIRECT_FILE_BYTES, REDIRECT_BYTES, REDIRECT_RECORDS = 64 << 20, 256 << 20, 100_000


def within_budgets(records: DataFrame, size: str = "size", file_bytes: int = REDIRECT_FILE_BYTES, all_bytes: int = REDIRECT_BYTES, most: int = REDIRECT_RECORDS) -> tuple[DataFrame, DataFrame]:
    """The records (filename, offset, ``size``) that a reader meets who takes files by name, of each file no more than
    ``file_bytes`` and of all no more than ``all_bytes``, and stops after ``most`` records that are whole; and warnings (filename,
    warning) for the files that were cut or left. Places are sums over the whole table, found by ranges."""
    placed = written(running_sum(records, ["filename", "offset"], size, "_before"))
    of_file = written(placed.groupBy("filename").agg(F.sum(size).alias("_size"), F.min("_before").alias("_first")).withColumn("_taken", F.least("_size", F.lit(file_bytes))))
    limits = running_sum(of_file, ["filename"], "_taken", "_used").withColumn("_limit", F.least(F.lit(file_bytes), F.greatest(F.lit(all_bytes) - F.col("_used"), F.lit(0))))
    limits = written(limits.select("filename", "_size", "_first", "_limit"))
    whole = placed.join(limits, "filename").where(F.col("_before") - F.col("_first") + F.col(size) <= F.col("_limit"))
    numbered = dense_ids(written(whole.drop("_before", "_size", "_first", "_limit")), ["filename", "offset"], "_n")
    warning = F.when(F.col("_limit") == 0, "byte limit reached").when(F.col("_size") > F.col("_limit"), F.concat(F.lit("cut at "), F.col("_limit"), F.lit(" bytes")))
    return numbered.where(F.col("_n") <= most).drop("_n"), limits.select("filename", warning.alias("warning")).where("warning is not null")


def has_web_records(spark: SparkSession, folder: str, prefix: int = PROBE_BYTES) -> bool:
    """Whether the beginnings of a folder's web archives hold any response or resource. Files are
    taken in order within the budget of files and bytes, and probed by one job, which ends at the first."""
    left, chosen = PROBE_TOTAL, []
    for n in sorted(n for n in os.listdir(folder) if n.lower().endswith((".warc", ".warc.gz")))[:PROBE_FILES]:
        take = min(prefix, os.path.getsize(os.path.join(folder, n)), left)
        if take <= 0:
            break
        left -= take
        chosen.append((os.path.join(folder, n), take))
    if not chosen:
        return False

    def run(batches):
        from vellumspark.sources.warc import WarcReader, _File

        for b in batches:
            for path, take in zip(b["path"], b["take"]):
                rows = WarcReader({"path": path, "mode": "permissive", "prefixbytes": str(take)}).read(_File(path))
                if any(r[3] in ("response", "resource") for r in rows):
                    yield pd.DataFrame({"path": [path]})

    parts = min(len(chosen), spark.sparkContext.defaultParallelism)
    return not spark.createDataFrame(chosen, "path string, take long").repartition(parts).mapInPandas(run, "path string").limit(1).isEmpty()


def logical_bytes(records: DataFrame, limit: int) -> DataFrame:
    """One row: the bytes of all records, at most ``limit``."""
    return records.agg(F.least(F.coalesce(F.sum("length"), F.lit(0)), F.lit(limit)).alias("bytes"))


def gunzipped_digest(data: bytes | None, limit: int = RECOVERED_BYTES) -> str | None:
    """sha256 of a gzip payload, null if it is over the limit or broken."""
    if data is None:
        return None
    d = zlib.decompressobj(16 + zlib.MAX_WBITS)
    try:
        out = d.decompress(data, limit + 1)
    except zlib.error:
        return None
    return hashlib.sha256(out).hexdigest() if d.eof and len(out) <= limit and not d.unused_data else None


def recovered(expected: DataFrame, files: DataFrame) -> DataFrame:
    """name and problem of recovered downloads. ``expected``: name, sha256, inner_sha256; ``files``:
    name, sha256, content. The first check that fails counts: there is not exactly one, its digest,
    the digest of what it holds."""

    def inner(batches):
        for b in batches:
            yield pd.DataFrame({"name": b["name"], "outer": b["sha256"], "inner": [gunzipped_digest(c) for c in b["content"]]})

    f = files.select("name", "sha256", "content").mapInPandas(inner, "name string, outer string, inner string")
    n = f.groupBy("name").agg(F.count("*").alias("n"), F.min("outer").alias("outer"), F.min("inner").alias("inner"))
    j = expected.join(n, "name", "left")
    problem = F.when(F.coalesce("n", F.lit(0)) == 0, "missing").when(F.col("n") > 1, "several").when(F.col("outer") != F.col("sha256"), "fixity").when(~F.col("inner").eqNullSafe(F.col("inner_sha256")), "payload")
    return j.select("name", problem.alias("problem")).where("problem is not null")


def expected_ids(register: DataFrame, reviewed: DataFrame, count: int, digest: str) -> DataFrame:
    """The register's ids, else the reviewed list, which must have the stated count and digest."""
    from vellumspark.operators.inventory import ordered_digest

    if not register.isEmpty():
        return register.select("id").distinct()
    if reviewed.select("id").distinct().count() != count or ordered_digest(reviewed, "id") != digest:
        raise ListingError("the reviewed list is not the one that was reviewed")
    return reviewed.select("id").distinct()


def unchanged(before: DataFrame, after: DataFrame) -> bool:
    """Whether two snapshots of a folder are the same."""
    return fixity_diff(before, after).isEmpty()


def over_limits(listing: DataFrame, files: int, folders: int, size: int) -> DataFrame:
    """One row: which limits a tree breaks."""
    n = listing.agg(F.count_if(F.col("type") == "file").alias("f"), F.count_if(F.col("type") == "directory").alias("d"), F.coalesce(F.sum("size"), F.lit(0)).alias("b"))
    return n.select(F.array_compact(F.array(F.when(F.col("f") > files, F.lit("files")), F.when(F.col("d") > folders, F.lit("directories")), F.when(F.col("b") > size, F.lit("bytes")))).alias("broken"))


def page_entry_problems(lines: DataFrame) -> DataFrame:
    """line and problem of a page list (line from 0, value): a header first, then pages with an id,
    a URL and a time with a zone."""
    p = F.from_json("value", "format string, id string, url string, ts string")
    head = F.when((F.col("line") == 0) & ~p["format"].eqNullSafe("json-pages-1.0"), "header")
    page = F.when(F.col("line") > 0, F.when(F.coalesce(p["id"], F.lit("")) == "", "id").when(urls.absolute(p["url"]).isNull(), "url").when(urls.rfc3339(p["ts"]).isNull(), "time"))
    return lines.select("line", F.coalesce(head, page).alias("problem")).where("problem is not null")


def scan_bundle(root: str, only: list[str] | None = None) -> tuple[list[dict], str]:
    """Entries and digest of a recipe's folder, or of the declared files alone. Transient files are
    left out; links, special files, and more or larger files than allowed are errors."""
    rows, odd = walk(root)
    if odd:
        raise ListingError(f"{odd[0][0]}: {odd[0][1]}")
    names = [(p, s) for p, t, s, *_ in rows if t == "file" and not (p.rsplit("/", 1)[-1] == ".DS_Store" or p.endswith((".pyc", ".pyo")))]
    if only is not None:
        missing = set(only) - {p for p, _ in names}
        if missing:
            raise ListingError(f"{min(missing)} is declared and not there")
        names = [x for x in names if x[0] in set(only)]
    if len(names) > BUNDLE_FILES or sum(s for _, s in names) > BUNDLE_BYTES or any(s > BUNDLE_FILE_BYTES for _, s in names):
        raise ListingError("the bundle is too large")
    entries = [{"path": p, "size": s, "sha256": hash_file(os.path.join(root, p))} for p, s in names]
    return entries, bundle_digest(entries)


def copy_bundle(root: str, dest: str) -> str:
    """Copy a bundle with its manifest, checked again where it lands; its digest."""
    from shutil import copyfile

    entries, digest = scan_bundle(root)
    for e in entries:
        to = os.path.join(dest, e["path"])
        os.makedirs(os.path.dirname(to), exist_ok=True)
        copyfile(os.path.join(root, e["path"]), to)
        if hash_file(to) != e["sha256"]:
            raise ListingError(f"{e['path']} changed while it was copied")
    with open(os.path.join(dest, "..", "bundle-manifest.json"), "w", encoding="utf-8") as f:
        json.dump({"files": entries, "sha256": digest}, f, sort_keys=True)
    return digest


def collection_summaries(collections: DataFrame, sources: DataFrame) -> DataFrame:
    """Each collection with how many sources it has and how many of them are required, by id."""
    n = sources.groupBy("collection_id").agg(F.count("*").alias("sources"), F.count_if("required").alias("required"))
    return collections.join(n, "collection_id", "left").fillna(0, ["sources", "required"]).orderBy("collection_id")
