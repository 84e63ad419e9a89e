"""Validation of packages: bags and web archive collections, as joins of what is stated with what is there."""

import hashlib
import json
import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions.urls import cdx_timestamp, rfc3339, surt
from vellumspark.operators.inventory import fixity_diff
from vellumspark.sources import files, tree

# What a bag declares of itself.
DECLARATION = "BagIt-Version: 1.0\nTag-File-Character-Encoding: UTF-8\n"
ALGORITHMS = ("sha256", "sha512")


def declaration_valid(text: str) -> bool:
    return text.replace("\r\n", "\n").rstrip("\n") + "\n" in (DECLARATION, DECLARATION.replace("1.0", "0.97"))


def bag_info(lines: list[tuple[str, str]]) -> bytes:
    """bag-info.txt; labels have no colon and nothing spans lines."""
    for label, value in lines:
        if not label.strip() or ":" in label or any(c in label + value for c in "\r\n"):
            raise ValueError(f"unusable bag-info line {label!r}")
    return "".join(f"{k}: {v}\n" for k, v in lines).encode()


def validate_bag(spark: SparkSession, root: str) -> DataFrame:
    """path, problem and field of everything in a bag that is not as its manifests say."""
    found = tree.listing(spark, root)
    listing = found.where("type = 'file'").select("path", "size")
    out = tree.problems(found).select("path", F.col("warning").alias("problem"), F.lit(None).cast("string").alias("field"))
    with open(os.path.join(root, "bagit.txt"), encoding="utf-8") as f:
        if not declaration_valid(f.read()):
            out = out.unionByName(spark.createDataFrame([("bagit.txt", "declaration", None)], out.schema))
    for algorithm in ALGORITHMS:
        for name, data in ((f"manifest-{algorithm}.txt", True), (f"tagmanifest-{algorithm}.txt", False)):
            path = os.path.join(root, name)
            if not os.path.exists(path):
                continue
            stated = files.bag_manifest(spark, path)
            out = out.unionByName(stated.where("path is null").select("line", F.lit("malformed line").alias("problem"), F.lit(name).alias("field")).withColumnRenamed("line", "path"))
            twice = stated.where("path is not null").groupBy("path").count().where("count > 1")
            out = out.unionByName(twice.select("path", F.lit("repeated").alias("problem"), F.lit(name).alias("field")))
            there = listing.where(F.col("path").startswith("data/") if data else ~F.col("path").startswith("data/") & ~F.col("path").startswith("tagmanifest-"))
            actual = hashed(there.select("path"), root, algorithm)
            expected = stated.where("path is not null").select("path", "digest").distinct()
            out = out.unionByName(fixity_diff(expected, actual, "path", ("digest",)))
    return out


def hashed(paths: DataFrame, root: str, algorithm: str) -> DataFrame:
    import pandas as pd

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "digest": [files.hash_file(os.path.join(root, p), algorithm) for p in b["path"]]})

    return paths.mapInPandas(run, "path string, digest string")


def index_lines(records: DataFrame) -> DataFrame:
    """Index lines of WARC records, in order of key and time."""
    from vellumspark.operators.catalogue import cdx_lines

    return cdx_lines(records.withColumn("ts", rfc3339(F.col("date"))))


def page_lines(pages: list[dict]) -> bytes:
    """pages.jsonl with its header line."""
    dump = lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"
    return (dump({"format": "json-pages-1.0", "id": "pages", "title": "All Pages"}) + "".join(dump(p) for p in pages)).encode()


def package_index(spark: SparkSession, path: str) -> DataFrame:
    """line, value and late (before the line above it, by key and time) of a package's index, streamed by a task."""
    import pandas as pd

    def run(batches):
        for b in batches:
            for p in b["path"]:
                with zipfile.ZipFile(p) as z, z.open("indexes/index.cdx") as f:
                    rows, last = [], None
                    for i, line in enumerate(f):
                        value = line.decode().rstrip("\n")
                        key = value.split(" ")[:2]
                        rows.append((i, value, last is not None and key < last))
                        last = key
                        if len(rows) == 50_000:
                            yield pd.DataFrame(rows, columns=["line", "value", "late"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["line", "value", "late"])

    return spark.createDataFrame([(path,)], "path string").mapInPandas(run, "line long, value string, late boolean")


def validate_wacz(spark: SparkSession, path: str) -> DataFrame:
    """path, problem and field: resources against members, and index lines against their records. Members
    are hashed in blocks by the cluster, whatever their size."""
    from vellumspark.sources.zip_members import ZipMembersDataSource, member_problems

    spark.dataSource.register(ZipMembersDataSource)
    members = spark.read.format("zip_members").option("path", path).option("hash", "true").load()
    unsafe = member_problems(members).select(F.coalesce("name", F.lit("")).alias("path"), "problem", F.lit(None).cast("string").alias("field"))
    with zipfile.ZipFile(path) as z:
        raw = z.read("datapackage.json")
        package = files.strict_json(raw.decode())
        said = files.strict_json(z.read("datapackage-digest.json").decode())["hash"] if "datapackage-digest.json" in z.namelist() else None
    stated = spark.createDataFrame([(r["path"], r["bytes"], r["hash"]) for r in package["resources"]], "path string, bytes long, hash string")
    actual = members.where("not is_dir and name not in ('datapackage.json', 'datapackage-digest.json')").select(F.col("name").alias("path"), F.col("file_size").alias("bytes"), F.concat(F.lit("sha256:"), "sha256").alias("hash"))
    out = unsafe.unionByName(fixity_diff(stated, actual, "path", ("bytes", "hash")))
    if said not in (None, f"sha256:{hashlib.sha256(raw).hexdigest()}"):
        out = out.unionByName(spark.createDataFrame([("datapackage.json", "mismatch", "hash")], out.schema))
    lines = package_index(spark, path)
    at = F.concat(F.lit("indexes/index.cdx:"), F.col("line")).alias("path")
    late = lines.where("late").select(at, F.lit("unsorted").alias("problem"), F.lit(None).cast("string").alias("field"))
    return out.unionByName(late).unionByName(_index_mismatches(path, lines))


def _index_mismatches(path: str, lines: DataFrame) -> DataFrame:
    """Index lines whose record, read alone at its place inside the package, says otherwise."""
    import pandas as pd

    from vellumspark.sources.warc import WarcError, record_of

    fact = "struct<digest:string,filename:string,length:long,mime:string,offset:long,status:int,url:string>"
    rows = lines.select("line", F.split_part("value", F.lit(" "), F.lit(1)).alias("key"), F.from_json(F.regexp_extract("value", r"^\S+ \S+ (.*)$", 1), fact).alias("f")).select("line", "key", "f.*")
    wrong_key = rows.where(surt(F.col("url")) != F.col("key")).select("line", F.lit("key").alias("field"))

    def run(batches):
        with zipfile.ZipFile(path) as z:
            for b in batches:
                out = []
                for r in b.itertuples():
                    try:
                        with z.open(f"archive/{r.filename}") as f:
                            f.seek(int(r.offset))
                            got = record_of(f.read(int(r.length)), r.filename, int(r.offset), int(r.length))
                        bad = [n for n, x, y in (("url", got[4], r.url), ("digest", got[8], r.digest)) if x != y]
                    except (WarcError, KeyError, OSError, ValueError, zipfile.BadZipFile) as e:
                        bad = [type(e).__name__]
                    out += [(r.line, n) for n in bad]
                yield pd.DataFrame(out, columns=["line", "field"])

    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wrong = rows.select("line", "filename", "offset", "length", "url", "digest").repartitionByRange(parts, "filename", "offset").mapInPandas(run, "line long, field string")
    return wrong.unionByName(wrong_key).select(F.concat(F.lit("indexes/index.cdx:"), F.col("line")).alias("path"), F.lit("index").alias("problem"), "field")


def stamps_match(records: DataFrame) -> DataFrame:
    return records.where(cdx_timestamp(rfc3339(F.col("date"))) != F.col("stamp"))
