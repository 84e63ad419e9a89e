"""What the files of a capture are for, and which of them may leave it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.urls import is_warc_name

# Roles of capture files.
ORIGINAL, DERIVATIVE, METADATA = "preservation_original", "capture_derivative", "metadata"
# Metadata files that say nothing private, whole and by their place in a source's folder.
SHAREABLE = ["metadata/environment.json", "metadata/resolved-collection.json", "metadata/recipe-bundle-manifest.json"]
SHAREABLE_IN_SOURCE = ["seeds.txt", "metadata/command.json", "metadata/redirects.json", "metadata/resolved-source.json", "metadata/result.json"]


def _part(path: Column, i: int) -> Column:
    return F.coalesce(F.get(F.split(path, "/"), F.lit(i)), F.lit(""))


def _in_source(path: Column, place: str) -> Column:
    """sources/<id>/<place>/... with a file below."""
    return (_part(path, 0) == "sources") & (_part(path, 2) == place) & (F.size(F.split(path, "/")) >= 4)


def role(path: Column, kind: Column) -> Column:
    """The role of a file by its place; ``kind`` is its source's kind, null if unknown. Web archives
    are originals, and so is what an http-file source mirrors."""
    by_kind = F.when(kind == "http-file", ORIGINAL).otherwise(DERIVATIVE)
    by_name = F.when(is_warc_name(path), ORIGINAL).otherwise(DERIVATIVE)
    return F.when(_in_source(path, "warc"), by_name).when(_in_source(path, "mirror"), by_kind).otherwise(METADATA)


def inferred_role(path: Column, kind: Column) -> Column:
    """For captures without stated roles: a web archive is original right in its folder only."""
    deep = _in_source(path, "warc") & (F.size(F.split(path, "/")) != 4)
    return F.when(deep, DERIVATIVE).otherwise(role(path, kind))


def is_payload(path: Column) -> Column:
    return _in_source(path, "mirror") | _in_source(path, "warc")


def shareable(path: Column) -> Column:
    """Payload outside private and log folders, and metadata from the fixed lists."""
    parts, rest = F.split(path, "/"), F.array_join(F.slice(F.split(path, "/"), 3, 1000), "/")
    payload = is_payload(path) & ~F.array_contains(parts, "private") & ~F.array_contains(parts, "logs")
    in_source = (_part(path, 0) == "sources") & (F.size(parts) >= 3) & (rest.isin(SHAREABLE_IN_SOURCE) | ((_part(path, 2) == "warc") & F.lower(path).endswith(".cdx")))
    return payload | path.isin(SHAREABLE) | path.startswith("metadata/recipe-bundle/") | in_source


def coverage(files: DataFrame, assigned: DataFrame) -> DataFrame:
    """path and problem: files without a role, and roles without a file."""
    bare = files.select("path").join(assigned.select("path"), "path", "left_anti").withColumn("problem", F.lit("no role"))
    return bare.unionByName(assigned.select("path").join(files.select("path"), "path", "left_anti").withColumn("problem", F.lit("no file")))


def selected(files: DataFrame, profile: str, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Paths to export, and allowed paths that no file has: private takes all and must not have a
    list, public needs one."""
    if profile == "private":
        if allowed is not None:
            raise ValueError("a private export takes the complete capture")
        return files.select("path"), files.select("path").limit(0)
    if allowed is None:
        raise ValueError("a public export needs a list of paths")
    return files.select("path").join(allowed.select("path").distinct(), "path", "left_semi"), allowed.select("path").distinct().join(files.select("path"), "path", "left_anti")


def preservation_warcs(files: DataFrame) -> DataFrame:
    return files.where((F.col("role") == ORIGINAL) & is_warc_name(F.col("path")))


def source_kinds(paths: DataFrame, stated: DataFrame, older: DataFrame) -> DataFrame:
    """Kind of each source with mirrored files: by its resolved record, else by an older one; null
    where neither has it, which is an error to the caller."""
    ids = paths.where(_in_source(F.col("path"), "mirror")).select(_part(F.col("path"), 1).alias("source_id")).distinct()
    out = ids.join(stated.select("source_id", F.col("kind").alias("_a")), "source_id", "left").join(older.select("source_id", F.col("kind").alias("_b")), "source_id", "left")
    return out.select("source_id", F.coalesce("_a", "_b").alias("kind"))
