"""What captures say of themselves: stated roles, times, ids, commands, settings and reader payloads.

Problems come as rows with an ordinal, so that their order is kept wherever they are joined or counted.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.functions.urls import CAPTURE_ID, rfc3339, safe_id, safe_relative
from vellumspark.operators import roles
from vellumspark.sources.shared import written

# Schemas of capture.json, statuses of a reader, limits of its output.
SCHEMAS = ["1", "2", "3"]
READER_STATUSES = ["complete", "complete_with_warnings", "incomplete"]
READER_FILES, READER_BYTES, READER_INDEX, READER_RESERVED = 2000, 128 << 20, "index.html", "metadata.json"
#: What the ordinal of a capture's problem says first; the place within the list comes after it.
STAGES = ["document", "schema", "roles", "entry", "no role", "no file", "kind"]


def schema_version(record: Column) -> Column:
    """Version of a parsed capture.json (a variant): 1 if none is stated, null if it is no version."""
    stated = F.variant_get(record, "$.schema_version", "variant")
    number = F.when(F.schema_of_variant(stated) == "BIGINT", F.variant_get(record, "$.schema_version", "string"))
    return F.when(F.schema_of_variant(record).startswith("OBJECT"), F.when(stated.isNull(), F.lit(1)).otherwise(F.when(number.isin(SCHEMAS), number.cast("int"))))


def parsed(records: DataFrame) -> DataFrame:
    """capture, record (variant) and version of records (capture, document)."""
    r = records.select("capture", F.try_parse_json("document").alias("record"))
    return r.withColumn("version", schema_version(F.col("record")))


def stated_roles(parsed_records: DataFrame) -> DataFrame:
    """capture, place, path, role and problem of every entry that a record of schema 3 has."""
    listed = F.try_variant_get("record", "$.payload_roles", "array<variant>")
    e = parsed_records.where("version = 3").select("capture", F.posexplode(listed).alias("place", "entry"))
    shaped = F.schema_of_variant("entry").isin("OBJECT<path: STRING, role: STRING>")
    e = e.select("capture", "place", *[F.when(shaped, F.try_variant_get("entry", f"$.{k}", "string")).alias(k) for k in ("path", "role")])
    first = F.min("place").over(Window.partitionBy("capture", "path"))
    problem = (
        F.when(F.col("path").isNull(), "no path and role").when(~safe_relative(F.col("path")), "unsafe path").when(F.col("place") > F.col("_first"), "repeated path")
        .when(~F.col("role").isin(roles.ORIGINAL, roles.DERIVATIVE, roles.METADATA), "unknown role").when((F.col("role") != roles.METADATA) & ~roles.is_payload(F.col("path")), "role of a payload")
    )
    return e.withColumn("_first", first).select("capture", "place", "path", "role", problem.alias("problem"))


def _kinds(files: DataFrame, kinds: DataFrame) -> DataFrame:
    """Files with source_id and the kind of their source, null where nothing states it."""
    f = files.select("capture", "path", F.coalesce(F.get(F.split("path", "/"), F.lit(1)), F.lit("")).alias("source_id"))
    return f.join(kinds.select("capture", "source_id", "kind"), ["capture", "source_id"], "left")


def verified(records: DataFrame, files: DataFrame, kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Roles of all files of captures without problems (capture, version, path, role, stated), and the
    problems (capture, ordinal, problem, detail) of the others.

    ``records``: capture, document. ``files``: capture, path. ``kinds``: capture, source_id, kind.
    Roles are stated by schema 3, and must then name each file once; before, places and kinds tell them.
    What is used more than once is written to the shared folder: records are parsed once, files joined once.
    """
    record, version = F.col("record"), F.col("version")
    is_object, has = F.coalesce(F.schema_of_variant(record).startswith("OBJECT"), F.lit(False)), F.try_variant_get(record, "$.payload_roles", "array<variant>").isNotNull()
    schema = F.when(version.isNull(), F.try_variant_get(record, "$.schema_version", "string"))
    p = written(parsed(records).select("capture", "version", is_object.alias("_object"), schema.alias("_schema"), (has & (version == 3)).alias("_has"), F.when(version == 3, record).alias("record")))
    known = p.drop("record")
    entries = written(stated_roles(p))
    f = written(files.select("capture", "path").join(known.select("capture", "version", "_has"), "capture"))
    listed = entries.where("path is not null").select("capture", "path").distinct()
    older = _kinds(f.where("version < 3").select("capture", "path"), kinds)
    ordinal = lambda stage, place: F.struct(F.lit(STAGES.index(stage)).alias("stage"), place.cast("long").alias("place"), F.coalesce(F.col("detail"), F.lit("")).alias("at"))

    def rows(df: DataFrame, stage: str, problem: Column, detail: Column, place: Column | None = None) -> DataFrame:
        out = df.select("capture", problem.alias("problem"), detail.cast("string").alias("detail"), (F.lit(0) if place is None else place).alias("_place"))
        return out.select("capture", ordinal(stage, F.col("_place")).alias("ordinal"), "problem", "detail")

    none, said = F.lit(None), F.lit
    whole = known.where("version is null")
    problems = rows(whole.where("not _object"), "document", said("no object"), none)
    problems = problems.unionByName(rows(whole.where("_object"), "schema", said("unknown schema"), F.col("_schema")))
    problems = problems.unionByName(rows(known.where("version = 3 and not _has"), "roles", said("no list of roles"), none))
    problems = problems.unionByName(rows(entries.where("problem is not null"), "entry", F.col("problem"), F.coalesce("path", F.col("place").cast("string")), F.col("place")))
    stated = f.where("_has").select("capture", "path")
    problems = problems.unionByName(rows(stated.join(listed, ["capture", "path"], "left_anti"), "no role", said("no role"), F.col("path")))
    problems = problems.unionByName(rows(listed.join(f.select("capture", "path"), ["capture", "path"], "left_anti"), "no file", said("no file"), F.col("path")))
    mirrored = roles._in_source(F.col("path"), "mirror") & F.col("kind").isNull()
    problems = problems.unionByName(rows(older.where(mirrored).select("capture", "source_id").distinct(), "kind", said("unknown kind"), F.col("source_id")))
    problems = written(problems)
    # One row per capture is enough for the test of membership; files may be many.
    fine = known.where("version is not null").select("capture", "version").join(problems.select("capture").distinct(), "capture", "left_anti")
    by_record = entries.select("capture", "path", "role", F.lit(True).alias("stated"))
    by_place = older.select("capture", "path", roles.inferred_role(F.col("path"), F.col("kind")).alias("role"), F.lit(False).alias("stated"))
    return by_record.unionByName(by_place).join(fine, "capture").select("capture", "version", "path", "role", "stated"), problems


def in_order(problems: DataFrame, key: str) -> DataFrame:
    """Of each key the number of problems, the first by ordinal, and all of them in their order."""
    listed = F.sort_array(F.collect_list(F.struct("ordinal", "problem", "detail")))
    text = lambda x: F.concat_ws(": ", x["problem"], x["detail"])
    g = problems.groupBy(key).agg(F.count("*").alias("problems"), listed.alias("_all"))
    return g.select(key, "problems", text(F.get("_all", F.lit(0))).alias("first"), F.transform("_all", text).alias("messages"))


def told(stamp: Column) -> Column:
    """A moment in RFC 3339 and UTC, with microseconds only if there are any."""
    utc = F.to_utc_timestamp(stamp, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.expr("0") == F.unix_micros(stamp) % 1_000_000, "").otherwise(F.date_format(utc, ".SSSSSS")), F.lit("Z"))


def capture_moment(ended: Column, started: Column, now: Column) -> Column:
    """When a capture was: its end if that is a moment with a zone, else its start, else now."""
    return told(F.coalesce(rfc3339(ended), rfc3339(started), now))


def new_capture_id(now: Column) -> Column:
    """The moment and six random hexadecimal digits."""
    utc = F.to_utc_timestamp(now, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyyMMdd'T'HHmmss'Z'"), F.lit("-"), F.substring(F.expr("uuid()"), 1, 6))


def captured_at(capture_id: Column) -> Column:
    return F.try_to_timestamp(F.regexp_extract(capture_id, CAPTURE_ID, 1), F.lit("yyyyMMdd'T'HHmmss'Z'"))


def shell_word(word: Column) -> Column:
    """A word as a shell reads it back."""
    quoted = F.concat(F.lit("'"), F.replace(word, F.lit("'"), F.lit("'\"'\"'")), F.lit("'"))
    return F.when(word.rlike(r"\A[A-Za-z0-9_@%+=:,./-]+\z"), word).otherwise(quoted)


def shown_command(argv: Column) -> Column:
    return F.array_join(F.transform(argv, shell_word), " ")


def portable(commands: DataFrame, program: str = "wget") -> DataFrame:
    """Commands (argv, working_directory, required_directories and others) without the places of one
    machine: the program by name, folders as seen from the working directory. Null if a folder lies elsewhere."""
    base = F.col("working_directory")
    inside = lambda d: F.when(d == base, ".").when(d.startswith(F.concat(base, F.lit("/"))), F.substring(d, F.length(base) + 2, F.length(d)))
    folders = F.transform("required_directories", inside)
    argv = F.concat(F.array(F.lit(program)), F.slice("argv", 2, F.greatest(F.size("argv"), F.lit(1))))
    return commands.withColumns({"argv": argv, "required_directories": F.when(~F.exists(folders, lambda d: d.isNull()), folders), "shell_command": shown_command(argv)}).withColumn("working_directory", F.lit("."))


# What only a mirror can do.
MIRROR_ONLY = ["convert_links", "adjust_extension", "page_requisites"]


def setting_problems(settings: DataFrame) -> DataFrame:
    """Settings that contradict each other, as an array column in the order of the rules."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = [(~on("mirror") & ~on("warc"), "neither mirror nor warc"), (on("warc_cdx") & ~on("warc"), "warc_cdx without warc")]
    rules += [(on(c) & ~on("mirror"), f"{c} without mirror") for c in MIRROR_ONLY]
    return settings.withColumn("problems", F.array_compact(F.array(*[F.when(broken, text) for broken, text in rules])))


def reader_problems(reports: DataFrame, files: DataFrame) -> DataFrame:
    """reader, ordinal, problem and detail of what readers returned. ``reports``: reader, status.
    ``files``: reader, name, content (null if it is no text). Names and sizes are counted in partial
    aggregates; texts are never moved."""
    name = F.col("name")
    unsafe = name.isNull() | (name == "") | name.contains("\\") | name.startswith("/") | F.array_contains(F.split(name, "/"), "..") | name.rlike(r"\A(\./?)+\z")
    reserved = (name == READER_RESERVED) | name.endswith("/")
    problem = F.when(unsafe, "unsafe path").when(reserved, "reserved path").when(F.col("content").isNull(), "no text")
    each = files.select("reader", problem.alias("problem"), name.alias("detail")).where("problem is not null").withColumn("ordinal", F.lit(3))
    size = files.groupBy("reader").agg(F.count("*").alias("n"), F.sum(F.octet_length("content")).alias("bytes"), F.max((name == READER_INDEX).cast("int")).alias("index"))
    all_ = reports.join(size, "reader", "left").fillna(0, ["n", "bytes", "index"])
    checks = [
        (1, ~F.coalesce(F.col("status").isin(READER_STATUSES), F.lit(False)), "unknown status", F.col("status")), (2, F.col("n") > READER_FILES, "too many files", F.col("n")),
        (4, F.col("bytes") > READER_BYTES, "too many bytes", F.col("bytes")), (5, F.col("index") == 0, "no index", F.lit(None)),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("ordinal"), F.lit(t).alias("problem"), d.cast("string").alias("detail"))) for k, c, t, d in checks]))
    return each.select("reader", "ordinal", "problem", "detail").unionByName(all_.select("reader", F.inline(found)))


def recipe_path(collection_id: Column, root: str) -> Column:
    """Place of a public collection's recipe below ``root``; null for an unsafe id."""
    return F.when(safe_id(collection_id), F.concat(F.lit(root.rstrip("/") + "/"), collection_id, F.lit("/collection.toml")))
