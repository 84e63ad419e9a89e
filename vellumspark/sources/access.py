"""Access graphs: the JSON of a collection as normalised tables, and the checks that they pass."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions.urls import access_id_valid, route_valid
from vellumspark.operators import graphs, model
from vellumspark.sources.files import json_lines
from vellumspark.sources.json_parts import json_parts
from vellumspark.sources.shared import written

SEGMENT = "struct<id:string,label:string,route:string>"
FACET = "struct<key:string,label:string,values:array<string>,artifact_ids:array<string>,note:string>"
REPRESENTATION = f"struct<id:string,label:string,kind:string,language:string,route:string,artifact_ids:array<string>,segments:array<{SEGMENT}>,segment_index:string>"
ITEM = f"struct<id:string,label:string,type:string,route:string,citation:string,rights:array<string>,facets:array<{FACET}>,representations:array<{REPRESENTATION}>>"
ARTIFACT = "struct<id:string,label:string,role:string,capture_path:string,media_type:string,sha256:string,container_id:string,member_path:string>"
COLLECTION = "struct<id:string,label:string,status:string,route:string,rights:array<string>>"
RELATION = "struct<source_id:string,relation:string,target_id:string>"
# What a collection's status may be.
STATUSES = ["complete", "complete_with_warnings", "incomplete"]
KIND = "^[a-z][a-z0-9_-]*$"


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of one or many graphs: collections, items, representations, representation_artifacts,
    segments, facets, artifacts, relations and rights. Order is kept as ordinals. Graphs are streamed and
    their elements written once, so that no task holds a graph whole, and the tables are read from there."""
    parts = {"collection": COLLECTION, "items": ITEM, "artifacts": ARTIFACT, "relations": RELATION}
    rows = json_parts(spark, path, "collection", ["items", "artifacts", "relations"])
    typed = [F.when(F.col("part") == n, F.from_json("value", kind, {"mode": "FAILFAST"})).alias(n) for n, kind in parts.items()]
    rows = written(rows.select("document", "part", "ordinal", *typed))
    g = rows.where("part = 'collection'").select("document", F.col("collection.id").alias("collection_id"), "collection")
    own = lambda n, *c: rows.where(F.col("part") == n).select("document", "ordinal", n).join(g.select("document", "collection_id"), "document").select("collection_id", *c)
    items = own("items", "ordinal", F.col("items").alias("i"))
    reps = items.select("collection_id", F.col("i.id").alias("item_id"), F.posexplode("i.representations").alias("ordinal", "r"))
    rights = g.select("collection_id", F.col("collection_id").alias("owner_id"), F.posexplode("collection.rights").alias("ordinal", "text")).unionByName(items.select("collection_id", F.col("i.id").alias("owner_id"), F.posexplode("i.rights").alias("ordinal", "text")))
    return {
        "collections": g.select("collection.id", "collection.label", "collection.status", "collection.route"),
        "items": items.select("collection_id", "ordinal", "i.id", "i.label", F.col("i.type").alias("item_type"), "i.route", "i.citation"),
        "representations": reps.select("collection_id", "item_id", "ordinal", "r.id", "r.label", "r.kind", "r.language", "r.route", "r.segment_index"),
        "representation_artifacts": reps.select("collection_id", F.col("r.id").alias("representation_id"), F.posexplode("r.artifact_ids").alias("ordinal", "artifact_id")),
        "segments": reps.select("collection_id", F.col("r.id").alias("representation_id"), F.posexplode("r.segments").alias("ordinal", "s")).select("collection_id", "representation_id", "ordinal", "s.*"),
        "facets": items.select("collection_id", F.col("i.id").alias("item_id"), F.col("ordinal").alias("item_ordinal"), F.posexplode("i.facets").alias("ordinal", "f")).select("collection_id", "item_id", "item_ordinal", "ordinal", "f.*"),
        "artifacts": own("artifacts", "artifacts.*"),
        "relations": own("relations", "ordinal", "relations.*"),
        "rights": rights,
    }


def problems(t: dict[str, DataFrame]) -> DataFrame:
    """table, id and problem of everything that a valid graph may not have: faults of its rows, and too many of them."""
    return row_problems(t).unionByName(size_problems(t))


def size_problems(t: dict[str, DataFrame]) -> DataFrame:
    """Collections that have more rows than a graph may have."""
    counts = [t[n].groupBy("collection_id").agg(F.count("*").alias("n")).withColumn("what", F.lit(w)) for n, w in (("items", "items"), ("artifacts", "artifacts"), ("segments", "inline_segments"))]
    return model.over_limits(reduce(DataFrame.unionByName, counts)).select(F.lit("graph").alias("table"), F.col("collection_id").alias("id"), F.lit("too many rows").alias("problem"))


def row_problems(t: dict[str, DataFrame]) -> DataFrame:
    """table, id and problem of every row at fault, whatever the size of its graph."""
    found = lambda df, table, ident, problem: df.select(F.lit(table).alias("table"), F.col(ident).alias("id"), F.lit(problem).alias("problem"))
    named = [t["collections"], t["artifacts"], t["items"], t["representations"], t["segments"]]
    out = [found(model.one_namespace(*named), "graph", "id", "repeated id")]
    for name in ("collections", "items", "representations", "segments"):
        out.append(found(t[name].where(~F.coalesce(route_valid(F.col("route")), F.lit(False))), name, "id", "route"))
        if name != "collections":
            out.append(found(t[name].groupBy("collection_id", "route").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1"), name, "id", "repeated route"))
    for name in ("collections", "items", "representations", "segments", "artifacts"):
        out.append(found(t[name].where(~F.coalesce(access_id_valid(F.col("id")), F.lit(False))), name, "id", "id"))
    out.append(found(t["collections"].where(~F.col("status").isin(STATUSES)), "collections", "id", "status"))
    for name, column in (("items", "item_type"), ("representations", "kind"), ("artifacts", "role")):
        out.append(found(t[name].where(~F.col(column).rlike(KIND)), name, "id", column))
    out.append(found(t["artifacts"].where(~F.coalesce(F.col("sha256"), F.lit("0" * 64)).rlike("^[0-9a-f]{64}$")), "artifacts", "id", "sha256"))
    out.append(found(model.dangling(t["representation_artifacts"], "artifact_id", t["artifacts"]), "representations", "representation_id", "unknown artifact"))
    refs = t["facets"].select("item_id", F.explode("artifact_ids").alias("artifact_id"))
    out.append(found(model.dangling(refs, "artifact_id", t["artifacts"]), "items", "item_id", "unknown artifact of a facet"))
    out.append(found(t["facets"].where(~model.facet_valid(F.col("values")) | ~F.col("key").rlike(KIND)), "items", "item_id", "facet"))
    out.append(found(t["facets"].groupBy("item_id").count().where(F.col("count") > model.MAX_FACETS), "items", "item_id", "too many facets"))
    out.append(found(model.facet_conflicts(t["facets"].withColumn("key", F.concat_ws("\t", "collection_id", "key"))), "facets", "key", "inconsistent"))
    out.append(found(model.dangling(t["artifacts"], "container_id", t["artifacts"].select("id")), "artifacts", "id", "unknown container"))
    out.append(found(graphs.on_cycles(t["artifacts"]), "artifacts", "id", "container cycle"))
    ends = [t[n].select("id") for n in ("collections", "items", "representations", "segments")]
    out.append(found(model.bad_relations(t["relations"], *ends), "relations", "source_id", "unknown end"))
    out.append(found(t["representations"].join(t["segments"].select(F.col("representation_id").alias("id")).distinct(), "id", "left_semi").where("segment_index is not null"), "representations", "id", "inline and indexed segments"))
    return reduce(DataFrame.unionByName, out)


def index_problems(spark: SparkSession, path: str, index: str, representations: DataFrame) -> DataFrame:
    """value and problem of lines of an external segment index: they must be compact JSON with sorted
    names, and belong to a representation that declares this index."""
    rows = json_lines(spark, path, f"representation_id string, segment {SEGMENT}")
    canonical = F.to_json(F.struct(F.col("record.representation_id"), F.col("record.segment")))
    declared = representations.where(F.col("segment_index") == index).select(F.col("id").alias("_rep")).distinct().withColumn("_known", F.lit(True))
    j = rows.join(declared, F.col("record.representation_id") == F.col("_rep"), "left")
    problem = F.when(canonical != F.col("value"), "not canonical").when(F.col("_known").isNull(), "foreign representation").when(~access_id_valid(F.col("record.segment.id")) | ~route_valid(F.col("record.segment.route")), "segment")
    return j.select("value", problem.alias("problem")).where("problem is not null")


def documents(t: dict[str, DataFrame], texts: DataFrame) -> DataFrame:
    """A searchable document for each representation, with its text from (representation_id, body);
    numbered densely in the order of collection, item and representation."""
    from vellumspark.functions.text import nfc
    from vellumspark.operators.numbering import dense_ids

    r = t["representations"].select("collection_id", "item_id", F.col("id").alias("representation_id"), nfc("label").alias("representation_label"), "kind", "language", "route")
    i = t["items"].select(F.col("id").alias("item_id"), nfc("label").alias("title"), "item_type", nfc("citation").alias("citation"))
    rows = r.join(i, "item_id").join(texts.select("representation_id", "body"), "representation_id").withColumn("body_sha256", F.sha2("body", 256))
    return dense_ids(rows, ["collection_id", "item_id", "representation_id"])


def write_catalogue(t: dict[str, DataFrame], texts: DataFrame, folder: str) -> None:
    """All tables of a catalogue as Parquet, the searchable documents with their tokens beside them."""
    from vellumspark.operators.search import tokenized

    for name, df in t.items():
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
    tokenized(documents(t, texts)).write.mode("errorifexists").partitionBy("collection_id").parquet(f"{folder}/documents")


def content_digest(docs: DataFrame) -> str:
    """Digest of all documents in the order of their ids, streamed through the driver."""
    import hashlib

    from vellumspark.operators.publish import canonical_json

    h = hashlib.sha256()
    for r in docs.select("docid", "collection_id", "item_id", "representation_id", "title", "representation_label", "kind", "language", "route", "body_sha256").orderBy("docid").toLocalIterator():
        h.update(canonical_json(r.asDict()) + b"\n")
    return h.hexdigest()
