"""Inventories of text collections: what a catalogue page promises, what a package holds."""

import posixpath
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions import html, urls
from vellumspark.operators import graphs, inventory

ENTITY_DECLARATION = r"<!ENTITY\s+(?!%)([A-Za-z][A-Za-z0-9._:-]*)"
REFERENCES = r"""(?:SYSTEM|PUBLIC\s+(?:"[^"]*"|'[^']*'))\s+["']([^"']+)["']"""


def classified_links(pages: DataFrame, classes: dict[str, str], hosts: list[str], primary: str) -> DataFrame:
    """class and id of a register's own links. ``classes``: a pattern for the path of each class,
    whose first group is the id; the first that fits counts, each id once."""
    link = html.links(pages).select(urls.first_party(F.col("link"), hosts, primary).alias("link")).where("link is not null").distinct()
    path = urls.percent_decoded(F.regexp_extract("link", urls.PATH_OF, 1))
    kind, ident = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, pattern in reversed(classes.items()):
        whole = f"^{pattern}$"
        kind, ident = F.when(path.rlike(whole), name).otherwise(kind), F.when(path.rlike(whole), F.regexp_extract(path, whole, 1)).otherwise(ident)
    return link.select(kind.alias("class"), ident.alias("id")).where("class is not null").distinct()


def register_report(ids: DataFrame, required: tuple = ()) -> DataFrame:
    """severity, kind and message of each gap between the main class tei and the others. Gaps of a
    required class are errors, other gaps and orphans are warnings."""
    main = ids.where("class = 'tei'").select("id")
    out = None
    for kind in ("analytic-html", "plaintext"):
        g = inventory.gaps(main, ids.where(F.col("class") == kind).select("id"), "id")
        n = g.groupBy("side").agg(F.count("*").alias("n"), F.min("id").alias("first"))
        severe = (F.col("side") == "missing") & F.lit(kind in required)
        row = n.select(F.when(severe, "error").otherwise("warning").alias("severity"), F.lit(kind).alias("kind"), "side", "n", "first")
        out = row if out is None else out.unionByName(row)
    return out


def composition_gaps(items: DataFrame, untranslated: DataFrame, expected: DataFrame) -> DataFrame:
    """Compositions (id, translated) against the expected ids, and against those known to have no
    translation."""
    known = untranslated.select("id").distinct()
    bare = items.where("not translated").select("id").join(known, "id", "left_anti").withColumn("problem", F.lit("missing translation"))
    odd = items.where("translated").select("id").join(known, "id", "left_semi").withColumn("problem", F.lit("unexpected translation"))
    ids = inventory.gaps(expected, items, "id").select("id", F.concat(F.col("side"), F.lit(" composition")).alias("problem"))
    return bare.unionByName(odd).unionByName(ids).distinct()


def member_agreement(members: DataFrame, pattern: str) -> DataFrame:
    """Package members whose name does not say the same kind as their folder, or whose root id is
    not the one in the name. ``pattern``: groups folder kind, id, name kind."""
    group = lambda i: F.regexp_extract("name", pattern, i)
    problem = F.when(group(2) == "", "name").when(group(1) != group(3), "folder").when(~F.col("root_id").eqNullSafe(group(2)), "root id")
    return members.select("name", problem.alias("problem")).where("problem is not null")


def unbound_entities(documents: DataFrame, declared: DataFrame) -> DataFrame:
    """Entities that documents (name, document) use and nothing declares, with how many use them."""
    used = documents.select("name", F.explode(F.array_distinct(F.regexp_extract_all("document", F.lit(r"&([A-Za-z][A-Za-z0-9._:-]*);"), 1))).alias("entity"))
    builtin = ["amp", "apos", "gt", "lt", "quot"]
    return used.where(~F.col("entity").isin(builtin)).join(declared.select("entity").distinct(), "entity", "left_anti").groupBy("entity").agg(F.count("*").alias("documents"))


def declared_entities(documents: DataFrame) -> DataFrame:
    return documents.select("name", F.explode(F.regexp_extract_all("document", F.lit(ENTITY_DECLARATION), 1)).alias("entity")).distinct()


def support_edges(documents: DataFrame) -> DataFrame:
    """src and dst: which file refers to which, relative places resolved; absolute URLs stay."""

    def run(batches):
        for b in batches:
            rows = []
            for name, text in zip(b["name"], b["document"]):
                for target in re.findall(REFERENCES, text or ""):
                    rows.append((name, target if "://" in target else posixpath.normpath(posixpath.join(posixpath.dirname(name), target))))
            yield pd.DataFrame(rows, columns=["src", "dst"])

    return documents.select("name", "document").mapInPandas(run, "src string, dst string").distinct()


def support_graph(documents: DataFrame, roots: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files reached from the roots through declarations, and references that lead nowhere."""
    spark = documents.sparkSession
    edges = support_edges(documents)
    start = spark.createDataFrame([(r,) for r in roots], "node string")
    names = documents.select(F.col("name").alias("node"))
    follow = edges.where(F.col("dst").rlike(r"\.(dtd|ent)$")).join(names.withColumnRenamed("node", "dst"), "dst", "left_semi")
    visited = graphs.reach(follow, start.join(names, "node", "left_semi"))
    refs = edges.join(visited.withColumnRenamed("node", "src"), "src", "left_semi")
    missing = refs.join(names.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
    return visited, missing.unionByName(start.join(names, "node", "left_anti").select(F.lit("deposit").alias("src"), F.col("node").alias("dst")))


def download_coverage(expected: int, listed: int, recovered: Column) -> tuple[Column, Column]:
    """Payloads that are there, and those still missing."""
    return F.lit(listed) + recovered, F.greatest(F.lit(0), F.lit(expected - listed) - recovered)


def aligned(catalogue: DataFrame, package: DataFrame) -> DataFrame:
    """Catalogue entries in their order, each with its package record if there is one, then package
    records that no entry has, by id."""
    j = catalogue.select("id", "ordinal", "title").join(package.select("id", "member"), "id", "full_outer")
    return j.orderBy(F.col("ordinal").asc_nulls_last(), "id")


# Fixed value: the root element of the documents that packages hold.
TEI_ROOT = "{http://www.tei-c.org/ns/1.0}TEI"


def tei_identities(members: DataFrame, pattern: str, mapping: DataFrame) -> DataFrame:
    """archive, name, file_id, register_id and problem of the members whose name has the ``pattern`` (its first
    group is the id). ``mapping`` (file_id, register_id, root_id): where a register or a root is known to say
    otherwise than the file's name; a null there means the file's id. ``members``: read with ``xml``."""
    own = members.select("archive", "name", "xml_ok", "root", "root_id", F.regexp_extract("name", pattern, 1).alias("file_id")).where("file_id <> ''")
    known = mapping.select(F.col("file_id").alias("_id"), F.col("register_id").alias("_register"), F.col("root_id").alias("_root"))
    j = own.join(known, own["file_id"] == known["_id"], "left")
    problem = (
        F.when(~F.coalesce("xml_ok", F.lit(False)), "not well formed").when(F.col("root") != TEI_ROOT, "another root").when(F.coalesce("root_id", F.lit("")) == "", "no id")
        .when(F.col("root_id") != F.coalesce("_root", "file_id"), "another id")
    )
    return j.select("archive", "name", "file_id", F.coalesce("_register", "file_id").alias("register_id"), problem.alias("problem"))


def translations(representations: DataFrame) -> DataFrame:
    """source_id, relation and target_id: each translation of an item to its transliteration."""
    t = representations.where("kind = 'translation'").select("item_id", F.col("id").alias("source_id"))
    base = representations.where("kind = 'transliteration'").select("item_id", F.col("id").alias("target_id"))
    return t.join(base, "item_id").select("source_id", F.lit("translation_of").alias("relation"), "target_id")
