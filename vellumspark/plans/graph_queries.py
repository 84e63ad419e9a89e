"""Queries over the catalogue's tables, access graph checks, page lists and walks."""

from pyspark.sql import functions as F

from vellumspark.operators import catalogue, graphs, model, numbering
from vellumspark.plans.common import table


def catalogue_summary(spark, sf_dir):
    return catalogue.summary(catalogue.from_documents(table(spark, sf_dir, "documents")))


SUMMARY_SQL = """select source as collection_id, count(*) as documents, count(distinct lang) as languages, sum(strlen(text))::bigint as bytes from documents group by source"""


def catalogue_documents(spark, sf_dir):
    """Document rows with dense ids in catalogue order."""
    return catalogue.from_documents(table(spark, sf_dir, "documents")).select("docid", "collection_id", "representation_id", "title", "body_sha256")


DOCUMENTS_SQL = """select row_number() over (order by source, doc_id) as docid, source as collection_id, doc_id as representation_id, nfc_normalize(split_part(text, chr(10), 1)) as title, sha256(text) as body_sha256 from documents"""


def catalogue_projection(spark, sf_dir):
    """Collections with their items in order, and those that are unavailable."""
    d = table(spark, sf_dir, "documents")
    wanted = d.select(F.col("source").alias("collection_id")).distinct().unionByName(table(spark, sf_dir, "region").select(F.col("r_name").alias("collection_id")))
    return catalogue.projection(wanted, d.select(F.col("source").alias("collection_id"), F.col("doc_id").alias("item_id"), F.col("lang").alias("label")))


PROJECTION_SQL = """select collection_id, coalesce(n, 0) as n_items, coalesce(items, '') as items, case when n is null then 'unavailable' else 'available' end as status from
(select distinct source as collection_id from documents union select r_name from region) left join (select source as collection_id, count(*) as n, string_agg(doc_id || ':' || lang, ',' order by doc_id) as items from documents group by source) using (collection_id)"""


def facet_consistency(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("label"), F.when(F.col("p_size") > 45, F.col("p_size").cast("string")).alias("note"))
    return model.facet_conflicts(f)


FACETS_SQL = """select p_brand as key, count(distinct split_part(p_type, ' ', 1)) as labels, count(distinct case when p_size > 45 then '=' || p_size else '' end) as notes from part group by 1
having count(distinct split_part(p_type, ' ', 1)) > 1 or count(distinct case when p_size > 45 then '=' || p_size else '' end) > 1"""


def facet_notes(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.when(F.col("p_size") > 20, F.col("p_name")).alias("note"), F.col("p_partkey").alias("ordinal"))
    return model.facet_notes(f)


def facet_values(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("v"))
    return f.select("l_orderkey", model.facet_valid(F.col("v")).alias("valid"))


def graph_namespace(spark, sf_dir):
    """Ids shared by tables that have one namespace."""
    ids = [table(spark, sf_dir, t).select(F.col(c).cast("long").alias("id")) for t, c in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey"))]
    return model.one_namespace(*ids)


NAMESPACE_SQL = """select id, count(*) as n from (select c_custkey::bigint as id from customer union all select s_suppkey from supplier union all select p_partkey from part) group by id having count(*) > 1"""


def dangling_references(spark, sf_dir):
    refs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") < 5, F.col("l_partkey") * 2).alias("ref"))
    return model.dangling(refs, "ref", table(spark, sf_dir, "part"), "p_partkey")


DANGLING_SQL = """select l_orderkey, l_linenumber, l_partkey * 2 as ref from lineitem where l_linenumber < 5 and l_partkey * 2 not in (select p_partkey from part)"""


def bad_relations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    relations = o.select(F.col("o_orderkey").alias("relation"), F.col("o_custkey").alias("source_id"), (F.col("o_custkey") * 3).alias("target_id"))
    return model.bad_relations(relations, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 3).alias("id")))


RELATIONS_SQL = """with ids as (select c_custkey as id from customer union select s_suppkey * 3 from supplier)
select o_orderkey as relation, o_custkey as source_id, o_custkey * 3 as target_id from orders where o_custkey not in (select id from ids) or o_custkey * 3 not in (select id from ids)"""


def ordinals(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return model.numbered(d, "lines", "line")


def page_list(spark, sf_dir):
    """The first record of each page, as a web archive's page list has it."""
    p = table(spark, sf_dir, "pages").select(F.regexp_replace("url", r"[?#].*$", "").alias("url"), (F.col("page_id") % 3).cast("string").alias("timestamp"), F.concat(F.lit("f"), F.col("page_id") % 5).alias("filename"), F.col("page_id").alias("offset"))
    return catalogue.pages(p).select("id", "url", "timestamp", "filename", "offset")


PAGES_SQL = """with p as (select regexp_replace(url, '[?#].*$', '') as url, (page_id % 3)::varchar as timestamp, 'f' || (page_id % 5) as filename, page_id as "offset" from pages)
select substr(sha256(url || chr(10) || timestamp), 1, 16) as id, url, timestamp, filename, "offset" from (select *, row_number() over (partition by url, timestamp order by filename, "offset") as r from p) where r = 1"""


def cdx_lines(spark, sf_dir):
    """Index lines of all pages."""
    p = table(spark, sf_dir, "pages").select("url", F.timestamp_seconds(F.lit(1577836800) + F.col("page_id") * 61).alias("ts"), F.lit("text/html").alias("mime"), F.lit(200).alias("status"), F.concat(F.lit("sha256:"), F.sha2("html", 256)).alias("digest"), F.col("page_id").alias("offset"), F.octet_length("html").cast("long").alias("length"), F.lit("data.warc.gz").alias("filename"))
    return catalogue.cdx_lines(p).select("line")


CDX_SQL = """select array_to_string(list_reverse(string_split(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.')), ',') || ')' || regexp_extract(url, '://[^/?#]*([^#]*)', 1) || ' ' || strftime(make_timestamp((1577836800 + page_id * 61) * 1000000), '%Y%m%d%H%M%S') ||
 ' {"digest":"sha256:' || sha256(html) || '","filename":"data.warc.gz","length":' || strlen(html) || ',"mime":"text/html","offset":' || page_id || ',"status":200,"url":"' || url || '"}' as line from pages"""


def _edges(spark, sf_dir):
    """Edges from the keys of all orders: a graph with chains and cycles that grows with the table."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") * 7).alias("dst"))


def reachable(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graphs.reach(e, spark.createDataFrame([(0,), (3,)], "node long"), 4)


REACH_SQL = """with recursive e as (select distinct o_custkey as src, o_orderkey * 7 as dst from orders),
w(node, depth) as (select unnest([0, 3])::bigint, 0 union select e.dst, depth + 1 from w join e on w.node = e.src where depth < 4)
select node, min(depth) as depth from w group by node"""


def container_cycles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    containers = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 11 != 0, (F.col("c_custkey") * 5 + 3) % 700).alias("container_id"))
    return graphs.on_cycles(containers)


CYCLES_SQL = """with recursive c as (select c_custkey as id, (c_custkey * 5 + 3) % 700 as up from customer where c_custkey % 11 <> 0),
w(origin, here, depth) as (select id, up, 1 from c union all select w.origin, c.up, depth + 1 from w join c on w.here = c.id where w.here <> w.origin and depth < 700)
select distinct origin as id from w where here = origin"""


def redirect_walk(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graphs.redirect_walk(spark.createDataFrame([(1,), (2,), (7,)], "url long"), e, e.where("dst % 4 <> 0"), 8)


WALK_SQL = """with recursive e as (select distinct o_custkey as src, o_orderkey * 7 as dst from orders where (o_orderkey * 7) % 4 <> 0),
w(url, depth) as (select unnest([1, 2, 7])::bigint, 0 union select e.dst, depth + 1 from w join e on w.url = e.src where depth < 8)
select url, min(depth) as depth from w group by url order by 2, 1 limit 1000"""


def redirect_flags(spark, sf_dir):
    e = _edges(spark, sf_dir).distinct()
    return graphs.edge_flags(e, e.where("(src + dst) % 3 = 0"), e.where("src % 5 = 0").select(F.col("dst").alias("url")))


FLAGS_SQL = """with e as (select distinct o_custkey as src, o_orderkey * 7 as dst from orders)
select src, dst, (src + dst) % 3 = 0 as reviewed, dst in (select dst from e where src % 5 = 0) as requested from e"""


def completed_invocations(spark, sf_dir):
    flags = redirect_flags(spark, sf_dir)
    requests = table(spark, sf_dir, "orders").select(F.expr("o_orderkey div 2").alias("invocation"), F.col("o_custkey").alias("url"))
    return graphs.completed_by_redirects(requests, flags)


COMPLETED_SQL = f"""with f as ({FLAGS_SQL.replace("with e as", "with e as", 1)}), d as (select distinct src from f where reviewed and requested)
select o_orderkey // 2 as invocation, bool_and(o_custkey in (select src from d)) as completed from orders group by 1"""


def missing_support(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return graphs.missing_targets(e, e.select(F.col("src").alias("node")).distinct())


def first_per_key(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey")
    return numbering.first_by(li, ["l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"]).select("l_partkey", "l_orderkey", "l_linenumber")


QUERIES = {
    "catalogue_summary": (catalogue_summary, SUMMARY_SQL),
    "catalogue_documents": (catalogue_documents, DOCUMENTS_SQL),
    "catalogue_projection": (catalogue_projection, PROJECTION_SQL),
    "facet_consistency": (facet_consistency, FACETS_SQL),
    "facet_notes": (facet_notes, "select p_brand as key, arg_min(p_name, p_partkey) as note from part where p_size > 20 group by 1"),
    "facet_values": (facet_values, "select l_orderkey, count(*) = count(distinct l_returnflag) and count(*) <= 128 as valid from lineitem group by 1"),
    "graph_namespace": (graph_namespace, NAMESPACE_SQL),
    "dangling_references": (dangling_references, DANGLING_SQL),
    "bad_relations": (bad_relations, RELATIONS_SQL),
    "ordinals": (ordinals, "select doc_id, i - 1 as ordinal, l[i] as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents))"),
    "page_list": (page_list, PAGES_SQL),
    "cdx_lines": (cdx_lines, CDX_SQL),
    "reachable": (reachable, REACH_SQL),
    "container_cycles": (container_cycles, CYCLES_SQL),
    "redirect_walk": (redirect_walk, WALK_SQL),
    "redirect_flags": (redirect_flags, FLAGS_SQL),
    "completed_invocations": (completed_invocations, COMPLETED_SQL),
    "missing_support": (missing_support, "select distinct o_orderkey * 7 as node from orders where o_orderkey * 7 not in (select o_custkey from orders)"),
    "first_per_key": (first_per_key, "select l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey order by l_shipdate, l_orderkey, l_linenumber, l_suppkey) as r from lineitem) where r = 1"),
}
