"""Queries over inventories: fixity, lineage, duplicates, completeness."""

from pyspark.sql import functions as F

from vellumspark.operators import inventory
from vellumspark.plans.common import table


def manifests(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    entry = lambda text: (F.lit("file").alias("type"), F.octet_length(text).cast("long").alias("size"), F.sha2(text, 256).alias("sha256"))
    expected = d.select(F.col("doc_id").alias("path"), *entry(F.col("text")))
    changed = F.when(F.col("doc_id") % 23 == 0, F.concat("text", F.lit("x"))).when(F.col("doc_id") % 29 == 0, F.reverse("text")).otherwise(F.col("text"))
    actual = d.where("doc_id % 17 <> 0").select(F.col("doc_id").alias("path"), *entry(changed))
    extra = d.where("doc_id % 19 = 0").select((-F.col("doc_id") - 1).alias("path"), *entry(F.col("text")))
    return expected, actual.unionByName(extra)


def fixity_verify(spark, sf_dir):
    expected, actual = manifests(spark, sf_dir)
    return inventory.fixity_diff(expected, actual)


MANIFESTS_SQL = """with e as (select doc_id as path, 'file' as type, strlen(text) as size, sha256(text) as sha256 from documents),
c as (select doc_id as path, case when doc_id % 23 = 0 then text || 'x' when doc_id % 29 = 0 then reverse(text) else text end as t from documents where doc_id % 17 <> 0
  union all select -doc_id - 1, text from documents where doc_id % 19 = 0),
a as (select path, 'file' as type, strlen(t) as size, sha256(t) as sha256 from c)"""

FIXITY_SQL = (
    MANIFESTS_SQL
    + """
select coalesce(e.path, a.path) as path, 'missing' as problem, null::varchar as field from e left join a using (path) where a.path is null
union all select a.path, 'unexpected', null from a left join e using (path) where e.path is null
union all select e.path, 'mismatch', 'size' from e join a using (path) where e.size is distinct from a.size
union all select e.path, 'mismatch', 'sha256' from e join a using (path) where e.sha256 is distinct from a.sha256"""
)


def stated_facts(spark, sf_dir):
    """Facts are stated for some orders only: status where the key is even, price where it is not."""
    o = table(spark, sf_dir, "orders")
    even = F.col("o_orderkey") % 2 == 0
    expected = o.select(F.col("o_orderkey").alias("name"), F.when(even, F.col("o_orderstatus")).alias("status"), F.when(~even, F.round("o_totalprice", 2)).alias("price"))
    actual = o.where("o_orderkey % 31 <> 0").select(F.col("o_orderkey").alias("name"), F.when(F.col("o_orderkey") % 7 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("status"), F.round("o_totalprice", 2).alias("price"))
    return inventory.nullable_mismatch(expected, actual, "name", ["status", "price"])


STATED_SQL = """select o_orderkey as name, 'missing' as problem from orders where o_orderkey % 31 = 0
union all select o_orderkey, 'status' from orders where o_orderkey % 31 <> 0 and o_orderkey % 2 = 0 and o_orderkey % 7 = 0 and o_orderstatus <> 'X'"""


def lineage_gaps(spark, sf_dir):
    return inventory.gaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


LINEAGE_SQL = """select doc_id, 'missing' as side from (select distinct doc_id from documents) anti join labels using (doc_id)
union all select doc_id, 'unexpected' from (select distinct doc_id from labels) anti join documents using (doc_id)"""


def customer_gaps(spark, sf_dir):
    """Expected customers against those of orders; a fortieth is expected under another number."""
    c, o = table(spark, sf_dir, "customer").select(F.expr("if(c_custkey % 40 = 7, -c_custkey, c_custkey)").alias("id")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return inventory.gaps(c, o, "id")


CUSTOMER_SQL = """with c as (select case when c_custkey % 40 = 7 then -c_custkey else c_custkey end as id from customer)
select id, 'missing' as side from c where id not in (select o_custkey from orders) union all select distinct o_custkey, 'unexpected' from orders where o_custkey not in (select id from c)"""


def duplicate_texts(spark, sf_dir):
    return inventory.repeated(table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256")), "sha256")


def cross_package_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sha256"), "source")
    return inventory.in_several(d, "sha256", "source").select("sha256", F.array_join("packages", ",").alias("packages"))


def parts_of_several_suppliers(spark, sf_dir):
    out = inventory.in_several(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")
    return out.select("l_partkey", F.size("packages").cast("long").alias("n"), F.array_min("packages").alias("first"))


def missing_representation(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    items = d.select(F.col("source").alias("item"))
    kinds = d.select(F.col("lang").alias("kind"))
    exempt = d.where("doc_id % 5 = 0").select(F.col("source").alias("item"))
    return inventory.missing_representations(items, d.where("n_chars > 9000").select(F.col("source").alias("item"), F.col("lang").alias("kind")), kinds, exempt, "de")


MISSING_SQL = """select item, kind from (select distinct source as item from documents) cross join (select distinct lang as kind from documents)
where not exists (select 1 from documents d where d.source = item and d.lang = kind and d.n_chars > 9000)
  and not (kind = 'de' and item in (select source from documents where doc_id % 5 = 0))"""


def id_set_digest(spark, sf_dir):
    """A set's digest depends on all ids in order, so ids are sorted by the cluster and streamed."""
    return spark.createDataFrame([(inventory.ordered_digest(table(spark, sf_dir, "documents"), "doc_id"),)], "digest string")


def source_set_digests(spark, sf_dir):
    """The digest of each language's set of sources, inside the engine as the sets are small."""
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.sort_array(F.collect_set("source")).alias("ids"))
    return d.select("lang", F.sha2(F.concat(F.array_join("ids", "\n"), F.lit("\n")), 256).alias("digest"))


def set_operations(spark, sf_dir):
    """Languages of sources in both halves of the corpus, in one, and in either."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    a, b = d.where("doc_id % 2 = 0").select("source", "lang").distinct(), d.where("doc_id % 3 = 0").select("source", "lang").distinct()
    parts = [("difference", a.subtract(b)), ("intersection", a.intersect(b)), ("union", a.unionByName(b).distinct())]
    out = None
    for name, df in parts:
        df = df.groupBy("lang").agg(F.count("*").alias("n")).withColumn("operation", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


SETS_SQL = """with a as (select distinct source, lang from documents where doc_id % 2 = 0), b as (select distinct source, lang from documents where doc_id % 3 = 0)
select lang, count(*) as n, 'difference' as operation from (select * from a except select * from b) group by lang
union all select lang, count(*), 'intersection' from (select * from a intersect select * from b) group by lang
union all select lang, count(*), 'union' from (select * from a union select * from b) group by lang"""


def set_equality(spark, sf_dir):
    """For each pair of tables, whether two id lists have the same members without repeats."""
    n, s, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    pairs = [("nations of themselves", n.select("n_nationkey"), n.select("n_nationkey")), ("nations of suppliers", n.select("n_nationkey"), s.select(F.col("s_nationkey").alias("n_nationkey"))), ("nations of customers", n.select("n_nationkey"), c.select(F.col("c_nationkey").alias("n_nationkey")).distinct())]
    out = None
    for name, l, r in pairs:
        row = inventory.same_members(l, r, "n_nationkey").withColumn("pair", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


EQUALITY_SQL = """select 'nations of themselves' as pair, count(*) = count(distinct n_nationkey) as same from nation
union all select 'nations of suppliers', (select count(*) = count(distinct s_nationkey) from supplier) and not exists (select n_nationkey from nation except select s_nationkey from supplier) and not exists (select s_nationkey from supplier except select n_nationkey from nation)
union all select 'nations of customers', not exists (select n_nationkey from nation except select c_nationkey from customer) and not exists (select c_nationkey from customer except select n_nationkey from nation)"""


def reviewed_identity(spark, sf_dir):
    """Members through a reviewed mapping that covers some; the rest stand for themselves."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    mapping = p.where("id % 10 = 0").select("id", (F.col("id") + 1000000).alias("mapped"))
    return inventory.reviewed_ids(p, mapping, "id")


def required_sources(spark, sf_dir):
    """The last status of every expected source, missing where there is none."""
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"))
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source_id")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))
    return inventory.with_default(users, last, "source_id", "status", "missing")


REQUIRED_SQL = """select c_custkey as source_id, coalesce(status, 'missing') as status from customer left join
(select user_id, arg_max(event_type, {'a': ts, 'b': event_id}) as status from events group by user_id) on c_custkey = user_id"""

QUERIES = {
    "fixity_verify": (fixity_verify, FIXITY_SQL),
    "stated_facts": (stated_facts, STATED_SQL),
    "lineage_gaps": (lineage_gaps, LINEAGE_SQL),
    "customer_gaps": (customer_gaps, CUSTOMER_SQL),
    "duplicate_texts": (duplicate_texts, "select sha256(text) as sha256, count(*) as n from documents group by 1 having count(*) > 1"),
    "cross_package_duplicates": (cross_package_duplicates, "select sha256(text) as sha256, string_agg(distinct source, ',' order by source) as packages from documents group by 1 having count(distinct source) > 1"),
    "parts_of_several_suppliers": (parts_of_several_suppliers, "select l_partkey, count(distinct l_suppkey) as n, min(l_suppkey) as first from lineitem group by 1 having count(distinct l_suppkey) > 1"),
    "missing_representation": (missing_representation, MISSING_SQL),
    "id_set_digest": (id_set_digest, "select sha256(string_agg(id, chr(10) order by id) || chr(10)) as digest from (select distinct doc_id::varchar as id from documents)"),
    "source_set_digests": (source_set_digests, "select lang, sha256(string_agg(distinct source, chr(10) order by source) || chr(10)) as digest from documents group by lang"),
    "set_operations": (set_operations, SETS_SQL),
    "set_equality": (set_equality, EQUALITY_SQL),
    "reviewed_identity": (reviewed_identity, "select p_partkey as id, case when p_partkey % 10 = 0 then p_partkey + 1000000 else p_partkey end as resolved from part"),
    "required_sources": (required_sources, REQUIRED_SQL),
}
