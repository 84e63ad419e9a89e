"""Queries over collections of texts: catalogues, packages, TEI, entities, recovered payloads."""

import gzip

import pandas as pd
from pyspark.sql import functions as F

from vellumspark.functions import html, render, urls
from vellumspark.operators import collections, evidence, graphs, query_language
from vellumspark.plans.common import table

#: A composition's identifier from a part's key.
UNTRANSLATED = [f"{k % 7 + 1}.{k % 31 + 1}.{k}" for k in range(60)]
IDENT = "(p_partkey % 7 + 1) || '.' || (p_partkey % 31 + 1) || '.' || p_partkey"


def catalogue_records(spark, sf_dir):
    """Catalogue pages in both forms, a page for each brand, with a record for each part; nested ones stand under two
    labels or three, of which one begins like an identifier."""
    p = table(spark, sf_dir, "part")
    linked = F.expr(f"concat('<li>', {IDENT}, ' ', p_name, ': <a href=\"e.cgi?text=c.', {IDENT}, '&amp;d=x\">t</a>', if(p_size > 25, concat(' | <a href=\"e.cgi?text=t.', {IDENT}, '\">t</a>'), ''), '</li>')")
    nested = F.expr(f"concat('<li> Kind  ', p_size % 3, if(p_size % 3 = 0, '<ul><li>1.2.3 like one', ''), '<ul><li><b>', {IDENT}, '</b> ', p_name, if(p_size > 25, '</l>', '</li>'), if(p_size % 3 = 0, '</ul></li>', ''), '</ul></li>')")
    rows = p.select("p_brand", (F.col("p_brand").substr(-1, 1).cast("int") % 2 == 0).alias("form"), "p_partkey", linked.alias("a"), nested.alias("b"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "a", "b"))), lambda x: F.when(F.first("form"), x["a"]).otherwise(x["b"]))
    body = F.array_join(lines, "\n")
    pages = rows.groupBy("p_brand").agg(F.when(F.first("form"), F.concat(F.lit("<ul>"), body, F.lit("</ul>"))).otherwise(F.concat(F.lit("<ul><li> Works of  "), F.first("p_brand"), F.lit("<ul>"), body, F.lit("</ul></li></ul>"))).alias("html"))
    out = html.catalogues(pages, "p_brand", untranslated=UNTRANSLATED)
    return out.select("p_brand", "ordinal", F.array_join("path", " / ").alias("path"), "id", "title", "transliteration", "translation", "problem")


CATALOGUE_SQL = f"""with p as (select *, {IDENT} as id, right(p_brand, 1)::int % 2 = 0 as form from part)
select p_brand, (row_number() over (partition by p_brand order by p_partkey) - 1)::int as ordinal, case when form then '' else 'Works of ' || p_brand || ' / Kind ' || p_size % 3 end as path, id, trim(p_name) as title,
 case when form then 'e.cgi?text=c.' || id || '&d=x' else 'etcsl/transliterations/c.' || id || '.xml' end as transliteration, case when form then case when p_size > 25 then 'e.cgi?text=t.' || id end when p_partkey >= 60 then 'etcsl/translations/t.' || id || '.xml' end as translation, null::varchar as problem from p"""

TEI_DOC = """concat('<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="c', c_custkey, '"><teiHeader><fileDesc><titleStmt><title> Work of  ', c_name, '</title><author>', c_mktsegment, '</author><author>N', c_nationkey, '</author><author>', c_mktsegment,
 '</author></titleStmt><publicationStmt><availability><p>Free for ', c_mktsegment, '</p><licence target="http://l/', c_nationkey % 3, '"/></availability></publicationStmt></fileDesc><profileDesc><langUsage><language ident="l', c_nationkey % 4, '"/><language ident="la"/></langUsage><textClass><keywords><term>k', c_nationkey % 5, '</term><term>k0</term></keywords></textClass></profileDesc></teiHeader><text><body><div n="1"><head>H ', c_custkey, '</head><p>a <hi rend="bold">b', c_custkey, '</hi> &amp; c<lb/><gap/></p></div></body></text>', if(c_custkey % 17 = 0, '', '</TEI>'))"""


def tei_headers(spark, sf_dir):
    """What TEI headers say; broken documents have no row."""
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.expr(TEI_DOC).alias("document"))
    out = html.tei_records(docs, "c_custkey", "document")
    return out.select("c_custkey", "id", "title", "primary_language", *[F.array_join(c, "|").alias(c) for c in ("authors", "languages", "terms", "rights")])


TEI_SQL = """select c_custkey, 'c' || c_custkey as id, 'Work of ' || c_name as title, 'l' || c_nationkey % 4 as primary_language, c_mktsegment || '|N' || c_nationkey as authors, 'l' || c_nationkey % 4 || '|la' as languages,
 case when c_nationkey % 5 = 0 then 'k0' else 'k' || c_nationkey % 5 || '|k0' end as terms, 'Free for ' || c_mktsegment || '|http://l/' || c_nationkey % 3 as rights from customer where c_custkey % 17 <> 0"""


def tei_pages(spark, sf_dir):
    """TEI bodies as HTML."""
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.expr(TEI_DOC).alias("document"))
    return docs.select("c_custkey", render.rendered(F.col("document")).alias("html"))


TEI_PAGES_SQL = """select c_custkey, case when c_custkey % 17 <> 0 then '<div><h3>H ' || c_custkey || '</h3><p>a <strong>b' || c_custkey || '</strong> &amp; c<br><span>[…]</span></p></div>' end as html from customer"""


def entity_text(spark, sf_dir):
    """A corpus's own entities first, then those of XML kept, then HTML's, others shown by name."""
    s = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("&c;"), F.col("c_name"), F.lit(" &amp; &eacute; &zz"), F.col("c_nationkey"), F.lit(";")).alias("t"))
    return s.select("c_custkey", html.entities_replaced(F.col("t"), {"c": "š"}).alias("shown"))


def unbound_entities(spark, sf_dir):
    """Entities used in pages that no declaration covers."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("name"), F.concat("html", F.lit("&e"), F.col("page_id") % 50, F.lit(";")).alias("document"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("name"), F.concat(F.lit("<!ENTITY e"), F.col("n_nationkey"), F.lit(' "x"> <!ENTITY % p "y">')).alias("document"))
    return collections.unbound_entities(p, collections.declared_entities(n))


UNBOUND_SQL = """with u as (select distinct page_id, unnest(regexp_extract_all(html || '&e' || page_id % 50 || ';', '&([A-Za-z][A-Za-z0-9._:-]*);', 1)) as entity from pages)
select entity, count(*) as documents from u where entity not in ('amp', 'apos', 'gt', 'lt', 'quot') and entity not in (select 'e' || n_nationkey from nation) group by 1"""


def support_references(spark, sf_dir):
    """Which file names which in its declarations, relative places resolved."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("d"), F.col("c_nationkey"), F.lit("/x/f"), F.col("c_custkey"), F.lit(".xml")).alias("name"), F.expr("""concat('<!ENTITY % a SYSTEM "../y/', c_custkey % 9, '.ent"> <!DOCTYPE t PUBLIC "-//X" "http://h/t', c_nationkey, '.dtd">')""").alias("document"))
    return collections.support_edges(c)


SUPPORT_SQL = """select distinct 'd' || c_nationkey || '/x/f' || c_custkey || '.xml' as src, unnest(['d' || c_nationkey || '/y/' || c_custkey % 9 || '.ent', 'http://h/t' || c_nationkey || '.dtd']) as dst from customer"""


def member_agreement(spark, sf_dir):
    """Package members whose folder, name and root disagree."""
    li = table(spark, sf_dir, "lineitem")
    name = F.expr("concat('p/', if(l_linenumber % 2 = 0, 'translations', 'transliterations'), '/', if(l_suppkey % 5 = 0, 't', if(l_linenumber % 2 = 0, 't', 'c')), if(l_suppkey % 11 = 0, 'x', '.'), l_orderkey, '.', l_linenumber, '.xml')")
    m = li.select(name.alias("name"), F.when(F.col("l_partkey") % 7 != 0, F.concat_ws(".", "l_orderkey", "l_linenumber")).alias("root_id"))
    kinds = m.withColumn("name", F.regexp_replace(F.regexp_replace("name", "/translations/t", "/t/t"), "/transliterations/", "/c/"))
    return collections.member_agreement(kinds.withColumn("name", F.regexp_replace("name", "/translations/", "/t/")), r"^p/([ct])/(?=[ct][.])(?=.[.]([0-9.]+)[.]xml$)([ct])[.][0-9.]+[.]xml$")


AGREEMENT_SQL = """with m as (select case when l_linenumber % 2 = 0 then 't' else 'c' end as folder, case when l_suppkey % 5 = 0 or l_linenumber % 2 = 0 then 't' else 'c' end as kind, l_suppkey % 11 = 0 as odd, l_partkey % 7 = 0 as bare,
 l_orderkey || '.' || l_linenumber as id from lineitem), n as (select 'p/' || folder || '/' || kind || case when odd then 'x' else '.' end || id || '.xml' as name, case when odd then 'name' when folder <> kind then 'folder' when bare then 'root id' end as problem from m)
select name, problem from n where problem is not null"""


def composition_gaps(spark, sf_dir):
    """Compositions without an expected translation, with an unexpected one, missing or unexpected."""
    p = table(spark, sf_dir, "part")
    items = p.where("p_size > 2").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("translated"))
    return collections.composition_gaps(items, p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("id")), p.where("p_size < 49").select(F.col("p_partkey").alias("id")))


GAPS_SQL = """select p_partkey as id, 'missing translation' as problem from part where p_size > 2 and p_size % 2 <> 0 and p_size % 3 <> 0 union all select p_partkey, 'unexpected translation' from part where p_size > 2 and p_size % 6 = 0
union all select p_partkey, 'missing composition' from part where p_size <= 2 union all select p_partkey, 'unexpected composition' from part where p_size >= 49"""


def register_report(spark, sf_dir):
    """Gaps between a register's main class and the others; html is required."""
    li = table(spark, sf_dir, "lineitem")
    ids = li.select(F.expr("case when l_partkey % 9 = 4 then 'tei' when l_partkey % 7 = 3 then 'plaintext' when l_returnflag = 'A' then 'tei' when l_returnflag = 'N' then 'analytic-html' else 'plaintext' end").alias("class"), F.col("l_partkey").alias("id")).distinct()
    return collections.register_report(ids, ("analytic-html",))


REGISTER_SQL = """with i as (select distinct case when l_partkey % 9 = 4 then 'tei' when l_partkey % 7 = 3 then 'plaintext' when l_returnflag = 'A' then 'tei' when l_returnflag = 'N' then 'analytic-html' else 'plaintext' end as class, l_partkey as id from lineitem),
g as (select k.kind, 'missing' as side, t.id from (values ('analytic-html'), ('plaintext')) k(kind), i t where t.class = 'tei' and t.id not in (select id from i where class = k.kind)
 union all select class, 'unexpected', id from i where class <> 'tei' and id not in (select id from i where class = 'tei'))
select case when side = 'missing' and kind = 'analytic-html' then 'error' else 'warning' end as severity, kind, side, count(*) as n, min(id) as first from g group by kind, side"""


def aligned_records(spark, sf_dir):
    """Catalogue entries beside package records, and records that no entry has."""
    c = table(spark, sf_dir, "customer").select(F.expr("if(c_custkey % 20 = 3, -c_custkey, c_custkey)").alias("id"), F.col("c_custkey").alias("ordinal"), F.col("c_name").alias("title"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderkey").alias("member"))
    return collections.aligned(c, o)


def translation_relations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    reps = li.select(F.col("l_orderkey").alias("item_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.expr("case l_linenumber when 1 then 'transliteration' when 2 then 'translation' when 3 then 'translation' else 'note' end").alias("kind"))
    return collections.translations(reps)


def download_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(F.col("o_totalprice") > 150000).alias("recovered"))
    held, missing = collections.download_coverage(358, 348, F.col("recovered"))
    return o.select("o_orderpriority", held.alias("held"), missing.alias("missing"))


def recovered_payloads(spark, sf_dir):
    """Downloads that were recovered, by their packed and unpacked digests."""
    s = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("f"), F.col("c_custkey")).alias("name"), F.encode(F.col("c_name"), "UTF-8").alias("plain"))

    def packed(batches):
        for b in batches:
            yield pd.DataFrame({"c_custkey": b["c_custkey"], "name": b["name"], "plain": b["plain"], "content": [gzip.compress(p, mtime=0) if k % 13 else b"broken" for k, p in zip(b["c_custkey"], b["plain"])]})

    made = s.mapInPandas(packed, "c_custkey long, name string, plain binary, content binary").withColumn("sha256", F.sha2("content", 256))
    wrong = F.when(F.col("c_custkey") % 5 == 0, F.repeat(F.lit("0"), F.lit(64)))
    expected = made.select("name", F.coalesce(wrong, "sha256").alias("sha256"), F.when(F.col("c_custkey") % 7 == 0, F.lit("other")).otherwise(F.sha2("plain", 256)).alias("inner_sha256"))
    files = made.where("c_custkey % 3 <> 0").unionByName(made.where("c_custkey % 11 = 1"))
    return evidence.recovered(expected, files.select("name", "sha256", "content"))


RECOVERED_SQL = """with n as (select c_custkey as k, (case when c_custkey % 3 <> 0 then 1 else 0 end) + (case when c_custkey % 11 = 1 then 1 else 0 end) as n from customer)
select name, problem from (select 'f' || k as name, case when n = 0 then 'missing' when n > 1 then 'several' when k % 5 = 0 then 'fixity' when k % 13 = 0 or k % 7 = 0 then 'payload' end as problem from n) where problem is not null"""


def page_entries(spark, sf_dir):
    """Lines of page lists, one list for all pages, that are no entries."""
    p = table(spark, sf_dir, "pages")
    value = F.to_json(F.struct(F.when(F.col("page_id") % 5 != 0, F.sha2("url", 256)).alias("id"), F.when(F.col("page_id") % 7 == 0, F.lit("ftp:x")).otherwise(F.col("url")).alias("url"), F.when(F.col("page_id") % 11 == 0, F.lit("2026-01-01")).otherwise(F.lit("2026-01-01T00:00:00Z")).alias("ts")))
    return evidence.page_entry_problems(p.select((F.col("page_id") + 1).alias("line"), value.alias("value")))


ENTRIES_SQL = """select * from (select page_id + 1 as line, case when page_id % 5 = 0 then 'id' when page_id % 7 = 0 then 'url' when page_id % 11 = 0 then 'time' end as problem from pages) where problem is not null"""


def redirect_rules(spark, sf_dir):
    """Reviewed redirects that can't be used."""
    o = table(spark, sf_dir, "orders")
    url = lambda k, h: F.concat(F.lit("https://"), F.when(F.col("o_orderkey") % 9 == h, F.lit("other.org")).otherwise(F.lit("a.org")), F.lit("/"), k)
    rules = o.select(url(F.col("o_custkey"), 4).alias("src"), url(F.when(F.col("o_orderkey") % 8 == 0, F.col("o_custkey")).otherwise(F.col("o_orderkey")), 5).alias("dst"))
    return graphs.rule_problems(rules, ["a.org"])


RULES_SQL = """with r as (select 'https://' || case when o_orderkey % 9 = 4 then 'other.org' else 'a.org' end || '/' || o_custkey as src,
 'https://' || case when o_orderkey % 9 = 5 then 'other.org' else 'a.org' end || '/' || case when o_orderkey % 8 = 0 then o_custkey else o_orderkey end as dst from orders),
n as (select src, count(distinct dst) as targets, count(*) as rows_ from r group by src)
select src, dst, problem from (select distinct src, dst, case when src = dst then 'equal ends' when not starts_with(src, 'https://a.org/') or not starts_with(dst, 'https://a.org/') then 'foreign host' when targets > 1 then 'several targets' when rows_ > 1 then 'repeated' end as problem from r join n using (src)) where problem is not null"""


def url_parts(spark, sf_dir):
    """Links against their page, percent escapes and query parameters."""
    p = table(spark, sf_dir, "pages")
    link = F.concat(F.lit("../x%20y/"), F.col("page_id"), F.lit("?id=a+b&id="), F.col("page_id"), F.lit("#f"))
    base = F.concat(F.lit("http://h.org/a/b/"), F.col("page_id"))
    out = urls.resolved(base, link)
    return p.select("page_id", out.alias("link"), urls.percent_decoded(F.regexp_extract(out, r"^https?://[^/]*([^?#]*)", 1)).alias("path"), F.array_join(urls.query_values(out, F.lit("id")), "|").alias("ids"), urls.host_valid(F.concat(F.lit("h-"), F.col("page_id"), F.when(F.col("page_id") % 2 == 0, ".org").otherwise("-.org"))).alias("host"), urls.safe_id(F.concat(F.lit("x."), F.col("page_id"), F.when(F.col("page_id") % 3 == 0, "_").otherwise(""))).alias("id"))


PARTS_SQL = """select page_id, 'http://h.org/a/x%20y/' || page_id || '?id=a+b&id=' || page_id as link, '/a/x y/' || page_id as path, 'a b|' || page_id as ids, page_id % 2 = 0 as host, page_id % 3 <> 0 as id from pages"""


def query_checks(spark, sf_dir):
    """Search expressions made from names, and whether they parse."""

    @F.pandas_udf("boolean")
    def parses(q: pd.Series) -> pd.Series:
        def one(x):
            try:
                query_language.parse(x, ("title", "body"))
            except query_language.QueryError:
                return False
            return True

        return q.map(one)

    shape = """case c_custkey % 10 when 0 then c_name when 1 then concat('"', c_name) when 2 then concat(c_mktsegment, ' AND') when 3 then concat('title : ', c_mktsegment) when 4 then concat('nope : ', c_mktsegment) when 5 then concat('(', c_mktsegment, ' OR b*)')
 when 6 then concat(c_mktsegment, ')') when 7 then concat('NEAR(a ', c_mktsegment, ', 3)') when 8 then concat('a\t', c_mktsegment) else repeat('y', 1025) end"""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.expr(shape).alias("q"))
    return c.select("c_custkey", parses("q").alias("ok"))


def collection_summaries(spark, sf_dir):
    n = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("collection_id"), F.col("r_name").alias("label"))
    s = table(spark, sf_dir, "nation").select(F.expr("if(n_regionkey = 2, 1, n_regionkey)").alias("collection_id"), (F.col("n_nationkey") % 2 == 0).alias("required"))
    return evidence.collection_summaries(n, s)


def logical_bytes(spark, sf_dir):
    """The bytes of all pages, once up to a limit that they pass and once up to one that they don't."""
    p = table(spark, sf_dir, "pages").select(F.octet_length("html").cast("long").alias("length"))
    return evidence.logical_bytes(p, 10_000).unionByName(evidence.logical_bytes(p, 1 << 50))


QUERIES = {
    "catalogue_records": (catalogue_records, CATALOGUE_SQL),
    "tei_headers": (tei_headers, TEI_SQL),
    "tei_pages": (tei_pages, TEI_PAGES_SQL),
    "entity_text": (entity_text, "select c_custkey, 'š' || c_name || ' &amp; é {zz' || c_nationkey || '}' as shown from customer"),
    "unbound_entities": (unbound_entities, UNBOUND_SQL),
    "support_references": (support_references, SUPPORT_SQL),
    "member_agreement": (member_agreement, AGREEMENT_SQL),
    "composition_gaps": (composition_gaps, GAPS_SQL),
    "register_report": (register_report, REGISTER_SQL),
    "aligned_records": (aligned_records, "select coalesce(k, o_custkey) as id, c_custkey as ordinal, c_name as title, member from (select *, case when c_custkey % 20 = 3 then -c_custkey else c_custkey end as k from customer) full join (select o_custkey, min(o_orderkey) as member from orders group by 1) on k = o_custkey"),
    "translation_relations": (translation_relations, "select a.l_orderkey || '-' || a.l_linenumber as source_id, 'translation_of' as relation, b.l_orderkey || '-1' as target_id from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber in (2, 3) and b.l_linenumber = 1"),
    "download_coverage": (download_coverage, "select o_orderpriority, 348 + n as held, greatest(0, 10 - n) as missing from (select o_orderpriority, count(*) filter (o_totalprice > 150000) as n from orders group by 1)"),
    "recovered_payloads": (recovered_payloads, RECOVERED_SQL),
    "page_entries": (page_entries, ENTRIES_SQL),
    "redirect_rules": (redirect_rules, RULES_SQL),
    "url_parts": (url_parts, PARTS_SQL),
    "query_checks": (query_checks, "select c_custkey, c_custkey % 10 in (3, 5, 7) or (c_custkey % 10 = 0 and not contains(c_name, '#')) as ok from customer"),
    "collection_summaries": (collection_summaries, "select r_regionkey as collection_id, r_name as label, coalesce(n, 0) as sources, coalesce(q, 0) as required from region left join (select n_regionkey, count(*) as n, count(*) filter (n_nationkey % 2 = 0) as q from (select n_nationkey, case when n_regionkey = 2 then 1 else n_regionkey end as n_regionkey from nation) group by 1) on r_regionkey = n_regionkey"),
    "logical_bytes": (logical_bytes, "select least(sum(strlen(html))::bigint, unnest([10000, 1125899906842624])) as bytes from pages"),
}
