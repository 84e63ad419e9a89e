"""Queries over scalar functions: text, URLs, paths, digests, times."""

from pyspark.sql import functions as F

from vellumspark.functions import html, text, urls
from vellumspark.operators import collections
from vellumspark.plans.common import table

TOKEN_SQL = text.TOKEN
SPACE_SQL = text.WIDE_SPACE


def norm_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", text.collapsed(text.nfc("text")).alias("norm"))


def token_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.coalesce(F.array_max("t"), F.lit("")).alias("last"))


TOKENS_SQL = f"""with d as (select doc_id, regexp_extract_all(translate(lower(text), '{text.FOLD_FROM}', '{text.FOLD_TO}'), '{TOKEN_SQL}') as t from documents)
select doc_id, len(t) as n, len(list_distinct(t)) as n_distinct, coalesce(list_max(t), '') as last from d"""


def surt_keys(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    u = F.col("url")
    return p.select("page_id", urls.surt(u).alias("surt"), urls.host(u).alias("host"), urls.absolute(u).alias("absolute"), urls.observed_safe(u).alias("safe"))


SURT_SQL = """select page_id, array_to_string(list_reverse(string_split(lower(regexp_extract(url, '://([^/?#:]*)', 1)), '.')), ',') || ')' ||
 case when rest = '' then '/' when starts_with(rest, '?') then '/' || rest else rest end as surt, lower(regexp_extract(url, '://([^/?#:]*)', 1)) as host, url as absolute, true as safe
from (select *, regexp_extract(url, '://[^/?#]*([^#]*)', 1) as rest from pages)"""


def first_party_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    hosts = ["tionble.example.org", "ththti.example.net", "www.ththre.example.net"]
    return p.select("page_id", urls.first_party(F.col("url"), hosts, "tionble.example.org").alias("url"))


FIRST_PARTY_SQL = """select page_id, case when lower(regexp_extract(url, '://([^/?#]*)', 1)) in ('tionble.example.org', 'ththti.example.net', 'www.ththre.example.net') then
 'https://tionble.example.org' || case when regexp_extract(url, '://[^/?#]*([^#]*)', 1) = '' then '/' else regexp_extract(url, '://[^/?#]*([^#]*)', 1) end end as url from pages"""


def page_keys(spark, sf_dir):
    """A stamp, page id and digest for each page."""
    p = table(spark, sf_dir, "pages")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1577836800) + F.col("page_id") * 61), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    own = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("SHA1:"), F.upper(F.sha1("url"))))
    return p.select("page_id", urls.page_id(F.col("url"), stamp).alias("id"), urls.cdx_timestamp(urls.rfc3339(stamp)).alias("stamp14"), urls.digest_or(own, F.encode("html", "UTF-8")).alias("digest"))


PAGE_KEYS_SQL = """with p as (select *, strftime(make_timestamp((1577836800 + page_id * 61) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as s from pages)
select page_id, substr(sha256(url || chr(10) || s), 1, 16) as id, replace(replace(replace(replace(s, '-', ''), ':', ''), 'T', ''), 'Z', '') as stamp14,
 case when page_id % 3 = 0 then 'sha1:' || lower(sha1(url)) else 'sha256:' || sha256(html) end as digest from p"""


def digests(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"), F.md5("text").alias("md5"))


def byte_sizes(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat((F.col("o_orderkey") % 5000).cast("string"), F.element_at(F.array(F.lit(""), F.lit("K"), F.lit("M"), F.lit("G"), F.lit("T"), F.lit(" k")), (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("literal"))
    size = text.byte_size(F.col("literal"))
    return o.select("o_orderkey", "literal", size.alias("bytes"), text.byte_text(size).alias("shown"))


BYTES_SQL = """with o as (select o_orderkey, (o_orderkey % 5000)::varchar || ['', 'K', 'M', 'G', 'T', ' k'][(o_orderkey % 6 + 1)::int] as literal from orders),
b as (select *, case when regexp_matches(literal, '^[1-9][0-9]*[KMG]?$') then regexp_extract(literal, '^[0-9]+')::bigint * case right(literal, 1) when 'K' then 1024 when 'M' then 1048576 when 'G' then 1073741824 else 1 end end as bytes from o)
select o_orderkey, literal, bytes, case when bytes < 1024 then printf('%.1f B', bytes::double) when bytes < 1048576 then printf('%.1f KiB', bytes / 1024) when bytes < 1073741824 then printf('%.1f MiB', bytes / 1048576)
 when bytes < 1099511627776 then printf('%.1f GiB', bytes / 1073741824) else printf('%.1f TiB', bytes / 1099511627776) end as shown from b"""

#: Paths and routes of many shapes, made from keys.
SHAPES = """case p_partkey % 12 when 0 then 'a/b' || p_partkey || '.txt' when 1 then '/abs/' || p_partkey when 2 then 'a//' || p_partkey when 3 then '../' || p_partkey when 4 then 'x/./y' when 5 then 'a\\\\b' || p_partkey
 when 6 then 'pages/' || p_partkey || '.html#s' || p_partkey when 7 then 'https://h/' || p_partkey when 8 then 'q?x=' || p_partkey when 9 then 'w.warc.gz' when 10 then 'fold/' else 'caf%C3' end"""
SHAPES_DUCK = SHAPES.replace("\\\\\\\\", "\\\\").replace("a\\\\b", "a\\b")


def path_checks(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(SHAPES).alias("path"))
    c = F.col("path")
    return p.select("p_partkey", "path", urls.safe_relative(c).alias("safe"), urls.safe_archive_member(c).alias("member"), urls.route_valid(c).alias("route"), urls.route_path(c).alias("file"), urls.route_fragment(c).alias("fragment"), urls.is_warc_name(c).alias("warc"), urls.media_type(c).alias("media"))


BAD_PART = r"(^|/)[.]{0,2}(/|$)"
PATHS_SQL = f"""with p as (select p_partkey, {SHAPES_DUCK} as path from part), f as (select *, split_part(path, '#', 1) as file from p)
select p_partkey, path, path <> '' and not regexp_matches(path, '[\\\\]') and not starts_with(path, '/') and not regexp_matches(path, '{BAD_PART}') as safe,
 path <> '' and not regexp_matches(path, '[\\\\]') and not starts_with(path, '/') and not regexp_matches(regexp_replace(path, '/$', ''), '{BAD_PART}') as member,
 file <> '' and not regexp_matches(file, '^[A-Za-z][A-Za-z0-9+.-]*:|[?%\\\\]|^/') and not regexp_matches(file, '{BAD_PART}') as route, file,
 case when contains(path, '#') then substr(path, strpos(path, '#') + 1) end as fragment, regexp_matches(lower(path), '[.]warc([.]gz)?$') as warc,
 case when ends_with(path, '.warc.gz') then 'application/warc+gzip' else 'application/octet-stream' end as media from f"""


def access_ids(spark, sf_dir):
    d = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Ä ~b/"), F.col("c_name")).alias("v"))
    i = text.access_id(F.lit("corpus one"), F.lit("item"), F.col("v"))
    return d.select("c_custkey", i.alias("id"), urls.access_id_valid(i).alias("valid"), text.unsafe_to_token(F.col("v")).alias("token"))


ACCESS_SQL = """select c_custkey, 'tp:corpus%20one/item/' || '%C3%84%20~b%2F' || replace(c_name, '#', '%23') as id, true as valid, '~c3~84~20~7eb~2f' || replace(c_name, '#', '~23') as token from customer"""


def identifier_order(spark, sf_dir):
    """Customers by identifiers such as 4.12.a, numbers by value and before words."""
    ident = F.concat_ws(".", (F.col("c_custkey") % 4).cast("string"), (F.col("c_custkey") % 113).cast("string"), F.when(F.col("c_custkey") % 2 == 0, "a").otherwise((F.col("c_custkey") % 7).cast("string")))
    c = table(spark, sf_dir, "customer").select(ident.alias("ident")).distinct().withColumn("_key", text.identifier_sort_key(F.col("ident")))
    from vellumspark.operators.numbering import dense_ids

    return dense_ids(c, ["_key"], "at").select("ident", "at")


ORDER_SQL = """with i as (select distinct c_custkey % 4 as a, c_custkey % 113 as b, case when c_custkey % 2 = 0 then 'a' else (c_custkey % 7)::varchar end as c from customer)
select a || '.' || b || '.' || c as ident, row_number() over (order by a, b, c = 'a', case when c <> 'a' then c::int end) as at from i"""


def markup_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", text.html_escaped(F.col("html")).alias("escaped"), F.array_join(text.entity_names(F.col("html")), ",").alias("entities"), text.clean_title(F.concat(F.lit("  a \t"), F.col("url"), F.lit(" : "))).alias("title"))


MARKUP_SQL = """select page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as escaped,
 array_to_string(regexp_extract_all(html, '&([A-Za-z][A-Za-z0-9._:-]*);', 1), ',') as entities, 'a ' || url as title from pages"""


def html_text(spark, sf_dir):
    """Visible text of each page's article, with its digest."""
    p = table(spark, sf_dir, "pages").select("page_id", html.text_of(F.col("html"), "article", by_tag=True).alias("body"))
    return p.select("page_id", "body", F.sha2("body", 256).alias("body_sha256"))


def html_links(spark, sf_dir):
    return html.links(table(spark, sf_dir, "pages"))


#: Kinds of a site's own pages, by their path; the first group is the id.
CLASSES = {"number": r"/([0-9]+)(?:[.]html|/)?", "picture": r"/(.+)[.](?:png|jpe?g|gif|svg)", "word": r"/([^/.]+)[.]?"}


def link_classes(spark, sf_dir):
    """Distinct targets of all pages' links, and of the pages themselves, by kind, with how often an id of
    each kind begins alike."""
    p = table(spark, sf_dir, "pages")
    rows = p.select("page_id", "html", F.lit("https://www.example.org/").alias("url"))
    ids = collections.classified_links(rows, CLASSES, ["www.example.org"], "www.example.org")
    return ids.groupBy("class").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))


#: References of a, link, img and script elements outside scripts and comments, as these pages write them.
HREFS_SQL = """with clean as (select page_id, url, regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)>.*?</(script|style)>', '', 'gs') as h from pages),
r as (select page_id, url, i - 1 as ordinal, m[i] as m from (select page_id, url, m, unnest(range(1, len(m) + 1)) as i from
  (select page_id, url, regexp_extract_all(h, '<(?:a|link) [^>]*?href="[^"]*"|<(?:img|script) [^>]*?src="[^"]*"') as m from clean))),
v as (select page_id, url, ordinal, regexp_extract(m, '^<([a-z]+)', 1) as tag, replace(regexp_extract(m, '(?:href|src)="([^"]*)"', 1), '&amp;', '&') as ref from r)"""
LINKS_SQL = HREFS_SQL + """ select page_id, ordinal::int as ordinal, tag, regexp_replace(case when regexp_matches(ref, '^[a-z]+:') then ref when starts_with(ref, '//') then split_part(url, '//', 1) || ref
 when starts_with(ref, '/') then regexp_extract(url, '^[^/]+//[^/?#]*') || ref when starts_with(ref, '?') then regexp_replace(url, '[?#].*$', '') || ref when ref = '' or starts_with(ref, '#') then url
 else regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || ref end, '#.*$', '') as link from v"""
CLASSES_SQL = HREFS_SQL + """, k as (select distinct regexp_replace(ref, '[?#].*$', '') as path from v where starts_with(ref, '/') and not starts_with(ref, '//')),
c as (select path, case when regexp_full_match(path, '/[0-9]+([.]html|/)?') then 'number' when regexp_full_match(path, '/.+[.](png|jpe?g|gif|svg)') then 'picture' when regexp_full_match(path, '/[^/.]+[.]?') then 'word' end as class from k),
i as (select distinct class, case class when 'number' then regexp_extract(path, '/([0-9]+)', 1) when 'picture' then regexp_extract(path, '/(.+)[.]', 1) else regexp_extract(path, '/([^/.]+)', 1) end as id from c where class is not null)
select class, count(*) as n, min(id) as first, max(id) as last from i group by class"""


def capture_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.concat(F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'"), F.when(F.col("event_id") % 5 == 0, F.lit("_x")).otherwise(F.lit("-run-1")))
    i = F.when(F.col("event_id") % 7 == 0, F.lit("20230231T000000Z-a")).otherwise(i)
    return e.select("event_id", i.alias("capture_id"), urls.capture_id_valid(i).alias("valid"))


IDS_SQL = """select event_id, case when event_id % 7 = 0 then '20230231T000000Z-a' else strftime(ts, '%Y%m%dT%H%M%SZ') || case when event_id % 5 = 0 then '_x' else '-run-1' end end as capture_id,
 event_id % 7 <> 0 and event_id % 5 <> 0 as valid from events"""


def manifest_paths(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.lit("%25\n")).otherwise(F.lit("%\r"))).alias("path"))
    e = urls.manifest_path_encoded(F.col("path"))
    return p.select("p_partkey", e.alias("encoded"), (urls.manifest_path_decoded(e) == F.col("path")).alias("same"))


MANIFEST_PATHS_SQL = """select p_partkey, p_name || case when p_partkey % 2 = 0 then '%2525%0A' else '%25%0D' end as encoded, true as same from part"""

QUERIES = {
    "norm_text": (norm_text, f"select doc_id, trim(regexp_replace(nfc_normalize(text), '{SPACE_SQL}', ' ', 'g')) as norm from documents"),
    "token_counts": (token_counts, TOKENS_SQL),
    "surt_keys": (surt_keys, SURT_SQL),
    "first_party_urls": (first_party_urls, FIRST_PARTY_SQL),
    "page_keys": (page_keys, PAGE_KEYS_SQL),
    "digests": (digests, "select doc_id, sha256(text) as sha256, sha1(text) as sha1, md5(text) as md5 from documents"),
    "byte_sizes": (byte_sizes, BYTES_SQL),
    "path_checks": (path_checks, PATHS_SQL),
    "access_ids": (access_ids, ACCESS_SQL),
    "identifier_order": (identifier_order, ORDER_SQL),
    "markup_text": (markup_text, MARKUP_SQL),
    "html_text": (html_text, None),
    "html_links": (html_links, LINKS_SQL),
    "link_classes": (link_classes, CLASSES_SQL),
    "capture_ids": (capture_ids, IDS_SQL),
    "manifest_paths": (manifest_paths, MANIFEST_PATHS_SQL),
}
