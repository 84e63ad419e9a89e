"""Ranked search queries, and the index behind them."""

import hashlib

from pyspark.sql import functions as F

from vellumspark.functions.text import FOLD_FROM, FOLD_TO, TOKEN
from vellumspark.operators import search
from vellumspark.plans.common import corpus
from vellumspark.sources.shared import drop_at_exit, exists, shared_folder

TOP = 100


def index_of(spark, sf_dir) -> search.Index:
    """The corpus's index in the shared folder, written by the first search of a session."""
    folder = f"{shared_folder(spark)}/search-{spark.sparkContext.applicationId}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    if not exists(spark, f"{folder}/statistics/_SUCCESS"):
        drop_at_exit(spark, folder)
        return search.write_index(corpus(spark, sf_dir), folder)
    return search.Index(spark, folder)


def _run(query: str, **filters):
    def run(spark, sf_dir):
        hits = search.search(index_of(spark, sf_dir), query, TOP, **filters)
        return hits.select("docid", "collection_id", "language", F.round("rank", 9).alias("rank"))

    return run


def _starts(col: str, toks: list[str], prefix: bool, first: bool) -> str:
    tests = [f"starts_with(t_{col}[i + {k}], '{t}')" if prefix and k == len(toks) - 1 else f"t_{col}[i + {k}] = '{t}'" for k, t in enumerate(toks)]
    return f"list_filter(range(1, len(t_{col}) + 1), lambda i: coalesce({' and '.join(tests)}, false){' and i = 1' if first else ''})"


def _sql(phrases: list[tuple], condition: str, where: str = "true", near: int | None = None) -> str:
    """``phrases``: (tokens, prefix, first, columns). ``condition`` speaks of c0, c1 and so on."""
    cols = {"title": 8, "representation_label": 3, "body": 1}
    hits, f = [], []
    for k, (toks, prefix, first, own) in enumerate(phrases):
        for c in own or cols:
            hits.append(f"{_starts(c, toks, prefix, first)} as s{k}_{c}")
        if near is not None:  # two phrases of one token, in bodies: starts with one of the other close by
            o = 1 - k
            f.append(f"len(list_filter(s{k}_body, lambda a: len(list_filter(s{o}_body, lambda b: abs(a - b) <= 1 + {near})) > 0))::double as c{k}, len(s{k}_body) as r{k}")
            continue
        f.append(f"({' + '.join(f'{cols[c]}.0 * len(s{k}_{c})' for c in own or cols)})::double as c{k}")
    n = ", ".join(f"count(*) filter ({'r' if near is not None else 'c'}{k} > 0) as n{k}" for k in range(len(phrases)))
    idf = lambda k: f"(case when ln((n - n{k} + 0.5) / (n{k} + 0.5)) > 0 then ln((n - n{k} + 0.5) / (n{k} + 0.5)) else 0.000001 end)"
    rank = " ".join(f"- {idf(k)} * c{k} * 2.2 / (c{k} + 1.2 * (0.25 + 0.75 * len_all / avg_all))" for k in range(len(phrases)))
    tok = lambda e: f"regexp_extract_all(translate(lower({e}), '{FOLD_FROM}', '{FOLD_TO}'), '{TOKEN}')"
    return f"""with t as (select doc_id as docid, source as collection_id, lang as language, {tok("split_part(text, chr(10), 1)")} as t_title, {tok("source")} as t_representation_label, {tok("text")} as t_body from documents),
h as (select docid, collection_id, language, t_body, len(t_title) + len(t_representation_label) + len(t_body) as len_all, {", ".join(hits)} from t),
c as (select *, {", ".join(f)} from h), s as (select count(*) as n, avg(len_all) as avg_all, {n} from c)
select docid, collection_id, language, round(0.0 {rank}, 9) as rank from c, s where {condition} and {where} order by 0.0 {rank}, collection_id, docid::varchar limit {TOP}"""


def snippets(spark, sf_dir):
    hits = search.search(index_of(spark, sf_dir), "worthless OR disgusting", 20)
    return search.snippets(corpus(spark, sf_dir).select("docid", "body").join(F.broadcast(hits.select("docid")), "docid"), "worthless OR disgusting").select("docid", "snippet")


#: The first twenty hits of two terms. A window scores 1000 for each of the terms in it and 1 for each repeat; candidates are
#: the windows with the instances that follow a term in their middle, and those from the start of its sentence (100 more, 120 for the first).
def snippets_sql() -> str:
    ranked = _sql([ONE("worthless"), ONE("disgusting")], "(c0 > 0 or c1 > 0)").replace(f"limit {TOP}", "limit 20")
    tok = f"regexp_extract_all(translate(lower(text), '{FOLD_FROM}', '{FOLD_TO}'), '{TOKEN}')"
    inside = lambda at: f"list_filter(m, lambda x: x >= {at} and x < {at} + 24)"
    score = lambda w: f"999 * len(list_distinct(list_transform({w}, lambda x: t[x]))) + len({w})"
    return f"""with hit as ({ranked}), d as (select doc_id as docid, text, {tok} as t, regexp_extract_all(text, '{TOKEN}') as o, regexp_split_to_array(text, '{TOKEN}') as g from documents join hit on doc_id = docid),
s as (select docid, t, o, g, len(t) as n, list_filter(range(1, len(t) + 1), lambda i: t[i] in ('worthless', 'disgusting')) as m,
  list_filter(range(1, len(t) + 1), lambda i: i = 1 or regexp_matches(g[i], '[.:][ \t\r\n]+$')) as q from d),
c as (select *, unnest(list_concat(m, case when len(m) = 0 then [1] else [] end)) as i from s),
r as (select *, {inside("i")} as w, list_max(list_filter(q, lambda x: x <= i)) as a from c),
v as (select docid, i, 0 as kind, {score("w")} as score, greatest(1, least(i - (23 - (coalesce(list_max(w), i) - i)) // 2, n - 23)) as f from r
  union all select docid, i, 1, {score(inside("a"))} + case when a = 1 then 120 else 100 end, a from r where n > 24 and a < i),
b as (select docid, arg_max(f, score * 100000000 - 2 * i - kind) as f from v group by docid),
e as (select docid, o, t, g, n, f, least(n, f + 23) as l, list_transform(range(1, n + 1), lambda i: case when t[i] in ('worthless', 'disgusting') then '[' || o[i] || ']' else o[i] end) as w from s join b using (docid))
select docid, case when f > 1 then ' ... ' else g[1] end || array_to_string(list_transform(range(f, l + 1), lambda i: w[i] || case when i < l then g[i + 1] else '' end), '') || case when l < n then ' ... ' else g[n + 1] end as snippet from e"""


def search_hits(spark, sf_dir):
    """The eleven fields of hits, with the links to their places."""
    query = '"of the" NOT worthless'
    more = {"item_id": F.concat(F.lit("item-"), F.col("docid")), "kind": F.lit("text"), "reader_root": F.concat(F.lit("readers/"), F.col("collection_id")), "route": F.concat(F.lit("works/"), F.col("docid"), F.lit(".html#s"), F.col("docid"))}
    hits = search.search(index_of(spark, sf_dir), query, 50).withColumns(more)
    out = search.shown_hits(hits, corpus(spark, sf_dir), query, "/derived")
    return out.select("collection_id", "item_id", "representation_id", "title", "representation_label", "language", "kind", F.round("rank", 9).alias("rank"), "path", "fragment", "link")


def hits_sql() -> str:
    ranked = _sql([(["of", "the"], False, False, None), ONE("worthless")], "c0 > 0 and not c1 > 0").replace(f"limit {TOP}", "limit 50")
    return f"""with hit as ({ranked}) select collection_id, 'item-' || docid as item_id, docid::varchar as representation_id, split_part(text, chr(10), 1) as title, source as representation_label, language, 'text' as kind, rank,
 '/derived/readers/' || source || '/works/' || docid || '.html' as path, 's' || docid as fragment, 'file:///derived/readers/' || source || '/works/' || docid || '.html#s' || docid as link from hit join documents on doc_id = docid"""


def term_statistics(spark, sf_dir):
    return search.index_terms(index_of(spark, sf_dir))


TERMS_SQL = f"""with t as (select doc_id, unnest(list_concat(list_concat(regexp_extract_all(translate(lower(split_part(text, chr(10), 1)), '{FOLD_FROM}', '{FOLD_TO}'), '{TOKEN}'), regexp_extract_all(lower(source), '{TOKEN}')),
 regexp_extract_all(translate(lower(text), '{FOLD_FROM}', '{FOLD_TO}'), '{TOKEN}'))) as term from documents)
select term, count(distinct doc_id) as docs, count(*) as occurrences from t group by term"""


def posting_positions(spark, sf_dir):
    """Where every term stands in each column: how often, first, last, and the sum of the places."""
    p = index_of(spark, sf_dir).postings
    one = p.select("term", "col", F.size("positions").alias("n"), F.array_min("positions").alias("low"), F.array_max("positions").alias("high"), F.aggregate("positions", F.lit(0).cast("long"), lambda a, x: a + x).alias("s"))
    return one.groupBy("term", "col").agg(F.sum("n").alias("n"), F.min("low").alias("first"), F.max("high").alias("last"), F.sum("s").alias("places"))


_TOK = lambda e: f"regexp_extract_all(translate(lower({e}), '{FOLD_FROM}', '{FOLD_TO}'), '{TOKEN}')"
POSTINGS_SQL = f"""with t as (select 0 as col, {_TOK("split_part(text, chr(10), 1)")} as t from documents union all select 1, {_TOK("source")} from documents union all select 2, {_TOK("text")} from documents),
p as (select col, unnest(t) as term, unnest(range(0, len(t))) as pos from t)
select term, col, count(*) as n, min(pos) as first, max(pos) as last, sum(pos)::bigint as places from p group by all"""


def index_integrity(spark, sf_dir):
    """Documents that the index lacks, has too many of, or has with another digest."""
    d = corpus(spark, sf_dir).withColumn("body_sha256", F.sha2(F.when(F.col("docid") % 41 == 0, F.upper("body")).otherwise(F.col("body")), 256))
    index = d.where("docid % 37 <> 0").select("docid").unionByName(d.where("docid % 43 = 0").select((-F.col("docid") - 1).alias("docid")))
    return search.index_problems(d, index)


INTEGRITY_SQL = """select doc_id as docid, 'not indexed' as problem from documents where doc_id % 37 = 0 union all select -doc_id - 1, 'no document' from documents where doc_id % 43 = 0
union all select doc_id, 'digest' from documents where doc_id % 37 <> 0 and doc_id % 41 = 0 and upper(text) <> text"""

ONE = lambda t, **k: ([t], k.get("prefix", False), k.get("first", False), k.get("cols"))
QUERIES = {
    "search_bm25": (_run("disgusting worthless"), _sql([ONE("disgusting"), ONE("worthless")], "c0 > 0 and c1 > 0")),
    "search_phrase": (_run('"of the"'), _sql([(["of", "the"], False, False, None)], "c0 > 0")),
    "search_prefix": (_run("disg* OR path*"), _sql([ONE("disg", prefix=True), ONE("path", prefix=True)], "(c0 > 0 or c1 > 0)")),
    "search_filters": (_run("the", language=["en", "de"], collection_id=["src1", "src2", "src3"]), _sql([ONE("the")], "c0 > 0", "language in ('en', 'de') and collection_id in ('src1', 'src2', 'src3')")),
    "search_boolean": (_run("(idiot OR moron) NOT scum"), _sql([ONE("idiot"), ONE("moron"), ONE("scum")], "(c0 > 0 or c1 > 0) and not c2 > 0")),
    "search_near": (_run("body : NEAR(idiot the, 2)"), _sql([ONE("idiot", cols=["body"]), ONE("the", cols=["body"])], "c0 > 0", near=2)),
    "search_first_in_column": (_run("{title body} : ^the"), _sql([ONE("the", first=True, cols=["title", "body"])], "c0 > 0")),
    "search_column": (_run("representation_label : src7 AND body : de"), _sql([ONE("src7", cols=["representation_label"]), ONE("de", cols=["body"])], "c0 > 0 and c1 > 0")),
    "search_snippets": (snippets, snippets_sql()),
    "search_hits": (search_hits, hits_sql()),
    "term_statistics": (term_statistics, TERMS_SQL),
    "posting_positions": (posting_positions, POSTINGS_SQL),
    "index_integrity": (index_integrity, INTEGRITY_SQL),
}
