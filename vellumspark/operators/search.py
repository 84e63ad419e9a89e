"""Ranked full-text search with filters, over a written index or over tokenised documents.

``write_index`` tokenises documents once and writes a row for each term, document and column with
the positions, dealt by ranges of terms and sorted, so that files and row groups tell which terms
they hold; beside it the facts that filters and ranks need, and the corpus's statistics. A search
reads the rows of its terms only (an equality or a prefix pushed down to the files), joins
their positions by document, and ranks; texts are read for no more than the hits shown.

Small corpora can be searched without an index: ``search`` takes what ``tokenized`` returns as well.
Statistics are those of the whole corpus; filters apply after them.
"""

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.functions.text import tokens
from vellumspark.operators.query_language import Phrase, Query, QueryError, parse
from vellumspark.operators.snippet import snippet
from vellumspark.sources.shared import written

# The searched columns with their weights, and the parameters of BM25.
WEIGHTS = {"title": 8.0, "representation_label": 3.0, "body": 1.0}
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SNIPPET_TOKENS, SNIPPET_SIGNS = 24, ("[", "]", " ... ")


def tokenized(docs: DataFrame) -> DataFrame:
    """``docs`` with arrays t_title, t_representation_label and t_body, and their length n_tokens."""
    out = docs.select("*", *[tokens(F.col(c)).alias(f"t_{c}") for c in WEIGHTS])
    return out.withColumn("n_tokens", sum((F.size(f"t_{c}") for c in WEIGHTS), F.lit(0)))


def starts(array: Column, phrase: Phrase) -> Column:
    """Positions (from 0) at which a phrase starts in an array of tokens."""
    n = len(phrase.tokens)
    if not n:
        return F.array().cast("array<int>")

    def here(words: Column):
        def at(word: Column, i: Column) -> Column:
            ok = F.lit(True)
            for k, t in enumerate(phrase.tokens):
                w = word if k == 0 else F.coalesce(F.get(words, i + k), F.lit(""))
                ok = ok & (w.startswith(t) if phrase.prefix and k == n - 1 else w == t)
            return F.when(ok & (i == 0) if phrase.first else ok, i)

        return at

    # bound as a lambda's variable, else the tokens would be made anew for each word
    return F.element_at(F.transform(F.array(array), lambda words: F.array_compact(F.transform(words, here(words)))), 1)


def _window(arrays: list[list[Column]], c: int, phrase: Phrase, distance: int):
    """Whether all phrases stand in column c within reach of a start of ``phrase``."""
    reach = len(phrase.tokens) + distance
    return lambda s: reduce(lambda a, b: a & b, [F.exists(o[c], lambda x: (x >= s) & (x <= s + reach)) for o in arrays])


def near(arrays: list[list[Column]], phrases: list[Phrase], distance: int) -> Column:
    """Whether in some column all phrases stand with at most ``distance`` tokens between the end
    of the first and the start of the last. ``arrays``: starts by phrase, then by column."""
    hits = [F.exists(arrays[j][c], _window(arrays, c, p, distance)) for c in range(min(len(a) for a in arrays)) for j, p in enumerate(phrases)]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


def near_starts(arrays: list[list[Column]], phrases: list[Phrase], distance: int, k: int, c: int) -> Column:
    """The starts of phrase k in column c that belong to such a place."""

    def counted(x: Column) -> Column:
        def by(j: int, p: Phrase):
            reach = len(p.tokens) + distance
            return F.exists(arrays[j][c], lambda s: (x >= s) & (x <= s + reach) & _window(arrays, c, p, distance)(s))

        return reduce(lambda a, b: a | b, [by(j, p) for j, p in enumerate(phrases)])

    return F.filter(arrays[k][c], counted)


class Index:
    """An index in a folder: documents (facts, no texts), postings and statistics."""

    def __init__(self, spark: SparkSession, folder: str):
        self.documents, self.postings, self.statistics = (spark.read.parquet(f"{folder}/{t}") for t in ("documents", "postings", "statistics"))


def grouped_positions(docs: DataFrame, key: str) -> DataFrame:
    """term, key, col and positions of every distinct token of a document's column."""

    def run(batches):
        for batch in batches:
            for c, name in enumerate(WEIGHTS):
                lists = batch.column(f"t_{name}")
                n = np.diff(lists.offsets.to_numpy())
                own, flat = np.repeat(np.arange(len(n)), n), lists.flatten().dictionary_encode()
                code, size = flat.indices.to_numpy(), max(len(flat.dictionary), 1)
                at = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
                both = own * size + code
                order = np.argsort(both, kind="stable")
                first = np.flatnonzero(np.append(True, both[order][1:] != both[order][:-1])) if len(order) else np.empty(0, np.int64)
                positions = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(at[order], pa.int32()))
                head = order[first]
                yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(code[head])), batch.column(key).take(pa.array(own[head])), pa.array(np.full(len(head), c), pa.int8()), positions], ["term", key, "col", "positions"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, *[f"t_{c}" for c in WEIGHTS]).mapInArrow(run, f"term string, {key} {kind}, col byte, positions array<int>")


def write_index(docs: DataFrame, folder: str, key: str = "docid") -> Index:
    """Index the columns of ``WEIGHTS``; the other columns are kept to filter and to show. A frequent
    term is dealt over several files, by document."""
    spark = docs.sparkSession
    made = written(tokenized(docs).drop("body"))
    facts = made.drop(*[f"t_{c}" for c in WEIGHTS])
    facts.write.parquet(f"{folder}/documents")
    rows = written(grouped_positions(made, key))  # the ranges are found in one pass and dealt in another
    rows.repartitionByRange("term", key).sortWithinPartitions("term", key).write.option("parquet.block.size", 8 << 20).parquet(f"{folder}/postings")
    facts.agg(F.count("*").alias("_n"), F.avg("n_tokens").alias("_avg")).coalesce(1).write.parquet(f"{folder}/statistics")
    return Index(spark, folder)


def _in_index(index: Index, q: Query, cols: list[list[str]], key: str) -> DataFrame:
    """key and the starts of each phrase (_at0, _at1, ...: an array for each of its columns) of the
    documents that hold any of the query's terms."""
    names = list(WEIGHTS)
    fits = lambda p, j: F.col("term").startswith(p.tokens[j]) if p.prefix and j == len(p.tokens) - 1 else F.col("term") == p.tokens[j]
    terms = [fits(p, j) for p in q.phrases for j in range(len(p.tokens))]
    rows = index.postings.where(reduce(lambda a, b: a | b, terms, F.lit(False)))
    shifted = lambda j: F.transform("positions", lambda x: x - j)
    parts, uses = [], {}
    for k, (p, cs) in enumerate(zip(q.phrases, cols)):
        for c in cs:
            for j in range(len(p.tokens)):
                uses[k, c, j] = f"_p{len(parts)}"
                here = F.when(fits(p, j) & (F.col("col") == names.index(c)), shifted(j))
                parts.append(F.flatten(F.collect_list(here)).alias(uses[k, c, j]))
    found = rows.groupBy(key).agg(F.lit(1).alias("_one"), *parts)  # a document's own positions, however often a term is written
    at = []
    for k, (p, cs) in enumerate(zip(q.phrases, cols)):
        starts_ = []
        for c in cs:
            arrays = [F.col(uses[k, c, j]) for j in range(len(p.tokens))]
            one = F.array_sort(reduce(F.array_intersect, arrays)) if arrays else F.array().cast("array<int>")
            starts_.append(F.filter(one, lambda x: x == 0) if p.first else one)
        at.append(F.array(*starts_).alias(f"_at{k}") if starts_ else F.array(F.array().cast("array<int>")).alias(f"_at{k}"))
    return found.select(key, *at)


def search(docs: DataFrame | Index, query: str, limit: int = 10, tie: tuple = ("collection_id", "representation_id"), key: str = "docid", **filters: list) -> DataFrame:
    """The top ``limit`` documents by rank (ascending, best first), then by ``tie``.

    ``docs`` is an index, or what ``tokenized`` returns. Filters are lists of values by column: any value
    of a column will do, all columns must agree, an empty list does not filter. Statistics are those
    of all documents, filtered or not."""
    if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= 100:
        raise QueryError("the limit is 1 to 100")
    q: Query = parse(query, tuple(WEIGHTS))
    cols = [[c for c in WEIGHTS if p.columns is None or c in p.columns] for p in q.phrases]
    k = len(q.phrases)
    has = lambda k: F.exists(f"_at{k}", lambda a: F.size(a) > 0)
    matched = [F.count_if(has(i)).alias(f"_n{i}") for i in range(k)]
    if isinstance(docs, Index):
        base = _in_index(docs, q, cols, key)
        stats = base.agg(*matched).crossJoin(docs.statistics)  # two single rows
    else:
        at = [[starts(F.col(f"t_{c}"), p) for c in cs] for p, cs in zip(q.phrases, cols)]
        base = docs.select("*", *[F.array(*a).alias(f"_at{k}") if a else F.array(F.array().cast("array<int>")).alias(f"_at{k}") for k, a in enumerate(at)])
        stats = base.agg(F.count("*").alias("_n"), F.avg("n_tokens").alias("_avg"), *matched)
    lists = lambda k: [F.get(f"_at{k}", F.lit(i)) for i in range(len(cols[k]))]
    groups = {k: node for node in _near_nodes(q.tree) for k in node[1]}

    def count(k: int) -> Column:
        """Weighted occurrences; of a phrase in a NEAR group those that are near the others."""
        found = lists(k)
        if k in groups:
            _, members, distance = groups[k]
            found = [near_starts([lists(m) for m in members], [q.phrases[m] for m in members], distance, members.index(k), c) for c in range(len(found))]
        return sum((F.size(f) * WEIGHTS[c] for f, c in zip(found, cols[k])), F.lit(0.0))

    def matches(tree) -> Column:
        kind = tree[0]
        if kind == "group":
            return matches(tree[1])
        if kind == "phrase":
            return has(tree[1])
        if kind == "near":
            return near([lists(k) for k in tree[1]], [q.phrases[k] for k in tree[1]], tree[2])
        left, right = matches(tree[1]), matches(tree[2])
        return left | right if kind == "or" else left & ~right if kind == "not" else left & right

    hits = base.where(matches(q.tree))
    facts = docs.documents if isinstance(docs, Index) else hits
    for name, values in filters.items():
        if values:
            facts = facts.where(F.col(name).isin(list(values)))
    hits = hits.join(facts, key) if isinstance(docs, Index) else facts
    joined = hits.crossJoin(F.broadcast(stats))  # one row
    rank = F.lit(0.0)
    for i in range(k):
        f = count(i)
        idf = F.ln((F.col("_n") - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
        rank = rank - idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n_tokens") / F.col("_avg")))
    private = [c for c in joined.columns if c.startswith("_")]
    return joined.withColumn("rank", rank).drop(*private).orderBy("rank", *tie).limit(limit)


# What a hit shows, beside its file.
HIT = ["collection_id", "item_id", "representation_id", "title", "representation_label", "language", "kind", "rank", "snippet", "path", "fragment"]


def shown_hits(hits: DataFrame, texts: DataFrame, query: str, root: str, key: str = "docid") -> DataFrame:
    """The eleven fields of each hit, with a snippet of its text (key, body), and the link to its place in
    an unchanging file below ``root``. At most 100 hits, so they are sent to the texts."""
    from vellumspark.functions.urls import file_uri, route_fragment, route_path

    own = texts.select(key, "body").join(F.broadcast(hits), key)
    path = F.concat(F.lit(root.rstrip("/") + "/"), F.col("reader_root"), F.lit("/"), route_path(F.col("route")))
    out = snippets(own, query).withColumns({"path": path, "fragment": route_fragment(F.col("route"))})
    return out.select(*HIT, file_uri(F.col("path"), F.col("fragment")).alias("link")).orderBy("rank", "collection_id", "representation_id")


def _near_nodes(tree: tuple) -> list[tuple]:
    if tree[0] == "near":
        return [tree]
    return [n for part in tree[1:] if isinstance(part, tuple) for n in _near_nodes(part)]


def snippets(hits: DataFrame, query: str, body: str = "body") -> DataFrame:
    """The found rows with a snippet of the body. ``hits`` may bear the other searched columns too; those it
    lacks count as empty. Runs on the top rows only."""
    parsed, others = parse(query), [c for c in WEIGHTS if c != "body" and c in hits.columns]

    @F.pandas_udf("string")
    def cut(texts: pd.DataFrame) -> pd.Series:
        rows = texts.fillna("").to_dict("records")
        return pd.Series([snippet(parsed, r, "body", SNIPPET_TOKENS, SNIPPET_SIGNS) for r in rows], dtype=object)

    return hits.withColumn("snippet", cut(F.struct(F.col(body).alias("body"), *others)))


def postings(docs: DataFrame, key: str = "docid") -> DataFrame:
    """term, docid, col and pos of every token of ``tokenized`` documents."""
    parts = [docs.select(key, F.lit(i).alias("col"), F.posexplode(f"t_{c}").alias("pos", "term")) for i, c in enumerate(WEIGHTS)]
    return reduce(DataFrame.unionByName, parts).select("term", key, "col", "pos")


def term_stats(docs: DataFrame, key: str = "docid") -> DataFrame:
    """Documents and occurrences of each term, counted once per document before the exchange."""
    words = F.flatten(F.array(*[F.col(f"t_{c}") for c in WEIGHTS]))
    per_doc = docs.select(key, F.explode(words).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))
    return per_doc.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


def index_terms(index: Index) -> DataFrame:
    """Documents and occurrences of each term of an index, which is dealt by terms already."""
    per_doc = index.postings.groupBy("term", "docid").agg(F.sum(F.size("positions")).alias("tf"))
    return per_doc.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("occurrences"))


def index_problems(docs: DataFrame, index: DataFrame, key: str = "docid") -> DataFrame:
    """Documents without an index row, and the other way round, and bodies whose digest changed."""
    left = docs.select(key, F.sha2("body", 256).alias("actual"), F.col("body_sha256").alias("stated"))
    right = index.select(key).withColumn("_in", F.lit(True))
    j = left.join(right, key, "full_outer")
    problem = F.when(F.col("_in").isNull(), "not indexed").when(F.col("stated").isNull(), "no document").when(F.col("actual") != F.col("stated"), "digest")
    return j.select(key, problem.alias("problem")).where("problem is not null")
