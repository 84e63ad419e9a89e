"""The query language and ranking, on small texts and against SQLite's own full-text index."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import search
from vellumspark.operators.query_language import QueryError, parse, tokenize

ROWS = [
    (1, "River songs", "A", "the river runs past the old mill and the river sleeps"),
    (2, "Mill", "B", "an old mill by the river"),
    (3, "Śiva hymn", "A", "śiva dances; the dancer of the north"),
    (4, "Empty", "C", ""),
    (5, "Numbers", "B", "old old old river mill 42 x-ray"),
    (6, "Phrase", "A", "by the old river mill we sat and by the mill we wept"),
]
QUERIES = ["river", "old river", '"old river"', "riv*", "river OR siva", "river NOT mill", "title : mill", "{title body} : old", "NEAR(old mill, 1)", "NEAR(river mill)", "^the", "(old OR dances) AND river", "old + river", "ŚIVA", "- body : river", "river mill NOT wept"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "docid int, title string, representation_label string, body string")
    return search.tokenized(df.withColumns({"collection_id": F.lit("c"), "representation_id": F.col("docid").cast("string")})).cache()


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(ROWS, "docid int, title string, representation_label string, body string")
    return search.write_index(df.withColumns({"collection_id": F.lit("c"), "representation_id": F.col("docid").cast("string")}), f"file://{tmp_path_factory.mktemp('index')}/i")


@pytest.fixture(scope="module")
def fts():
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(title, representation_label, body, tokenize='unicode61 remove_diacritics 0')")
    c.executemany("insert into t(rowid, title, representation_label, body) values (?, ?, ?, ?)", ROWS)
    return c


@pytest.mark.parametrize("query", QUERIES)
def test_index_ranks_like_fts5(index, fts, query):
    want = {r: pytest.approx(x, abs=1e-9) for r, x in fts.execute("select rowid, bm25(t, 8, 3, 1) from t where t match ?", (query,))}
    assert {r["docid"]: r["rank"] for r in search.search(index, query, 50).collect()} == want


def test_index_filters(index, docs):
    some = {r["docid"]: r["rank"] for r in search.search(index, "river", 50, representation_label=["B"], docid=[]).collect()}
    assert some == {r["docid"]: r["rank"] for r in search.search(docs, "river", 50).collect() if r["docid"] in (2, 5)}


def test_only_the_terms_are_read(index):
    plan = search.search(index, "riv* mill", 5)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,riv)" in plan and "EqualTo(term,mill)" in plan


def test_snippets_of_folded_letters(spark):
    hits = spark.createDataFrame([(1, "ΟΔΟΣ und İdiot, idiot here"), (2, "Straſſe ςidiot IDIOT")], "docid int, body string")
    assert [r["snippet"] for r in search.snippets(hits, "idiot").orderBy("docid").collect()] == ["ΟΔΟΣ und İdiot, [idiot] here", "Straſſe ςidiot [IDIOT]"]


@pytest.mark.parametrize("query", QUERIES)
def test_matches_and_ranks_like_fts5(docs, fts, query):
    want = {r: pytest.approx(x, abs=1e-9) for r, x in fts.execute("select rowid, bm25(t, 8, 3, 1) from t where t match ?", (query,))}
    got = {r["docid"]: r["rank"] for r in search.search(docs, query, 50).collect()}
    assert got == want


@pytest.mark.parametrize("query", ["", "   ", "a AND", "OR a", '"open', "(a", "a)", "no_such : a", "NEAR(a b, x)", "a\tb", "x" * 1025])
def test_malformed_queries_are_errors(query):
    with pytest.raises(QueryError):
        parse(query)


@pytest.mark.parametrize("limit", [0, 101, True, "3"])
def test_limit_is_checked(docs, limit):
    with pytest.raises(QueryError):
        search.search(docs, "river", limit)


def test_filters_agree_and_statistics_stay_global(docs):
    everywhere = {r["docid"]: r["rank"] for r in search.search(docs, "river", 50).collect()}
    some = {r["docid"]: r["rank"] for r in search.search(docs, "river", 50, representation_label=["B"], docid=[]).collect()}
    assert some == {k: v for k, v in everywhere.items() if k in (2, 5)}


def test_tokens():
    assert tokenize("Ünïcode—words, x2 and क्षत्रिय") == ["ünïcode", "words", "x2", "and", "क", "षत", "र", "य"]


def test_snippet_marks_phrases(docs):
    hits = search.search(docs, '"old river"', 5)
    assert {r["snippet"] for r in search.snippets(hits, '"old river"').collect()} == {"by the [old river] mill we sat and by the mill we wept", "old old [old river] mill 42 x-ray"}


def test_index_tables(docs):
    assert search.postings(docs).where("term = 'mill'").count() == 6
    assert search.term_stats(docs).where("term = 'old'").first().asDict() == {"term": "old", "docs": 4, "occurrences": 6}
