"""Snippets against those of SQLite's full-text index, on random texts and queries."""

import random
import sqlite3

import pytest

from vellumspark.operators import search
from vellumspark.operators.query_language import parse
from vellumspark.operators.snippet import marks, snippet

WORDS = ["river", "mill", "old", "stone", "rivet", "Śiva", "x2", "the", "and", "of"] + [f"w{i}" for i in range(25)]
ENDS = [" "] * 12 + [". ", ": ", ".\n", "; ", ".", ":", "  ", " . ", ".\t"]
QUERIES = [
    "river", "river OR mill OR old", '"old river"', "riv*", '"old riv" *', "river mill", '"the old" OR stone', "NEAR(old mill, 3)", "NEAR(river mill stone, 8)", 'NEAR("old river" the)', "(old OR stone) AND river", "river NOT stone",
    "old + river", "body : river", "ŚIVA OR of", "title : mill OR river", "(old stone) OR of", "^river OR mill", "riv* OR river", '"the the" OR the', "NEAR(riv* old, 2) OR stone",
]


def passage(r, n, words):
    out = r.choice(["", " ", ". ", "— "])
    for _ in range(n):
        out += r.choice(words) + r.choice(ENDS)
    return out.rstrip() if r.random() < 0.5 else out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    return [(i, passage(r, r.randint(0, 4), WORDS), passage(r, 2, WORDS), passage(r, r.choice([0, 3, 20, 24, 25, 60, 200]), WORDS[: r.choice([8, 20, 35])])) for i in range(1000)]


@pytest.fixture(scope="module")
def fts(rows):
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table t using fts5(title, representation_label, body, tokenize='unicode61 remove_diacritics 0')")
    c.executemany("insert into t(rowid, title, representation_label, body) values (?, ?, ?, ?)", rows)
    return c


@pytest.mark.parametrize("query", QUERIES)
@pytest.mark.parametrize("width", [24, 5, 2])
def test_snippets_of_a_thousand_texts_equal_fts5(rows, fts, query, width):
    parsed, by_id = parse(query), {r[0]: r[1:] for r in rows}
    found = fts.execute("select rowid, snippet(t, 2, '[', ']', ' ... ', ?) from t where t match ?", (width, query)).fetchall()
    assert len(found) > 5
    for i, want in found:
        title, label, body = by_id[i]
        assert snippet(parsed, {"title": title, "representation_label": label, "body": body}, "body", width, search.SNIPPET_SIGNS) == want


def test_snippets_of_rows(spark, rows, fts):
    hits = spark.createDataFrame([(i, t, lab, b, "x") for i, t, lab, b in rows[:150]], "docid int, title string, representation_label string, body string, snippet string")
    want = dict(fts.execute("select rowid, snippet(t, 2, '[', ']', ' ... ', 24) from t where t match 'river OR \"old mill\"'"))
    got = {r["docid"]: r["snippet"] for r in search.snippets(hits, 'river OR "old mill"').collect()}
    assert len(got) == 150 and all(got[i] == w for i, w in want.items() if i < 150)


def test_only_parts_that_hold_are_marked():
    q = parse("(old AND mill) OR stone")
    assert marks(q, {"title": [], "body": ["old", "stone"]}, "body") == [(1, 2)]
    assert snippet(q, {"body": ""}, "body", 24, search.SNIPPET_SIGNS) == ""
