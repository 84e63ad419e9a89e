"""The whole pipeline, and the queries without SQL, against brute force on the smallest tables."""

import hashlib
import re
import struct
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
from tests.llm.test_operators import clusters, fingerprint, removed, rule_row, words
from tests.llm.test_near_copies import kept as near_kept
from vellumspark.llm import line_rules, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return [(r["doc_id"], r["text"] or "") for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def line_fails(line):
    n = len(words(line))
    return n > 0 and (
        len(re.findall(line_rules.SIGNS, line)) > n * line_rules.MAX_SIGN_SHARE
        or len(re.findall(line_rules.SEPARATORS, line)) > n * line_rules.MAX_SEPARATOR_SHARE
        or any(p in line.lower() for p in line_rules.PHRASES)
    )


def cleaned(text):
    """The text without its failing lines, or None if the document is rejected."""
    n, *_, covered = rule_row(text)
    good = "\n".join(x for x in text.split("\n") if not line_fails(x))
    if n < 20 or 100 * covered > 30 * n or len(text) - len(good) > len(text) * line_rules.MAX_LOST_SHARE:
        return None
    return good


def encoded(tokenizer, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    back = tokenizer.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def grams(text):
    w = [x for x in (re.sub(r"[\W_]+", "", y.lower()) for y in words(text)) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_pipeline(spark, documents, tokenizer):
    docs = [(i, c) for i, t in documents if (c := cleaned(t)) is not None]
    stay = set(near_kept(docs))
    docs = [(i, t) for i, t in docs if i in stay]
    cut = {i: (n, kept) for i, _, n, kept in removed(docs)}
    docs = [(i, cut[i][1] if cut[i][0] else t) for i, t in docs]
    items = [grams(r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    docs = [(i, t) for i, t in docs if not any(len(s & grams(t)) >= 0.8 * len(s) - 1e-9 for s in items)]
    want = sorted((i, *encoded(tokenizer, t)) for i, t in docs)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())
    assert got == want and len(want) > 50


def test_encoding_query(spark, documents, tokenizer):
    got = sorted(tuple(r) for r in queries.op9_lexicon_bpe(spark, SF).collect())
    assert got == sorted((i, *encoded(tokenizer, t)) for i, t in documents)


def test_simhash_query(spark, documents):
    fps = [fingerprint(t) for _, t in documents]
    comp = clusters(fps)
    want = []
    for (i, _), f, c in zip(documents, fps, comp):
        want.append((i, f"{f:016x}", min(d for (d, _), o in zip(documents, comp) if o == c)))
    assert sorted(tuple(r) for r in queries.op4_simhash_trie(spark, SF).collect()) == sorted(want)


def test_sharding_query(spark, documents):
    rows = queries.op2_histogram_sort(spark, SF).toPandas().set_index("doc_id")
    assert {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in documents} == {i: (r["size"], r.text_crc32) for i, r in rows.iterrows()}
    assert all(sorted(s) == list(range(len(s))) for _, s in rows.groupby("shard").slot) and set(rows.law) == {"bytes"} and rows.grown_shard.isna().all()
    sizes = rows.groupby("shard")["size"].sum()  # near equal, but for a document that no shard can share
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 2 * rows["size"].max()


def test_histogram_query(spark, documents, tokenizer):
    n = np.array([encoded(tokenizer, t)[0] for _, t in documents])
    every = queries.op3_token_histogram(spark, SF).collect()
    rows = [r for r in every if r["kind"] == "length"]
    assert {r["n_tokens"]: (r["docs"], r["tokens"], r["truncated_total"]) for r in every if r["kind"] == "limit"} == {x: ((n > x).sum(), n[n > x].sum(), np.minimum(n, x).sum()) for x in queries.LIMITS}
    assert {r["share"]: r["n_tokens"] for r in every if r["kind"] == "quantile"} == {q: np.sort(n)[int(np.ceil(q * len(n))) - 1] for q in queries.SHARES}
    assert [(r["docs"], r["tokens"]) for r in every if r["kind"] == "total"] == [(len(n), n.sum())]
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(n.tolist()))
    assert all(r["truncated_total"] == np.minimum(n, r["n_tokens"]).sum() and r["docs_at_least"] == (n >= r["n_tokens"]).sum() for r in rows)


@pytest.mark.parametrize("query, label", [(queries.op1_quality_fm, "quality"), (queries.op7_toxicity, "toxic")])
def test_classifier_queries(spark, query, label):
    sf = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r[label] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = query(spark, sf).collect()
    assert len(rows) == pq.read_metadata(f"{sf}/documents.parquet").num_rows
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == y for p, y in held]) > 0.95


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, c.sql(f"select {', '.join(columns)} from ({queries.oracle_sql()[name]})").fetchall()))


def test_every_stage_on_odd_tables(spark):
    """Nulls in any column, empty and long texts, repeated rows, columns with clashing names, and no rows at all."""
    text = " ".join(f"word{k}" for k in range(300)) + "."
    rows = [(None, None, None, None, None, 1, "x"), (1, "", "en", "s", 0, 1, "x"), (2, text, None, None, None, 1, "x"), (2, text, None, None, None, 1, "x"), (None, text + " more", "en", None, 7, 1, "x"), (3, "plain words stand here. " * 20_000, "en", "s", 5, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, _gone string")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, docs.limit(0)):
            out = stage(spark, table, "/root/testdata/sf0.001")
            n = out.count()
            last = name == corpus_pipeline.STAGES[-1][0]
            assert last or out.columns == corpus_pipeline.COLUMNS, name
            assert n <= table.count() and (n or table is not docs or name == "quality rules"), name
