"""Filter audit, Re-Pair files and block-max search against brute-force versions and at their edges."""

import math
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from vellumspark.llm import block_max, filter_audit, queries, repair_grammar
from vellumspark.llm._store import shared_dir

SF = "/root/testdata/sf0.001"
WORD, TERM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
CONFIG = open(BYTES, encoding="utf-8").read()
STRANGE = ["", " ", "  a", "a  b", "a \n b", "a  b", "a  b", "a   b", " 　x", "x<|endoftext|> y", "don't I'LL  go", "\x1c \x1c", "\x85 a \x85", "é É́ ﬁ \U0001f600 \U0001f600", "Tab\t x", "trail ", "trail  \n", "#2 # ##", "a" * 3000, " x" * 900]


def prose(n, seed):
    r = np.random.default_rng(seed)
    syl = ["the", "er", "on", "Ä", "re", "st", "Of", "ly", "#1", "a7"]
    return " ".join("".join(syl[i] for i in r.integers(0, len(syl), 2)) for _ in range(n))


def texts():
    long = prose(20_000, 1)
    return [None, *STRANGE, *[prose(40, s) for s in range(30)], prose(40, 3), prose(40, 3), prose(250, 5), long, "THE the " * 300, "\n".join([prose(9, 8)] * 40)]


@pytest.fixture(scope="module")
def docs(spark):
    """Clashing names, a repeated row, two rows with one id, null ids."""
    rows = [(i, t, ["en", "de", None][i % 3], 1, "x", "y") for i, t in enumerate(texts())]
    rows += [rows[25], (25, "another text of that id", "en", 1, "x", "y"), (None, prose(40, 3), "de", 1, "x", "y"), (None, None, "", 1, "x", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, mask int, digest string, start string").repartition(4).cache()


@pytest.fixture(scope="module")
def rows(docs):
    return [(r["doc_id"], r["text"] or "", r["lang"] or "") for r in docs.collect()]


# filter audit


def brute_audit(rows, labels):
    least = {}
    for i, t, _ in rows:
        i = math.inf if i is None else i
        least[t] = min(least.get(t, math.inf), i)
    out = {}
    for i, t, part in rows:
        w = re.findall(WORD, t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": (math.inf if i is None else i) > least[t]}
        good, toxic = labels.get(i, (0, 0))
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                c = out.setdefault((part, "".join(order), step), Counter())
                c["kept"] += not gone and not fails[f]
                c["removed"] += not gone and fails[f]
                c["redundant"] += gone and fails[f]
                c["unique_fails"] += fails[f] and sum(fails.values()) == 1
                c["good_lost"] += good if not gone and fails[f] else 0
                c["toxic_lost"] += toxic if not gone and fails[f] else 0
                gone = gone or fails[f]
    total = Counter()
    for (part, order, step), c in out.items():
        total[part, order[step - 1]] += c["removed"]
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {(*k, *(c[n] for n in names), total[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def test_audit_equals_brute_force(spark, docs, rows):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 1), (25, 1, None), (30, 1, 1), (None, 1, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    counts = filter_audit.cells(docs, labels, F.col("lang"), filter_audit.text_filters(F.col("text")))
    got = filter_audit.audit(counts, "ABCDE").drop("filter")
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r) for r in got.collect()} == brute_audit(rows, {3: (1, 1), 25: (1, 0), 30: (1, 1)})


def test_audit_of_own_filters_and_orders(spark):
    docs = spark.createDataFrame([(1, "a", 5), (2, "a", 5), (3, "b", 9)], "doc_id long, text string, size int")
    labels = spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")
    counts = filter_audit.cells(docs, labels, F.lit("all"), {"S": F.col("size") > 8})
    got = filter_audit.audit(counts, "SE", ["ES"]).orderBy("step").collect()
    assert [tuple(r)[2:] for r in got] == [(1, "E", 2, 1, 0, 1, 1, 0, 1), (2, "S", 1, 1, 0, 1, 0, 0, 1)]


def test_audit_of_nothing_and_of_many_copies(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    cells = lambda d: filter_audit.cells(d, labels, F.col("lang"), filter_audit.text_filters(F.col("text")))
    assert filter_audit.audit(cells(none), "ABCDE").count() == 0
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.lit("en").alias("lang"))
    assert {(r["mask"], r["n"]) for r in cells(many).collect()} == {(0b00001, 1), (0b10001, 4999)}


# Re-Pair files


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(BYTES)


def ids_of(tokenizer, text):
    return tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list(" \n\t  \x85\x1cab'Tdllé.1#\U0001f600")), max_size=25), min_size=1, max_size=6))
def test_pieces_encode_as_the_library(parts):
    t, e = Tokenizer.from_file(BYTES), repair_grammar.PieceEncoder(CONFIG)
    parts = parts + ["a  ", "1", "\n\n", "b"]
    got, at = e.texts(pa.array(parts))
    assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(t, p) for p in parts]


def test_whole_texts_encode_as_the_library(tokenizer):
    e = repair_grammar.PieceEncoder(CONFIG)
    all_ = [t or "" for t in texts()] + [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet'").fetchall()]
    got, at = e.texts(pa.array(all_).slice(1))
    assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(tokenizer, t) for t in all_[1:]]


def test_other_tokenizers_encode_whole(tokenizer):
    path = public_tokenizers.path("word_bpe_49k.json")
    config = open(path, encoding="utf-8").read()
    assert repair_grammar.cuts_before_space(CONFIG) and not repair_grammar.cuts_before_space(config)
    got, at = repair_grammar.PieceEncoder(config).texts(pa.array(STRANGE))
    other = Tokenizer.from_file(path)
    other.no_truncation(), other.no_padding()
    assert [got[a:b].tolist() for a, b in zip(at, at[1:])] == [ids_of(other, t) for t in STRANGE]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 6), st.integers(1, 3000), st.sampled_from([1, 70_000, 4_000_000]))
def test_grammar_round_trip_and_random_access(seed, symbols, n, scale):
    r = np.random.default_rng(seed)
    ids = (r.integers(0, symbols, n) * scale).astype(np.uint32)
    ends = np.array([0, *sorted(r.integers(0, n + 1, 3).tolist()), n])
    block = repair_grammar.Block(repair_grammar.packed(ids, ends))
    assert (block.all() == ids).all() and (block.ends == ends[1:]).all()
    assert all((block.span(a, b) == ids[a:b]).all() for a, b in ((0, n), (0, 1), (n - 1, n), (n // 3, n // 2 + 1), (n // 2, n // 2)))
    firsts = {int(e) for e in ends[1:-1]}  # no rule spans two documents
    stop = np.cumsum(block.spans(block.symbols)).tolist()
    assert firsts - {0, n} <= set(stop)


def test_grammar_shortens_and_keeps_pairs_apart():
    ids = np.tile(np.array([5, 6, 7, 8, 9, 5, 5, 5], np.uint32), 2000)
    alphabet, lefts, rights, seq = repair_grammar.compress(ids, np.array([0, len(ids)]))
    assert len(seq) < len(ids) / 50 and len(lefts) < 30
    assert repair_grammar.independent(np.array([1, 2, 4, 3]), np.array([2, 3, 1, 3]), np.array([9, 8, 7, 6]), 10) == [0, 3]


def test_block_that_was_damaged_is_refused():
    row = repair_grammar.packed(np.arange(50, dtype=np.uint32), np.array([0, 50]))
    with pytest.raises(ValueError):
        repair_grammar.Block(row | {"symbols": row["symbols"][:-2] + b"\x00\x00"}).all()


def test_files_hold_every_document_in_order(spark, docs, rows, tokenizer):
    path = shared_dir(spark)
    repair_grammar.write(docs, path, CONFIG, 2, block_ids=1000)
    got = repair_grammar.read_documents(spark, path).orderBy("start").collect()
    want = sorted(((i is not None, i if i is not None else 0, t) for i, t, _ in rows), key=lambda r: r[:2])
    assert [r["doc_id"] for r in got] == [i if known else None for known, i, _ in want]
    assert Counter((r["doc_id"], r["ids"]) for r in got) == Counter((i if known else None, np.array([*ids_of(tokenizer, t), 2], "<u4").tobytes()) for known, i, t in want)
    stream = b"".join(r["ids"] for r in got)
    assert [r["start"] for r in got] == np.cumsum([0, *(len(r["ids"]) // 4 for r in got)])[:-1].tolist()
    all_ids = np.frombuffer(stream, "<u4").tolist()
    assert repair_grammar.blocks(spark, path).count() > 4
    for a, n in ((0, 5), (2990, 40), (len(all_ids) - 3, 99), (100, 9000), (len(all_ids), 5)):
        assert repair_grammar.read_span(spark, path, a, n) == all_ids[a : a + n]


def test_files_of_nothing(spark, docs):
    path = shared_dir(spark)
    repair_grammar.write(docs.limit(0), path, CONFIG, 2)
    assert repair_grammar.read_documents(spark, path).count() == 0 and repair_grammar.read_span(spark, path, 0, 9) == []


def test_op12_over_whole_tables(spark, tokenizer):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op12_repair_files(spark, SF).collect()}
    want, start = {}, 0
    for i, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall():
        raw = np.array([*ids_of(tokenizer, t or ""), 2], "<u4").tobytes()
        want[i] = (start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4
    assert got == want


# block-max search


def brute_search(rows, items, k):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    terms = lambda t: re.findall(TERM, (t or "").translate(lower))
    bags = [(i, Counter(terms(t))) for i, t, *_ in rows]
    bags = [(i, b) for i, b in bags if b]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        q = Counter(terms(text))
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in q}
        scores = []
        for i, b in bags:
            m = 25 + (75 * sum(b.values()) * n_docs) // n_terms
            s = sum(n * w[t] * ((1_000_000_000 * b[t]) // (1000 * b[t] + 8 * m)) for t, n in q.items() if t in b)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def found(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_search_equals_brute_force(spark, docs, rows, monkeypatch):
    items = [(0, prose(12, 3)), (1, None), (2, ""), (3, "never seen zzz"), (4, "the THE The"), (5, prose(40, 3)), (5, "onÄ #1 a7a7"), (None, prose(30, 9)), (6, "thethe " * 50 + "é"), (7, "\U0001f600")]
    table = spark.createDataFrame(items, "item_id long, text string").repartition(2)
    monkeypatch.setattr(block_max, "BLOCK_DOCS", 5)
    want = Counter(brute_search(rows, items, 10))
    assert found(block_max.rank_all(docs, table)) == want
    path, stats = shared_dir(spark), block_max.statistics(docs)
    block_max.build(docs, stats, path)
    assert found(block_max.search(path, stats, table, batch_terms=20)) == want  # many batches
    assert found(block_max.search(path, stats, table, k=2)) == Counter(brute_search(rows, items, 2))


def test_search_of_nothing(spark, docs):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert block_max.rank_all(docs.limit(0), items).count() == 0
    assert block_max.rank_all(docs, items.limit(0)).count() == 0
    assert block_max.rank_all(docs, items.where("false").unionByName(spark.createDataFrame([(1, "!!")], "item_id long, text string"))).count() == 0


def test_blocks_below_the_threshold_are_not_scored(spark):
    """Rare words stand in few blocks: all others are pruned, and the hits stay the same."""
    rows = [(i, prose(50, i) + (f" rare{i // 100}" * 3 if i % 100 < 12 else "")) for i in range(2000)]
    path = shared_dir(spark)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    stats = block_max.statistics(docs)
    block_max.build(docs, stats, path)
    batch = spark.read.parquet(path).toArrow().combine_chunks().to_batches()[0]
    names = ["ly#1", "rare7"]
    q = block_max.Queries(names, [0, 2], [0, 1], [1, 1]).weighted(np.array([300, 5000]))
    s = block_max.Searcher(q, 10, np.zeros(1, np.int64))
    s.take(batch)
    assert s.seen == batch.num_rows and s.scored < s.seen / 5
    every = block_max.Searcher(q, 2000, np.zeros(1, np.int64))
    every.take(batch)
    assert s.rows() == every.rows()[:10]
