"""Near copies by five-word similarity, against brute force."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_operators import clusters, fingerprint, words
from vellumspark.llm import simhash_trie

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = words((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def kept(rows):
    """Ids that stay, by comparing all pairs."""
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if similarity(rows[i][1], rows[j][1]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                top[b] = a
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted(i for k, (i, _) in enumerate(rows) if least[find(k)] == i)


@pytest.fixture(scope="module")
def planted():
    """Unlike texts, each with copies in which one word or several are changed."""
    r, out = np.random.default_rng(3), []
    for _ in range(40):
        base = [f"w{k}" for k in r.integers(0, 3000, 120)]
        out.append(" ".join(base))
        for changes in (1, 2, 3, 6):
            copy = list(base)
            for at in r.choice(120, changes, replace=False):
                copy[at] = f"x{r.integers(0, 10**6)}"
            out.append(" ".join(copy))
    order = r.permutation(len(out))
    return [(int(i), out[k]) for i, k in enumerate(order)]


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    return sorted((r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=lambda i: (i is None, i))


def test_planted_near_copies(spark, planted):
    want = kept(planted)
    four_bits = clusters([fingerprint(t) for _, t in planted])
    assert len(set(four_bits)) > len(want)  # the fingerprints of op4 don't reach these copies
    assert stage(spark, planted) == want


def test_odd_rows(spark):
    text = " ".join(f"v{k}" for k in range(60))
    other = " ".join(f"u{k}" for k in range(60))
    rows = [(5, text), (2, text.upper()), (2, text), (2, text), (None, other), (7, None), (8, ""), (9, "a b"), (4, "A  b"), (6, "b a")]
    assert stage(spark, rows) == [2, 4, 6, 7, None]  # one row of a group, also where rows share the id
    assert stage(spark, rows[:0]) == []


def test_second_round_connects(spark):
    """A chain in which the ends are less alike than 0.8 is one group."""
    words_ = [f"c{k}" for k in range(200)]
    chain = [" ".join([f"d{k}" for k in range(j)] + words_[j:]) for j in range(0, 60, 6)]
    assert similarity(chain[0], chain[-1]) < 0.8
    assert stage(spark, list(enumerate(chain))) == [0]
    assert simhash_trie.SIMILARITY == 0.8


def test_null_and_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(50)) for x in "abc")
    rows = [(1, a), (None, a), (None, b), (4, c), (4, c + " more"), (4, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str)
    assert [x[0] for x in got] == [1, 4, 4] and {t.split(" ")[0] for _, t in got} == {"a0", "b0", "c0"}


@pytest.mark.parametrize("chunk", [20, 100_000])
def test_chunks_and_columns(spark, planted, chunk):
    docs = spark.createDataFrame([(i, t, "x", i, 1) for i, t in planted], "doc_id long, text string, uid string, row int, label int")
    out = simhash_trie.near_duplicates(docs, chunk)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == kept(planted)


def test_long_fingerprints():
    """Against a count of bits, one by one."""
    g, at = simhash_trie.sets(pa.array(["a b c d e f g h", "", "a b", "a b c d e f g i"]))
    got = simhash_trie.long_fingerprints(g, at)
    for k in range(4):
        own = g[at[k] : at[k + 1]]
        lanes = [simhash_trie.mixed(own + np.uint64((x + 1) * simhash_trie.FACTOR & (1 << 64) - 1)) for x in range(8)]
        want = [2 * sum(int(h) >> b & 1 for h in lane.tolist()) > len(own) for lane in lanes for b in (8 * y + 7 - z for y in range(8) for z in range(8))]
        assert np.unpackbits(got[k]).astype(bool).tolist() == want


def test_columns_named_like_working_ones(spark):
    """Columns pass through whatever they are called, and are never taken for the operator's own."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(1, base, 5, 6, 7, 8, 9), (2, base + " x", 5, 6, 7, 8, 9), (3, "other words stand here and there", 5, 6, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _near_row int, gone int, near_row int, GONE_ int")
    out = simhash_trie.near_duplicates(docs)
    assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect()) == [rows[0], rows[2]]


def test_recall_at_the_threshold(spark):
    """Of planted pairs with a similarity just above 0.8, at least 0.98 are caught; pairs well below it are left alone."""
    r, rows, n = np.random.default_rng(11), [], 150
    for k in range(n):
        size = int(r.integers(40, 400))
        words = [f"v{x}" for x in r.integers(0, 50_000, size + 4)]
        swaps = lambda share: max(1, int(share * size / 5))  # noqa: E731  each word changed alone touches five shingles
        for j, share in enumerate((0.0, 0.105, 0.45)):
            other = list(words)
            if share:
                at = r.choice(np.arange(2, size, 5), swaps(share), replace=False)
                for a in at:
                    other[a] = f"n{k}x{a}"
            rows.append((3 * k + j, " ".join(other)))
    sets = {i: {tuple(w[a : a + 5]) for a in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    close = [k for k in range(n) if alike(3 * k, 3 * k + 1) >= 0.8]
    assert len(close) > n * 0.7 and all(alike(3 * k, 3 * k + 2) < 0.8 for k in range(n))
    left = {row["doc_id"] for row in simhash_trie.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(3 * k in left and 3 * k + 2 in left for k in range(n))
    assert sum(3 * k + 1 not in left for k in close) >= 0.98 * len(close)
