"""Budgets other than the registered query's."""

import numpy as np
import pytest

from tests.llm.test_operators import clusters
from vellumspark.llm import simhash_trie
from vellumspark.llm._graph import components


@pytest.mark.parametrize("budget", [2, 7])
def test_links_of_any_budget(spark, budget):
    r = np.random.default_rng(2)
    values = set()
    for b in r.integers(0, 1 << 63, 40, dtype=np.uint64).tolist():
        # a bit in each of the five blocks of budget 4, and two more in some
        values |= {b, b ^ sum(1 << k for k in (2, 15, 28, 41, 54)), b ^ sum(1 << k for k in (3, 16, 29, 42, 55, 60, 1))}
    values = sorted(values)
    u = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    root = {row["node"] % (1 << 64): row["root"] for row in components(simhash_trie.links(u, budget)).collect()}
    want, got = {}, {}
    for v, c in zip(values, clusters(values, budget)):
        want.setdefault(c, set()).add(v)
        got.setdefault(root.get(v, ("alone", v)), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_layout():
    orders, shared = simhash_trie.layout(4)
    assert len(orders) == 5 and shared == 12 and all(sorted(o) == sorted(orders[0]) and sum(w for _, w in o) == 64 for o in orders)
    assert [(len(o), s) for o, s in (simhash_trie.layout(4, p) for p in (2, 3))] == [(15, 20), (35, 27)]
    assert [simhash_trie.picks_for(n, 4, 100_000) for n in (0, 10**8, 10**10, 10**12)] == [1, 1, 2, 3]
    with pytest.raises(ValueError):
        simhash_trie.layout(64)


@pytest.mark.parametrize("picks, leaf, compared", [(1, 1, 7), (2, 1, 2_000_000), (3, 30, 50)])
def test_longer_beginnings_and_deep_walks(spark, picks, leaf, compared, monkeypatch):
    """Links are the same whatever the layout, the leaves and the pieces that are compared at once."""
    monkeypatch.setattr(simhash_trie, "LEAF", leaf)
    monkeypatch.setattr(simhash_trie, "COMPARED", compared)
    r, values = np.random.default_rng(4), set()
    for b in r.integers(0, 1 << 63, 60, dtype=np.uint64).tolist():
        values |= {b} | {b ^ sum(1 << int(k) for k in r.choice(64, r.integers(1, 8), replace=False)) for _ in range(12)}
    values = sorted(values)
    u = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    root = {row["node"] % (1 << 64): row["root"] for row in components(simhash_trie.links(u, picks=picks)).collect()}
    want, got = {}, {}
    for v, c in zip(values, clusters(values)):
        want.setdefault(c, set()).add(v)
        got.setdefault(root.get(v, ("alone", v)), set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_tries_are_walked_at_every_size(spark, sf, monkeypatch):
    """Node pairs are split and pruned, and few fingerprints are compared beside all pairs of a trie."""
    walks, join = [], simhash_trie.trie_self_join

    def counted(values, first, *args, **more):
        forest = join(values, first, *args, **more)
        sizes = np.diff(np.append(first, len(values)))
        walks.append((forest.split, forest.pruned, forest.compared, int((sizes * sizes).sum()), int((sizes > 1).sum())))
        return forest

    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    fp = np.unique(np.array([r["fp"] for r in simhash_trie.fingerprints(docs, 4).select("fp").distinct().collect()], np.int64).view(np.uint64))
    orders, shared = simhash_trie.layout(4)
    begin = min(shared, len(fp).bit_length() - simhash_trie.TRIE_BITS)
    for order in orders:
        values = np.sort(simhash_trie.arranged(fp, order))
        counted(values, np.flatnonzero(np.diff(values >> np.uint64(64 - begin), prepend=np.uint64(1 << 63))), begin)
    split, pruned, compared, pairs, tries = np.array(walks).sum(0)
    assert split > 10 * tries and pruned > 0 and compared < pairs
