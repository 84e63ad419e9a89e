"""Queries over whole tables against brute force."""

import html
import re
from collections import defaultdict

import pyarrow.parquet as pq

from vellumspark.plans import capture_queries, graph_queries, scalar_queries

SF = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_ordinals(spark):
    want = sorted((d["doc_id"], i, line) for d in rows("documents") if d["text"] is not None for i, line in enumerate(d["text"].split("\n")))
    got = graph_queries.ordinals(spark, SF).select("doc_id", "ordinal", "line").collect()
    assert sorted(tuple(r) for r in got) == want
    assert any(d["n_chars"] >= 400 for d in rows("documents"))


def test_markup_text(spark):
    pages = rows("pages")
    want = sorted((p["page_id"], html.escape(p["html"]), ",".join(re.findall(r"&([A-Za-z][A-Za-z0-9._:-]*);", p["html"])), "a " + p["url"]) for p in pages)
    assert sorted(tuple(r) for r in scalar_queries.markup_text(spark, SF).select("page_id", "escaped", "entities", "title").collect()) == want
    assert any(len(p["html"]) > 400 for p in pages)


def test_view_status(spark):
    captures_, days = defaultdict(list), defaultdict(list)
    for e in rows("events"):
        ok, value = e["event_type"] != "error", e["value"]
        status = "complete" if ok and value > 20 else "complete_with_warnings" if value > 60 else "partial" if value > 5 else "failed"
        captures_[f"{e['ts']:%Y%m%d}", e["user_id"] % 97].append((status, e["user_id"] % 3 == 0, value > 40))
    for (day, _), results in captures_.items():
        missed = [s for s, required, _ in results if required and s in ("partial", "failed")]
        if missed:
            status = "partial" if "partial" in missed or any(p for *_, p in results) else "failed"
        else:
            status = "complete" if all(s == "complete" for s, *_ in results) else "complete_with_warnings"
        days[day].append(status)
    want = {}
    for day, found in days.items():
        want[day] = "complete" if set(found) == {"complete"} else "complete_with_warnings" if set(found) <= {"complete", "complete_with_warnings"} else "partial"
    assert {r["day"]: r["status"] for r in capture_queries.view_status(spark, SF).collect()} == want and len(want) > 3


def test_catalogue_projection(spark):
    items = defaultdict(list)
    for d in rows("documents"):
        items[d["source"]].append((d["doc_id"], d["lang"]))
    want = {s: (len(v), ",".join(f"{i}:{lang}" for i, lang in sorted(v)), "available") for s, v in items.items()}
    want |= {r["r_name"]: (0, "", "unavailable") for r in rows("region") if r["r_name"] not in want}
    got = graph_queries.catalogue_projection(spark, SF).collect()
    assert {r["collection_id"]: (r["n_items"], r["items"], r["status"]) for r in got} == want and len(got) == len(want)
    assert any(d["n_chars"] <= 4000 for d in rows("documents"))


def walked(edges, starts, most):
    depth, front = {n: 0 for n in starts}, set(starts)
    for k in range(1, most + 1):
        front = {d for s, d in edges if s in front} - set(depth)
        depth |= {n: k for n in front}
    return depth


def test_graphs(spark):
    orders = rows("orders")
    edges = {(o["o_custkey"], o["o_orderkey"] * 7) for o in orders}
    assert max(s for s, _ in edges) < 500 < max(d for _, d in edges) and max(d for _, d in edges) > 1000  # beyond the folded keys
    assert {r["node"]: r["depth"] for r in graph_queries.reachable(spark, SF).collect()} == walked(edges, [0, 3], 4)
    followed = walked({(s, d) for s, d in edges if d % 4}, [1, 2, 7], 8)
    first = sorted(followed.items(), key=lambda x: (x[1], x[0]))[:1000]
    assert {r["url"]: r["depth"] for r in graph_queries.redirect_walk(spark, SF).collect()} == dict(first)
    asked = {d for s, d in edges if s % 5 == 0}
    flags = {(s, d, (s + d) % 3 == 0, d in asked) for s, d in edges}
    assert {tuple(r) for r in graph_queries.redirect_flags(spark, SF).select("src", "dst", "reviewed", "requested").collect()} == flags
    done, want = {s for s, _, reviewed, requested in flags if reviewed and requested}, defaultdict(lambda: True)
    for o in orders:
        want[o["o_orderkey"] // 2] &= o["o_custkey"] in done
    got = {r["invocation"]: r["completed"] for r in graph_queries.completed_invocations(spark, SF).collect()}
    assert got == want and set(got.values()) == {True, False}
    assert {r["node"] for r in graph_queries.missing_support(spark, SF).collect()} == {d for _, d in edges} - {s for s, _ in edges}
