"""Access graphs: tables, checks, documents, the catalogue on disk, and pages."""

import json
import xml.etree.ElementTree as E

import pytest
from pyspark.sql import functions as F

from vellumspark.functions import render
from vellumspark.operators import publish, search
from vellumspark.sources import access


def graph():
    rep = lambda i, k, **x: {"id": f"tp:c/rep/{i}{k}", "label": k, "kind": k, "language": "en", "route": f"{i}.html#{k}", "artifact_ids": ["tp:c/artifact/a"], "segments": []} | x
    facet = {"key": "form", "label": "Form", "values": ["verse"], "artifact_ids": [], "note": "n"}
    items = [{"id": f"tp:c/item/{i}", "label": f"Item {i}", "type": "work", "route": f"{i}.html", "citation": "c", "rights": ["free"], "facets": [dict(facet)], "representations": [rep(i, "text"), rep(i, "translation", segments=[{"id": f"tp:c/seg/{i}", "label": "1", "route": f"{i}.html#s1"}])]} for i in "ba"]
    return {"schema_version": 2, "collection": {"id": "tp:c/collection", "label": "C", "status": "complete", "route": "index.html", "rights": ["r"]}, "items": items, "artifacts": [{"id": "tp:c/artifact/a", "label": "A", "role": "source", "capture_path": "x/y", "media_type": "text/xml"}], "relations": [{"source_id": "tp:c/rep/atranslation", "relation": "translation_of", "target_id": "tp:c/rep/atext"}]}


def load(spark, tmp_path, value):
    (tmp_path / "g.json").write_bytes(publish.pretty_json(value))
    return access.load(spark, str(tmp_path / "g.json"))


def test_valid_graph(spark, tmp_path):
    t = load(spark, tmp_path, graph())
    assert access.problems(t).collect() == []
    assert {n: df.count() for n, df in t.items()} == {"collections": 1, "items": 2, "representations": 4, "representation_artifacts": 4, "segments": 2, "facets": 2, "artifacts": 1, "relations": 1, "rights": 3}


def test_broken_graph(spark, tmp_path):
    g = graph()
    g["items"][0]["representations"][0]["artifact_ids"] = ["tp:c/artifact/zz"]
    g["items"][0]["route"] = "../x"
    g["items"][1]["id"] = "tp:c/artifact/a"
    g["items"][1]["facets"][0]["note"] = None
    g["items"][1]["representations"][0]["route"] = g["items"][0]["representations"][0]["route"]
    g["artifacts"].append({"id": "tp:c/artifact/b", "label": "B", "role": "Bad Role", "capture_path": "x", "media_type": "t", "container_id": "tp:c/artifact/b", "sha256": "xyz"})
    g["relations"].append({"source_id": "tp:c/artifact/b", "relation": "r", "target_id": "tp:c/collection"})
    found = {(r["table"], r["problem"]) for r in access.problems(load(spark, tmp_path, g)).collect()}
    assert found == {("graph", "repeated id"), ("representations", "unknown artifact"), ("items", "route"), ("facets", "inconsistent"), ("representations", "repeated route"), ("artifacts", "role"), ("artifacts", "sha256"), ("artifacts", "container cycle"), ("relations", "unknown end")}


def test_segment_index(spark, tmp_path):
    reps = spark.createDataFrame([("tp:c/rep/1", "s.jsonl"), ("tp:c/rep/2", None)], "id string, segment_index string")
    line = lambda r, route="a.html#1": json.dumps({"representation_id": r, "segment": {"id": "tp:c/seg/1", "label": "l", "route": route}}, separators=(",", ":"), sort_keys=True)
    (tmp_path / "s.jsonl").write_text("\n".join([line("tp:c/rep/1"), line("tp:c/rep/2"), line("tp:c/rep/1").replace(",", ", ", 1), line("tp:c/rep/1", "/abs")]) + "\n")
    assert sorted(r["problem"] for r in access.index_problems(spark, str(tmp_path / "s.jsonl"), "s.jsonl", reps).collect()) == ["foreign representation", "not canonical", "segment"]


def test_catalogue_on_disk(spark, tmp_path):
    t = load(spark, tmp_path, graph())
    texts = t["representations"].select(F.col("id").alias("representation_id"), F.concat(F.lit("the old mill "), F.col("kind")).alias("body"))
    access.write_catalogue(t, texts, str(tmp_path / "cat"))
    docs = spark.read.parquet(str(tmp_path / "cat" / "documents"))
    assert [r["item_id"] for r in docs.orderBy("docid").collect()] == ["tp:c/item/a"] * 2 + ["tp:c/item/b"] * 2
    assert [r["representation_id"] for r in search.search(docs, "body : translation", kind=["translation"]).collect()] == ["tp:c/rep/atranslation", "tp:c/rep/btranslation"]
    assert access.content_digest(docs) == access.content_digest(docs.repartition(3))


def test_pages():
    items = [{"label": "<I>", "route": "a.html", "facets": [{"key": "k", "label": "K", "values": list("abcde"), "note": "why"}], "representations": [{"kind": "text", "language": "en"}]}]
    out = render.catalogue_page("T", [{"label": "C", "status": "complete", "reader": "r/index.html", "items": items}, {"label": "D", "reason": "gone"}])
    assert "&lt;I&gt;" in out and "a; b; c; and 2 more" in out and "why" in out and "gone" in out and "script" not in out
    for bad in ("http://x/", "/abs", "", "a\\b"):
        with pytest.raises(ValueError):
            render.local_href(bad)


def test_tei_rendering(spark):
    doc = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><lg n="1"><l n="1">a <hi rend="bold">b</hi><lb/>&amp;</l><l n="1">c</l></lg><unknown>d</unknown></body></text></TEI>'
    assert render.tei_html(E.fromstring(doc)[0]) == "<div><p>a <strong>b</strong><br>&amp;</p><p>c</p></div>d"
    assert [s[2] for s in render.tei_segments(E.fromstring(doc), "r")] == ["r#lg-1", "r#l-1", "r#l-1-2"]
    df = spark.createDataFrame([(doc,), ("<x",)], "d string")
    assert [r[0] for r in df.select(render.rendered(F.col("d"))).collect()] == ["<div><p>a <strong>b</strong><br>&amp;</p><p>c</p></div>d", None]
