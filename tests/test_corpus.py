"""Operators on small tables: walks, inventories, markup, publication, extensions, streams."""

import os

import pytest
from pyspark.sql import functions as F

from vellumspark.functions import html, text, urls
from vellumspark.operators import captures, collections, graphs, inventory, model, numbering, publish, roles
from vellumspark.plans import extensions
from vellumspark.sources.files import ListingError
from vellumspark.streaming import captures as streams


def column(spark, values, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(expression).collect()]


def test_visible_text():
    page = '<p id="a">x <b>y<div id="t">One<br>two<script>no</script> <i>t&eacute;n<div>in</div><div class="reader-citation"><p>gone</div>end</div> out'
    assert html.visible_text(page, "t") == "One two tén in end"
    assert html.visible_text(page, "none") is None and html.visible_text('<p id="t">a</p><p id="t">b</p>', "t") is None
    assert html.visible_text("<article>a</article>", "article", by_tag=True) == "a" and html.visible_text(None, "t") is None


def test_links():
    assert html.links_of('<a href="b#c">x</a><img src="/i.png"><script src="//h/s.js"></script><a>no</a>', "http://a.org/d/e") == [("a", "http://a.org/d/b"), ("img", "http://a.org/i.png"), ("script", "http://h/s.js")]
    nested = "<ul><li>1 = Category<ul><li><b>1.1.1</b> Untranslated record:</l><li><b>1.8.1.1</b> Gilgame&#x0161; and <i>Aga</i></li><li>1.8.1.9 Unedited record</li><li><b>2.1.1</b> Elsewhere</li><li><b>1.1.1</b> Again</li><li><b>x</b> y</li></ul></li></ul>"
    assert [(r[0], r[1], r[2], r[5]) for r in html.catalogue_of(nested)] == [
        (["1 = Category"], "1.1.1", "Untranslated record", None), (["1 = Category"], "1.8.1.1", "Gilgameš and Aga", None), (["1 = Category"], "2.1.1", "Elsewhere", "other category"),
        (["1 = Category"], "1.1.1", "Again", "repeated"), (["1 = Category"], "x", "y", "no identifier"),
    ]
    linked = "<ul><li>0.1.1 First (N1):\n<a href='e.cgi?text=c.0.1.1&amp;d=x'>tl</a></li><li>2.4.1.a Second: <a href='e.cgi?text=c.2.4.1.a'>tl</a> | <a href='e.cgi?text=t.2.4.1.b'>t</a></li><li>no link</li></ul>"
    assert html.catalogue_of(linked) == [([], "0.1.1", "First (N1)", "e.cgi?text=c.0.1.1&d=x", None, None), ([], "2.4.1.a", "Second", "e.cgi?text=c.2.4.1.a", "e.cgi?text=t.2.4.1.b", "other identifier")]
    two = html.catalogue_of("<ul><li>A<ul><li>B<ul><li><b>1.1.1</b> X</li></ul></li><li><b>0.1.1</b> Y</li></ul></li></ul>")
    assert [(r[0], r[3], r[4]) for r in two] == [(["A", "B"], "etcsl/transliterations/c.1.1.1.xml", "etcsl/translations/t.1.1.1.xml"), (["A"], "etcsl/transliterations/c.0.1.1.xml", None)]
    assert html.catalogue_of("")[0][5] == html.catalogue_of(None)[0][5] == "no records"
    import xml.etree.ElementTree as E

    assert "".join(E.fromstring(html.with_stub_entities("<?xml version='1.0'?><!DOCTYPE a [<!ENTITY x 'y'>]><a>b&c;d&amp;</a>")).itertext()) == "bd&"


def test_entities(spark):
    out = column(spark, ["&c; &amp; &eacute; &zz9;", None], html.entities_replaced(F.col("v"), {"c": "š"}))
    assert out == ["š &amp; é {zz9}", None]


def test_tei():
    doc = '<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="x1"><teiHeader><fileDesc><titleStmt><title> A <hi>b</hi></title><author>C</author><author>C</author></titleStmt><publicationStmt><availability><p>Free.</p></availability></publicationStmt></fileDesc><profileDesc><langUsage><language ident="sa"/></langUsage></profileDesc></teiHeader></TEI>'
    r = html.tei_record(doc)
    assert (r["id"], r["title"], r["authors"], r["primary_language"], r["rights"]) == ("x1", "A b", ["C"], "sa", ["Free."])
    assert html.tei_record("<TEI/>") is None and html.tei_record("<a") is None


def test_scalars(spark):
    assert column(spark, [" a  b\x1cc ", ""], text.collapsed(F.col("v"))) == ["a b c", ""]
    assert column(spark, ["é", "abc", None], text.nfc("v")) == ["é", "abc", None]
    assert column(spark, ["10K", "3m", "0", "5", "1T", "-1"], text.byte_size(F.col("v"))) == [10240, 3 << 20, None, 5, None, None]
    assert column(spark, [0, 1023, 1024, 1 << 40, 1 << 51], text.byte_text(F.col("v")), "long") == ["0.0 B", "1023.0 B", "1.0 KiB", "1.0 TiB", "2048.0 TiB"]
    assert column(spark, ["a b", "é'", ""], text.unsafe_to_token(F.col("v"))) == ["a~20b", "~c3~a9'", ""]
    assert column(spark, ["http://User@B.Example.org:80/x?y#z", "https://a.b", "http://a.b?q"], urls.surt(F.col("v"))) == ["org,example,b:80)/x?y", "b,a)/", "b,a)/?q"]
    assert column(spark, ["20240131T010203Z-a-b", "20240231T010203Z-a", "20240131T010203Z"], urls.capture_id_valid(F.col("v"))) == [True, False, False]
    assert column(spark, ["2024-01-02T03:04:05+02:00", "2024-01-02T03:04:05", "x"], urls.cdx_timestamp(urls.rfc3339(F.col("v")))) == ["20240102010405", None, None]
    assert column(spark, ["a%25b%0d", "a%20"], urls.manifest_path_decoded(F.col("v"))) == ["a%b\r", None]
    assert column(spark, ["r#a#b", "r"], urls.route_fragment(F.col("v"))) == ["a#b", None]
    assert column(spark, ["a/b.html#x", "/a", "a/../b", "http:x", "a?b", "a%20"], urls.route_valid(F.col("v"))) == [True, False, False, False, False, False]
    assert column(spark, ["http://a/b?x=1&x=2", "http://a"], urls.query_values(F.col("v"), F.lit("x"))) == [["1", "2"], []]
    assert column(spark, ["x.warc.gz", "x.gz", "x.xml", "x"], urls.media_type(F.col("v"))) == ["application/warc+gzip", "application/gzip", "application/xml", "application/octet-stream"]


def test_statuses(spark):
    rows = [("a", "complete", True, True), ("b", "complete", True, True), ("b", "failed", False, False), ("c", "failed", True, False), ("d", "failed", True, False), ("d", "complete", False, True), ("e", "partial", True, False), ("f", "complete_with_warnings", True, True)]
    out = captures.capture_status(spark.createDataFrame(rows, "capture_id string, status string, required boolean, payload boolean"))
    assert {r["capture_id"]: r["status"] for r in out.collect()} == {"a": "complete", "b": "complete_with_warnings", "c": "failed", "d": "partial", "e": "partial", "f": "complete_with_warnings"}


def test_best_provider_prefers_success_to_recency(spark):
    rows = [("s", "2020", True), ("s", "2021", False), ("t", "2020", False), ("t", "2021", False)]
    out = captures.best_provider(spark.createDataFrame(rows, "source_id string, capture_id string, ok boolean"))
    assert {r["source_id"]: r["capture_id"] for r in out.collect()} == {"s": "2020", "t": "2021"}


def test_roles(spark):
    rows = [("sources/s/warc/a.warc.gz", None), ("sources/s/warc/d/a.WARC", None), ("sources/s/mirror/a", "http-file"), ("sources/s/mirror/a", "web"), ("sources/s/warc", "web"), ("capture.json", None)]
    df = spark.createDataFrame(rows, "path string, kind string")
    got = [tuple(r) for r in df.select(roles.role(F.col("path"), F.col("kind")), roles.inferred_role(F.col("path"), F.col("kind"))).collect()]
    o, d, m = roles.ORIGINAL, roles.DERIVATIVE, roles.METADATA
    assert got == [(o, o), (o, d), (o, o), (d, d), (m, m), (m, m)]
    with pytest.raises(ValueError):
        roles.selected(df, "public")
    with pytest.raises(ValueError):
        roles.selected(df, "private", df)


def test_walks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "src string, dst string")
    out = graphs.reach(e, spark.createDataFrame([("a",)], "node string"))
    assert {(r["node"], r["depth"]) for r in out.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    c = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", None), ("s", "s")], "id string, container_id string")
    assert {r["id"] for r in graphs.on_cycles(c).collect()} == {"a", "b", "c", "s"}
    assert graphs.on_cycles(c.where("id > 'd'").where("id < 's'")).count() == 0
    rules = spark.createDataFrame([("http://a/1", "http://a/1"), ("http://a/2", "http://b/2"), ("http://a/3", "http://a/4"), ("http://a/3", "http://a/5"), ("http://a/6", "http://a/7")], "src string, dst string")
    assert {(r["src"], r["problem"]) for r in graphs.rule_problems(rules, ["a"]).collect()} == {("http://a/1", "equal ends"), ("http://a/2", "foreign host"), ("http://a/3", "several targets")}


def test_model_checks(spark):
    f = spark.createDataFrame([("k", "L", None, 1), ("k", "L", "n", 0), ("j", "L", "n", 2), ("j", "M", "n", 3), ("ok", "A", None, 4)], "key string, label string, note string, ordinal int")
    assert {r["key"] for r in model.facet_conflicts(f).collect()} == {"k", "j"}
    assert {(r["key"], r["note"]) for r in model.facet_notes(f).collect()} == {("k", "n"), ("j", "n")}
    v = spark.createDataFrame([(["a", "b"],), (["a", "a"],), ([" a"],), ([],), (["a\x01"],)], "v array<string>")
    assert [r[0] for r in v.select(model.facet_valid(F.col("v"))).collect()] == [True, False, False, False, False]


def test_dense_ids_are_gapless_for_any_partitioning(spark):
    df = spark.range(1000).withColumn("k", F.pmod(F.xxhash64("id"), F.lit(17))).repartition(7)
    out = [(r["k"], r["id"]) for r in numbering.dense_ids(df, ["k", "id"]).orderBy("docid").collect()]
    assert out == sorted(out) and [r["docid"] for r in numbering.dense_ids(df, ["k", "id"]).orderBy("docid").collect()] == list(range(1, 1001))


def test_ordered_digest(spark):
    import hashlib

    df = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "v string")
    assert inventory.ordered_digest(df, "v") == hashlib.sha256(b"a\nb\n").hexdigest()
    assert inventory.ordered_digest(df.limit(0), "v") == hashlib.sha256(b"\n").hexdigest()


def test_register(spark):
    page = '<a href="/c/tei/one.xml">x</a><a href="/c/html/one.html">x</a><a href="http://a.org/c/html/two.html#q">x</a><a href="http://other.org/c/tei/three.xml">x</a><a href="/c/tei/f%C3%B6.xml">x</a>'
    pages = spark.createDataFrame([(1, page, "https://a.org/reg")], "page_id int, html string, url string")
    ids = collections.classified_links(pages, {"tei": "/c/tei/([^/]+)\\.xml", "analytic-html": "/c/html/([^/]+)\\.html"}, ["a.org"], "a.org")
    assert {tuple(r) for r in ids.collect()} == {("tei", "one"), ("tei", "fö"), ("analytic-html", "one"), ("analytic-html", "two")}
    report = {(r["severity"], r["kind"], r["side"], r["n"]) for r in collections.register_report(ids, ("analytic-html",)).collect()}
    assert report == {("error", "analytic-html", "missing", 1), ("warning", "analytic-html", "unexpected", 1), ("warning", "plaintext", "missing", 2)}


def test_support_graph(spark):
    docs = spark.createDataFrame([("d/root.xml", '<!DOCTYPE x SYSTEM "../t/a.dtd"> &used; &amp; &lost;'), ("t/a.dtd", '<!ENTITY % p PUBLIC "-//x" "b.ent"> <!ENTITY y SYSTEM "gone.ent">'), ("t/b.ent", '<!ENTITY used "u">'), ("t/c.ent", '<!ENTITY never "u">')], "name string, document string")
    visited, missing = collections.support_graph(docs, ["d/root.xml", "no.dtd"])
    assert {r["node"] for r in visited.collect()} == {"d/root.xml", "t/a.dtd", "t/b.ent"}
    assert {tuple(r) for r in missing.collect()} == {("t/a.dtd", "t/gone.ent"), ("deposit", "no.dtd")}
    assert {r["entity"] for r in collections.unbound_entities(docs, collections.declared_entities(docs)).collect()} == {"lost"}


def test_composition_gaps(spark):
    items = spark.createDataFrame([("1", True), ("2", False), ("3", False), ("4", True)], "id string, translated boolean")
    out = collections.composition_gaps(items, spark.createDataFrame([("3",), ("4",)], "id string"), spark.createDataFrame([("1",), ("2",), ("3",), ("5",)], "id string"))
    assert {tuple(r) for r in out.collect()} == {("2", "missing translation"), ("4", "unexpected translation"), ("5", "missing composition"), ("4", "unexpected composition")}


def test_publication(tmp_path):
    def build(value):
        def run(d):
            with open(os.path.join(d, "f"), "w") as f:
                f.write(value)

        return run

    parent = str(tmp_path / "g")
    assert [publish.publish(build(v), parent, "k")[1] for v in ("a", "a", "b")] == ["built", "reused", "replaced"]
    assert sum(n.startswith("quarantine-") for n in os.listdir(parent)) == 1
    for n in ("20200101T000000Z-a", "20210101T000000Z-a"):
        os.mkdir(tmp_path / n)
    p = str(tmp_path / "LATEST")
    assert publish.read_pointer(p, str(tmp_path)) is None
    assert publish.move_pointer(p, str(tmp_path), str(tmp_path / "20210101T000000Z-a"))
    assert not publish.move_pointer(p, str(tmp_path), str(tmp_path / "20200101T000000Z-a"))
    assert publish.resolve_capture(str(tmp_path), None, ["NONE", "LATEST"]).endswith("20210101T000000Z-a")
    with open(p, "w") as f:
        f.write("../up")
    with pytest.raises(ListingError):
        publish.read_pointer(p, str(tmp_path))
    assert publish.move_pointer(p, str(tmp_path), str(tmp_path / "20200101T000000Z-a"))
    r = str(tmp_path / "r.json")
    assert publish.write_once(r, {"id": 1, "x": 1}) == {"id": 1, "x": 1} == publish.write_once(r, {"id": 1, "x": 2})
    with pytest.raises(ListingError):
        publish.write_once(r, {"id": 2})
    assert publish.canonical_json({"b": 1, "a": "é"}) == b'{"a":"\\u00e9","b":1}'
    with pytest.raises(ValueError):
        publish.identity({"created_at": 1})


def test_operations_and_their_limits(spark):
    r, c = extensions.Registry(), extensions.Context("c", "/x")
    r.register("operation", "rows", lambda spark, c: spark.range(c.arguments["n"]))
    r.register("operation", "echo", lambda spark, c: c.arguments)
    r.register("operation", "set", lambda spark, c: {1, 2})
    r.register("operation", "big", lambda spark, c: "x" * extensions.ANSWER_BYTES)
    r.register("operation", "quick", lambda spark, c: spark.range(5).count())
    r.register("operation", "slow", lambda spark, c: spark.range(4, numPartitions=2).selectExpr("java_method('java.lang.Thread', 'sleep', cast(4000 + id as bigint))").collect())
    r.register("read", "none", lambda spark, c: {})
    assert r.operation(spark, "rows", c, {"n": 3}).count() == 3
    assert r.operation(spark, "echo", c, {"a": [None, "é"]}) == {"a": [None, "é"]} and c.arguments == {}
    assert r.operation(spark, "quick", c, {}) == 5
    for name, arguments in [("set", {}), ("big", {}), ("echo", {"x": float("inf")}), ("echo", []), ("absent", {})]:
        with pytest.raises(extensions.ExtensionError):
            r.operation(spark, name, c, arguments)
    for seconds in (0.5, 901):
        with pytest.raises(extensions.ExtensionError, match="1 to 900"):
            r.run(spark, "read", "none", c, seconds)
    with pytest.raises(extensions.ExtensionError, match="longer than 1 seconds") as e:
        r.operation(spark, "slow", c, {}, seconds=1)
    assert e.value.__cause__ is not None  # the jobs were cancelled, not awaited
    assert spark.range(7).count() == 7  # later jobs run


def test_extensions(spark):
    r = extensions.Registry()
    r.register("validate", "v", lambda spark, c: extensions.Report("complete", details={"n": 1}))
    r.register("validate", "bad", lambda spark, c: extensions.Report("complete", errors=("x",)))
    r.register("validate", "nan", lambda spark, c: extensions.Report("complete", details={"n": float("nan")}))
    c = extensions.Context("c", "/x")
    assert extensions.folded(r.run(spark, "validate", "v", c), True).status == "complete_with_warnings"
    for name in ("bad", "nan", "absent"):
        with pytest.raises(extensions.ExtensionError):
            r.run(spark, "validate", name, c)
    with pytest.raises(extensions.ExtensionError):
        r.register("validate", "v", print)


def test_stream_of_captures(spark, tmp_path):
    rows = spark.createDataFrame([("s", "1", True), ("s", "2", False), ("t", "1", False)], "source_id string, capture_id string, ok boolean").withColumn("ended_at", F.current_timestamp())
    rows.write.json(str(tmp_path / "in"))
    q = streams.providers(streams.results(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("providers").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["source_id"], r["capture_id"]) for r in spark.table("providers").collect()} == {("s", "1"), ("t", "1")}
