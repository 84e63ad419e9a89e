"""Records of captures and texts of one corpus, by small cases."""

import os

from vellumspark.functions import cuneiform
from vellumspark.operators import capture_record
from vellumspark.sources import files


def test_captures_without_a_record_are_problems(spark, tmp_path):
    for name, data in (("none", None), ("bytes", b"\xff{}"), ("listed", b"[]"), ("text", b'{"schema_version": "3"}'), ("true", b'{"schema_version": true}'), ("empty", b"{}")):
        os.makedirs(tmp_path / name)
        (tmp_path / name / ".hidden").write_text("x")
        if data is not None:
            (tmp_path / name / "capture.json").write_bytes(data)
    kinds = spark.createDataFrame([], "capture string, source_id string, kind string")
    good, bad = capture_record.verified(*files.captured(spark, str(tmp_path)), kinds)
    assert {(r["capture"], r["path"]) for r in good.collect()} == {("empty", ".hidden"), ("empty", "capture.json")}
    told = {r["capture"]: r["first"] for r in capture_record.in_order(bad, "capture").collect()}
    assert told == {"none": "no object", "bytes": "no object", "listed": "no object", "text": "unknown schema: 3", "true": "unknown schema: true"}


def test_stated_roles_must_cover_all_files(spark):
    record = '{"schema_version":3,"payload_roles":[{"path":"a","role":"metadata"},{"path":"sources/x/warc/y","role":"other"},{"path":"b","role":"metadata"}]}'
    records = spark.createDataFrame([("c", record)], "capture string, document string")
    held = spark.createDataFrame([("c", "a"), ("c", "z"), ("c", "q"), ("c", "sources/x/warc/y")], "capture string, path string")
    kinds = spark.createDataFrame([], "capture string, source_id string, kind string")
    good, bad = capture_record.verified(records, held, kinds)
    assert good.count() == 0
    assert capture_record.in_order(bad, "capture").first()["messages"] == ["unknown role: sources/x/warc/y", "no role: q", "no role: z", "no file: b"]


def test_words_of_a_shell(spark):
    import shlex

    words = ["", "a", "it's", "a b", "é", "$x", "a\nb", "x=1", "'", "a\n"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(capture_record.shell_word(df["w"])).collect()] == [shlex.quote(w) for w in words]


def test_entities_of_the_corpus():
    names = ["c", "mu", "hr", "eacute", "nope", "semi"]
    assert "".join(map(cuneiform.plain_entity, names)) == "šmu―é&nope;;"
    assert cuneiform.shown_entity("nope") == "&amp;nope;" and [cuneiform.explained(n) for n in ("c", "amp", "nope")] == [True, True, False]
    reader = cuneiform.TextReader("<!DOCTYPE t SYSTEM 'x.dtd' ><text n='&d;&nope;&amp;'><body>&lt;<!-- &gone; --> &own;</body></text>")
    assert [p["html"] for p in reader.pieces()] == ['<section class="text-body"><h3>d&amp;nope;&amp;</h3><p>&lt; &amp;own;</p></section>'] and reader.unknown == ["gone", "nope", "own"]


def test_bodies_of_odd_documents(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "<x"), (4, "<x/>"), (5, "<text><body>" + "<l n='1'>w</l>" * 20_000 + "</body></text>")], "id long, document string")
    got = {r["id"]: r for r in cuneiform.bodies(docs, "id").collect()}
    assert all(got[k]["html"] is None and got[k]["segments"] is None for k in (1, 2, 3))
    assert got[4]["html"] == '<p class="unavailable">No text body was found.</p>' and got[4]["segments"] == []
    assert len(got[5]["segments"]) == 20_000 and got[5]["segments"][-1]["occurrence"] == 20_000
