"""Archives cut at records and members give the rows of the whole, whatever looks like a start inside them."""

import gzip
import os
import random
import zipfile
import zlib

import pytest

from vellumspark.sources import warc, warc_splits
from vellumspark.sources.warc import WarcDataSource, WarcError, record_bytes
from vellumspark.sources.zip_members import ZipMembersDataSource, ZipReader, runs_of

DATE = "2026-01-01T00:00:00Z"


def stored(data: bytes) -> bytes:
    """A gzip member whose bytes stand in the file as they are, in blocks of 64 KB at most."""
    c = zlib.compressobj(0, wbits=31)
    return c.compress(data) + c.flush()


def page(k: int, body: bytes) -> bytes:
    return record_bytes(f"http://a.org/{k}", DATE, 200, "text/html", body)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Packed and plain archives with whole archives as payloads, a record larger than many ranges, signs without meaning."""
    d, r = tmp_path_factory.mktemp("split"), random.Random(3)
    inner = b"".join(gzip.compress(page(9000 + k, os.urandom(r.randint(10, 900)))) for k in range(60))
    plain_inner = b"".join(page(8000 + k, b"x" * r.randint(10, 500)) for k in range(60))
    bodies = [os.urandom(r.randint(0, 3000)) for _ in range(80)]
    bodies[20], bodies[50] = inner[:40_000], inner
    bodies[30] = b"\x1f\x8b\x08\x00" * 500 + os.urandom(200_000)
    (d / "a.warc.gz").write_bytes(b"".join(stored(page(k, b)) for k, b in enumerate(bodies)))
    bodies[20], bodies[50] = plain_inner, b"WARC/1.0\r\n" * 300 + plain_inner
    (d / "b.warc").write_bytes(b"".join(page(k, b) for k, b in enumerate(bodies)))
    (d / "c.warc.gz").write_bytes(b"")
    (d / "d.warc").write_bytes(page(1, b"one"))
    return d


def rows(df):
    return sorted(tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect())


@pytest.mark.parametrize("split", [15_000, 64_000, 1 << 30])
def test_ranges_give_the_rows_of_the_whole(spark, folder, split):
    spark.dataSource.register(WarcDataSource)
    whole = rows(spark.read.format("warc").option("path", str(folder)).load())
    out = warc_splits.scan(spark, str(folder), split)
    assert rows(out) == whole and len(whole) == 161
    assert split > 1 << 20 or out.rdd.getNumPartitions() > 5


def test_false_starts_are_met_and_left(spark, folder):
    """Some ranges find a start of their own inside a payload; all are walked again from the right place."""
    paths = [str(folder / n) for n in ("a.warc.gz", "b.warc")]
    for p in paths:
        true = {o for o, *_ in (warc.gzip_members(p) if p.endswith(".gz") else warc.plain_records(p))}
        size = os.path.getsize(p)
        found = [warc_splits.own_start(p, a, min(size, a + 15_000)) for a in range(0, size, 15_000)]
        assert any(s is not None and s not in true for s in found)
        agreed = warc_splits.ranges(spark, [p], 15_000).where("start < b").collect()
        assert {r["start"] for r in agreed} <= true and all(r["a"] <= r["start"] < r["b"] for r in agreed)


def test_broken_archives(spark, tmp_path):
    data = b"".join(gzip.compress(page(k, os.urandom(400))) for k in range(40))
    (tmp_path / "x.warc.gz").write_bytes(data[:9000] + b"\x00" * 50 + data[9050:])
    with pytest.raises(Exception, match="WarcError|zlib|Error"):
        warc_splits.scan(spark, str(tmp_path), 3_000).collect()
    spark.dataSource.register(WarcDataSource)
    want = rows(spark.read.format("warc").option("path", str(tmp_path)).option("mode", "permissive").load())
    assert rows(warc_splits.scan(spark, str(tmp_path), 3_000, permissive=True)) == want and 5 < len(want) < 40
    assert issubclass(WarcError, ValueError)


@pytest.fixture(scope="module")
def package(tmp_path_factory):
    p = tmp_path_factory.mktemp("zip") / "big.zip"
    with zipfile.ZipFile(p, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(60):
            z.writestr(f"tei/w{k}.xml", f'<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="w{k}"><text>{"x" * (k * 50)}</text></TEI>')
        z.writestr("tei/broken.xml", "<TEI><text></TEI>")
        z.writestr("tei/bare.xml", "<a><b/></a>")
        z.writestr("tei/entity.xml", "<a>&unknown;</a>")
        z.writestr("tei/", "")
        with z.open("tei/large.xml", "w") as f:
            f.write(b'<TEI xmlns="http://www.tei-c.org/ns/1.0" xml:id="large">')
            for _ in range(120):
                f.write(b"<p>" + b"words " * 20_000 + b"</p>")
            f.write(b"</TEI>")
    return str(p)


def test_one_zip_read_by_many_tasks(spark, package):
    from vellumspark.operators.collections import tei_identities

    spark.dataSource.register(ZipMembersDataSource)
    read = lambda n: spark.read.format("zip_members").option("path", package).option("hash", "true").option("xml", "true").option("partitionBytes", n).load()
    few, many = read(1 << 40), read(400)
    assert few.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 10
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    facts = {r["name"]: (r["xml_ok"], r["root_id"]) for r in many.collect()}
    assert facts["tei/w7.xml"] == (True, "w7") and facts["tei/broken.xml"] == (False, None) and facts["tei/entity.xml"] == (False, None) and facts["tei/"] == (None, None) and facts["tei/large.xml"] == (True, "large")
    mapping = spark.createDataFrame([("w1", "r1", None), ("w2", None, "other"), ("bare", None, None)], "file_id string, register_id string, root_id string")
    got = {r["file_id"]: (r["register_id"], r["problem"]) for r in tei_identities(many, r"^tei/([^/]+)\.xml$", mapping).collect()}
    assert got["w1"] == ("r1", None) and got["w2"] == ("w2", "another id") and got["w3"] == ("w3", None) and got["bare"] == ("bare", "another root") and got["broken"] == ("broken", "not well formed")


def test_large_members_are_parsed_in_blocks(package):
    import tracemalloc

    tracemalloc.start()
    reader = ZipReader({"path": package, "xml": "true", "hash": "true"})
    rows = [r for part in reader.partitions() for r in reader.read(part)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(r[3] for r in rows) > 14_000_000 and peak < 6_000_000


def test_runs_of_a_directory():
    assert runs_of([5, 5, 5, 50, 1, 1], 10) == [(0, 2), (2, 3), (3, 4), (4, 6)] and runs_of([], 10) == [(0, 0)]


def test_one_zip_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Several archives, one over several parts, a name beyond ASCII, an empty member, and offsets told in 64 bits."""
    from vellumspark.operators import package_writer

    rows = [("a.zip", f"t/ä{k:04d}.xml", f"<a>{'x' * k}</a>" * (k % 3)) for k in range(3000)] + [("b.zip", "one", "1")]
    frame = spark.createDataFrame(rows, "archive string, name string, content string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name, limit in (("near", package_writer.MANY), ("far", 1000)):
            with monkeypatch.context() as m:
                m.setattr(package_writer, "RUN_BYTES", 5000)
                folder = tmp_path / name
                folder.mkdir()
                if name == "far":
                    m.setattr(package_writer, "FAR", limit)
                package_writer.packed_zips(frame, str(folder))
            assert sorted(os.listdir(folder)) == ["a.zip", "b.zip"]
            with zipfile.ZipFile(folder / "a.zip") as z:
                assert z.testzip() is None and z.namelist() == [r[1] for r in rows[:-1]]
                assert [z.read(n).decode() for n in z.namelist()] == [r[2] for r in rows[:-1]]
            spark.dataSource.register(ZipMembersDataSource)
            m = spark.read.format("zip_members").option("path", str(folder)).option("content", "true").option("partitionBytes", 2000).load()
            assert sorted((r["archive"], r["name"], bytes(r["content"]).decode()) for r in m.collect()) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_task_reads_its_run_of_the_directory_only(tmp_path):
    """The runs of a ZIP give its rows, also behind other bytes and with members out of order or over each other."""
    p = tmp_path / "x.zip"
    with zipfile.ZipFile(p, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(2000):
            z.writestr(f"{k}.xml", f"<a n='{k}'/>")
    q, r, o = tmp_path / "prefixed.zip", tmp_path / "reversed.zip", tmp_path / "over.zip"
    q.write_bytes(b"#!/bin/sh\n" + p.read_bytes())
    with zipfile.ZipFile(p) as z, zipfile.ZipFile(r, "w") as to:
        for m in z.infolist():
            to.writestr(m.filename, z.read(m))
        to.filelist.reverse()
        to._didModify = True
    with zipfile.ZipFile(o, "w") as to:
        for k in range(100):
            to.writestr(f"{k}", f"{k:09d}")
        for m in to.filelist[51:]:
            m.header_offset = to.filelist[50].header_offset
    for path in (p, q, r, o):
        few, many = (ZipReader({"path": str(path), "hash": "true", "xml": "true", "partitionBytes": n}) for n in (1 << 40, 300))
        parts = many.partitions()
        assert len(parts) > 2 and [x for a in few.partitions() for x in few.read(a)] == (rows := [x for a in parts for x in many.read(a)])
        with zipfile.ZipFile(path) as z:
            assert [(x[1], x[2], x[5]) for x in rows] == [(i, m.filename, m.CRC) for i, m in enumerate(z.infolist())]
        assert path in (r,) or max(a.b - a.a for a in parts) < 10_000


def test_one_archive_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """Parts of a packed and a plain archive stand in order of url; ranges smaller than a task's worth share tasks."""
    rows = [(f"{'p.warc' if k % 2 else 'g.warc.gz'}", f"http://a.org/{k:05d}", DATE, 200, "text/html", None, None, os.urandom(k % 700)) for k in range(4000)]
    frame = spark.createDataFrame(rows, "file string, url string, date string, status int, mime string, location string, digest string, body binary").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    seen = []
    from vellumspark.operators import package_writer

    place = package_writer.placed
    monkeypatch.setattr(package_writer, "placed", lambda s, copies: (seen.extend(copies), place(s, copies)))
    try:
        made = warc.write_warcs(frame, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, made.collect())) == [("g.warc.gz", 2000), ("p.warc", 2000)] and len(seen) > 4
    assert sorted(os.listdir(tmp_path)) == ["g.warc.gz", "p.warc"]
    for name, read in (("g.warc.gz", warc.gzip_members), ("p.warc", warc.plain_records)):
        whole = [warc.record(x[-1])[0]["warc-target-uri"] for x in read(str(tmp_path / name))]
        assert whole == [r[1] for r in rows if r[0] == name]
    out = warc_splits.scan(spark, str(tmp_path), 3_000)
    assert out.rdd.getNumPartitions() == warc_splits.CORE_TASKS * spark.sparkContext.defaultParallelism
    assert sorted((r["filename"], r["url"], bytes(r["entity"])) for r in out.collect()) == sorted((r[0], r[1], r[7]) for r in rows)


def test_many_misled_ranges_cost_few_rounds(spark, tmp_path, monkeypatch):
    """Payloads that begin like archives and end nowhere mislead ranges; those behind them keep their starts."""
    inner = b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n"
    (tmp_path / "m.warc").write_bytes(b"".join(page(k, (inner + b"x" * 1500) if k % 4 == 0 else b"y" * 300) for k in range(600)))
    made, write = [], warc_splits.written
    monkeypatch.setattr(warc_splits, "written", lambda df: (made.append(1), write(df))[1])
    found = warc_splits.ranges(spark, [str(tmp_path / "m.warc")], 1000).where("start < b").collect()
    true = {o for o, _ in warc.plain_records(str(tmp_path / "m.warc"))}
    assert {r["start"] for r in found} == {min(o for o in true if o >= r["a"]) for r in found} and len(found) > 200
    assert len(made) < 12, len(made)
