"""Archives, packages and folders: written here, read back by the sources."""

import gzip
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from vellumspark.operators import package_writer, packages
from vellumspark.operators.inventory import EMPTY_SHA256
from vellumspark.sources import files
from vellumspark.sources.warc import WarcDataSource, WarcError, gzip_members, header_lines, read_at, rows_of
from vellumspark.sources.zip_members import COLLECTION_LIMITS, ZipMembersDataSource, member_problems


def response(url, body=b"<p>hi</p>", status="200 OK", extra=""):
    http = f"HTTP/1.1 {status}\r\nContent-Type: text/html; charset=utf-8\r\n{extra}\r\n".encode() + body
    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2024-01-02T03:04:05Z\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(http)}\r\n\r\n"
    return head.encode() + http + b"\r\n\r\n"


INFO = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\na: b\r\n\r\n"
RECORDS = [INFO, response("http://b.example.org/x?y=1"), response("http://a.example.org/", status="301 Moved", extra="Location: /x\r\n"), response("http://a.example.org/x", body=b"z" * 3_000_000)]


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    d = tmp_path_factory.mktemp("warc")
    (d / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in RECORDS))
    (d / "two.warc").write_bytes(b"".join(RECORDS))
    return d


def test_warc_rows(spark, archive):
    spark.dataSource.register(WarcDataSource)
    rows = spark.read.format("warc").option("path", str(archive)).load().orderBy("filename", "offset").collect()
    assert [(r["filename"], r["status"], r["location"], len(r["entity"])) for r in rows] == [(n, s, x, k) for n in ("one.warc.gz", "two.warc") for s, x, k in ((200, None, 9), (301, "/x", 9), (200, None, 3_000_000))]
    for r in rows:  # each record can be read again alone
        again = read_at(str(archive / r["filename"]), r["offset"], r["length"])
        assert (again[4], again[8]) == (r["url"], r["digest"])


def test_warc_errors(spark, archive, tmp_path):
    (tmp_path / "cut.warc.gz").write_bytes((archive / "one.warc.gz").read_bytes()[:-20])
    spark.dataSource.register(WarcDataSource)
    read = spark.read.format("warc").option("path", str(tmp_path))
    assert read.option("mode", "permissive").load().count() == 2
    with pytest.raises(Exception, match="cut short"):
        read.option("mode", "failfast").load().count()
    with pytest.raises(WarcError):
        header_lines(b"A: 1\r\na: 2")
    assert header_lines(b"A: 1\r\na: 2", strict=False) == {"a": "2"}
    with pytest.raises(WarcError):
        list(rows_of(b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", "f", 0, 1))
    assert [m[2] for m in gzip_members(str(archive / "one.warc.gz"))] == RECORDS


def test_wacz_round_trip(spark, archive, tmp_path):
    out = str(tmp_path / "c.wacz")
    package_writer.create_wacz(spark, str(archive), out, "t")
    assert packages.validate_wacz(spark, out).collect() == []
    with zipfile.ZipFile(out) as z:
        keys = [line.split(" ")[0] for line in z.read("indexes/index.cdx").decode().splitlines()]
        assert keys == sorted(keys) and keys[0] == "org,example,a)/"
        assert [json.loads(x)["id"] for x in z.read("pages/pages.jsonl").decode().splitlines()][0] == "pages"
        members = {n: z.read(n) for n in z.namelist()}
    members["pages/pages.jsonl"] += b"{}\n"
    lines = members["indexes/index.cdx"].decode().splitlines()
    members["indexes/index.cdx"] = ("\n".join(lines[::-1]) + "\n").encode()
    bad = str(tmp_path / "bad.wacz")
    with zipfile.ZipFile(bad, "w") as z:
        for n, data in members.items():
            z.writestr(n, data)
    problems = {(r["path"], r["problem"]) for r in packages.validate_wacz(spark, bad).collect()}
    assert ("pages/pages.jsonl", "mismatch") in problems and any(p == "unsorted" for _, p in problems)


def test_large_members_and_copies(spark, tmp_path, monkeypatch):
    """A record of 70 MB is no fault; one changed byte of it is, and so is a file that changes while it is copied."""
    from vellumspark.sources.warc import record_bytes

    folder, out = tmp_path / "w", str(tmp_path / "big.wacz")
    folder.mkdir()
    (folder / "big.warc").write_bytes(record_bytes("http://a.org/big", "2026-01-01T00:00:00Z", 200, "text/html", os.urandom(70 << 20)))
    package_writer.create_wacz(spark, str(folder), out)
    assert packages.validate_wacz(spark, out).collect() == []
    with open(out, "r+b") as f:
        f.seek(40 << 20)
        byte = f.read(1)
        f.seek(40 << 20)
        f.write(bytes([byte[0] ^ 1]))
    assert {r["problem"] for r in packages.validate_wacz(spark, out).collect()} >= {"checksum", "mismatch"}
    real = package_writer.measured

    def changing(spark, members):
        facts = real(spark, members)
        with open(folder / "big.warc", "ab") as f:
            f.write(b"x")
        return facts

    monkeypatch.setattr(package_writer, "measured", changing)
    with pytest.raises(Exception, match="changed while it was copied"):
        package_writer.create_wacz(spark, str(folder), str(tmp_path / "two.wacz"))
    assert sorted(os.listdir(tmp_path)) == ["big.wacz", "w"]  # nothing is left of it


def test_trees_listed_by_levels(spark, tmp_path):
    from vellumspark.operators import publish
    from vellumspark.sources import tree

    root = tmp_path / "t"
    (root / "a" / "b" / ".c").mkdir(parents=True)
    (root / "empty").mkdir()
    for n, data in (("a/x.txt", "x"), ("a/b/.c/é.txt", "y" * 9), (".hidden", ""), ("a/b/skip", "s")):
        (root / n).write_text(data)
    rows, odd = files.walk(str(root), ("a/b/skip",))
    got = tree.listing(spark, str(root), ("a/b/skip",))
    assert sorted(tuple(r)[:5] for r in got.collect()) == rows and odd == []
    assert tree.digest(spark, str(root)) == publish.tree_digest(str(root))
    before = tree.hashed(tree.listing(spark, str(root)), str(root)).collect()
    (root / "a" / "x.txt").write_text("z")
    (root / "new").write_text("n")
    (root / ".hidden").unlink()
    after = tree.hashed(tree.listing(spark, str(root)), str(root))
    stated = spark.createDataFrame(before, after.schema)
    assert {tuple(r) for r in tree.changes(stated, after).collect()} == {("a/x.txt", "changed"), ("new", "added"), (".hidden", "removed")}
    (root / "link").symlink_to("new")
    assert [tuple(r) for r in tree.problems(tree.listing(spark, str(root))).collect()] == [("link", "symbolic link")]
    with pytest.raises(files.ListingError):
        tree.digest(spark, str(root))


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("ok/a.xml", "<a/>")
        z.writestr("../up", "x")
        z.writestr("big", "0" * 1_000_000)
        link = zipfile.ZipInfo("link")
        link.external_attr = 0o120777 << 16
        z.writestr(link, "ok")
    spark.dataSource.register(ZipMembersDataSource)
    rows = spark.read.format("zip_members").option("path", str(tmp_path)).option("content", "true").load()
    assert {(r["name"], r["problem"]) for r in member_problems(rows, COLLECTION_LIMITS).collect()} == {("../up", "unsafe path"), ("big", "compression ratio"), ("link", "symbolic link")}
    assert rows.where("name = 'ok/a.xml'").first()["content"] == b"<a/>"


def test_listing_and_manifest(spark, tmp_path):
    root = tmp_path / "r"
    (root / "empty").mkdir(parents=True)
    (root / ".dot").write_text("a")
    (root / "_x").write_text("")
    rows, _ = files.objects(spark, str(root))
    assert [(r["path"], r["type"], r["size"]) for r in rows.collect()] == [(".dot", "file", 1), ("_x", "file", 0), ("empty", "directory", 0)]
    assert {r["sha256"] for r in rows.where("size = 0").collect()} == {EMPTY_SHA256}
    files.write_manifest(rows, str(tmp_path / "m"))
    back = files.fixity_manifest(spark, str(tmp_path / "m" / "manifest-sha256.json"))
    assert sorted(back.collect()) == sorted(rows.select(back.columns).collect())
    with pytest.raises(FileExistsError):
        files.write_manifest(rows, str(tmp_path / "m"))
    os.symlink("/nowhere", root / "l")
    with pytest.raises(files.ListingError):
        files.objects(spark, str(root))
    _, odd = files.objects(spark, str(root), strict=False)
    assert [tuple(r) for r in odd.collect()] == [("l", "symbolic link")]


def test_bag(spark, tmp_path):
    src = tmp_path / "src"
    (src / "d").mkdir(parents=True)
    (src / "a%b.txt").write_text("one")
    (src / "d" / "c.txt").write_text("two")
    bag = str(tmp_path / "bag")
    package_writer.create_bag(spark, str(src), bag, spark.createDataFrame([("a%b.txt",), ("d/c.txt",)], "path string"), [("Source", "here")])
    assert packages.validate_bag(spark, bag).collect() == []
    with open(os.path.join(bag, "bag-info.txt")) as f:
        assert f.read() == "Source: here\nPayload-Oxum: 6.2\n"
    with open(os.path.join(bag, "data", "d", "c.txt"), "w") as f:
        f.write("TWO")
    with open(os.path.join(bag, "data", "new"), "w") as f:
        f.write("")
    assert {(r["path"], r["problem"]) for r in packages.validate_bag(spark, bag).collect()} == {("data/d/c.txt", "mismatch"), ("data/new", "unexpected")}
    with pytest.raises(ValueError):
        packages.bag_info([("a:b", "c")])


def test_cdx_counts(spark, tmp_path):
    (tmp_path / "a.cdx").write_text(" CDX N b a\nx 1\ny 2\n")
    (tmp_path / "b.cdx").write_text("x 1\n")
    n = {os.path.basename(r["file"]): r["records"] for r in files.cdx_counts(spark, str(tmp_path)).collect()}
    assert n == {"a.cdx": 2, "b.cdx": None}
    assert files.cdx_total(files.cdx_counts(spark, str(tmp_path))).first()["records"] is None
    assert files.cdx_total(files.cdx_counts(spark, str(tmp_path), header=False)).first()["records"] == 3


def test_config_inherits(spark, tmp_path):
    (tmp_path / "c.toml").write_text('[defaults]\nkind = "http-file"\nhosts = ["a.org"]\n[[collections]]\nid = "one"\nenabled = false\n[[collections.sources]]\nid = "s1"\nkind = "web"\n[[collections.sources]]\nid = "s2"\n')
    c, s = files.config(spark, str(tmp_path / "c.toml"))
    assert [(r["collection_id"], r["enabled"]) for r in c.collect()] == [("one", False)]
    assert [(r["source_id"], r["kind"], r["hosts"]) for r in s.orderBy("ordinal").collect()] == [("s1", "web", ["a.org"]), ("s2", "http-file", ["a.org"])]


def test_strict_json():
    assert files.strict_json('{"a": [1, null]}') == {"a": [1, None]}
    for bad in ('{"a": 1, "a": 2}', "[NaN]", "[1"):
        with pytest.raises(ValueError):
            files.strict_json(bad)


def test_named_files(spark):
    listing = spark.createDataFrame([("x/a.zip?v=1", "file"), ("y/b.zip", "file"), ("z/b.zip", "file"), ("a.zip", "directory")], "path string, type string")
    one, twice = files.named_files(listing, ".zip")
    assert [tuple(r) for r in one.collect()] == [("a.zip", "x/a.zip?v=1")] and [tuple(r) for r in twice.collect()] == [("b.zip", 2)]
    assert one.where(F.col("name") == "b.zip").count() == 0
