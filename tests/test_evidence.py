import gzip
import hashlib

import pytest

from tests.test_sources import RECORDS
from vellumspark.operators import evidence
from vellumspark.sources.files import ListingError
from vellumspark.sources.warc import WarcDataSource


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("w")
    (d / "a.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in RECORDS))
    return d


def test_redirects_and_probes(spark, folder, tmp_path):
    spark.dataSource.register(WarcDataSource)
    rows = spark.read.format("warc").option("path", str(folder)).load()
    assert [tuple(r) for r in evidence.observed_redirects(rows).collect()] == [("http://a.example.org/", "http://a.example.org/x")]
    assert evidence.logical_bytes(rows, 100).first()["bytes"] == 100
    assert evidence.has_web_records(spark, str(folder)) and not evidence.has_web_records(spark, str(folder), prefix=1)
    (tmp_path / "i.warc").write_bytes(RECORDS[0])
    assert not evidence.has_web_records(spark, str(tmp_path))


def test_recovered(spark):
    data = gzip.compress(b"inner")
    sha, inner = hashlib.sha256(data).hexdigest(), hashlib.sha256(b"inner").hexdigest()
    expected = spark.createDataFrame([(n, sha, inner if n != "d" else "0") for n in "abcde"], "name string, sha256 string, inner_sha256 string")
    files = spark.createDataFrame([("a", sha, data), ("b", "x", data), ("c", sha, data), ("c", sha, data), ("d", sha, data)], "name string, sha256 string, content binary")
    assert {tuple(r) for r in evidence.recovered(expected, files).collect()} == {("b", "fixity"), ("c", "several"), ("d", "payload"), ("e", "missing")}
    assert evidence.gunzipped_digest(data[:-3]) is None and evidence.gunzipped_digest(data, 2) is None


def test_expected_ids(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    digest = hashlib.sha256(b"a\nb\n").hexdigest()
    assert evidence.expected_ids(ids.limit(0), ids, 2, digest).count() == 2
    assert evidence.expected_ids(ids.limit(1), ids, 9, "").count() == 1
    with pytest.raises(ListingError):
        evidence.expected_ids(ids.limit(0), ids, 3, digest)


def test_limits_and_snapshots(spark):
    rows = spark.createDataFrame([("a", "file", 5, "x"), ("b", "directory", 0, "y")], "path string, type string, size long, sha256 string")
    assert evidence.over_limits(rows, 0, 1, 4).first()["broken"] == ["files", "bytes"]
    assert evidence.unchanged(rows, rows) and not evidence.unchanged(rows, rows.limit(1))


def test_page_entries(spark):
    lines = ['{"format":"json-pages-1.0"}', '{"id":"1","url":"http://a","ts":"2024-01-01T00:00:00Z"}', '{"id":"","url":"http://a","ts":"2024-01-01T00:00:00Z"}', '{"id":"1","url":"a","ts":"2024-01-01T00:00:00Z"}', '{"id":"1","url":"http://a","ts":"2024-01-01"}']
    df = spark.createDataFrame(list(enumerate(lines)), "line int, value string")
    assert {tuple(r) for r in evidence.page_entry_problems(df).collect()} == {(2, "id"), (3, "url"), (4, "time")}
    assert [tuple(r) for r in evidence.page_entry_problems(spark.createDataFrame([(0, "{}")], "line int, value string")).collect()] == [(0, "header")]


def test_bundle(tmp_path):
    src = tmp_path / "src"
    (src / "d").mkdir(parents=True)
    (src / "a.py").write_text("a")
    (src / "d" / "b.toml").write_text("b")
    (src / "a.pyc").write_text("no")
    entries, digest = evidence.scan_bundle(str(src))
    assert [e["path"] for e in entries] == ["a.py", "d/b.toml"]
    assert [e["path"] for e in evidence.scan_bundle(str(src), ["a.py"])[0]] == ["a.py"]
    assert evidence.copy_bundle(str(src), str(tmp_path / "out" / "bundle")) == digest == evidence.scan_bundle(str(tmp_path / "out" / "bundle"))[1]
    with pytest.raises(ListingError):
        evidence.scan_bundle(str(src), ["none"])


def test_summaries(spark):
    c = spark.createDataFrame([("b", "B"), ("a", "A")], "collection_id string, label string")
    s = spark.createDataFrame([("a", True), ("a", False)], "collection_id string, required boolean")
    assert [tuple(r) for r in evidence.collection_summaries(c, s).collect()] == [("a", "A", 2, 1), ("b", "B", 0, 0)]


@pytest.mark.parametrize("budgets", [(100, 230, 1000), (1000, 1000, 4), (64, 64, 9), (10, 5, 3), (1 << 30, 1 << 30, 1 << 30)])
def test_budgets_as_one_reader_takes_them(spark, budgets):
    """The same records and warnings as from reading file after file, cut at the bytes of each and of all."""
    import random

    r = random.Random(5)
    rows = [(f"f{r.randint(0, 5)}", k, r.choice([0, 3, 17, 40])) for k in range(90)]
    per_file, total, most = budgets
    want, cut, used = [], {}, 0
    for name in sorted({x[0] for x in rows}):
        size, limit = sum(x[2] for x in rows if x[0] == name), min(per_file, max(0, total - used))
        at = 0
        for _, offset, n in sorted(x for x in rows if x[0] == name):
            at += n
            if at <= limit and len(want) < most:
                want.append((name, offset, n))
        used += min(size, limit)
        if size > limit:
            cut[name] = "byte limit reached" if not limit else f"cut at {limit} bytes"
    df = spark.createDataFrame(r.sample(rows, len(rows)), "filename string, offset long, size long").repartition(3)
    taken, warnings = evidence.within_budgets(df, "size", *budgets)
    assert sorted(tuple(x) for x in taken.select("filename", "offset", "size").collect()) == want
    assert {x["filename"]: x["warning"] for x in warnings.collect()} == cut


def test_pointers_move_together_or_not_at_all(tmp_path, monkeypatch):
    from concurrent.futures import ThreadPoolExecutor

    from vellumspark.operators import publish

    root = str(tmp_path)
    for g in "abcdefgh":
        (tmp_path / g).mkdir()
    at = lambda g: str(tmp_path / g)
    read = lambda n: publish.read_pointer(at(n), root)
    assert publish.record_validation(root, at("a"), False) and read("LATEST") == at("a") and read("LATEST-VALIDATED") is None
    assert publish.record_validation(root, at("b"), True) and read("LATEST") == read("LATEST-VALIDATED") == at("b")
    real = publish.atomic_write

    def failing(path, data, replace=True):
        if path.endswith("VALIDATED"):
            raise OSError("disk full")
        return real(path, data, replace)

    monkeypatch.setattr(publish, "atomic_write", failing)
    with pytest.raises(OSError):
        publish.record_validation(root, at("c"), True)
    monkeypatch.setattr(publish, "atomic_write", real)
    assert read("LATEST") == read("LATEST-VALIDATED") == at("b") and not (tmp_path / ".claim").exists()
    with pytest.raises(ListingError):
        publish.move_together(root, {"NEW": at("c"), "LATEST": str(tmp_path / "nowhere")})
    assert read("NEW") is None and read("LATEST") == at("b")
    with ThreadPoolExecutor(6) as pool:
        won = list(pool.map(lambda g: publish.move_together(root, {"LATEST": at(g)}, {"LATEST": at("b")}), "cdefgh"))
    assert sum(won) == 1 and read("LATEST") == at("cdefgh"[won.index(True)])
    (tmp_path / ".claim").write_text("lost")
    assert not publish.move_together(root, {"LATEST": at("a")})
    with publish.Claim(root, stale=-1) as claim:
        assert claim.held
    assert publish.move_together(root, {"LATEST": at("a")}) and read("LATEST") == at("a")
