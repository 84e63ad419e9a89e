"""Cases that only tables larger than the samples show."""

import io
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from vellumspark.operators import capture_record, catalogue, publish
from vellumspark.plans import file_queries, record_queries, registry
from vellumspark.sources import access, files, json_parts
from vellumspark.sources.files import ListingError


def test_dense_ids_of_more_rows_than_the_bounds_are_sampled_from(spark):
    d = spark.range(60_000, numPartitions=8).select((F.col("id") * 7919 % 60_000).alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.lit("en").alias("lang"), F.concat(F.lit("t"), "id").alias("text"))
    got = [tuple(r) for r in catalogue.from_documents(d).select("docid", "collection_id", "representation_id", "body_sha256").collect()]
    assert sorted(x[:3] for x in got) == [(k, *x) for k, x in enumerate(sorted(x[1:3] for x in got), 1)]


def rows_and_sql(spark, query, folder, tables):
    """The rows of a query over a folder and those of its SQL."""
    run, sql = registry.queries()[query], registry.oracle_sql()[query]
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    got = run(spark, str(folder))
    columns = sorted(got.columns)
    names = ", ".join(f'"{x}"' for x in columns)
    return sorted(map(str, (tuple(r) for r in got.select(columns).collect()))), sorted(map(str, c.sql(f"select {names} from ({sql})").fetchall()))


def customers(folder, n, nations):
    duckdb.connect().execute(f"copy (select i as c_custkey, 'Customer' || i as c_name, (i % {nations})::int as c_nationkey, 'BUILDING' as c_mktsegment from range({n}) t(i)) to '{folder}/customer.parquet'")


def test_a_graph_is_streamed(monkeypatch):
    monkeypatch.setattr(json_parts, "CHUNK", 64)
    doc = {"relations": None, "items": [{"id": f"é{k}", "x": ["]", {"a": "\\"}]} for k in range(1000)], "more": [1, 2.5], "artifacts": []}
    f = io.StringIO(json.dumps(doc, indent=1, ensure_ascii=False))
    rows = json_parts.parts_of(f, "collection", ["items", "artifacts", "relations"])
    first = next(rows)
    assert f.tell() < 1000 and (first[:3], json.loads(first[3])) == ((0, "items", 0), doc["items"][0])
    rest = list(rows)
    assert [json.loads(r[3]) for r in rest[:-1]] == doc["items"][1:] and rest[-1] == (0, "collection", 0, "null")
    for bad in ('{"items":[1,]}', '{"items":{}}', '{"items":[1]', '{"items":[]} x', '{"items":[],"items":[]}', "[{}"):
        with pytest.raises(ListingError):
            list(json_parts.parts_of(io.StringIO(bad), "collection", ["items"]))
    assert list(json_parts.parts_of(io.StringIO('[{"collection": 12}, {}]'), "collection", [])) == [(0, "collection", 0, "12"), (1, "collection", 0, "null")]


def test_no_task_holds_a_graph(spark, tmp_path):
    """Elements reach Spark as rows of their own, so the widest row is that of an element."""
    customers(tmp_path, 4_300, 2)
    folder = file_queries._graphs(spark, str(tmp_path))
    n = json_parts.json_parts(spark, f"file://{folder}", "collection", ["items", "artifacts", "relations"]).groupBy("part").agg(F.count("*").alias("n"), F.max(F.length("value")).alias("size"))
    got = {r["part"]: (r["n"], r["size"] < 2000) for r in n.collect()}
    assert got == {"collection": (2, True), "items": (4_300, True), "artifacts": (4_300, True), "relations": (2, True)}


def test_faults_of_graphs_beyond_the_rows_of_a_collection(spark, tmp_path):
    customers(tmp_path, 4_300, 2)
    got, want = rows_and_sql(spark, "access_problems", tmp_path, ["customer"])
    assert got == want
    t = access.load(spark, file_queries._graphs(spark, str(tmp_path)))
    assert sorted(r["id"] for r in access.size_problems(t).collect()) == ["tp:n0/collection", "tp:n1/collection"]


def test_captures_stand_on_disk_by_the_batch(spark, tmp_path, monkeypatch):
    duckdb.connect().execute(f"copy (select i as p_partkey from range(300) t(i)) to '{tmp_path}/part.parquet'")
    seen = []
    read = record_queries.files.captured
    monkeypatch.setattr(record_queries, "AT_ONCE", 100)
    monkeypatch.setattr(record_queries.files, "captured", lambda s, folder: seen.append((folder, len(os.listdir(folder)))) or read(s, folder))
    for query in ("capture_roles", "capture_problems"):
        got, want = rows_and_sql(spark, query, tmp_path, ["part"])
        assert got == want
    assert len(seen) == 6 and sum(n for _, n in seen) == 600 and max(n for _, n in seen) < 150
    assert not any(os.path.exists(folder) for folder, _ in seen)


@pytest.mark.parametrize("query", ["capture_roles", "capture_problems"])
def test_a_batch_takes_over_the_folders_of_the_one_before(spark, tmp_path, monkeypatch, query):
    duckdb.connect().execute(f"copy (select i as p_partkey from range(3000) t(i)) to '{tmp_path}/part.parquet'")
    seen, read = [], record_queries.files.captured

    def captured(s, folder):
        places = [os.path.join(folder, name, "sources/a/warc") for name in os.listdir(folder)]
        seen.append((folder, len(places), sum(os.stat(at).st_mtime == 1 for at in places)))
        for at in places:
            os.utime(at, (1, 1))  # stays as long as nothing is made or removed there
        return read(s, folder)

    monkeypatch.setattr(record_queries, "AT_ONCE", 1000)
    monkeypatch.setattr(record_queries.files, "captured", captured)
    got, want = rows_and_sql(spark, query, tmp_path, ["part"])
    assert got == want
    assert seen[0][2] == 0 and all(taken > n * 0.7 for _, n, taken in seen[1:]) and sum(n for _, n, _ in seen) == 3000
    assert not any(os.path.exists(folder) for folder, _, _ in seen)


def test_a_capture_is_written_again_by_a_second_run_of_its_task(tmp_path):
    held = {"capture.json": "é" * 10, "sources/a/x": "w"}
    record_queries._take(str(tmp_path / "c1"), held, [])
    for spare in (["c1"], ["c1"], []):  # taken, gone, none
        record_queries._take(str(tmp_path / "c2"), held | {"capture.json": "{}"}, spare)
        assert os.listdir(tmp_path) == ["c2"] and (tmp_path / "c2/capture.json").read_text() == "{}" and (tmp_path / "c2/sources/a/x").read_text() == "w"


def test_files_of_captures_are_listed_and_links_to_folders_are_errors(spark, tmp_path):
    for k in range(50):
        os.makedirs(tmp_path / f"c{k}" / "a" / "b")
        for name in ("capture.json", "a/x", "a/b/.y"):
            (tmp_path / f"c{k}" / name).write_text("{}")
    records, listed = files.captured(spark, str(tmp_path))
    assert listed.count() == 150 and records.where("document = '{}'").count() == 50
    assert {r["path"] for r in listed.where("capture = 'c7'").collect()} == {"capture.json", "a/x", "a/b/.y"}
    os.symlink(tmp_path, tmp_path / "c7" / "a" / "to")
    with pytest.raises(Exception, match="is no regular file"):
        files.captured(spark, str(tmp_path))[1].count()


def test_records_and_listing_of_captures_are_read_once(spark, tmp_path):
    def told(rows, schema, name):
        at = str(tmp_path / name)

        def run(batches):
            for b in batches:
                with open(at, "a") as f:
                    f.write("x" * len(b))
                yield b

        return spark.createDataFrame(rows, schema).coalesce(1).mapInPandas(run, schema)

    role = '{"path":"capture.json","role":"metadata"}'
    documents = ["[]", '{"schema_version":9}', '{"schema_version":3}', "{}", f'{{"schema_version":3,"payload_roles":[{role}]}}', f'{{"schema_version":3,"payload_roles":[{role},{role},{{"a":1}},{{"b":1}}]}}', None]
    records = told([(f"c{k}", d) for k, d in enumerate(documents)], "capture string, document string", "records")
    listed = told([(f"c{k}", "capture.json") for k in range(len(documents))], "capture string, path string", "files")
    good, bad = capture_record.verified(records, listed, spark.createDataFrame([], "capture string, source_id string, kind string"))
    assert sorted(tuple(r) for r in good.collect()) == [("c3", 1, "capture.json", "metadata", False), ("c4", 3, "capture.json", "metadata", True)]
    assert sorted(((r["capture"], r["problem"], r["detail"]) for r in bad.collect()), key=str) == [
        ("c0", "no object", None), ("c1", "unknown schema", "9"), ("c2", "no list of roles", None), ("c5", "no path and role", "2"), ("c5", "no path and role", "3"), ("c5", "repeated path", "capture.json"), ("c6", "no object", None),
    ]
    assert (tmp_path / "records").stat().st_size == (tmp_path / "files").stat().st_size == len(documents)


def test_claims_are_not_synced(tmp_path, monkeypatch):
    synced = []
    monkeypatch.setattr(publish.os, "fsync", synced.append)
    (tmp_path / "g1").mkdir()
    assert publish.record_validation(str(tmp_path), str(tmp_path / "g1"), True)
    assert len(synced) == 2 and sorted(os.listdir(tmp_path)) == ["LATEST", "LATEST-VALIDATED", "g1"]
    with publish.Claim(str(tmp_path)) as one, publish.Claim(str(tmp_path)) as two:
        assert one.held and not two.held
