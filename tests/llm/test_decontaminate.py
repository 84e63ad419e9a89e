"""Decontamination where ids are null or repeated."""

import pyarrow.parquet as pq

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_ids_null_or_repeated(spark):
    item = max((r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()), key=len)
    clean = " ".join(f"plain{k}" for k in range(40))
    rows = [(None, "head " + item), (None, clean), (None, None), (3, item + " tail"), (3, clean + " more"), (4, clean)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminate(spark, docs, SF).collect()]
    assert sorted(got, key=str) == sorted((r for k, r in enumerate(rows) if k not in (0, 3)), key=str)
