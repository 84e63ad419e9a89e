"""Sharding by histogram sort: splitters from exact counts, then one exchange.

Documents are ordered by a 64-bit key: 40 bits of a hash of the text, then 24 bits of a hash of
the id and of the row's place in the input, so that equal texts stand together and a large group
of them can still be cut, even one of rows alike in text and id. Splitters
that divide the bytes evenly are found by rounds: each counts, in one pass over a table of keys
and sizes, the exact bytes and rows below candidate keys, and the brackets around each target
shrink until the nearer end meets the tolerance or no row is left inside. The counts also give
each part's first slot, so one exchange of the documents and a sort within each part suffice.

A shard is a run of parts, as many as the cluster's shuffle partitions ask for; a shard may
therefore be far larger than what one task holds.

Cases: a null text has size 1 and is grouped with other nulls; empty texts count as texts of
size 1; repeated rows are dealt like any others; a very long text is one row, and a shard may
be off by its size; an empty table gives no rows; a document's own columns named like a result
column are replaced, all others pass through. The input is read twice and must give the same
rows in the same partitions: a scan does, anything else is written first (``steady``).
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.llm._store import materialize, steady

SHARDS = 16
#: Bytes by which a splitter may miss its target: this share of a shard, or of a part within one.
TOLERANCE, INNER_TOLERANCE = 0.0005, 0.05
PROBES, TIE_BITS = 7, 24
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def sort_key(doc_id: Column, text: Column) -> Column:
    tie = F.xxhash64(doc_id, F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << TIE_BITS) - 1))
    return F.shiftleft(F.shiftright(F.xxhash64(text), TIE_BITS), TIE_BITS).bitwiseOR(tie)


def counts_below(keys: DataFrame, probes: list[int]) -> tuple[list[int], list[int]]:
    """Exact bytes and rows with a key below each of the sorted probes."""
    at = np.array(probes, np.int64)

    def bins(batches):
        rows, size = np.zeros(len(at) + 1, np.int64), np.zeros(len(at) + 1, np.int64)
        for b in batches:
            place = np.searchsorted(at, b.column("key").to_numpy(), "right")
            rows += np.bincount(place, minlength=len(rows))
            np.add.at(size, place, b.column("size").to_numpy())
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(rows[some]), pa.array(size[some])], ["bin", "n", "bytes"])

    got = {r["bin"]: r for r in keys.mapInArrow(bins, "bin long, n long, bytes long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    size, rows, s, n = [], [], 0, 0
    for k in range(len(probes)):  # bin k: keys from probe k - 1 up to below probe k
        if k in got:
            s, n = s + got[k]["bytes"], n + got[k]["n"]
        size.append(s)
        rows.append(n)
    return size, rows


def find_splitters(keys: DataFrame, parts: int, per_shard: int) -> tuple[list[int], list[int], int]:
    """The first key of each part but the first, the rows before each part, and the rounds."""
    total = keys.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
    known = {LOW: (0, 0), HIGH: (total["b"], total["n"])}
    targets = [total["b"] * j // parts for j in range(1, parts)]
    tol = [total["b"] / parts * (TOLERANCE * per_shard if j % per_shard == 0 else INNER_TOLERANCE) for j in range(1, parts)]
    probes = sorted({LOW + (1 << 64) * k // (parts * PROBES) for k in range(1, parts * PROBES)}) if total["n"] else []
    rounds = 0
    while probes:
        rounds += 1
        known.update(zip(probes, zip(*counts_below(keys, probes))))
        order, probes = sorted(known), set()
        size = [known[k][0] for k in order]
        for t, e in zip(targets, tol):
            i = int(np.searchsorted(size, t, "right")) - 1
            i = min(i, len(order) - 2)
            lo, hi = order[i], order[i + 1]
            if min(t - size[i], size[i + 1] - t) <= e or known[hi][1] - known[lo][1] <= 1 or hi - lo <= 1:
                continue
            guess = lo + (hi - lo) * (t - size[i]) // max(1, size[i + 1] - size[i])
            probes |= {p for p in [lo + (hi - lo) * k // PROBES for k in range(1, PROBES)] + [guess, guess + 1] if lo < p < hi}
        probes = sorted(probes)
    order = sorted(known)
    size = [known[k][0] for k in order]
    near = []
    for t in targets:
        i = min(int(np.searchsorted(size, t, "right")) - 1, len(order) - 2)
        near.append(order[i] if t - size[i] <= size[i + 1] - t else order[i + 1])
    near = np.maximum.accumulate(np.array(near, np.int64)).tolist() if near else []
    return near, [0] + [known[k][1] for k in near], rounds


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text") -> DataFrame:
    """``docs`` with size, shard and slot; sizes of shards are near equal, slots gapless from 0."""
    spark, docs = docs.sparkSession, steady(docs)
    per_shard = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards)
    parts = shards * per_shard
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("size", "shard", "slot", "_hs_key", "_hs_part")]
    t = F.col(f"`{text}`")
    sized = docs.select(*own, sort_key(F.col("doc_id"), t).alias("_hs_key"), (F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + 1).alias("size"))
    keys = materialize(sized.select(F.col("_hs_key").alias("key"), "size"))
    splitters, before, _ = find_splitters(keys, parts, per_shard)
    at = np.array(splitters, np.int64)

    def part(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, key.to_numpy(), "right").astype(np.int32))

    placed = sized.withColumn("_hs_part", F.pandas_udf(part, "int")("_hs_key"))
    ordered = placed.repartitionById(parts, "_hs_part").sortWithinPartitions("_hs_key", "doc_id")
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    first = [before[p] - before[p - p % per_shard] for p in range(parts)]
    slot = F.element_at(F.lit(first).cast("array<bigint>"), F.col("_hs_part") + 1) + F.col("_hs_index")
    out = ordered.withColumn("_hs_index", index).withColumns({"shard": F.floor(F.col("_hs_part") / per_shard).cast("int"), "slot": slot})
    return out.drop("_hs_key", "_hs_part", "_hs_index")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder of Parquet files for each shard."""
    sharded.write.partitionBy("shard").parquet(path)
