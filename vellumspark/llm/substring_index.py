"""Substring dedup with a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words. Windows that are equal have the same anchor, the
smallest hash of the short runs of words inside them, so an index of anchors finds every
repeated window with about a fifth of the entries. Neighbouring windows with one anchor are one
unit: an entry of the index has the anchor, a hash of the unit's words, and where it stands.

The index is log-structured and lasts: each batch of documents becomes a sorted immutable run,
bucketed by anchor, in a folder whose manifest names the runs; it can be opened again in another
session. A new batch is merge-joined with all runs, without an exchange of theirs. Where all units
of an anchor have the same words, as inside most repeated passages, they are settled by the join
alone, by 64 bits beside the anchor's 64. Only under anchors whose units differ are windows
compared one by one on the texts, by hashes of all their words (96 bits). Two runs of a tier are
compacted into one of the next.

``dedup`` treats a whole table, its batches in ascending order of doc_id; ``dedup_batch`` a new batch
against an index of history. Texts of history are read only for documents with differing units.

Cases: doc_id is a whole number or a text (compared by its bytes; other types are taken as texts);
null and empty texts have no words; texts shorter than a window keep all; a null doc_id ranks
after all others; rows that share a doc_id, null ones too, never remove each other's words and are
told apart by a 64-bit hash of the text; ties and repeated rows keep the same words; an empty
table gives no rows; texts are read whole, whatever their length; other columns are left out
unless named in ``carry``, where one that bears a result's name gets ``own_`` before it.
"""

import json
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from vellumspark.llm._store import Scratch, discard, shared_dir
from vellumspark.llm._text import gram_hashes, inside, mixed, owners, ragged, slices, word_hashes, words_of

WINDOW, GRAM = 13, 5
#: Factors of the anchors' hashes and of the two hashes of a window.
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: Runs of a tier that are compacted into one.
FAN_IN = 2
#: Filter: bits for an entry, and least and greatest size in bits (32 MB). More entries than that
#: holds are joined instead.
BITS_EACH, LEAST_BITS, MOST_BITS, BLOCK_BITS = 12, 1 << 20, 1 << 28, 1 << 16
LAST = (1 << 63) - 1
#: Bytes of text that a task looks at together: a word costs it some ten numbers for a moment.
SLICE = 2_000_000


def anchors_of(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, first word and anchor of every window."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    g = gram_hashes(hashes, GRAM, FACTORS[0])
    least = g[:n].copy()
    for j in range(1, WINDOW - GRAM + 1):
        np.minimum(least, g[j : j + n], out=least)
    at = np.flatnonzero(inside(offsets, WINDOW, len(hashes)))
    return owners(offsets)[at], at, least[at]


def windows_of(texts) -> tuple:
    """Of every window: text number, first word in its text, anchor and two hashes of its words."""
    flat, offsets = words_of(texts)
    h = word_hashes(flat)
    own, at, a = anchors_of(h, offsets)
    w, v = (gram_hashes(h, WINDOW, f)[at] if len(at) else np.empty(0, np.uint64) for f in FACTORS[1:])
    return own, at - offsets[own], a, w, v


def rank_of(docs: DataFrame) -> Column:
    """The order of doc_id as a long, or as a text that puts null last."""
    c = F.col("doc_id")
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        return F.coalesce(c.cast("long"), F.lit(LAST))
    return F.when(c.isNull(), "1").otherwise(F.concat(F.lit("0"), c.cast("string")))


def kind_of(docs: DataFrame) -> str:
    return "long" if isinstance(docs.schema["doc_id"].dataType, IntegralType) else "string"


def ranked(docs: DataFrame, *more: Column) -> DataFrame:
    """doc (the rank of its id), row (a hash of id and text) and text."""
    return docs.select(rank_of(docs).alias("doc"), F.xxhash64("doc_id", "text").alias("row"), "text", *more)


def ordinal(doc: Column, kind: str) -> Column:
    """A long in the order of ranks, with ties among long texts."""
    if kind == "long":
        return doc
    return F.conv(F.hex(F.substring(F.rpad(doc.cast("binary"), 7, F.lit(b"\0")), 1, 7)), 16, 10).cast("long")


def units(docs: DataFrame) -> DataFrame:
    """anchor, words, doc, row and place of all units. A place is 16 times the first word's number,
    and windows less one; a unit has at most WINDOW of them, so that its first and last hold all words."""

    def run(batches):
        for batch in slices(batches, limit=SLICE):
            own, at, a, w, v = windows_of(batch.column("text"))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(new)
            length = np.diff(np.append(first, len(a)))
            pieces = -(-length // WINDOW)
            start = np.repeat(first, pieces) + WINDOW * ragged(np.zeros_like(pieces), pieces)
            n = np.minimum(start + WINDOW, np.repeat(first + length, pieces)) - start
            words = mixed(mixed(w[start] + np.uint64(3) * v[start + n - 1]) + n.astype(np.uint64)) if len(a) else w
            text = pa.array(own[start])
            yield pa.RecordBatch.from_arrays([pa.array(a[start].view(np.int64)), pa.array(words.view(np.int64)), batch.column("doc").take(text), batch.column("row").take(text), pa.array(at[start] << 4 | n - 1)], ["anchor", "words", "doc", "row", "place"])

    return ranked(docs).mapInArrow(run, f"anchor long, words long, doc {kind_of(docs)}, row long, place long")


class FingerprintIndex:
    """Sorted immutable runs of units in a folder that driver and executors share.

    ``kind``: long or string, the type of ranks. An index that the folder already has is opened."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fan_in: int = FAN_IN, kind: str = "long"):
        self.spark, self.folder = spark, folder or shared_dir(spark)
        self.state = self._manifest() or {"version": 0, "buckets": int(spark.conf.get("spark.sql.shuffle.partitions")), "fan_in": fan_in, "kind": kind, "runs": []}
        for _, name in self.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (anchor BIGINT, words BIGINT, doc {self.state['kind']}, row BIGINT, place BIGINT) USING parquet CLUSTERED BY (anchor) SORTED BY (anchor) INTO {self.state['buckets']} BUCKETS LOCATION '{self.folder}/{name}'")

    @property
    def runs(self) -> list[tuple[int, str]]:
        return [(t, n) for t, n in self.state["runs"]]

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), lambda name: self.spark._jvm.org.apache.hadoop.fs.Path(path, name)

    def _manifest(self) -> dict | None:
        """The newest of the manifests in the folder."""
        fs, at = self._files()
        found = [f.getPath() for f in fs.globStatus(at("manifest-*.json")) or []]
        if not found:
            return None
        return json.loads(self.spark.read.text(max(found, key=lambda p: p.getName()).toString(), wholetext=True).first()[0])

    def _commit(self, runs: list[tuple[int, str]]) -> None:
        """A new manifest, put in its place by one renaming; the last one is kept, older ones go."""
        self.state = self.state | {"version": self.state["version"] + 1, "runs": runs}
        fs, at = self._files()
        name, temp = f"manifest-{self.state['version']:012d}.json", at(f".{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        if not fs.rename(temp, at(name)):
            raise RuntimeError(f"another writer has changed the index in {self.folder}")
        for f in fs.globStatus(at("manifest-*.json")):
            if f.getPath().getName() < f"manifest-{self.state['version'] - 1:012d}.json":
                fs.delete(f.getPath(), False)

    def _write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        rows.repartition(self.state["buckets"], "anchor").write.bucketBy(self.state["buckets"], "anchor").sortBy("anchor").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        discard(self.spark, f"{self.folder}/{name}")

    def rows(self) -> DataFrame:
        """All entries. Runs have equal buckets, so they are still dealt by anchor."""
        out = self.spark.table(self.runs[0][1])
        for _, n in self.runs[1:]:
            out = out.unionByName(self.spark.table(n))
        return out

    def ingest(self, batch: DataFrame, keep: list | None = None) -> tuple[DataFrame, DataFrame]:
        """Add a batch of units. Returns (row, place) of its units that stand in a document with a
        smaller id, as far as units tell, and (anchor) of the batch whose units have different words."""
        old = self.rows() if self.runs else None
        name = self._write(batch)
        new = self.spark.table(name)
        summary = [F.min("doc").alias("least"), F.max("doc").alias("most"), F.min("words").alias("low"), F.max("words").alias("high")]
        known = new.groupBy("anchor").agg(*summary)
        if old is not None:
            past = old.groupBy("anchor").agg(*[c for c in summary]).withColumnsRenamed({"least": "p_least", "most": "p_most", "low": "p_low", "high": "p_high"})
            both = known.hint("merge").join(past, "anchor", "left")
            known = both.select("anchor", F.least("least", "p_least").alias("least"), F.greatest("most", "p_most").alias("most"), F.least("low", "p_low").alias("low"), F.greatest("high", "p_high").alias("high"))
        s = Scratch(self.spark)
        known = s.keep(known.where("least <> most").select("anchor", "least", (F.col("low") == F.col("high")).alias("alike")))
        settled = s.keep(new.join(known.where("alike"), "anchor").where("doc > least").select("row", "place"))
        differ = s.keep(known.where("not alike").select("anchor"))
        s.drop(known)
        self._commit([*self.runs, (0, name)])
        if keep is not None:
            keep.append(s)
        return settled, differ

    def compact(self) -> None:
        """Merge runs of a tier, from the lowest up, while a tier has ``fan_in`` of them."""
        while True:
            tiers = [t for t, _ in self.runs]
            full = [t for t in sorted({*tiers}) if tiers.count(t) >= self.state["fan_in"]]
            if not full:
                return
            old = [n for t, n in self.runs if t == full[0]]
            rows = self.spark.table(old[0])
            for n in old[1:]:
                rows = rows.unionByName(self.spark.table(n))
            name = self._write(rows)
            self._commit([(t, n) for t, n in self.runs if n not in old] + [(full[0] + 1, name)])
            for n in old:
                self._drop(n)

    def close(self) -> None:
        """Forget the tables; the folder stays."""
        for _, name in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def delete(self) -> None:
        for _, name in self.runs:
            self._drop(name)
        discard(self.spark, self.folder)


def member_filter(values: DataFrame) -> tuple[int, dict[int, bytes]]:
    """A blocked Bloom filter of the longs in the only column: bits in all, and its blocks. The
    size follows the count up to MOST_BITS; blocks are built on executors, each by one task."""
    (name,) = values.columns
    n = values.count()
    bits = LEAST_BITS
    while bits < min(MOST_BITS, n * BITS_EACH):
        bits *= 2
    blocks = bits // BLOCK_BITS

    def build(batches):
        made: dict[int, np.ndarray] = {}
        for b in batches:
            x = mixed(b.column(0).to_numpy().view(np.uint64))
            block = _blocks(x, blocks)
            order = np.argsort(block, kind="stable")
            x, block = x[order], block[order]
            first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(x) else np.empty(0, np.int64)
            for a, e in zip(first, np.append(first[1:], len(x))):
                bitmap = made.setdefault(int(block[a]), np.zeros(BLOCK_BITS // 8, np.uint8))
                for s in _spots(x[a:e]):
                    np.bitwise_or.at(bitmap, s >> 3, np.uint8(1) << (s & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([*made], pa.int64()), pa.array([v.tobytes() for v in made.values()], pa.binary())], ["block", "bits"])

    def place(x: pd.Series) -> pd.Series:
        return pd.Series(_blocks(mixed(x.to_numpy().view(np.uint64)), blocks))

    at = F.pandas_udf(place, "long")(name)
    rows = values.repartition(min(blocks, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))), at).mapInArrow(build, "block long, bits binary")
    return blocks, {r["block"]: bytes(r["bits"]) for r in rows.collect()}


def _blocks(x: np.ndarray, blocks: int) -> np.ndarray:
    return ((x >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)


def _spots(x: np.ndarray) -> list[np.ndarray]:
    return [((x >> np.uint64(s)) & np.uint64(BLOCK_BITS - 1)).astype(np.int64) for s in (0, 12, 24)]


def flat_filter(blocks: int, parts: dict[int, bytes]) -> np.ndarray:
    out = np.zeros((blocks, BLOCK_BITS // 8), np.uint8)
    for k, v in parts.items():
        out[k] = np.frombuffer(v, np.uint8)
    return out


def passes(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values may be members."""
    x = mixed(values)
    block = _blocks(x, len(table))
    ok = np.ones(len(x), bool)
    for s in _spots(x):
        ok &= (table[block, s >> 3] >> (s & 7).astype(np.uint8) & 1).astype(bool)
    return ok


def capacity() -> int:
    return MOST_BITS // BITS_EACH


def single_windows(docs: DataFrame, differ: DataFrame, entries: DataFrame) -> DataFrame:
    """w, v, doc, row and place of the windows under the anchors of ``differ``. As many anchors as the
    filter holds are found in one pass over the texts; more are joined with the index, and only
    texts that have them are read, each with its places."""
    schema = f"w long, v int, doc {kind_of(docs)}, row long, place long"

    def made(batch, ok, own, at, w, v):
        text = pa.array(own[ok])
        half = (v[ok] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(w[ok].view(np.int64)), pa.array(half), batch.column("doc").take(text), batch.column("row").take(text), pa.array(at[ok] << 4)], ["w", "v", "doc", "row", "place"])

    if differ.count() <= capacity():
        wanted = docs.sparkSession.sparkContext.broadcast(member_filter(differ))

        def filtered(batches):
            table = flat_filter(*wanted.value)
            for batch in slices(batches, limit=SLICE):
                own, at, a, w, v = windows_of(batch.column("text"))
                new = np.ones(len(a), bool)
                new[1:] = a[1:] != a[:-1]
                ok = passes(table, a[new])[np.cumsum(new) - 1] if len(a) else np.empty(0, bool)
                yield made(batch, ok, own, at, w, v)

        return ranked(docs).mapInArrow(filtered, schema)

    places = entries.join(differ.hint("merge"), "anchor").groupBy("row").agg(F.collect_set("place").alias("places"))

    def placed(batches):
        for batch in slices(batches, limit=SLICE):
            own, at, _, w, v = windows_of(batch.column("text"))
            first = np.searchsorted(own, np.arange(batch.num_rows))
            ok = np.zeros(len(own), bool)
            for k, p in enumerate(batch.column("places").to_pylist()):
                p = np.array(p, np.int64)
                ok[first[k] + ragged(p >> 4, (p & 15) + 1)] = True
            yield made(batch, ok, own, at, w, v)

    return ranked(docs).join(places, "row").select("doc", "row", "text", "places").mapInArrow(placed, schema)


def repeated(single: DataFrame, s: Scratch) -> DataFrame:
    """row and place of the windows that also start in a document with a smaller doc_id."""
    first = s.keep(single.groupBy("w", "v").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least <> most").select("w", "v", "least"))
    return single.join(first, ["w", "v"]).where("doc > least").select("row", "place")


def in_batches(docs: DataFrame, batches: int) -> list[DataFrame]:
    """The documents in ascending order of doc_id, in about equal parts."""
    place = ordinal(rank_of(docs), kind_of(docs))
    cuts = sorted({min(int(x), LAST - 1) for x in docs.select(place.alias("p")).approxQuantile("p", [k / batches for k in range(1, batches)], 0.02)}) if batches > 1 else []
    bounds = [None, *cuts, None]
    out = []
    for low, high in zip(bounds, bounds[1:]):
        part = docs if low is None else docs.where(place > low)
        out.append(part if high is None else part.where(place <= high))
    return out


def dedup(docs: DataFrame, batches: int = 3, carry: tuple = ()) -> DataFrame:
    """doc_id, n_words, n_removed, changed and kept (the words left, joined by one space), and
    the columns named in ``carry``; one that bears a result's name becomes ``own_`` and its name."""
    spark = docs.sparkSession
    s, index, parts, kept = Scratch(spark), FingerprintIndex(spark, kind=kind_of(docs)), in_batches(docs, batches), []
    found = []
    for k, part in enumerate(parts):
        found.append(index.ingest(units(part), kept))
        if k + 1 < len(parts):
            index.compact()
    settled, differ = found[0]
    for a, b in found[1:]:
        settled, differ = settled.unionByName(a), differ.unionByName(b)
    differ = s.keep(differ.distinct())
    single = s.keep(single_windows(docs, differ, index.rows()))
    hits = s.keep(settled.unionByName(repeated(single, s)))
    index.delete()
    s.drop(*(t for t, _ in list(s.paths.values()) if t is not hits))
    for k in kept:
        k.drop(*(t for t, _ in list(k.paths.values())))
    return cut(docs, hits, carry)


def dedup_batch(index: FingerprintIndex, batch: DataFrame, history: DataFrame, carry: tuple = ()) -> DataFrame:
    """As ``dedup``, for the rows of a new batch only, whose words also go where they stand in the index's
    documents with smaller ids; the index then has the batch too. ``history`` (doc_id, text) is read for
    documents that have units in common with the batch but for some words."""
    s = Scratch(index.spark)
    before = index.rows() if index.runs else None
    settled, differ = index.ingest(units(batch))
    own = ["doc_id", "text"]
    both = batch.select(*own)
    if before is not None:
        holders = s.keep(before.join(differ, "anchor", "left_semi").select("doc").distinct())
        held = history.select(*own, rank_of(history).alias("doc")).join(holders, "doc", "left_semi")
        both = both.unionByName(held.select(*own))
    single = s.keep(single_windows(both, differ, index.rows()))
    hits = s.keep(settled.unionByName(repeated(single, s)))
    index.compact()
    return cut(batch, hits, carry)


def cut(docs: DataFrame, hits: DataFrame, carry: tuple = ()) -> DataFrame:
    """The documents without the words of ``hits`` (row, place). Texts that lose none need no exchange."""
    spark, carry = docs.sparkSession, list(carry)
    kind = docs.schema["doc_id"].dataType.simpleString()
    touched = spark.sparkContext.broadcast(member_filter(hits.select("row").distinct()))
    names = ["doc_id", "n_words", "n_removed", "changed", "kept"]
    names += [f"own_{c}" if c in names else c for c in carry]
    also = "".join(f", `{n}` {docs.schema[c].dataType.simpleString()}" for n, c in zip(names[5:], carry))
    schema = f"doc_id {kind}, n_words long, n_removed long, changed boolean, kept string{also}"

    def left(batch, places):
        flat, offsets = words_of(batch.column("text"))
        n = np.diff(offsets)
        keep = np.ones(len(flat), bool)
        for k, p in enumerate(places):
            if p:
                p = np.array(p, np.int64)
                edge = np.zeros(n[k] + 2 * WINDOW + 1, np.int64)
                np.add.at(edge, p >> 4, 1)
                np.add.at(edge, (p >> 4) + (p & 15) + WINDOW, -1)
                keep[offsets[k] : offsets[k + 1]] = np.cumsum(edge)[: n[k]] == 0
        left = np.bincount(owners(offsets)[keep], minlength=len(n))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(left)]), pa.int32()), flat.filter(pa.array(keep)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(n - left), pa.array(n != left), pc.binary_join(lists, " "), *[batch.column(f"_carry_{c}") for c in carry]], names)

    def marked(table, batch):
        return passes(table, batch.column("row").to_numpy().view(np.uint64))

    def whole(batches):
        table = flat_filter(*touched.value)
        for batch in slices(batches, limit=SLICE):
            yield left(batch.filter(pa.array(~marked(table, batch))), ())

    def chosen(batches):
        table = flat_filter(*touched.value)
        for batch in batches:
            yield batch.filter(pa.array(marked(table, batch)))

    def parts(batches):
        for batch in slices(batches, limit=SLICE):
            yield left(batch, batch.column("places").to_pylist())

    base = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), *[F.col(f"`{c}`").alias(f"_carry_{c}") for c in carry])
    spots = hits.groupBy("row").agg(F.collect_set("place").alias("places"))
    joined = base.mapInArrow(chosen, base.schema).join(spots, "row", "left").select("doc_id", "text", "places", *[f"_carry_{c}" for c in carry])
    return base.mapInArrow(whole, schema).unionByName(joined.mapInArrow(parts, schema))
