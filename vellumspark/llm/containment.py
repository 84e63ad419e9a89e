"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are short and documents may be long, so the question is containment: the share of
an item's distinct word shingles that a document has. Items are partitioned by their number of
shingles; every item is sketched by the smallest hashes of its shingles, and a document is a
candidate if it holds enough values of the sketch. The sketch of a partition with at most u
shingles has floor((1 - t) u) + ``MARGIN`` values, or all of the item's: an item of n shingles with
containment t or more lacks at most floor((1 - t) n), so all others of its sketch are found, and no
pair is lost. Candidate pairs are verified by exact containment over all shingles of the item.

Words are runs of non-space characters, lower-cased, without anything but letters and digits;
words without any are dropped. A shingle is five words; items with fewer words are one shingle
of their own length.

Cases: null and empty documents hold nothing; null, empty or wordless items match nothing; an
empty table gives no rows; repeated items and documents are judged one by one; ties in containment
all count; very long texts are read whole; columns other than ids and texts are left out, so names
cannot clash; ids may be null and of any type. Items are
taken in blocks of bounded size (``BLOCK_SHINGLES``), each sent to the tasks and run against
all documents, so the benchmark may outgrow any one task.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vellumspark.llm._text import coded, gram_hashes, inside, mixed, owners, ragged, slices, word_hashes, words_of

WIDTH, CONTAINMENT = 5, 0.8
#: Values of a sketch beyond those that an item may lack.
MARGIN = 4
#: Shingles of the items in a block (16 bytes each in a task).
BLOCK_SHINGLES = 1_000_000
FACTOR = 0x9E3779B97F4A7C15
NOT_WORD = re.compile(r"[\W_]+")
#: 2 ** FILTER_BITS bits tell most absent values at once.
FILTER_BITS = 24


def normal_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the normal words of all texts, and each text's offsets."""
    flat, offsets = words_of(texts)
    index, distinct = coded(flat)
    normal = pa.array([NOT_WORD.sub("", w.lower()) for w in distinct.to_pylist()], pa.string())
    hashes = word_hashes(normal)
    full = np.array([w != "" for w in normal.to_pylist()], bool)
    keep = full[index]
    counts = np.bincount(owners(offsets)[keep], minlength=len(offsets) - 1)
    return hashes[index[keep]], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of all shingles of one width."""
    grams, ok = gram_hashes(hashes, width, FACTOR), inside(offsets, width, len(hashes))
    return owners(offsets)[: len(grams)][ok], grams[ok]


def sketch_size(n: int, t: float) -> int:
    """For the partition of items with 2**k to 2**(k+1) - 1 shingles: missing values, and the margin."""
    most = (1 << n.bit_length()) - 1
    return int((1 - t) * most + 1e-9) + MARGIN


class Items:
    """A block of items: their shingles by width, and the sketches to search with."""

    def __init__(self, rows: list[tuple], t: float):
        self.t, self.ids = t, [r[0] for r in rows]
        h, at = normal_words(pa.array([r[1] for r in rows], pa.string()))
        n = np.diff(at)
        width = np.minimum(n, WIDTH)
        self.sizes = np.zeros(len(rows), np.int64)
        self.by_width = {}
        for w in sorted({*width.tolist()} - {0}):
            own, g = shingles(h, at, w)
            own, g = own[width[own] == w], g[width[own] == w]
            pairs = np.unique(np.stack([own.astype(np.uint64), g]), axis=1)
            own, g = pairs[0].astype(np.int64), pairs[1]
            size = np.bincount(own, minlength=len(rows))
            self.sizes += size
            rank = np.lexsort((mixed(g), own))  # the sketch: the smallest scrambled values of each item
            place = np.arange(len(own)) - np.searchsorted(own, own)
            wide = np.minimum(np.array([sketch_size(int(s), t) for s in size]), size)
            need = wide - ((1 - t) * size + 1e-9).astype(np.int64)  # values of the sketch that a hit has
            first = place < wide[own]
            sketch, holder = g[rank][first], own[rank][first]
            by_value = np.lexsort((holder, sketch))
            sketch, holder = sketch[by_value], holder[by_value]
            bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
            slot = sketch >> np.uint64(64 - FILTER_BITS)
            np.bitwise_or.at(bits, (slot >> np.uint64(3)).astype(np.int64), (np.uint8(1) << (slot & np.uint64(7)).astype(np.uint8)))
            self.by_width[w] = (sketch, holder, need, bits, g, own, np.searchsorted(own, np.arange(len(rows) + 1)))

    @classmethod
    def restored(cls, parts: tuple) -> "Items":
        self = cls.__new__(cls)
        self.t, self.ids, self.sizes, self.by_width = parts
        return self

    def parts(self) -> tuple:
        return self.t, self.ids, self.sizes, self.by_width

    def search(self, texts):
        """(text number, item number, shared shingles) with enough containment."""
        h, at = normal_words(texts)
        found = []
        many = len(self.ids)
        for w, (sketch, holder, need, bits, g, own, start) in self.by_width.items():
            doc, s = shingles(h, at, w)
            slot = s >> np.uint64(64 - FILTER_BITS)
            maybe = np.flatnonzero(bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
            seen = np.unique(np.stack([doc[maybe].astype(np.uint64), s[maybe]]), axis=1)
            low, high = np.searchsorted(sketch, seen[1], "left"), np.searchsorted(sketch, seen[1], "right")
            pair, hits = np.unique(np.repeat(seen[0].astype(np.int64), high - low) * many + holder[ragged(low, high - low)], return_counts=True)
            pair = pair[hits >= need[pair % many]]
            if not len(pair):
                continue
            d, i = pair // many, pair % many  # verify: all shingles of the items among those of their documents
            first, last = np.searchsorted(doc, d, "left"), np.searchsorted(doc, d, "right")
            for k in range(len(pair)):
                shared = int(np.isin(g[start[i[k]] : start[i[k] + 1]], s[first[k] : last[k]]).sum())
                if shared >= self.t * self.sizes[i[k]] - 1e-9:
                    found.append(np.array([[d[k]], [i[k]], [shared]]))
        return np.concatenate(found, 1) if found else np.empty((3, 0), np.int64)


def item_blocks(benchmark: DataFrame, block: int):
    """Lists of (item_id, text) with at most ``block`` words each, or one item."""
    rows, words = [], 0
    for r in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).orderBy("item_id", "text").toLocalIterator():
        n = len(r["text"].split())
        if rows and words + n > block:
            yield rows
            rows, words = [], 0
        rows.append((r["item_id"], r["text"]))
        words += n
    if rows:
        yield rows


def search(docs: DataFrame, benchmark: DataFrame, t: float = CONTAINMENT, block: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_shared, n_item and containment of all pairs with containment t or more."""
    spark, kind, ikind = docs.sparkSession, docs.schema["doc_id"].dataType, benchmark.schema["item_id"].dataType
    schema = f"doc_id {kind.simpleString()}, item_id {ikind.simpleString()}, n_shared long, n_item long"
    out, item_type = spark.createDataFrame([], schema), to_arrow_type(ikind)
    for first, rows in enumerate(item_blocks(benchmark, block)):
        shared = spark.sparkContext.broadcast(Items(rows, t).parts())

        def run(batches, shared=shared):
            items = Items.restored(shared.value)
            for batch in slices(batches):
                d, i, n = items.search(batch.column("text"))
                ids = pa.array([items.ids[x] for x in i.tolist()], item_type)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(d)), ids, pa.array(n), pa.array(items.sizes[i])], ["doc_id", "item_id", "n_shared", "n_item"])

        got = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = got if not first else out.unionByName(got)
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))
