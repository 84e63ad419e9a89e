"""Ranked lexical search over blocks of documents with the largest value of each term.

Every term's value in a document is the integer ``impact`` of its occurrences and the document's
length; a score is the sum of weights times impacts over the query's terms. ``build`` writes a forward
index: documents of one range of the input stand together in a block, with their terms and impacts,
and beside it each term's largest impact and number of documents in the block. The weights times those
maxima bound the score of any document of the block for a query.

``search`` takes the queries in batches of bounded size. Blocks' bounds alone are read first: each task
names the blocks with the highest bounds for each query, and those few blocks are scored; the k-th
best score found is a threshold that no final hit falls below. Then every task sorts its blocks
by their bounds for each query and scores block after block until the bound drops below the threshold,
which rises with the task's own hits. A block is left out only if its bound is less than the
threshold, so equal scores are never lost and the result is exact. Tasks give at most k rows for a query.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z
are lower-cased. Whole texts are read, in slices of bounded size.

Cases: a null text has no terms, and neither has one of other characters; such documents are not
counted and never found; a query without terms, or whose terms no document has, gives no rows; each
row of ``items`` is a query of its own, and each row of ``docs`` a document of its own, whatever
their ids; equal scores go by ascending id, null ids last; an empty table gives no rows; of the tables
only ids and texts are read, so names cannot clash.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumspark.llm._store import discard, materialize, shared_dir, steady
from vellumspark.llm._text import plain, slices

#: Documents of a block, and bytes of text that end one earlier.
BLOCK_DOCS, BLOCK_BYTES = 32, 1_000_000
#: Terms (with their queries) that one batch of queries may have: what is sent to every task is bounded by it.
BATCH_TERMS = 200_000
#: Blocks with the highest bounds that give a query its first threshold.
FIRST_BLOCKS = 4
#: Length normalisation: share of a document's relative length in percent.
LENGTH_SHARE = 75

TERM = np.array([chr(b).isascii() and chr(b).isalnum() or b >= 0x80 for b in range(256)])
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of all texts in order, and where each text's terms start (n + 1 places)."""
    texts = plain(texts)
    n = len(texts)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    inside = TERM[raw]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = at[:-1][at[:-1] < len(raw)]
    start[edge] = inside[edge]
    letters = LOWER[raw[inside]]
    begin = np.flatnonzero(start)
    place = np.append((np.cumsum(inside) - 1)[begin], len(letters)).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(begin), pa.py_buffer(place), pa.py_buffer(letters))
    return terms, np.searchsorted(begin, at)


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and terms of all documents with repeats."""

    def run(batches):
        some, total = 0, 0
        for batch in slices(batches):
            n = np.diff(terms_of(batch.column("text"))[1])
            some, total = some + int((n > 0).sum()), total + int(n.sum())
        yield pa.RecordBatch.from_pydict({"some": [some], "total": [total]})

    got = docs.select("text").mapInArrow(run, "some long, total long").agg(F.sum("some"), F.sum("total")).first()
    return got[0] or 0, got[1] or 0


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The integer value of tf occurrences in a document of so many terms (div rounds down)."""
    norm = 100 - LENGTH_SHARE + (LENGTH_SHARE * length * n_docs) // max(n_terms, 1)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


INDEX = "doc_ids array<{kind}>, words binary, word_ends binary, maxima binary, counts binary, docs binary, codes binary, values binary"
#: Columns that bounds and document counts need; the rest is read for the blocks that are scored.
BOUNDS = ["block", "words", "word_ends", "maxima", "counts"]


def build(docs: DataFrame, stats: tuple[int, int], path: str) -> None:
    """Write the forward index of ``docs`` (doc_id, text), a row for each block."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["words", "word_ends", "maxima", "counts", "docs", "codes", "values"]

    def block(ids, texts):
        terms, at = terms_of(texts)
        coded = terms.dictionary_encode()
        code, words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        length, m = np.diff(at), max(len(words), 1)
        key, tf = np.unique(code * len(length) + np.repeat(np.arange(len(length)), length), return_counts=True)
        code, doc = key // len(length), key % len(length)  # by term, then document
        value = impacts(tf, length[doc], *stats)
        first = np.flatnonzero(np.diff(code, prepend=-1))
        maxima = np.maximum.reduceat(value, first) if len(first) else value
        ends, raw = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1] if len(words) else np.zeros(1, np.int32), words.buffers()[2] or b""
        data = [bytes(raw)[: int(ends[-1])], *(x.astype("<u4").tobytes() for x in (ends[1:], maxima, np.bincount(code, minlength=m)[: len(words)], doc, code, value))]
        return pa.RecordBatch.from_arrays([pa.array([ids.to_pylist()], pa.list_(ids.type)), *(pa.array([x], pa.binary()) for x in data)], ["doc_ids", *names])

    def run(batches):
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
            at = 0
            while at < batch.num_rows:
                to = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES, "right"))
                to = min(max(to, at + 1), at + BLOCK_DOCS, batch.num_rows)
                yield block(batch.column("doc_id").slice(at, to - at), batch.column("text").slice(at, to - at))
                at = to

    indexed = docs.select("doc_id", "text").mapInArrow(run, INDEX.format(kind=kind))
    indexed.select(F.monotonically_increasing_id().alias("block"), "*").write.option("compression", "zstd").option("parquet.block.size", 1 << 25).parquet(path)


def u4(x) -> np.ndarray:
    return np.frombuffer(x.as_buffer() if hasattr(x, "as_buffer") else x, "<u4").astype(np.int64)


class Queries:
    """A batch of queries: their terms, and for each query the terms' numbers and weights times repeats."""

    def __init__(self, terms: list[str], at: list[int], numbers: list[int], repeats: list[int]):
        self.terms, self.at, self.numbers, self.factors = terms, np.array(at, np.int64), np.array(numbers, np.int64), np.array(repeats, np.int64)

    def weighted(self, weights: np.ndarray) -> "Queries":
        return Queries(self.terms, self.at, self.numbers, self.factors * weights[self.numbers])

    def known(self, batch, rows: range) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each block, the numbers in this batch of the block's terms that are in it, and their codes in the block."""
        ends = [u4(batch.column("word_ends")[k]) for k in rows]
        sizes = [int(e[-1]) if len(e) else 0 for e in ends]
        before = np.cumsum([0, *sizes])
        at = np.concatenate([[0], *(e + b for e, b in zip(ends, before.tolist()))]).astype(np.int64)
        raw = b"".join(batch.column("words")[k].as_py() for k in rows)
        words = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(raw))
        number = pc.fill_null(pc.index_in(words, pa.array(self.terms, pa.large_string())), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        out, k = [], 0
        for e in ends:
            mine = number[k : k + len(e)]
            code = np.flatnonzero(mine >= 0)
            out.append((mine[code], code))
            k += len(e)
        return out

    def bounds(self, number: np.ndarray, maxima: np.ndarray) -> np.ndarray:
        """For each query, what no document of the block scores above."""
        best = np.zeros(len(self.terms), np.int64)
        best[number] = maxima
        return np.add.reduceat(self.factors * best[self.numbers], self.at[:-1])

    def __len__(self):
        return len(self.at) - 1


#: Blocks whose terms are looked up at once.
GROUP = 64


class Searcher:
    """The k best documents of the blocks that one task reads, for each query."""

    def __init__(self, queries: Queries, k: int, floor: np.ndarray):
        self.q, self.k, self.least = queries, k, np.maximum(floor, 1)
        self.hits = [[] for _ in range(len(queries))]
        self.seen = self.scored = 0

    def take(self, batch) -> None:
        for at in range(0, batch.num_rows, GROUP):
            rows = range(at, min(at + GROUP, batch.num_rows))
            known = self.q.known(batch, rows)
            bounds = np.stack([self.q.bounds(number, u4(batch.column("maxima")[r])[code]) for r, (number, code) in zip(rows, known)], 1)
            self.seen += bounds.size
            ready = {}
            for query in np.flatnonzero((bounds >= self.least[:, None]).any(1)).tolist():
                for j in np.argsort(-bounds[query], kind="stable").tolist():
                    if bounds[query, j] < self.least[query]:
                        break
                    if j not in ready:
                        ready[j] = self.forward(batch, rows[j], *known[j])
                    self.score(query, *ready[j])

    def forward(self, batch, row: int, number: np.ndarray, code: np.ndarray) -> tuple:
        """Ids, row of each known term in the table of values (0: none), and that table."""
        ids = batch.column("doc_ids")[row].values
        docs, codes, values = (u4(batch.column(c)[row]) for c in ("docs", "codes", "values"))
        line = np.zeros(int(codes[-1]) + 1 if len(codes) else 0, np.int64)
        line[code] = np.arange(1, len(code) + 1)
        table = np.zeros((len(code) + 1, len(ids)), np.int64)
        mine = line[codes]
        table[mine, docs] = values
        table[0] = 0
        place = np.zeros(len(self.q.terms), np.int32)
        place[number] = np.arange(1, len(number) + 1)
        return ids, place, table

    def score(self, query: int, ids, place: np.ndarray, table: np.ndarray) -> None:
        self.scored += 1
        a, b = self.q.at[query : query + 2]
        got = self.q.factors[a:b] @ table[place[self.q.numbers[a:b]]]
        hits = self.hits[query]
        for d in np.flatnonzero(got >= self.least[query]).tolist():
            hits.append((int(got[d]), ids[d].as_py()))
        if len(hits) > self.k:
            hits.sort(key=rank_key)
            del hits[self.k :]
            self.least[query] = max(self.least[query], hits[-1][0])
        elif len(hits) == self.k:
            self.least[query] = max(self.least[query], min(h[0] for h in hits))

    def rows(self):
        return [(q, d, s) for q, hits in enumerate(self.hits) for s, d in sorted(hits, key=rank_key)[: self.k]]


def rank_key(hit: tuple):
    return -hit[0], hit[1] is None, hit[1] if hit[1] is not None else 0


def document_counts(index: DataFrame, queries) -> dict[int, int]:
    """Documents that hold each term of the batch."""

    def run(batches):
        q = queries.value
        total = np.zeros(len(q.terms), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                rows = range(at, min(at + GROUP, batch.num_rows))
                for r, (number, code) in zip(rows, q.known(batch, rows)):
                    total[number] += u4(batch.column("counts")[r])[code]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": some, "n": total[some]})

    got = index.select(*BOUNDS).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in got.collect()}  # at most the batch's terms


def best(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def first_blocks(index: DataFrame, queries) -> DataFrame:
    """query and block of the blocks with the highest bounds."""

    def run(batches):
        q = queries.value
        top, name = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, GROUP):
                rows = range(at, min(at + GROUP, batch.num_rows))
                block = batch.column("block").slice(at, len(rows)).to_numpy()
                bounds = np.stack([q.bounds(number, u4(batch.column("maxima")[r])[code]) for r, (number, code) in zip(rows, q.known(batch, rows))], 1)
                top, name = np.hstack([top, bounds]), np.hstack([name, np.tile(block, (len(q), 1))])
                keep = np.argsort(-top, 1, kind="stable")[:, :FIRST_BLOCKS]
                top, name = np.take_along_axis(top, keep, 1), np.take_along_axis(name, keep, 1)
        query, place = np.nonzero(top)
        yield pa.RecordBatch.from_pydict({"query": query, "block": name[query, place], "bound": top[query, place]})

    return best(index.select(*BOUNDS).mapInArrow(run, "query long, block long, bound long"), FIRST_BLOCKS, F.desc("bound"), F.col("block")).select("query", "block")


def hits(index: DataFrame, queries, k: int, floor) -> DataFrame:
    """query, doc_id and score of each task's k best documents, none below the floor."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        s, id_type = None, None
        for batch in batches:
            s = s or Searcher(queries.value, k, floor.value.copy())
            id_type = batch.schema.field("doc_ids").type.value_type
            s.take(batch)
        found = s.rows() if s else []
        if found:
            query, doc, score = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(doc, id_type), pa.array(score, pa.int64())], ["query", "doc_id", "score"])

    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    return best(index.select("doc_ids", *BOUNDS, "docs", "codes", "values").mapInArrow(run, f"query long, doc_id {kind}, score long"), k, *order)


def parsed(items: DataFrame) -> DataFrame:
    """number (of the row), term and repeats of all terms of all items."""

    def run(batches):
        for batch in slices(batches):
            terms, at = terms_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("number").to_numpy(), np.diff(at))), terms], ["number", "term"])

    return items.mapInArrow(run, "number long, term string").groupBy("number", "term").agg(F.count("*").alias("repeats"))


def search(index_path: str, stats: tuple[int, int], items: DataFrame, k: int = 10, batch_terms: int = BATCH_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents with a score above 0, for every row of ``items`` (item_id, text)."""
    spark = items.sparkSession
    context = spark.sparkContext
    index = spark.read.parquet(index_path)
    numbered = materialize(steady(items.select("item_id", "text")).withColumn("number", F.monotonically_increasing_id()))
    terms = materialize(parsed(numbered.select("number", "text")))
    n_batches = max(1, -(-terms.count() // batch_terms))
    out = None
    for b in range(n_batches):  # a batch's terms pass through the driver, nothing else of the items does
        mine = terms.where(F.pmod(F.xxhash64("number"), F.lit(n_batches)) == b).orderBy("number", "term").collect()
        if not mine:
            continue
        names = sorted({r["term"] for r in mine})
        number_of = {t: k for k, t in enumerate(names)}
        numbers = list(dict.fromkeys(r["number"] for r in mine))
        at = [0, *np.cumsum(np.unique([r["number"] for r in mine], return_counts=True)[1]).tolist()]
        queries = Queries(names, at, [number_of[r["term"]] for r in mine], [r["repeats"] for r in mine])
        plain_batch = context.broadcast(queries)
        df = np.zeros(len(names), np.int64)
        for t, n in document_counts(index, plain_batch).items():
            df[t] = n
        weights = np.floor(1000 * np.log((2 * stats[0] + 2) / (2 * df + 1))).astype(np.int64)
        batch = context.broadcast(queries.weighted(weights))
        none = context.broadcast(np.zeros(len(queries), np.int64))
        first = materialize(first_blocks(index, batch))
        chosen = index.join(F.broadcast(first.select("block").distinct()), "block", "left_semi")  # at most FIRST_BLOCKS for each query of the batch
        floor = np.zeros(len(queries), np.int64)
        for r in hits(chosen, batch, k, none).where(F.col("rank") == k).select("query", "score").collect():
            floor[r["query"]] = r["score"]
        found = hits(index, batch, k, context.broadcast(floor))
        ids = spark.createDataFrame([(q, n) for q, n in enumerate(numbers)], "query long, number long")
        found = materialize(found.join(ids, "query").drop("query"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = index.schema["doc_ids"].dataType.elementType.simpleString()
        out = spark.createDataFrame([], f"doc_id {kind}, score long, rank int, number long")
    return out.join(numbered.select("number", "item_id"), "number").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def rank_all(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """``search`` over a new index of ``docs``, which goes when the hits are found."""
    spark, path = docs.sparkSession, shared_dir(docs.sparkSession)
    stats = statistics(docs)
    build(docs, stats, path)
    out = search(path, stats, items, k)
    discard(spark, path)
    return out
