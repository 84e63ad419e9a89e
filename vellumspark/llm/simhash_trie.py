"""SimHash near-dedup by a self-join of binary tries.

``cluster``: fingerprints of 64 bits over word shingles, linked if they differ in at most 4 bits.
Equal fingerprints are first reduced to one. The bits are cut into ``budget`` + r blocks; two
fingerprints within the budget agree in at least r of them, so each is laid out once for each
choice of r blocks, which come first. r grows with the number of fingerprints (1, 2, 3): a
longer shared beginning keeps the tries small where more copies of one block would not; few
fingerprints share fewer bits, so that some 2**``TRIE_BITS`` of them make a trie. The
fingerprints that share a layout's first blocks form a binary trie, which is joined with itself:
node pairs are walked together, a level at a time, differing bits are added up, and a pair is
pruned once it exceeds the budget, or once all its fingerprints are known to be connected. Only pairs
of leaves are compared outright. Only a spanning forest of the links leaves a task.

``near_duplicates``: documents whose sets of five-word shingles have a Jaccard similarity of at
least 0.8. Such sets differ in about 15 % of SimHash's bits, far more than any budget that blocks
can hold, so these fingerprints have 512 bits, tries begin with 12 of them (more above 2**24
fingerprints) at ``tables`` places, and one of the tries holds a pair of similarity 0.8 with
probability ``RECALL`` at least. Pairs of at most ``SURE`` differing bits are linked; those up to
``MAYBE`` that would connect two groups are compared by exact similarity.

A block with too many fingerprints for one task is dealt by hash into chunks, and each pair of
chunks is a task of its own: memory stays bounded and no link is lost.

Cases: null texts and texts without words have fingerprint zero and are linked like any other;
texts with fewer words than a shingle count as one shingle; ties and repeated rows fall into the
same component; null ids are kept and never name a component that has another id; an empty table
gives no rows; texts are read whole; ``cluster`` leaves other columns out and ``near_duplicates``
passes them through, whatever they are called.
"""

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm._graph import components
from vellumspark.llm._store import Scratch, steady
from vellumspark.llm._text import gram_hashes, inside, mixed, owners, plain, slices, word_hashes, words_of

BITS, BUDGET, SEED = 64, 4, 42


def layout(budget: int, picks: int = 1) -> tuple[list[list[tuple[int, int]]], int]:
    """The order of the blocks (first bit from the top, bits) of each trie, and how many bits a trie's
    fingerprints share at least. Of ``budget`` + ``picks`` blocks, five at least, two fingerprints within
    the budget agree in ``picks``."""
    if not 0 <= budget < BITS:
        raise ValueError(f"a budget is 0 to {BITS - 1} bits, not {budget}")
    n = max(5, budget + picks)
    picks = min(picks, n - budget)
    cuts = [i * BITS // n for i in range(n + 1)]
    blocks = [(a, b - a) for a, b in zip(cuts, cuts[1:])]
    orders = [[*first, *(x for x in blocks if x not in first)] for first in combinations(blocks, picks)]
    return orders, min(sum(w for _, w in o[:picks]) for o in orders)


def picks_for(count: int, budget: int, chunk: int) -> int:
    """The fewest blocks that keep the fingerprints of a trie, evenly dealt, below half a chunk."""
    for picks in (1, 2):
        if count >> layout(budget, picks)[1] <= chunk // 2:
            return picks
    return 3


#: Fingerprints of a trie that one task takes, and node pairs it walks at once. Leaves are nodes of at most so many
#: fingerprints. A trie begins where about 2 ** TRIE_BITS fingerprints share their first bits, if blocks reach so far.
CHUNK, FRONTIER, LEAF, TRIE_BITS = 100_000, 20_000, 4, 6
#: Comparisons of fingerprints made at once.
COMPARED = 2_000_000

#: Sets of shingles: words in one, similarity, bits, and shared bits with how many fingerprints they serve.
WIDTH, SIMILARITY, LONG, BEGINNING, ROOM = 5, 0.8, 512, 12, 12
#: The least probability that a pair at this similarity meets in a trie.
RECALL = 0.995
#: At similarity 0.8, 78 of 512 bits differ (standard deviation 8): surely alike, and to be compared.
SURE, MAYBE = 58, 98
#: Differing bits of the first 64 beyond which a pair is pruned, and fingerprints of a leaf.
WORD_BUDGET, NEAR_LEAF = 22, 4
FACTOR = 0x9E3779B97F4A7C15


def fingerprint(text: bytes, width: int) -> int:
    """Of UTF-8 text: bits set in more than half of the shingles' hashes."""
    words = text.lower().split()  # bytes: A-Z only, and white space as in the words' definition
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    n = len(words) - width + 1
    starts = np.concatenate([[0], ends[: n - 1]]).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    h, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, 8192):  # long texts a piece at a time
        values = np.array([h(joined[a:b], SEED) for a, b in zip(starts[at : at + 8192], stops[at : at + 8192])], np.uint64)
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and fp (the 64 bits as a long) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            texts = plain(batch.column("text")).cast(pa.binary()).to_pylist()
            fp = np.fromiter((fingerprint(t, width) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


class Forest:
    """Labels of connected fingerprints: each label is the smallest position of its tree so far.
    ``made`` has the pairs that connected trees; node pairs that were split, and those given up, are counted."""

    def __init__(self, n: int):
        self.label, self.made = np.arange(n), []
        self.split = self.pruned = self.compared = 0

    def join(self, a: np.ndarray, b: np.ndarray, log: bool = True) -> None:
        p = self.label
        while len(a):
            u, v = p[a], p[b]
            differ = u != v
            a, b, u, v = a[differ], b[differ], u[differ], v[differ]
            if not len(a):
                break
            low, high = np.minimum(u, v), np.maximum(u, v)
            if log:
                _, one = np.unique(low * len(p) + high, return_index=True)
                self.made.append(np.stack([a[one], b[one]]))
            np.minimum.at(p, high, low)
            while True:
                q = p[p]
                if np.array_equal(q, p):
                    break
                p[:] = q


def in_pieces(a0, a1, b0, b1, own):
    """Node pairs with at most ``COMPARED`` comparisons each: the ranges of the left nodes are cut."""
    most = np.maximum(1, COMPARED // (b1 - b0))
    n = -(-(a1 - a0) // most)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a0, a1, b0, b1, own, most = (np.repeat(v, n) for v in (a0, a1, b0, b1, own, most))
    return a0 + k * most, np.minimum(a0 + (k + 1) * most, a1), b0, b1, own


def trie_self_join(values: np.ndarray, first: np.ndarray, depth: int, budget: int = BUDGET, leaf: int | None = None, accept=None, known: np.ndarray | None = None) -> Forest:
    """The forest of linked values. ``values``: fingerprints with the shared blocks first, ascending
    within each group; ``first``: where groups start. Values of a group agree in their first ``depth``
    bits. ``accept`` tells how far apart pairs within the budget are by their positions, -1 if they are not to
    be linked; values that are equal in ``known`` are connected beforehand."""
    n, forest, leaf = len(values), Forest(len(values)), LEAF if leaf is None else leaf
    if known is not None and n:
        order = np.argsort(known, kind="stable")
        same = known[order[1:]] == known[order[:-1]]
        forest.join(order[1:][same], order[:-1][same], log=False)

    def connected(a0, a1, b0, b1):
        change = np.concatenate([[0], np.cumsum(forest.label[1:] != forest.label[:-1])])
        return (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (forest.label[a0] == forest.label[b0])

    waiting = []  # pairs that are to be linked with how far they are apart

    def closest_first():
        x, y, apart = np.concatenate(waiting, 1) if waiting else np.empty((3, 0), np.int64)
        waiting.clear()
        for d in np.unique(apart):
            forest.join(x[apart == d], y[apart == d])

    ends = np.append(first[1:], n)
    zero = np.zeros(len(first), np.int64)
    todo = [(depth, np.stack([first, ends, first, ends, zero]))] if n else []  # node pairs as ranges, and their differing bits
    while todo:
        level, pairs = todo.pop()
        if pairs.shape[1] > FRONTIER:  # depth first, so that the waiting pairs stay few
            todo.append((level, pairs[:, FRONTIER:].copy()))
            pairs = pairs[:, :FRONTIER]
        one = connected(*pairs[:4])
        forest.pruned += int(one.sum())
        a0, a1, b0, b1, spent = pairs[:, ~one]
        small = ((a1 - a0 <= leaf) & (b1 - b0 <= leaf)) | (level >= BITS)
        p0, p1, q0, q1, own = in_pieces(*(v[small] for v in (a0, a1, b0, b1)), (a0 == b0)[small])
        step = np.cumsum((p1 - p0) * (q1 - q0)) // COMPARED
        cuts = np.append(np.flatnonzero(np.diff(step, prepend=-1)), len(step))
        for k, to in zip(cuts, cuts[1:]):
            c0, c1, d0, d1, self_ = (v[k:to] for v in (p0, p1, q0, q1, own))
            if k:  # what was found meanwhile may have connected them
                open_ = ~connected(c0, c1, d0, d1)
                c0, c1, d0, d1, self_ = (v[open_] for v in (c0, c1, d0, d1, self_))
            w, wide = (c1 - c0) * (d1 - d0), d1 - d0
            forest.compared += int(w.sum())
            inner = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            x = np.repeat(c0, w) + inner // np.repeat(wide, w)
            y = np.repeat(d0, w) + inner % np.repeat(wide, w)
            near = (x < y) | ~np.repeat(self_, w)  # a node with itself: each pair once
            near &= np.bitwise_count(values[x] ^ values[y]) <= budget
            x, y = x[near], y[near]
            if accept is not None:
                open_ = forest.label[x] != forest.label[y]
                x, y = x[open_], y[open_]
                apart = accept(x, y)
                fits = apart >= 0
                waiting.append(np.stack([x[fits], y[fits], apart[fits]]))
                if sum(c.shape[1] for c in waiting) >= COMPARED:
                    closest_first()
                continue
            forest.join(x, y)
        a0, a1, b0, b1, spent = (v[~small] for v in (a0, a1, b0, b1, spent))
        if not len(a0):
            continue
        bit = np.uint64(BITS - 1 - level)

        def middle(lo, hi):  # first position of the range whose bit is set
            lo, hi = lo.copy(), hi.copy()
            while True:
                open_ = lo < hi
                if not open_.any():
                    return lo
                m = (lo + hi) // 2
                up = np.zeros(len(m), bool)
                up[open_] = (values[m[open_]] >> bit) & np.uint64(1) == 1
                hi = np.where(open_ & up, m, hi)
                lo = np.where(open_ & ~up, m + 1, lo)

        am, bm = middle(a0, a1), middle(b0, b1)
        same = a0 == b0
        children = [np.stack([a0, am, b0, bm, spent]), np.stack([am, a1, bm, b1, spent]), np.stack([a0, am, bm, b1, spent + 1]), np.stack([am, a1, b0, bm, spent + 1])[:, ~same]]
        new = np.concatenate(children, 1)
        new = new[:, (new[0] < new[1]) & (new[2] < new[3])]
        forest.split += len(a0)
        forest.pruned += int((new[4] > budget).sum())
        new = new[:, new[4] <= budget]
        if new.shape[1]:
            todo.append((level + 1, new))
    closest_first()
    return forest


def arranged(fp: np.ndarray, order: list[tuple[int, int]]) -> np.ndarray:
    """The fingerprints with their blocks in another order."""
    out = np.zeros(len(fp), np.uint64)
    for start, width in order:
        out = (out << np.uint64(width)) | ((fp >> np.uint64(BITS - start - width)) & np.uint64((1 << width) - 1))
    return out


def shared_key(fp: str, order: list[tuple[int, int]]) -> F.Column:
    """The blocks that come first, as one number."""
    out = F.lit(0).cast("long")
    for start, width in order:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(fp, BITS - start - width).bitwiseAND(F.lit((1 << width) - 1)))
    return out


def dealt_groups(rows: DataFrame, chunk: int, scratch: Scratch) -> DataFrame:
    """``rows`` with i and j, dealt by (r, b, i, j): r names a layout and b the shared bits of a trie.
    A crowded trie is cut into chunks, and each pair of chunks (i, j) is a group."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = [c for c in rows.columns if c not in ("r", "b")]
    # what is crowded is at most rows / chunk; Spark broadcasts it only if it is small
    crowded = scratch.keep(rows.groupBy("r", "b").count().where(F.col("count") > chunk).select("r", "b", F.ceil(F.col("count") / (chunk / 2)).cast("int").alias("s")))
    if crowded.isEmpty():
        out = rows.select("r", "b", F.lit(0).alias("i"), F.lit(0).alias("j"), *own)
    else:
        out = rows.join(crowded, ["r", "b"], "left").withColumn("s", F.coalesce("s", F.lit(1))).withColumn("c", F.pmod(F.xxhash64(own[0]), F.col("s")).cast("int"))
        out = out.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("s") - 1))).select("r", "b", F.least("c", "k").alias("i"), F.greatest("c", "k").alias("j"), *own)
    return out.repartition(parts, "r", "b", "i", "j").sortWithinPartitions("r", "b", "i", "j")


KEY = ("r", "b", "i", "j")


def whole_groups(batches, chunk: int):
    """Tables of whole groups from batches that are sorted by group, of about 2 chunks at least."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= 2 * chunk:  # whole groups leave, the last one waits for the rest of it
            table = pa.Table.from_batches(held).combine_chunks()
            key = [table.column(c).to_numpy() for c in KEY]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0))
            if len(new):
                yield table.slice(0, int(new[-1]) + 1)
                table = table.slice(int(new[-1]) + 1)
            held, size = table.to_batches(), table.num_rows
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def grouped(table, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by group and value, and where groups start among them."""
    key = [table.column(c).to_numpy() for c in KEY]
    order = np.lexsort((values, *key[::-1]))
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in key], axis=0)
    return order, np.flatnonzero(new)


def links(unique: DataFrame, budget: int = BUDGET, chunk: int = CHUNK, picks: int | None = None) -> DataFrame:
    """u and v: a spanning forest of the links between the distinct fingerprints ``fp``."""
    count = unique.count()
    orders, shared = layout(budget, picks or picks_for(count, budget, chunk))
    begin = min(shared, max(0, count.bit_length() - TRIE_BITS))  # few fingerprints share fewer bits, so that there are tries to walk
    first = [next(n for n in range(1, len(o) + 1) if sum(w for _, w in o[:n]) >= shared) for o in orders]
    over = [sum(w for _, w in o[:n]) - begin for o, n in zip(orders, first)]
    keys = F.array(*[F.shiftrightunsigned(shared_key("fp", o[:n]), extra) for o, n, extra in zip(orders, first, over)])
    dealt = dealt_groups(unique.select("fp", F.posexplode(keys).alias("r", "b")), chunk, Scratch(unique.sparkSession))

    def run(batches):
        for table in whole_groups(batches, chunk):
            fp, r = table.column("fp").to_numpy().view(np.uint64), table.column("r").to_numpy()
            values = fp.copy()
            for k, o in enumerate(orders):
                values[r == k] = arranged(fp[r == k], o)
            at, starts = grouped(table, values)
            label = trie_self_join(values[at], starts, begin, budget).label
            linked = np.flatnonzero(label != np.arange(len(label)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[at[x]].view(np.int64)) for x in (linked, label[linked])], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def cluster(docs: DataFrame, width: int = 4, budget: int = BUDGET) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) of every document."""
    s = Scratch(docs.sparkSession)
    fps = s.keep(fingerprints(docs, width))
    unique = s.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = s.keep(components(links(unique, budget)))
    member = s.keep(found.join(unique, found["node"] == unique["fp"]).select("fp", "root", "least"))
    roots = s.keep(member.groupBy("root").agg(F.min("least").alias("component_id")))
    named = member.join(roots, "root").select("fp", "component_id")
    every = s.keep(unique.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    s.drop(unique, found, member, roots)
    return fps.join(every, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


# Documents by the similarity of their sets of shingles.


def sets(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the shingles of all texts (A-Z lower-cased), ascending within each, and
    each text's offsets. A text with fewer words is one shingle; without words it has none."""
    flat, at = words_of(pc.ascii_lower(plain(texts)))
    h = word_hashes(flat)
    g, ok = gram_hashes(h, WIDTH, FACTOR), inside(at, WIDTH, len(h))
    own, g = owners(at)[: len(g)][ok], g[ok]
    n = np.diff(at)
    for w in range(1, WIDTH):
        short = np.flatnonzero(n == w)
        own = np.concatenate([own, short])
        g = np.concatenate([g, *(mixed(gram_hashes(h[at[i] : at[i + 1]], w, FACTOR) + np.uint64(w)) for i in short)])
    order = np.lexsort((g, own))
    own, g = own[order], g[order]
    new = np.ones(len(g), bool)
    new[1:] = (own[1:] != own[:-1]) | (g[1:] != g[:-1])
    return g[new], np.searchsorted(own[new], np.arange(len(n) + 1))


BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32)


def long_fingerprints(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """LONG bits of each set, as bytes: a bit is set if more than half of the shingles' hashes have it.
    Counted by the values of the hashes' bytes, 1,024 sets at a time."""
    n = np.diff(at)
    out = np.zeros((len(n), LONG // 8), np.uint8)
    for a in range(0, len(n), 1024):
        b = min(a + 1024, len(n))
        part, own = g[at[a] : at[b]], np.repeat(np.arange(b - a) * 256, n[a:b])
        for lane in range(LONG // BITS):
            data = mixed(part + np.uint64((lane + 1) * FACTOR & (1 << 64) - 1)).view(np.uint8).reshape(-1, 8)
            for k in range(8):
                seen = np.bincount(own + data[:, k], minlength=256 * (b - a)).reshape(b - a, 256).astype(np.float32)
                out[a:b, 8 * lane + k] = np.packbits(2 * (seen @ BYTE_BITS) > n[a:b, None], axis=1)[:, 0]
    return out


WORDS = [f"w{k}" for k in range(LONG // BITS)]


def set_fingerprints(docs: DataFrame) -> DataFrame:
    """row, doc_id, mark (a hash of the text), size (shingles) and the words w0, w1 ... of the
    fingerprint of every document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("mark"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in slices(batches):
            g, at = sets(batch.column("text"))
            fp = np.ascontiguousarray(long_fingerprints(g, at)).view(">u8").astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("mark"), pa.array(np.diff(at)), *(pa.array(np.ascontiguousarray(c)) for c in fp.T)], ["row", "doc_id", "mark", "size", *WORDS])

    return rows.mapInArrow(run, f"row long, doc_id {kind}, mark long, size long, " + ", ".join(f"{w} long" for w in WORDS))


def beginnings(count: int) -> tuple[list[int], int]:
    """First bits of the tries, and how many bits each shares."""
    shared = max(BEGINNING, count.bit_length() - ROOM)
    cosine = 2 * SIMILARITY / (1 + SIMILARITY)
    agree = (1 - math.acos(cosine) / math.pi) ** shared
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - agree))
    places = [s for s in range(LONG) if s % BITS + shared <= BITS]
    return [places[k * len(places) // tables] for k in range(min(tables, len(places)))], shared


def near_links(unique: DataFrame, count: int, most: int, scratch: Scratch, chunk: int = CHUNK) -> DataFrame:
    """u and v (uid): pairs of at most ``most`` differing bits that connect what they can. ``unique``:
    uid, size, label and the words. Fingerprints with one label are connected beforehand; sets
    whose sizes rule the similarity out are not linked."""
    starts, shared = beginnings(count)
    keys = F.array(*[F.shiftrightunsigned(WORDS[s // BITS], BITS - s % BITS - shared).bitwiseAND(F.lit((1 << shared) - 1)) for s in starts])
    dealt = dealt_groups(unique.select("uid", "size", "label", *WORDS, F.posexplode(keys).alias("r", "b")), chunk, scratch)
    at_word, turn = np.array([s // BITS for s in starts]), np.array([s % BITS for s in starts], np.uint64)

    def run(batches):
        for table in whole_groups(batches, chunk):
            full = np.stack([table.column(w).to_numpy() for w in WORDS], 1).view(np.uint64)
            r = table.column("r").to_numpy()
            word, t = full[np.arange(len(full)), at_word[r]], turn[r]
            values = np.where(t == 0, word, (word << t) | (word >> ((np.uint64(BITS) - t) & np.uint64(63))))
            at, first = grouped(table, values)
            full, size, uid = full[at], table.column("size").to_numpy()[at], table.column("uid").to_numpy()[at]

            def accept(x, y):
                fits = np.minimum(size[x], size[y]) >= SIMILARITY * np.maximum(size[x], size[y]) - 1e-9
                apart = np.full(len(x), -1)
                apart[fits] = np.bitwise_count(full[x[fits]] ^ full[y[fits]]).sum(1, dtype=np.int64)
                apart[apart > most] = -1
                return apart

            made = trie_self_join(values[at], first, shared, WORD_BUDGET, NEAR_LEAF, accept, table.column("label").to_numpy()[at]).made
            u, v = np.concatenate(made, 1) if made else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(uid[u], uid[v])), pa.array(np.maximum(uid[u], uid[v]))], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def similar(pairs: DataFrame, texts: DataFrame, t: float) -> DataFrame:
    """Those of the ``pairs`` (u, v) whose texts (uid, text) have a similarity of at least ``t``."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = pairs.select("u", "v", F.explode(F.array("u", "v")).alias("uid"))
    both = texts.join(sides, "uid").select("u", "v", "text").repartition(parts, "u", "v").sortWithinPartitions("u", "v")

    def run(batches):
        held, one = None, None
        for batch in slices(batches):
            g, at = sets(batch.column("text"))
            found = []
            for i, key in enumerate(zip(batch.column("u").to_pylist(), batch.column("v").to_pylist())):
                own = g[at[i] : at[i + 1]]
                if key != held:
                    held, one = key, own
                    continue
                shared = len(np.intersect1d(one, own, assume_unique=True))
                if shared >= t * (len(one) + len(own) - shared) - 1e-9:
                    found.append(key)
                held = None
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return both.mapInArrow(run, "u long, v long")


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as make it unlike any column's."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def near_duplicates(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``docs`` that stay: one of each group of near-duplicates, that with the smallest id
    (nulls last); of rows with this id, the first."""
    s, docs = Scratch(docs.sparkSession), steady(docs)
    facts = s.keep(set_fingerprints(docs).withColumn("uid", F.xxhash64("size", *WORDS)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "row")).alias("first")
    unique = s.keep(facts.groupBy("uid").agg(first, F.first("size").alias("size"), *[F.first(w).alias(w) for w in WORDS]))
    count = unique.count()

    sure = s.keep(near_links(unique.withColumn("label", F.col("uid")), count, SURE, s, chunk))
    label = s.keep(components(sure))
    named = unique.join(label, unique["uid"] == label["node"], "left").withColumn("label", F.coalesce("root", "uid"))
    maybe = s.keep(near_links(named, count, MAYBE, s, chunk))
    wanted = s.keep(maybe.select(F.explode(F.array("u", "v")).alias("uid")).distinct().join(unique, "uid").select("uid", F.col("first.row").alias("row")))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), "text").join(wanted, "row").select("uid", "text")
    more = s.keep(similar(maybe, s.keep(texts), SIMILARITY))
    group = s.keep(components(sure.unionByName(more)))

    member = s.keep(unique.select("uid", "first").join(group, unique["uid"] == group["node"], "left").select("uid", "first", F.coalesce("root", "uid").alias("root")))
    best = s.keep(member.groupBy("root").agg(F.min("first").alias("best")))
    keeper = s.keep(member.join(best, "root").select("uid", F.col("best.row").alias("keeper")))
    gone_name, row_name = (unused(docs, c) for c in ("gone", "near_row"))
    gone = s.keep(facts.select("row", "uid").join(keeper, "uid").where("row <> keeper").select(F.col("row").alias(gone_name)))
    own = docs.withColumn(row_name, F.monotonically_increasing_id())
    s.drop(*(t for t, _ in list(s.paths.values()) if t is not gone))
    return own.join(gone, F.col(row_name) == F.col(gone_name), "left_anti").drop(row_name)
