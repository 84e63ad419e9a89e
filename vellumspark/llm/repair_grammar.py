"""Token-id files compressed by a Re-Pair grammar, read back in whole or at any place.

Documents are ordered by id, encoded, ended with an end id and written as shards ("blocks") of
about ``BLOCK_IDS`` ids, each with a grammar of its own: the most frequent pairs of neighbouring
symbols become nonterminals, again and again, until a round shortens the sequence by less than
``LEAST_GAIN``. Pairs of one round share no symbol between a left and a right side, so no two of
their occurrences overlap, every occurrence is replaced and the order of the replacements is no
matter; a pair of one symbol with itself is replaced from the left. No pair spans two documents.

A block stores its rules (left and right symbols), the length that each rule expands to, the
remaining sequence, the number of ids before every ``MARK``-th symbol, and its documents' ids and
ends. ``read_span`` finds a place by those lengths and expands only the symbols that it meets;
``read_documents`` expands everything. The format is a folder with two Parquet tables: ``blocks``
(a row for each block) and ``parts`` (how many ids lie before each part of the order). Tasks commit
blocks as Spark commits files, so a lost executor's blocks are written again and never twice.

Texts are cut into pieces where a byte-level pre-tokenizer cuts too (``cuts_of``); the tokenizer then merges each distinct piece of a slice once. Texts with added tokens, and all
texts if the tokenizer works otherwise (``cuts_before_space``), are encoded whole by the library.

Cases: a null text counts as empty and has the end id only; null ids come first; rows with one id
are ordered by a hash of their text and their place in the input; a very long document is a block
of its own; an empty table gives an empty file; other columns are not read, so names cannot clash.
"""

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellumspark.llm._store import steady
from vellumspark.llm._text import plain, ragged, slices

#: Ids of a block, if its last document does not make it longer.
BLOCK_IDS = 1 << 19
#: A pair must occur so often to become a rule; a round must shorten a sequence by this share.
LEAST_COUNT, LEAST_GAIN = 32, 0.01
#: Pairs considered and rules made in one round, and rules of one block, at most.
CONSIDERED, ROUND_RULES, MOST_RULES = 4096, 1023, 15_000
MARK = 256
#: Bytes of text whose pieces are merged together, pieces given to the tokenizer in one call, pieces whose ids are put
#: together at once, and bytes that are looked at together.
TEXT_BYTES, PIECES, GROUP_PIECES, STRETCH = 6_000_000, 5_000, 150_000, 1 << 20
#: A task remembers the ids of pieces until it knows so many.
REMEMBERED = 400_000

SPACE, BREAK = 0x20, 0x0A
LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
STOP = np.array([chr(b) in ".,;:!?" for b in range(256)])
#: Lead bytes of sequences that may be white space (U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000).
DOUBTFUL = (0xC2, 0xE1, 0xE2, 0xE3)
SOLID = np.array([0x20 < b < 0x80 or b >= 0xC3 and b not in DOUBTFUL for b in range(256)])

BLOCKS = "part int, block int, before long, n_ids long, crc long, doc_ids array<{kind}>, doc_ends binary, alphabet binary, lefts binary, rights binary, lengths binary, width int, symbols binary, marks binary"


def cuts_before_space(config: str) -> bool:
    """Whether ids of a text are those of its pieces, cut before spaces that solid text follows."""
    c = json.loads(config)
    pre = c.get("pre_tokenizer") or {}
    if any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") for t in c.get("added_tokens") or []):
        return False
    alone = not c.get("normalizer") and not c.get("post_processor") and not (c.get("model") or {}).get("dropout")
    return alone and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)


def spread(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's bytes start (n + 1 places), and the bytes."""
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return at - at[0], np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]


def cuts_of(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where texts are cut: at their starts, before a space or line break that solid text follows, after such a
    line break, and before a stop or comma that follows an ASCII letter. The pre-tokenizer cuts at each of these."""
    start = np.zeros(len(raw) + 1, bool)
    for k in range(0, len(raw) - 1, STRETCH):  # in stretches, so that little is held at once
        one, two = raw[k : min(k + STRETCH, len(raw) - 1)], raw[k + 1 : k + 1 + STRETCH]
        solid = SOLID[two]
        edge = at[np.searchsorted(at, k + 1) : np.searchsorted(at, k + 1 + len(two))]
        solid[edge[edge < len(raw)] - k - 1] = False  # what follows is another text
        breaks = (one == BREAK) & solid
        start[k : k + len(one)] |= (one == SPACE) & solid | breaks
        start[k + 1 : k + 1 + len(one)] |= breaks | STOP[two] & LETTER[one]
    start[at[:-1]] = True
    start[-1] = False
    where = [np.flatnonzero(start[k : k + STRETCH]).astype(np.int32) + np.int32(k) for k in range(0, len(start), STRETCH)]
    return np.concatenate([*where, np.array([len(raw)], np.int32)])


class PieceEncoder:
    """Ids of whole texts as the tokenizer has them, distinct pieces merged once."""

    def __init__(self, config: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(config)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cut = cuts_before_space(config)
        self.added = [t["content"] for t in json.loads(config).get("added_tokens") or []]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max([0, *vocab.values(), *(self.tokenizer.token_to_id(t) for t in self.added)]) + 1, np.int64)
        self.sizes[list(vocab.values())] = [len(t) for t in vocab]  # a character of a token is a byte
        self.sizes[[self.tokenizer.token_to_id(t) for t in self.added]] = [len(t.encode()) for t in self.added]
        self.known, self.flat, self.place = pa.array([], pa.string()), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for k in range(0, len(texts), PIECES):
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts[k : k + PIECES], add_special_tokens=False)]
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter((i for x in got for i in x), np.uint32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)

    def joined(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that begin with a space before solid text, and how many each has: many are merged as
        one text, and the tokens' sizes in bytes tell which piece each belongs to."""
        cuts, data = spread(pieces)
        ids, step = [np.empty(0, np.uint32)], PIECES
        for k in range(0, len(cuts) - 1, step):
            edge = cuts[k : k + step + 1 : 500].tolist() + [int(cuts[min(k + step, len(cuts) - 1)])]
            texts = [data[a:b].tobytes().decode() for a, b in zip(edge, edge[1:]) if b > a]
            ids += [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(ids)
        return ids, np.diff(np.searchsorted(np.cumsum(self.sizes[ids]), cuts[1:]) + 1, prepend=0) if len(pieces) else np.empty(0, np.int64)

    def words(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that are ASCII letters, a space before them or not, and how many each has: the pre-tokenizer
        leaves them in one and changes the space only, so the model takes them as they are."""
        merge, ids, counts = self.tokenizer.model.tokenize, [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for k in range(0, len(pieces), PIECES):
            got = [merge(w) for w in pc.replace_substring(pieces.slice(k, PIECES), " ", "\u0120").to_pylist()]
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter((t.id for x in got for t in x), np.uint32, int(counts[-1].sum())))
        return np.concatenate(ids), np.concatenate(counts)

    def pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in order, and where each piece's ids start."""
        at, raw = spread(pieces)
        kind = np.zeros(len(pieces), np.int8)  # 1: solid text follows a space, 2: a word of letters alone, after a space or not
        long = np.flatnonzero(np.diff(at) > 1)
        kind[long] = (raw[at[long]] == SPACE) & SOLID[raw[at[long] + 1]]
        odd = np.concatenate([np.zeros(1, np.int32), np.cumsum(~LETTER[raw], dtype=np.int32)])
        kind[long[odd[at[long + 1]] == odd[at[long]] + (raw[at[long]] == SPACE)]] = 2
        counts = np.zeros(len(pieces), np.int64)
        others, counts[kind == 0] = (lambda got: (got[0], np.diff(got[1])))(self.library(pieces.filter(pa.array(kind == 0)).to_pylist()))
        spaced, counts[kind == 1] = self.joined(pieces.filter(pa.array(kind == 1)))
        words, counts[kind == 2] = self.words(pieces.filter(pa.array(kind == 2)))
        own = np.repeat(kind, counts)
        out = np.empty(len(own), np.uint32)
        out[own == 0], out[own == 1], out[own == 2] = others, spaced, words
        return out, np.concatenate([[0], np.cumsum(counts)])

    def looked_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same through what the task remembers: pieces met before are not merged again."""
        at = pc.index_in(pieces, self.known)
        new = at.is_null()
        fresh, ends = self.pieces(pieces.filter(new))
        start, size = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        new = new.to_numpy(zero_copy_only=False)
        old = pc.drop_null(at).to_numpy()
        start[~new], size[~new] = self.place[old], np.diff(self.place)[old]
        start[new], size[new] = len(self.flat) + ends[:-1], np.diff(ends)
        both = np.concatenate([self.flat, fresh])
        if len(self.known) < REMEMBERED:
            self.known = pa.concat_arrays([self.known, pieces.filter(pa.array(new))])
            self.flat, self.place = both, np.concatenate([self.place, len(self.flat) + ends[1:]])
        return both[ragged(start, size)], np.concatenate([[0], np.cumsum(size)])

    def groups(self, texts: pa.Array):
        """For runs of texts in order, all ids and where each text's ids start (one more place than texts)."""
        texts = plain(texts)
        whole = pa.array(np.full(len(texts), not self.cut))
        for t in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, t))
        whole = whole.to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(whole)
        if len(odd) == len(texts):
            yield self.library(texts.to_pylist())
            return
        other, there = self.library(texts.take(pa.array(odd)).to_pylist())
        at, raw = spread(texts)
        cuts = cuts_of(raw, at)
        coded = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw)).dictionary_encode()
        flat, place = self.looked_up(coded.dictionary)
        code, size = coded.indices.to_numpy(zero_copy_only=False), np.diff(place)
        edge = np.searchsorted(cuts, at)  # the piece at which each text begins
        k, done = 0, 0
        while k < len(texts):
            to = max(k + 1, int(np.searchsorted(edge, edge[k] + GROUP_PIECES, "right")) - 1)
            mine = code[edge[k] : edge[to]]
            lens = size[mine]
            ids, ends = flat[ragged(place[mine], lens)], np.concatenate([[0], np.cumsum(lens)])[edge[k : to + 1] - edge[k]]
            if whole[k:to].any():
                parts = []
                for i in range(k, to):
                    parts.append(other[there[done] : there[done + 1]] if whole[i] else ids[ends[i - k] : ends[i - k + 1]])
                    done += bool(whole[i])
                ids, ends = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
            yield ids, ends
            k = to

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's ids start (n + 1 places)."""
        got = list(self.groups(texts))
        counts = np.concatenate([np.empty(0, np.int64), *(np.diff(at) for _, at in got)])
        return np.concatenate([np.empty(0, np.uint32), *(ids for ids, _ in got)]), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def independent(a: np.ndarray, b: np.ndarray, counts: np.ndarray, most: int) -> list[int]:
    """The most frequent pairs of which none's left symbol is another's right symbol (equal counts: smaller pair first)."""
    order = np.argsort(-counts, kind="stable")[:CONSIDERED]
    lefts, rights, out = set(), set(), []
    for k, a, b in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        if a in rights or b in lefts or a == b and (a in lefts or b in rights):
            continue
        lefts.add(a)
        rights.add(b)
        out.append(k)
        if len(out) == most:
            break
    return out


def compress(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Alphabet, left symbols, right symbols and remaining sequence. Symbol k stands for the k-th id of the alphabet, symbols beyond it for rules in order."""
    known = np.zeros(int(ids.max()) + 1 if len(ids) else 0, bool)
    known[ids] = True
    alphabet = np.flatnonzero(known)
    base = len(alphabet)
    small = base + MOST_RULES <= 1 << 16
    half, bits = (np.uint16, np.uint32) if small else (np.uint32, np.uint64)
    shift, mask = bits(16 if small else 32), (1 << 16) - 1 if small else (1 << 32) - 1
    seq = (np.cumsum(known) - 1).astype(half)[ids]
    first = np.zeros(len(seq), bool)  # symbols that begin a document
    first[ends[:-1][ends[:-1] < len(seq)]] = True
    lefts, rights = [], []
    while len(seq) > 1 and len(lefts) < MOST_RULES:
        keys = (seq[:-1].astype(bits) << shift) | seq[1:]
        keys = np.sort(keys[~first[1:]])
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        counts = np.diff(np.append(edge, len(keys)))
        often = np.flatnonzero(counts >= LEAST_COUNT)
        pairs, counts = keys[edge[often]].astype(np.int64), counts[often]
        a, b = pairs >> int(shift), pairs & mask
        chosen = independent(a, b, counts, min(ROUND_RULES, MOST_RULES - len(lefts)))
        if not chosen or counts[chosen].sum() < LEAST_GAIN * len(seq):
            break
        a, b = a[chosen], b[chosen]
        top = base + len(lefts)
        row, col = np.zeros(top, np.uint32), np.zeros(top, np.uint16)
        names_a, names_b = np.unique(a), np.unique(b)
        wide = len(names_b) + 1
        row[names_a], col[names_b] = np.arange(1, len(names_a) + 1) * wide, np.arange(1, wide)
        rule = np.zeros((len(names_a) + 1) * wide, np.uint16)  # a cell for each left and right symbol of the round
        rule[row[a] + col[b]] = np.arange(1, len(a) + 1)
        hit = rule[row[seq[:-1]] + col[seq[1:]]]
        hit[first[1:]] = 0
        at = np.flatnonzero(hit)
        near = np.concatenate([[False], np.diff(at) == 1])
        if near.any():  # a pair of one symbol with itself: every other place of a run
            k = np.arange(len(at))
            at = at[(k - np.maximum.accumulate(np.where(near, 0, k))) % 2 == 0]
        seq[at] = hit[at].astype(half) + half(top - 1)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq, first = seq[keep], first[keep]
        lefts += a.tolist()
        rights += b.tolist()
    return alphabet.astype(np.uint32), np.array(lefts, np.uint32), np.array(rights, np.uint32), seq


def lengths_of(base: int, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
    """Ids that each rule expands to; rules only name earlier ones."""
    out = []
    for a, b in zip(lefts.tolist(), rights.tolist()):
        out.append((1 if a < base else out[a - base]) + (1 if b < base else out[b - base]))
    return np.array(out, np.uint32)


def packed(ids: np.ndarray, ends: np.ndarray) -> dict:
    """The columns of a block that hold its ids."""
    alphabet, lefts, rights, seq = compress(ids, ends)
    base = len(alphabet)
    lengths = lengths_of(base, lefts, rights)
    spans = np.concatenate([[1], lengths])[np.maximum(seq.astype(np.int64) - base + 1, 0)]
    width = 2 if base + len(lefts) <= 1 << 16 else 4
    marks = (np.cumsum(spans) - spans)[::MARK]
    return {
        "n_ids": len(ids), "crc": zlib.crc32(ids.astype("<u4").tobytes()), "doc_ends": ends[1:].astype("<u4").tobytes(), "alphabet": alphabet.astype("<u4").tobytes(), "lefts": lefts.astype("<u4").tobytes(), "rights": rights.astype("<u4").tobytes(),
        "lengths": lengths.astype("<u4").tobytes(), "width": width, "symbols": seq.astype(f"<u{width}").tobytes(), "marks": marks.astype("<u4").tobytes(),
    }


class Block:
    """A block as it was read."""

    def __init__(self, row: dict):
        self.ids_in_all, self.crc = row["n_ids"], row["crc"]
        self.alphabet, self.lefts, self.rights, self.lengths, self.ends, self.marks = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("alphabet", "lefts", "rights", "lengths", "doc_ends", "marks"))
        self.base = len(self.alphabet)
        self.symbols = np.frombuffer(row["symbols"], f"<u{row['width']}").astype(np.int64)

    def spans(self, symbols: np.ndarray) -> np.ndarray:
        return np.concatenate([[1], self.lengths])[np.maximum(symbols - self.base + 1, 0)]

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids that symbols stand for: symbols give way to their two sides until only ids are left."""
        while (deep := symbols >= self.base).any():
            at = np.cumsum(1 + deep) - (1 + deep)
            out = np.empty(len(symbols) + int(deep.sum()), np.int64)
            out[at[~deep]] = symbols[~deep]
            k = symbols[deep] - self.base
            out[at[deep]], out[at[deep] + 1] = self.lefts[k], self.rights[k]
            symbols = out
        return self.alphabet[symbols]

    def all(self) -> np.ndarray:
        """Every id; each rule is expanded once."""
        table = [self.alphabet[k : k + 1] for k in range(self.base)]
        for a, b in zip(self.lefts.tolist(), self.rights.tolist()):
            table.append(np.concatenate([table[a], table[b]]))
        lens = np.concatenate([np.ones(self.base, np.int64), self.lengths])
        flat = np.concatenate(table).astype("<u4") if table else np.empty(0, "<u4")
        out = flat[ragged((np.cumsum(lens) - lens)[self.symbols], lens[self.symbols])]
        if len(out) != self.ids_in_all or zlib.crc32(out.tobytes()) != self.crc:
            raise ValueError("a block's ids differ from those written")
        return out

    def span(self, a: int, b: int) -> np.ndarray:
        """Ids a to b (without b), from the symbols around them alone."""
        a, b = max(a, 0), min(b, self.ids_in_all)
        if a >= b:
            return np.empty(0, "<u4")
        k = (int(np.searchsorted(self.marks, a, "right")) - 1) * MARK
        to = int(np.searchsorted(self.marks, b, "left")) * MARK
        near, before = self.symbols[k:to], int(self.marks[k // MARK])
        stop = before + np.cumsum(self.spans(near))
        i, j = int(np.searchsorted(stop, a, "right")), int(np.searchsorted(stop, b, "left")) + 1
        skip = a - (before if not i else int(stop[i - 1]))
        return self.expand(near[i:j])[skip : skip + b - a].astype("<u4")


def write(docs: DataFrame, path: str, config: str, end_id: int, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``docs`` (doc_id, text) in the order of doc_id into a new folder."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(config)

    def run(batches):
        part, encoder, block, before = TaskContext.get().partitionId(), PieceEncoder(shared.value), 0, 0
        ids, names, ends = [], [], [0]

        def done():
            nonlocal block, before
            all_ids = np.concatenate(ids)
            row = {"part": part, "block": block, "before": before, "doc_ids": list(names), **packed(all_ids, np.array(ends))}
            block, before = block + 1, before + len(all_ids)
            ids.clear(), names.clear(), ends.clear()
            ends.append(0)
            return pa.RecordBatch.from_pylist([row], schema)

        schema = None
        for batch in slices(batches, limit=TEXT_BYTES):
            doc_type = batch.column("doc_id").type
            schema = schema or pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("crc", pa.int64()), ("doc_ids", pa.list_(doc_type)), ("doc_ends", pa.binary()), ("alphabet", pa.binary()), ("lefts", pa.binary()), ("rights", pa.binary()), ("lengths", pa.binary()), ("width", pa.int32()), ("symbols", pa.binary()), ("marks", pa.binary())])
            own = iter(batch.column("doc_id").to_pylist())
            for flat, at in encoder.groups(batch.column("text")):
                for a, b in zip(at.tolist(), at[1:].tolist()):
                    ids += [flat[a:b], np.array([end_id], np.uint32)]
                    names.append(next(own))
                    ends.append(ends[-1] + b - a + 1)
                    if ends[-1] >= block_ids:
                        yield done()
        if names:
            yield done()

    rows = steady(docs.select("doc_id", "text")).withColumn("_tie", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), "_tie", "_place"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(run, BLOCKS.format(kind=kind)).write.option("compression", "zstd").option("parquet.block.size", 1 << 25).parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row for each partition
    starts = np.cumsum([0, *(r["n"] for r in totals)]).tolist()
    spark.createDataFrame([(r["part"], s) for r, s in zip(totals, starts)], "part int, start long").coalesce(1).write.parquet(f"{path}/parts")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks with ``start``, the ids of all documents before them. ``parts`` has a row for each partition of the writing job, so it may be broadcast."""
    parts = F.broadcast(spark.read.parquet(f"{path}/parts"))
    return spark.read.parquet(f"{path}/blocks").join(parts, "part").withColumn("start", F.col("start") + F.col("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and ids (little-endian unsigned 32-bit, the end id included) of every document."""
    table = blocks(spark, path)
    kind = table.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names if c != "doc_ids"}
                b = Block(row)
                at = np.concatenate([[0], b.ends])
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b.ends), [None, pa.py_buffer(4 * at), pa.py_buffer(b.all())]).cast(pa.binary())
                names = batch.column("doc_ids").slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays([names, pa.array(at[:-1] + row["start"]), raw], ["doc_id", "start", "ids"])

    return table.mapInArrow(run, f"doc_id {kind}, start long, ids binary")


def read_span(spark: SparkSession, path: str, start: int, count: int) -> list[int]:
    """``count`` ids from place ``start`` of the whole sequence (fewer at its end); blocks elsewhere are skipped."""
    table = blocks(spark, path).where((F.col("start") < start + count) & (F.col("start") + F.col("n_ids") > start))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = Block(row).span(start - row["start"], start + count - row["start"])
                yield pa.RecordBatch.from_arrays([pa.array([row["start"]]), pa.array([ids.tobytes()], pa.binary())], ["start", "ids"])

    got = sorted(table.mapInArrow(run, "start long, ids binary").collect(), key=lambda r: r["start"])
    return [i for r in got for i in np.frombuffer(r["ids"], "<u4").tolist()]
