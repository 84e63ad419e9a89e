"""BPE encoding and decoding over a minimal acyclic transducer of frequent words.

Words of all texts are counted; the frequent ones are encoded once and compiled into an
automaton that shares prefixes and suffixes. A word's number is the sum of the skips along its
path, and gives its ids. The automaton is one block of bytes, sent to every worker and memory-mapped
there. Words that it lacks are merged exactly by the tokenizer's own model. The lexicon thus
changes how ids are found, never which.

A text's ids are its words' ids one after the other, which holds for tokenizers that drop white
space before merging (``splits_on_space`` checks this); texts are read whole in slices of
bounded size. Where the tokenizer parts letters from signs, a word is cut before a stop behind an ASCII letter, and
where it lower-cases, A-Z is lower-cased first (``Cutter``), so that fewer distinct words are left to merge. Unseen
words are merged many as one text; the sizes of tokens in bytes tell which word each belongs to.

Cases: a null text counts as empty; empty texts have no ids and decode to the empty text;
special tokens' strings in a text become their ids, as the tokenizer has it; repeated rows are
encoded one by one; words that are as frequent as the last of the lexicon are in it by their
spelling; an empty table gives an empty lexicon; only doc_id and text are read and returned, so
names cannot clash. Executors get the vocabulary with the task and need no local file of it.
"""

import json
import mmap
import os
import re
import tempfile
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellumspark.llm._store import materialize
from vellumspark.llm._text import coded, plain, ragged, slices, words_of

#: Frequent words in the automaton, at most; longer words than this many bytes stay out.
LEXICON_WORDS, LEXICON_BYTES = 65_536, 64
#: Merged unseen words that a task remembers.
REMEMBERED = 300_000
#: Words that the tokenizer merges in one call; its results are bulky.
MERGED_AT_ONCE = 5_000
#: Words that are merged as one text.
JOINED = 500
ARRAYS = [("keys", np.uint32), ("targets", np.int32), ("skips", np.int32), ("final", np.uint8), ("offsets", np.int32), ("ids", np.uint32)]


# Normalisers that leave a word's neighbours alone.
WITHIN_WORDS = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}
SPACES_TO_ONE = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}


def splits_on_space(config: str) -> bool:
    """Whether white space only separates words, so that a text's ids are those of its words and its
    tokens are decoded with a space between them: normalisers act within words, nothing rewrites the
    tokens, and no added token holds or takes white space."""
    c = json.loads(config)
    normal = c.get("normalizer") or {}
    within = all(n.get("type") in WITHIN_WORDS or n == SPACES_TO_ONE for n in normal.get("normalizers", [normal] if normal else []))
    if c.get("decoder") or not within or any(t.get("lstrip") or t.get("rstrip") or t.get("content", "").split() != [t.get("content")] for t in c.get("added_tokens") or []):
        return False
    steps = (c.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and " ?" not in str(s.get("pattern")) for s in steps)


# Patterns that part letters from signs, and normalisers that keep the bytes of printable ASCII and U+00C0 to U+00FF as many.
PARTING = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
SIZE_KEEPING = {"NFC", "Lowercase"}
LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])
STOP = np.array([chr(b) in ".,;:!?" for b in range(256)])
EVEN = re.compile("[!-~\u00c0-\u00ff]+")


class Cutter:
    """Cuts texts into words, or smaller pieces whose ids stand for themselves too, as far as a tokenizer's file allows it."""

    def __init__(self, config: str):
        c = json.loads(config)
        n = c.get("normalizer") or {}
        normal = n.get("normalizers", [n] if n else [])
        kinds = {x.get("type") for x in normal if x != SPACES_TO_ONE}
        steps = (c.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        model = c.get("model") or {}
        self.added = [t["content"] for t in c.get("added_tokens") or []]
        bytes_only = [x.get("type") for x in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex") and not model.get("dropout")
        parts = (steps[0].get("pattern") or {}).get("Regex") in PARTING if isinstance(steps[0].get("pattern"), dict) else False
        self.cuts = parts and bytes_only and not c.get("post_processor") and not any(ch in t for t in self.added for ch in ".,;:!?")
        self.lowers = self.cuts and "Lowercase" in kinds
        self.joins = self.cuts and kinds <= SIZE_KEEPING and not model.get("continuing_subword_prefix") and not model.get("ignore_merges")
        self.suffix = model.get("end_of_word_suffix") or ""

    def pieces(self, texts) -> tuple[pa.Array, np.ndarray]:
        """All pieces of all texts in order, and where each text's start (n + 1 offsets)."""
        texts = plain(texts)
        if self.lowers:
            low = pc.ascii_lower(texts)
            for t in self.added:  # what lower-casing would make an added token stays as it is
                low = pc.if_else(pc.match_substring(low, t.lower()), texts, low)
            texts = low
        flat, offsets = words_of(texts)
        if not self.cuts or not len(flat):
            return flat, offsets
        at = np.frombuffer(flat.buffers()[1], np.int32)[flat.offset : flat.offset + len(flat) + 1]
        raw = np.frombuffer(flat.buffers()[2], np.uint8)[at[0] : at[-1]]
        at = at - at[0]
        start = np.zeros(len(raw) + 1, bool)
        start[1:-1] = STOP[raw[1:]] & LETTER[raw[:-1]]
        start[at] = True
        cuts = np.flatnonzero(start).astype(np.int32)
        return pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(raw)), np.searchsorted(cuts, at)[offsets]


def word_counts(docs: DataFrame, cutter: Cutter | None = None) -> DataFrame:
    """word and n over every whole text, counted by slice before the exchange."""

    def count(batches):
        for batch in slices(batches):
            flat, _ = (cutter.pieces if cutter else words_of)(batch.column("text"))
            c = flat.value_counts()
            yield pa.RecordBatch.from_arrays([c.field("values"), c.field("counts")], ["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS, cutter: Cutter | None = None) -> list[str]:
    """The most frequent words, by a count threshold so chosen that at most ``most`` reach it."""
    counts = materialize(word_counts(docs, cutter).where(F.octet_length("word") <= LEXICON_BYTES))
    level = F.floor(F.log2(F.col("n")) * 16).cast("int")
    total, least = 0, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # a few hundred levels at most
        if total + r["count"] > most:
            break
        total, least = total + r["count"], r["level"]
    return [] if least is None else sorted((r["word"] for r in counts.where(level >= least).select("word").collect()), key=str.encode)


def compile_automaton(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The minimal acyclic automaton of sorted distinct words, and their ids, as one block."""
    register: dict[tuple, int] = {}
    nodes: list[tuple[bool, list]] = []  # of the register: final, [(byte, target)]

    def settle(node: list) -> int:
        sign = (node[0], tuple(node[1]))
        if sign not in register:
            register[sign] = len(nodes)
            nodes.append((node[0], list(node[1])))
        return register[sign]

    path, last = [[False, []]], b""
    for word in words:
        common = len(os.path.commonprefix([word, last]))
        for depth in range(len(last), common, -1):
            path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
        path += [[False, []] for _ in word[common:]]
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
    root = settle(path[0])
    below = []
    keys, targets, skips = [], [], []
    for state, (final, edges) in enumerate(nodes):  # children come before their parents
        n = int(final)
        for byte, target in edges:
            keys.append(state << 8 | byte)
            targets.append(target)
            skips.append(n)
            n += below[target]
        below.append(n)
    arrays = [keys, targets, skips, [f for f, _ in nodes], np.cumsum([0] + [len(i) for i in ids]), [x for i in ids for x in i]]
    packed = [np.asarray(a, dtype) for a, (_, dtype) in zip(arrays, ARRAYS)]
    head = np.array([root, *(len(a) for a in packed)], np.int64).tobytes()
    return head + b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in packed)


class Automaton:
    """Reads what compile_automaton wrote, from any buffer, such as a memory map."""

    def __init__(self, buffer):
        head = np.frombuffer(buffer, np.int64, 1 + len(ARRAYS))
        self.root, at = int(head[0]), head.nbytes
        for (name, dtype), n in zip(ARRAYS, head[1:].tolist()):
            setattr(self, name, np.frombuffer(buffer, dtype, n, at))
            at += -(-n * np.dtype(dtype).itemsize // 8) * 8

    @classmethod
    def mapped(cls, block: bytes) -> "Automaton":
        """Over a memory map of an unnamed local file, which goes when the worker does."""
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        """Each word's number, or -1: all words walk together, a byte at a time."""
        n = len(distinct)
        out = np.full(n, -1, np.int64)
        if not n or not len(self.keys):
            return out
        at = np.frombuffer(distinct.buffers()[1], np.int32)[distinct.offset : distinct.offset + n + 1].astype(np.int64)
        data = np.frombuffer(distinct.buffers()[2] or b"", np.uint8)
        length = np.diff(at)
        alive = np.flatnonzero(length <= LEXICON_BYTES)
        state, number = np.full(len(alive), self.root, np.int64), np.zeros(len(alive), np.int64)
        step = 0
        while len(alive):
            done = length[alive] == step
            hit = done & (self.final[state] == 1)
            out[alive[hit]] = number[hit]
            alive, state, number = alive[~done], state[~done], number[~done]
            key = (state << 8 | data[at[alive] + step]).astype(np.uint32)
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[edge] == key
            alive, edge = alive[ok], edge[ok]
            state, number = self.targets[edge].astype(np.int64), number[ok] + self.skips[edge]
            step += 1
        return out


class Encoder:
    """ids of words: by the automaton, and for the others by the tokenizer's merges."""

    def __init__(self, tokenizer: Tokenizer, automaton: Automaton | None):
        self.tokenizer, self.automaton, self.known, self.cutter = tokenizer, automaton, {}, Cutter(tokenizer.to_str())
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocab.values(), default=-1) + 1, np.int64)
        self.sizes[list(vocab.values())] = [len(t.removesuffix(self.cutter.suffix)) for t in vocab]  # a character of a token is a byte

    def merged(self, words: list[str]) -> None:
        """Know the ids of new words: many even ones (``EVEN``) are merged as one text, if tokens' sizes then meet all their ends."""
        even = [w for w in words if EVEN.fullmatch(w) and not any(t in w for t in self.cutter.added)] if self.cutter.joins else []
        if even:
            texts = [" ".join(even[k : k + JOINED]) for k in range(0, len(even), JOINED)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            ends, upto = np.cumsum([len(w.encode()) for w in even]), np.cumsum(self.sizes[ids])
            last = np.searchsorted(upto, ends)
            if last[-1] + 1 == len(ids) and (upto[last] == ends).all():
                data, cut = ids.tobytes(), [0, *(4 * (last + 1)).tolist()]
                self.known.update(zip(even, (data[a:b] for a, b in zip(cut, cut[1:]))))
                words = [w for w in words if w not in self.known]
        self.known.update(zip(words, (array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False))))

    def words(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, start, length) of each distinct word."""
        a = self.automaton
        number = a.numbers(distinct) if a else np.full(len(distinct), -1, np.int64)
        rest = np.flatnonzero(number < 0)
        unseen = distinct.take(pa.array(rest)).to_pylist()
        new = [w for w in unseen if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = unseen
        for at in range(0, len(new), MERGED_AT_ONCE):
            self.merged(new[at : at + MERGED_AT_ONCE])
        own = [self.known[w] for w in unseen]
        sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
        tail = np.frombuffer(b"".join(own), np.uint32)
        head = a.ids if a else np.empty(0, np.uint32)
        start, length = np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64)
        start[rest], length[rest] = len(head) + np.cumsum(sizes) - sizes, sizes
        if a:
            seen = np.flatnonzero(number >= 0)
            start[seen] = a.offsets[number[seen]]
            length[seen] = a.offsets[number[seen] + 1] - a.offsets[number[seen]]
        return np.concatenate([head, tail]), start, length

    def texts(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's start (n + 1 offsets)."""
        flat, offsets = self.cutter.pieces(texts)
        index, distinct = coded(flat)
        ids, start, length = self.words(distinct)
        n = length[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        return ids[ragged(start[index], n)], ends[offsets]

    def lengths(self, texts) -> np.ndarray:
        """The number of ids of each text."""
        flat, offsets = self.cutter.pieces(texts)
        index, distinct = coded(flat)
        ends = np.concatenate([[0], np.cumsum(self.words(distinct)[2][index])])
        return np.diff(ends[offsets])


def read_config(tokenizer_path: str) -> str:
    """The tokenizer's file with truncation and padding unused."""
    with open(tokenizer_path, encoding="utf-8") as f:
        config = f.read()
    if not splits_on_space(config):
        raise ValueError("this tokenizer merges across white space")
    t = Tokenizer.from_str(config)
    t.no_truncation()
    t.no_padding()
    return t.to_str()


def quiet(config: str) -> Tokenizer:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_str(config)


def compile_lexicon(docs: DataFrame, config: str, most: int = LEXICON_WORDS) -> bytes:
    """The automaton of the corpus's frequent words; its size is bounded by ``most``."""
    words = frequent_words(docs, most, Cutter(config))
    ids = [e.ids for e in quiet(config).encode_batch_fast(words, add_special_tokens=False)]
    return compile_automaton([w.encode() for w in words], ids)


def encode_decode(docs: DataFrame, config: str, lexicon: bytes) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) and the text decoded from those ids."""
    shared = docs.sparkSession.sparkContext.broadcast((config, lexicon))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tokenizer = quiet(shared.value[0])
        encoder = Encoder(tokenizer, Automaton.mapped(shared.value[1]))
        names = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=True).items()}
        tokens = pa.array([names.get(i, "") for i in range(max(names, default=-1) + 1)], pa.string())
        for batch in slices(batches, limit=3_000_000):
            ids, at = encoder.texts(plain(batch.column("text")))
            raw = pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(ids.astype("<u4").tobytes())])
            back = pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), tokens.take(pa.array(ids))), " ")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), raw, back], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")


def count_tokens(docs: DataFrame, config: str) -> DataFrame:
    """doc_id and n_tokens of every whole text, each distinct word of a slice merged once."""
    shared = docs.sparkSession.sparkContext.broadcast(config)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoder = Encoder(quiet(shared.value), None)
        for batch in slices(batches):
            n = encoder.lengths(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long")
