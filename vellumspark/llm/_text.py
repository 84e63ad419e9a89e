"""Vectorised word handling on Arrow string arrays, shared by the Python-side operators.

Words are maximal runs of characters other than space and U+0009..U+000D. Nothing here
makes a Python object per word: words are dictionary-encoded per slice, work that depends
on the word alone is done once per distinct word, and the rest is numpy.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are expanded into words at once.
SLICE_BYTES = 6_000_000

MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def plain(arr) -> pa.Array:
    """One contiguous string array without nulls (null becomes the empty string)."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if not pa.types.is_string(arr.type):
        arr = arr.cast(pa.string())
    return pc.fill_null(arr, "") if arr.null_count else arr


def slices(batches, column="text", limit=SLICE_BYTES):
    """Cut record batches so that each piece has about ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def words_of(texts) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and where each text's words start (n + 1 offsets)."""
    texts = plain(texts)
    split = pc.ascii_split_whitespace(texts)
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = split.flatten()
    full = pc.not_equal(flat, "")
    if not pc.all(full).as_py():  # white space at either end leaves an empty piece
        keep = full.to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(owner[keep], minlength=len(counts))
        flat = flat.filter(full)
    return flat, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def coded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Index of each word among the distinct words, and the distinct words."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


#: Longer words than this many bytes are hashed one by one.
LONG_WORD = 4096


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word's UTF-8 bytes, eight bytes of all words at a time."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    raw = np.zeros(at[-1] - at[0] + 8, np.uint8)
    raw[:-8] = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # the bytes from each place on, as numbers
    at, left = at[:-1] - at[0], np.diff(at)
    out = mixed(left.astype(np.uint64) + MIX_2)
    alive = np.flatnonzero((left > 0) & (left <= LONG_WORD))
    at, rest = at[alive], left[alive]
    while len(alive):
        part = eight[at]
        short = rest < 8
        part[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[alive] = mixed(out[alive] * MIX_1 + part)
        more = rest > 8
        alive, at, rest = alive[more], at[more] + 8, rest[more] - 8
    for k in np.flatnonzero(left > LONG_WORD):
        out[k] = xxhash.xxh64_intdigest(words[int(k)].as_py().encode())
    return out


def gram_hashes(hashes: np.ndarray, k: int, factor: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive values (texts' ends are not seen here)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    f = np.uint64(factor | 1)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= f
        out += hashes[j : j + n]
    return mixed(out)


def inside(offsets: np.ndarray, k: int, total: int) -> np.ndarray:
    """For each start of k consecutive words, whether they lie within one text."""
    n = total - k + 1
    if n <= 0:
        return np.empty(0, bool)
    ok = np.ones(n, bool)
    for e in np.unique(offsets[1:-1]):
        ok[max(0, e - k + 1) : e] = False
    return ok


def owners(offsets: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)
