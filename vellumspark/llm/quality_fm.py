"""Quality classifier: a factorisation machine over words, structure and metadata of a text.

Features of a text: hashed words (letters lower-cased) and hashed runs of trailing signs, as
damped frequencies; structure statistics (shares of signs, capitals and digits, repetition of
words and lines, word and line lengths); and metadata: its size in bytes, and the stated number of
characters (``n_chars``, where the table has it, else counted) with the bytes for each of them.
Pairwise interactions are products of low-rank factors, and are scored in linear time:
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

Cases: null and empty texts have no words and are scored by their structure features; without
labels of both kinds every score is the share of label 1 (0.5 without any); a null or negative
n_chars is counted anew; repeated rows get equal scores, and ties in score stand; an empty table gives
no rows; every text is read whole; other columns are left out, so names cannot clash. Fitting uses a bounded sample (``SAMPLE_ROWS``).
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from vellumspark.llm._text import coded, owners, plain, slices, words_of

BUCKETS, FACTORS, STRUCTURE = 1024, 8, 14
EPOCHS, RATE, DECAY, BATCH = 12, 0.02, 1e-4, 256
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        s = x @ self.factors
        pairs = (s * s - (x * x) @ (self.factors * self.factors)).sum(1) / 2
        return self.bias + x @ self.linear + pairs


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, np.float32)
    t[list(chars.encode())] = 1
    return t


KINDS = [_table("#*$%&|<>"), _table("!?"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table(",.;:")]


def features(texts, n_chars=None) -> np.ndarray:
    """A row of BUCKETS + STRUCTURE values for each text and its stated number of characters."""
    texts = plain(texts)
    n = len(texts)
    flat, offsets = words_of(texts)
    index, distinct = coded(flat)
    words = distinct.to_pylist()
    core = [w.strip(MARKS).lower() for w in words]
    tail = [w[len(w.rstrip(MARKS)) :] for w in words]
    hashed = lambda w, salt: xxhash.xxh32_intdigest(w, salt) % BUCKETS
    first = np.array([hashed(w, 1) for w in core], np.int64)
    marks = {t: hashed(t, 2) if len(t) > 1 else -1 for t in set(tail)}
    second = np.array([marks[t] for t in tail], np.int64)
    own, count = owners(offsets), np.diff(offsets)
    x = np.bincount(own * BUCKETS + first[index], minlength=n * BUCKETS).astype(np.float32)
    has = second[index] >= 0
    x += np.bincount((own * BUCKETS + second[index])[has], minlength=n * BUCKETS)
    x = np.log1p(x.reshape(n, BUCKETS))
    x /= np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-6)

    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    size = np.diff(at)

    def total(t: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(t[data[at[0] : at[-1]]], dtype=np.float64)])
        return c[at[1:] - at[0]] - c[at[:-1] - at[0]]

    stated = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.float64)
    if n_chars is not None:
        given = pc.fill_null(n_chars.cast(pa.float64()), -1.0).to_numpy(zero_copy_only=False)
        stated = np.where(given >= 0, given, stated)
    per_word = np.maximum(count, 1)
    pairs = np.unique(own * max(len(words), 1) + index)
    kinds = np.bincount(pairs // max(len(words), 1), minlength=n)
    lines = [t.split("\n") for t in texts.to_pylist()]
    n_lines, own_lines = np.array([len(s) for s in lines]), np.array([len(set(s)) for s in lines])
    same = np.zeros(n)
    if len(index) > 1:
        twice = (index[1:] == index[:-1]) & (own[1:] == own[:-1])
        same = np.bincount(own[1:][twice], minlength=n)
    structure = [np.minimum(total(t) / per_word, 3) for t in KINDS]
    structure += [kinds / per_word, same / per_word, 1 - own_lines / np.maximum(n_lines, 1), np.minimum(size / per_word / 10, 3), np.minimum(per_word / np.maximum(n_lines, 1) / 50, 3), np.log1p(count) / 8, np.log1p(size) / 10, np.log1p(stated) / 10, np.minimum(size / np.maximum(stated, 1), 4) / 4]
    return np.hstack([x, np.stack(structure, 1).astype(np.float32)])


def with_size(docs: DataFrame, key: str) -> DataFrame:
    """key, text and n_chars, null where the table has none or it is no number."""
    n = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return docs.select(key, "text", (F.col("n_chars") if isinstance(n, NumericType) else F.lit(None)).cast("double").alias("n_chars"))


def fit(sample: DataFrame, seed: int = 7) -> Model:
    """Fit on a bounded sample of (text, label); features are made on executors."""

    def rows(batches):
        for batch in slices(batches, limit=2_000_000):
            x = features(batch.column("text"), batch.column("n_chars")).astype(np.float16)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("label").cast(pa.int32())], ["x", "y"])

    got = sorted(with_size(sample, "label").mapInArrow(rows, "x binary, y int").collect())
    y = np.array([r["y"] for r in got], np.float32)
    width = BUCKETS + STRUCTURE
    share = float((y.sum() + 1) / (len(y) + 2))
    model = Model(float(np.log(share / (1 - share))), np.zeros(width, np.float32), np.zeros((width, FACTORS), np.float32))
    if len(set(y.tolist())) < 2:
        return model
    x = np.stack([np.frombuffer(r["x"], np.float16) for r in got]).astype(np.float32)
    rng = np.random.default_rng(seed)
    theta = [np.array([model.bias], np.float32), model.linear, rng.normal(0, 0.05, (width, FACTORS)).astype(np.float32)]
    m, v, step = [np.zeros_like(p) for p in theta], [np.zeros_like(p) for p in theta], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            b = x[order[at : at + BATCH]]
            model = Model(float(theta[0][0]), theta[1], theta[2])
            s = b @ theta[2]
            g = (1 / (1 + np.exp(-model.raw(b))) - y[order[at : at + BATCH]]) / len(b)
            grads = [np.array([g.sum()], np.float32), b.T @ g + DECAY * theta[1], b.T @ (g[:, None] * s) - theta[2] * ((b * b).T @ g)[:, None] + DECAY * theta[2]]
            step += 1
            for k, d in enumerate(grads):  # Adam
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                theta[k] = theta[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(float(theta[0][0]), theta[1].astype(np.float32), theta[2].astype(np.float32))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every document."""
    parts = (model.bias, model.linear, model.factors)

    def rows(batches):
        m = Model(*parts)
        for batch in slices(batches, limit=3_000_000):
            p = 1 / (1 + np.exp(-m.raw(features(batch.column("text"), batch.column("n_chars"))).astype(np.float64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_size(docs, "doc_id").mapInArrow(rows, f"doc_id {kind}, score double")
