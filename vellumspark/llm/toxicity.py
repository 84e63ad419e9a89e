"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding drops accents and maps homoglyphs and digit or sign substitutions to plain letters, with l,
i and 1 as one letter, so that written-over words still match; terms are folded alike. A term counts
only as a whole word, also in its plural with s, and not inside an exception phrase. The weights
start from a base list, with a prior of weight 1, and are learned from labelled documents, as is
the logistic scale of the sum, which is normalised by the length of the text.

Cases: null and empty texts have no hits and get the score of a text without hits; without
labels of both kinds the base weights and a fixed scale hold; repeated rows get equal scores, and
texts repeated in the sample teach once; of ties among beginnings the longer, then the later by
spelling is taken; an empty table gives no rows; other columns are left out, so names cannot
clash; texts are scanned whole, whatever their length.
"""

import math
import re
from bisect import bisect_right
from itertools import accumulate
from unicodedata import normalize

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm._text import plain, slices

# Base terms, each of weight 1 until labels say otherwise.
BASE_TERMS = [
    "bastard", "bitch", "clown", "cretin", "degenerate", "disgusting", "dumbass", "filth", "fool", "freak", "garbage", "idiot", "imbecile", "jerk",
    "loser", "lowlife", "maggot", "moron", "parasite", "pathetic", "pig", "scum", "scumbag", "stupid", "subhuman", "trash", "vermin", "worthless",
]
# Phrases in which a term is not an insult.
EXCEPTIONS = ["clown fish", "freak accident", "garbage can", "garbage collection", "garbage collector", "guinea pig", "pig iron", "trash bag", "trash bin", "trash can", "trash collection"]
# Letters that look like Latin ones, and what they stand for.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ѕ": "s", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ⅼ": "l", "ɡ": "g", "\u200b": "", "\u00ad": "",
}
# Digits and signs written for letters; signs count only before a letter.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"}
SIGNS = {"!": "i", "$": "s", "@": "a"}
BEFORE = re.compile(r"[!$@](?=[a-z])")
#: Letters that look alike are one; the marks that accents leave when they are taken apart are dropped.
SAME = {"l": "i"}
FOLD = str.maketrans({k: SAME.get(v, v) for k, v in (HOMOGLYPHS | DIGITS | SAME | {chr(c): "" for c in range(0x300, 0x370)}).items()})

#: A learned beginning of words has one of these lengths, explains so many toxic documents at
#: least, and stands in at most this share of the others.
STEMS, MIN_TOXIC_DOCS, MOST_CLEAN_SHARE = (3, 4, 5, 6, 7, 8, 9), 4, 0.03
MIN_LOG_ODDS, ENOUGH_LOG_ODDS = 1.6, 2.5
#: The base weight of 1 counts as much as so many labelled documents with the term.
PRIOR_DOCS = 5
#: The scale of the score without labels: intercept, and slope of the normalised sum.
DEFAULT_SCALE = (-3.0, 12.0)


def fold(text: str) -> str:
    out = text.lower()
    if not out.isascii():
        out = normalize("NFKD", out)
    out = out.translate(FOLD)
    if "!" in out or "$" in out or "@" in out:
        out = BEFORE.sub(lambda m: SIGNS[m[0]], out)
    return out


def automaton(weights: dict[str, float]) -> ahocorasick.Automaton:
    """Folded terms with their name and weight, exception phrases with None. A term that ends in * is
    the beginning of longer words."""
    a = ahocorasick.Automaton()
    for term, w in weights.items():
        stem = fold(term.rstrip("*"))
        a.add_word(stem, (len(stem), w, stem + "*" != fold(term), term))
    for phrase in EXCEPTIONS:
        form = fold(phrase)
        a.add_word(form, (len(form), None, True, phrase))
    a.make_automaton()
    return a


def hits_of(a: ahocorasick.Automaton, text: str) -> list[tuple[int, int, float, str]]:
    """(start, end, weight, term) of the terms in a folded text that stand as words or their
    plurals, or begin a longer one if they are beginnings, outside exceptions."""
    found, spared, size = [], [], len(text)
    for last, (n, w, whole, term) in a.iter(text):
        start, end = last - n + 1, last + 1
        if start and text[start - 1].isalnum():
            continue
        longer = end < size and text[end].isalnum()
        if whole and longer and text[end] == "s":
            end += 1
            longer = end < size and text[end].isalnum()
        if whole == longer:
            continue
        (spared if w is None else found).append((start, end, w, term))
    if spared and found:  # of the exceptions that start no later than a hit, the one that reaches farthest tells
        spared.sort(key=lambda x: x[0])
        starts, reach = [x[0] for x in spared], list(accumulate((x[1] for x in spared), max))
        found = [x for x in found if not (k := bisect_right(starts, x[0])) or reach[k - 1] < x[1]]
    return found


def normalised(total: float, n_chars: int) -> float:
    """The sum of weights against the logarithm of the length, so that long texts need more."""
    return total / (1 + math.log1p(n_chars / 100))


def learned_weights(sample: DataFrame, base=tuple(BASE_TERMS)) -> dict[str, float]:
    """The base terms, and beginnings of longer words found in those toxic documents of the bounded
    sample that no base term explains.

    A base term's weight is its log-odds in the sample against a prior of 1. Of the beginnings, the one
    that explains most documents, and hardly stands in others, is taken; then the next for what is
    left. Counting runs on executors; the driver gets the beginnings that enough documents of the
    bounded sample have."""
    terms = {t: 1.0 for t in base}

    def beginnings(batches):
        a = automaton(terms)
        for batch in slices(batches):
            rows = []
            for t, y in zip(plain(batch.column("text")).to_pylist(), batch.column("label").to_pylist()):
                t = fold(t)
                doc = xxhash.xxh64_intdigest(t.encode()) - (1 << 63)
                hits = {x[3] for x in hits_of(a, t)}
                rows += [("=" + x, y, doc) for x in hits]
                if y and hits:
                    continue
                found = {w[:n] for w in set(re.findall(r"[^\W\d_]+", t)) for n in STEMS if len(w) > n}
                rows += [(w, y, doc) for w in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int64()))], ["stem", "label", "doc"])

    of = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not of.get(0) or not of.get(1):
        return terms
    bad, good = F.collect_set(F.when(F.col("label") == 1, F.col("doc"))), F.count(F.when(F.col("label") == 0, 1))
    n = sample.mapInArrow(beginnings, "stem string, label int, doc long").groupBy("stem").agg(bad.alias("docs"), good.alias("good"))
    few = n.where(F.col("stem").startswith("=") | (F.size("docs") >= MIN_TOXIC_DOCS) & (F.col("good") <= MOST_CLEAN_SHARE * of[0]))
    counted = {r["stem"]: ({*r["docs"]}, r["good"]) for r in few.collect()}
    odds = lambda d, g: math.log((len(d) + 0.5) / (of[1] + 1)) - math.log((g + 0.5) / (of[0] + 1))
    for t in terms:
        d, g = counted.get("=" + t, ((), 0))
        terms[t] = (PRIOR_DOCS + (len(d) + g) * max(0.0, odds(d, g)) / ENOUGH_LOG_ODDS) / (PRIOR_DOCS + len(d) + g)
    stems = {s: x for s, x in counted.items() if s[0] != "="}
    fits = lambda d, g: len(d) >= MIN_TOXIC_DOCS and odds(d, g) >= MIN_LOG_ODDS
    learned = {}
    while stems := {s: x for s, x in stems.items() if fits(*x)}:
        best = max(stems, key=lambda s: (len(stems[s][0]) * min(odds(*stems[s]), ENOUGH_LOG_ODDS), len(s), s))
        docs, clean = stems[best]
        learned[best + "*"] = odds(docs, clean)
        stems = {s: (d - docs, g) for s, (d, g) in stems.items()}
    top = max(1.0, *learned.values()) if learned else 1.0
    return terms | {t: w / top for t, w in learned.items()}


def _sums(weights):
    def run(batches):
        a = automaton(weights)
        for batch in slices(batches):
            texts = plain(batch.column("text")).to_pylist()
            found = [hits_of(a, fold(t)) for t in texts]
            x = [normalised(sum(w for _, _, w, _ in f), len(t)) for f, t in zip(found, texts)]
            yield batch, np.array(x), np.array([len(f) for f in found])

    return run


def fitted_scale(sample: DataFrame, weights: dict[str, float]) -> tuple[float, float]:
    """Intercept and slope of a logistic regression on the bounded sample."""
    sums = _sums(weights)

    def rows(batches):
        for batch, x, _ in sums(batches):
            yield pa.RecordBatch.from_arrays([pa.array(x), batch.column("label").cast(pa.float64())], ["x", "y"])

    got = sample.mapInArrow(rows, "x double, y double").collect()
    x, y = np.array([r["x"] for r in got]), np.array([r["y"] for r in got])
    if len(set(y.tolist())) < 2:
        return DEFAULT_SCALE
    f, beta, ridge = np.stack([np.ones_like(x), x], 1), np.array([0.0, 0.0]), np.array([1e-3, 1e-2])
    loss = lambda b: np.logaddexp(0, f @ b).sum() - y @ (f @ b) + (ridge * b * b).sum() / 2
    for _ in range(50):  # Newton steps, halved until they help; the ridge keeps separable data finite
        p = 1 / (1 + np.exp(-np.clip(f @ beta, -500, 500)))
        step = np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + np.diag(ridge), f.T @ (p - y) + ridge * beta)
        scale = 1.0
        while scale > 1e-6 and loss(beta - scale * step) > loss(beta):
            scale /= 2
        beta = beta - scale * step
    return float(beta[0]), float(beta[1])


def score(docs: DataFrame, weights: dict[str, float], scale=DEFAULT_SCALE) -> DataFrame:
    """doc_id, score and n_hits of every document."""
    sums, (a, b) = _sums(weights), scale

    def rows(batches):
        for batch, x, n in sums(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(1 / (1 + np.exp(-(a + b * x)))), pa.array(n, pa.int64())], ["doc_id", "score", "n_hits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, score double, n_hits long")
