"""Weighted URL vocabulary: strict and soft terms found with Aho-Corasick.

A term counts only between boundaries (no ASCII letter or digit on either side). One strict
term blocks a URL, and so do several distinct soft terms. Host rules with path prefixes come
before the vocabulary; of the rules that fit, the longest decides.

Cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; the
vocabulary then judges what text there is (null and empty: allow). Very long urls are scanned whole;
of rules with equal lengths the later in the list decides. Rows, repeated ones too, are judged one by
one without any exchange; an empty table gives no rows; other columns pass through, but for those
named like a result, which the result replaces.
"""

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (host, path prefix, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
# Terms of the vocabulary.
STRICT = [
    "adult", "camgirl", "camgirls", "camsex", "casino", "cialis", "escort", "escorts", "hentai", "keygen", "keygens", "levitra", "malware", "milf", "nsfw",
    "phishing", "porn", "porno", "pornos", "spam", "spammer", "torrentz", "viagra", "warez", "xanax", "xvideos", "xxx",
]
SOFT = [
    "ads", "adserver", "affiliate", "bet", "bets", "betting", "bingo", "bonus", "cash", "cheap", "click", "clickbait", "coupon", "coupons", "crack", "cracked", "credit", "dating", "deal", "deals",
    "discount", "download", "downloads", "farm", "forex", "free", "gambling", "giveaway", "hot", "jackpot", "jackpots", "loan", "loans", "lottery", "mortgage", "nude", "payday", "pharmacy", "pill", "pills",
    "poker", "popup", "prize", "promo", "replica", "roulette", "sale", "serial", "sex", "sexy", "singles", "slot", "slots", "sweepstakes", "torrent", "torrents", "track", "tracker", "vegas", "win", "winner",
]
#: A strict term weighs as much as so many distinct soft terms; that weight blocks.
BLOCK_WEIGHT = 2

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The parts before the host, of the host, and of the path, of a URL that has a scheme.
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"


def automaton(weights: dict[str, int]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term, weight in weights.items():
        a.add_word(term, (term, weight))
    a.make_automaton()
    return a


def weight_of(a: ahocorasick.Automaton, url: str) -> int:
    """Sum of the weights of the distinct terms that stand between boundaries."""
    found = {}
    bare = lambda i: not (0 <= i < len(url) and url[i].isascii() and url[i].isalnum())
    for end, (term, weight) in a.iter(url):
        if bare(end + 1) and bare(end - len(term)):
            found[term] = weight
    return sum(found.values())


def vocabulary_weight(url: Column, strict=tuple(STRICT), soft=tuple(SOFT)) -> Column:
    weights = {t: 1 for t in soft} | {t: BLOCK_WEIGHT for t in strict}

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = automaton(weights)
        for urls in batches:
            yield pd.Series([weight_of(a, u.lower()) if u else 0 for u in urls], dtype="int64")

    return F.pandas_udf(score, "long")(url)


def judge(pages: DataFrame, url: str = "url", rules=tuple(RULES)) -> DataFrame:
    """Add host, path, rule, vocabulary_weight and verdict."""
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    own = {"host": F.translate(F.regexp_extract(u, HOST, 1), UPPER, LOWER), "path": F.regexp_extract(u, PATH, 1), "vocabulary_weight": vocabulary_weight(F.col(f"`{url}`"))}
    out = pages.withColumns(own)  # all of the column as it was, which may bear one of these names
    rule, by_rule = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, by_rule = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(by_rule)
    out = out.withColumns({"rule": rule, "verdict": by_rule})
    method = F.when(F.col("vocabulary_weight") >= BLOCK_WEIGHT, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("verdict", method))
