"""Exact histogram of encoded lengths, and what suffix sums over it answer.

Documents are aggregated by their number of tokens. Suffix sums of the histogram then give, for
every context limit, how many documents and tokens reach it and the corpus's size if texts are
cut there; quantiles follow from the same sums. Suffix sums run in two levels (blocks of
lengths, then within a block), so that no task holds all lengths.

Cases: null and empty texts have length 0; ties and repeated rows share a row; an empty table
gives an empty histogram, whose quantiles are null; a limit beyond the longest text cuts nothing;
very long texts have a length like any other; only lengths are read, so names cannot clash.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellumspark.llm._store import materialize

#: Lengths in a block of the two-level sums.
BLOCK = 1024


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, docs, tokens, docs_at_least, tokens_at_least and truncated_total by length.
    truncated_total: tokens left if no text is longer than n_tokens."""
    counted = materialize(lengths.groupBy("n_tokens").agg(F.count("*").alias("docs")))  # else each use would encode again
    h = counted.withColumns({"tokens": F.col("n_tokens") * F.col("docs"), "block": F.floor(F.col("n_tokens") / BLOCK)})
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each 1,024 lengths
    total = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = blocks.select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_after"), F.sum("t").over(total).alias("t_all"))
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = h.join(after, "block").withColumns({"docs_at_least": F.sum("docs").over(within) + F.col("d_after"), "tokens_at_least": F.sum("tokens").over(within) + F.col("t_after")})
    kept = F.col("t_all") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")
    return out.select("n_tokens", "docs", "tokens", "docs_at_least", "tokens_at_least", kept.alias("truncated_total"))


def answers(hist: DataFrame, limits: list[int], shares: list[float]) -> tuple[int, int, list[tuple], list]:
    """Documents and tokens in all; for each limit the documents that are cut, their tokens, and the
    tokens left in all; for each share the smallest length that so many documents do not exceed.
    All are read off the suffix sums in one pass over the histogram, a row for each length."""
    n = hist.agg(F.coalesce(F.max("docs_at_least"), F.lit(0)).alias("docs"), F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("tokens")).first()
    above = [F.min(F.when(F.col("n_tokens") > x, F.struct("n_tokens", "docs_at_least", "tokens_at_least"))).alias(f"l{k}") for k, x in enumerate(limits)]
    upto = F.lit(n["docs"]) - F.col("docs_at_least") + F.col("docs")
    reached = [F.min(F.when(upto >= F.lit(q) * n["docs"], F.col("n_tokens"))).alias(f"q{k}") for k, q in enumerate(shares)]
    got = hist.agg(F.lit(1).alias("one"), *above, *reached).first()
    cut = []
    for k, x in enumerate(limits):
        r = got[f"l{k}"]
        docs, tokens = (r["docs_at_least"], r["tokens_at_least"]) if r else (0, 0)
        cut.append((x, docs, tokens, n["tokens"] - tokens + x * docs))
    return n["docs"], n["tokens"], cut, [got[f"q{k}"] for k in range(len(shares))]


def truncated_total(hist: DataFrame, limits: DataFrame) -> DataFrame:
    """limit, docs_cut and truncated_total for the stated limits."""
    _, _, cut, _ = answers(hist, [r["limit"] for r in limits.select("limit").collect()], [])
    return hist.sparkSession.createDataFrame([(x, d, t) for x, d, _, t in cut], "limit long, docs_cut long, truncated_total long")


def quantile(hist: DataFrame, q: float) -> int | None:
    """The smallest length that at least a share ``q`` of the documents do not exceed."""
    return answers(hist, [], [q])[3][0]


REPORT = "kind string, share double, n_tokens long, docs long, tokens long, docs_at_least long, tokens_at_least long, truncated_total long"


def report(hist: DataFrame, limits: list[int], shares: list[float]) -> DataFrame:
    """The histogram (kind length), and the answers for stated limits (kind limit: docs and tokens
    are those of documents over it), shares (kind quantile) and the whole (kind total)."""
    docs, tokens, cut, lengths = answers(hist, limits, shares)
    rows = [("limit", None, x, d, t, None, None, left) for x, d, t, left in cut]
    rows += [("quantile", float(q), n, None, None, None, None, None) for q, n in zip(shares, lengths)]
    rows += [("total", None, None, docs, tokens, None, None, None)]
    own = hist.select(F.lit("length").alias("kind"), F.lit(None).cast("double").alias("share"), "n_tokens", "docs", "tokens", "docs_at_least", "tokens_at_least", "truncated_total")
    return own.unionByName(hist.sparkSession.createDataFrame(rows, REPORT))
