"""What each filter of a chain removes, in every order: windows over a long form of mask cells.

Each document gets a mask with a bit for every filter that it fails. Documents alike in part and
mask are counted as one cell, so what follows grows with parts and masks only. Every cell is
unpivoted against the steps of every order; a running bit-or over the earlier steps of its order
tells whether it was removed before; conditional sums give each step's figures, and a window over
part and filter sums what a filter removes over all orders.

Filter E (identical to the text of a smaller id) is told by digests: rows alike in digest and part
are counted first, so a group of copies of any size is a few rows when its least id is looked up.

Cases: a null text counts as empty; a null part is the empty string; a null id is larger than
any other, and rows with one id and one text never make each other fail; an id with several labels
counts with the largest of each; labels that are null or missing add to no loss; an empty table
gives no rows. Only the columns named are read, so names cannot clash.
"""

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
#: Bounds of the text filters: words, percent of distinct words, percent of capital letters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
COPY = "E"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters that look at one text, by letter; each is never null."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < LEAST_DISTINCT * F.size(words),
        "C": 100 * capitals > MOST_CAPITALS * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def mask_of(filters: dict[str, Column]) -> Column:
    """A bit for each failed filter, the first filter's lowest."""
    return sum((F.when(failed, 1 << k).otherwise(0) for k, failed in enumerate(filters.values())), F.lit(0)).cast("int")


def cells(docs: DataFrame, labels: DataFrame, part: Column, filters: dict[str, Column]) -> DataFrame:
    """part, mask (with a last bit for ``COPY``), n, good and toxic of documents alike in part and mask.

    ``filters`` are conditions over the columns of ``docs``; equal texts must give equal conditions."""
    own = docs.select("doc_id", F.coalesce(part.cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), mask_of(filters).alias("mask"))
    known = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # null ids have no label; a salt by digest keeps them from meeting in one task
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0)).alias("salt")
    rows = own.select("*", salt).join(known.where("id is not null").select("*", F.lit(0).cast("long").alias("_none")), (F.col("doc_id") == F.col("id")) & (F.col("salt") == F.col("_none")), "left")
    alike = ["digest", "part", "mask", "good", "toxic"]
    rows = rows.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id").alias("id"), "digest", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    repeats = rows.groupBy("id", *alike).agg(F.count("*").alias("n"))
    groups = repeats.groupBy(*alike).agg(F.sum("n").alias("n"), F.min(F.struct("id", "n")).alias("least"))
    first = F.min("least.id").over(W.partitionBy("digest"))
    kept = F.when(F.col("least.id") == F.col("first"), F.col("least.n")).otherwise(F.lit(0))
    split = groups.withColumn("first", first).select("part", "mask", "good", "toxic", F.inline(F.array(F.struct(kept.alias("n"), F.lit(0).alias("copy")), F.struct((F.col("n") - kept).alias("n"), F.lit(1 << len(filters)).alias("copy")))))
    mask = F.col("mask").bitwiseOR(F.col("copy"))
    return split.where("n > 0").groupBy("part", mask.alias("mask")).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(table: DataFrame, letters: str, orders: list[str] | None = None) -> DataFrame:
    """A row for each part, order and step, zeros included, from the ``cells`` of the filters called
    ``letters`` (the mask's bits in order). Orders are all permutations unless they are given."""
    orders = orders or ["".join(p) for p in permutations(letters)]
    plan = F.array(*[F.lit(o) for o in orders])
    long = table.withColumn("filter_order", F.explode(plan)).select("*", F.posexplode(F.expr("transform(sequence(1, length(filter_order)), i -> substring(filter_order, i, 1))")).alias("at", "filter"))
    bit = F.expr(f"shiftleft(1, cast(locate(filter, '{letters}') - 1 as int))")
    steps = long.withColumn("bit", bit).withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    before = W.partitionBy("part", "mask", "filter_order").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    now = F.col("fails") != 0
    removed = now & (F.col("earlier") == 0)
    count = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(0)).alias
    out = steps.groupBy("part", "filter_order", "at", "filter").agg(
        count(~now & (F.col("earlier") == 0))("kept"), count(removed)("removed"), count(now & (F.col("earlier") != 0))("redundant"), count(F.col("mask") == F.col("bit"))("unique_fails"), count(removed, "good")("good_lost"), count(removed, "toxic")("toxic_lost"),
    )
    shapley = F.sum("removed").over(W.partitionBy("part", "filter")).alias("shapley")
    return out.select("part", "filter_order", (F.col("at") + 1).cast("int").alias("step"), "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)
