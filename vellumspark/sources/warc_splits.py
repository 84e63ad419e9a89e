"""Large web archives read by many tasks: files are cut at the starts of records or gzip members.

Each range of a file looks for a start of its own and walks from record to record to the first start
beyond its end. A range's start is right if the range before has landed on it; where it has not (what looks like
a start may stand inside a payload, even as a whole archive in itself), the range is walked again from where
the one before has landed, and ranges that this passes over have no start, until all agree: a round for each
place that misleads, of few small jobs. Walking an
uncompressed file reads headers only; packed members have to be unpacked to know their ends.

The result has the rows of the ``warc`` data source. Nothing but counts comes to the driver.
"""

import os
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumspark.sources.shared import written
from vellumspark.sources.warc import BLOCK, SCHEMA, WarcError, gzip_members, header_end, header_lines, plain_records, rows_of

SPLIT_BYTES = 64 << 20
#: Bytes within which the header of an uncompressed record ends, and those that are read first.
HEADER_BYTES, FIRST_BYTES = 1 << 20, 1 << 13
#: Tasks for each core that the ranges of archives are dealt to, if no task gets more than SPLIT_BYTES.
CORE_TASKS = 4
# How a gzip member and a record begin.
MEMBER, RECORD = b"\x1f\x8b\x08", b"WARC/"
RESERVED = 0xE0


def packed(path: str) -> bool:
    return path.lower().endswith(".gz")


def member_end(f, at: int) -> int | None:
    """Where the gzip member at a place ends, if it is whole and holds a record; its bytes are not kept."""
    f.seek(at)
    d, begin, used, step = zlib.decompressobj(16 + zlib.MAX_WBITS), b"", 0, FIRST_BYTES
    while not d.eof:
        data, step = f.read(step), min(BLOCK, 4 * step)  # most members are small
        if not data:
            return None
        used += len(data)
        while data and not d.eof:
            try:
                piece = d.decompress(data, BLOCK)
            except zlib.error:
                return None
            begin = begin or piece[: len(RECORD)]
            if begin and begin != RECORD:
                return None
            data = d.unconsumed_tail
    return at + used - len(d.unused_data)


def record_end(f, at: int) -> int | None:
    """Where the uncompressed record at a place ends, with the empty lines behind it."""
    f.seek(at)
    head = f.read(FIRST_BYTES)
    if not head.startswith(RECORD):
        return None
    if b"\r\n\r\n" not in head and b"\n\n" not in head:
        head += f.read(HEADER_BYTES - len(head))
    try:
        end, body = header_end(head)
        size = header_lines(head[head.index(b"\n") + 1 : end]).get("content-length", "")
    except WarcError:
        return None
    if not size.isdigit():
        return None
    stop = at + body + int(size)
    if stop > os.fstat(f.fileno()).st_size:
        return None
    f.seek(stop)
    rest = f.read(64)
    return stop + len(rest) - len(rest.lstrip(b"\r\n"))


def end_of(f, path: str, at: int) -> int | None:
    return member_end(f, at) if packed(path) else record_end(f, at)


def candidates(f, path: str, a: int, b: int) -> Iterator[int]:
    """Places from a to b (without b) that look like a start."""
    sign, at, held = MEMBER if packed(path) else RECORD, a, b""
    f.seek(a)
    while at < b and (data := f.read(BLOCK)):
        held += data
        k = held.find(sign)
        while 0 <= k and at + k < b:
            if not packed(path) or len(held) > k + 3 and not held[k + 3] & RESERVED:
                yield at + k
                f.seek(at + len(held))
            k = held.find(sign, k + 1)
        at, held = at + max(0, len(held) - len(sign)), held[-len(sign) :] if len(held) > len(sign) else held


def own_start(path: str, a: int, b: int) -> int | None:
    """The first place of a range that holds a whole record and after it the end or another start."""
    with open(path, "rb") as f:
        if not a:
            return 0
        size, sign = os.fstat(f.fileno()).st_size, MEMBER if packed(path) else RECORD
        for at in candidates(f, path, a, b):
            end = end_of(f, path, at)
            if end is not None:
                f.seek(end)
                if end == size or f.read(len(sign)) == sign:
                    return at
    return None


def landing(path: str, start: int, b: int) -> tuple[int, bool]:
    """The first start at b or beyond when walking from a start; the file's size if a record on the way is broken.
    And whether that is doubtful: a record is broken, or none seems to begin there."""
    sign = MEMBER if packed(path) else RECORD
    with open(path, "rb") as f:
        size, at = os.fstat(f.fileno()).st_size, start
        while at < b:
            end = end_of(f, path, at)
            if end is None:
                return size, True
            at = end
        f.seek(at)
        return at, at < size and f.read(len(sign)) != sign


RANGES = "path string, k long, a long, b long, start long, landed long, doubtful boolean"


def no_start() -> dict:
    return {"start": F.lit(None).cast("long"), "landed": F.lit(None).cast("long"), "doubtful": F.lit(False)}


def tasks(spark: SparkSession, count: int, size: int) -> int:
    """How many tasks ranges are dealt to: small ranges cost less than a task, so tasks take several."""
    return max(1, min(count, 10_000, max(CORE_TASKS * spark.sparkContext.defaultParallelism, size // SPLIT_BYTES)))


def ranges(spark: SparkSession, paths: list[str], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """path, k, a, b, start and landed of every range, all agreed."""
    parts = tasks(spark, sum(-(-os.path.getsize(p) // split_bytes) for p in paths), sum(map(os.path.getsize, paths)))
    sizes = spark.createDataFrame([(p, os.path.getsize(p)) for p in paths], "path string, size long")
    cut = sizes.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("size") / split_bytes) - 1, F.lit(0)))).alias("k"))
    cut = cut.select("path", "k", (F.col("k") * split_bytes).alias("a"), F.least("size", (F.col("k") + 1) * split_bytes).alias("b"))

    def walk(frame: DataFrame) -> DataFrame:
        """start null: one is to be found."""

        def run(batches):
            for r in batches:
                start = [own_start(p, int(a), int(b)) if pd.isna(s) else int(s) for p, a, b, s in zip(r["path"], r["a"], r["b"], r["start"])]
                landed = [(None, False) if s is None else landing(p, s, int(b)) if s < b else (s, False) for p, s, b in zip(r["path"], start, r["b"])]
                yield r.assign(start=pd.Series(start, dtype="Int64", index=r.index), landed=pd.Series([x for x, _ in landed], dtype="Int64", index=r.index), doubtful=[x for _, x in landed])

        return frame.repartition(parts, "path", "k").mapInPandas(run, RANGES)

    known = written(walk(cut.withColumns(no_start())))
    before = W.partitionBy("path").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    up_to = W.partitionBy("path").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    while True:
        seen = known.withColumns({"due": F.coalesce(F.last("landed", True).over(before), F.lit(0)), "guess": F.coalesce(F.last(F.when(F.col("landed").isNotNull(), F.col("doubtful")), True).over(before), F.lit(False))})
        right = F.when(F.col("due") >= F.col("b"), F.col("start").isNull() | (F.col("start") == F.col("due"))).otherwise(F.col("start").eqNullSafe(F.col("due")))
        seen = written(seen.withColumn("right", right))
        if seen.where("not right").isEmpty():
            return known
        # what the first wrong range of a file is due is exact, what later ones are due is likely, unless a walk that was
        # misled ended nowhere: that would pass over all ranges behind it, and each of them would cost a round
        wrong, likely = F.when(~F.col("right"), F.col("due")), F.when(~F.col("right") & ~F.col("guess"), F.col("due"))
        seen = seen.withColumns({"first": F.first(wrong, True).over(up_to), "latest": F.last(likely, True).over(up_to)})
        place = F.when(F.col("first") >= F.col("a"), F.col("first")).otherwise(F.col("latest"))
        seen = seen.withColumn("place", F.when(place >= F.col("a"), place))
        kept = seen.where("place is null")
        passed = seen.where("place >= b").withColumns(no_start())
        again = seen.where("place < b").withColumns({**no_start(), "start": F.col("place")})
        known = written(kept.unionByName(passed).select(*known.columns).unionByName(walk(again.select(*known.columns))))


def archives(path: str) -> list[str]:
    if os.path.isfile(path):
        return [path]
    return [os.path.join(d, f) for d, _, names in sorted(os.walk(path)) for f in sorted(names) if f.lower().endswith((".warc", ".warc.gz"))]


def scan(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, permissive: bool = False) -> DataFrame:
    """The rows of all archives at a path, each range read by a task of its own. Permissive: a broken record
    ends its file with the records before; else it fails the read."""
    found = archives(path)
    agreed = ranges(spark, found, split_bytes).where("start < b")
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        for r in batches:
            for p, start, b in zip(r["path"], r["start"], r["b"]):
                rows, held, name = [], 0, os.path.basename(p)
                try:
                    records = gzip_members(p, start=int(start)) if packed(p) else ((o, len(d), d) for o, d in plain_records(p, start=int(start)))
                    for offset, length, data in records:
                        if offset >= b:
                            break
                        rows += rows_of(data, name, offset, length)
                        held += len(data)
                        if held > BLOCK << 4:
                            yield pd.DataFrame(rows, columns=columns)
                            rows, held = [], 0
                except (WarcError, zlib.error):
                    if not permissive:
                        raise
                yield pd.DataFrame(rows, columns=columns)

    # ranges are alike in size, so dealing them round makes tasks alike
    return agreed.repartition(tasks(spark, agreed.count(), sum(map(os.path.getsize, found)))).mapInPandas(run, SCHEMA)
