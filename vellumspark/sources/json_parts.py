"""Large JSON documents as rows: each element of some of a document's arrays, read as a stream.

Spark's reader makes a row, held whole, of a document. Here one task walks a document and holds the element
at hand only; the elements are parsed by Spark, as many at once as a batch has.
"""

import io
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from vellumspark.sources.files import ListingError

PARTS = "document string, part string, ordinal int, value string"
CHUNK, BATCH = 1 << 20, 4 << 20
#: An element with more characters is an error, so that a broken document is not held whole.
MOST = 64 << 20
SPACE = re.compile(r"[ \t\r\n]*")
DECODER = json.JSONDecoder()


class Walk:
    """The place in a stream of JSON."""

    def __init__(self, f):
        self.f, self.held, self.at = f, "", 0

    def more(self) -> bool:
        data = self.f.read(max(CHUNK, len(self.held) - self.at))
        self.held, self.at = self.held[self.at :] + data, 0
        return bool(data)

    def peek(self) -> str:
        """The next character that is no space, empty at the end."""
        while True:
            self.at = SPACE.match(self.held, self.at).end()
            if self.at < len(self.held):
                return self.held[self.at]
            if not self.more():
                return ""

    def take(self, sign: str) -> None:
        if self.peek() != sign:
            raise ListingError(f"malformed JSON: no {sign}")
        self.at += 1

    def value(self) -> str:
        """The next value as it is written."""
        self.peek()
        last = False
        while True:
            try:
                end = DECODER.raw_decode(self.held, self.at)[1]
            except json.JSONDecodeError as e:
                if last or len(self.held) - self.at > MOST:
                    raise ListingError(f"malformed JSON, or a value of more than {MOST} characters: {e.msg}") from None
            else:
                if last or end < len(self.held):  # a number that ends with the chunk may go on
                    text, self.at = self.held[self.at : end], end
                    return text
            last = not self.more()

    def listed(self, opening: str, closing: str) -> Iterator[int]:
        """A number for each element of an array or object; whoever asks must read it before the next."""
        self.take(opening)
        if self.peek() == closing:
            self.at += 1
            return
        for k in range(1 << 62):
            yield k
            if self.peek() == closing:
                self.at += 1
                return
            self.take(",")


def parts_of(f, whole: str, arrays: list[str]) -> Iterator[tuple[int, str, int, str]]:
    """Number, part, ordinal and text: of every document the member ``whole`` ('null' if it lacks one), and the elements of ``arrays``."""
    w = Walk(f)

    def document(number):
        seen = set()
        for _ in w.listed("{", "}"):
            name = json.loads(w.value())
            w.take(":")
            if name in seen:
                raise ListingError(f"{name} is repeated")
            seen.add(name)
            if name in arrays and w.peek() == "[":
                for k in w.listed("[", "]"):
                    yield number, name, k, w.value()
            elif (text := w.value()) and name in arrays and text != "null":
                raise ListingError(f"{name} is no array")
            elif name == whole:
                yield number, name, 0, text
        if whole not in seen:
            yield number, whole, 0, "null"

    if w.peek() == "[":
        for k in w.listed("[", "]"):
            yield from document(k)
    else:
        yield from document(0)
    if w.peek():
        raise ListingError("malformed JSON: there is more after the document")


def json_parts(spark: SparkSession, path: str, whole: str, arrays: list[str]) -> DataFrame:
    """document (file and number in it), part, ordinal and value (JSON) of all documents at a path. Files below a mounted
    folder are streamed; those that only Spark can open are held one at a time."""
    mounted = "://" not in path or path.startswith("file:")
    files = spark.read.format("binaryFile").load(path).select("path") if mounted else spark.read.text(path, wholetext=True).selectExpr("_metadata.file_path as path", "value")

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                rows, size = [], 0
                at = re.sub("^file:/*", "/", r.path)
                with open(at, encoding="utf-8-sig", newline="") if mounted else io.StringIO(r.value) as f:
                    for number, part, ordinal, text in parts_of(f, whole, arrays):
                        rows.append((f"{r.path}#{number}", part, ordinal, text))
                        size += len(text)
                        if size > BATCH:
                            yield pd.DataFrame(rows, columns=["document", "part", "ordinal", "value"])
                            rows, size = [], 0
                yield pd.DataFrame(rows, columns=["document", "part", "ordinal", "value"])

    return files.mapInPandas(run, PARTS)
