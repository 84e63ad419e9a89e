"""Validators, readers and other operations of collections, registered by name.

A validator takes (spark, context) and returns a report; a reader returns the tables of an access
graph; any other operation returns a DataFrame or JSON of bounded size. Answers are checked for
their shape before anything uses them. Spark jobs that run beyond the time allowed are cancelled;
plain Python on the driver can't be, so its lateness is reported when it returns.
"""

import json
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Statuses of a validator's report, and names that its details may not have.
STATUSES = ["complete", "complete_with_warnings", "incomplete"]
RESERVED = ["status", "errors", "warnings", "schema_version"]
# Seconds allowed by default, the range a reader may ask for, and bytes of a JSON answer.
SECONDS, READER_SECONDS, READER_RANGE, ANSWER_BYTES = 30, 120, (1, 900), 8 << 20
GRAPH = {"items": ["id", "label", "item_type", "route", "citation"], "representations": ["id", "item_id", "label", "kind", "language", "route"], "artifacts": ["id", "label", "role", "capture_path", "media_type"]}


@dataclass(frozen=True)
class Context:
    collection_id: str
    capture: str
    arguments: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Report:
    status: str
    errors: tuple = ()
    warnings: tuple = ()
    details: dict = field(default_factory=dict)


class ExtensionError(ValueError):
    """An extension is unknown or broke its contract."""


class Registry:
    def __init__(self):
        self.found: dict[tuple[str, str], Callable] = {}

    def register(self, capability: str, name: str, function: Callable) -> None:
        if (capability, name) in self.found:
            raise ExtensionError(f"{capability} {name} is registered already")
        self.found[capability, name] = function

    def run(self, spark: SparkSession, capability: str, name: str, context: Context, seconds: float | None = None):
        if (capability, name) not in self.found:
            raise ExtensionError(f"there is no {capability} {name}")
        if seconds is None:
            seconds = READER_SECONDS if capability == "read" else SECONDS
        elif capability == "read" and not READER_RANGE[0] <= seconds <= READER_RANGE[1]:
            raise ExtensionError(f"a reader is allowed {READER_RANGE[0]} to {READER_RANGE[1]} seconds")
        with within(spark, seconds):
            out = self.found[capability, name](spark, context)
        check = {"validate": checked_report, "read": checked_graph}.get(capability, checked_answer)
        return check(out)

    def operation(self, spark: SparkSession, name: str, context: Context, arguments: dict, seconds: float | None = None):
        """An operation that is neither validator nor reader, with arguments of its own."""
        given = Context(context.collection_id, context.capture, dict(finite_json(arguments, dict)))
        return self.run(spark, "operation", name, given, seconds)


@contextmanager
def within(spark: SparkSession, seconds: float):
    """Cancels the block's jobs once the seconds are over, and says so whatever the block made of it."""
    tag, late = f"extension-{uuid.uuid4().hex}", threading.Event()

    def stop():
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise ExtensionError(f"an extension took longer than {seconds} seconds") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
    if late.is_set():
        raise ExtensionError(f"an extension took longer than {seconds} seconds")


def finite_json(value, kind: type = object):
    try:
        size = len(json.dumps(value, allow_nan=False).encode())
    except (TypeError, ValueError) as e:
        raise ExtensionError("arguments and answers are finite JSON") from e
    if size > ANSWER_BYTES or not isinstance(value, kind):
        raise ExtensionError(f"arguments and answers have at most {ANSWER_BYTES} bytes and the right type")
    return value


def checked_answer(answer):
    return answer if isinstance(answer, DataFrame) else finite_json(answer)


def checked_report(report) -> Report:
    if not isinstance(report, Report) or report.status not in STATUSES:
        raise ExtensionError("a validator returns a report with a known status")
    for part in (report.errors, report.warnings):
        if not isinstance(part, tuple) or not all(isinstance(x, str) and x for x in part):
            raise ExtensionError("errors and warnings are tuples of texts")
    if report.errors and report.status != "incomplete" or not report.errors and report.status == "incomplete":
        raise ExtensionError("a report is incomplete exactly if it has errors")
    try:
        json.dumps(report.details, allow_nan=False)
    except (TypeError, ValueError) as e:
        raise ExtensionError("details must be finite JSON") from e
    if not isinstance(report.details, dict) or set(report.details) & set(RESERVED):
        raise ExtensionError("details bear a reserved name")
    return report


def checked_graph(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    for name, columns in GRAPH.items():
        if name not in tables or not set(columns) <= set(tables[name].columns):
            raise ExtensionError(f"a reader returns {name} with {', '.join(columns)}")
    return tables


def folded(report: Report, current_recipe: bool) -> Report:
    """A capture's own recipe comes first; judged by the current one instead, complete turns into
    complete with a warning."""
    if not current_recipe:
        return report
    status = "complete_with_warnings" if report.status == "complete" else report.status
    return Report(status, report.errors, (*report.warnings, "judged by the current recipe"), report.details)
