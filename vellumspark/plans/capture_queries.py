"""Queries over captures: providers, statuses, payloads, numbering."""

from pyspark.sql import functions as F

from vellumspark.operators import captures, numbering, roles
from vellumspark.plans.common import CAPTURES_SQL, capture_rows, table


def best_provider(spark, sf_dir):
    return captures.best_provider(capture_rows(spark, sf_dir))


BEST_SQL = f"""select source_id, capture_id, ok from (select *, row_number() over (partition by source_id order by ok desc, capture_id desc) as r from {CAPTURES_SQL}) where r = 1"""


def contributing_captures(spark, sf_dir):
    return captures.contributing(best_provider(spark, sf_dir))


CONTRIBUTING_SQL = f"""with b as ({BEST_SQL}) select distinct capture_id, capture_id = (select max(capture_id) from b) as is_primary from b"""


def source_status(spark, sf_dir):
    c = capture_rows(spark, sf_dir)
    failed = F.col("event_type").isin("error", "click").cast("int")
    return c.select("capture_id", captures.source_status(failed, F.col("value") > 20, (F.col("value") > 80).cast("int")).alias("status"))


SOURCE_STATUS_SQL = f"""select capture_id, case when value > 20 and event_type not in ('error', 'click') then case when value > 80 then 'complete_with_warnings' else 'complete' end when value > 20 then 'partial' else 'failed' end as status from {CAPTURES_SQL}"""


def _results(spark, sf_dir):
    c = capture_rows(spark, sf_dir)
    status = F.when(F.col("ok") & (F.col("value") > 20), "complete").when(F.col("value") > 60, "complete_with_warnings").when(F.col("value") > 5, "partial").otherwise("failed")
    day = F.concat(F.col("day"), F.lit("-"), (F.col("source_id") % 97).cast("string"))
    return c.select(day.alias("capture_id"), status.alias("status"), (F.col("source_id") % 3 == 0).alias("required"), (F.col("value") > 40).alias("payload"))


RESULTS_SQL = f"""(select day || '-' || (source_id % 97)::varchar as capture_id, case when ok and value > 20 then 'complete' when value > 60 then 'complete_with_warnings' when value > 5 then 'partial' else 'failed' end as status,
  source_id % 3 = 0 as required, value > 40 as payload from {CAPTURES_SQL})"""


def capture_status(spark, sf_dir):
    return captures.capture_status(_results(spark, sf_dir))


MISSED = "required and status not in ('complete', 'complete_with_warnings')"
CAPTURE_STATUS_SQL = f"""select capture_id, case when bool_or({MISSED}) then case when bool_or({MISSED} and status = 'partial') or bool_or(payload) then 'partial' else 'failed' end
  when bool_or(status <> 'complete') then 'complete_with_warnings' else 'complete' end as status from {RESULTS_SQL} group by capture_id"""


def view_status(spark, sf_dir):
    """The views of all days."""
    days = capture_status(spark, sf_dir).withColumn("day", F.substring("capture_id", 1, 8))
    return captures.view_status(days, "day")


VIEW_SQL = f"""select left(capture_id, 8) as day, case when bool_and(status = 'complete') then 'complete' when bool_and(status in ('complete', 'complete_with_warnings')) then 'complete_with_warnings' else 'partial' end as status
from ({CAPTURE_STATUS_SQL}) group by 1"""


def report_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    n = d.groupBy("source").agg(F.count_if(F.col("n_chars") < 12).alias("errors"), F.count_if(F.col("n_chars") > 15000).alias("warnings"))
    return n.select("source", "errors", "warnings", captures.report_status(F.col("errors"), F.col("warnings")).alias("status"))


REPORT_SQL = """select source, errors, warnings, case when errors > 0 then 'incomplete' when warnings > 0 then 'complete_with_warnings' else 'complete' end as status
from (select source, count(*) filter (n_chars < 12) as errors, count(*) filter (n_chars > 15000) as warnings from documents group by source)"""


def complete_captures(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    results = li.select(F.col("l_orderkey").alias("capture_id"), F.col("l_linenumber").alias("source_id"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("complete").alias("status"))
    configured = spark.createDataFrame([(1,), (2,)], "source_id int")
    return captures.complete_full(results, configured)


COMPLETE_SQL = """select l_orderkey as capture_id, bool_and(l_linenumber in (1, 2) and l_returnflag <> 'R') and count(*) = 2 and count(distinct l_linenumber) = 2 as complete_full from lineitem group by 1"""

#: A path for each document, over all places that a capture has.
PATH = """case doc_id % 11 when 0 then 'sources/' || source || '/warc/' || doc_id || '.warc.gz' when 1 then 'sources/' || source || '/warc/' || doc_id || '.cdx' when 2 then 'sources/' || source || '/mirror/' || lang || '/' || doc_id || '.html'
 when 3 then 'sources/' || source || '/mirror/private/' || doc_id || '.zip' when 4 then 'sources/' || source || '/metadata/command.json' when 5 then 'sources/' || source || '/warc/deep/' || doc_id || '.WARC' when 6 then 'metadata/recipe-bundle/' || doc_id || '.py'
 when 7 then 'sources/' || source || '/warc/logs/' || doc_id || '.log' when 8 then 'metadata/environment.json' when 9 then 'sources/' || source || '/seeds.txt' else 'metadata/' || doc_id || '.json' end"""
KIND = "case when doc_id % 4 = 0 then null when doc_id % 2 = 0 then 'web' else 'http-file' end"
DEPTH, PLACE, WARC = "len(string_split(path, '/'))", "split_part(path, '/', 3)", "regexp_matches(lower(path), '\\.warc(\\.gz)?$')"
PAYLOAD = f"(starts_with(path, 'sources/') and {DEPTH} >= 4 and {PLACE} in ('warc', 'mirror'))"
ROLE_SQL = f"""case when {PAYLOAD} and {PLACE} = 'warc' then case when {WARC} then 'preservation_original' else 'capture_derivative' end
  when {PAYLOAD} then case when kind = 'http-file' then 'preservation_original' else 'capture_derivative' end else 'metadata' end"""
FILES_SQL = f"(select doc_id, source, strlen(text) as size, {PATH} as path, {KIND} as kind from documents)"


def _files(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("size"), F.expr(PATH).alias("path"), F.expr(KIND).alias("kind"))


def role_classification(spark, sf_dir):
    f, path, kind = _files(spark, sf_dir), F.col("path"), F.col("kind")
    return f.select("path", roles.role(path, kind).alias("role"), roles.inferred_role(path, kind).alias("inferred"), roles.is_payload(path).alias("payload"), roles.shareable(path).alias("shareable"))


ROLES_SQL = f"""select path, role, case when {PAYLOAD} and {PLACE} = 'warc' and {DEPTH} <> 4 then 'capture_derivative' else role end as inferred, {PAYLOAD} as payload,
  ({PAYLOAD} and not contains(path, '/private/') and not contains(path, '/logs/')) or path = 'metadata/environment.json' or starts_with(path, 'metadata/recipe-bundle/') or ends_with(path, '/seeds.txt') or ends_with(path, '/metadata/command.json') or ends_with(path, '.cdx') as shareable
from (select *, {ROLE_SQL} as role from {FILES_SQL})"""


def payload_metrics(spark, sf_dir):
    return captures.payload_metrics(_files(spark, sf_dir), "source")


METRICS_SQL = f"""select source, count(*) as files, sum(size)::bigint as bytes, count(*) filter ({WARC}) as warc_files, count(*) filter (size = 0) as empty_files from {FILES_SQL} group by source"""


def payload_oxum(spark, sf_dir):
    return captures.oxum(_files(spark, sf_dir), "source")


def _named(spark, sf_dir):
    """The same files, each under a name of its own."""
    return _files(spark, sf_dir).withColumn("path", F.concat_ws("-", "path", "doc_id"))


NAMED_SQL = f"(select doc_id, path || '-' || doc_id as path from {FILES_SQL})"


def role_coverage(spark, sf_dir):
    f = _named(spark, sf_dir)
    assigned = f.where("doc_id % 13 <> 0").select("path").unionByName(f.where("doc_id % 50 = 0").select(F.concat("path", F.lit(".gone")).alias("path")))
    return roles.coverage(f, assigned)


COVERAGE_SQL = f"""select path, 'no role' as problem from {NAMED_SQL} where doc_id % 13 = 0 union all select path || '.gone', 'no file' from {NAMED_SQL} where doc_id % 50 = 0"""


def export_selection(spark, sf_dir):
    f = _named(spark, sf_dir)
    allowed = f.where("doc_id % 6 = 0").select("path").unionByName(f.where("doc_id % 97 = 0").select(F.concat("path", F.lit("~")).alias("path")))
    chosen, unknown = roles.selected(f, "public", allowed)
    return chosen.withColumn("status", F.lit("selected")).unionByName(unknown.withColumn("status", F.lit("unknown")))


EXPORT_SQL = f"""select path, 'selected' as status from {NAMED_SQL} where doc_id % 6 = 0 union all select path || '~', 'unknown' from {NAMED_SQL} where doc_id % 97 = 0"""


def preservation_warcs(spark, sf_dir):
    f = _files(spark, sf_dir).withColumn("role", roles.role(F.col("path"), F.col("kind")))
    return roles.preservation_warcs(f).select("path", "size")


def dense_docids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    return numbering.dense_ids(d, ["source", "lang", "doc_id"])


def occurrence_numbers(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return numbering.occurrence(c, ["conv_id", "role"], ["turn"]).select("conv_id", "turn", "role", F.col("occurrence").cast("long").alias("occurrence"))


def item_neighbours(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return numbering.neighbours(c, ["conv_id"], ["turn"], "role")


def group_runs(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    out = numbering.run_starts(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"], "l_returnflag")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "starts_run", F.col("run").cast("long").alias("run"))


RUNS_SQL = """select l_orderkey, l_linenumber, l_partkey, s as starts_run, sum(s::int) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag rows unbounded preceding)::bigint as run from
(select *, row_number() over w = 1 or lag(l_returnflag) over w is distinct from l_returnflag as s from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag))"""


def sorted_check(spark, sf_dir):
    """Events that stand before the event above them; every fiftieth is ten days early."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.expr("if(event_id % 50 = 0, ts - interval 10 days, ts)").alias("ts"))
    return numbering.unsorted(e, ["user_id"], "event_id", ["ts"]).select("user_id", "event_id")


def positional_routes(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return numbering.dense_ids(n, ["n_name", "n_nationkey"], "at").select("n_nationkey", numbering.positional_route(F.col("at")).alias("route"))


def retained_quota(spark, sf_dir):
    return captures.quota_left(_files(spark, sf_dir), 10_000_000)


def environment_checks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return captures.environment(d.select(F.col("lang").alias("name"), (F.col("n") > 150).alias("ok")))


def lifecycle_status(spark, sf_dir):
    """Four independent dimensions for each collection, each absent where nothing is known."""
    d = table(spark, sf_dir, "documents")
    c = d.select(F.col("source").alias("collection_id")).distinct()
    part = lambda cond, s: d.where(cond).select(F.col("source").alias("collection_id"), F.lit(s).alias("status")).distinct()
    return captures.lifecycle(c, capture=part("n_chars > 12000", "complete"), validation=part("n_chars > 16000", "validated"), reader=part("n_chars > 18000", "built"), catalogue=part("n_chars < 6", "indexed"))


LIFECYCLE_SQL = """select source as collection_id, case when max(n_chars) > 12000 then 'complete' else 'absent' end as capture, case when max(n_chars) > 16000 then 'validated' else 'absent' end as validation,
 case when max(n_chars) > 18000 then 'built' else 'absent' end as reader, case when min(n_chars) < 6 then 'indexed' else 'absent' end as catalogue from documents group by source"""

QUERIES = {
    "best_provider": (best_provider, BEST_SQL),
    "contributing_captures": (contributing_captures, CONTRIBUTING_SQL),
    "source_status": (source_status, SOURCE_STATUS_SQL),
    "capture_status": (capture_status, CAPTURE_STATUS_SQL),
    "view_status": (view_status, VIEW_SQL),
    "report_status": (report_status, REPORT_SQL),
    "complete_captures": (complete_captures, COMPLETE_SQL),
    "role_classification": (role_classification, ROLES_SQL),
    "payload_metrics": (payload_metrics, METRICS_SQL),
    "payload_oxum": (payload_oxum, f"select source, sum(size)::varchar || '.' || count(*)::varchar as oxum from {FILES_SQL} group by source"),
    "role_coverage": (role_coverage, COVERAGE_SQL),
    "export_selection": (export_selection, EXPORT_SQL),
    "preservation_warcs": (preservation_warcs, f"select path, size from {FILES_SQL} where {ROLE_SQL} = 'preservation_original' and {WARC}"),
    "dense_docids": (dense_docids, "select source, lang, doc_id, row_number() over (order by source, lang, doc_id) as docid from documents"),
    "occurrence_numbers": (occurrence_numbers, "select conv_id, turn, role, row_number() over (partition by conv_id, role order by turn) as occurrence from conversations"),
    "item_neighbours": (item_neighbours, "select conv_id, turn, role, lag(role) over w as previous_role, lead(role) over w as next_role from conversations window w as (partition by conv_id order by turn)"),
    "group_runs": (group_runs, RUNS_SQL),
    "sorted_check": (sorted_check, "select user_id, event_id from (select *, lag(ts) over (partition by user_id order by event_id) as b from (select user_id, event_id, case when event_id % 50 = 0 then ts - interval 10 day else ts end as ts from events)) where b > ts"),
    "positional_routes": (positional_routes, "select n_nationkey, printf('%04d', row_number() over (order by n_name, n_nationkey)) as route from nation"),
    "retained_quota": (retained_quota, f"select greatest(0, 10000000 - sum(size))::bigint as left from {FILES_SQL}"),
    "environment_checks": (environment_checks, "select bool_and(n > 150) as ok, coalesce(string_agg(lang, ', ' order by lang) filter (n <= 150), '') as failed from (select lang, count(*) as n from documents group by lang)"),
    "lifecycle_status": (lifecycle_status, LIFECYCLE_SQL),
}
