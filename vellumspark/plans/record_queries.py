"""Queries over what captures state of themselves, over settings, reader payloads and one corpus's texts."""

import contextlib
import os
import shutil
import uuid

from pyspark.sql import functions as F

from vellumspark.functions import cuneiform
from vellumspark.operators import capture_record
from vellumspark.plans.common import table
from vellumspark.plans.file_queries import new_folder, write_files
from vellumspark.sources import files
from vellumspark.sources.shared import shared_folder, written

# Captures, one for each part: four kinds of records, and faults among those of schema 3.
RECORD = """case when k % 6 = 0 then '{"a":1}' when k % 6 = 1 then '{"schema_version":2}' when k % 6 = 2 then concat('{"schema_version":', if(k % 4 = 0, '"3"', '7'), '}')
 when k % 6 = 3 then '[1]' when k % 12 = 4 then '{"schema_version":3,"payload_roles":1}'
 else concat('{"schema_version":3,"payload_roles":[{"path":"capture.json","role":"metadata"},{"path":"sources/a/warc/x.warc.gz","role":"preservation_original"}',
  if(k % 5 = 0, ',{"path":"notes.txt","role":"capture_derivative"}', ''), if(k % 7 = 0, ',{"path":"sources/a/warc/x.warc.gz","role":"metadata"}', ''), if(k % 11 = 0, ',{"path":"../x","role":"metadata","more":1}', ''), ']}') end"""


#: Captures whose files stand on disk at once; each takes some 30 KB in files and folders, however little they hold.
AT_ONCE = 40_000


def _captures(spark, sf_dir):
    """Captures are written as files and read by the batch, so that disk is bounded; what was read of all of them is kept as a table.
    A batch takes over the folders of the one before: to make and remove them takes far longer than all the rest."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"))
    place = lambda rest: F.concat(F.lit("c"), F.col("k"), F.lit(rest))
    one = lambda path, content: F.struct(F.lit(path).alias("path"), content.alias("content"))
    batches = max(1, -(-p.count() // AT_ONCE))
    holds = F.array(one("capture.json", F.expr(RECORD)), one("sources/a/warc/x.warc.gz", F.lit("w")), F.when(F.expr("k % 6 < 2"), one("sources/b/mirror/i.html", F.lit("m"))))
    rows = p.select(F.pmod(F.xxhash64("k"), F.lit(batches)).alias("batch"), place("").alias("capture"), F.array_compact(holds).alias("files"))
    folder, read = new_folder(spark, "captures"), f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    for n in range(batches):
        _turn(rows, n, folder)
        records, listed = files.captured(spark, folder)
        both = records.withColumn("path", F.lit(None).cast("string")).unionByName(listed, allowMissingColumns=True)
        kept = written(both.coalesce(spark.sparkContext.defaultParallelism), f"{read}/{n}")
    _turn(rows, batches, folder)
    shutil.rmtree(folder, ignore_errors=True)
    kept = spark.read.schema(kept.schema).parquet(f"{read}/*").coalesce(spark.sparkContext.defaultParallelism * 4)  # each batch left small files
    records, listed = kept.where("path is null").select("capture", "document"), kept.where("path is not null").select("capture", "path")
    kinds = p.where("k % 10 <> 1").select(place("").alias("capture"), F.lit("b").alias("source_id"), F.expr("if(k % 4 = 0, 'http-file', 'web')").alias("kind"))
    return capture_record.verified(records, listed, kinds)


def _turn(rows, n: int, folder: str) -> None:
    """The captures of batch n take the place of those of the batch before, by the cluster. ``rows``: batch, capture, files (path, content).
    A capture's folder goes to one with the same paths, whose files are then written; what nobody takes is removed."""

    def run(batches):
        spare = {}
        for b in batches:
            for batch, name, held in zip(b["batch"], b["capture"], b["files"]):
                held = {f["path"]: f["content"] for f in held}
                alike = spare.setdefault(tuple(sorted(held)), [])
                if batch < n:
                    alike.append(name)
                else:
                    _take(os.path.join(folder, name), held, alike)
            yield b[["capture"]][:0]
        for name in (name for alike in spare.values() for name in alike):
            shutil.rmtree(os.path.join(folder, name), ignore_errors=True)  # a task that runs twice finds them gone

    own = rows.where(F.col("batch").isin(n - 1, n)).repartition(rows.sparkSession.sparkContext.defaultParallelism * 2, "capture")
    own.sortWithinPartitions("batch").mapInPandas(run, "capture string").count()


def _take(at: str, held: dict, spare: list) -> None:
    """Write a capture's files, into a spare folder with the same paths if there is one."""
    if spare:
        with contextlib.suppress(OSError):  # a task that runs twice finds it taken
            os.rename(os.path.join(os.path.dirname(at), spare.pop()), at)
    for path, content in held.items():
        file = os.path.join(at, path)
        try:
            to = os.open(file, os.O_WRONLY | os.O_CREAT, 0o666)
        except FileNotFoundError:
            os.makedirs(os.path.dirname(file), exist_ok=True)
            to = os.open(file, os.O_WRONLY | os.O_CREAT, 0o666)
        with open(to, "wb") as f:
            f.write(content.encode())
            f.truncate()


def capture_roles(spark, sf_dir):
    """Roles of the files of captures whose record holds, stated or by place."""
    return _captures(spark, sf_dir)[0].select("capture", "version", "path", "role", "stated")


def capture_problems(spark, sf_dir):
    """What is wrong with the other captures' records: how many problems, the first, and all in order."""
    return capture_record.in_order(_captures(spark, sf_dir)[1], "capture").select("capture", "problems", "first", F.array_join("messages", "; ").alias("messages"))


ROLES_SQL = """with p as (select p_partkey as k, 'c' || p_partkey as capture from part), old as (select *, case when k % 6 = 0 then 1 else 2 end as version from p where k % 6 < 2 and k % 10 <> 1),
new as (select *, 3 as version from p where k % 6 = 5 or k % 12 = 10), good as (select * from new where k % 5 <> 0 and k % 7 <> 0 and k % 11 <> 0)
select capture, version, 'capture.json' as path, 'metadata' as role, false as stated from old union all select capture, version, 'sources/a/warc/x.warc.gz', 'preservation_original', false from old
union all select capture, version, 'sources/b/mirror/i.html', case when k % 4 = 0 then 'preservation_original' else 'capture_derivative' end, false from old
union all select capture, version, 'capture.json', 'metadata', true from good union all select capture, version, 'sources/a/warc/x.warc.gz', 'preservation_original', true from good"""

PROBLEMS_SQL = """with p as (select p_partkey as k, 'c' || p_partkey as capture from part), m as (
select capture, 0 as s, 0 as i, 'no object' as t from p where k % 6 = 3
union all select capture, 1, 0, 'unknown schema: ' || case when k % 4 = 0 then '3' else '7' end from p where k % 6 = 2
union all select capture, 2, 0, 'no list of roles' from p where k % 12 = 4
union all select capture, 3, 2, 'role of a payload: notes.txt' from p where (k % 6 = 5 or k % 12 = 10) and k % 5 = 0
union all select capture, 3, 3, 'repeated path: sources/a/warc/x.warc.gz' from p where (k % 6 = 5 or k % 12 = 10) and k % 7 = 0
union all select capture, 3, 4, 'no path and role: ' || (2 + (k % 5 = 0)::int + (k % 7 = 0)::int) from p where (k % 6 = 5 or k % 12 = 10) and k % 11 = 0
union all select capture, 5, 0, 'no file: notes.txt' from p where (k % 6 = 5 or k % 12 = 10) and k % 5 = 0
union all select capture, 6, 0, 'unknown kind: b' from p where k % 6 < 2 and k % 10 = 1)
select capture, count(*) as problems, first(t order by s, i) as first, string_agg(t, '; ' order by s, i) as messages from m group by capture"""


def capture_moments(spark, sf_dir):
    """When each capture was, by its end, its start or the present, and whether a new id tells that moment."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    ended = F.expr("case o_orderkey % 4 when 0 then concat(d, 'T10:00:00Z') when 1 then concat(d, 'T23:30:00.25-02:00') when 2 then concat(d, 'T10:00:00') end")
    now = F.expr("timestamp'2024-02-29 01:02:03Z'")
    fresh = capture_record.new_capture_id(now)
    return o.select("o_orderkey", capture_record.capture_moment(ended, F.when(F.col("o_orderkey") % 3 == 0, F.concat("d", F.lit("T00:00:00+00:00"))), now).alias("moment"), (capture_record.captured_at(fresh) == now).alias("id_tells"))


MOMENTS_SQL = """select o_orderkey, case when o_orderkey % 4 = 0 then strftime(o_orderdate, '%Y-%m-%d') || 'T10:00:00Z' when o_orderkey % 4 = 1 then strftime(o_orderdate::date + 1, '%Y-%m-%d') || 'T01:30:00.250000Z'
 when o_orderkey % 3 = 0 then strftime(o_orderdate, '%Y-%m-%d') || 'T00:00:00Z' else '2024-02-29T01:02:03Z' end as moment, true as id_tells from orders"""


def portable_commands(spark, sf_dir):
    """Commands of captures without the places of one machine."""
    c = table(spark, sf_dir, "customer").select(
        "c_custkey", F.array(F.lit("/opt/bin/wget"), F.lit("--tries=3"), F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" it's"))).otherwise(F.lit("https://a.org/x")), F.lit("")).alias("argv"), F.lit("/data/run").alias("working_directory"),
        F.array(F.lit("/data/run"), F.concat(F.lit("/data/"), F.when(F.col("c_custkey") % 5 == 0, "other/").otherwise("run/"), F.lit("warc"))).alias("required_directories"),
    )
    return capture_record.portable(c).select("c_custkey", "working_directory", "shell_command", F.array_join("required_directories", ",").alias("folders"))


PORTABLE_SQL = """select c_custkey, '.' as working_directory, 'wget --tries=3 ' || case when c_custkey % 2 = 0 then '''' || c_name || ' it''"''"''s''' else 'https://a.org/x' end || ' ''''' as shell_command,
 case when c_custkey % 5 <> 0 then '.,warc' end as folders from customer"""


def setting_rules(spark, sf_dir):
    """Settings that contradict each other, in the order of the rules."""
    bit = lambda n: (F.shiftright("p_partkey", n) % 2 == 1)
    names = ["mirror", "warc", "warc_cdx", *capture_record.MIRROR_ONLY]
    s = table(spark, sf_dir, "part").select("p_partkey", *[bit(i).alias(n) for i, n in enumerate(names)])
    return capture_record.setting_problems(s).select("p_partkey", F.array_join("problems", "; ").alias("problems"))


SETTINGS_SQL = """select p_partkey, concat_ws('; ', case when p_partkey & 3 = 0 then 'neither mirror nor warc' end, case when p_partkey & 6 = 4 then 'warc_cdx without warc' end, case when p_partkey & 9 = 8 then 'convert_links without mirror' end,
 case when p_partkey & 17 = 16 then 'adjust_extension without mirror' end, case when p_partkey & 33 = 32 then 'page_requisites without mirror' end) as problems from part"""


def reader_payloads(spark, sf_dir):
    """What is wrong with the files that readers returned: a reader for each customer, a file for each order."""
    o = table(spark, sf_dir, "orders")
    name = F.expr("case o_orderkey % 9 when 0 then 'index.html' when 1 then '../x' when 2 then 'metadata.json' when 3 then 'a\\\\\\\\b' else concat('p/', o_orderkey, '.html') end")
    f = o.select(F.col("o_custkey").alias("reader"), name.alias("name"), F.when(F.col("o_orderkey") % 10 != 4, F.col("o_orderpriority")).alias("content"))
    r = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("reader"), F.expr("case c_custkey % 3 when 0 then 'complete' when 1 then 'incomplete' else 'fine' end").alias("status"))
    return capture_record.reader_problems(r, f).select("reader", "ordinal", "problem", "detail")


PAYLOADS_SQL = r"""with f as (select o_custkey as reader, case o_orderkey % 9 when 0 then 'index.html' when 1 then '../x' when 2 then 'metadata.json' when 3 then 'a\\b' else 'p/' || o_orderkey || '.html' end as name, o_orderkey % 10 = 4 as bare from orders)
select reader, 3 as ordinal, case name when '../x' then 'unsafe path' when 'a\\b' then 'unsafe path' when 'metadata.json' then 'reserved path' else 'no text' end as problem, name as detail from f where name in ('../x', 'a\\b', 'metadata.json') or bare
union all select c_custkey, 1, 'unknown status', 'fine' from customer where c_custkey % 3 = 2 union all select c_custkey, 5, 'no index', null from customer where c_custkey not in (select reader from f where name = 'index.html')"""


def recipe_paths(spark, sf_dir):
    """Where the recipes of public collections are; none for an id that is not safe."""
    ids = table(spark, sf_dir, "part").select("p_partkey", F.expr("case p_partkey % 3 when 0 then concat('r', p_partkey) when 1 then concat('../', p_partkey) else concat('R', p_partkey) end").alias("id"))
    return ids.select("p_partkey", capture_record.recipe_path(F.col("id"), "recipes").alias("path"))


# Texts of the corpus in four shapes, one for each customer: blocks and entities; every element within a line; texts within
# texts, with heads behind bodies; no body, or not well formed.
TEXTS = [
    """concat('<TEI.2><text n="', c_custkey, '"><head>A &d; b</head><body> l&c; <head>&hr;</head><lg type="v"><l n="1">a<w type="noun">&jic;', c_custkey, '</w> &amp; &zz;</l>x</lg><p n="1">&mu;<gap extent="2"/><note>n</note></p><l n="1">&eacute;<lb/></l>',
 '<trailer>t</trailer><q>y</q><q/></body></text></TEI.2>')""",
    """concat('<TEI.2><text><body><div1 type="seg"><l n="', c_custkey, '&g;"><foreign>f</foreign><unclear>u</unclear><corr>c</corr><supplied>s</supplied><suppliedEnd>gone</suppliedEnd><damage/>d<damageEnd/><gap/><w>w<note>in <q>q&d;</q></note></w><odd>o</odd></l>',
 '<l>bare</l></div1><div1 n="II"><lg><p>&lt;p</p></lg></div1><!-- &zz; --><gap extent="3 &quot;lines&quot;"/> tail &ki; </body></text></TEI.2>')""",
    """concat('<x><text n="o"><body><l n="1">a</l><text n="i"><body><l n="1">b', c_custkey, '</l></body></text><l n="1">c</l></body><head>last <b>h</b>&c;</head><body>two</body></text></x>')""",
    """if(c_custkey % 8 = 3, concat('<x>', c_custkey, '</x>'), concat('<x>', c_custkey, '<'))""",
]
TEXT = "case c_custkey % 4 " + " ".join(f"when {k} then {t}" for k, t in enumerate(TEXTS)) + " end"


def cuneiform_bodies(spark, sf_dir):
    """Text bodies as HTML, entities that nothing explains, and the numbered segments with their ids and places."""
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.expr(TEXT).alias("document"))
    out = cuneiform.bodies(docs, "c_custkey", "tr", identifier=F.concat(F.lit("c."), F.col("c_custkey")), route=F.concat(F.lit("works/"), F.col("c_custkey"), F.lit(".html")))
    return out.select("c_custkey", "html", F.array_join("unknown", ",").alias("unknown"), F.array_join(F.transform("segments", lambda s: F.concat_ws("|", s["title"], s["occurrence"], s["segment_id"], s["route"])), ",").alias("segments"))


def bodies_sql() -> str:
    sup = lambda n, t: f'<sup class="determinative" title="ETCSL determinative {n}">{t}</sup>'
    line = lambda at, n, t: f'<div id="segment-tr-line-{at}" class="line"><span class="line-number">{n}</span><span class="line-text">{t}</span></div>'
    milestone = lambda what, sign: f'<span class="milestone" title="{what}">&#x{sign};</span>'
    first = f"""'<section class="text-body"><h3>' || c_custkey || ' - A d b</h3><p>lš</p><h4><span class="ruling" role="separator" title="horizontal ruling">―</span></h4><section class="line-group"><h4>v</h4>
{line("1--occurrence-1", "1", f'a<span class="word" title="noun">{sup("jic", "ĝiš")}@</span> &amp; &amp;zz;')}<p>x</p></section><p id="segment-tr-paragraph-1--occurrence-1" class="paragraph"><span class="line-number">1</span>{sup("mu", "mu")}<span class="gap">[gap: 2]</span><span class="note">[note: n]</span></p>
{line("1--occurrence-2", "1", "é<br>")}<aside class="trailer"><p>t</p></aside><div class="annotation-block"><q>y</q></div><div class="annotation-block"><q></q></div></section>'""".replace("\n", "").replace("@", "' || c_custkey || '")
    inside = (
        '<span class="foreign">f</span><span class="unclear">u</span><span class="correction">c</span>' + milestone("supplied text begins", "27e8") + "s" + milestone("supplied text ends", "27e9") + milestone("damaged text begins", "2e22") + "d"
        + milestone("damaged text ends", "2e23") + f'<span class="gap">[gap: unspecified]</span><span class="word" title="word">w<span class="note">[note: in <q>q{sup("d", "d")}</q>]</span></span>o'
    )
    second = f"""'<section class="text-body"><h3>Text</h3><section class="segment"><h4>seg</h4>{line("@~c4~9d--occurrence-1", "@ĝ", inside)}<div class="line"><span class="line-number"></span><span class="line-text">bare</span></div></section><section class="segment"><h4>II</h4>
<section class="line-group"><p class="paragraph"><span class="line-number"></span>&lt;p</p></section></section><div class="annotation-block"><span class="gap">[gap: 3 &quot;lines&quot;]</span></div><p>tail {sup("ki", "ki")}</p></section>'""".replace("\n", "").replace("@", "' || c_custkey || '")
    third = f"""'<section class="text-body"><h3>o - last hš</h3>{line("1--occurrence-1", "1", "a")}<div class="annotation-block">b@</div>{line("1--occurrence-2", "1", "c")}</section><section class="text-body"><h3>o - last hš</h3><p>two</p></section><section class="text-body"><h3>i</h3>{line("1--occurrence-3", "1", "b@")}</section>'""".replace("@", "' || c_custkey || '")
    seg = lambda kind, label, n, at=None: f"'{kind.title()} ' || {label} || '|{n}|tp:etcsl/segment/c.' || c_custkey || '%2Ftr%2F{kind}%2F' || {at and at[0] or label} || '%2F{n}|works/' || c_custkey || '.html#segment-tr-{kind}-' || {at and at[1] or label} || '--occurrence-{n}'"
    join = " || ',' || ".join
    segments = [
        join([seg("line", "'1'", 1), seg("paragraph", "'1'", 1), seg("line", "'1'", 2)]), seg("line", "c_custkey || 'ĝ'", 1, ("c_custkey || '%C4%9D'", "c_custkey || '~c4~9d'")),
        join([seg("line", "'1'", k) for k in (1, 2, 3)]), "case when c_custkey % 8 = 3 then '' end",
    ]
    html = [first, second, third, """case when c_custkey % 8 = 3 then '<p class="unavailable">No text body was found.</p>' end"""]
    pick = lambda values: "case c_custkey % 4 " + " ".join(f"when {k} then {v}" for k, v in enumerate(values)) + " end"
    return f"select c_custkey, {pick(html)} as html, {pick(chr(39) + x + chr(39) if x is not None else segments[3] for x in ('zz', 'zz', '', None))} as unknown, {pick(segments)} as segments from customer"


def sniffed_files(spark, sf_dir):
    """Catalogues and archives told by their content, with the path only where there is one of a kind."""
    folder = new_folder(spark, "sniffed")
    p = table(spark, sf_dir, "part")
    empty_zip = F.unhex(F.lit("504B0506" + "00" * 18))
    rows = p.select(F.concat("p_brand", F.lit("/f"), "p_partkey").alias("path"), F.when(F.col("p_partkey") % 7 == 0, empty_zip).when(F.col("p_partkey") == 1, F.encode(F.concat(F.lit("all works ref=c.1 "), "p_name"), "UTF-8")).otherwise(F.encode("p_name", "UTF-8")).alias("content"))
    write_files(rows, folder)
    listed = rows.select("path", F.octet_length("content").alias("size"))
    return files.only_one(files.sniffed(listed, ["all works", "ref=c."], folder)).select("what", "n", "path")


QUERIES = {
    "capture_roles": (capture_roles, ROLES_SQL),
    "capture_problems": (capture_problems, PROBLEMS_SQL),
    "capture_moments": (capture_moments, MOMENTS_SQL),
    "portable_commands": (portable_commands, PORTABLE_SQL),
    "setting_rules": (setting_rules, SETTINGS_SQL),
    "reader_payloads": (reader_payloads, PAYLOADS_SQL),
    "recipe_paths": (recipe_paths, "select p_partkey, case when p_partkey % 3 = 0 then 'recipes/r' || p_partkey || '/collection.toml' end as path from part"),
    "cuneiform_bodies": (cuneiform_bodies, bodies_sql()),
    "sniffed_files": (sniffed_files, "select 'zip' as what, count(*) as n, case when count(*) = 1 then min(p_brand || '/f' || p_partkey) end as path from part where p_partkey % 7 = 0 having count(*) > 0 union all select 'catalogue', 1, p_brand || '/f1' from part where p_partkey = 1"),
}
