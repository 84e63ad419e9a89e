"""One query for each operator, over its whole tables, and DuckDB SQL where SQL can say it."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import block_max, containment, filter_audit, histogram_sort, lexicon_bpe, line_rules, quality_fm, repair_grammar, simhash_trie, substring_index, token_histogram, toxicity, url_vocab
from vellumspark.llm._labelled import held_out, training_sample
from vellumspark.llm._store import materialize, shared_dir

TOKENIZER, BYTE_TOKENIZER, END_ID = "word_bpe_49k.json", "byte_bpe_50k.json", 2
#: Context limits and quantiles that the token report states.
LIMITS, SHARES = [128, 256, 512, 1024, 2048, 4096, 8192, 32768, 131072], [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classified(scores: DataFrame, threshold: float) -> DataFrame:
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0)
    return scores.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": predicted})


def op1_quality_fm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.fit(training_sample(docs, table(spark, sf_dir, "labels"), "quality"))
    return classified(quality_fm.score(docs, model), 0.3).select("doc_id", "held_out", "score", "predicted")


def op2_histogram_sort(spark, sf_dir):
    out = histogram_sort.shard(table(spark, sf_dir, "documents"), 16)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_token_histogram(spark, sf_dir):
    config = lexicon_bpe.read_config(public_tokenizers.path(TOKENIZER))
    hist = materialize(token_histogram.histogram(lexicon_bpe.count_tokens(table(spark, sf_dir, "documents"), config)))
    return token_histogram.report(hist, LIMITS, SHARES)


def op4_simhash_trie(spark, sf_dir):
    out = simhash_trie.cluster(table(spark, sf_dir, "documents"), 4)
    return out.select("doc_id", simhash_trie.hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op5_line_rules(spark, sf_dir):
    out = line_rules.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def op6_url_vocabulary(spark, sf_dir):
    return url_vocab.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "vocabulary_weight")


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sample = training_sample(docs, table(spark, sf_dir, "labels"), "toxic")
    weights = toxicity.learned_weights(sample)
    scores = toxicity.score(docs, weights, toxicity.fitted_scale(sample, weights))
    return classified(scores, 0.5).select("doc_id", "held_out", "score", "predicted", "n_hits")


def op8_substring_index(spark, sf_dir):
    out = substring_index.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def encoded(docs: DataFrame) -> DataFrame:
    config = lexicon_bpe.read_config(public_tokenizers.path(TOKENIZER))
    out = lexicon_bpe.encode_decode(docs, config, lexicon_bpe.compile_lexicon(docs, config))
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_lexicon_bpe(spark, sf_dir):
    return encoded(table(spark, sf_dir, "documents"))


def op10_containment(spark, sf_dir):
    return containment.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = filter_audit.cells(docs, table(spark, sf_dir, "labels"), F.col("lang"), filter_audit.text_filters(F.col("text")))
    return filter_audit.audit(counts, "ABCDE").drop("filter")


def op12_repair_files(spark, sf_dir):
    path = shared_dir(spark)
    with open(public_tokenizers.path(BYTE_TOKENIZER), encoding="utf-8") as f:
        repair_grammar.write(table(spark, sf_dir, "documents"), path, f.read(), END_ID)
    out = repair_grammar.read_documents(spark, path)
    n = F.floor(F.octet_length("ids") / 4).cast("long")
    return out.select("doc_id", "start", n.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op13_block_max(spark, sf_dir):
    return block_max.rank_all(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    all_ = [op1_quality_fm, op2_histogram_sort, op3_token_histogram, op4_simhash_trie, op5_line_rules, op6_url_vocabulary, op7_toxicity, op8_substring_index, op9_lexicon_bpe, op10_containment, op11_filter_audit, op12_repair_files, op13_block_max]
    return {f.__name__: f for f in all_}


SPLIT = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
#: A line's text without white space at its ends, as the line rules see it.
BARE = r"regexp_replace(regexp_replace(l, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"


def sql_line_rules() -> str:
    count = lambda p: f"len(regexp_extract_all(l, '{p}'))"
    n = r"len(string_split_regex(" + BARE + r", '[\x20\x09-\x0D]+'))"
    phrases = " or ".join(f"""contains(lower(l), '{p.replace("'", "''")}')""" for p in line_rules.PHRASES)
    has = rf"regexp_matches(l, '[^\x20\x09-\x0D]')"  # noqa: F541
    fails = f"({has} and ({count(line_rules.SIGNS)} > {n} * {line_rules.MAX_SIGN_SHARE} or {count(line_rules.SEPARATORS)} > {n} * {line_rules.MAX_SEPARATOR_SHARE} or {phrases}))"
    return rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {SPLIT} as w, string_split(coalesce(text, ''), chr(10)) as lines from documents),
m as (select *, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
  list_filter(lines, lambda l: {has}) as full_lines, array_to_string(list_filter(lines, lambda l: not {fails}), chr(10)) as clean from d),
win as (select r, i, array_to_string(w[i:i + 7], ' ') as g from (select r, w, unnest(range(1, n_words - 6)) as i from m where n_words > 8)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as c from win) where c > 1),
covered as (select r, sum(least(8, coalesce(lead_i - i, 8))) as n from (select r, i, lead(i) over (partition by r order by i) as lead_i from twice) group by r),
b as (select m.*, len(full_lines) - len(list_distinct(full_lines)) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words,
  greatest(length(text) - length(clean), 0) as lost_chars from m left join covered using (r)),
f as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from b)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  n_repeat_words::bigint as n_repeat_words, base_failed, not base_failed and lost_chars <= length(text) * {line_rules.MAX_LOST_SHARE} as kept, lost_chars::bigint as lost_chars from f"""


def sql_url_vocabulary() -> str:
    hit = lambda t: f"regexp_matches(lower(coalesce(url, '')), '(^|[^a-z0-9]){t}($|[^a-z0-9])')::int"
    weight = " + ".join([f"2 * {hit(t)}" for t in url_vocab.STRICT] + [hit(t) for t in url_vocab.SOFT])
    rules = sorted(url_vocab.RULES, key=lambda r: -len(r[0]) - len(r[1]))
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rule = " ".join(f"when {fits(h, p)} then '{h}{p}'" for h, p, _ in rules)
    by_rule = " ".join(f"when {fits(h, p)} then '{v}'" for h, p, v in rules)
    return f"""
with p as (select page_id, url, translate(regexp_extract(coalesce(url, ''), '{url_vocab.HOST}', 1), '{url_vocab.UPPER}', '{url_vocab.LOWER}') as host,
  regexp_extract(coalesce(url, ''), '{url_vocab.PATH}', 1) as path, ({weight})::bigint as vocabulary_weight from pages)
select page_id, host, path, case {rule} end as rule, case {by_rule} when vocabulary_weight >= 2 then 'block' else 'allow' end as verdict, vocabulary_weight from p"""


SQL_SUBSTRING = rf"""
with d as (select row_number() over () as r, doc_id, {SPLIT} as w from documents),
win as (select r, doc_id, i, array_to_string(w[i:i + 12], ' ') as g from (select r, doc_id, w, unnest(range(1, len(w) - 11)) as i from d where len(w) > 12)),
first as (select g, min(coalesce(doc_id, 9223372036854775807)) as least from win group by g),
gone as (select distinct r, p from (select r, unnest(range(i, i + 13)) as p from win join first using (g) where coalesce(doc_id, 9223372036854775807) > least)),
words as (select r, p, word from (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d)),
kept as (select r, string_agg(word, ' ' order by p) as kept, count(*) as n from words anti join gone using (r, p) group by r)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join kept using (r)"""

SQL_CONTAINMENT = rf"""
with words as (select 'd' as side, doc_id as id, row_number() over () as r, list_filter(list_transform({SPLIT}, lambda w: regexp_replace(lower(w), '[^\pL\pN]+', '', 'g')), lambda w: w <> '') as w from documents
  union all select 'b', item_id, row_number() over (), list_filter(list_transform({SPLIT}, lambda w: regexp_replace(lower(w), '[^\pL\pN]+', '', 'g')), lambda w: w <> '') from benchmark),
item as (select distinct r, id, k, array_to_string(w[i:i + k - 1], ' ') as g from (select r, id, w, least(len(w), 5) as k, unnest(range(1, len(w) - least(len(w), 5) + 2)) as i from words where side = 'b' and len(w) > 0)),
doc as (select distinct r, id, k, array_to_string(w[i:i + k - 1], ' ') as g from (select r, id, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (select distinct k from item) where side = 'd' and len(w) >= k)),
size as (select r, count(*) as n from item group by r)
select doc.id as doc_id, item.id as item_id, count(*)::bigint as n_shared, any_value(n)::bigint as n_item, count(*) / any_value(n) as containment
from item join doc using (k, g) join size on size.r = item.r group by doc.r, item.r, doc.id, item.id having count(*) >= 0.8 * any_value(n) - 1e-9"""


SQL_FILTER_AUDIT = rf"""
with l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by 1),
t as (select coalesce(doc_id, 9223372036854775807) as id, coalesce(lang, '') as part, coalesce(text, '') as text, {SPLIT} as w, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic from documents left join l using (doc_id)),
first as (select text, min(id) as least from t group by text),
m as (select part, good, toxic, (len(w) < 200)::int as fa, (100 * len(list_distinct(w)) < 50 * len(w))::int as fb, (100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text))::int as fc,
  regexp_matches(text, '[#$%&*|]')::int as fd, (id > least)::int as fe from t join first using (text)),
c as (select part, map(['A', 'B', 'C', 'D', 'E'], [fa, fb, fc, fd, fe]) as f, fa + fb + fc + fd + fe as fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by 1, 2, 3),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step, filter_order[step] as letter from o, range(1, 6) r(step)),
g as (select part, filter_order, step, letter, n, good, toxic, fails, f[letter] as now, list_sum([f[y] for y in string_split(filter_order[1:step - 1], '') if y <> '']) as earlier from c, s),
r as (select part, filter_order, step, letter, sum(case when now = 0 and coalesce(earlier, 0) = 0 then n else 0 end) as kept, sum(case when now = 1 and coalesce(earlier, 0) = 0 then n else 0 end) as removed,
  sum(case when now = 1 and earlier > 0 then n else 0 end) as redundant, sum(case when now = 1 and fails = 1 then n else 0 end) as unique_fails,
  sum(case when now = 1 and coalesce(earlier, 0) = 0 then good else 0 end) as good_lost, sum(case when now = 1 and coalesce(earlier, 0) = 0 then toxic else 0 end) as toxic_lost from g group by 1, 2, 3, 4)
select part, filter_order, step::int as step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost,
  toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from r"""

SQL_BLOCK_MAX = r"""
with d as (select row_number() over () as r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
i as (select k, item_id, term, count(*) as repeats from (select row_number() over () as k, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark) group by all),
len as (select r, any_value(doc_id) as doc_id, count(*) as n from d group by r),
c as (select count(*) as n_docs, sum(n)::bigint as n_terms from len),
tf as (select r, term, count(*) as tf from d where term in (select term from i) group by r, term),
w as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from tf, c group by term),
s as (select k, any_value(item_id) as item_id, r, any_value(len.doc_id) as doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint as score
  from i join w using (term) join tf using (term) join len using (r), c group by k, r)
select item_id, rank::int as rank, doc_id, score from (select *, row_number() over (partition by k order by score desc, doc_id nulls last) as rank from s where score > 0) where rank <= 10"""


def oracle_sql() -> dict:
    return {
        "op5_line_rules": sql_line_rules(), "op6_url_vocabulary": sql_url_vocabulary(), "op8_substring_index": SQL_SUBSTRING, "op10_containment": SQL_CONTAINMENT,
        "op11_filter_audit": SQL_FILTER_AUDIT, "op13_block_max": SQL_BLOCK_MAX,
    }
