"""The registered queries of the library and the DuckDB SQL of those that SQL can say."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import classify, code, jsoncrush, masks, prose, shell
from ..functions.text import content_hash, json_string_length, lines_with_ends, saved_by, saved_tokens, tokens
from ..operators import budget, callgraph, reports, store
from ..operators import messages as m
from ..sources import tables as t
from . import pipeline, requests

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# -- SQL pieces. RE2 has no (?U) and (?d) of Java, and its classes are ASCII.


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    if flags:
        kept = "".join(c for c in flags[1] if c in "ims")
        pattern = (f"(?{kept})" if kept else "") + pattern[flags.end() :]
    return pattern.replace(r"\z", r"\z")


def chain(text: str, steps) -> str:
    for pattern, new in steps:
        text = f"regexp_replace({text}, {quote(re2(pattern))}, {quote(new.replace('$', chr(92)))}, 'g')"
    return text


def stripped(text: str) -> str:
    return chain(text, ((r"^\s+", ""), (r"\s+\z", "")))


FILL = [(p, "") for p in prose.FILLERS]
PHRASE = [(rf"(?i)\b{p}\b", new) for p, new in prose.PHRASES.items()]
TIDY = [(r"(?m)[ \t]+$", ""), (r"  +", " ")]
MINIFIED = stripped(chain("x.text", [*FILL, *PHRASE, *TIDY]))
SAVED = "(2 * greatest(0, length({0}) - length({1}))) // 7"
A = "(2 * ({0})) // 7"
TOK = "greatest(1, (2 * length({0})) // 7)"
HASH = "substr(sha256({0}), 1, 16)"


def kind_sql(x: str) -> str:
    bare = stripped(x)
    marks = " + ".join(f"contains({x}, {quote(k)})::int" for k in classify.CODE_MARKS)
    is_json = f"(regexp_matches({bare}, '^[\\[{{]') and (json_valid({bare}) or length({bare}) > 100))"
    is_code = f"(regexp_matches({x}, '(?m)^```') or ({marks}) >= 2)"
    is_shell = f"regexp_matches({x}, {quote(classify.SHELL_MARKS)})"
    n = f"({is_json}::int + {is_code}::int + {is_shell}::int)"
    return f"case when {n} = 0 then 'conversation' when {n} > 1 then 'mixed' when {is_json} then 'json_data' when {is_code} then 'code' else 'shell_output' end"


def _savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.messages(spark, sf_dir).withColumn("kind", classify.kind(F.col("content"))).withColumn("small", prose.minify(F.col("content")))
    gain = F.when(F.col("kind") == "conversation", saved_by(F.col("content"), F.col("small"))).otherwise(0)
    rows = rows.withColumn("gain", gain).withColumn("new", F.when(F.col("gain") > 0, F.col("small")).otherwise(F.col("content")))
    return rows.groupBy("request_id").agg(F.count("*").alias("messages"), F.sum(F.length("content")).alias("raw_chars"), F.sum(F.length("new")).alias("compressed_chars"), F.sum("gain").alias("saved_tokens"))


@query(
    f"""with a as (select x.conv_id, x.text, {kind_sql('x.text')} as kind, {MINIFIED} as small from conversations x),
    b as (select *, case when kind = 'conversation' then {SAVED.format('text', 'small')} else 0 end as gain from a)
    select conv_id as request_id, count(*) as messages, sum(length(text))::bigint as raw_chars,
    sum(case when gain > 0 then length(small) else length(text) end)::bigint as compressed_chars, sum(gain)::bigint as saved_tokens from b group by 1"""
)
def flagship_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _savings(spark, sf_dir)


@query(
    r"""select doc_id, length(text) as n_chars, (2 * length(text)) // 7 as saved_tokens, greatest(1, (2 * length(text)) // 7) as tokens,
    length(text) + 2 + len(regexp_extract_all(text, '["\\\n\r\t\x08\f]')) + 5 * len(regexp_extract_all(text, '[\x00-\x07\x0b\x0e-\x1f\x7f-\x{ffff}]'))
    + 11 * len(regexp_extract_all(text, '[\x{10000}-\x{10ffff}]')) as json_chars, substr(sha256(text), 1, 16) as hash from documents"""
)
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return t.table(spark, sf_dir, "documents").select("doc_id", F.length(x).cast("long").alias("n_chars"), saved_tokens(F.length(x)).alias("saved_tokens"), tokens(x).alias("tokens"), json_string_length(x).alias("json_chars"), content_hash(x).alias("hash"))


@query(f"select x.doc_id, {kind_sql('x.text')} as kind from documents x")
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select("doc_id", classify.kind(F.col("text")).alias("kind"))


@query(f"select x.page_id, {kind_sql('x.html')} as kind from pages x")
def classify_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "pages").select("page_id", classify.kind(F.col("html")).alias("kind"))


@query()
def split_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.col("text"), F.lit("\n```python\ndef f(x):\n    return x\n```\n"), F.lit("tail\n```json\n{\"a\": 1}\n```"))
    rows = t.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(classify.split_blocks(fenced)).alias("place", "b"))
    return rows.select("conv_id", "turn", "place", "b.kind", "b.language", F.length("b.text").alias("n_chars"))


def _count_sql(name: str) -> str:
    pattern = next(p for n, p, _ in masks.PATTERNS if n == name)
    return f"select '{name}' as pattern, sum(len(regexp_extract_all(text, {quote(re2(pattern))})))::bigint as total from documents"


@query(
    "select * from ("
    + " union all ".join(_count_sql(n) for n in ("aws_access_key", "password_kv", "ssn", "email"))
    + r""" union all select 'credit_card', sum(len(list_filter(regexp_extract_all(text, '\b(?:\d[ \-]?){13,19}\b'), lambda m:
    list_sum(list_transform(range(1, length(regexp_replace(m, '[ \-]', '', 'g')) + 1), lambda i:
      case when (length(regexp_replace(m, '[ \-]', '', 'g')) - i) % 2 = 1
        then substr(regexp_replace(m, '[ \-]', '', 'g'), i, 1)::int * 2 - case when substr(regexp_replace(m, '[ \-]', '', 'g'), i, 1)::int > 4 then 9 else 0 end
        else substr(regexp_replace(m, '[ \-]', '', 'g'), i, 1)::int end)) % 10 = 0)))::bigint from documents
    ) where total > 0"""
)
def mask_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = t.table(spark, sf_dir, "documents").select(masks.scrub("text").alias("m")).select(F.explode("m.hits").alias("pattern", "count"))
    return reports.mask_totals(hits)


@query()
def mask_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").select("doc_id", masks.scrub("text").alias("m")).select("doc_id", F.col("m.text").alias("text"), F.map_entries("m.hits").alias("hits"))


@query(
    r"""select doc_id, m as digits, list_sum(list_transform(range(1, length(m) + 1), lambda i: case when (length(m) - i) % 2 = 1
    then substr(m, i, 1)::int * 2 - case when substr(m, i, 1)::int > 4 then 9 else 0 end else substr(m, i, 1)::int end)) % 10 = 0 as valid
    from (select doc_id, unnest(regexp_extract_all(text, '[0-9]{13,19}')) as m from documents)"""
)
def card_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{13,19}"), F.lit(0))).alias("digits"))
    return found.withColumn("valid", masks.luhn_ok(F.col("digits")))


@query(
    r"""select doc_id, run, (select -sum(n * 1.0 / length(run) * log2(n * 1.0 / length(run))) from
    (select count(*) as n from (select unnest(string_split(run, '')) as c) group by c)) >= 4.5 as high
    from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9+/=_\-]{40,}')) as run from documents)"""
)
def entropy_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = t.table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(masks.ENTROPY_RUN), F.lit(0))).alias("run"))
    return found.withColumn("high", masks.entropy_bits(F.col("run")) >= masks.ENTROPY_LEAST)


_SIM = """grams as (select {id}, unnest(range(1, length(text) - 2)) as i, text from {table} where length(text) >= 4),
    bits as (select {id}, ('0x' || substr(md5(substr(text, i, 4)), 17, 16))::ubigint as h from grams),
    sums as (select {id}, b, sum(case when (h >> b) & 1 = 1 then 1 else -1 end) as s from bits, range(0, 64) r(b) group by all),
    prints as (select {id}, bit_or(case when s > 0 then (1::hugeint << b) else 0 end) as p from sums group by all)"""


@query(
    "with " + _SIM.format(id="conv_id, turn", table="conversations")
    + " select c.conv_id as request_id, c.turn as msg_idx, (case when coalesce(p, 0) >= 9223372036854775808 then coalesce(p, 0) - 18446744073709551616 else coalesce(p, 0) end)::bigint as simhash from conversations c left join prints using (conv_id, turn)"
)
def simhash_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.messages(spark, sf_dir).select("request_id", "msg_idx", m.simhash64("content").alias("simhash"))


_NEAR = """, d as (select {part} as part, {ord} as ord, text, coalesce(p, 0) as p, row_number() over (partition by {part} order by {ord}) as rn from {table} left join prints using ({id})),
    pairs as (select a.part, a.ord, b.ord as ref, a.text = b.text as same, 64 - bit_count((xor(a.p, b.p))::hugeint) as bits from d a join d b on a.part = b.part and b.rn between a.rn - 10 and a.rn - 1
      where length(a.text) >= 80 and length(b.text) >= 80),
    best as (select part, ord, max(case when same then ref end) as exact, arg_max(ref, bits * 10000000 + ref) filter (where bits >= {least}) as near, max(bits) filter (where bits >= {least}) as bits from pairs group by all)
    select d.part as request_id, d.ord as msg_idx, coalesce(exact, near) as ref_idx, case when exact is not null then 64 else bits end as same_bits, coalesce(exact, near) is not null as is_dup
    from d left join best using (part, ord)"""


@query("with " + _SIM.format(id="conv_id, turn", table="conversations") + _NEAR.format(part="conv_id", ord="turn", table="conversations", id="conv_id, turn", least=48))
def near_dup_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.near_dup_turns(t.messages(spark, sf_dir), threshold=0.75).select("request_id", "msg_idx", "ref_idx", "same_bits", "is_dup")


@query("with " + _SIM.format(id="doc_id", table="documents") + _NEAR.format(part="lang || '-' || (doc_id // 500)", ord="doc_id", table="documents", id="doc_id", least=55))
def near_dup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").select(F.concat_ws("-", "lang", F.floor(F.col("doc_id") / 500).cast("string")).alias("request_id"), F.col("doc_id").alias("msg_idx"), F.col("text").alias("content"))
    return m.near_dup_turns(docs).select("request_id", "msg_idx", "ref_idx", "same_bits", "is_dup")


_AGED = "select *, count(*) over (partition by conv_id) - row_number() over (partition by conv_id order by turn) as age from conversations"
_ZONE = "case when role = 'system' then 'system' when regexp_matches(text, '^\\s*\\[PIN\\]') then 'pinned' when age < {0} then 'recent' when age < {1} then 'partial' else 'digest' end"


@query(f"select conv_id as request_id, turn as msg_idx, age, {_ZONE.format(1, 3)} as zone from ({_AGED})")
def decay_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.decay(t.messages(spark, sf_dir), recent=1, partial=2).select("request_id", "msg_idx", "age", "zone")


@query()
def decay_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.decay(t.messages(spark, sf_dir), recent=1, partial=2).select("request_id", "msg_idx", "zone", "new_content", "saved")


_PIN = "case when turn % 3 = 0 then '  [PIN] ' || text else text end"


@query(rf"select conv_id as request_id, turn as msg_idx, regexp_matches(c, '^\s*\[PIN\]') as pinned, {chain('c', ((r'^\s*\[PIN\]', ''), (r'^\s+', '')))} as text from (select conv_id, turn, {_PIN} as c from conversations)")
def pin_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.messages(spark, sf_dir).withColumn("c", F.when(F.col("msg_idx") % 3 == 0, F.concat(F.lit("  [PIN] "), F.col("content"))).otherwise(F.col("content")))
    return rows.select("request_id", "msg_idx", m.is_pinned(F.col("c")).alias("pinned"), m.unpin(F.col("c")).alias("text"))


@query(f"select x.conv_id, x.turn, {MINIFIED} as text from conversations x")
def minify_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "conversations").select("conv_id", "turn", prose.minify(F.col("text")).alias("text"))


_MD = "'## ' || text || ' **bold** and *it* ~~gone~~ in order to make use of'"


@query(f"select conv_id, turn, {chain(f'({_MD})', prose.MARKDOWN)} as text from conversations")
def strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("## "), F.col("text"), F.lit(" **bold** and *it* ~~gone~~ in order to make use of"))
    return t.table(spark, sf_dir, "conversations").select("conv_id", "turn", prose.strip_markdown(marked).alias("text"))


@query(f"select conv_id, turn, {stripped(chain(f'({_MD})', PHRASE + TIDY))} as text from conversations")
def compact_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("## "), F.col("text"), F.lit(" **bold** and *it* ~~gone~~ in order to make use of"))
    return t.table(spark, sf_dir, "conversations").select("conv_id", "turn", prose.minify(marked, fillers=False).alias("text"))


_LOG = r"""log as (select user_id, string_agg(case event_id % 9 when 0 then 'test_' || event_type || ' PASSED' when 1 then 'tests/t.py::' || event_type || ' PASSED'
    when 2 then '--- PASS: ' || event_type when 3 then event_type || 'Error: value ' || event_id when 4 then 'collecting ...' when 5 then 'step ' || event_type
    when 6 then '  File "/usr/lib/python3/site-packages/x.py", line 1' when 7 then 'step ' || event_type || ' again' else (event_id % 7) || ' passed' end || chr(10), '' order by event_id) as text from events group by 1)"""
_PASSING = "(" + "|".join(re2(p) if p.startswith("(?i") else f"(?:{re2(p)})" for p in shell.PASSING).replace("(?i)", "") + ")"


@query(f"with {_LOG} select user_id, array_to_string(list_filter(regexp_extract_all(text, '[^\\n]*\\n'), lambda x: not regexp_matches(x, {quote('(?i)' + _PASSING)})), '') as kept, len(regexp_extract_all(text, '[^\\n]*\\n')) as lines from log")
def shell_pass_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_with_ends(F.col("text"))
    return t.logs(spark, sf_dir).select("user_id", F.array_join(shell.drop_passing(lines), "").alias("kept"), F.size(lines).cast("long").alias("lines"))


@query(rf"with {_LOG} select user_id, list_last(regexp_extract_all(text, {quote('(?im)^(?:' + chr(92) + 'w+' + chr(92) + '.)*' + chr(92) + 'w*(?:Error|Exception|Warning|Failure|Fault|Panic|FAIL|fatal)[^' + chr(92) + 'n]*')})) as root from log")
def shell_root_exception(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.logs(spark, sf_dir).select("user_id", shell.root_exception(F.col("text")).alias("root"))


@query(rf"with {_LOG}, l as (select user_id, regexp_extract_all(text, '[^\n]*\n') as ls from log) select user_id, case when len(ls) > 20 then array_to_string(ls[1:10], '') || chr(10) || '… [' || (len(ls) - 20) || ' lines omitted] …' || chr(10) || array_to_string(ls[len(ls) - 9:], '') else array_to_string(ls, '') end as text from l")
def shell_line_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.logs(spark, sf_dir).select("user_id", F.array_join(shell.cap_lines(lines_with_ends(F.col("text")), 20), "").alias("text"))


@query()
def shell_group_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.logs(spark, sf_dir).select("user_id", F.array_join(shell.group_similar(lines_with_ends(F.col("text"))), "").alias("text"))


_LINE = _LOG[_LOG.index("case event_id") : _LOG.index(" || chr(10), '' order by")]


@query(
    f"""with l as (select user_id, event_id % 9 = 6 as f, row_number() over (partition by user_id order by event_id) as rn, ({_LINE}) || chr(10) as line from events),
    g as (select *, rn - row_number() over (partition by user_id, f order by rn) as island from l),
    k as (select user_id, min(rn) as rn, case when f then '    … ' || count(*) || case when count(*) > 1 then ' stdlib/venv frames omitted …' else ' stdlib/venv frame omitted …' end || chr(10)
      else string_agg(line, '' order by rn) end as part from g group by user_id, f, island)
    select user_id, string_agg(part, '' order by rn) as text from k group by 1"""
)
def shell_frame_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.logs(spark, sf_dir).select("user_id", F.array_join(shell.collapse_frames(lines_with_ends(F.col("text"))), "").alias("text"))


@query()
def shell_minify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.logs(spark, sf_dir).select("user_id", shell.minify_shell(F.col("text")).alias("text"))


_FILES = "select 'src/m' || (o_custkey % 40) || '.py' as path, o_orderkey as seq, o_orderstatus as c from orders"


@query(
    f"""with f as ({_FILES}), g as (select *, lag(c) over (partition by path order by seq) as p from f)
    select path, seq, (1 + sum(case when p <> c then 1 else 0 end) over (partition by path order by seq))::bigint as version, coalesce(p = c, false) as unchanged from g"""
)
def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.file_versions(t.files(spark, sf_dir)).select("path", "seq", "version", "unchanged")


@query(f"with f as ({_FILES}), g as (select *, lag(c) over (partition by path order by seq) as p from f) select count(distinct path) as paths, count(*) filter (where p is null or p <> c) as stored from g")
def file_store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.file_versions(t.files(spark, sf_dir)).agg(F.count_distinct("path").alias("paths"), F.count_if(~F.col("unchanged")).alias("stored"))


_BODY = "'# module' || chr(10) || repeat('def f_' || c || '(x):' || chr(10) || '    return x' || chr(10), 20) || 'STATE = ' || c || chr(10)"


@query(
    f"""with f as ({_FILES}), g as (select *, lag(c) over (partition by path order by seq) as p, {_BODY} as body from f),
    v as (select *, (1 + sum(case when p <> c then 1 else 0 end) over (partition by path order by seq))::bigint as version, coalesce(p = c, false) as same from g),
    -- every function changes with the state, so a diff is longer than the text and only repeats become pointers
    n as (select *, case when same then '[FILEREF:' || path || '@v' || version || ' unchanged]' else body end as new from v)
    select path, seq, version, same as is_delta, new as new_content, {SAVED.format('body', 'new')} as saved from n"""
)
def file_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.file_deltas(store.file_versions(t.files(spark, sf_dir))).select("path", "seq", "version", "is_delta", "new_content", "saved")


@query()
def json_crush(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.json_texts(spark, sf_dir).select("o_custkey", jsoncrush.crusher()("text").alias("c")).select("o_custkey", "c.text", "c.saved")


@query()
def json_crush_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.json_texts(spark, sf_dir).select("o_custkey", F.concat(F.lit("see "), F.col("text"), F.lit(" there")).alias("text"))
    return rows.select("o_custkey", jsoncrush.embedded_crusher()("text").alias("c")).select("o_custkey", "c.text", "c.saved")


@query(
    """select o_custkey, case when 1.0 / count(*) < 0.30 then 1 else 3 end as knee, 2.0::double / (2 * count(*)) as leaf_density, 3 as levels from orders group by 1"""
)
def json_knee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of three levels of objects: the customer, its orders, and an object in each order."""
    o = t.table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", F.struct("o_orderstatus", "o_orderpriority").alias("inner")).alias("o"))
    rows = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o")).alias("orders"))
    rows = rows.select("o_custkey", jsoncrush.key_density(F.to_json(F.struct(F.col("o_custkey").alias("customer"), "orders"))).alias("d"))
    return rows.select("o_custkey", F.col("d.knee").alias("knee"), F.element_at("d.densities", -1).alias("leaf_density"), F.size("d.densities").alias("levels"))


_SKELETON = "chr(10) || repeat('def f_' || c || '(x):' || chr(10) || '    ...' || chr(10), 20) || 'STATE = ' || c || chr(10)"


@query(f"with f as ({_FILES}) select path, seq, {_SKELETON} as text, length({_SKELETON})::int as n_chars from f")
def code_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.files(spark, sf_dir)
    small = code.compact_code("content", "path")
    return rows.select("path", "seq", small.alias("text")).withColumn("n_chars", F.length("text"))


_BY_EXT = "case ext " + " ".join(f"when {quote(k)} then {quote(v)}" for k, v in code.LANGUAGES.items()) + " end"


@query(
    f"""with p as (select page_id, unnest([url, 'src/a.PY', 'b.tsx', '.go', 'x/y.unknown']) as path from pages), e as (select *, lower(regexp_extract(path, '[^/.](\\.[^./]*)$', 1)) as ext from p)
    select page_id, path, ext, {_BY_EXT} as language from e"""
)
def file_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = F.explode(F.array("url", *[F.lit(x) for x in ("src/a.PY", "b.tsx", ".go", "x/y.unknown")])).alias("path")
    rows = t.table(spark, sf_dir, "pages").select("page_id", paths)
    return rows.select("page_id", "path", F.lower(F.regexp_extract("path", r"[^/.](\.[^./]*)$", 1)).alias("ext"), code.language(F.col("path")).alias("language"))


@query(
    """with recursive n as (select count(*) as n from part), e as (select p_partkey as a, (p_partkey * 7 + 3) % n as b from part, n where p_size < 35),
    r as (select * from (values (1::bigint), (2::bigint), (3::bigint)) v(s) union select b from r join e on e.a = r.s) select s::varchar as symbol from r"""
)
def call_graph_reachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    focal = spark.createDataFrame([("1",), ("2",), ("3",)], "symbol string")
    return callgraph.reachable(t.calls(spark, sf_dir), focal)


@query()
def call_graph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = t.files(spark, sf_dir).groupBy("path").agg(F.max_by("content", "seq").alias("code"))
    symbols, _ = callgraph.index_files(files)
    return symbols


@query(
    f"""select doc_id, {TOK.format('text')} >= 500 as offloaded, case when {TOK.format('text')} >= 500 then '[CCR:' || {HASH.format('text')} || ' | ' || lang || ' | ~' || {TOK.format('text')} || ' tok]' else text end as new_content,
    (case when {TOK.format('text')} >= 500 then greatest(0, length(text) // 4 - length('[CCR:' || {HASH.format('text')} || ' | ' || lang || ' | ~' || {TOK.format('text')} || ' tok]') // 4) else 0 end)::bigint as saved from documents"""
)
def ccr_offload(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"), "lang")
    return store.offload(docs, 500, "lang").select("doc_id", "offloaded", "new_content", "saved")


@query(f"select {HASH.format('text')} as hash, arg_max(source, doc_id) as label, max(octet_length(encode(text)))::bigint as size_bytes from documents where {TOK.format('text')} >= 500 group by 1")
def ccr_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("content"), F.col("source").alias("label"))
    return store.store_entries(docs, 500).select("hash", "label", "size_bytes")


@query(
    f"""with s as (select distinct {HASH.format('text')} as hash, text from documents where {TOK.format('text')} >= 500)
    select doc_id, coalesce(s.text, '[CCR ERROR] No entry found for hash ''' || h || '''.') as resolved
    from (select doc_id, case when doc_id % 3 = 0 then '0000000000000000' else {HASH.format('text')} end as h from documents) d left join s on s.hash = d.h"""
)
def ccr_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents")
    entries = store.store_entries(docs.select(F.col("doc_id").alias("seq"), F.col("text").alias("content"), F.col("source").alias("label")), 500)
    h = F.when(F.col("doc_id") % 3 == 0, "0000000000000000").otherwise(content_hash(F.col("text")))
    asked = docs.select("doc_id", F.concat(F.lit("[CCR:"), h, F.lit(" | chunk | ~1 tok]")).alias("pointer"))
    return store.resolve(asked, entries).select("doc_id", "resolved")


_SAID = f"select doc_id, source, lang, text, {HASH.format('text')} as h from documents"


@query(f"with s as ({_SAID}) select lang as run_id, h as hash, arg_min(source, doc_id) as owner from s where length(text) >= 200 group by 1, 2")
def xcomp_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("source").alias("component_id"), F.col("lang").alias("run_id"), F.col("text").alias("content"))
    return store.first_writers(rows)


@query(
    f"""with s as ({_SAID}), o as (select lang, h, arg_min(source, doc_id) as owner from s where length(text) >= 200 group by 1, 2)
    select doc_id, coalesce(length(text) >= 200 and owner <> source, false) as is_cross,
    case when coalesce(length(text) >= 200 and owner <> source, false) then '[CCR:' || s.h || ' | xcomp:' || owner || ' | ~' || {TOK.format('text')} || ' tok]' else text end as new_content
    from s left join o on s.lang = o.lang and s.h = o.h and length(text) >= 200"""
)
def xcomp_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("seq"), F.col("source").alias("component_id"), F.col("lang").alias("run_id"), F.col("text").alias("content"))
    return store.cross_component(rows).select("doc_id", "is_cross", "new_content")


_TIER = "case when raw <= budget then 1 when budget is null or budget <= 0 then 5 " + " ".join(f"when raw::double * (1.0::double - {x[7]}::double) <= budget then {k}" for k, x in enumerate(budget.TIERS)) + " else 5 end"


@query(f"with r as (select conv_id, sum({TOK.format('text')})::bigint as raw, case when conv_id % 5 = 0 then null else conv_id * 13 % 400 end as budget from conversations group by 1) select conv_id as request_id, {_TIER} as tier from r")
def budget_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = t.messages(spark, sf_dir).groupBy("request_id").agg(F.sum(tokens(F.col("content"))).alias("raw_tokens"))
    asked = raw.withColumn("budget_tokens", F.when(F.col("request_id") % 5 != 0, F.col("request_id") * 13 % 400))
    return budget.plan(asked).select("request_id", "tier")


_JSON_CHARS = r"""(length({0}) + 2 + len(regexp_extract_all({0}, '["\\\n\r\t\x08\f]')) + 5 * len(regexp_extract_all({0}, '[\x00-\x07\x0b\x0e-\x1f\x7f-\x{{ffff}}]'))
    + 11 * len(regexp_extract_all({0}, '[\x{{10000}}-\x{{10ffff}}]')))"""


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests of the conversations, with two tools and a budget for four of five."""
    rows = t.messages(spark, sf_dir)
    own = F.array(*[F.struct(F.lit(n).alias("name"), F.lit('{"name": "' + n + '"}').alias("definition")) for n in ("zeta", "alpha")])
    asked = rows.select("request_id").distinct().withColumn("model", F.when(F.col("request_id") % 2 == 0, "claude-x").otherwise("gpt-x"))
    return asked.withColumn("tools", own).withColumn("budget_tokens", F.when(F.col("request_id") % 5 != 0, F.col("request_id") * 13 % 900).cast("long")), rows


# 27 characters of the payload's frame, the model in quotes, and ', "tools": []' with '{"name": "zeta"}' and '{"name": "alpha"}'
@query(
    f"""with c as (select conv_id, count(*)::bigint as n, sum(23 + {_JSON_CHARS.format("coalesce(role, '')")} + {_JSON_CHARS.format("coalesce(text, '')")}) as size from conversations group by 1),
    r as (select conv_id, n, greatest(1, (27 + case when conv_id % 2 = 0 then 10 else 7 end + size + 2 * (n - 1) + 13 + 16 + 17 + 2) // 4)::bigint as raw,
      case when conv_id % 5 <> 0 then conv_id * 13 % 900 end as budget from c),
    t as (select *, {_TIER} as tier from r)
    select conv_id as request_id, n as n_messages, raw as raw_tokens, case when coalesce(budget, 0) <> 0 then tier else -1 end as tier from t"""
)
def request_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload tokens and tier of whole requests."""
    rows = requests.plan_requests(requests.raw_tokens(*_requests(spark, sf_dir)), EngineConfig())
    return rows.select("request_id", "n_messages", "raw_tokens", "tier")


@query(
    """with r as (select conv_id, turn, role, text, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn) as rn,
      sum((role <> 'system')::int) over (partition by conv_id) as turns from conversations)
    select conv_id as request_id, min(n)::bigint as n_messages, max(case when conv_id % 2 = 0 and rn = n - least(3, turns) then turn end) as hint_idx, 'alpha,zeta' as tools from r group by 1"""
)
def request_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cache hints and tools of assembled requests that store nothing."""
    _, done = requests.reduce_requests(*_requests(spark, sf_dir), EngineConfig(offload=False, cross_component=False))
    return done.select("request_id", "n_messages", "hint_idx", F.array_join(F.transform("tools", lambda x: x["name"]), ",").alias("tools"))


@query()
def request_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole requests by their budgets: tier, tokens before and after, savings by stage, the retrieval tool last where texts were stored."""
    _, done = requests.reduce_requests(*_requests(spark, sf_dir), EngineConfig(offload_tokens=400))
    return done.withColumn("tools", F.array_join(F.transform("tools", lambda x: x["name"]), ","))


@query(
    f"""with s as (select distinct {HASH.format('text')} as hash, text from documents where {TOK.format('text')} >= 500)
    select doc_id as response_id, case when doc_id % 4 = 0 then 1 else 2 end as blocks,
    case when doc_id % 4 <> 0 then coalesce(s.text, '[CCR ERROR] No entry found for hash ' || chr(39) || h || chr(39) || '.') end as answer
    from (select doc_id, {HASH.format('text')} as h from documents) d left join s on s.hash = d.h"""
)
def tool_calls_answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents")
    entries = store.store_entries(docs.select(F.col("doc_id").alias("seq"), F.col("text").alias("content"), F.col("source").alias("label")), 500)
    none = F.lit(None).cast("string")
    call = F.when(F.col("doc_id") % 4 == 0, "other").otherwise(requests.TOOL)
    block = F.struct(F.lit("tool_use").alias("type"), F.lit("t1").alias("id"), call.alias("name"), content_hash(F.col("text")).alias("hash"), none.alias("tool_use_id"), none.alias("content"))
    out = store.answer_tool_calls(docs.select(F.col("doc_id").alias("response_id"), F.array(block).alias("content")), entries, requests.TOOL)
    return out.select("response_id", F.size("content").alias("blocks"), F.when(F.size("content") > 1, F.element_at("content", -1)["content"]).alias("answer"))


@query("select conv_id as request_id, count(*) as n_messages, greatest(0, count(*) - least(3, count(*) filter (where role <> 'system')))::bigint as boundary from conversations group by 1")
def cache_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.cache_boundary(t.messages(spark, sf_dir))


@query(
    """select conv_id as request_id, turn as msg_idx, (conv_id % 2 = 0 and b > 0 and rn = b) as cache_hint from (select conv_id, turn, row_number() over (partition by conv_id order by turn) as rn,
    greatest(0, count(*) over (partition by conv_id) - least(3, sum(case when role <> 'system' then 1 else 0 end) over (partition by conv_id))) as b from conversations)"""
)
def cache_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.messages(spark, sf_dir)
    model = F.when(F.col("request_id") % 2 == 0, "claude-x").otherwise("gpt-x")
    return m.cache_hints(rows, store.provider(model)).select("request_id", "msg_idx", "cache_hint")


@query("select n_regionkey, string_agg(n_name, ',' order by n_name, n_nationkey) as names from nation group by 1")
def tools_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", F.col("n_name").alias("name")))).alias("tools"))
    return rows.select("n_regionkey", F.array_join(F.transform(m.sort_tools(F.col("tools")), lambda x: x["name"]), ",").alias("names"))


@query(
    """select page_id, case page_id % 3 when 0 then 'anthropic' when 1 then 'openai' else 'generic' end as provider,
    case page_id % 3 when 0 then 'openai' when 1 then 'openrouter' else 'anthropic' end as upstream, '/v1/' || page_id as tail from pages"""
)
def provider_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    tail = F.concat(F.lit("/v1/"), F.col("page_id").cast("string"))
    model = F.when(k == 0, "Claude-3").when(k == 1, "GPT-4").otherwise("llama")
    path = F.concat(F.when(k == 0, "/openai").when(k == 1, "/openrouter").otherwise(""), tail)
    return t.table(spark, sf_dir, "pages").select("page_id", store.provider(model).alias("provider"), store.route(path).alias("r")).select("page_id", "provider", "r.upstream", "r.tail")


_METRICS = """m as (select event_id as id, ts, (event_id * 37) % 5000 + 100 as raw_tokens, (event_id * 37) % 5000 + 100 - ((event_id * 37) % 5000 + 100) * (event_id % 70) // 100 as compressed_tokens,
    event_id % 250 as latency_ms, event_id % 900 as upstream_ms, event_id % 5 = 0 as cache_hit, event_id % 11 = 0 as offloaded, props as breakdown, case when event_id % 4 = 0 then '' else event_type end as component_id from events)"""
_BP = "(case when sum(raw_tokens) > 0 then (sum(raw_tokens) - sum(compressed_tokens)) * 10000 // sum(raw_tokens) else 0 end)::bigint"


@query(
    f"""with {_METRICS} select count(*) as requests, sum(raw_tokens)::bigint as raw_tokens, sum(compressed_tokens)::bigint as compressed_tokens, round(avg(latency_ms), 2) as avg_latency_ms, round(avg(upstream_ms), 2) as avg_upstream_ms,
    sum(cache_hit::int)::bigint as cache_hits, sum(offloaded::int)::bigint as offloads, (sum(raw_tokens) - sum(compressed_tokens))::bigint as saved_tokens, {_BP} as saved_bp from m"""
)
def dash_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary(t.metrics(spark, sf_dir))


@query(
    f"""with {_METRICS}, e as (select count(distinct {HASH.format('text')}) as entries from documents where {TOK.format('text')} >= 500)
    select count(*) as requests, sum(raw_tokens)::bigint as raw_tokens, (sum(raw_tokens) - sum(compressed_tokens))::bigint as saved_tokens, {_BP} as saved_bp, any_value(entries) as entries from m, e"""
)
def dash_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("text").alias("content"), F.col("source").alias("label"))
    return reports.status(t.metrics(spark, sf_dir), store.store_entries(docs, 500))


@query(
    """with a as (select key as algorithm, sum(json_extract(props, '$.' || key)::bigint)::bigint as saved from (select props, unnest(json_keys(props)) as key from events) group by 1)
    select algorithm, saved, (saved * 10000 // greatest(1, sum(saved) over ()))::bigint as share_bp from a"""
)
def dash_algorithm_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.algorithm_share(reports.by_algorithm(t.metrics(spark, sf_dir)))


@query(f"with {_METRICS} select id, ts, raw_tokens, compressed_tokens from m order by ts desc, id desc limit 50")
def dash_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.timeline(t.metrics(spark, sf_dir))


@query("select key as algorithm, sum(json_extract(props, '$.' || key)::bigint)::bigint as saved from (select props, unnest(json_keys(props)) as key from events) group by 1")
def dash_algorithms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_algorithm(t.metrics(spark, sf_dir))


@query(
    f"""with {_METRICS} select component_id, count(*) as requests, sum(raw_tokens)::bigint as raw_tokens, sum(compressed_tokens)::bigint as compressed_tokens,
    (sum(raw_tokens) - sum(compressed_tokens))::bigint as saved_tokens, {_BP} as saved_bp from m where component_id <> '' group by 1"""
)
def dash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_component(t.metrics(spark, sf_dir))


@query()
def lexical_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.messages(spark, sf_dir).withColumn("before", F.lag("content").over(m.within()))
    return rows.where("before is not null").select("request_id", "msg_idx", code.lexical_similarity("before", "content").alias("similarity"))


@query()
def pipeline_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.request_metrics(pipeline.reduce_messages(t.messages(spark, sf_dir)))


@query()
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.eval_report(pipeline.eval_cases(pipeline.reduce_messages(t.messages(spark, sf_dir))))


@query()
def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.metrics import hourly

    return hourly(t.metrics(spark, sf_dir))


ORACLES["stream_metrics"] = (
    f"with {_METRICS} select component_id, date_trunc('hour', ts) as hour, count(*) as requests, sum(raw_tokens)::bigint as raw_tokens, "
    "(sum(raw_tokens) - sum(compressed_tokens))::bigint as saved_tokens from m group by 1, 2"
)
