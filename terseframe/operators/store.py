"""Content-addressed store, file versions, cross-component ledger and routing across requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import unified_diff
from ..functions.text import content_hash, saved_by, tokens

POINTER = r"^\[CCR:([0-9a-f]{16})\s*\|[^\]]+\]$"
MISSING = "[CCR ERROR] No entry found for hash '"


def pointer(text: Column, label: Column) -> Column:
    named = F.when(F.coalesce(label, F.lit("")) == "", "chunk").otherwise(label)
    return F.concat(F.lit("[CCR:"), content_hash(text), F.lit(" | "), named, F.lit(" | ~"), tokens(text).cast("string"), F.lit(" tok]"))


def offload(rows: DataFrame, least: int = 2000, label: str = "label") -> DataFrame:
    """Adds offloaded, hash, new_content and the saving, counted as whole quarters of both lengths."""
    big = tokens(F.col("content")) >= least
    out = rows.withColumn("offloaded", big).withColumn("hash", F.when(big, content_hash(F.col("content"))))
    out = out.withColumn("new_content", F.when(big, pointer(F.col("content"), F.col(label))).otherwise(F.col("content")))
    quarter = lambda c: F.floor(F.length(c) / 4)
    return out.withColumn("saved", F.when(big, F.greatest(F.lit(0), quarter("content") - quarter("new_content"))).otherwise(0).cast("long"))


def store_entries(rows: DataFrame, least: int = 2000, order: str = "seq", label: str = "label") -> DataFrame:
    """The store after all rows in order: one entry a hash, with the last label; partial aggregation before the shuffle."""
    kept = rows.where(tokens(F.col("content")) >= least).select(content_hash(F.col("content")).alias("hash"), "content", F.col(label).alias("label"), F.col(order).alias("seq"))
    return kept.groupBy("hash").agg(F.max_by("content", "seq").alias("content"), F.max_by("label", "seq").alias("label")).withColumn("size_bytes", F.octet_length("content").cast("long"))


def resolve(pointers: DataFrame, entries: DataFrame) -> DataFrame:
    """Content behind a pointer or a bare hash, or the error text."""
    asked = pointers.withColumn("hash", F.regexp_extract(F.trim("pointer"), POINTER, 1))
    found = asked.join(entries.select("hash", F.col("content").alias("_found")), "hash", "left")
    return found.withColumn("resolved", F.coalesce("_found", F.concat(F.lit(MISSING), F.col("hash"), F.lit("'.")))).drop("_found")


def file_versions(files: DataFrame, order: str = "seq") -> DataFrame:
    """Adds version, previous version's content and whether a row repeats the latest; rows of a path in order.

    A repeat stores nothing, so the latest version is always the row before. Rows without a path have no versions
    (version 1, no previous one) and are kept apart from each other.
    """
    alone = F.when(F.col("path").isNull(), F.xxhash64(order))
    chain = Window.partitionBy("path", alone).orderBy(order)
    rows = files.withColumn("_hash", content_hash(F.col("content")))
    changed = F.coalesce((F.col("_hash") != F.lag("_hash").over(chain)).cast("int"), F.lit(0))
    rows = rows.withColumn("_changed", changed).withColumn("previous", F.when(F.col("path").isNotNull(), F.lag("content").over(chain))).withColumn("_first", F.row_number().over(chain) == 1)
    rows = rows.withColumn("version", (1 + F.sum("_changed").over(chain)).cast("long"))
    return rows.withColumn("unchanged", F.col("path").isNotNull() & ~F.col("_first") & (F.col("_changed") == 0)).drop("_hash", "_changed", "_first")


def file_deltas(versions: DataFrame, ratio: float = 0.6) -> DataFrame:
    """Adds new_content, is_delta and saved: a pointer for a repeat, a diff where it is short enough, else the text."""
    name = lambda v: F.concat(F.col("path"), F.lit("@v"), v.cast("string"))
    older = F.when(F.col("unchanged"), F.col("version")).otherwise(F.col("version") - 1)
    need = F.when(~F.col("unchanged") & F.col("previous").isNotNull(), F.col("previous"))
    rows = versions.withColumn("_diff", unified_diff(need, F.col("content"), name(older), name(F.col("version"))))
    short = (F.col("_diff") != "") & (F.length("_diff") < F.length("content") * F.lit(ratio))
    repeat = F.concat(F.lit("[FILEREF:"), name(F.col("version")), F.lit(" unchanged]"))
    delta = F.concat(F.lit("[FILEDIFF:"), name(older), F.lit("->v"), F.col("version").cast("string"), F.lit("]\n"), F.col("_diff"))
    rows = rows.withColumn("is_delta", F.coalesce(F.col("unchanged") | short, F.lit(False)))
    rows = rows.withColumn("new_content", F.when(F.col("unchanged"), repeat).when(F.coalesce(short, F.lit(False)), delta).otherwise(F.col("content")))
    return rows.withColumn("saved", saved_by(F.col("content"), F.col("new_content"))).drop("_diff", "previous")


def first_writers(rows: DataFrame, order: str = "seq", least: int = 200) -> DataFrame:
    """(run_id, hash, owner): who said a long text first in a run; aggregated before the shuffle, so popular texts are no hot key."""
    said = rows.where((F.length("content") >= least) & (F.coalesce("run_id", F.lit("")) != "") & (F.coalesce("component_id", F.lit("")) != ""))
    return said.groupBy("run_id", content_hash(F.col("content")).alias("hash")).agg(F.min_by("component_id", order).alias("owner"))


def cross_component(rows: DataFrame, order: str = "seq", least: int = 200) -> DataFrame:
    """Adds owner, is_cross and new_content: texts that another component of the run said before become pointers."""
    owners = first_writers(rows, order, least).withColumnRenamed("hash", "_hash").withColumnRenamed("run_id", "_run")
    keyed = rows.withColumn("_own", F.when(F.length("content") >= least, content_hash(F.col("content"))))
    out = keyed.join(owners, (F.col("_own") == F.col("_hash")) & (F.col("run_id") == F.col("_run")), "left")
    cross = F.coalesce((F.col("owner") != F.col("component_id")) & (F.coalesce("component_id", F.lit("")) != ""), F.lit(False))
    out = out.withColumn("is_cross", cross).withColumn("new_content", F.when(cross, pointer(F.col("content"), F.concat(F.lit("xcomp:"), F.col("owner")))).otherwise(F.col("content")))
    return out.withColumn("saved", saved_by(F.col("content"), F.col("new_content"))).drop("_own", "_hash", "_run")


def provider(model: Column) -> Column:
    low = F.lower(model)
    return F.when(F.contains(low, F.lit("claude")), "anthropic").when(F.contains(low, F.lit("gpt")) | F.contains(low, F.lit("o1")), "openai").otherwise("generic")


def route(path: Column) -> Column:
    """(upstream, tail) of a request path."""
    for_prefix = lambda p: F.struct(F.lit(p).alias("upstream"), F.substr(path, F.lit(len(p) + 2)).alias("tail"))
    return F.when(path.startswith("/openai"), for_prefix("openai")).when(path.startswith("/openrouter"), for_prefix("openrouter")).otherwise(F.struct(F.lit("anthropic").alias("upstream"), path.alias("tail")))


def request_meta(headers: Column, body: Column, prefix: str) -> Column:
    """(component_id, run_id, budget_tokens): headers ``prefix``component, -run and -budget, in any case, win over the body's fields.

    Empty headers count as none, and a budget that is no number is none.
    """
    lower = F.map_from_entries(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    take = lambda h, b: F.coalesce(F.nullif(F.try_element_at(lower, F.lit(prefix.lower() + h)), F.lit("")), body[b].cast("string"))
    return F.struct(take("component", "component_id").alias("component_id"), take("run", "run_id").alias("run_id"), take("budget", "budget_tokens").try_cast("int").alias("budget_tokens"))


def answer_tool_calls(responses: DataFrame, entries: DataFrame, tool: str) -> DataFrame:
    """Responses (response_id, content) with a result block appended for every call of ``tool``, in the order of the calls.

    ``content`` is an array of structs (type, id, name, hash, tool_use_id, content); a response without such a call stays as
    it is, and an unknown hash gets the error text. A response's few blocks are collected in one row.
    """
    block = responses.schema["content"].dataType.elementType
    calls = responses.select("response_id", F.posexplode("content").alias("_at", "b")).where((F.col("b.type") == "tool_use") & (F.col("b.name") == tool))
    asked = calls.select("response_id", "_at", F.coalesce("b.id", F.lit("")).alias("_id"), F.coalesce("b.hash", F.lit("")).alias("hash"))
    found = asked.join(entries.select("hash", F.col("content").alias("_found")), "hash", "left")
    said = F.coalesce("_found", F.concat(F.lit(MISSING), F.col("hash"), F.lit("'.")))
    values = {"type": F.lit("tool_result"), "tool_use_id": F.col("_id"), "content": said}
    result = F.struct(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in block.fields])
    results = found.groupBy("response_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", result.alias("b")))), lambda x: x["b"]).alias("_results"))
    out = responses.join(results, "response_id", "left")
    return out.withColumn("content", F.when(F.col("_results").isNull(), F.col("content")).otherwise(F.concat("content", "_results"))).drop("_results")


def inject_tool(tools: Column, used: Column, name: str, definition: str) -> Column:
    """Tools, an array of structs (name, definition), with the retrieval tool last, once, where something was stored."""
    there = F.exists(F.coalesce(tools, F.array().cast("array<struct<name:string,definition:string>>")), lambda x: x["name"] == name)
    added = F.array(F.struct(F.lit(name).alias("name"), F.lit(definition).alias("definition")))
    own = F.coalesce(tools, F.array().cast("array<struct<name:string,definition:string>>"))
    return F.when(used & ~there, F.concat(own, added)).otherwise(own)


# Headers that are not passed on with a request, or back with a response.
NOT_FORWARDED = ("host", "content-length", "transfer-encoding")
NOT_RETURNED = ("transfer-encoding", "content-encoding")


def forward_headers(headers: Column, prefix: str) -> Column:
    """Headers of a request as they are passed on: without those of the connection and the ``prefix`` fields read here."""
    gone = (*NOT_FORWARDED, *(prefix.lower() + x for x in ("component", "run", "budget")))
    return F.map_concat(F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*gone, "content-type")), F.create_map(F.lit("content-type"), F.lit("application/json")))


def return_headers(headers: Column, prefix: str, saved: Column, percent: Column, component: Column, tier: Column) -> Column:
    """Headers of a response as they are passed back, with what was saved."""
    none = F.create_map().cast("map<string,string>")
    added = [
        F.create_map(F.lit(prefix + "tokens-saved"), saved.cast("string"), F.lit(prefix + "compression-pct"), F.format_string("%.1f", percent)),
        F.when(F.coalesce(component, F.lit("")) != "", F.create_map(F.lit(prefix + "component"), component)).otherwise(none),
        F.when(tier >= 0, F.create_map(F.lit(prefix + "budget-tier"), tier.cast("string"))).otherwise(none),
    ]
    return F.map_concat(F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*NOT_RETURNED) & ~F.lower(k).startswith(prefix.lower())), *added)


def cache_hit(headers: Column) -> Column:
    """Whether a response's headers tell of a cache."""
    return F.map_contains_key(headers, "anthropic-cache-creation-input-tokens") | F.coalesce(F.try_element_at(headers, F.lit("x-cache")) == "HIT", F.lit(False))
