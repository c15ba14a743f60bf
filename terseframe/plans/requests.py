"""Whole requests: tokens of the payload, the plan of a budget, the reduction of messages, cache hint and retrieval tool."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import json_string_length
from ..operators import budget, reports, store
from ..operators import messages as m
from .pipeline import BREAKDOWN, reduce_messages

TOOL = "stored_text"
TOOL_DEFINITION = json.dumps(
    {
        "name": TOOL,
        "description": "Returns the whole text behind a [CCR:...] pointer.",
        "input_schema": {"type": "object", "properties": {"hash": {"type": "string", "description": "The hash in the pointer."}}, "required": ["hash"]},
    }
)
_MESSAGE = len('{"role": , "content": }')
_HINT = len('[{"type": "text", "text": , "cache_control": {"type": "ephemeral"}}]')


def message_chars(role: Column, content: Column, hinted: Column | None = None) -> Column:
    """Characters of a message in the payload's JSON; a hinted one is a block with a cache mark."""
    size = _MESSAGE + json_string_length(F.coalesce(role, F.lit(""))) + json_string_length(F.coalesce(content, F.lit("")))
    return size if hinted is None else size + F.when(hinted, _HINT).otherwise(0)


def payload_tokens(chars: Column, messages: Column, model: Column, tools: Column) -> Column:
    """A quarter of the payload's characters: {"model": ..., "messages": [...], "tools": [...]}, without tools if there are none."""
    listed = F.when(F.size(tools) > 0, len(', "tools": []') + F.aggregate(tools, F.lit(0), lambda s, t: s + F.length(t["definition"])) + 2 * (F.size(tools) - 1)).otherwise(0)
    size = len('{"model": , "messages": []}') + json_string_length(F.coalesce(model, F.lit(""))) + chars + 2 * F.greatest(messages - 1, F.lit(0)) + listed
    return F.greatest(F.lit(1), F.floor(size / 4)).cast("long")


def raw_tokens(requests: DataFrame, messages: DataFrame) -> DataFrame:
    """``requests`` (request_id, model, tools array<struct<name, definition>>) with n_messages and raw_tokens; one without messages has 0 of them."""
    sums = messages.groupBy("request_id").agg(F.count("*").alias("n_messages"), F.sum(message_chars(F.col("role"), F.col("content"))).alias("_chars"))
    rows = requests.join(sums, "request_id", "left").withColumn("n_messages", F.coalesce("n_messages", F.lit(0)).cast("long"))
    return rows.withColumn("raw_tokens", payload_tokens(F.coalesce("_chars", F.lit(0)), F.col("n_messages"), F.col("model"), F.col("tools"))).drop("_chars")


def plan_requests(requests: DataFrame, config: EngineConfig) -> DataFrame:
    """Requests (raw_tokens, budget_tokens) with their tier, -1 without a budget, and the plan's stages, null without one."""
    planned = budget.plan(requests, config.offload_tokens)
    has = F.coalesce(F.col("budget_tokens"), F.lit(0)) != 0
    plan = F.when(has, F.struct(*[F.col(c) for c in budget.COLUMNS]))
    return planned.select(*requests.columns, F.when(has, F.col("tier")).otherwise(-1).alias("tier"), plan.alias("plan"))


def reduce_requests(requests: DataFrame, messages: DataFrame, config: EngineConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Reduced messages and one row a request: tier, tokens before and after, savings by stage, tools, whether texts were stored.

    ``requests``: request_id, model, tools, budget_tokens. The plan follows the raw tokens, then messages are reduced, the
    message before the cached part's end is marked, tools are sorted, and the retrieval tool comes last, once, if anything was stored.
    """
    config = config or EngineConfig()
    planned = plan_requests(raw_tokens(requests, messages), config)
    reduced = reduce_messages(messages.join(planned.select("request_id", "plan"), "request_id"), config)
    provider = store.provider(F.col("model"))
    marked = reduced.join(planned.select("request_id", "model"), "request_id")
    marked = m.cache_hints(marked, provider, config.cache_tail) if config.cache_align else marked.withColumn("cache_hint", F.lit(False))
    sums = marked.groupBy("request_id").agg(
        F.sum(message_chars(F.col("role"), F.col("content"), F.col("cache_hint"))).alias("_chars"), F.bool_or("stored_any").alias("stored_any"),
        F.max(F.when(F.col("cache_hint"), F.col("msg_idx"))).alias("hint_idx"), *[F.sum(f"s_{n}").alias(n) for n in BREAKDOWN],
    )
    out = planned.join(sums, "request_id", "left").withColumn("stored_any", F.coalesce("stored_any", F.lit(False)))
    none = F.array().cast("array<struct<name:string,definition:string>>")
    tools = m.sort_tools(F.coalesce("tools", none)) if config.cache_align else F.coalesce("tools", none)
    out = out.withColumn("tools", store.inject_tool(tools, F.col("stored_any") & F.lit(config.offload), TOOL, TOOL_DEFINITION))
    out = out.withColumn("compressed_tokens", payload_tokens(F.coalesce("_chars", F.lit(0)), F.col("n_messages"), F.col("model"), F.col("tools")))
    saved = F.col("raw_tokens") - F.col("compressed_tokens")
    out = out.withColumn("saved_tokens", saved).withColumn("saved_bp", reports.basis_points(saved, F.col("raw_tokens")))
    return marked.drop("model", "plan"), out.drop("_chars", "plan").fillna(0, list(BREAKDOWN))


def metrics_rows(done: DataFrame) -> DataFrame:
    """Rows for the metrics table of reduced requests; a stage that saved nothing is not in the breakdown."""
    pairs = F.filter(F.array(*[F.struct(F.lit(n).alias("k"), F.col(n).alias("v")) for n in BREAKDOWN[1:]]), lambda x: x["v"] > 0)
    return done.select(
        F.col("request_id").cast("string").alias("request_id"), F.unix_timestamp().cast("double").alias("ts"), "raw_tokens", "compressed_tokens",
        F.to_json(F.map_from_entries(pairs)).alias("breakdown"), F.col("stored_any").alias("offloaded"), F.col("tier").alias("budget_tier"),
    )
