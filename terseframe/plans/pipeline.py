"""The whole reduction of requests: masks, near copies, ageing, then each message by its kind, then offload."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import masks, prose, shell
from ..functions.classify import blocks_of, kind
from ..functions.code import compact, file_hint
from ..functions.jsoncrush import crush, crush_embedded, saved
from ..functions.lazy import arrow
from ..functions.text import saved_by, tokens
from ..operators import messages as m
from ..operators import store

BREAKDOWN = ("masked", "near_dup", "decay", "cross_component", "file_versions", "code", "json", "shell", "prose", "offload")


def _mixed(config: EngineConfig):
    """Each block of a mixed message by its own kind: (kind, text, code saved, json saved) in order."""

    @arrow("array<struct<kind:string,text:string,code:bigint,json:bigint>>")
    def run(texts: pd.Series, sorts: pd.Series, codes: pd.Series, jsons: pd.Series) -> pd.Series:
        def one(text: str | None, sort: str | None, use_code: bool, use_json: bool) -> list[dict] | None:
            if text is None or sort is None:
                return None
            out = []
            for k, t, _ in blocks_of(text) if sort == "mixed" else [(sort, text, None)]:
                c = j = 0
                if k == "code" and use_code:
                    new = compact(t, None)
                    c = saved(t, new)
                    t = new if c else t
                if use_json:
                    new, j = (crush(t, config.json_depth), 0) if k == "json_data" else crush_embedded(t, config.json_depth)
                    j = saved(t, new) if k == "json_data" else j
                    t = new if j else t
                out.append({"kind": k, "text": t, "code": c, "json": j})
            return out

        return pd.Series([one(*x) for x in zip(texts, sorts, codes, jsons, strict=True)])

    return run


def reduce_messages(messages: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Messages (request_id, request_seq, msg_idx, role, content[, component_id, run_id, plan]) with new content and savings by stage.

    State across requests (file versions, ledger of a run) follows (request_seq, msg_idx). ``plan`` is a struct of a request's
    stages by its budget, null without a budget: a stage runs where both the settings and the plan have it.
    """
    config = config or EngineConfig()
    for c in ("component_id", "run_id"):
        if c not in messages.columns:
            messages = messages.withColumn(c, F.lit(""))
    planned = "plan" in messages.columns

    def allowed(stage: str):
        own = F.lit(getattr(config, stage))
        return own & F.coalesce(F.col("plan")[stage], F.lit(True)) if planned else own

    rows = messages.withColumn("original", F.coalesce("content", F.lit(""))).withColumn("content", F.col("original"))
    rows = rows.withColumn("seq", F.struct("request_seq", "msg_idx"))
    zero = F.lit(0).cast("long")
    if config.scrub:
        rows = rows.withColumn("_m", masks.scrub("content")).withColumn("content", F.col("_m.text")).withColumn("hits", F.col("_m.hits")).drop("_m")
        rows = rows.withColumn("s_masked", F.aggregate(F.map_values("hits"), zero, lambda a, x: a + x))
    if config.near_dup:
        rows = m.near_dup_turns(rows, config.near_dup_threshold, config.near_dup_window, config.near_dup_least_chars).drop("ref_idx", "same_bits")
        rows = rows.withColumn("new_content", F.when(allowed("near_dup"), F.col("new_content")).otherwise(F.col("content")))
        rows = rows.withColumn("s_near_dup", F.when(F.col("is_dup"), saved_by(F.col("content"), F.col("new_content"))).otherwise(zero)).withColumn("content", F.col("new_content")).drop("new_content", "is_dup")
    if config.decay:
        rows = m.decay(rows, config.recent_turns, config.partial_turns, config.most_keywords)
        rows = rows.withColumn("s_decay", F.when(allowed("decay"), F.col("saved")).otherwise(zero)).withColumn("content", F.when(allowed("decay"), F.col("new_content")).otherwise(F.col("content")))
        rows = rows.drop("new_content", "age", "zone", "saved")
    rows = rows.withColumn("kind", kind(F.col("content")))
    if config.cross_component:
        rows = store.cross_component(rows, "seq", config.cross_least_chars).withColumnRenamed("saved", "s_cross_component").withColumn("content", F.col("new_content")).drop("new_content", "owner")
    else:
        rows = rows.withColumn("is_cross", F.lit(False))
    if config.file_versions:
        # one window for all rows: those without a path are partitions of their own, and nothing before it runs twice
        rows = rows.withColumn("path", F.when((F.col("kind") == "code") & ~F.col("is_cross") & allowed("code"), file_hint(F.col("content"))))
        rows = store.file_deltas(store.file_versions(rows, "seq"), config.delta_ratio)
        rows = rows.withColumn("content", F.col("new_content")).withColumn("s_file_versions", F.when(F.col("is_delta"), F.col("saved")).otherwise(zero))
        rows = rows.drop("new_content", "saved", "version", "unchanged", "path")
    else:
        rows = rows.withColumn("is_delta", F.lit(False))
    asked = F.when(~F.col("is_cross") & ~F.col("is_delta"), F.col("kind"))
    rows = rows.withColumn("_blocks", _mixed(config)("content", asked, allowed("code"), allowed("json")))

    def finish(b):
        use_shell = (b["kind"] == "shell_output") & allowed("shell")
        use_prose = (b["kind"] == "conversation") & allowed("prose")
        tried = F.when(use_shell, shell.minify_shell(b["text"], config.most_lines, config.group_ratio)).when(use_prose, prose.minify(b["text"])).otherwise(b["text"])

        def kept(new):
            gain = saved_by(b["text"], new)
            return F.struct(
                F.when(gain > 0, new).otherwise(b["text"]).alias("text"), b["code"].alias("code"), b["json"].alias("json"),
                F.when(use_shell, gain).otherwise(zero).alias("shell"), F.when(use_prose, gain).otherwise(zero).alias("prose"),
            )

        # bound once: in a lambda every mention of an expression would compute it again
        return F.transform(F.array(tried), kept)[0]

    rows = rows.withColumn("_done", F.transform("_blocks", finish)).drop("_blocks")
    rows = rows.withColumn("content", F.when(F.col("_done").isNotNull(), F.array_join("_done.text", "")).otherwise(F.col("content")))
    for name in ("code", "json", "shell", "prose"):
        rows = rows.withColumn(f"s_{name}", F.coalesce(F.aggregate(F.col(f"_done.{name}"), zero, lambda a, x: a + x), zero))
    rows = rows.drop("_done")
    if config.offload:
        least = F.coalesce(F.col("plan.offload_tokens"), F.lit(config.offload_tokens)) if planned else F.lit(config.offload_tokens)
        kept = ~F.col("is_cross") & (tokens(F.col("content")) >= least)
        ptr = store.pointer(F.col("content"), F.col("kind"))
        quarter = lambda c: F.floor(F.length(c) / 4)
        rows = rows.withColumn("s_offload", F.when(kept, F.greatest(zero, quarter(F.col("content")) - quarter(ptr))).otherwise(zero)).withColumn("offloaded", kept)
        rows = rows.withColumn("stored", F.when(kept, F.col("content"))).withColumn("content", F.when(kept, ptr).otherwise(F.col("content")))
    for name in BREAKDOWN:
        if f"s_{name}" not in rows.columns:
            rows = rows.withColumn(f"s_{name}", zero)
    return rows.withColumn("stored_any", F.col("is_cross") | (F.col("offloaded") if config.offload else F.lit(False))).drop("seq", "is_cross", "is_delta")


def request_metrics(reduced: DataFrame) -> DataFrame:
    """One row a request: characters before and after, savings of each stage."""
    sums = [F.sum(f"s_{n}").alias(n) for n in BREAKDOWN]
    return reduced.groupBy("request_id").agg(F.count("*").alias("messages"), F.sum(F.length("original")).alias("raw_chars"), F.sum(F.length("content")).alias("compressed_chars"), *sums)


def eval_cases(reduced: DataFrame) -> DataFrame:
    """One row a message: tokens before and after, likeness of both texts; a failing case keeps its error and counts nothing."""

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for before, after in zip(f["original"], f["content"], strict=True):
                try:
                    like = difflib.SequenceMatcher(None, before, after).ratio() if before or after else 1.0
                    rows.append((max(1, len(before) * 2 // 7), max(1, len(after) * 2 // 7), like, None))
                except Exception as e:  # noqa: BLE001  the report counts failing cases
                    rows.append((0, 0, 0.0, str(e)))
            yield pd.DataFrame(rows, columns=["raw_tokens", "compressed_tokens", "similarity", "error"])

    return reduced.select("original", "content").mapInPandas(compare, "raw_tokens long, compressed_tokens long, similarity double, error string")
