"""Metrics and ledgers over streams of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash


def hourly(metrics: DataFrame, late: str = "2 hours") -> DataFrame:
    """Requests and savings by component and hour; on a stream, rows later than ``late`` are past their window."""
    if metrics.isStreaming:
        metrics = metrics.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = metrics.groupBy("component_id", F.window("ts", "1 hour").alias("w")).agg(
        F.count("*").alias("requests"), F.sum("raw_tokens").alias("raw_tokens"), F.sum(F.col("raw_tokens") - F.col("compressed_tokens")).alias("saved_tokens")
    )
    return out.select("component_id", F.col("w.start").alias("hour"), "requests", "raw_tokens", "saved_tokens")


def first_writers(messages: DataFrame, least: int = 200) -> DataFrame:
    """Streamed ledger: for each (run_id, hash) the component that said a long text first, in order of ``seq`` within a batch.

    The state of a key is one name; it is kept for ever, as the batch ledger is.
    """

    def one(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        owner = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("seq")
        if owner is None:
            owner = rows["component_id"].iloc[0]
            state.update((owner,))
        out = rows[["seq", "component_id"]].copy()
        out["run_id"], out["hash"], out["owner"] = key[0], key[1], owner
        yield out[["run_id", "hash", "seq", "component_id", "owner"]]

    said = messages.where((F.length("content") >= least) & (F.coalesce("run_id", F.lit("")) != "") & (F.coalesce("component_id", F.lit("")) != ""))
    keyed = said.select("run_id", content_hash(F.col("content")).alias("hash"), "seq", "component_id").groupBy("run_id", "hash")
    return keyed.applyInPandasWithState(one, "run_id string, hash string, seq long, component_id string, owner string", "owner string", "append", "NoTimeout")
