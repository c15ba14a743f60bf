"""Reports over the metrics table (request_id, ts, raw_tokens, compressed_tokens, latencies, flags, breakdown, tags)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def basis_points(saved, raw):
    """Share of tokens saved in hundredths of a percent, whole, 0 without tokens."""
    return F.when(raw > 0, F.floor(saved * 10000 / raw)).otherwise(0).cast("long")


def summary(metrics: DataFrame) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = metrics.agg(
        F.count("*").alias("requests"), total("raw_tokens").alias("raw_tokens"), total("compressed_tokens").alias("compressed_tokens"),
        F.coalesce(F.round(F.avg("latency_ms"), 2), F.lit(0.0)).alias("avg_latency_ms"), F.coalesce(F.round(F.avg("upstream_ms"), 2), F.lit(0.0)).alias("avg_upstream_ms"), total(F.col("cache_hit").cast("int")).alias("cache_hits"), total(F.col("offloaded").cast("int")).alias("offloads"),
    )
    saved = F.col("raw_tokens") - F.col("compressed_tokens")
    return out.withColumn("saved_tokens", saved).withColumn("saved_bp", basis_points(saved, F.col("raw_tokens")))


def timeline(metrics: DataFrame, last: int = 50) -> DataFrame:
    """The newest requests, oldest first."""
    return metrics.select("id", "ts", "raw_tokens", "compressed_tokens").orderBy(F.desc("ts"), F.desc("id")).limit(last).orderBy("ts", "id")


def by_algorithm(metrics: DataFrame, column: str = "breakdown") -> DataFrame:
    """Savings of each stage: the JSON maps of all rows, unreadable ones skipped, summed by key."""
    parsed = metrics.select(F.explode(F.from_json(column, "map<string,bigint>")).alias("algorithm", "saved"))
    return parsed.groupBy("algorithm").agg(F.sum("saved").alias("saved"))


def by_component(metrics: DataFrame) -> DataFrame:
    rows = metrics.where(F.coalesce("component_id", F.lit("")) != "")
    out = rows.groupBy("component_id").agg(F.count("*").alias("requests"), F.sum("raw_tokens").alias("raw_tokens"), F.sum("compressed_tokens").alias("compressed_tokens"))
    saved = F.col("raw_tokens") - F.col("compressed_tokens")
    out = out.withColumn("saved_tokens", saved).withColumn("saved_bp", basis_points(saved, F.col("raw_tokens")))
    return out.orderBy(F.desc("saved_tokens"), "component_id")


def algorithm_share(totals: DataFrame) -> DataFrame:
    """Share of each stage (algorithm, saved) in all savings, in hundredths of a percent, the largest first; one row a stage."""
    every = F.greatest(F.lit(1), F.sum("saved").over(Window.partitionBy()))
    return totals.withColumn("share_bp", F.floor(F.col("saved") * 10000 / every).cast("long")).orderBy(F.desc("saved"), "algorithm")


def status(metrics: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: requests, tokens saved and their share, entries of the store."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = metrics.agg(F.count("*").alias("requests"), total("raw_tokens").alias("raw_tokens"), (total("raw_tokens") - total("compressed_tokens")).alias("saved_tokens"))
    out = out.withColumn("saved_bp", basis_points(F.col("saved_tokens"), F.col("raw_tokens")))
    # two tables of one row each
    return out.join(F.broadcast(entries.agg(F.count("*").alias("entries"))))


def mask_totals(log: DataFrame) -> DataFrame:
    return log.groupBy("pattern").agg(F.sum("count").cast("long").alias("total")).orderBy(F.desc("total"), "pattern")


def eval_report(cases: DataFrame) -> DataFrame:
    """One row over evaluation cases (raw_tokens, compressed_tokens, similarity, error)."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    latency = F.avg(F.when(F.col("error").isNull(), F.col("latency_ms"))) if "latency_ms" in cases.columns else F.lit(0.0)
    out = cases.agg(F.coalesce(F.round(latency, 2), F.lit(0.0)).alias("avg_latency_ms"), F.count("*").alias("cases"), F.count("error").alias("errors"), total("raw_tokens").alias("raw_tokens"), total("compressed_tokens").alias("compressed_tokens"), F.count_if(F.col("similarity") < 0.5).alias("flagged"))
    saved = F.col("raw_tokens") - F.col("compressed_tokens")
    return out.withColumn("saved_tokens", saved).withColumn("saved_bp", basis_points(saved, F.col("raw_tokens")))


def eval_algorithms(cases: DataFrame, column: str = "breakdown") -> DataFrame:
    """Savings of each stage over all evaluation cases, whose ``column`` maps stages to tokens."""
    return cases.select(F.explode(column).alias("algorithm", "saved")).groupBy("algorithm").agg(F.sum("saved").cast("long").alias("saved"))
