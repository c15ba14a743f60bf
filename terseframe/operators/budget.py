"""Choice of stages by a token budget: six tiers of growing strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Stages and offload threshold of each tier, and the share each is planned to remove.
TIERS = (
    # near_dup, prose, json, code, shell, decay, offload_tokens, ceiling
    (False, False, False, False, False, False, 999999, 0.05),
    (True, False, False, False, False, False, 999999, 0.15),
    (True, True, True, False, False, False, 4000, 0.35),
    (True, True, True, True, True, False, 2000, 0.55),
    (True, True, True, True, True, True, 2000, 0.70),
    (True, True, True, True, True, True, 500, 0.85),
)
COLUMNS = ("near_dup", "prose", "json", "code", "shell", "decay", "offload_tokens")


def tier(raw: Column, budget: Column) -> Column:
    """First tier whose planned result fits the budget, 5 if none does or there is no budget, 1 if the raw text already fits."""
    fits = [(raw.cast("double") * (F.lit(1.0).cast("double") - F.lit(t[7]).cast("double"))) <= budget for t in TIERS]
    out = F.when(raw <= budget, 1).when(budget.isNull() | (budget <= 0), 5)
    for k, ok in enumerate(fits):
        out = out.when(ok, k)
    return out.otherwise(5)


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *t[:7]) for k, t in enumerate(TIERS)], "tier int, " + ", ".join(f"{c} {'int' if c == 'offload_tokens' else 'boolean'}" for c in COLUMNS))


def plan(requests: DataFrame, offload_most: int = 2000) -> DataFrame:
    """Requests (raw_tokens, budget_tokens) with their tier and its stages; six rows are broadcast."""
    rows = requests.withColumn("tier", tier(F.col("raw_tokens"), F.col("budget_tokens")))
    return rows.join(F.broadcast(tiers(requests.sparkSession)), "tier").withColumn("offload_tokens", F.least("offload_tokens", F.lit(offload_most)))
