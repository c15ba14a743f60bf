"""Call graphs over tables: extraction, reachability, pruning."""

from __future__ import annotations

import itertools
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.code import call_graph, prune
from ..functions.lazy import arrow


def index_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols (file, symbol, kind) and calls (caller_file, caller_symbol, callee_symbol) of files (path, code)."""
    found = files.select("path", call_graph("code").alias("g"))
    symbols = found.select(F.col("path").alias("file"), F.posexplode("g.symbols").alias("at", "s"))
    symbols = symbols.groupBy("file", F.col("s.symbol").alias("symbol")).agg(F.max_by("s.kind", "at").alias("kind"))
    calls = found.select(F.col("path").alias("caller_file"), F.explode("g.edges").alias("e")).select("caller_file", F.col("e.caller").alias("caller_symbol"), F.col("e.callee").alias("callee_symbol"))
    return symbols, calls


def _folder(spark: SparkSession) -> str:
    """A folder that driver and executors share, below ``spark.checkpoint.dir``; only a local master may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="terseframe-reach-")
    return f"{base.rstrip('/')}/reach-{uuid.uuid4().hex}"


def _cut(df: DataFrame, path: str) -> DataFrame:
    """Lineage cut by a written table, which outlives any executor."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reachable(calls: DataFrame, focal: DataFrame) -> DataFrame:
    """Symbols reached from ``focal`` (symbol) over calls by name: frontier joins until nothing is new, so cycles end.

    Each hop joins the frontier alone and writes it; what was seen is the union of the frontiers.
    """
    folder = _folder(calls.sparkSession)
    edges = _cut(calls.select(F.col("caller_symbol").alias("symbol"), F.col("callee_symbol").alias("next")).distinct(), f"{folder}/edges")
    seen = frontier = _cut(focal.select("symbol").distinct(), f"{folder}/0")
    for step in itertools.count(1):
        new = frontier.join(edges, "symbol").select(F.col("next").alias("symbol")).distinct().join(seen, "symbol", "left_anti")
        frontier = _cut(new, f"{folder}/{step}")
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def prune_files(files: DataFrame, symbols: DataFrame, reached: DataFrame) -> DataFrame:
    """Files (path, code) with the bodies of their own unreached symbols cut; each file gets the names it needs by a join."""
    names = symbols.join(reached, "symbol", "left_semi").groupBy("file").agg(F.collect_set("symbol").alias("names")).withColumnRenamed("file", "path")

    @arrow("string")
    def cut(codes: pd.Series, kept: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else prune(c, set(k) if k is not None else set()) for c, k in zip(codes, kept, strict=True)])

    return files.join(names, "path", "left").withColumn("pruned", cut("code", "names")).drop("names")
