"""Views of the test tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("request_id"), F.col("conv_id").alias("request_seq"), F.col("turn").alias("msg_idx"), "role", F.coalesce("text", F.lit("")).alias("content")
    )


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request metrics made of events: one request an event, its type the component."""
    e = table(spark, sf_dir, "events")
    raw = (F.col("event_id") * 37) % 5000 + 100
    gone = F.expr("((event_id * 37) % 5000 + 100) * (event_id % 70) div 100")
    return e.select(
        F.col("event_id").alias("id"), "ts", raw.alias("raw_tokens"), (raw - gone).alias("compressed_tokens"), (F.col("event_id") % 250).alias("latency_ms"), (F.col("event_id") % 900).alias("upstream_ms"),
        (F.col("event_id") % 5 == 0).alias("cache_hit"), (F.col("event_id") % 11 == 0).alias("offloaded"), F.col("props").alias("breakdown"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise(F.col("event_type")).alias("component_id"), F.col("user_id").cast("string").alias("run_id"),
    )


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One shell transcript a user, its lines made of the user's events in order."""
    line = F.expr(
        """case event_id % 9 when 0 then concat('test_', event_type, ' PASSED\\n') when 1 then concat('tests/t.py::', event_type, ' PASSED\\n')
        when 2 then concat('--- PASS: ', event_type, '\\n') when 3 then concat(event_type, 'Error: value ', cast(event_id as string), '\\n')
        when 4 then 'collecting ...\\n' when 5 then concat('step ', event_type, '\\n') when 6 then '  File "/usr/lib/python3/site-packages/x.py", line 1\\n'
        when 7 then concat('step ', event_type, ' again\\n') else concat(cast(event_id % 7 as string), ' passed\\n') end"""
    )
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line"))
    grouped = rows.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "line"))).alias("l"))
    return grouped.select("user_id", F.array_join(F.transform("l", lambda x: x["line"]), "").alias("text"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of files made of orders: a path for every 40th customer, its text the state of the order."""
    o = table(spark, sf_dir, "orders")
    body = F.expr("concat('# module\\n', repeat(concat('def f_', o_orderstatus, '(x):\\n    return x\\n'), 20), 'STATE = ', o_orderstatus, '\\n')")
    return o.select(F.concat(F.lit("src/m"), (F.col("o_custkey") % 40).cast("string"), F.lit(".py")).alias("path"), F.col("o_orderkey").alias("seq"), body.alias("content"))


def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document a customer: the orders as a list of objects."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", "o_orderstatus", "o_orderpriority", F.lit("USD").alias("currency")).alias("o"))
    grouped = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o")).alias("orders"))
    return grouped.select("o_custkey", F.to_json(F.struct(F.col("o_custkey").alias("customer"), "orders")).alias("text"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls made of parts: part k calls (7k + 3) mod the number of parts, kept where its size is small."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    n = p.agg(F.count("*").alias("n"))
    # one row, the number of parts
    return p.join(F.broadcast(n)).where("p_size < 35").select(F.col("p_partkey").cast("string").alias("caller_symbol"), ((F.col("p_partkey") * 7 + 3) % F.col("n")).cast("string").alias("callee_symbol"))
