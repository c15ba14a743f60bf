"""Request logs in JSON lines, in and out."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lazy import arrow

BLOCK = "struct<type:string,text:string,content:string>"
PAYLOAD = "struct<model:string,max_tokens:int,system:string,messages:array<struct<role:string,content:string>>,tools:array<string>>"


def read_requests(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(file, line, model, system, messages, tools, payload) of a log; blank and unreadable lines are skipped.

    Entries of a recorder, {path, ts, payload}, are unwrapped. With ``limit`` the first so many parsed
    lines in file order are kept.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.trim("value").alias("value"))
    good = lines.where((F.col("value") != "") & F.try_parse_json("value").isNotNull())
    inner = F.get_json_object("value", "$.payload")
    payload = F.when(inner.isNotNull() & F.get_json_object("value", "$.messages").isNull(), inner).otherwise(F.col("value"))
    rows = good.select("file", "line", payload.alias("payload")).withColumn("p", F.from_json("payload", PAYLOAD))
    out = rows.select("file", "line", "p.model", "p.system", "p.messages", "p.tools", "payload")
    return out.orderBy("file", "line").limit(limit) if limit is not None else out


def messages_of(requests: DataFrame, request_id: str = "request_id") -> DataFrame:
    """One row a message (request_id, msg_idx, role, content); content in blocks becomes their texts, one a line."""
    rows = requests.select(request_id, F.posexplode("messages").alias("msg_idx", "m")).select(F.col(request_id).alias("request_id"), "msg_idx", "m.role", F.col("m.content").alias("raw"))
    blocks = F.from_json("raw", f"array<{BLOCK}>")
    joined = F.array_join(F.transform(blocks, lambda b: F.coalesce(b["text"], b["content"], F.lit(""))), "\n")
    return rows.withColumn("content", F.when(F.col("raw").startswith("[") & blocks.isNotNull(), joined).otherwise(F.coalesce("raw", F.lit("")))).drop("raw")


def block_texts(raw: Column) -> Column:
    """What each kind of stage reads of a message's content, as a struct; of plain text all are that text.

    ``engines``: text, else content, of all blocks, one a line. ``classify`` and ``plain``: text of all blocks, by spaces.
    ``near_dup``: text of text blocks, one a line. ``keywords``: text, else content, of all blocks, by spaces.
    """
    blocks = F.filter(F.from_json(raw, "array<string>"), lambda b: b.startswith("{"))
    listed = F.ltrim(raw).startswith("[") & F.from_json(raw, "array<string>").isNotNull()
    field = lambda b, k: F.get_json_object(b, f"$.{k}")
    either = lambda b: F.coalesce(field(b, "text"), field(b, "content"), F.lit(""))
    own = lambda b: F.coalesce(field(b, "text"), F.lit(""))
    of = {
        "engines": F.array_join(F.transform(blocks, either), "\n"),
        "classify": F.array_join(F.transform(blocks, own), " "),
        "near_dup": F.array_join(F.transform(F.filter(blocks, lambda b: field(b, "type") == "text"), own), "\n"),
        "keywords": F.array_join(F.transform(blocks, either), " "),
        "plain": F.array_join(F.transform(blocks, own), " "),
    }
    return F.struct(*[F.when(listed, x).otherwise(F.coalesce(raw, F.lit(""))).alias(k) for k, x in of.items()])


@arrow("string")
def write_back(raw: pd.Series, text: pd.Series) -> pd.Series:
    """A message's content with new text: plain text is replaced, of blocks the first text block takes it and the others stay."""

    def one(old: str | None, new: str | None) -> str | None:
        try:
            blocks = json.loads(old) if old and new is not None and old.lstrip().startswith("[") else None
        except ValueError:
            blocks = None
        if not isinstance(blocks, list):
            return old if new is None else new
        first = next((b for b in blocks if isinstance(b, dict) and b.get("type") == "text"), None)
        if first is None:
            return old
        first["text"] = new
        return json.dumps(blocks)

    return pd.Series([one(a, b) for a, b in zip(raw, text, strict=True)], dtype=object)


def record_requests(requests: DataFrame, path: str) -> None:
    """Append requests (path, ts, payload) to a log, one line {"path", "ts", "payload"} each; a payload is JSON text and stays as it is.

    A row whose payload is no JSON is left out.
    """
    line = F.concat(F.lit('{"path": '), _quoted("path"), F.lit(', "ts": '), F.col("ts").cast("string"), F.lit(', "payload": '), F.regexp_replace("payload", r"[\r\n]+", " "), F.lit("}"))
    requests.where(F.try_parse_json("payload").isNotNull()).select(line.alias("value")).write.mode("append").text(path)


def _quoted(column: str) -> Column:
    """A string column as a JSON literal."""
    inner = F.to_json(F.struct(F.coalesce(column, F.lit("")).alias("x")))
    return F.substr(inner, F.lit(6), F.length(inner) - 6)


def read_code(spark: SparkSession, path: str) -> DataFrame:
    """(path, code) of Python files below a folder; folders of tools and environments are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    skip = r"/(\.git|\.venv|venv|node_modules|__pycache__|\.tox|dist|build)/"
    return files.where(F.col("path").rlike(r"\.pyi?$") & ~F.col("path").rlike(skip)).select("path", F.decode("content", "UTF-8").alias("code"))
