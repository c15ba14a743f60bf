"""Operators over messages (request_id, msg_idx, role, content): near copies, ageing, cache boundary.

All windows share one partitioning and order, so a plan with several of them has one exchange.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prose
from ..functions.lazy import arrow
from ..functions.text import lstrip, saved_by

# Words that say little, role codes, and the three sorts of keywords.
STOP_WORDS = frozenset(
    """a about after all also an and any are as at be been before being below between both but by can could did do does doing
    down during each few for from further get got had has have he her here him his how i if in into is it its itself just keep
    let like likely may me might more most much must my need no nor not now of off on once only or other our out over own per
    same see set should since so some still such than that the their them then there these they this those through to too under
    until up use very via was we were what when where which while who will with would you your""".split()
)
ROLE_CODES = {"user": "U", "assistant": "A", "system": "SYS", "tool": "TOOL"}
QUOTED, PATHLIKE, WORDLIKE = r"`([^`]+)`", r"(?U)[\w\-./]+\.[a-z]{2,5}", r"(?U)[a-zA-Z_][\w]{2,}"
PIN = "[PIN]"


def within(by: str = "request_id") -> Window:
    return Window.partitionBy(by).orderBy("msg_idx")


@arrow("bigint")
def simhash64(texts: pd.Series) -> pd.Series:
    """64-bit SimHash over the overlapping 4-character pieces, each counted as often as it occurs; a tie gives 0."""
    import hashlib

    import numpy as np

    known: dict[str, int] = {}

    def piece(s: str) -> int:
        if s not in known:
            known[s] = int.from_bytes(hashlib.md5(s.encode()).digest()[8:], "big")
        return known[s]

    place = np.arange(64, dtype=np.uint64)
    out = []
    for t in texts:
        h = np.array([piece(t[i : i + 4]) for i in range(len(t or "") - 3)], np.uint64)
        if len(known) > 2_000_000:
            known.clear()
        total = np.zeros(64, np.int64)
        for lo in range(0, len(h), 8192):
            total += ((h[lo : lo + 8192, None] >> place) & np.uint64(1)).astype(np.int64).sum(0)
        bits = np.bitwise_or.reduce(np.where(total * 2 > len(h), np.uint64(1) << place, np.uint64(0)))
        out.append(int(np.uint64(bits).view(np.int64)))
    return pd.Series(out, dtype="int64")


def near_dup_turns(messages: DataFrame, threshold: float = 0.85, window: int = 10, least: int = 80, by: str = "request_id") -> DataFrame:
    """Adds ref_idx, same_bits, is_dup and the content with near copies replaced by pointers.

    A turn is compared with those of the ``window`` turns before it that have ``least`` characters: an
    equal one, the newest first, else the most alike at ``threshold`` or more, the newest among equals.
    Fingerprints are of the original texts. The frame is bounded, so a long request costs no more a turn.
    """
    long = F.length("content") >= least
    rows = messages.withColumn("_print", simhash64(F.col("content"))).withColumn("_digest", F.sha2(F.col("content").cast("binary"), 256))
    before = within(by).rowsBetween(-window, -1)
    rows = rows.withColumn("_seen", F.collect_list(F.when(long, F.struct("msg_idx", "_digest", "_print"))).over(before))
    same = F.filter("_seen", lambda x: x["_digest"] == F.col("_digest"))
    alike = F.filter(
        F.transform("_seen", lambda x: F.struct((64 - F.bit_count(x["_print"].bitwiseXOR(F.col("_print")))).alias("bits"), x["msg_idx"].alias("idx"))),
        lambda x: x["bits"] / 64.0 >= threshold,
    )
    best = F.when(F.size(same) > 0, F.struct(F.lit(64).alias("bits"), F.array_max(F.transform(same, lambda x: x["msg_idx"])).alias("idx"))).otherwise(F.array_max(alike))
    rows = rows.withColumn("_best", F.when(long, best))
    pointer = F.concat(F.lit("[DEDUP:ref="), F.col("_best.idx").cast("string"), F.lit(" sim="), F.format_string("%.2f", F.col("_best.bits") / 64.0), F.lit("]"))
    rows = rows.withColumn("is_dup", F.col("_best").isNotNull()).withColumn("ref_idx", F.col("_best.idx")).withColumn("same_bits", F.col("_best.bits"))
    return rows.withColumn("new_content", F.when(F.col("is_dup"), pointer).otherwise(F.col("content"))).drop("_print", "_digest", "_seen", "_best")


def is_pinned(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*\[PIN\]")


def unpin(text: Column) -> Column:
    return lstrip(F.regexp_replace(text, r"(?U)^\s*\[PIN\]", ""))


def keywords(text: Column, most: int = 25) -> Column:
    """Quoted symbols, then path-like words, then words that say something; each list in order, joined by commas."""
    quoted = F.filter(F.transform(F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+\z", "")), lambda s: s != "")
    first = F.array_distinct(F.concat(quoted, F.regexp_extract_all(text, F.lit(PATHLIKE), F.lit(0))))
    stop = F.array(*[F.lit(w) for w in sorted(STOP_WORDS)])
    words = F.filter(F.regexp_extract_all(text, F.lit(WORDLIKE), F.lit(0)), lambda w: ~F.array_contains(stop, F.lower(w)))

    def step(s, w):
        # the list keeps the word's case while the test is in lower case, so a capitalised word can recur
        return F.when((F.size(s) >= most) | F.array_contains(s, F.lower(w)), s).otherwise(F.concat(s, F.array(w)))

    return F.array_join(F.slice(F.aggregate(words, first, step), 1, most), ", ")


def decay(messages: DataFrame, recent: int = 2, partial: int = 8, most: int = 25, by: str = "request_id") -> DataFrame:
    """Adds age, zone and the content after ageing: recent turns stay, older ones lose markdown, the oldest become keywords."""
    rows = messages.withColumn("age", F.count("*").over(Window.partitionBy(by)) - F.row_number().over(within(by)))
    zone = (
        F.when(F.col("role") == "system", "system").when(is_pinned(F.col("content")), "pinned").when(F.col("age") < recent, "recent")
        .when(F.col("age") < recent + partial, "partial").otherwise("digest")
    )
    code = F.coalesce(*[F.when(F.col("role") == r, c) for r, c in ROLE_CODES.items()], F.upper(F.substring("role", 1, 1)))
    digest = F.concat(F.lit("["), code, F.lit("·"), keywords(F.col("content"), most), F.lit("]"))
    rows = rows.withColumn("zone", zone)
    new = F.when(F.col("zone") == "pinned", unpin(F.col("content"))).when(F.col("zone") == "partial", prose.strip_markdown(F.col("content"))).when(F.col("zone") == "digest", digest).otherwise(F.col("content"))
    rows = rows.withColumn("new_content", new)
    return rows.withColumn("saved", F.when(F.col("zone").isin("partial", "digest"), saved_by(F.col("content"), F.col("new_content"))).otherwise(F.lit(0)).cast("long"))


def cache_boundary(messages: DataFrame, tail: int = 3, by: str = "request_id") -> DataFrame:
    """One row a request: messages, and the index before which a prefix can be cached."""
    return messages.groupBy(by).agg(F.count("*").alias("n_messages"), F.count_if(F.col("role") != "system").alias("_turns")).select(
        by, "n_messages", F.greatest(F.lit(0), F.col("n_messages") - F.least(F.lit(tail), F.col("_turns"))).cast("long").alias("boundary")
    )


def cache_hints(messages: DataFrame, provider: Column, tail: int = 3, by: str = "request_id") -> DataFrame:
    """Marks the message before the boundary for providers that take such a hint."""
    every = Window.partitionBy(by)
    turns = F.sum((F.col("role") != "system").cast("int")).over(every)
    boundary = F.greatest(F.lit(0), F.count("*").over(every) - F.least(F.lit(tail), turns))
    place = F.row_number().over(within(by)) - 1
    return messages.withColumn("cache_hint", (provider == "anthropic") & (boundary > 0) & (place == boundary - 1))


def sort_tools(tools: Column) -> Column:
    """An array of structs with a name, in the order of names; equal names keep their order."""
    placed = F.transform(tools, lambda t, i: F.struct(t["name"].alias("k"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(placed), lambda x: x["t"])
