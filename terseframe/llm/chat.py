"""Reply trees to chat-formatted conversations with a loss mask.

Messages point to the message they answer. Ancestors are found by iterative self-joins that double
the reach of every pointer (a path of n messages takes log2 n joins); the same tables of jumps then
list each chosen path. Branches are ranked by the sum of their messages' scores, longer ones and
smaller leaf numbers first among equals, and each chosen root-to-leaf path becomes one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In texts a backslash is put into every
``<|``, and one more into every ``<\\|``, ``<\\\\|`` ..., so no control string is left inside a text and the
reverse is exact; in roles ``\\`` and line ends are escaped as well. The loss mask covers the escaped text
of each assistant turn.

Defined cases: a null text or role is empty; turns of a conversation may repeat or have gaps, equal
turns come in order of role and text; a null turn comes first; a null conversation id is a conversation
of its own; a message whose parent is not in its tree is a root; messages on a cycle of parents belong
to no path; an empty table gives no conversation; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

START, END = "<|im_start|>", "<|im_end|>"
#: Turns that are joined into one string before those strings are joined, so no task orders all turns of a long path.
CHUNK = 64


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<$1\\|")


def escape_role(c: Column) -> Column:
    return escape(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


def chain(conversations: DataFrame) -> DataFrame:
    """Messages of tables without parents: each turn answers the one before it.

    Turns are numbered in chunks of :data:`CHUNK` turn numbers, so one long conversation is not ordered by one task.
    """
    rows = conversations.select(
        F.col("conv_id").alias("tree"), F.coalesce(F.col("conv_id").cast("string"), F.lit("none")).alias("_t"), F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 40))).alias("_chunk"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    inner = Window.partitionBy("_t", "_chunk").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    counts = rows.groupBy("_t", "_chunk").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("_t").orderBy("_chunk")) - F.col("_n"))
    numbered = rows.withColumn("_at", F.row_number().over(inner) - 1).join(counts.drop("_n"), ["_t", "_chunk"])
    at = (F.col("_before") + F.col("_at")).cast("long")
    return numbered.select("tree", at.alias("msg"), F.when(at > 0, at - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, msg, depth) of the ``branches`` best root-to-leaf paths of every tree, depth from 0 at the root."""
    key = F.coalesce(F.col("tree").cast("string"), F.lit("none"))
    nodes = messages.select(key.alias("_t"), "msg", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    nodes = nodes.groupBy("_t", "msg").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    known = nodes.select("_t", F.col("msg").alias("parent"), F.lit(True).alias("_in"))
    state = nodes.join(known, ["_t", "parent"], "left").select("_t", "msg", F.when(F.col("_in"), F.col("parent")).alias("up"), F.when(F.col("_in"), 1).otherwise(0).cast("long").alias("depth"), "score")
    jumps, live, ended = [], -1, None
    while True:
        state = materialise(state, "chat-jumps")
        open_, done = state.where("up is not null"), state.where("up is null")
        ended = done if ended is None else ended.unionByName(done)
        jumps.append(open_.select("_t", "msg", "up"))
        left = open_.count()
        # a message at some depth has ancestors at every smaller one, so a doubling that ends no pointer leaves cycles alone
        if left in (0, live):
            break
        live = left
        above = ended.unionByName(open_).select("_t", F.col("msg").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("score").alias("_score"))
        # only pointers that have not reached a root are joined again
        state = open_.join(above, ["_t", "up"], "left").select(
            "_t", "msg", F.col("_up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"), (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score")
        )
    parents = nodes.where("parent is not null and parent <> msg").select("_t", F.col("parent").alias("msg")).distinct()
    leaves = ended.join(parents, ["_t", "msg"], "left_anti")
    best = Window.partitionBy("_t").orderBy(F.desc("score"), F.desc("depth"), "msg")
    leaves = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    paths = leaves.select("_t", F.col("msg").alias("leaf"), "rank", "msg")
    for jump in reversed(jumps[:-1]):
        paths = materialise(paths.unionByName(paths.join(jump, ["_t", "msg"]).select("_t", "leaf", "rank", F.col("up").alias("msg"))), "chat-paths")
    return paths.join(ended.select("_t", "msg", "depth"), ["_t", "msg"])


def format_conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, loss_spans) of each chosen path; spans are code points, end exclusive."""
    key = F.coalesce(F.col("tree").cast("string"), F.lit("none"))
    said = messages.select(key.alias("_t"), "tree", "msg", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = reply_paths(messages, branches).join(said, ["_t", "msg"])
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select(
        "_t", "tree", "leaf", "rank", F.floor(F.col("depth") / CHUNK).alias("_chunk"),
        F.struct(F.col("depth"), head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss")).alias("turn"),
    )
    chunks = turns.groupBy("_t", "tree", "leaf", "rank", "_chunk").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(s, t):
        begin = s["at"] + F.length(t["head"])
        end = begin + F.length(t["body"])
        span = F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))
        return F.struct((end + len(END) + 1).cast("long").alias("at"), F.when(t["loss"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    chunks = chunks.select("_t", "tree", "leaf", "rank", F.struct("_chunk", text.alias("text"), F.aggregate("turns", start, step)["spans"].alias("spans")).alias("chunk"))
    paths = chunks.groupBy("_t", "tree", "leaf", "rank").agg(F.sort_array(F.collect_list("chunk")).alias("chunks"))
    before = F.lit(0).cast("long")

    def shift(s, c):
        moved = F.transform(c["spans"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), (x["end"] + s["at"]).alias("end")))
        return F.struct((s["at"] + F.length(c["text"])).cast("long").alias("at"), F.concat(s["spans"], moved).alias("spans"))

    spans = F.aggregate("chunks", F.struct(before.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")), shift)["spans"]
    return paths.select("tree", "leaf", "rank", F.array_join(F.transform("chunks", lambda c: c["text"]), "").alias("formatted"), spans.alias("loss_spans"))


_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted strings and masks gets back, as digests."""
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for text, mask in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = parse(text)
                loss = "".join(unescape(text[x["start"] : x["end"]]) for x in mask)
                values = len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string() if "sha" in n else pa.int64()) for c, n in zip(cols, names, strict=True))], names=["conv_id", *names])

    kind = formatted.schema["tree"].dataType.simpleString()
    return formatted.select("tree", "formatted", "loss_spans").mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
