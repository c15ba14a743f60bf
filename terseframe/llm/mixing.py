"""Mix sources to target weights by Pareto order sampling, in DataFrame functions alone.

Every source gets a target in words (weights with a cap, see :func:`source_targets`). Within a source a
document's expected number of copies falls with its length, by a factor 2 ** (-1 / TILT) for each doubling,
so a few very long documents do not make up a repeated source; :func:`size_shares` finds the level at which
all expected copies make the target and none is above the cap. The whole part is given as certain copies,
the fraction is the inclusion probability p of one copy more, so documents of a source have different p.
All documents of a source are ranked by random odds over inclusion odds, (u/(1-u)) / (p/(1-p)), u a keyed
hash of the row, and are taken in that order until the words that remain are used up; so the sample has a
fixed size in words.

No source is ever gathered in one place: ranks are cut into buckets, buckets are summed, the cumulated
sums name the one bucket in which the sample ends, and only that bucket (about 256 documents, more
slowly growing with the source) is ordered and filled document by document.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; equal rows
(id, source and text) are numbered and drawn one by one, so as many of them are taken as the sample has
room for; an empty table gives an empty one; other columns pass through, whatever their names, except
that output names replace equal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, bounded_broadcast, materialise, scratch

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = "mix-1"
#: A document of twice the length has 2 ** (-1 / TILT) of the expected copies.
TILT = 8
#: Up to so many sources a table of their targets is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 4096
#: Lengths are told apart by their power of two, so a source has at most so many rows in the table of shares.
CLASSES = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _uniform(*parts: Column) -> Column:
    """52 bits of a keyed hash as a number strictly between 0 and 1."""
    text = F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """From (source, source_size, n) one row a source: target words, by weight, at most ``most`` times its size.

    Sources in code point order, null last, weigh ``weights`` in turn. What a capped source cannot use is
    shared by weight among the others; the level at which no source is above its cap is found in one pass
    over the sources in the order of cap / weight. The windows hold one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    every = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", "_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("_rank", F.row_number().over(order))
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") - 1) % len(weights) + 1))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(most))).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    ranked = (
        ranked.withColumn("_all", F.sum("source_size").over(every).cast("double"))
        .withColumn("_used", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_left", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_all") - F.col("_used")) / F.col("_left"))
    )
    level = F.min_by(F.col("_level"), F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_rank"))).over(every)
    return ranked.withColumn("target", F.least("_cap", level * F.col("_w"))).select("source", "source_size", "n", "target")


def size_shares(classes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """From (source, level, words, source_size, n, target) the certain copies and p of each class of lengths of each source.

    Expected copies are least(most, c * 2 ** (-level / TILT)); c is found in one pass over the classes in the
    order in which they reach the cap. The windows hold a source's at most CLASSES rows.
    """
    own = Window.partitionBy("source").orderBy("level")
    every = Window.partitionBy("source")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    after = own.rowsBetween(0, Window.unboundedFollowing)
    lean = F.pow(F.lit(2.0), -F.col("level") / TILT)
    rows = classes.withColumn("lean", lean).withColumn("ratio", most / F.col("lean"))
    used = F.coalesce(F.sum("words").over(before), F.lit(0)) * float(most)
    rows = rows.withColumn("c", F.try_divide(F.col("target") - used, F.sum(F.col("lean") * F.col("words")).over(after)))
    c = F.min_by(F.col("c"), F.when(F.col("c") <= F.col("ratio"), F.col("level"))).over(every)
    rows = rows.withColumn("copies", F.least(F.lit(float(most)), F.greatest(F.lit(0.0), F.coalesce(c * F.col("lean"), F.lit(float(most))))))
    rows = rows.withColumn("whole", F.floor(F.col("copies") + 1e-9))
    rows = rows.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.sum(F.col("whole") * F.col("words")).over(every)))
    p = F.least(F.lit(1 - 1e-9), F.greatest(F.lit(1e-9), F.col("copies") - F.col("whole")))
    return rows.select("source", "level", "source_size", "n", "target", "whole", "rest", p.alias("p"))


def _same(a: list, b: list) -> Column:
    out = a[0].eqNullSafe(b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        out = out & x.eqNullSafe(y)
    return out


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and taken words added."""
    with scratch(docs.sparkSession) as stay:
        return _mix(docs, weights, most, stay)


def _mix(docs: DataFrame, weights: tuple[int, ...], most: int, stay: list[str]) -> DataFrame:
    names = ("size", "source_size", "target", "taken")
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    # the table's own columns travel in one struct, so no name of theirs can clash with those made here
    said = F.xxhash64(F.coalesce("text", F.lit("")))
    base = docs.select(F.struct(*keep).alias("row"), F.col("doc_id").alias("id"), F.col("source"), word_count(F.col("text")).alias("size"), said.alias("hash"))
    group = ["id", "source", "size", "hash"]
    groups = materialise(base.select(*group).groupBy(*group).agg(F.count("*").alias("same")), "mix-sizes")
    level = F.least(F.lit(CLASSES - 1), F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("int"))
    classes = materialise(groups.groupBy("source", level.alias("level")).agg(F.sum(F.col("size") * F.col("same")).alias("words"), F.sum("same").alias("n")), "mix-classes")
    targets = source_targets(classes.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n")), weights, most)
    joined = classes.select("source", "level", "words").join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    shares = size_shares(joined, most)
    shares = materialise(shares.withColumn("buckets", F.ceil(F.col("n") / F.greatest(F.lit(256.0), F.sqrt("n") / 4))).drop("n").withColumnsRenamed({"source": "_source", "level": "_level"}), "mix-shares")

    def ranked(df: DataFrame, plan: DataFrame, number: Column) -> DataFrame:
        plan = bounded_broadcast(plan, BROADCAST_SOURCES * CLASSES)
        out = df.withColumn("level", level).join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("level") == F.col("_level")), "left")
        out = out.withColumn("u", _uniform(F.col("id"), F.col("source"), F.col("size"), F.col("hash"), number))
        out = out.withColumn("odds", F.col("u") / (1 - F.col("u")) / (F.col("p") / (1 - F.col("p"))))
        return out.withColumn("bucket", F.floor(F.col("odds") / (1 + F.col("odds")) * F.col("buckets")))

    drawn = groups.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("same"))))
    rows = ranked(drawn, shares, F.col("number")).where(F.col("whole") < most)  # what has all its copies is not drawn
    upto = Window.partitionBy("_source").orderBy("bucket")
    ends = (
        rows.groupBy("_source", "bucket", "rest")
        .agg(F.sum("size").alias("words"))
        .withColumn("before", F.sum("words").over(upto) - F.col("words"))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words")))
        .select(F.col("_source").alias("end_source"), F.col("bucket").alias("end"), (F.col("rest") - F.col("before")).alias("gap"))
    )
    ends = materialise(ends, "mix-ends")
    last = (
        rows.join(bounded_broadcast(ends, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("end_source")) & (F.col("bucket") == F.col("end")))
        .groupBy("end_source", "end", "gap")
        .agg(F.sort_array(F.collect_list(F.struct("odds", "u", F.col("size").cast("double").alias("words")))).alias("order"))
    )
    fill = F.aggregate(
        "order",
        F.struct(F.col("gap").alias("gap"), F.array().cast("array<double>").alias("taken")),
        lambda s, x: F.when(x["words"] <= s["gap"], F.struct((s["gap"] - x["words"]).alias("gap"), F.concat(s["taken"], F.array(x["u"])).alias("taken"))).otherwise(s),
    )
    ended = last.select("end_source", "end", fill["taken"].alias("filled"))
    # a source without such a bucket takes its every document (its rest is all its words) or has no words
    plan = materialise(shares.join(ended, F.col("_source").eqNullSafe(F.col("end_source")), "left").drop("end_source"), "mix-plan", stay)
    more = (F.col("rest") > 0) & (F.col("whole") < most) & (F.col("end").isNull() | (F.col("bucket") < F.col("end")) | ((F.col("bucket") == F.col("end")) & F.array_contains("filled", F.col("u"))))
    result = [
        F.col("row.*"), "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
        (F.col("size") * F.coalesce(F.col("whole") + F.col("extra"), F.lit(0))).cast("long").alias("taken"),
    ]
    several = groups.where("same > 1")
    if several.limit(1).count() == 0:
        return ranked(base, plan, F.lit(1)).withColumn("extra", F.when(more, 1).otherwise(0)).select(*result)
    # of equal rows as many have one copy more as the draws of their numbers say; they are numbered by input
    # partition first, so no task orders all of a large group
    drawn = ranked(several.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("same")))), plan, F.col("number"))
    more_of = drawn.groupBy(*group).agg(F.count_if(more).alias("more_of"))
    more_of = materialise(more_of.select(*[F.col(c).alias(f"g_{c}") for c in group], "more_of"), "mix-several", stay)
    in_group = _same([F.col(c) for c in group], [F.col(f"g_{c}") for c in group])
    hinted = bounded_broadcast(more_of, BROADCAST_SOURCES)
    apart = base.withColumn("part", F.spark_partition_id()).join(hinted, in_group).drop(*[f"g_{c}" for c in group])
    keyed = Window.partitionBy(*group, "part").orderBy("hash")
    apart = materialise(apart.withColumn("at", F.row_number().over(keyed)), "mix-repeated", stay)
    sums = apart.groupBy(*group, "part").agg(F.count("*").alias("many"))
    sums = sums.withColumn("before", F.sum("many").over(Window.partitionBy(*group).orderBy("part")) - F.col("many"))
    sums = sums.select(*[F.col(c).alias(f"g_{c}") for c in group], F.col("part").alias("g_part"), "before")
    numbered = apart.join(sums, in_group & (F.col("part") == F.col("g_part"))).withColumn("extra", F.when(F.col("before") + F.col("at") <= F.col("more_of"), 1).otherwise(0))
    alone = base.join(hinted, in_group, "left_anti")
    alone = ranked(alone, plan, F.lit(1)).withColumn("extra", F.when(more, 1).otherwise(0)).select(*result)
    return alone.unionByName(ranked(numbered, plan, F.lit(1)).select(*result))
