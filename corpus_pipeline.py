"""A corpus pipeline of five of the training-data operators; each stage reads all that the one before it kept.

toxicity     drops documents that the restored-text model predicts to be toxic
dedup        keeps of every class of near copies the document with the smallest id
decontam     drops documents that hold a benchmark item
pii          replaces personal data by format-preserving pseudonyms
mixing       samples documents so that sources have their target shares; ``copies`` says how often one is taken

SQL cannot express the models and keyed digests of these stages, so there is no ORACLE_SQL. Tests plant
toxic texts, near copies, benchmark items and personal data in a small table and hold what each stage keeps
against a plain Python version of that stage; the classifier's own quality is tested on held-out rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terseframe.llm import chosenpath, decontam, mixing, pii, toxicity
from terseframe.llm.common import materialise, scratch, table
from terseframe.llm.queries import DEMO_KEY


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_documents(docs, model).where("predicted = 0").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chosenpath.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean_documents(docs, decontam.build_index(table(spark, sf_dir, "benchmark").select("item_id", "text")))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.scrub(docs, DEMO_KEY).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mix_sources(docs).where("taken > 0")
    return taken.select(*docs.columns, F.expr("taken div size").alias("copies"), "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", pseudonymise),
    ("mixing", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; its table alone stays in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as stay:
        for name, stage in STAGES:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}", stay if name == STAGES[-1][0] else None)
    return docs
