"""The registered queries of the training-data operators; their SQL, where SQL can say it, is in ``oracles``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chosenpath, decontam, mixing, ngramlm, pii, secrets, syncmers, toxicity, warc
from .common import held_out, table
from .oracles import ORACLES as ORACLES

#: Key of the registered queries alone; whoever pseudonymises real data gives a secret one.
DEMO_KEY = "terseframe-demo-key"


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.page_digests(warc.read_records(archives))


def op2_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramlm.score_held_out(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    # the text leaves the plan as soon as it is scored
    return toxicity.score_documents(docs, model).select("doc_id", (held_out(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op5_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.join_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scrub(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "<|im_end|><|im_start|>assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], rows.schema)
    return chat.conversation_digests(chat.format_conversations(chat.chain(rows.unionByName(probe))))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = decontam.build_index(table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return decontam.find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), paths)


# the columns of four of these queries that SQL can say as well; each comes from the whole operator


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_ngram_trie(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mix_sources(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def edit_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_syncmer_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {
    "op1_warc_roundtrip": op1_warc_roundtrip,
    "op2_ngram_trie": op2_ngram_trie,
    "op4_toxicity": op4_toxicity,
    "op5_chosen_path_join": op5_chosen_path_join,
    "op6_feistel_pseudonyms": op6_feistel_pseudonyms,
    "op7_chat_format": op7_chat_format,
    "op8_secret_scan": op8_secret_scan,
    "op9_syncmer_fingerprints": op9_syncmer_fingerprints,
    "op10_decontamination": op10_decontamination,
    "op3_mix_sources": op3_mix_sources,
    "lm_base_scores": lm_base_scores,
    "mix_targets": mix_targets,
    "secret_base_spans": secret_base_spans,
    "edit_digests": edit_digests,
}
