"""The queries of this subpackage and, where SQL can say them, their oracles."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, html_text, line_dedup, lz_fingerprint, packing, secrets, simhash, token_store, toxicity
from .common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", "fingerprint", "component_id")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_deleted")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def toxic_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``; nothing is learnt from rows whose fold is 2."""
    fold = toxicity.fold(F.col("doc_id"))
    model, weights = toxicity.train(docs, labels, counted=fold.isin(0, 1), calibrated=fold == 3)
    return toxicity.score(docs, model, weights, name)


TOXIC_AT = 0.3


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxic_scores(spark, docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (toxicity.fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "sources", "chars_deleted")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    uri, manifest = token_store.write(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return token_store.documents(spark, uri, manifest)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz_fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    rows = rows.union(spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema))
    return chat.digest(chat.format_events(chat.turns_as_streamed(rows)))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (op1_simhash_near_dedup, op2_html_text, op3_secret_scan, op4_toxicity, op5_line_dedup, op6_token_store, op7_packing, op8_lz_fingerprint, op9_chat_format, op10_decontaminate)
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scan": secrets.oracle()}
