"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor
kept and, but for the last, returns the columns of ``documents``. Stages are
written as Parquet to the shared folder and read again, so a lost executor
costs a stage's tasks and never the stages before.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import decontaminate, line_dedup, near, packing
from quadloom.llm.common import Scratch, free_name, sized, small_batches, stage, table
from quadloom.llm.queries import TOXIC_AT, toxic_scores

#: Near duplicates: a Jaccard similarity of SIMILAR between sets of five-word shingles. RADIUS is SimHash's share in
#: proposing them; pairs with more bits apart are proposed by MinHash bands (see near.py).
SHINGLE, RADIUS, SIMILAR = 5, 6, 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at TOXIC_AT or above go."""
    small_batches(spark)
    score = free_name("score", docs.columns)
    scored = toxic_scores(spark, docs, table(spark, sf_dir, "labels"), score)
    return scored.where(F.col(score) < TOXIC_AT).select(docs.columns)


def delete_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are deleted from the later; every document stays, ``n_chars`` follows."""
    small_batches(spark)
    found = line_dedup.dedup_lines(docs, sources=free_name("sources", docs.columns), deleted=free_name("chars_deleted", docs.columns))
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by a similarity of SIMILAR the one of the smallest doc_id stays (null: after all others); of
    those that share it, the longest text, then the least hash of the whole row. What still ties is the same row."""
    small_batches(spark)
    row, tie = free_name("row", docs.columns), free_name("tie", docs.columns)
    rows = stage(docs.withColumns({row: F.monotonically_increasing_id(), tie: F.xxhash64(*docs.columns)}), "numbered")
    groups = near.groups(rows, SHINGLE, RADIUS, SIMILAR, id_col=row)
    long_first = -F.length(F.coalesce("text", F.lit("")))
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), long_first.alias("c"), F.col(tie).alias("d"), F.col(row).alias("row"))
    first = rows.select(row, order.alias("order")).join(groups, row).groupBy("group").agg(F.min("order").alias("first"))
    return sized(rows.join(first.select(F.col("first.row").alias(row)), row, "left_semi").select(docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    small_batches(spark)
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens: a row for each piece of each document."""
    small_batches(spark)
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, with_ids=False)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", delete_repeated_lines),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can express neither the models nor the alignment; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what the stages before it wrote is deleted."""
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        for name, apply in STAGES[:-1]:
            docs = scratch.stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
            scratch.drop_all_but(1)
        name, apply = STAGES[-1]
        return stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
