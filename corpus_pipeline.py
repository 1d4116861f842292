"""Corpus pipeline: quality, near-duplicates, benchmark passages, personal data, tokens.

Each stage takes what its predecessor kept (columns of ``documents``) and leaves the work to its operator in
``braidflow.llm``. No stage knows how the others decide.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidflow.llm import bpe, decontaminate, pii, quality_classifier, simhash
from braidflow.llm.common import broadcast_if, discard, row_key, table, written
from braidflow.llm.queries import document_site

#: Keys (of 16 bytes) that may be broadcast.
FEW_ROWS = 500_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    found = quality_classifier.classify(docs, table(spark, sf_dir, "labels"), *document_site())
    return found.filter("kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group, that of the least ``doc_id``; rows that share a ``doc_id`` are judged each by its own text.

    Groups are those of ``op7`` (links of at most 3 bits), whether or not their rows have a ``doc_id``.
    """
    groups = simhash.near_duplicates(docs.select("doc_id", row_key(F.col("text")).alias("row"), "text"), carry=("row",))
    rows = written(groups.groupBy(F.col("component").alias("g"), "doc_id", "row").agg(F.count("*").alias("n")), "group-rows")
    at = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row", "n")
    kept = rows.groupBy("g").agg(F.min(at).alias("m")).select("m.doc_id", "m.row", "m.n")
    kept = kept.select(F.col("doc_id").alias("_k"), F.col("row").alias("_r"), "n")
    out = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_k")) & (F.col("row") == F.col("_r")), "left_anti").select(F.col("doc_id").alias("_k"), F.col("row").alias("_r"))
    repeated = kept.filter("n > 1").drop("n")
    # the keys of what goes are written and counted: if they are few, texts stay where they are
    gone = broadcast_if(written(out.unionByName(repeated), "group-gone"), FEW_ROWS)
    repeated = broadcast_if(written(repeated, "group-repeated"), FEW_ROWS)
    keyed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("_key"), row_key(F.col("text")).alias("_row"))  # so that no name can clash
    same = F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_row") == F.col("_r"))
    single = keyed.join(gone, same, "left_anti")
    return single.unionByName(keyed.join(repeated, same, "left_semi").dropDuplicates(["_key", "_row"])).select("doc.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold too much of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; every document stays."""
    return pii.mask(docs, "text", "n_chars")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, token ids, their number and digests."""
    return bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("quality_classifier", quality),
    ("simhash", near_duplicates),
    ("decontaminate", decontaminated),
    ("pii", private),
    ("bpe", tokens),
]

#: The classifier, XXH64 and BPE are not expressible in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet, read again by the next, and deleted after that one's."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
