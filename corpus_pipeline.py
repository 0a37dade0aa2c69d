"""A corpus from raw documents to packed sequences: each stage is an operator of ``abyssal.llm``, written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abyssal.llm import decontaminate, langid, packing, simhash, substring
from abyssal.llm.common import stage

#: Near-duplicates: five-word shingles at a similarity of 0.8.  15 masks nominate all pairs up to three bits; sketches nominate the copies that lie further apart.
SHINGLE, RADIUS, JACCARD = 5, 3, 0.8
#: The workers of earlier stages are still there: a smaller word cache than the operator's own.
CACHE_WORDS = 250_000


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a text or a letter go, and those like no language learnt.  A null language is filled in."""
    return langid.keep_identified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group; unlike texts stay, whatever ids repeat or are null."""
    return simhash.keep_first(docs, shingle=SHINGLE, radius=RADIUS, jaccard=JACCARD)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the windows that an earlier document has; a document that loses nothing keeps its text as it is, one that loses all goes.  Rows of one id are one document; null ids come last."""
    names = docs.columns
    spans = substring.repeated_spans(docs, carry=tuple(c for c in names if c not in ("doc_id", "text")), verbatim=True)
    touched = F.size("starts") > 0
    new = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept_text")}
    if "n_chars" in names:
        new["n_chars"] = F.when(touched, F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))
    kept = spans.where(~touched | (F.col("kept_text") != ""))
    return kept.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in names])


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages.  A row is told by its id and text: copies go together, others of its id stay."""
    row = F.xxhash64("doc_id", "text")
    found = decontaminate.contamination(docs.select(row.alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = found.where("contaminated").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, row == F.col("_gone"), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences of 4096; every row is packed."""
    return packing.pack(docs, cache_words=CACHE_WORDS)


STAGES = [("language ID", identified), ("SimHash near-dedup", distinct), ("substring dedup", unrepeated), ("benchmark decontamination", uncontaminated), ("packing", packed)]

#: Language identification is a fitted model: SQL can't express it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, "corpus")
    return docs
