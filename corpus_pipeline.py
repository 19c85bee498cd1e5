"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlake.llm import line_dedup, near_dedup, packing, quality
from outlake.llm.common import save
from outlake.llm.queries import tokenizer_file


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null, empty and short texts go (fewer than 50 words); texts of any length are read whole; null languages and sources
    are groups of their own; ties and repeated rows are judged row by row; an empty table stays empty; all columns stay
    as they are, whatever their names.
    """
    return quality.quality_filter(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier one go; documents that lose all their lines with words go with them.

    Null and empty texts and rows with a null id stay as they are; lines of any length are compared whole; of equal lines
    the one with the smallest id and place stays; repeated rows are treated alike; an empty table stays empty; all other
    columns stay, but ``n_chars`` is counted again.
    """
    kept = line_dedup.line_dedup(docs).where(~((F.col("lines.n_removed") > 0) & ~F.col("doc.text").rlike(r"[^\x20\x09-\x0D]")))
    kept = kept.select("doc.*")
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns) if "n_chars" in docs.columns else kept


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id.

    Null and empty texts and rows with a null id match nothing and stay; texts of any length are compared whole; repeated
    rows of an id that stays all stay; an empty table stays empty; all columns stay as they are, whatever their names.
    """
    return near_dedup.near_dedup(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, each with its sequence and its place there.

    Null and empty texts give one piece with the end id; texts of any length are tokenised whole and cut; null ids are
    carried along; ties and repeated rows are packed once for each row; an empty table gives no pieces; other columns go.
    """
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("quality rules", quality_stage), ("line dedup", line_dedup_stage), ("MinHash near-dedup", near_dedup_stage), ("best-fit packing", packing_stage)]

#: SQL can't express the tokenizer; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = save(docs)
    return docs
