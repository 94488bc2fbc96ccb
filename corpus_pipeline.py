"""From raw documents to packed training sequences, in five stages.

Each stage gets what the one before kept, as a DataFrame with the columns of
``documents``; all but the last return those columns. Nulls in other columns go through
as they are, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import decontaminate, exact_dedup, minhash, packing, quality
from quantloom.llm.shared import new_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, fitted on ``labels``, rejects. Null and empty texts are graded by their
    shape, repeated rows alike; labels with nulls that tell no grade are left out, and without labels all stay."""
    return quality.drop_poor(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts, white space aside: the row of the smallest id, one of equal rows. Null
    and empty texts are one group; a null id comes after all others."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of five-word shingles: the smallest id. Rows without words or
    without id stay, rows of one id stay or go together."""
    return minhash.drop_near_duplicates(docs, n=5, percent=80)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold four fifths of a test item's five-word shingles. Null and empty items match nothing;
    rows with a null id or an empty text stay."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece with its place in a sequence of 4096 tokens: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null
    or empty text is the end token alone; repeated rows are packed each."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("MinHash near-dedup", near_stage), ("benchmark decontamination", benchmark_stage), ("best-fit packing", packing_stage)]

#: No SQL: the classifier, the tokenizer and the packing can't be expressed; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
