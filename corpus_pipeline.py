"""The corpus pipeline: quality rules, near-dedup, suffix-array dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each as Parquet to the shared folder and reads it again as the next one's
docs.  All stages but the last return the columns of their input.

Stages that choose rows number them first, so rows with null or repeated ids
are documents of their own: none is dropped or kept for its id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrain.llm import minhash_dedup, packing, quality_rules, source_mixing, suffix_dedup
from pagegrain.llm._text import written
from pagegrain.llm.queries import vocabulary_path

#: Bytes of a passage that suffix-array dedup takes for a copy: about fifty words.
PASSAGE, PASSAGE_GRAM = 256, 64


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a row number, written, so that every later reading sees the same ones; and the number's name."""
    row = "row"
    while row in docs.columns:
        row += "_"
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered"), row


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go.  The rules see a row at a time, so the verdict rides along with the row."""
    return quality_rules.keep_rows(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: its first row.  Texts without words stay."""
    numbered, row = _numbered(docs)
    found = minhash_dedup.near_duplicates(numbered, id_col=row).filter("kept").select(F.col("doc_id").alias(row))
    return numbered.join(found.hint("shuffle_hash"), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages go from the texts, whole characters only; n_chars follows."""
    return suffix_dedup.cut_rows(docs, length=PASSAGE, k=PASSAGE_GRAM)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; those taken no time go."""
    numbered, row = _numbered(docs)
    taken = source_mixing.mix_sources(numbered, id_col=row).filter("copies > 0")
    taken = taken.select(F.col("doc_id").alias(f"{row}_of"), F.col("copies").cast("int").alias(f"{row}_copies"))
    joined = numbered.join(taken.hint("shuffle_hash"), F.col(row) == F.col(f"{row}_of"))
    many = joined.withColumn(row, F.explode(F.sequence(F.lit(1), F.col(f"{row}_copies"))))
    return many.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 1024 tokens: a row for each piece, with its ids."""
    return packing.pack(docs, vocabulary_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_dedup_stage),
    ("mixing sources", mixing_stage),
    ("packing", packing_stage),
]

#: Compression, MinHash and tokenizing are beyond SQL; tests/llm/test_queries.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
