"""A corpus pipeline of five of the training-data operators, each stage written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmeter.llm import byte_bpe as bpe
from quillmeter.llm.common import discard, table, vocabulary_path, written
from quillmeter.llm.line_dedup import line_dedup
from quillmeter.llm.near_dedup import near_dedup
from quillmeter.llm.source_mix import mix_documents
from quillmeter.llm.toxicity import toxicity

SEED = "pipeline-1"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    return toxicity(docs, table(spark, sf_dir, "labels")).filter("predicted = 0").select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the lines that others hold too; n_chars follows the text."""
    kept = line_dedup(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id; a null id names no class and stays."""
    gone = near_dedup(docs).filter("NOT kept").select(F.col("doc_id").alias("gone_id"))
    return docs.join(gone, F.col("doc_id") == F.col("gone_id"), "left_anti")


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, left out or repeated so that each source comes near its target; those without a word stay."""
    mixed = mix_documents(docs, seed=SEED).filter("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (unsigned 32-bit little-endian), restored: whether the ids decode to the text."""
    carry = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    return bpe.byte_bpe(docs, vocabulary_path(bpe.VOCABULARY), bpe.default_pattern(), carry=carry, give=("ids", "restored"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("near-duplicate removal", keep_one_of_near_copies),
    ("source mix", mix_to_targets),
    ("byte-level BPE", encode),
]

#: The first stage is a trained classifier, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs, path = written(stage(spark, docs, sf_dir))
        discard(spark, *before)  # nothing reads it any more
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
