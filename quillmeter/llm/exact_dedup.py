"""Exact deduplication through recipes of content-defined chunks.

A text is cut where its own content says so: a chunk ends behind the first
window that matches ``BOUNDARY`` at least ``MIN_CHUNK`` code points after the
last cut, and at ``MAX_CHUNK`` at the latest.  Equal texts get equal cuts, and
an edit moves only the cuts near it.  Each distinct chunk is moved once (after
a map-side merge) to the dictionary, which checks that its identifier, the
chunk's SHA-256, names one content only; a second content under the same
identifier stops the job rather than merging texts.  Documents then travel as
their ordered lists of verified identifiers, about 32 bytes for each chunk, and
two texts are equal when the lists are.

Only built-in functions are used.  No step holds a group's rows together:
counts and minima are merged before the shuffle, and a frequent chunk or a
large group of copies meets one dictionary or group row in a join whose skewed
side Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

MIN_CHUNK, MAX_CHUNK = 512, 2048
#: Ends a chunk: some characters of context, met once in some dozens of characters, whatever the script: Latin words, ends of words of other
#: scripts, some characters of scripts without spaces, and letters and digits of unbroken strings.
BOUNDARY = r"(?:[aeioudnst][nst.,] [a-m]|\P{ASCII}[ \p{P}]|[\u4E00-\u53FF\u3040-\u3057\uAC00-\uB1FF\u0E01-\u0E0F]|[0-9][A-M][0-9A-Za-z]|[AEIOUaeiou][b-dB-D][a-eA-E][f-pF-P0-9])"
CHUNK = f"(?s).{{{MIN_CHUNK},{MAX_CHUNK - 4}}}?{BOUNDARY}|.{{1,{MAX_CHUNK}}}"


def normalised(text: str | Column = "text") -> Column:
    """Each run of white space as one space.  Single spaces, nearly all of them, need no replacement."""
    return F.regexp_replace(whole_text(text), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def chunks(text: Column) -> Column:
    """The chunks of a text in order; the empty text is one empty chunk."""
    return F.when(text == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(text, F.lit(CHUNK), 0))


def verified(content_low: Column, content_high: Column, chunk_id: Column) -> Column:
    """The identifier, once all contents seen under it are one."""
    return F.when(content_low == content_high, chunk_id).otherwise(
        F.raise_error(F.lit("two different chunks have one identifier")).cast("binary")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, n_chunks.

    Null and empty texts are equal to each other and to no text with content.
    Of equal texts the smallest id stays.  Every row counts and comes back, also
    one that repeats another; rows that repeat the id that stays all stay.
    A null id sorts after all others, so it stays only where
    every id of its group is null.  Other columns are ignored.
    """
    text = normalised(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    pieces = base.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.posexplode(chunks(F.col("text"))).alias("pos", "chunk")).select(
        "doc_id", "text_sha256", "pos", "chunk", F.unhex(F.sha2("chunk", 256)).alias("chunk_id")
    )
    dictionary = pieces.groupBy("chunk_id").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"))
    dictionary = dictionary.select(F.col("chunk_id").alias("known_id"), verified(F.col("low"), F.col("high"), F.col("chunk_id")).alias("verified_id"))
    placed = pieces.select("doc_id", "text_sha256", "pos", "chunk_id").join(dictionary, F.col("chunk_id") == F.col("known_id"))
    recipes = placed.groupBy("doc_id", "text_sha256").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("pos", "verified_id"))), lambda p: p["verified_id"]).alias("recipe"), F.count_if(F.col("pos") == 0).alias("times")
    )
    groups = recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.sum("times").alias("group_size"))
    groups = groups.withColumnRenamed("recipe", "group_recipe")
    recipes = recipes.join(groups, F.col("recipe") == F.col("group_recipe"))
    recipes = recipes.withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return recipes.select(
        F.col("doc_id"),
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )
