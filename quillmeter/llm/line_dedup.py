"""Removal of lines that many documents share.

Lines are exploded with their positions and identified by 128 bits of the
SHA-256 of their normalised form, so the shuffles that count documents carry
24 bytes a line and no text.  The decision comes back as the positions to drop
of each document, and the text is put together again from the positions left.

Only built-in functions are used.  A line that a third of all documents hold is
merged map-side before each count, and meets its single row of the decision
table in a join whose skewed side Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, ascii_lower, whole_text

MIN_KEY_CHARS, MIN_DOCS = 20, 3


def line_key(line: Column) -> Column:
    """A line's normal form: white space stripped at both ends, A-Z lower-cased."""
    return ascii_lower(F.trim(line, F.lit(SPACE_CHARS)))


def line_hash(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def dropped_positions(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, version, dropped): the positions that go, for documents that lose a line.  docs: doc_id, version, text."""
    lines = docs.select("doc_id", "version", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.select("doc_id", "version", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    lines = lines.select("doc_id", "version", "pos", line_hash(F.col("key")).alias("line_id"))
    holders = lines.groupBy("line_id", "doc_id").agg(F.lit(1).alias("one"))
    common = holders.groupBy("line_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")).filter(F.col("n_docs") >= min_docs)
    common = common.select(F.col("line_id").alias("common_id"), "last_doc")
    hit = lines.join(common, F.col("line_id") == F.col("common_id")).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    return hit.groupBy("doc_id", "version").agg(F.collect_set("pos").alias("dropped"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_KEY_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All columns of ``docs``, the text without dropped lines, then n_lines and n_dropped (which replace columns of those names).

    A line whose key has at least ``min_chars`` code points and is found in at
    least ``min_docs`` documents stays only in the document with the largest id
    that holds it, there at each of its places.  A null or empty text is one
    empty line and comes back as the empty text.  Documents are told apart by
    id: rows that repeat an id count once towards ``min_docs`` and share its
    fate.  A null id is a document too, and sorts before all others.
    """
    text = whole_text(text_col)
    # Rows that repeat an id are told apart by their texts, so each keeps its own positions.
    base = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("version"), text.alias("text"))
    drop = dropped_positions(base.select("doc_id", "version", "text"), min_chars, min_docs)
    drop = drop.select(F.col("doc_id").alias("drop_doc"), F.col("version").alias("drop_version"), "dropped")
    joined = base.join(drop, F.col("doc_id").eqNullSafe(F.col("drop_doc")) & (F.col("version") == F.col("drop_version")), "left")
    n = F.size(F.split("text", "\n"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped")), lambda i: F.get(F.col("lines"), i))
    joined = joined.withColumn("lines", F.when(F.col("dropped").isNotNull(), F.split("text", "\n")))
    left = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.concat_ws("\n", kept))
    carried = [left.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *carried, n.cast("long").alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped")
    )
