"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: The white space of every contract: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(text: str | Column = "text") -> Column:
    """The text, a null one counting as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else: ``lower`` also folds other scripts, so it serves pure ASCII only."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def in_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``most`` bytes of this text column (a longer text alone) and so many rows: a worker holds little at a time."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(ends):
            before = ends[start - 1] if start else 0
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + most, "right"))))
            yield batch.slice(start, stop - start)
            start = stop


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, which cuts its lineage; and that table's path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quillmeter-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def vocabulary_path(name: str) -> str:
    """Where the installed public vocabulary files have this one; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
