"""Continuous import: session files that change become rows of the ledger while the stream runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.sync import BUCKETS, sync
from .upload import POLL


def import_stream(
    spark: SparkSession, sources: dict[str, str], prices: DataFrame, path: str, checkpoint: str, now: Callable[[], int], once: bool = False, buckets: int = BUCKETS
) -> StreamingQuery:
    """A stream of ticks, each of which lists the session files and imports those that changed; ``once`` runs a tick and ends.

    The stream itself carries no rows: what has been imported is in the tables'
    own state, so a tick that is run again after a failure finds what is missing.
    """
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    writer = ticks.writeStream.foreachBatch(lambda df, i: sync(spark, sources, prices, path, now(), buckets) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()
