"""Usage questions over the event store from partial sums: raw rows are read at the ends of the range only.

Every batch that the store accepts adds the sums of its events by quarter hour
and by what a question can filter or group, in the commit that makes the events
visible.  Sums of sums are sums, so parts are added up when they are read and
merged as they grow.  Local days of every time zone begin at a quarter hour.
"""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType

from ..plans.params import FILTERS, Query
from ..schema import STORED_EVENTS
from ..sources.snapshots import Snapshots, manifest_parts, merged_run
from . import analytics as A

EVENTS, PARTIALS = "events", "partials"
#: Seconds that a row of partial sums covers; events that a part covers from which it is merged with no other any more.
SPAN, MOST_EVENTS = 900, 500_000_000
KEYS = ["event_date", "created_at", *FILTERS]
SUMS = StructType([
    StructField("event_date", DateType()), StructField("created_at", LongType()), *[StructField(c, StringType()) for c in FILTERS],
    *[StructField(c, DoubleType() if c == "cost" else LongType()) for c in ("n", *A.SUMS, "first_at", "last_at")],
])


def _added() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in ("n", *A.SUMS)], F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")]


def partial_sums(events: DataFrame) -> DataFrame:
    """The sums of events (with event_date), a row a quarter hour (created_at: its start) and combination of what can be filtered."""
    rows = A.measured(events).withColumn("quarter", F.floor(F.col("created_at") / SPAN) * SPAN)
    sums = rows.groupBy("event_date", "quarter", *FILTERS).agg(*A.group_sums()).withColumnRenamed("quarter", "created_at")
    return sums.select(*[F.col(f.name).cast(f.dataType) for f in SUMS.fields])


def covered(manifest: dict) -> bool:
    """Whether a version's partial sums are those of all its events; a store from before they were kept has none."""
    events, partials = (sum(p["rows"] for p in manifest_parts(manifest, name)) for name in (EVENTS, PARTIALS))
    return events == partials


def with_partials(table: Snapshots, base: dict, events: DataFrame, rows: int) -> list[dict]:
    """The parts of partial sums with those of these new events, for the next commit.  Where events before them have none, theirs are made too."""
    before = manifest_parts(base, PARTIALS)
    if not covered(base):
        events, rows = table.read(EVENTS, STORED_EVENTS, base).unionByName(events), rows + sum(p["rows"] for p in manifest_parts(base, EVENTS))
        before = []
    n = merged_run(before, rows, MOST_EVENTS)
    small = before[len(before) - n :]
    sums = partial_sums(events)
    if small:
        sums = sums.unionByName(table.read_parts(small, SUMS)).groupBy(*KEYS).agg(*_added())
    folder = table.write(sums.hint("rebalance", "event_date"), PARTIALS, ("event_date",))
    return [*before[: len(before) - n], {"folder": folder, "rows": rows + sum(p["rows"] for p in small)}]


class StoredUsage:
    """The questions of ``analytics`` to one version of a store (the latest unless told); answers are the same but for the last digits of sums of doubles."""

    def __init__(self, spark: SparkSession, store: str, version: int | None = None):
        self.table = Snapshots(spark, store)
        self.manifest = self.table.manifest(version)
        self.events = self.table.read(EVENTS, STORED_EVENTS, self.manifest)

    def sums(self, query: Query) -> DataFrame:
        """Partial sums whose total is that of the range: kept ones of its whole quarter hours, made ones of the rest."""
        begin, end = -(-query.begin // SPAN) * SPAN, query.end // SPAN * SPAN
        if begin >= end or not covered(self.manifest):
            return partial_sums(A.in_range(self.events, query))
        whole = A.in_range(self.table.read(PARTIALS, SUMS, self.manifest), replace(query, begin=begin, end=end))
        ends = [replace(query, begin=a, end=b) for a, b in ((query.begin, begin), (end, query.end)) if a < b]
        return reduce(DataFrame.unionByName, [whole, *(partial_sums(A.in_range(self.events, q)) for q in ends)])

    def summary(self, query: Query) -> DataFrame:
        return A.summary_of(self.sums(query).agg(*_added()))

    def trend(self, query: Query) -> DataFrame:
        """Buckets that do not end at quarter hours, and those of a shorter time, are counted from the events."""
        seconds = query.bucket.seconds
        if seconds is not None and (seconds % SPAN or query.offset % SPAN):
            return A.trend(self.events, query)
        return A.trend_of(self.sums(query).groupBy(A.bucket_of(query).alias("bucket_start")).agg(*_added()), query)

    def breakdown(self, query: Query, dimension: str) -> DataFrame:
        return A.breakdown_of(self.sums(query).groupBy(dimension).agg(*_added()), dimension)

    def provider_breakdown(self, catalog: DataFrame, query: Query) -> DataFrame:
        return A.provider_breakdown_of(self.sums(query).groupBy(*A.PROVIDER_KEY).agg(*_added()), catalog)
