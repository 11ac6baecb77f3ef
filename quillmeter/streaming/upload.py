"""Continuous upload: a file stream of ledger rows into an idempotent store.

The store is a snapshot table: accepted events by day, the index of their keys
and their partial sums, and how far each stream has come, all made visible by one commit.  A
micro-batch that is replayed after a failure finds itself recorded or starts
anew from what is visible; a reader sees all days of a batch or none.  Whether an
event is stored is asked of the key index, so its day does not matter: the time
of a request may change when a ledger is rebuilt.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.usage import event_id
from ..operators.ingest import dispositions
from ..operators.key_index import index_tables, known_keys, with_keys
from ..operators.partials import EVENTS, PARTIALS, with_partials
from ..schema import STORED_EVENTS, USAGE_EVENTS, conform, with_event_date, with_event_defaults
from ..sources.shared import read_pointer, remove_folder, write_pointer
from ..sources.tables import BATCH, drain_batches
from ..sources.snapshots import Conflict, Snapshots, manifest_parts, merged_run

POLL = "5 seconds"
#: Rows from which a part of the store is merged with no other any more; how often a batch is tried against other writers.
MOST_ROWS, ATTEMPTS = 50_000_000, 5


class UploadRefused(ValueError):
    """A micro-batch that the store does not take as a whole; the stream does not move past it."""


def stored(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """All accepted events of a store at a version (the latest unless told), with event_date, their partition; an empty frame where there is none yet."""
    table = Snapshots(spark, store)
    return table.read(EVENTS, STORED_EVENTS, table.manifest(version))


def accept(batch: DataFrame, batch_id: int | None, store: str, now: int, stream: str = "", facts: dict | None = None) -> dict[str, int]:
    """Stores the new events of a stream's micro-batch and gives counts; one that is recorded already is not run again.  A batch_id of None is always run.

    Events without an id's parts or a time are rejected, and then nothing is
    stored.  Where another writer comes first, the batch is compared anew with what that one stored.
    """
    table = Snapshots(batch.sparkSession, store)
    for attempt in range(ATTEMPTS):
        try:
            return _accept(table, batch, batch_id, now, stream, facts or {})
        except Conflict:
            if attempt == ATTEMPTS - 1:
                raise
    raise AssertionError("unreachable")


def _accept(table: Snapshots, batch: DataFrame, batch_id: int | None, now: int, stream: str, facts: dict) -> dict[str, int]:
    base = table.manifest()
    done = base["facts"].get("streams", {})
    if batch_id is not None and stream in done and batch_id <= done[stream]["batch_id"]:
        return done[stream]["counts"]
    rows = with_event_date(with_event_defaults(batch).withColumn("event_id", event_id()).withColumn("seq", F.struct("created_at", "request_id")))
    unusable = F.col("node_id").isNull() | F.col("request_id").isNull() | F.col("created_at").isNull()
    sent, rejected = rows.agg(F.count(F.lit(1)), F.count_if(unusable)).first()
    if rejected:
        raise UploadRefused(f"{rejected} of {sent} usage events are rejected")
    known = known_keys(table, base, rows.select(F.col("event_id").alias("key"))).withColumnRenamed("key", "event_id")
    new = dispositions(known, rows).filter("disposition = 'accepted'").withColumn("received_at", F.lit(now).cast("long"))
    folder = table.write(with_event_date(conform(new, USAGE_EVENTS)).hint("rebalance", "event_date"), EVENTS, ("event_date",))
    accepted = table.read_parts([{"folder": folder}], STORED_EVENTS).count()  # from the files' footers
    counts = {"sent": sent, "accepted": accepted, "duplicates": sent - accepted, "rejected": 0}
    tables = {}
    if accepted:
        part = {"folder": folder, "rows": accepted}
        stored_now = table.read_parts([part], STORED_EVENTS)
        keys = with_keys(table, base, stored_now.select(F.col("event_id").alias("key")), accepted)
        sums = with_partials(table, base, stored_now, accepted)
        tables = {EVENTS: _merged(table, manifest_parts(base, EVENTS), part), PARTIALS: sums} | index_tables(keys)
    else:
        remove_folder(table.spark, f"{table.path}/{folder}")
    streams = {} if batch_id is None else {"streams": done | {stream: {"batch_id": batch_id, "counts": counts}}}
    table.commit(base, tables, facts | streams)
    return counts


def _merged(table: Snapshots, before: list[dict], part: dict) -> list[dict]:
    """The parts with a new one, into which smaller ones before it are rewritten: few files stay, and each row is rewritten seldom."""
    n = merged_run(before, part["rows"], MOST_ROWS)
    if not n:
        return [*before, part]
    small = [*before[len(before) - n :], part]
    folder = table.write(table.read_parts(small, STORED_EVENTS).hint("rebalance", "event_date"), EVENTS, ("event_date",))
    return [*before[: len(before) - n], {"folder": folder, "rows": sum(p["rows"] for p in small)}]


def drain(logs: DataFrame, store: str, now: int, overlap_seconds: int = 0, size: int = BATCH) -> dict:
    """Uploads all rows of a ledger behind the store's cursor, from ``overlap_seconds`` before it, in one pass and one commit with the new cursor.

    The result is that of uploading batch after batch of ``size`` rows: how many
    were sent, accepted and known, in how many batches, and whether the cursor moved.
    """
    spark = logs.sparkSession
    base = Snapshots(spark, store).manifest()
    cursor = tuple(base["facts"].get("cursor", (0, "")))
    batches = drain_batches(logs, cursor, overlap_seconds, size)
    sent, n, last = batches.agg(F.count(F.lit(1)), F.max("batch_no"), F.max(F.struct("created_at", "request_id"))).first()
    if not sent:
        return {"sent": 0, "accepted": 0, "duplicates": 0, "rejected": 0, "batches": 0, "cursor": cursor, "cursor_advanced": False}
    new = max(cursor, tuple(last))
    counts = accept(batches.drop("batch_no"), None, store, now, facts={"cursor": list(new)})
    return counts | {"batches": n + 1, "cursor": new, "cursor_advanced": new > cursor}


def stream_name(spark: SparkSession, checkpoint: str) -> str:
    """The name under which the store knows a stream: it lives with the checkpoint, so a new checkpoint is a new stream."""
    at = f"{checkpoint.rstrip('/')}/stream-name"
    name = read_pointer(spark, at)
    if name is None:
        name = uuid.uuid4().hex
        write_pointer(spark, at, name)
    return name


def upload_stream(spark: SparkSession, ledger: str, schema, store: str, checkpoint: str, now: int, once: bool = False, files_per_batch: int = 100) -> StreamingQuery:
    """Starts the stream from a folder of ledger files; ``once`` takes what is there and ends."""
    name = stream_name(spark, checkpoint)
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(ledger)
    writer = rows.writeStream.foreachBatch(lambda df, i: accept(df, i, store, now, name) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream's events once each, with state for late ones bounded by the watermark (column ts)."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def settled(events: DataFrame, now: int, seconds: int = 60) -> DataFrame:
    """Events old enough to be final; younger ones wait for a later read."""
    return events.filter(F.col("created_at") <= now - seconds)


def streaming_trend(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests by time window of a stream (column ts), each window given once it is final."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("total_requests"))
