"""Writes to the central store, each as a function from DataFrames to DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.usage import rollup_key
from ..schema import ROLLUP_DIMENSIONS, ROLLUP_MEASURES, USAGE_EVENTS, with_event_defaults
from ..sources.shared import shared_table

SCHEMA_VERSION, MAX_BATCH, MAX_PROVIDERS = 1, 1000, 10_000


class InvalidSnapshot(ValueError):
    """A provider snapshot that is refused as a whole."""


def validate_batches(batches: DataFrame) -> DataFrame:
    """Adds valid to rows with batch_id, batch_node_id, schema_version and node_id.

    A batch holds if its version is 1, it has 1,000 events at most and all of
    them are its node's; otherwise every event of it is rejected.
    """
    fits = F.coalesce((F.col("schema_version") == SCHEMA_VERSION) & (F.col("node_id") == F.col("batch_node_id")), F.lit(False))
    facts = batches.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.bool_and(fits).alias("fits"))
    facts = facts.select(F.col("batch_id").alias("checked"), (F.col("fits") & (F.col("n") <= MAX_BATCH)).alias("valid"))
    return batches.join(facts, F.col("batch_id").eqNullSafe(F.col("checked"))).drop("checked")


def dispositions(store: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` (with a column seq, its order) and disposition: accepted or duplicate, where event ids follow from node and request.

    An event is a duplicate if the store has it or an earlier row of the batch
    brought it.  Ids are ``node:request``, so node ``a:b`` with request ``c`` and
    node ``a`` with request ``b:c`` meet; the id decides.
    """
    known = store.select(F.col("event_id").alias("known_id")).distinct()
    first = Window.partitionBy("event_id").orderBy("seq")
    marked = batch.withColumn("turn", F.row_number().over(first)).join(known, F.col("event_id") == F.col("known_id"), "left")
    duplicate = F.col("known_id").isNotNull() | (F.col("turn") > 1)
    return marked.withColumn("disposition", F.when(duplicate, "duplicate").otherwise("accepted")).drop("turn", "known_id")


def dispositions_of_batches(store: DataFrame, batch: DataFrame) -> DataFrame:
    """As ``dispositions`` for any ids: an event is a duplicate if its id or its (node, request) is stored or was accepted before.

    The order is that of batch_id and seq, over all batches.  A duplicate does
    not block later rows, so rows are decided in rounds: one that is the first
    undecided of its id and of its (node, request) is accepted, and its fellows
    are duplicates.  Two rounds do, but where ids and requests cross.
    """
    order, pair = ["batch_id", "seq"], ["node_id", "request_id"]
    ids = store.select(F.col("event_id").alias("k_id")).distinct()
    pairs = store.select(*[F.col(c).alias(f"k_{c}") for c in pair]).distinct()
    marked = batch.join(ids, F.col("event_id") == F.col("k_id"), "left")
    marked = marked.join(pairs, (F.col("node_id") == F.col("k_node_id")) & (F.col("request_id") == F.col("k_request_id")), "left")
    stored = F.col("k_id").isNotNull() | F.col("k_node_id").isNotNull()
    marked = marked.select(*[batch[c] for c in batch.columns], F.when(stored, "duplicate").alias("disposition"))
    # Only rows that are still open go into the next round; the table of a round keeps those it decided.
    decided = []
    while True:
        marked = shared_table(marked)
        decided.append(marked.filter("disposition IS NOT NULL"))
        marked = marked.filter("disposition IS NULL")
        if marked.isEmpty():
            return reduce(DataFrame.unionAll, decided)
        first = [F.min(F.struct(*order)).over(Window.partitionBy(*key)) for key in (["event_id"], pair)]
        marked = marked.withColumns({"first_id": first[0], "first_pair": first[1]})
        marked = marked.withColumn("takes", (F.struct(*order) == F.col("first_id")) & (F.struct(*order) == F.col("first_pair")))
        met = [F.max("takes").over(Window.partitionBy(*key)) for key in (["event_id"], pair)]
        marked = marked.withColumn("met", met[0] | met[1])
        marked = marked.select(*batch.columns, F.when(F.col("takes"), "accepted").when(F.col("met"), "duplicate").alias("disposition"))


def ingest_batch(store: DataFrame, batch: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(rows to append, dispositions) of a batch in the store's schema, or of several batches.

    Rows with batch_id, batch_node_id and schema_version are validated as their
    batches are; all events of an invalid one are rejected and stored nowhere.
    """
    rows, rejected = with_event_defaults(batch), None
    if {"batch_id", "batch_node_id", "schema_version"} <= set(batch.columns):
        rows = validate_batches(rows)
        rejected = rows.filter("NOT valid").select("event_id", "seq", F.lit("rejected").alias("disposition"))
        rows = rows.filter("valid").drop("valid")
        marked = dispositions_of_batches(store, rows)
    else:
        marked = dispositions(store, rows)
    accepted = marked.filter("disposition = 'accepted'").withColumn("received_at", F.lit(now).cast("long"))
    told = marked.select("event_id", "seq", "disposition")
    return accepted.select([c for c in USAGE_EVENTS.names if c in accepted.columns]), told if rejected is None else told.union(rejected)


def upsert_rollups(store: DataFrame, snapshots: DataFrame, now: int) -> DataFrame:
    """Snapshots (with seq) into the rollup store by key: measures are replaced by the last, dimensions keep the first."""
    snapshots = snapshots.withColumn("snapshot_key", rollup_key(ROLLUP_DIMENSIONS))
    by_key = Window.partitionBy("snapshot_key")
    last = snapshots.withColumn("turn", F.row_number().over(by_key.orderBy(F.desc("seq")))).filter("turn = 1")
    new = last.select("snapshot_key", *[F.col(c).alias(f"new_{c}") for c in ROLLUP_DIMENSIONS + ROLLUP_MEASURES])
    joined = store.select("snapshot_key", *ROLLUP_DIMENSIONS, *ROLLUP_MEASURES, "received_at").join(new, "snapshot_key", "full")
    arrived = F.col("new_request_count").isNotNull()
    return joined.select(
        "snapshot_key",
        *[F.coalesce(F.col(c), F.col(f"new_{c}")).alias(c) for c in ROLLUP_DIMENSIONS],
        *[F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) for c in ROLLUP_MEASURES],
        F.when(arrived, F.lit(now).cast("long")).otherwise(F.col("received_at")).alias("received_at"),
    )


def check_snapshot(entries: list[dict], schema_version: int) -> list[dict]:
    """A provider snapshot's entries, or why it is refused: 10,000 at most, none blank."""
    if schema_version != SCHEMA_VERSION or len(entries) > MAX_PROVIDERS:
        raise InvalidSnapshot("unsupported snapshot")
    if any(not (e.get(k) or "").strip() for e in entries for k in ("app_type", "provider_id", "name")):
        raise InvalidSnapshot("a provider entry is blank")
    return entries


def upsert_catalog(catalog: DataFrame, snapshot: DataFrame, now: int) -> DataFrame:
    """Provider names by (node, app, provider): the snapshot's last name wins, entries it lacks stay."""
    key = ["node_id", "app_type", "provider_id"]
    both = catalog.select(*key, "name", "updated_at", F.lit(-1).cast("long").alias("seq")).union(snapshot.select(*key, "name", F.lit(now).cast("long"), F.col("seq").cast("long")))
    newest = both.groupBy(*key).agg(F.max_by(F.struct("name", "updated_at"), "seq").alias("n"))
    return newest.select(*key, "n.name", "n.updated_at")
