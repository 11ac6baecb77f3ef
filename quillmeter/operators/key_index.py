"""Which keys a store has, whatever day they were stored: keys in hash buckets, and a Bloom filter for each.

The index belongs to a snapshot table and changes with it in one commit.  A
commit adds a part; smaller parts before it are merged into it, so there are few.
A look-up asks the filters first and then reads only the buckets in which one of
its keys may be, and of these only the key column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from ..sources.snapshots import Snapshots, bucket_column, manifest_parts, merged_run

KEYS, BLOOMS = "keys", "blooms"
#: Keys of a bucket, as buckets are powers of two; the most buckets of a part; bits of a filter for each key; rows from which a part is merged no more.
BUCKET_KEYS, MOST_BUCKETS, BITS_A_KEY, MOST_ROWS = 1 << 20, 1024, 16, 1 << 30
#: Bits of one bitmap that Spark's bitmap functions build.
BITMAP = 32_768
KEY_SCHEMA = StructType([StructField("key", StringType()), StructField("bucket", IntegerType())])
BLOOM_SCHEMA = StructType([StructField("bucket", IntegerType()), StructField("piece", LongType()), StructField("bitmap", BinaryType())])


def buckets_for(rows: int, bucket_keys: int = BUCKET_KEYS) -> int:
    return min(MOST_BUCKETS, 1 << max(0, (rows - 1) // bucket_keys).bit_length())


def _places(key: str, pieces: int) -> Column:
    """Two bits of a bucket's filter (of so many bitmaps) for a key, from the hash's upper and a second hash's bits."""
    bits = F.lit(pieces * BITMAP)
    return F.array(F.pmod(F.shiftrightunsigned(F.xxhash64(key), 20), bits), F.pmod(F.xxhash64(F.lit("2"), key), bits))


def bloom_of(keys: DataFrame, pieces: int) -> DataFrame:
    """(bucket, piece, bitmap) of keys (key, bucket): a bucket's filter has so many bitmaps."""
    bits = keys.select("bucket", F.explode(_places("key", pieces)).alias("at"))
    return bits.groupBy("bucket", F.floor(F.col("at") / BITMAP).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bitmap"))


def may_have(store: Snapshots, part: dict, probe: DataFrame) -> DataFrame:
    """(key, bucket) of the keys that a part's filter does not rule out."""
    asked = probe.select("key", bucket_column("key", part["of"]).alias("bucket"), F.explode(_places("key", part["pieces"])).alias("at"))
    asked = asked.select("key", "bucket", F.floor(F.col("at") / BITMAP).alias("piece"), (F.col("at") % BITMAP).alias("bit"))
    held = store.read_parts([{"folder": part["bloom"]}], BLOOM_SCHEMA).select(F.col("bucket").alias("b"), F.col("piece").alias("p"), "bitmap")
    met = asked.join(held, (F.col("bucket") == F.col("b")) & (F.col("piece") == F.col("p")))
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.expr("shiftright(byte, CAST(bit % 8 AS INT)) & 1") == 1
    return met.select("key", "bucket", "bit", byte.alias("byte")).filter(hit).groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("key", "bucket")


def known_keys(store: Snapshots, manifest: dict, keys: DataFrame) -> DataFrame:
    """The distinct keys (column key) that are in the index at a version."""
    probe = keys.select("key").filter("key IS NOT NULL").distinct()
    found = None
    for part in manifest_parts(manifest, KEYS):  # their number grows with the logarithm of the keys
        hits = [r.bucket for r in may_have(store, part, probe).select("bucket").distinct().collect()]  # MOST_BUCKETS rows at most
        held = sorted({str(b) for b in hits} & set(part["buckets"]))
        if held:
            met = probe.join(store.read_parts([part], KEY_SCHEMA, {"bucket": held}).select("key"), "key", "left_semi").select("key")
            found = met if found is None else found.unionAll(met)
    return (found if found is not None else probe.limit(0)).distinct()


def with_keys(store: Snapshots, manifest: dict, keys: DataFrame, rows: int, bucket_keys: int = BUCKET_KEYS) -> list[dict]:
    """The index's parts with these new keys, so many rows, for the next commit: they are written, but no version has them yet."""
    keys = keys.select("key")
    before = manifest_parts(manifest, KEYS)
    merged = merged_run(before, rows, MOST_ROWS)
    kept, small = before[: len(before) - merged], before[len(before) - merged :]
    if small:
        keys = keys.unionByName(store.read_parts(small, KEY_SCHEMA).select("key"))
        rows += sum(p["rows"] for p in small)
    n = buckets_for(rows, bucket_keys)
    pieces = max(1, -(-rows * BITS_A_KEY // (n * BITMAP)))
    folder = store.write(keys.withColumn("bucket", bucket_column("key", n)).repartition(n, "bucket"), KEYS, ("bucket",))
    written = store.read_parts([{"folder": folder}], KEY_SCHEMA)
    bloom = store.write(bloom_of(written, pieces).hint("rebalance"), BLOOMS)
    buckets = store.values(folder, "bucket")
    return [*kept, {"folder": folder, "bloom": bloom, "rows": rows, "of": n, "pieces": pieces, "buckets": buckets}]


def index_tables(parts: list[dict]) -> dict[str, list[dict]]:
    """The tables of the manifest that the index's parts make: the keys, and the filters for the collector to know."""
    return {KEYS: parts, BLOOMS: [{"folder": p["bloom"]} for p in parts]}
