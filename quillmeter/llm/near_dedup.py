"""Near-duplicate classes of documents by banded weighted MinHash.

1. One pass over the texts makes each document's fingerprint, the keys of its
   bands and some bits of its signature (``dart_minhash``).  Documents with equal
   fingerprints are copies; from here on the smallest id among them stands for all.
2. Representatives that share a band key meet in that key's bucket.  The texts of
   those that meet others are read once more, for their cells.
3. In each of ``ROUNDS`` rounds the members of a bucket are compared with one
   pivot, the first by a hash of the id, so that the same pair recurs in many
   bands and is compared once.  Links join members to classes, and the next round
   looks only at buckets that hold several classes still, at members of another
   class than the pivot's.  In the last round all members of a bucket of ``SMALL``
   at most are pivots.
4. Where a larger bucket still holds several classes, all links between them are
   found by an exact join on their rarest cells (``links_between_classes``).
5. A comparison is the exact weighted Jaccard similarity of the shingles, for
   pairs whose signature bits leave it a chance (``NO_CHANCE``).
6. Pairs of at least ``SIMILARITY`` are links; classes are their components.

Tables that are read more than once are written to the shared folder.  Nothing
but counts reaches the driver.  With 32 bands of 5 rows a pair at 0.8 shares no
band once in 300,000 times.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dart_minhash as darts
from .common import discard, in_slices, whole_text, written
from .components import components, stars

SIMILARITY = 0.8
#: Buckets with several classes are paired off up to this size; pivots join up the bulk of others before the exact join.
SMALL, ROUNDS = 8, 2
#: Standard deviations below the expected agreement of bits at the sought similarity: one such pair in 10^10 agrees less.
NO_CHANCE = 6.4
PART, EPSILON = 256, 1e-6
#: Texts that a worker sketches at a time, by bytes and by number.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 1024


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_cells, fingerprint, bands, bits) of (doc_id, text); a text without words has 0 cells and no bands."""

    def run(batches):
        for batch in in_slices(batches, 1, SLICE_BYTES, SLICE_ROWS):
            own = darts.shingles(batch.column(1).to_pylist())
            sizes, values = own.sizes(), darts.signatures(own)
            bands = [keys if n else [] for keys, n in zip(darts.band_keys(values), sizes.tolist())]
            columns = [pa.array(sizes, pa.int64()), pa.array(darts.fingerprints(own), pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(list(darts.packed(values)), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_cells", "fingerprint", "bands", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_cells long, fingerprint binary, bands array<long>, bits array<long>")


def cell_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, cells) of (doc_id, text)."""

    def run(batches):
        for batch in in_slices(batches, 1, SLICE_BYTES, SLICE_ROWS):
            own = darts.shingles(batch.column(1).to_pylist())
            cells, ends = darts.unit_cells(own)
            cells = pa.ListArray.from_arrays(pa.array([0, *ends.tolist()], pa.int32()), pa.array(cells.view("int64")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(darts.fingerprints(own), pa.binary()), cells], ["doc_id", "fingerprint", "cells"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fingerprint binary, cells array<long>")


def least_agreement(similarity: float) -> float:
    """The number of signature bits on which similar texts agree at least, but for one pair in 10^10."""
    k = darts.BANDS * darts.ROWS
    mean, variance = (1 + similarity) / 2, (similarity * (1 - similarity) / 4 + (1 - similarity) / (4 * darts.BITS)) / k
    return k * darts.BITS * (mean - NO_CHANCE * math.sqrt(variance))


def _differing(a: str, b: str) -> Column:
    """On how many signature bits two differ."""
    words = range(darts.BANDS * darts.ROWS * darts.BITS // 64)
    parts = [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in words]
    return sum(parts[1:], parts[0])


def compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The distinct pairs (a, b) that have at least this weighted Jaccard similarity.  sets: doc_id, bits, cells."""
    bits_a, bits_b = (sets.select(F.col("doc_id").alias(f"{x}_id"), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    likely = pairs.distinct().join(bits_a, F.col("a") == F.col("a_id")).join(bits_b, F.col("b") == F.col("b_id"))
    most = darts.BANDS * darts.ROWS * darts.BITS - least_agreement(similarity)
    likely, likely_path = written(likely.filter(_differing("a_bits", "b_bits") <= most).select("a", "b"))
    of_a, of_b = (sets.select(F.col("doc_id").alias(f"{x}_id"), F.col("cells").alias(f"{x}_cells")) for x in "ab")
    joined = likely.join(of_b, F.col("b") == F.col("b_id")).join(of_a, F.col("a") == F.col("a_id"))
    joined = joined.withColumn("both", F.size(F.array_intersect("a_cells", "b_cells"))).withColumn("either", F.size("a_cells") + F.size("b_cells") - F.col("both"))
    links, _ = written(joined.filter(F.col("both") >= similarity * F.col("either")).select("a", "b"))
    discard(sets.sparkSession, likely_path)
    return links


def _alike_in_size(a: str, b: str, similarity: float):
    return F.least(a, b) >= similarity * F.greatest(a, b)


def mixed(met: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Members (key, doc_id, n_cells, class, n, head) of the buckets that ``classes`` (``stars``) leave in several classes: n members, of which head is one."""
    classed = met.withColumn("class", F.col("doc_id"))
    if classes is not None:
        classed = met.join(classes, F.col("doc_id") == F.col("u"), "left").select("key", "doc_id", "n_cells", F.coalesce("v", "doc_id").alias("class"))
    several = classed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), F.min("doc_id").alias("head")).filter("low <> high")
    return classed.join(several.select(F.col("key").alias("m_key"), "n", "head"), F.col("key") == F.col("m_key")).drop("m_key")


def joined_up(classes: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """``classes`` (``stars``), joined up by more links (a, b); links that are already within them are not gone through again."""
    if links.isEmpty():
        return classes
    return stars(links if classes is None else classes.select(F.col("u").alias("a"), F.col("v").alias("b")).union(links))


def similar_pairs(reps: DataFrame, docs: DataFrame, similarity: float) -> DataFrame | None:
    """(a, b): pairs that join up the representatives (doc_id, n_cells, fingerprint, bands, bits) found similar, each with its class's smallest.  docs: doc_id, text."""
    spark = docs.sparkSession
    members = reps.select("doc_id", "n_cells", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("shared_key"))
    met, met_path = written(members.join(shared, F.col("key") == F.col("shared_key")).select("key", "doc_id", "n_cells"))
    prints = reps.join(met.select(F.col("doc_id").alias("id")).distinct(), F.col("doc_id") == F.col("id")).select("id", F.col("fingerprint").alias("print"), "bits")
    sets = cell_sets(docs.join(prints.select("id"), F.col("doc_id") == F.col("id"), "left_semi"))
    sets = sets.join(prints, (F.col("doc_id") == F.col("id")) & (F.col("fingerprint") == F.col("print"))).dropDuplicates(["doc_id"])
    sets, sets_path = written(sets.select("doc_id", "bits", "cells"))

    classes, several = None, True
    for round_ in range(ROUNDS):
        rows, rows_path = written(mixed(met, classes))
        if rows.isEmpty():
            discard(spark, rows_path)
            several = False
            break
        small = (F.col("n") <= SMALL) if round_ == ROUNDS - 1 else F.lit(False)
        first = rows.filter(~small).groupBy("key").agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(round_)).alias("hash"), "doc_id", "n_cells", "class")).alias("first"))
        pivots = first.select(F.col("key").alias("p_key"), F.col("first.doc_id").alias("p"), F.col("first.n_cells").alias("p_n"), F.col("first.class").alias("p_class"))
        pivots = pivots.union(rows.filter(small).select("key", "doc_id", "n_cells", "class"))
        pairs = rows.join(pivots, (F.col("key") == F.col("p_key")) & (F.col("class") != F.col("p_class")) & _alike_in_size("p_n", "n_cells", similarity))
        new = compared(pairs.select(F.least("p", "doc_id").alias("a"), F.greatest("p", "doc_id").alias("b")), sets, similarity)
        classes = joined_up(classes, new)
        discard(spark, rows_path)
    if several:
        classes = joined_up(classes, links_between_classes(mixed(met, classes).filter(F.col("n") > SMALL), sets, similarity))
    discard(spark, met_path, sets_path)
    return None if classes is None else classes.select(F.col("u").alias("a"), F.col("v").alias("b"))


def links_between_classes(met: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): all links between members (doc_id, n_cells, class, head) of a bucket that are of different classes.  sets: doc_id, bits, cells.

    Buckets whose members are of several classes, joined up where they share a
    member, are groups.  Let R be the cells that more than half of a group
    holds and S(x) what x and R do not share.  x and y differ in |S(x)| +
    |S(y)| - 2 |S(x) & S(y)| cells, and may differ in c (|x| + |y|), where c is
    (1 - similarity) / (1 + similarity).  With s(x) = |S(x)| - c |x| they are
    similar if and only if S(x) and S(y) share (s(x) + s(y)) / 2 cells.  Where
    that is 0 or less with the member of least s, both are similar at once.  The
    others have to share cells with each partner, so they meet all members of
    other classes by the rarest cells of S; the places at which the first shared
    cell stands bound how many can be shared.
    """
    spark = sets.sparkSession
    met, met_path = written(met.select("doc_id", "n_cells", "class", "head"))
    if met.isEmpty():
        discard(spark, met_path)
        return met.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b")).limit(0)
    groups = components(met.select(F.col("doc_id").alias("a"), F.col("head").alias("b"))).select(F.col("node"), F.col("class_id").alias("group"))
    members, members_path = written(met.select("doc_id", "n_cells", "class").distinct().join(groups, F.col("doc_id") == F.col("node")).drop("node"))
    discard(spark, met_path)
    every = sets
    sets = members.join(sets.select(F.col("doc_id").alias("of_doc"), "cells"), F.col("doc_id") == F.col("of_doc")).drop("of_doc")
    sizes, sizes_path = written(members.groupBy("group").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("group", "of_group"))
    held = sets.select("group", F.explode("cells").alias("cell")).groupBy("group", "cell").agg(F.count(F.lit(1)).alias("held"))
    common = held.join(sizes, F.col("group") == F.col("of_group")).filter("2 * held > n").groupBy("of_group").agg(F.collect_list("cell").alias("common"))
    # Large groups are dealt out in parts of about PART members.
    parts = F.greatest(F.ceil(F.col("n") / PART), F.lit(1)).cast("int")
    common = sizes.join(common, "of_group", "left").select("of_group", parts.alias("parts"), F.coalesce("common", F.array().cast("array<bigint>")).alias("common"))
    common, common_path = written(common.withColumn("of_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))))
    many = common.filter("of_part = 0").select(F.col("of_group").alias("p_group"), F.col("parts").alias("p_parts"))
    dealt = sets.join(F.broadcast(many.filter("p_parts > 1")), F.col("group") == F.col("p_group"), "left")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("p_parts", F.lit(1))).cast("int"))
    dealt = dealt.join(common, (F.col("group") == F.col("of_group")) & (F.col("part") == F.col("of_part")))
    unlike = F.array_union(F.array_except("cells", "common"), F.array_except("common", "cells"))
    own = dealt.select("doc_id", "group", "class", "n_cells", unlike.alias("unlike")).withColumn("k", F.size("unlike"))
    c = (1 - similarity) / (1 + similarity)
    own, own_path = written(own.withColumn("s", F.col("k") - c * F.col("n_cells")))
    discard(spark, common_path, sizes_path)

    low = own.groupBy("group").agg(F.min(F.struct("s", "doc_id")).alias("low")).select(F.col("group").alias("of_group"), F.col("low.s").alias("low_s"), F.col("low.doc_id").alias("low_doc"))
    own = own.join(low, F.col("group") == F.col("of_group")).drop("of_group")
    far = F.col("s") + F.col("low_s") > EPSILON
    at_once = own.filter(~far & (F.col("doc_id") != F.col("low_doc"))).select(F.least("doc_id", "low_doc").alias("a"), F.greatest("doc_id", "low_doc").alias("b"))
    rest = own.filter(far).groupBy("group").agg(F.min("s").alias("far_s")).withColumnRenamed("group", "of_group")
    own = own.join(rest, F.col("group") == F.col("of_group")).drop("of_group").withColumn("far", far)
    cells = own.select("doc_id", "group", F.explode("unlike").alias("cell"))
    rarity = cells.groupBy("group", "cell").agg(F.count(F.lit(1)).alias("in_s")).select(F.col("group").alias("r_group"), F.col("cell").alias("r_cell"), "in_s")
    cells = cells.join(rarity, (F.col("group") == F.col("r_group")) & (F.col("cell") == F.col("r_cell"))).select("doc_id", "cell", "in_s")
    ordered = cells.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("in_s", "cell"))).alias("ordered")).withColumnRenamed("doc_id", "o_doc")
    # A member shares at least this many cells of S with any partner it can still be linked to.
    least = F.when(F.col("far"), F.col("s") + F.col("low_s")).otherwise(F.col("s") + F.col("far_s")) / 2
    prefix = F.col("k") - F.greatest(F.ceil(least - EPSILON), F.lit(1)) + 1
    own = own.join(ordered, F.col("doc_id") == F.col("o_doc")).withColumn("prefix", prefix.cast("int")).filter("prefix > 0")
    placed = own.select("doc_id", "group", "class", "n_cells", "k", "s", "far", F.posexplode(F.slice("ordered", 1, F.col("prefix"))).alias("at", "o"))
    placed, placed_path = written(placed.filter("o.in_s > 1").select("doc_id", "group", "class", "n_cells", "s", "far", (F.col("k") - F.col("at")).alias("from_here"), F.col("o.cell").alias("cell")))
    x, y = (placed.select([F.col(n).alias(f"{side}_{n}") for n in placed.columns]) for side in "xy")
    both = (F.col("x_group") == F.col("y_group")) & (F.col("x_cell") == F.col("y_cell")) & (F.col("x_class") != F.col("y_class")) & (~F.col("y_far") | (F.col("x_doc_id") < F.col("y_doc_id")))
    enough = F.least("x_from_here", "y_from_here") >= (F.col("x_s") + F.col("y_s")) / 2 - EPSILON
    found = x.filter("x_far").join(y, both & _alike_in_size("x_n_cells", "y_n_cells", similarity) & enough)
    pairs = found.select(F.least("x_doc_id", "y_doc_id").alias("a"), F.greatest("x_doc_id", "y_doc_id").alias("b"))
    pairs, pairs_path = written(pairs.union(at_once).distinct())
    new = compared(pairs, every, similarity)
    discard(spark, members_path, own_path, placed_path, pairs_path)
    return new


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id, class_size, kept) with one row per id: class_id is the smallest id of the class, whose document is kept.

    Shingles are five words (white-space separated, A-Z as a-z) with their
    multiplicities; a text of fewer words is one shingle.  A null text, an empty
    one and one without words is alone in its class.  Rows that repeat an id
    are one document, and of their texts the one with fewest shingles counts;
    rows with a null id are left out, as nothing could name them in the result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).filter(F.col("doc_id").isNotNull())
    sketch, sketch_path = written(sketches(base))
    sketch = sketch.groupBy("doc_id").agg(F.min(F.struct("n_cells", "fingerprint", "bands", "bits")).alias("s")).select("doc_id", "s.*")
    worded = sketch.filter("n_cells > 0")
    reps = worded.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"), F.first("n_cells").alias("n_cells"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    reps, reps_path = written(reps)
    links = similar_pairs(reps, base, similarity)
    of_rep = reps.select(F.col("doc_id").alias("rep"), F.col("fingerprint").alias("print"))
    if links is not None:
        of_rep = of_rep.join(links, F.col("rep") == F.col("a"), "left").select("print", F.coalesce("b", "rep").alias("class_id"))
    else:
        of_rep = of_rep.withColumnRenamed("rep", "class_id")
    members = sketch.select("doc_id", F.when(F.col("n_cells") > 0, F.col("fingerprint")).alias("fingerprint"))
    members = members.join(of_rep, F.col("fingerprint") == F.col("print"), "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("class_size")).withColumnRenamed("class_id", "sized")
    result = members.join(sizes, F.col("class_id") == F.col("sized")).select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))
    result, _ = written(result)
    discard(docs.sparkSession, sketch_path, reps_path)
    return result
