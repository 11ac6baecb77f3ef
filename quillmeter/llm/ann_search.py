"""Nearest neighbours through stable random projections indexed by kd-trees.

Projecting on a few Gaussian (2-stable) directions turns a distance d into d
times the root of a chi-square variable.  So points are looked at in order of
projected distance, each is verified by its true distance, and the search stops
once the next projected distance is so large that a point nearer than the k-th
found would have stayed that far out with a chance below 1 - ``CONFIDENCE``.

A kd-tree fitted on a bounded sample cuts the projected space into cells, in
number as the rows need; every row is put in its cell, and a cell beyond
``PART_ROWS`` rows is split into parts by hash.  The bound on the k-th distance
comes down in three steps.  A query searches its own cell; then it verifies the
first ``PROBE`` projected neighbours in each cell whose box the stopping test
does not rule out; with the k-th distance over all of these it goes on, in the
cells that the test still leaves, to all points that the test leaves.  Within a
part, the leaves of a kd-tree are ruled out by their boxes, and the points of
the others come in order of projected distance.  The driver holds the sample,
the tree, and one box and counts a cell, all bounded by parameters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

DIMS, CONFIDENCE, NEAREST, SEED = 24, 0.9, 10, 11
SAMPLE, CELL_ROWS, MOST_CELLS, PART_ROWS, LEAF, PROBE, QUERY_BLOCK = 8192, 4096, 1024, 8192, 128, 64, 20_000


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """x with P(chi-square of an even number of dimensions <= x) = p."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
        low, high = (x, high) if below < p else (low, x)
    return high


@dataclass
class KdTree:
    """Median splits of a sample: a leaf for each cell, numbered from left to right."""

    axis: list[int] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    depth: int = 0

    @staticmethod
    def fit(points: np.ndarray, depth: int) -> KdTree:
        tree, parts = KdTree(depth=depth), [points]
        for _ in range(depth):
            halves = []
            for part in parts:
                axis = int(np.ptp(part, axis=0).argmax()) if len(part) else 0
                at = float(np.median(part[:, axis])) if len(part) else 0.0
                tree.axis.append(axis)
                tree.at.append(at)
                below = part[:, axis] <= at if len(part) else np.zeros(0, bool)
                halves += [part[below], part[~below]]
            parts = halves
        return tree

    def cell(self, points: np.ndarray) -> np.ndarray:
        node, axis, at = np.zeros(len(points), np.int64), np.array(self.axis, np.int64), np.array(self.at)
        for level in range(self.depth):
            i = node + (1 << level) - 1
            node = 2 * node + (points[np.arange(len(points)), axis[i]] > at[i])
        return node


def leaves(points: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """Rows of a part's points in kd-tree leaves of at most ``LEAF``."""
    if len(rows) <= LEAF:
        return [rows]
    spread = np.ptp(points[rows], axis=0)
    half = len(rows) // 2
    order = np.argpartition(points[rows, spread.argmax()], half)
    return leaves(points, rows[order[:half]]) + leaves(points, rows[order[half:]])


def search_part(vectors: np.ndarray, ids: np.ndarray, projected: np.ndarray, q_ids: np.ndarray, q_vectors: np.ndarray, q_projected: np.ndarray, bounds: np.ndarray, k: int, stop: float, probe: bool = False):
    """(query_id, vec_id, score, verified) lists: each query's k nearest of this part, as far as they can be among the nearest of all.

    ``verified`` is the number of points whose true distance a query took.  With
    ``probe`` that is ``PROBE`` at most (the first in projected order).
    """
    parts = leaves(projected, np.arange(len(ids)))
    low = np.array([projected[p].min(axis=0) for p in parts])
    high = np.array([projected[p].max(axis=0) for p in parts])
    out: tuple[list, list, list, list] = ([], [], [], [])
    for q_id, q, qp, bound in zip(q_ids, q_vectors, q_projected, bounds):
        slack = 1e-9 * (1 + np.abs(qp).max())  # equal vectors may differ in the last digits of their projections
        gap = np.maximum(np.maximum(low - qp, qp - high), 0)
        near = np.flatnonzero(np.sqrt((gap**2).sum(axis=1)) <= stop * bound + slack)
        if not len(near):
            continue
        rows = np.concatenate([parts[leaf] for leaf in near])
        rows = rows[ids[rows] != q_id]
        away = np.sqrt(((projected[rows] - qp) ** 2).sum(axis=1))
        best_d, best_i, kth, done, step = np.zeros(0), np.zeros(0, np.int64), bound, 0, PROBE
        while len(rows):
            # The next points in projected order, as far as the chi-square test for the k-th distance so far lets them.
            order = np.argpartition(away, step)[:step] if len(rows) > step else np.arange(len(rows))
            later = np.ones(len(rows), bool)
            later[order] = False
            order = order[away[order] <= stop * kth + slack]
            d = np.concatenate([best_d, np.sqrt(((vectors[rows[order]] - q) ** 2).sum(axis=1))])
            i = np.concatenate([best_i, ids[rows[order]]])
            done += len(order)
            best = np.lexsort((i, d))
            if len(np.unique(i)) < len(i):  # an id that repeats counts at its nearest
                best = best[np.sort(np.unique(i[best], return_index=True)[1])]
            best = best[:k]
            best_d, best_i = d[best], i[best]
            if len(best_d) == k:
                kth = min(bound, best_d[-1])
            if probe:
                break
            left = later & (away <= stop * kth + slack)
            rows, away, step = rows[left], away[left], 2 * step
        found = best_d <= bound
        out[0].extend([q_id] * int(found.sum()))
        out[1].extend(best_i[found].tolist())
        out[2].extend(best_d[found].tolist())
        out[3].extend([done] * int(found.sum()))
    return out


def ann_search(rows: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = NEAREST, confidence: float = CONFIDENCE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each query, its own row apart, nearest first, ties to the smaller id.

    ``queries`` (by default the rows whose id is divisible by 100) has the same
    columns.  Scores are Euclidean distances of the given vectors in double
    precision.  Null vectors, zero ones, ones with null or non-finite
    components, ones of another length than most have (of equally frequent
    lengths the larger counts), and null ids take no part; other columns are ignored; an id that repeats counts once, at its nearest vector.  A table
    without vectors has no result; with k others or fewer, all are returned.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    stop = math.sqrt(chi_square_quantile(confidence))

    def valid(df: DataFrame) -> DataFrame:
        bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        df = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
        return df.filter(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))

    points = valid(rows)
    asked = valid(queries) if queries is not None else points.filter(F.col("vec_id") % 100 == 0)
    lengths = points.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not lengths:
        return empty
    dim = lengths[0].dim
    points, asked = points.filter(F.size("v") == dim), asked.filter(F.size("v") == dim)
    directions = np.random.default_rng(SEED).normal(size=(dim, DIMS))
    sample = points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    n = points.count()
    depth = max(0, min(int(math.log2(MOST_CELLS)), math.ceil(math.log2(max(1, n / CELL_ROWS)))))
    tree = KdTree.fit(np.array([r.v for r in sample]) @ directions, depth)

    def place(batches):
        for batch in batches:
            vectors = np.array(batch.column(1).flatten(), np.float64).reshape(-1, dim)
            projected = vectors @ directions
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.FixedSizeListArray.from_arrays(pa.array(projected.ravel()), DIMS).cast(pa.list_(pa.float64())), pa.array(tree.cell(projected), pa.int64())],
                ["vec_id", "v", "p", "cell"],
            )

    schema = "vec_id long, v array<double>, p array<double>, cell long"
    points, points_path = written(points.mapInArrow(place, schema))
    asked = asked.mapInArrow(place, schema)
    ends = [f(F.get("p", F.lit(i))).alias(f"{name}{i}") for i in range(DIMS) for f, name in ((F.min, "low"), (F.max, "high"))]
    boxes = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *ends).orderBy("cell").collect()  # at most MOST_CELLS rows
    cells = np.array([b.cell for b in boxes])
    low, high = (np.array([[b[f"{name}{i}"] for i in range(DIMS)] for b in boxes]) for name in ("low", "high"))
    n_parts = {b.cell: math.ceil(b.n / PART_ROWS) for b in boxes}
    by_cell = spark.createDataFrame([(int(c), int(m)) for c, m in n_parts.items()], "of_cell long, n_parts int")

    def parted(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(by_cell), F.col("cell") == F.col("of_cell")).drop("of_cell")

    dealt = parted(points).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("n_parts")).cast("int")).drop("n_parts")

    def searched(routed: DataFrame, probe: bool = False) -> DataFrame:
        """routed: vec_id, v, p, bound, cell.  Queries of a cell go to all its parts, in blocks."""
        blocks = {r.cell: math.ceil(r.n / QUERY_BLOCK) for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        by_block = spark.createDataFrame([(int(c), int(m)) for c, m in blocks.items()] or [(-1, 1)], "block_cell long, n_blocks int")
        routed = parted(routed).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).drop("n_parts")
        routed = routed.join(F.broadcast(by_block), F.col("cell") == F.col("block_cell"))
        routed = routed.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("n_blocks")).cast("int")).drop("block_cell", "n_blocks")
        there = dealt.join(F.broadcast(by_block), F.col("cell") == F.col("block_cell")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        there = there.drop("block_cell", "n_blocks")

        def run(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
            found = ([], [], []) if not len(q) or not len(p) else search_part(
                np.stack(p.v), p.vec_id.to_numpy(), np.stack(p.p), q.vec_id.to_numpy(), np.stack(q.v), np.stack(q.p), q.bound.to_numpy(), k, stop, probe
            )
            return pd.DataFrame({"query_id": found[0], "vec_id": found[1], "score": found[2]}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

        key = ["cell", "part", "block"]
        found = routed.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(run, "query_id long, vec_id long, score double")
        return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))

    def ranked(found: DataFrame) -> DataFrame:
        near = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return found.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)

    def route(batches):
        for batch in batches:
            p = np.array(batch.column(2).flatten(), np.float64).reshape(-1, DIMS)
            own, bound = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            gap = np.maximum(np.maximum(low[None] - p[:, None], p[:, None] - high[None]), 0)
            reach = np.sqrt((gap**2).sum(axis=2))
            slack = 1e-9 * (1 + np.abs(p).max(axis=1, initial=0))
            at, to = np.nonzero((reach <= (stop * bound + slack)[:, None]) & (cells[None] != own[:, None]))
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(cells[to], pa.int64()), batch.column(4).take(at)], ["vec_id", "v", "p", "cell", "bound"]
            )

    def elsewhere(near: DataFrame, probe: bool) -> DataFrame:
        """``near`` and what each query finds in the other cells that its k-th distance so far does not rule out."""
        kth = near.filter(F.col("rank") == k).select(F.col("query_id").alias("bounded"), F.col("score").alias("kth"))
        told = asked.join(kth, F.col("vec_id") == F.col("bounded"), "left").select("vec_id", "v", "p", "cell", F.coalesce("kth", F.lit(float("inf"))).alias("bound"))
        found = searched(told.mapInArrow(route, f"{schema}, bound double"), probe)
        merged = near.select("query_id", "vec_id", "score").union(found).groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        return ranked(merged)

    home, home_path = written(ranked(searched(asked.withColumn("bound", F.lit(float("inf"))))))
    probed, probed_path = written(elsewhere(home, probe=True))
    result, _ = written(elsewhere(probed, probe=False).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
    discard(spark, home_path, probed_path, points_path)
    return result
