"""Ranked lexical search of a stated query set over all documents by sort-based accumulation.

One pass over the texts keeps, for each document, its length and the counts of
those terms that a query holds: a forward index, written once.  Document
frequencies, the number of documents and of terms are Spark aggregates of it.
A second pass joins each document's terms with the items that hold them: the
matched (item, document, impact) entries of many documents stand in arrays, are
ordered by a radix sort of packed (item, document) keys, and are summed where a
key ends.  A task keeps the best of each item in a heap; these go by ranges of
items to the tasks that select the best of all.

Queries come in blocks of bounded size, so what is broadcast (a block's terms and
the items of each) is bounded too; every block is ranked against all documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, whole_text, written

NEAREST = 10
#: A block of queries: so many items, of so many bytes together (a longer item alone).  At most 65,536 items fit a packed key.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 16 << 20
#: Entries that are accumulated together (a document's are never parted), and bytes of a text that are split at a time.
ENTRIES, PIECE = 1 << 21, 4 << 20
#: What is no term byte becomes a space: terms are runs of ASCII letters, digits and of all other scripts, with A-Z lower-cased.
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms(text: str, most: int = PIECE) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of bounded size."""
    data, start = text.encode().translate(_TERM_BYTES), 0
    while start < len(data):
        stop = data.find(b" ", start + most)
        stop = len(data) if stop < 0 else stop
        yield data[start:stop].split()
        start = stop


@dataclass
class Queries:
    """A block of items: their ids, the number of each term, and for each term the items that hold it and how often (CSR)."""

    ids: list
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    starts: np.ndarray = None
    items: np.ndarray = None
    repeats: np.ndarray = None

    @classmethod
    def of(cls, rows: list[tuple]) -> Queries:
        block, entries = cls([i for i, _ in rows]), []
        for n, (_, text) in enumerate(rows):
            held = Counter(t for piece in terms(text or "") for t in piece)
            entries += [(block.vocabulary.setdefault(t, len(block.vocabulary)), n, c) for t, c in held.items()]
        table = np.array(sorted(entries), np.int64).reshape(-1, 3)
        block.starts = np.searchsorted(table[:, 0], np.arange(len(block.vocabulary) + 1))
        block.items, block.repeats = table[:, 1].astype(np.uint32), table[:, 2]
        return block


def query_blocks(items: DataFrame, most_items: int = BLOCK_ITEMS, most_bytes: int = BLOCK_BYTES) -> Iterator[Queries]:
    """The distinct (item_id, text) rows dealt into blocks, of which each is checked to be small enough; a block is read when it is used."""
    rows = items.select("item_id", whole_text().alias("text")).distinct().withColumn("bytes", F.octet_length("text").cast("long"))
    n = 1
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))
        sizes = dealt.groupBy("block").agg(F.count(F.lit(1)).alias("items"), F.sum("bytes").alias("bytes"))
        if sizes.filter((F.col("items") > most_items) | ((F.col("items") > 1) & (F.col("bytes") > most_bytes))).isEmpty():
            break
        n *= 2
    for b in range(n):
        found = dealt.filter(F.col("block") == b).select("item_id", "text").collect()
        if found:
            yield Queries.of(sorted(((r.item_id, r.text) for r in found), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def forward_index(docs: DataFrame, vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, counts) of the documents with a term: n of them, and how often the document has each of the vocabulary (a broadcast dict)."""

    def index(batches):
        number = vocabulary.value.get
        for batch in in_slices(batches, 1):
            lengths, keys = np.zeros(batch.num_rows, np.int64), []
            for d, text in enumerate(batch.column(1).to_pylist()):
                for piece in terms(text):
                    lengths[d] += len(piece)
                    hits = np.array([i for i in map(number, piece) if i is not None], np.int64)
                    keys.append(np.int64(d) << 32 | hits)
            keys, counts = np.unique(np.concatenate([np.empty(0, np.int64), *keys]), return_counts=True)
            bounds = pa.array(np.searchsorted(keys, np.arange(batch.num_rows + 1) << 32).astype(np.int32))
            columns = [batch.column(0), pa.array(lengths)]
            columns += [pa.ListArray.from_arrays(bounds, pa.array(v)) for v in ((keys & 0xFFFFFFFF).astype(np.int32), counts.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "terms", "counts"]).filter(pa.array(lengths > 0))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(index, "doc_id long, n long, terms array<int>, counts array<int>")


def length_norm(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """100 - 75 + (75 * n * N) div L; by Python's integers where 64 bits are too few."""
    if len(n) and int(n.max()) * 75 * documents >= 1 << 63:
        return np.array([25 + 75 * x * documents // length for x in n.tolist()], np.int64)
    return 25 + 75 * n * documents // length


def term_weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order of 32-bit keys by two counting passes over their halves, the lower one first (numpy sorts 16-bit integers so)."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    return order[np.argsort((keys[order] >> np.uint32(16)).astype(np.uint16), kind="stable")]


class Best:
    """The best documents of each item so far, in heaps whose root is the worst of them: higher score, then smaller id, a null id last."""

    def __init__(self, items: int, most: int):
        self.heaps, self.floor, self.most = [[] for _ in range(items)], np.ones(items, np.int64), most

    def take(self, items: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.floor[items]
        items, ids, scores = items[good], ids[good], scores[good]
        order = np.lexsort((ids, -scores, items))
        items, ids, scores = items[order], ids[order], scores[order]
        place = np.arange(len(items)) - np.searchsorted(items, items)
        few = place < self.most
        for i, d, s in zip(items[few].tolist(), ids[few].tolist(), scores[few].tolist()):
            heap = self.heaps[i]
            if len(heap) < self.most:
                heapq.heappush(heap, (s, -d))
            else:
                heapq.heappushpop(heap, (s, -d))
            if len(heap) == self.most:
                self.floor[i] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int, int, int]]:
        """(item, rank from 1, document, score), best first."""
        for i, heap in enumerate(self.heaps):
            for rank, (s, d) in enumerate(sorted(heap, reverse=True), 1):
                yield i, rank, -d, s


#: Stands for a null document id in a heap: no id is larger.
NO_ID = (1 << 63) - 1
_TOPS = pa.schema([("item", pa.int32()), ("rank", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _batch(best: Best) -> pa.RecordBatch:
    columns = list(zip(*best.rows())) or [()] * 4
    arrays = [pa.array(c, f.type) for c, f in zip(columns, _TOPS)]
    arrays[2] = pc.if_else(pc.equal(arrays[2], NO_ID), pa.scalar(None, pa.int64()), arrays[2])
    return pa.RecordBatch.from_arrays(arrays, schema=_TOPS)


def accumulated(ids, norms, terms_of, sizes, counts, block: Queries, weights: np.ndarray, most: int = ENTRIES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(items, ids, scores) of every item and document that share a term, for runs of documents with a bounded number of entries."""
    fan = np.diff(block.starts)[terms_of]
    ends = np.concatenate([[0], np.cumsum(sizes)])
    entries = np.concatenate([[0], np.cumsum(fan)])[ends]
    first = 0
    while first < len(ids):
        last = max(first + 1, int(np.searchsorted(entries, entries[first] + most, "right")) - 1)
        last = min(last, first + (1 << 16), len(ids))
        part = slice(ends[first], ends[last])
        of = np.repeat(np.arange(last - first, dtype=np.uint32), sizes[first:last])
        tf = counts[part].astype(np.int64)
        impact = weights[terms_of[part]] * (1_000_000_000 * tf // (1000 * tf + 8 * norms[first:last][of]))
        width = fan[part]
        posting = np.repeat(np.arange(len(width)), width)
        at = np.arange(len(posting)) - np.repeat(np.cumsum(width) - width, width) + block.starts[terms_of[part]][posting]
        keys, values = block.items[at] << np.uint32(16) | of[posting], block.repeats[at] * impact[posting]
        if len(keys):
            order = radix_order(keys)
            keys, values = keys[order], values[order]
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys = keys[heads]
            yield (keys >> np.uint32(16)).astype(np.int64), ids[first:last][keys & 0xFFFF], np.add.reduceat(values, heads)
        first = last


def search_block(docs: DataFrame, block: Queries, nearest: int = NEAREST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item, rank, doc_id, score): the best documents of each item of a block, by its place there."""
    spark = docs.sparkSession
    index, _ = written(forward_index(docs, spark.sparkContext.broadcast(block.vocabulary), id_col, text_col))
    documents, length = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = np.zeros(len(block.vocabulary), np.int64)
    for r in held.collect():  # one row a term of the block
        weights[r.term] = term_weight(documents, r.df)
    shared = spark.sparkContext.broadcast((block, weights))

    def score(batches):
        queries, w = shared.value
        best = Best(len(queries.ids), nearest)
        for b in batches:
            ids = pc.fill_null(b.column(0), NO_ID).to_numpy(zero_copy_only=False)
            norms = length_norm(b.column(1).to_numpy(zero_copy_only=False), documents, length)
            sizes = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = [b.column(c).flatten().to_numpy(zero_copy_only=False) for c in (2, 3)]
            for found in accumulated(ids, norms, flat[0], sizes, flat[1], queries, w):
                best.take(*found)
        yield _batch(best)

    def select(batches):
        best = Best(len(shared.value[0].ids), nearest)
        for b in batches:
            ids = pc.fill_null(b.column(2), NO_ID).to_numpy(zero_copy_only=False)
            best.take(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), ids, b.column(3).to_numpy(zero_copy_only=False))
        yield _batch(best)

    schema = "item int, rank int, doc_id long, score long"
    tops, _ = written(index.mapInArrow(score, schema))  # the ranges are taken from it, which would score twice
    return tops.repartitionByRange("item").mapInArrow(select, schema)


def lexical_search(docs: DataFrame, items: DataFrame, nearest: int = NEAREST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``nearest`` highest-scoring documents of each item, scores above 0, equal ones by ascending id.

    Null and empty texts have no term: such an item finds nothing, such a document
    counts nowhere.  Equal (item_id, text) rows of ``items`` count once; one id
    with several texts gives the rank list of each.  Document ids are integers;
    repeated ones are ranked row by row, a null one behind all others of its
    score.  Texts of any length are split a few MB at a time, and other columns
    are ignored.  No document or no item: no rows.
    """
    spark, kind = docs.sparkSession, items.schema["item_id"].dataType
    found = None
    for block in query_blocks(items):
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind.simpleString()}")
        part = search_block(docs, block, nearest, id_col, text_col).join(F.broadcast(names), "item")  # one row an item of a block
        part = part.select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionAll(part)
    return found if found is not None else spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
