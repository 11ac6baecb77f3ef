"""Token counts of whole texts through a map-side two-tier lookup.

The tokenizer's pieces hold white-space marks only at their start, so no merge
crosses from a text character to a mark: a text is the concatenation of its
pre-tokens (marks, then everything up to the next mark), and its token count
is the sum of theirs.  The lengths of frequent pre-tokens are broadcast as a
hash table of a fixed number of entries; a miss is encoded by the library
itself and kept in a bounded cache of the worker.  No pre-token is shuffled.

Which pre-tokens are in the table affects speed only, so it is filled from a
small fixed number of documents; every count comes from the library.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, whole_text

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: Broadcast table: so many pre-tokens, from so many documents.  Worker cache, each of two generations: so many more; longer pre-tokens are not kept.
FREQUENT, WARM_DOCS, CACHED, LONGEST = 1 << 16, 4000, 250_000, 64
RUNS = re.compile(r" +[^ ]*")


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens, each without its first mark.  The library treats a mark in the text as a space, and adds one in front."""
    text = text.replace("▁", " ")
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " ":
        return [p[1:] for p in RUNS.findall(" " + text)]
    return text.split(" ")


def load(model_path: str):
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=model_path)


class Lengths:
    """Token counts of pre-tokens: the frequent ones, and those met lately by this worker in two generations."""

    def __init__(self, model_path: str, frequent: dict[str, int], cached: int = CACHED):
        self.encode, self.frequent, self.most = load(model_path).encode, frequent, len(frequent) + cached
        self.known, self.older = dict(frequent), {}

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) > self.most:
            self.known, self.older = dict(self.frequent), self.known
        new = []
        for piece in pieces.difference(self.known):
            n = self.older.get(piece)
            if n is None:
                new.append(piece)
            else:
                self.known[piece] = n
        for piece, ids in zip(new, self.encode(new, num_threads=1)):
            self.known[piece] = len(ids) if piece else 1

    def of(self, text: str) -> int:
        pieces = pre_tokens(text)
        distinct = set(pieces)
        self.learn(distinct)
        n = sum(map(self.known.__getitem__, pieces))
        for piece in distinct:
            if len(piece) > LONGEST:
                del self.known[piece]
        return n


def frequent_lengths(docs: DataFrame, model_path: str, keep: int = FREQUENT, warm_docs: int = WARM_DOCS) -> dict[str, int]:
    """Lengths of pre-tokens frequent in the first documents: at most ``keep`` entries.

    A task counts ``warm_docs`` documents at most and gives its pre-tokens in
    order of their number; Spark starts with one partition and reads more only
    while fewer than ``keep`` have come.
    """

    def count(batches):
        seen: Counter[str] = Counter()
        left = warm_docs
        for batch in batches:
            for text in batch.column(0).slice(0, left).to_pylist():
                seen.update(p for p in pre_tokens(text) if len(p) <= LONGEST)
                if len(seen) > 8 * keep:
                    seen = Counter(dict(seen.most_common(4 * keep)))
            left -= batch.num_rows
            if left <= 0:
                break
        lengths = Lengths(model_path, {})
        top = [p for p, _ in seen.most_common(keep)]
        lengths.learn(set(top))
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array([lengths.known[p] for p in top], pa.int64())], ["piece", "n"])

    rows = docs.select(whole_text("text").alias("text")).mapInArrow(count, "piece string, n long").limit(keep)
    return {r.piece: r.n for r in rows.collect()}


_workers: dict[tuple, Lengths] = {}


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    A null or empty text has 0 bytes and 0 tokens.  Repeated rows and ids, null
    ids included, come back row by row; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(base, model_path))
    table_id = table._jbroadcast.id()

    def count(batches):
        key = (model_path, table_id)
        if key not in _workers:
            _workers.clear()
            _workers[key] = Lengths(model_path, table.value)
        lengths = _workers[key]
        for batch in in_slices(batches, 2):
            n = pa.array([lengths.of(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    sized = base.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    out = sized.mapInArrow(count, f"doc_id {sized.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
