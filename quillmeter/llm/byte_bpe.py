"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut into pre-tokens by the vocabulary's pattern and each is merged
on its own.  The bytes form a linked list; every mergeable neighbour pair waits
in the bucket of its rank.  A three-level bitmap over the ranks says which
buckets have entries: the lowest set bit of the root, then of a word of the
middle, then of a word of the leaves, gives the next rank in constant time.
Entries that a merge has outdated stay in their bucket and are skipped when it
comes up, and the positions of a bucket go from left to right.  Merging n bytes
takes O(n) queue steps, which is what long pre-tokens without a break need; the
many short pre-tokens of a text that the worker has not met lately are laid
side by side and share one run of the queue.

A space between two characters that are not white space always starts a
pre-token, so a worker keeps the ids of whole space-separated chunks, in two
bounded generations, and applies the pattern to chunks it does not know.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import in_slices, whole_text

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Chunks in each of a worker's two cache generations, about 140 bytes each; longer ones (in characters) are not kept.
CACHED, LONGEST = 250_000, 64
#: Characters of text learnt together.
TOGETHER = 1 << 18
#: Where white space does not stand alone between other characters, the pattern is applied to the whole text.
UNEVEN = re.compile(r"\s\s|^\s|\s$")


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary: lines of a base64 token and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def default_pattern() -> str:
    """The pattern of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class RankQueue:
    """Buckets of positions by rank, under three levels of bitmap words of 64 bits."""

    def __init__(self, n_ranks: int):
        self.leaves = [0] * ((n_ranks >> 6) + 1)
        self.middle = [0] * ((n_ranks >> 12) + 1)
        self.root = 0
        self.buckets: dict[int, list[int]] = {}

    def add(self, rank: int, positions: list[int]) -> None:
        """Opens the bucket of a rank that has none."""
        self.buckets[rank] = positions
        leaf = rank >> 6
        self.leaves[leaf] |= 1 << (rank & 63)
        self.middle[leaf >> 6] |= 1 << (leaf & 63)
        self.root |= 1 << (leaf >> 6)

    def pop(self) -> tuple[int, list[int]]:
        """The lowest rank and its positions, whose bucket is closed."""
        m = (self.root & -self.root).bit_length() - 1
        word = self.middle[m]
        leaf = (m << 6) + (word & -word).bit_length() - 1
        word = self.leaves[leaf]
        rank = (leaf << 6) + (word & -word).bit_length() - 1
        self.leaves[leaf] ^= 1 << (rank & 63)
        if not self.leaves[leaf]:
            self.middle[m] ^= 1 << (leaf & 63)
            if not self.middle[m]:
                self.root ^= 1 << m
        return rank, self.buckets.pop(rank)


class BytePairs:
    """Merges pre-tokens by a table of ranks, which are also the ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.first = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)], np.int64)
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        #: first id << 32 | second id -> rank of their joined bytes, for all pairs that have one.
        self.pairs = {
            left << 32 | right: rank
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        }

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian unsigned 32-bit integers."""
        out = [None if (whole := self.ranks.get(p)) is None else whole.to_bytes(4, "little") for p in pieces]
        split = [i for i, ids in enumerate(out) if ids is None and pieces[i]]
        data = np.frombuffer(b"".join([pieces[i] for i in split]), np.uint8)
        ends = np.cumsum([len(pieces[i]) for i in split], dtype=np.int64)
        if not len(data):
            return [ids or b"" for ids in out]
        starts = np.concatenate([[0], ends[:-1]])
        after, before = np.arange(1, len(data) + 1), np.arange(-1, len(data) - 1)
        after[ends - 1], before[starts] = -1, -1
        waiting = np.full(len(data), -1, np.int64)  # the rank under which a position's pair waits now
        waiting[:-1] = self.first[data[:-1], data[1:]]
        waiting[ends - 1] = -1
        order = np.argsort(waiting, kind="stable")
        order = order[np.searchsorted(waiting[order], 0) :]
        ranks, at = np.unique(waiting[order], return_index=True)
        for rank, positions in zip(ranks.tolist(), np.split(order, at[1:])):
            self.queue.add(rank, positions.tolist())
        ids = self._merge(self.single[data].tolist(), after.tolist(), before.tolist(), waiting.tolist())
        ids = np.array(ids, np.int64)
        kept = ids >= 0
        coded = ids[kept].astype("<u4").tobytes()
        number = np.concatenate([[0], np.cumsum(kept)]) * 4
        for i, a, b in zip(split, number[starts].tolist(), number[ends].tolist()):
            out[i] = coded[a:b]
        return [ids or b"" for ids in out]

    def _merge(self, ids: list[int], after: list[int], before: list[int], waits: list[int]) -> list[int]:
        """Runs the queue until it is empty; -1 marks positions merged away."""
        pair, queue = self.pairs.get, self.queue
        buckets, add = queue.buckets, queue.add
        while queue.root:
            rank, positions = queue.pop()
            if len(positions) > 1:
                positions.sort()
            for at, i in enumerate(positions):
                if waits[i] != rank:
                    continue  # outdated
                j = after[i]
                k = after[j]
                ids[i], ids[j], waits[i], waits[j], after[i] = rank, -1, -1, -1, k
                lower = False
                if k >= 0:
                    before[k] = i
                    r = pair(rank << 32 | ids[k])
                    if r is not None:
                        waits[i] = r
                        lower = r < rank
                        if r in buckets:
                            buckets[r].append(i)
                        else:
                            add(r, [i])
                h = before[i]
                if h >= 0:
                    r = pair(ids[h] << 32 | rank, -1)
                    if r != waits[h]:
                        waits[h] = r
                        if r >= 0:
                            lower = lower or r < rank
                            if r in buckets:
                                buckets[r].append(h)
                            else:
                                add(r, [h])
                if lower and at + 1 < len(positions):  # a lower rank goes before the rest of this bucket
                    add(rank, buckets.get(rank, []) + positions[at + 1 :])
                    break
        return ids


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers, and back, with a bounded memory."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cached: int = CACHED):
        import regex

        self.pairs, self.cached = BytePairs(ranks), cached
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}  # of a chunk with a space in front
        self.older: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}  # of pre-tokens that do not start with a space
        size = max(ranks.values(), default=0) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def _pieces(self, pieces: list[str]) -> bytes:
        """The ids of pre-tokens, all of which ``_learn`` has seen."""
        known, plain = self.known, self.plain
        return b"".join([known[p[1:]] if p[0] == " " and len(p) > 1 else plain[p] for p in pieces])

    def _learn(self, cuts: list[list[str]]) -> None:
        new = list({p for pieces in cuts for p in pieces if (p[1:] not in self.known if p[0] == " " and len(p) > 1 else p not in self.plain)})
        for p, ids in zip(new, self.pairs.merge([p.encode() for p in new])):
            if p[0] == " " and len(p) > 1:
                self.known[p[1:]] = ids
            else:
                self.plain[p] = ids

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; texts of about ``TOGETHER`` characters are learnt together."""
        group: list[str] = []
        for text in texts:
            group.append(text)
            if sum(map(len, group)) >= TOGETHER:
                yield from self._encode_group(group)
                group = []
        yield from self._encode_group(group)

    def _encode_group(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.cached:
            self.known, self.older = {}, self.known
        if len(self.plain) > self.cached:
            self.plain.clear()
        parts, missing = [], set()
        for text in texts:
            if UNEVEN.search(text):
                parts.append((self.cut(text), []))
            else:
                first, *chunks = text.split(" ")
                parts.append((self.cut(first), chunks))
                missing.update(set(chunks).difference(self.known))
        unknown = []
        for chunk in missing:
            ids = self.older.get(chunk)
            if ids is None:
                unknown.append(chunk)
            else:
                self.known[chunk] = ids
        cuts = [self.cut(" " + chunk) for chunk in unknown]
        self._learn([*(pieces for pieces, _ in parts), *cuts])
        for chunk, pieces in zip(unknown, cuts):
            if len(pieces) > 1:
                self.known[chunk] = self._pieces(pieces)
        out = [self._pieces(pieces) + b"".join(map(self.known.__getitem__, chunks)) for pieces, chunks in parts]
        self._forget_long([p for pieces, _ in parts for p in pieces])
        self._forget_long([" " + c for c in unknown])
        self._forget_long([p for pieces in cuts if len(pieces) > 1 for p in pieces])
        return out

    def _forget_long(self, pieces: list[str]) -> None:
        for p in pieces:
            if len(p) > LONGEST:
                self.known.pop(p[1:], None)
                self.plain.pop(p, None)

    def decode(self, coded: bytes) -> bytes:
        ids = np.frombuffer(coded, "<u4")
        if not len(ids):
            return b""
        lengths = self.lengths[ids]
        shift = self.starts[ids] - (np.cumsum(lengths) - lengths)
        return self.flat[np.repeat(shift, lengths) + np.arange(lengths.sum())].tobytes()


_workers: dict[tuple, Encoder] = {}
#: What ``byte_bpe`` can give: its type, and the value of (text, ids, decoded bytes).
GIVEN = {
    "ids": (pa.binary(), lambda text, coded, back: coded),
    "decoded": (pa.binary(), lambda text, coded, back: back),
    "restored": (pa.bool_(), lambda text, coded, back: back == text.encode()),
    "ids_sha256": (pa.string(), lambda text, coded, back: hashlib.sha256(coded).hexdigest()),
    "decoded_sha256": (pa.string(), lambda text, coded, back: hashlib.sha256(back).hexdigest()),
}


def byte_bpe(
    docs: DataFrame, vocabulary_path: str, pattern: str, text_col: str = "text", carry: list[str] | None = None, give: tuple[str, ...] = ("ids", "decoded")
) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default), then n_tokens and those of ``GIVEN`` that are asked for; they replace columns of those names.

    ``ids`` holds unsigned 32-bit little-endian integers, ``decoded`` the bytes
    they decode to, ``restored`` says whether those are the text's, and the
    digests are SHA-256 in lowercase hex, made where the ids are, so neither ids
    nor bytes need to travel.  A null or empty text has no ids and decodes to no
    bytes.  Rows come back one by one, repeated ones too.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path))  # a vocabulary file: about 1 MB
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ("n_tokens", *give)]
    base = docs.select(whole_text(text_col).alias("_coded_text"), *kept)

    def encode(batches):
        key = (vocabulary_path, pattern)
        if key not in _workers:
            _workers.clear()
            _workers[key] = Encoder(ranks.value, pattern)
        worker = _workers[key]
        for batch in in_slices(batches, 0):
            texts = batch.column(0).to_pylist()
            counts, found = [], {name: [] for name in give}
            for text, coded in zip(texts, worker.encode_all(texts)):
                back = worker.decode(coded)
                counts.append(len(coded) // 4)
                for name, values in found.items():
                    values.append(GIVEN[name][1](text, coded, back))
            arrays = [pa.array(values, GIVEN[name][0]) for name, values in found.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(counts, pa.int64()), *arrays], [*kept, "n_tokens", *give])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[1:]]
    return base.mapInArrow(encode, ", ".join([*fields, "n_tokens long", *(f"{name} {'boolean' if name == 'restored' else GIVEN[name][0]}" for name in give)]))
