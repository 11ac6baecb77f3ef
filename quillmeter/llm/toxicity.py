"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A text is read as windows of ``WINDOW`` words, half of each shared with the
next.  A window is the average of the embeddings of its words' character
n-grams (hashed, word ends marked by a space), put into a linear softmax of two
classes; the text's score is its most toxic window's.  So a misspelling scores
through the n-grams it shares with words that were seen, and a few words in a
very long text are not averaged away.

Embeddings and softmax are trained jointly in numpy (Adagrad on the largest
window of each text) on a bounded sample of labelled rows: at most
``TRAIN_ROWS`` in hash order, whole texts, of ``TRAIN_CHARS`` characters together:
only a text that does not fit with those before it is left out.  For scoring, the trained model comes down to one number an n-gram bucket, 1 MB that
is broadcast, and every whole text is scored where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import in_slices, whole_text

WINDOW, STRIDE = 12, 6
SIZES, BITS, DIM = (3, 4, 5, 6), 18, 8
TRAIN_ROWS, TRAIN_CHARS = 8000, 64_000_000
EPOCHS, BATCH, RATE, DECAY, SEED = 3, 32, 0.1, 1e-5, 7
#: Buckets met in fewer training texts keep a zero embedding.
MIN_TEXTS = 5
#: Where training starts: pseudo-counts of the log-odds, weight of their dimension.
SMOOTH, START = 1.0, 6.0
THRESHOLD = 0.3


#: Words of a text that are scored together (a multiple of the stride), and bytes of them that are hashed together.
BLOCK_WORDS, BLOCK_BYTES = 60_000, 1 << 20


def buckets_of(data: np.ndarray) -> np.ndarray:
    """The bucket (0: none) of the n-gram of each length that starts at each byte of words between blanks."""
    n = len(data)
    blank = data == 32
    blanks = np.cumsum(blank, dtype=np.int32)
    out = np.zeros((len(SIZES), n), np.int32)
    h = np.zeros(n, np.uint32)
    wide = data.astype(np.uint32) + np.uint32(1)
    for size in range(1, SIZES[-1] + 1):
        if n < size:
            break
        m = n - size + 1
        h = h[:m] * np.uint32(0x9E3779B1) + wide[size - 1 :]
        if size in SIZES:
            mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77)
            bucket = (mixed >> np.uint32(32 - BITS)).astype(np.int32)
            inner = blanks[size - 2 : n - 1] - blanks[:m]  # blanks between the n-gram's ends
            bucket[(inner > 0) | (bucket == 0)] = 0
            out[SIZES.index(size), :m] = bucket
    return out


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, words): for each n-gram length and byte of the text's words, its bucket (0: none); the words' first bytes, and the end."""
    data = np.frombuffer(b" " + b" ".join(text.lower().encode().split()) + b" ", np.uint8)
    words = np.flatnonzero(data == 32)
    if len(data) < 3:
        return np.zeros((len(SIZES), 0), np.int32), words[:1]
    return buckets_of(data), words


def word_blocks(text: str, size: int = BLOCK_WORDS, read: int = 4 << 20) -> Iterator[list[bytes]]:
    """A text's words in blocks, of which each has the windows that start among its first ``size`` words, and only these."""
    data, start, held = text.lower().encode(), 0, []
    while start < len(data):
        stop = min(start + read, len(data))
        while stop < len(data) and data[stop] not in b" \t\n\r\x0b\x0c":
            stop += 1
        held += data[start:stop].split()
        start = stop
        while len(held) > size + STRIDE:
            yield held[: size + STRIDE]
            held = held[size:]
    yield held


def windows(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes at which each window starts and ends."""
    n = max(len(words) - 1, 0)
    first = np.arange(0, max(n - STRIDE, 1), STRIDE)
    return words[first], words[np.minimum(first + WINDOW, n)]


@dataclass
class Model:
    """``embeddings`` (bucket, DIM), softmax ``weights`` (DIM, 2) and ``bias`` (2)."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def scorer(self) -> Scorer:
        direction = self.weights[:, 1] - self.weights[:, 0]
        logits = (self.embeddings @ direction).astype(np.float32)
        logits[0] = 0
        return Scorer(logits, float(self.bias[1] - self.bias[0]))


@dataclass
class Scorer:
    """A trained model as far as scores need it: what each bucket adds to the difference of the two logits."""

    logits: np.ndarray
    bias: float

    def window_means(self, buckets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each window: its averaged logit (without the bias), its n-grams' number, its first byte and the byte behind it."""
        total = np.zeros(buckets.shape[1] + 1)
        count = np.zeros(buckets.shape[1] + 1, np.int64)
        np.cumsum(self.logits[buckets].sum(axis=0, dtype=np.float64), out=total[1:])
        np.cumsum(np.count_nonzero(buckets, axis=0), out=count[1:])
        a, b = windows(words)
        n = np.maximum(count[b] - count[a], 1)
        return (total[b] - total[a]) / n, n, a, b

    def word_means(self, words: list[bytes], together: int = BLOCK_BYTES) -> np.ndarray:
        """The averaged logit of each window of these words, from sums up to each word; bytes are hashed a block at a time, with those behind it that its n-grams reach."""
        data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
        edges = np.flatnonzero(data == 32)
        total, count = np.zeros(len(edges)), np.zeros(len(edges), np.int64)
        for start in range(0, len(data), together):
            buckets = buckets_of(data[start : start + together + SIZES[-1] - 1])[:, :together]
            sums, found = np.cumsum(self.logits[buckets].sum(axis=0, dtype=np.float64)), np.cumsum(np.count_nonzero(buckets, axis=0))
            first = int(np.searchsorted(edges, start, "right"))
            last = int(np.searchsorted(edges, start + buckets.shape[1], "right"))
            at = edges[first:last] - start - 1
            total[first:last] += sums[at]
            count[first:last] += found[at]
            total[last:] += sums[-1]
            count[last:] += found[-1]
        a, b = windows(np.arange(len(edges)))
        return (total[b] - total[a]) / np.maximum(count[b] - count[a], 1)

    def score(self, text: str) -> float:
        """Of the most toxic window; what is held at a time does not grow with the text."""
        logit = max((self.word_means(words).max() for words in word_blocks(text) if words), default=0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def fit(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Trains on whole texts.  Without texts of both classes the model gives their share to every text."""
    rng = np.random.default_rng(seed)
    y = np.asarray(toxic, np.float64)
    share = float(np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6))
    model = Model(rng.normal(0, 0.05, (1 << BITS, DIM)).astype(np.float32), rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.array([0.0, np.log(share / (1 - share))]))
    if not 0 < y.sum() < len(y):
        model.weights[:] = 0
        return model
    e, w, bias = model.embeddings, model.weights, model.bias
    met = np.zeros((2, len(e)))
    for text, label in zip(texts, y):
        met[int(label), np.unique(ngrams(text)[0])] += 1
    known = met.sum(axis=0) >= MIN_TEXTS
    known[0] = False
    # The first dimension starts from the smoothed log-odds of texts that hold the n-gram, the others from small noise.
    odds = np.log((met[1] + SMOOTH) / (y.sum() + 2 * SMOOTH)) - np.log((met[0] + SMOOTH) / (len(y) - y.sum() + 2 * SMOOTH))
    e[:, 0] = odds
    w[0] = [-START, START]
    e[~known] = 0
    seen_e, seen_w, seen_b = np.full(len(e), 1e-6, np.float32), np.full(w.shape, 1e-6, np.float32), np.full(2, 1e-2)
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            scorer = model.scorer()
            grad_w, grad_b = np.zeros_like(w), np.zeros(2)
            ids_all, grads_all = [], []
            for i in order[at : at + BATCH]:
                buckets, words = ngrams(texts[i])
                if buckets.shape[1] == 0:
                    continue
                logit, count, a, b = scorer.window_means(buckets, words)
                best = int(logit.argmax())
                ids = buckets[:, a[best] : b[best]].ravel()
                ids = ids[known[ids]]
                if not len(ids):
                    continue
                mean = e[ids].sum(axis=0) / count[best]
                z = mean @ w + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                delta = p - (np.array([0.0, 1.0]) if y[i] else np.array([1.0, 0.0]))
                grad_w += np.outer(mean, delta).astype(np.float32)
                grad_b += delta
                ids_all.append(ids)
                grads_all.append(np.repeat((w @ delta / count[best])[None, :], len(ids), axis=0).astype(np.float32))
            if not ids_all:
                continue
            ids, where = np.unique(np.concatenate(ids_all), return_inverse=True)
            grad_e = np.zeros((len(ids), DIM), np.float32)
            np.add.at(grad_e, where, np.concatenate(grads_all))
            grad_e += DECAY * e[ids]
            seen_e[ids] += (grad_e**2).mean(axis=1)
            e[ids] -= rate * grad_e / np.sqrt(seen_e[ids])[:, None]
            seen_w += grad_w**2
            seen_b += grad_b**2
            w -= 0.2 * rate * grad_w / np.sqrt(seen_w)
            bias -= 0.2 * rate * grad_b / np.sqrt(seen_b)
    return model


def remainder(id_col: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, learns: Column, rows: int, chars: int) -> tuple[list[str], list[int]]:
    """The first ``rows`` labelled texts, in hash order, for which ``learns`` holds, but those that do not fit into ``chars`` characters with the ones before."""
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    texts = docs.filter(learns).select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    digest = F.xxhash64("doc_id", "text")
    chosen = texts.select("doc_id", digest.alias("digest"), F.length("text").alias("n")).join(marked, F.col("doc_id") == F.col("id")).select("doc_id", "digest", "n", "label")
    first = chosen.dropDuplicates(["doc_id", "digest"]).orderBy(F.xxhash64("doc_id"), "doc_id", "digest").limit(rows).collect()  # the documented bound
    kept, so_far = [], 0
    for r in first:
        if so_far + r.n <= chars:
            so_far += r.n
            kept.append((r.doc_id, r.digest, r.label))
    kind = chosen.schema
    chosen = docs.sparkSession.createDataFrame(kept, StructType([StructField("c_id", kind["doc_id"].dataType), StructField("c_digest", kind["digest"].dataType), StructField("label", kind["label"].dataType)]))
    hit = texts.join(F.broadcast(chosen), (F.col("doc_id") == F.col("c_id")) & (digest == F.col("c_digest")))
    hit = hit.groupBy("doc_id", "c_digest").agg(F.first("text").alias("text"), F.first("label").alias("label"))  # rows that repeat teach once
    rows_ = sorted(hit.collect(), key=lambda r: (str(r.doc_id), r.text))
    return [r.text for r in rows_], [int(r.label == 1) for r in rows_]


def score_texts(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and a double column score (which replaces one of that name).  A null or empty text gets the bias's score."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    carried = [c for c in docs.columns if c != "score"]
    at = carried.index(text_col)

    def run(batches):
        model = shared.value
        for batch in in_slices(batches, at):
            scores = [model.score(t or "") for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*carried, "score"])

    base = docs.select(*carried)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema], "score double"])
    return base.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", folds: int = 4, held_out: int = 2) -> DataFrame:
    """All columns of ``docs``, then score, held_out, predicted (which replace columns of those names).

    Learns only from labelled rows whose crc32(id as text) mod ``folds`` is not
    ``held_out``.  A null label teaches nothing; an id with two labels counts as
    toxic if one is.  Without labels of both classes every text gets the share
    of toxic ones (0.000001 without any label).  Rows come back one by one,
    repeated ones too; a null id is in the fold of the empty text.  A text of any
    length is scored whole, a block of words at a time.
    """
    texts, toxic = training_sample(docs, labels, id_col, text_col, label_col, remainder(id_col, folds) != held_out, TRAIN_ROWS, TRAIN_CHARS)
    docs = docs.drop("score", "held_out", "predicted")
    scored = score_texts(docs, fit(texts, toxic).scorer(), text_col)
    return scored.withColumns({"held_out": remainder(id_col, folds) == held_out, "predicted": (F.col("score") >= THRESHOLD).cast("int")})
