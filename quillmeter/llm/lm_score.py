"""Language-model scores of texts: a unigram base from corpus counts, and a causal self-attention model.

1. Every training text's words are counted (map-side, then one shuffle of
   distinct words); the table of counts is written to the shared folder.
2. The distinct words are cut into subword ids once each, which gives the
   training corpus' count of every id: a row for each id of the vocabulary.
3. One pass over all texts writes them as ids to a table of the shared folder.
   Words among the ``FREQUENT`` most frequent are looked up in a broadcast table;
   the others leave the pass as (document, word, number) rows and meet their
   counts in a join.  The ids' neighbours are counted in all training texts, and
   the attention weights are trained on all of them.
   The texts are dealt over parts of about ``PART_IDS`` ids by the hash of their
   id and text, and the parts over ``ROUNDS`` rounds.  In a round, each of its
   parts (all parts, where the corpus has fewer than ``LEAST_STEPS`` steps) is
   gone through in the order of those hashes, from the same weights, and the
   results are averaged by what each part has seen (``trained``).  So the model
   depends on the texts alone, and not on files, partitions or executors.
4. All texts, as ids of the same table, are scored.

What comes to the driver has a fixed size: a row for each id, sums of as many
weights as the model has, and the frequent words.
"""

from __future__ import annotations

from itertools import chain, groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm as lm
from .common import discard, in_slices, whole_text, written
from .toxicity import remainder

MODEL = "piece_bpe_32k.model"
FREQUENT, CACHED_WORDS, CACHED_IDS = 1 << 17, 400_000, 4_000_000
#: Rounds of training, and ids in a part of the texts; a small corpus is gone through more often, until there are so many steps.
ROUNDS, PART_IDS, LEAST_STEPS = 4, 1 << 20, 400
#: Windows of a part that are trained on at a time, in random order; fixed-point digits of averaged weights; weights in a row of their sums.
WINDOWS, FIXED, ROW = 1 << 15, 1 << 20, 16
#: Bytes of texts whose words are counted, or looked up, at a time (a longer text alone).
COUNTED, LOOKED_UP = 8 << 20, 2 << 20


def words_of(text: str) -> list[bytes]:
    """Words end at white space; A-Z count as a-z."""
    return text.encode().lower().split()


def split(texts: pa.Array) -> pa.Array:
    """``words_of`` each text, and empty strings where white space leads or ends it."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word binary, n) of (text): how often each word occurs."""

    def counted(texts: list[pa.Array]):
        found = pa.chunked_array([split(x).flatten() for x in texts]).value_counts()
        words, n = (found.field(i) for i in range(2))
        full = pc.greater(pc.binary_length(words), 0)
        return pa.RecordBatch.from_arrays([words.filter(full).cast(pa.binary()), n.filter(full)], ["word", "n"])

    def run(batches):
        held, size = [], 0
        for batch in in_slices(batches, 0, COUNTED, 1 << 20):
            held.append(batch.column(0))
            size += pc.sum(pc.binary_length(held[-1])).as_py() or 0
            if size >= COUNTED:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def id_counts(counts: DataFrame, model_path: str) -> DataFrame:
    """(id, n) of (word, n): how often each subword id occurs, each distinct word being cut once."""

    def run(batches):
        encode, size = _encoder(model_path)
        total = np.zeros(size, np.int64)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for at in range(0, len(words), 5000):
                ids = encode([w.decode() for w in words[at : at + 5000]])
                np.add.at(total, np.fromiter(chain.from_iterable(ids), np.int64), np.repeat(n[at : at + 5000], [len(x) for x in ids]))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["id", "n"])

    return counts.select("word", "n").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


_encoders: dict = {}


def _encoder(model_path: str):
    if model_path not in _encoders:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        _encoders[model_path] = (lambda words: model.encode(words, num_threads=1)), model.get_piece_size()
    return _encoders[model_path]


class _Slots(dict):
    """Gives each word that it meets the next number."""

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        return at


class Words:
    """What a worker knows of the words met lately, within bounds: their ids, and the log count of frequent ones."""

    def __init__(self, model_path: str, frequent: dict[bytes, float]):
        self.encode, _ = _encoder(model_path)
        self.frequent = frequent
        self.slot = _Slots()
        self.words: list[bytes] = []
        self.ids = np.zeros(1 << 20, np.uint16)
        self.start, self.length, self.log = np.zeros(1 << 17, np.int64), np.zeros(1 << 17, np.int64), np.zeros(1 << 17)
        self.used = self.kept = 0

    def reset(self) -> None:
        """Forgets all words but the frequent ones."""
        keep = np.flatnonzero(~np.isnan(self.log[: len(self.words)]))
        words, ids, length = [self.words[i] for i in keep.tolist()], self.ids_of(keep), self.length[keep]
        self.slot, self.words, self.used, self.kept = _Slots(zip(words, range(len(words)))), [], 0, len(words)
        self.add(words, ids, length)

    def learn(self, new: list[bytes]) -> None:
        coded = self.encode([w.decode() for w in new])
        length = np.fromiter(map(len, coded), np.int64, len(coded))
        self.add(new, np.fromiter(chain.from_iterable(coded), np.uint16, int(length.sum())), length)

    def add(self, new: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        at, more, n = len(self.words), len(new), len(ids)
        while at + more > len(self.start):
            self.start, self.length, self.log = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.log))
        while self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + n] = ids
        self.start[at : at + more] = self.used + np.cumsum(lengths) - lengths
        self.length[at : at + more] = lengths
        self.log[at : at + more] = [self.frequent.get(w, np.nan) for w in new]
        self.words.extend(new)
        self.used += n

    def slots(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, good until the next call."""
        if len(self.slot) - self.kept > CACHED_WORDS or self.used > CACHED_IDS:
            self.reset()
        found = np.fromiter(map(self.slot.__getitem__, words), np.int64, len(words))
        if len(self.slot) > len(self.words):
            self.learn(list(islice(reversed(self.slot), len(self.slot) - len(self.words)))[::-1])
        return found

    def ids_of(self, slots: np.ndarray) -> np.ndarray:
        length = self.length[slots]
        return self.ids[np.repeat(self.start[slots] - (np.cumsum(length) - length), length) + np.arange(length.sum())]


def _tasks(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _ids(batches):
    return (np.frombuffer(ids, "<u2").astype(np.int64) for batch in batches for ids in batch.column(0).to_pylist())


def _by_part(batches):
    """(part, its texts' ids) of rows (ids, part) that have the rows of a part one behind the other."""
    rows = ((part, np.frombuffer(ids, "<u2").astype(np.int64)) for batch in batches for ids, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
    return ((part, (ids for _, ids in own)) for part, own in groupby(rows, itemgetter(0)))


def _summed(totals: DataFrame, size: int) -> np.ndarray:
    """The sums of whole numbers that tasks have in rows of ``ROW`` (at, n): a fixed number of rows reaches the driver.

    Upper and lower halves are summed apart, so that no sum passes 64 bits.
    """
    n, out = [F.get("n", F.lit(i)) for i in range(ROW)], np.zeros((-(-size // ROW), ROW))
    halves = [F.sum(F.shiftright(x, 32)).alias(f"u{i}") for i, x in enumerate(n)] + [F.sum(x.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"l{i}") for i, x in enumerate(n)]
    for r in totals.groupBy("at").agg(*halves).collect():
        out[r.at] = np.array(r[1 : ROW + 1], float) * 2.0**32 + np.array(r[ROW + 1 :], float)
    return out.ravel()[:size]


def _rows_of(total: np.ndarray) -> pa.RecordBatch:
    rows = np.concatenate([total, np.zeros(-len(total) % ROW, np.int64)]).reshape(-1, ROW)
    at = np.flatnonzero(rows.any(axis=1))
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(list(rows[at]), pa.list_(pa.int64()))], ["at", "n"])


def neighbour_counts(texts: DataFrame, counts: np.ndarray) -> np.ndarray:
    """``lm.neighbours`` of all texts (ids), in no more tasks than a shuffle has, as each may give a row for every id."""
    column, wide = lm.columns(counts), 2 * (lm.NEAR + 1)

    def run(batches):
        yield _rows_of(lm.neighbours(_ids(batches), column).ravel())

    return _summed(texts.select("ids").coalesce(_tasks(texts.sparkSession)).mapInArrow(run, "at long, n array<long>"), len(counts) * wide).reshape(-1, wide)


def trained(texts: DataFrame, counts: np.ndarray) -> lm.Scorer:
    """The model of all texts (key, ids).

    An embedding is averaged over the parts by how often each has seen the id,
    other weights by windows.  Sums are of fixed-point integers, so their order
    does not matter, and a task that has several parts adds them up itself.
    """
    spark = texts.sparkSession
    class_of = lm.classes(neighbour_counts(texts, counts), counts)
    w = lm.initial(counts, class_of)
    size, rest = len(counts), [n for n in w if n != "e"]
    steps = max(1, int(counts.sum()) // (lm.STEP * lm.BATCH))
    epochs = max(1, -(-LEAST_STEPS // steps))
    passes = -(-epochs // ROUNDS)
    parts = max(ROUNDS if epochs == 1 else 1, -(-int(counts.sum()) // PART_IDS))
    texts = texts.withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
    length = size * (1 + lm.DIM) + sum(w[k].size for k in rest) + 1
    for round_ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((w, class_of))
        rate = 1 - 0.9 * round_ / ROUNDS

        def run(batches, shared=shared, round_=round_, rate=rate):
            start, of = shared.value
            total = np.zeros(length, np.int64)
            for part, own_texts in _by_part(batches):
                own = {n: x.copy() for n, x in start.items()}
                trainer, rng = lm.Trainer(own, of), np.random.default_rng((lm.SEED, round_, part))
                seen, n = np.zeros(size, np.int64), 0
                for some in lm.batched(own_texts, WINDOWS * lm.STEP):
                    tokens, targets, first = lm.windows(some)
                    for _ in range(passes):
                        trainer.go(tokens, targets, first, rng, lambda done: rate)
                    seen += np.bincount(tokens[targets >= 0], minlength=size)
                    n += len(tokens)
                fixed = {k: np.rint(x.astype(np.float64) * FIXED).astype(np.int64) for k, x in own.items()}
                total += np.concatenate([seen, (fixed["e"] * seen[:, None]).ravel(), *(fixed[k].ravel() * n for k in rest), [n]])
            yield _rows_of(total)

        own_texts = texts.filter(F.col("part") % ROUNDS == round_) if epochs == 1 else texts
        own_texts = own_texts.repartition(min(_tasks(spark), parts), "part").sortWithinPartitions("part", "key", "ids")
        total = _summed(own_texts.select("ids", "part").mapInArrow(run, "at long, n array<long>"), length)
        shared.unpersist()
        if not total[-1]:
            continue
        seen, at = total[:size], size * (1 + lm.DIM)
        e = total[size:at].reshape(size, lm.DIM) / (np.maximum(seen, 1)[:, None] * FIXED)
        w = {**w, "e": np.where(seen[:, None] > 0, e, w["e"]).astype(np.float32)}
        for k in rest:
            w[k] = (total[at : at + w[k].size] / (total[-1] * FIXED)).reshape(w[k].shape).astype(np.float32)
            at += w[k].size
    return lm.scorer(w, class_of, counts)


def frequent_words(counts: DataFrame, most: int) -> dict[bytes, float]:
    """Log counts of all words that occur at least so often that no more than ``most`` do; at most ``most`` rows reach the driver."""
    level = F.least(F.floor(F.log2(F.col("n")) * 8), F.lit(500)).cast("int")
    by_level = sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("words")).collect(), key=lambda r: -r.level)  # some hundred rows
    total, least = 0, None
    for r in by_level:
        total += r.words
        if total > most:
            break
        least = r.level
    if least is None:
        return {}
    return {bytes(r.word): float(np.log10(r.n + 0.5)) for r in counts.filter(level >= least).collect()}


def looked_up(words: Words, texts: pa.Array) -> list[pa.Array]:
    """(words, frequent ones, their summed log counts, other words and their numbers, ids) of each text.

    The words of all these texts are looked up once each.
    """
    found = split(texts)
    n, at = len(texts), found.flatten().dictionary_encode()
    text = np.repeat(np.arange(n), pc.list_value_length(found).to_numpy(zero_copy_only=False))
    which, found = at.indices.to_numpy(), at.dictionary.cast(pa.binary())
    if (empty := found.index(b"").as_py()) >= 0:
        full = which != empty
        text, which = text[full], which[full] - (which[full] > empty)
        found = found.filter(pc.greater(pc.binary_length(found), 0))
    slots = words.slots(found.to_pylist())
    log = words.log[slots]
    unknown = np.isnan(log)
    rare = unknown[which]
    pair, times = np.unique(text[rare] * len(found) + which[rare], return_counts=True)
    total, others = np.bincount(text, minlength=n), np.bincount(pair // max(1, len(found)), minlength=n)
    ids = words.ids_of(slots[which]).astype("<u2", copy=False)
    ends = 2 * np.cumsum(np.bincount(text, weights=words.length[slots][which], minlength=n).astype(np.int64))
    pairs = pa.StructArray.from_arrays([found.take(pa.array(pair % max(1, len(found)))), pa.array(times, pa.int64())], ["word", "times"])
    return [
        pa.array(total, pa.int64()),
        pa.array(total - np.bincount(text[rare], minlength=n), pa.int64()),
        pa.array(np.bincount(text, weights=np.where(unknown, 0, log)[which], minlength=n), pa.float64()),
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(others)]), pa.int32()), pairs),
        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(ids)]),
    ]


_workers: dict[int, Words] = {}


def coded(base: DataFrame, model_path: str, frequent: dict[bytes, float]) -> DataFrame:
    """(doc_id, held_out, key, words, known, log, others, ids) of (doc_id, held_out, text).

    ids: all of the text as little-endian 16-bit subword ids; key: the hash that
    deals texts out for training and orders them; others: words that are not frequent.
    """
    shared = base.sparkSession.sparkContext.broadcast(frequent)
    shared_id = shared._jbroadcast.id()

    def run(batches):
        if shared_id not in _workers:
            _workers.clear()
            _workers[shared_id] = Words(model_path, shared.value)
        for batch in in_slices(batches, 3, LOOKED_UP):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *looked_up(_workers[shared_id], batch.column(3))], ["doc_id", "held_out", "key", "words", "known", "log", "others", "ids"]
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.select("doc_id", "held_out", F.xxhash64("doc_id", "text").alias("key"), "text").mapInArrow(
        run, f"doc_id {kind}, held_out boolean, key long, words long, known long, log double, others array<struct<word: binary, times: long>>, ids binary"
    )


def scored(rows: DataFrame, scorer: lm.Scorer) -> DataFrame:
    """All columns of ``rows`` but ids, and score: the model's log10 probability of the text that they are."""
    shared = rows.sparkSession.sparkContext.broadcast(scorer)
    carried = [c for c in rows.columns if c != "ids"]

    def run(batches):
        for batch in in_slices(batches, len(carried), 1 << 20, 2048):
            score = shared.value.score(list(_ids([batch.select(["ids"])])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64())], [*carried, "score"])

    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*carried).schema], "score double"])
    return rows.select(*carried, "ids").mapInArrow(run, schema)


def lm_score(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 1) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) with one row for every row of ``docs``.

    Learns from documents whose crc32(id as text) mod ``folds`` is not
    ``held_out``.  A null or empty text is its end alone; a null id is in the
    fold of the empty text; repeated rows count, and come back, one by one.
    Without training documents every count is 0 and the model is untrained.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), (remainder(id_col, folds) == held_out).alias("held_out"))
    learn = base.filter(~F.col("held_out"))
    counts, counts_path = written(word_counts(learn))
    n_docs = learn.count()
    n_words, n_distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    train_tokens, vocabulary = n_words + n_docs, n_distinct + (n_docs > 0)
    below = float(np.log10(train_tokens + 0.5 * (vocabulary + 1)))

    _, size = _encoder(model_path)
    ids = np.zeros(size)
    for r in id_counts(counts, model_path).collect():  # one row an id of the vocabulary at most
        ids[r.id] = r.n
    ids[lm.END] += n_docs
    passed = coded(base, model_path, frequent_words(counts, FREQUENT))
    passed, passed_path = written(passed.withColumn("row", F.monotonically_increasing_id()))  # written once, so a row keeps its number
    scorer = trained(passed.filter(~F.col("held_out")).select("key", "ids"), ids)
    rare = passed.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.times")
    known = counts.select(F.col("word").alias("counted"), "n")
    rare = rare.join(known, F.col("word") == F.col("counted"), "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log")
    )
    rare = rare.withColumnRenamed("row", "rare_row")
    out = scored(passed.select("row", "doc_id", "held_out", "words", "known", "log", "ids"), scorer).join(rare, F.col("row") == F.col("rare_row"), "left")
    end = float(np.log10(n_docs + 0.5))
    n_tokens = F.col("words") + 1
    result = out.select(
        "doc_id",
        "held_out",
        n_tokens.alias("n_tokens"),
        (F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(n_docs > 0))).cast("long").alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("log") + F.coalesce("rare_log", F.lit(0.0)) + end - n_tokens * below).alias("base_score"),
        "score",
    )
    result, _ = written(result)
    discard(spark, counts_path, passed_path)
    return result
