"""Phrase collocations from compressed position bitmaps.

The words of a shard of one language's texts get running positions; an empty one
parts pieces and texts, and a shifted bit that falls there meets no word.  A word
is a bitmap of its positions, of which only the bytes with a bit are kept.
Shifting a phrase's bitmap by one and ANDing it with those of the words that
share a byte with it extends the phrase; popcounts are its occurrences.  Phrases
are extended depth-first, the phrases of a few first words at a time, and the
popcounts of a phrase are summed over all shards.

Three passes over the texts, since no phrase is more frequent than its parts: the
first counts words; the second adds up pairs of frequent words by their cell of
the hash bitmap, two small numbers a row; the third counts the pairs whose hash is frequent and the triples
of two such pairs.  What is frequent comes to the tasks as a hash bitmap of fixed
size: a hit that is none costs a row of shuffle and is dropped by its exact count.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_slices, whole_text, written

LEAST, TOP, CONTAINED, SCALE, SALTS = 10, 2000, 50, 1_000_000, 64
#: Bytes of text in a shard, entries of first words that are extended together, and bits of the hash bitmap (16 MB).
SHARD, EXTENDED, FILTER_BITS = 4 << 20, 1 << 15, 27
#: Texts are lower-cased first, so a capital A can stand between pieces.
GAP = b"A"
_PIECES = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", GAP * 10)


class Filter:
    """Which words or pairs may be frequent: bits at the hash of a word, or at the joined hashes of two, of a size that the corpus does not change."""

    def __init__(self, bits: np.ndarray | None = None):
        self.bits = bits

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(hashes), bool)
        at = hashes & np.uint64(8 * len(self.bits) - 1)
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def word_hashes(lang: bytes, words: list[bytes]) -> np.ndarray:
    digest, before = xxhash.xxh64_intdigest, lang + b" "
    return np.array([digest(before + w, 42) for w in words], np.uint64)


def pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first ^ second >> np.uint64(20)


def word_hash() -> Column:
    """``word_hashes`` of the columns lang and phrase."""
    return F.xxhash64(F.concat_ws(" ", "lang", "phrase"))


def frequent_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> Filter:
    """The filter of rows with a column hash, put together by Spark in bitmaps of 4,096 bytes."""
    at = F.col("hash").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = hashes.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
    filled = np.zeros(1 << (bits - 3), np.uint8)
    for r in parts.collect():  # 2^bits / 32,768 rows at most
        filled[(r.bucket - 1) * 4096 : r.bucket * 4096] = np.frombuffer(bytes(r.bitmap), np.uint8)
    return Filter(filled)


def token_blocks(texts: list[str], most: int = SHARD) -> Iterator[tuple[list[bytes], int]]:
    """(words and gaps, number of words carried) of texts: a long text comes in blocks, each led by up to two words of the one before, which are not counted again."""
    data = GAP.join(t.encode().lower().translate(_PIECES) for t in texts).replace(GAP, b" A ")
    start, carried = 0, []
    while start < len(data):
        stop = data.find(b" ", start + most)
        stop = len(data) if stop < 0 else stop
        tokens = carried + data[start:stop].split()
        yield tokens, len(carried)
        start, carried = stop, tokens[-2:]
        if GAP in carried:
            carried = carried[carried.index(GAP, len(carried) - 1 if carried[-1] == GAP else 0) + 1 :]


def word_counts(tokens: list[bytes], carried: int) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of a shard and their occurrences but for the carried ones."""
    counts = Counter(tokens)
    counts.subtract(tokens[:carried])
    counts.pop(GAP, None)
    return list(counts), np.fromiter(counts.values(), np.int64, len(counts))


class Shard:
    """The position bitmaps of a shard's words: word by word, each the bytes that have a bit."""

    def __init__(self, tokens: list[bytes], carried: int, lang: bytes, frequent: Filter, extended: int = EXTENDED):
        self.extended = extended
        self.names = list(set(tokens) - {GAP})
        number = {w: i for i, w in enumerate(self.names)}
        number[GAP] = -1
        ids = np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens))
        if frequent.bits is not None and self.names:
            self.hashes = word_hashes(lang, self.names)
            kept = np.append(frequent.has(self.hashes), False)
            ids[~kept[ids]] = -1
        at = np.flatnonzero(ids >= 0)
        keys = ids[at] << 32 | at >> 3
        order = np.argsort(keys)
        heads = np.flatnonzero(np.diff(keys[order], prepend=-1))
        self.words, self.bytes_at = keys[order][heads] >> 32, keys[order][heads] & 0xFFFFFFFF
        bits = np.left_shift(1, at & 7).astype(np.uint8)[order]
        self.bits = np.bitwise_or.reduceat(bits, heads) if len(heads) else bits
        #: By byte: which words have a bit there.
        self.by_byte = np.argsort(self.bytes_at)
        self.starts = np.searchsorted(self.bytes_at[self.by_byte], np.arange((len(ids) >> 3) + 3))
        self.dir_words, self.dir_bits = self.words[self.by_byte], self.bits[self.by_byte]
        self.fresh = np.uint8(0xFF & ~((1 << carried) - 1))

    def extend(self, phrases: np.ndarray, bytes_at: np.ndarray, bits: np.ndarray):
        """Bitmaps of the phrases with one more word: (phrase and word as one key, byte, bits), ordered by key."""
        over = bits >> 7 > 0
        phrases, bytes_at = np.concatenate([phrases, phrases[over]]), np.concatenate([bytes_at, bytes_at[over] + 1])
        bits = np.concatenate([bits << 1, np.ones(int(over.sum()), np.uint8)])
        width = self.starts[bytes_at + 1] - self.starts[bytes_at]
        source = np.repeat(np.arange(len(width)), width)
        entry = np.arange(len(source)) + np.repeat(self.starts[bytes_at] - np.cumsum(width) + width, width)
        met = self.dir_bits[entry] & bits[source]
        good = np.flatnonzero(met)
        source, entry = source[good], entry[good]
        keys = phrases[source] * len(self.names) + self.dir_words[entry]
        order = np.argsort(keys)
        return keys[order], bytes_at[source][order], met[good][order]

    def popcounts(self, keys: np.ndarray, bytes_at: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys, occurrences): those that end among carried words were counted in the block before."""
        heads = np.flatnonzero(np.diff(keys, prepend=-1))
        counted = np.bitwise_count(np.where(bytes_at == 0, bits & self.fresh, bits)).astype(np.int64)
        return keys[heads], np.add.reduceat(counted, heads) if len(heads) else counted

    def runs(self) -> Iterator[slice]:
        """The bitmaps of a few words at a time."""
        first = 0
        while first < len(self.words):
            last = int(np.searchsorted(self.words, self.words[min(first + self.extended, len(self.words)) - 1], "right"))
            yield slice(first, last)
            first = last

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes and occurrences of all pairs."""
        n = len(self.names)
        for run in self.runs():
            keys, counts = self.popcounts(*self.extend(self.words[run], self.bytes_at[run], self.bits[run]))
            keys, counts = keys[counts > 0], counts[counts > 0]
            yield pair_hashes(self.hashes[keys // n], self.hashes[keys % n]), counts

    def longer(self, frequent: Filter) -> Iterator[tuple[pa.Array, np.ndarray]]:
        """Occurrences of the pairs that may be frequent, and of the triples of two such pairs."""
        n, words = len(self.names), pa.array(self.names, pa.string())
        for run in self.runs():
            keys, bytes_at, bits = self.extend(self.words[run], self.bytes_at[run], self.bits[run])
            good = frequent.has(pair_hashes(self.hashes[keys // n], self.hashes[keys % n]))
            keys, bytes_at, bits = keys[good], bytes_at[good], bits[good]
            pairs, counts = self.popcounts(keys, bytes_at, bits)
            names = pc.binary_join_element_wise(words.take(pa.array(pairs // n)), words.take(pa.array(pairs % n)), " ")
            yield names, counts
            # Pairs are numbered within the run, so that a pair and a word fit one key.
            found, counts = self.popcounts(*self.extend(np.cumsum(np.diff(keys, prepend=-1) != 0) - 1, bytes_at, bits))
            first, last = found // n, found % n
            good = (counts > 0) & frequent.has(pair_hashes(self.hashes[pairs[first] % n], self.hashes[last]))
            yield pc.binary_join_element_wise(names.take(pa.array(first[good])), words.take(pa.array(last[good])), " "), counts[good]


WORDS, PAIRS, LONGER = "words", "pairs", "longer"


def shard_counts(docs: DataFrame, what: str, frequent_words=None, frequent_pairs=None, shard_bytes: int = SHARD, extended: int = EXTENDED) -> DataFrame:
    """(lang, phrase, f): all occurrences of words or of longer phrases that the broadcast filters let pass; of ``PAIRS``, (hash, f) by the bits of the hash that the filter has."""
    schema = pa.schema([("hash", pa.int64()), ("f", pa.int64())] if what == PAIRS else [("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])

    def count(batches):
        of_words = frequent_words.value if frequent_words else Filter()
        of_pairs = frequent_pairs.value if frequent_pairs else None
        waiting, held = defaultdict(list), defaultdict(int)

        def counted(lang: str):
            held.pop(lang)
            for tokens, carried in token_blocks(waiting.pop(lang), shard_bytes):
                shard = None if what == WORDS else Shard(tokens, carried, lang.encode(), of_words, extended)
                if what == PAIRS:
                    for hashes, counts in shard.pairs():
                        cells = (hashes & np.uint64((1 << FILTER_BITS) - 1)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts)], schema=schema)
                    continue
                for phrases, counts in [word_counts(tokens, carried)] if what == WORDS else shard.longer(of_pairs):
                    langs = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(phrases), np.int32)), [lang]).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([langs, pa.array(phrases, pa.string()), pa.array(counts)], schema=schema).filter(pa.array(counts > 0))

        for batch in in_slices(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                waiting[lang].append(text)
                held[lang] += len(text)
                if held[lang] >= shard_bytes:
                    yield from counted(lang)
            while sum(held.values()) >= 3 * shard_bytes:  # of many languages the one with most text goes first
                yield from counted(max(held, key=held.get))
        for lang in list(waiting):
            yield from counted(lang)

    by = schema.names[:-1]
    return docs.mapInArrow(count, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in schema)).groupBy(*by).agg(F.sum("f").alias("f"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, contained: int = CONTAINED, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two and three words of each language.

    A phrase occurs ``a`` times, its parts at the lowest-scoring cut ``l`` and
    ``r`` times, and the language has ``n`` words; score is 1,000,000 a² / (l r),
    rounded down.  Phrases of fewer than ``least`` occurrences are left out, and so
    are those inside a longer one that is at least ``contained`` % as frequent.
    Languages are apart, a null one counts as ``und``.  Null and empty texts have no
    word; a text of any length is taken in blocks of a few MB; equal rows count as often as they
    stand there; other columns are ignored.  No document: no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    words, _ = written(shard_counts(texts, WORDS))
    size = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.filter(F.col("f") >= least)
    in_words = spark.sparkContext.broadcast(frequent_filter(frequent.select(word_hash().alias("hash"))))
    in_pairs = spark.sparkContext.broadcast(frequent_filter(shard_counts(texts, PAIRS, in_words).filter(F.col("f") >= least)))
    longer = shard_counts(texts, LONGER, in_words, in_pairs).filter(F.col("f") >= least)
    longer, _ = written(longer.withColumn("words", F.size(F.split("phrase", " "))))
    return ranked(frequent, longer.filter("words = 2"), longer.filter("words = 3"), size, top, contained)


def ranked(words: DataFrame, pairs: DataFrame, triples: DataFrame, size: DataFrame, top: int, contained: int) -> DataFrame:
    """Scores the frequent phrases by their exact counts; products are decimals, as they may pass 64 bits."""
    w = F.split("phrase", " ")
    inside = triples.select("lang", F.explode(F.array(F.concat_ws(" ", w[0], w[1]), F.concat_ws(" ", w[1], w[2]))).alias("phrase"), "f")
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = pairs.join(inside, ["lang", "phrase"], "left").filter(F.coalesce(F.col("longer") * 100 < F.col("f") * contained, F.lit(True)))

    def cut(k: int, first, rest):
        return F.struct(F.lit(k).alias("k"), first.alias("first"), rest.alias("rest"))

    cuts = left.select("lang", "phrase", F.col("f").alias("a"), F.array(cut(1, w[0], w[1])).alias("cuts"))
    longer = F.array(cut(1, w[0], F.concat_ws(" ", w[1], w[2])), cut(2, F.concat_ws(" ", w[0], w[1]), w[2]))
    cuts = cuts.unionAll(triples.select("lang", "phrase", F.col("f").alias("a"), longer.alias("cuts"))).select("lang", "phrase", "a", F.inline("cuts"))
    parts = words.select("lang", "phrase", "f").unionAll(pairs.select("lang", "phrase", "f"))
    for part, count in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(count)), ["lang", part])
    cuts = cuts.withColumns({c: F.col(c).cast("decimal(15,0)") for c in ("l", "r")}).withColumn("d", F.col("a").cast("decimal(15,0)"))
    score = F.expr(f"(d * d * CAST({SCALE} AS DECIMAL(7,0))) div (l * r)")
    lowest = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"))).alias("c"))
    found = lowest.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    # The first of each of SALTS parts of a language come before the first of the whole, so no task ranks more than SALTS * top of its phrases.
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))], ["lang"]):
        order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
        found = found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return found.join(size, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
