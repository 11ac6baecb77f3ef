"""No row, text or candidate is left out for its place, length or neighbours; the model operators against naive versions."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmeter.llm import ann_search as A
from quillmeter.llm import secret_scan as S
from quillmeter.llm import toxicity as T

from test_text_operators import WORDS


def test_one_vector_of_another_length_does_not_empty_the_result(spark):
    rng = np.random.default_rng(1)
    rows = [(0, [1.0, 2.0])] + [(i, rng.normal(size=8).tolist()) for i in range(1, 301)] + [(None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit("clash"), "cell": F.lit(1), "score": F.lit(2)})
    got = A.ann_search(df).collect()
    assert Counter(r.query_id for r in got) == {100: 10, 200: 10, 300: 10} and all(r.vec_id for r in got)


def test_only_a_text_that_does_not_fit_is_left_out(spark):
    rows = [(i, "word " * (30 if i != 7 else 5000)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    texts, toxic = T.training_sample(docs, labels, "doc_id", "text", "toxic", F.lit(True), 100, 10_000)
    assert len(texts) == 39 and sum(toxic) == 19


def naive_score(scorer, text):
    """The most toxic window of twelve words, each n-gram hashed by itself."""

    def bucket(gram):
        h = 0
        for b in gram:
            h = (h * 0x9E3779B1 + b + 1) % 2**32
        return ((h ^ (h >> 15)) * 0x85EBCA77) % 2**32 >> (32 - T.BITS)

    words = text.lower().encode().split()
    best = -math.inf
    for first in range(0, max(len(words) - T.STRIDE, 1), T.STRIDE):
        window, grams = words[first : first + T.WINDOW], []
        for i, w in enumerate(window):
            framed = b" " + w + (b" " if i + 1 < len(window) or first + i + 1 <= len(words) else b"")
            grams += [framed[a : a + n] for n in T.SIZES for a in range(len(framed) - n + 1)]
        hits = [scorer.logits[b] for g in grams if (b := bucket(g))]
        best = max(best, sum(map(float, hits)) / max(len(hits), 1))
    return 1 / (1 + math.exp(-max(-60, min(60, best + scorer.bias))))


def test_scores_are_those_of_each_window_alone():
    rng = np.random.default_rng(3)
    logits = rng.normal(size=1 << T.BITS).astype(np.float32)
    logits[0] = 0
    scorer, pick = T.Scorer(logits, -0.3), random.Random(4)
    texts = ["", " \n", "a", "ab", "Éa b", "x" * 300] + [" ".join(pick.choice(WORDS) for _ in range(n)) for n in (1, 6, 7, 12, 13, 18, 19, 100)]
    for text in texts:
        assert scorer.score(text) == pytest.approx(naive_score(scorer, text), rel=1e-9)


def test_blocks_of_words_and_bytes_score_alike():
    rng = np.random.default_rng(5)
    logits = rng.normal(size=1 << T.BITS).astype(np.float32)
    logits[0] = 0
    scorer, pick = T.Scorer(logits, 0.1), random.Random(6)
    for n in (1, 5, 11, 12, 13, 24, 29, 30, 31, 200):
        words = [pick.choice(WORDS).lower().encode() for _ in range(n)]
        text = b" ".join(words).decode()
        whole = scorer.word_means(words)
        parts = [scorer.word_means(b, 7) for b in T.word_blocks(text, 12, 9)]
        assert np.allclose(np.concatenate(parts), whole) and [w for b in T.word_blocks(text, 10**6) for w in b] == words


def test_a_very_long_text_is_scored_in_little_memory():
    import tracemalloc

    scorer, text = T.Scorer(np.ones(1 << T.BITS, np.float32), 0.0), "some words of a very long text " * 400_000
    tracemalloc.start()
    scorer.score(text)
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert held < 12 * len(text)


def bare_identifiers(n, seed=8):
    rng = random.Random(seed)
    return ["_".join(rng.choice(WORDS) for _ in range(4)) + f"_v{rng.randrange(9)}_{rng.randrange(1990, 2030)}" for _ in range(n)]


def test_identifiers_alone_in_their_texts_are_no_secrets(spark):
    """Lists of identifiers have no prose in front: few are reported, without any decoy and with those of other documents."""
    names = bare_identifiers(400)
    alone = spark.createDataFrame(list(enumerate(names)), "doc_id long, text string")
    assert S.secret_scan(alone).filter(F.size("spans") > 0).count() <= 20
    rng = random.Random(9)
    prose = [(1000 + i, " ".join(rng.choice(WORDS) for _ in range(300)) + " " + "".join(rng.choice(S.ENCODINGS[4][2]) for _ in range(40))) for i in range(200)]
    prose += [(2000 + i, " ".join(rng.choice(WORDS) for _ in range(300)) + " " + name) for i, name in enumerate(bare_identifiers(200, 10))]
    got = S.secret_scan(alone.union(spark.createDataFrame(prose, alone.schema))).filter(F.exists("spans", lambda s: s["kind"] == 3))
    ids = [r.doc_id for r in got.collect()]
    assert sum(i < 1000 for i in ids) <= 20 and sum(1000 <= i < 2000 for i in ids) >= 160


def naive_p(token, alphabet):
    """Chi-squared by symbol and by class, runs and lag-1 serial correlation with the exact normal tail, joined by Fisher's method."""
    tail = lambda z: max(math.erfc(abs(z) / math.sqrt(2)), 1e-12)
    n, a = len(token), len(alphabet)
    counts = Counter(token)
    chi = sum((counts[c] - n / a) ** 2 / (n / a) for c in alphabet)

    def uneven(chi, k):
        z = ((max(chi, 0) / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
        return max(tail(z) / 2 if z >= 0 else 1 - tail(z) / 2, 1e-12)

    kind = lambda c: next(i for i, shape in enumerate(S.CLASSES) if re.match(shape, c))
    there, sizes = Counter(map(kind, token)), Counter(map(kind, alphabet))
    chi_class = sum((there[c] - n * size / a) ** 2 / (n * size / a) for c, size in sizes.items())
    x = [alphabet.index(c) - (a - 1) / 2 for c in token]
    up = sum(v > 0 for v in x)
    both = 2 * up * (n - up)
    runs = 1 + sum((u > 0) != (v > 0) for u, v in zip(x, x[1:]))
    runs_z = (runs - 1 - both / n) / math.sqrt(max(both * (both - n) / (n * n * (n - 1)), 1e-9)) if both else 9.0
    mean = sum(x) / n
    spread = sum((v - mean) ** 2 for v in x)
    serial_z = (sum((u - mean) * (v - mean) for u, v in zip(x, x[1:])) / spread + 1 / (n - 1)) * math.sqrt(n) if spread else 9.0
    half = -(math.log(uneven(chi, a - 1)) + math.log(uneven(chi_class, len(sizes) - 1)) + math.log(tail(runs_z)) + math.log(tail(serial_z)))
    return math.exp(-half) * (1 + half + half * half / 2 + half**3 / 6)


def naive_report(rows, fdr):
    """Which candidates the step-up of each stratum reports: rows are (key, encoding, n, p, decoy, paired)."""
    strata = {}
    for r in rows:
        strata.setdefault((r[1], math.floor(2 * math.log2(r[2]))), []).append(r)
    least, out = math.floor(-math.log10(S.LEAST_P) * S.BINS_PER_DECADE), set()
    place = lambda p: min(math.floor(-math.log10(max(p, 1e-300)) * S.BINS_PER_DECADE), S.BINS)
    for members in strata.values():
        cut = None
        for b in sorted({place(m[3]) for m in members}):
            above = [m for m in members if place(m[3]) <= b]
            if sum(m[4] for m in above) <= fdr * sum(not m[4] and m[5] for m in above):
                cut = b
        if cut is not None:
            out |= {m[0] for m in members if not m[4] and place(m[3]) <= min(cut, least)}
    return out


def test_the_battery_and_the_step_up_are_the_naive_ones(spark):
    rng = random.Random(12)
    rows = []
    for i in range(300):
        alphabet = rng.choice(S.ENCODINGS)[2]
        token = "".join(rng.choice(alphabet) for _ in range(rng.choice([20, 33, 64]))) if i % 2 else bare_identifiers(1, i)[0]
        rows.append((i, token, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 3, 100])))))
    rows += [(900, "z1" + "xy" * 1500, " ".join(WORDS * 2)), (901, "A" * 19 + "1", "x"), (902, "1" * 30 + "a", "")]
    tested = S.tested(spark.createDataFrame(rows, "key long, match string, before string")).persist()
    told = tested.collect()
    alphabets = {n: a for n, _, a in S.ENCODINGS}
    by_key = {k: t for k, t, _ in rows}
    checked = 0
    for r in told:
        if not r.decoy:
            token = by_key[r.key].lower() if r.encoding == "hex" else by_key[r.key]
            want = naive_p(token, alphabets[r.encoding])
            assert r.p == pytest.approx(want, rel=1e-3, abs=1e-6)
            checked += 1
    assert checked > 200 and any(r.key == 900 and r.decoy for r in told)  # a candidate longer than the prose in front has a decoy too
    got = {r.key for r in S.still_random(tested).collect()}
    assert got == naive_report([(r.key, r.encoding, r.n, r.p, r.decoy, r.paired) for r in told], S.FDR) and got
