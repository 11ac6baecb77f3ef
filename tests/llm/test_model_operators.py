"""Token counts, byte-level BPE, toxicity, near dedup, neighbours, language model, pipeline."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmeter.llm import ann_search as A
from quillmeter.llm import attention_lm, byte_bpe, dart_minhash, lm_score, near_dedup, toxicity
from quillmeter.llm import token_counts as T
from quillmeter.llm import components as components_module
from quillmeter.llm.common import vocabulary_path, written
from quillmeter.llm.components import components

AWKWARD = [None, "", " ", "  a  b ", "a\nb\n\n c", "\ta\t", "▁x▁ y", "日本語 テスト", "😀😀 é　ü", "<s> </s> <|endoftext|>", "a" * 3000, "ab" * 2000 + " z", "don't I'll 123 4,5", "\x00\x1c\x85 x", "word " * 4000]


def docs(spark, texts, ids=None):
    return spark.createDataFrame(list(zip(ids or range(len(texts)), texts)), "doc_id long, text string")


def random_texts(n=60, seed=1):
    rng = random.Random(seed)
    alphabet = ["a", "b", "the", "ing", " ", " ", "  ", "\n", "é", "中", "😀", "'s", "1", "▁", "-", "\t", ".", "Z"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(n)]


def test_token_counts_are_the_library_s(spark):
    texts = AWKWARD + random_texts()
    model = T.load(vocabulary_path(T.MODEL))
    df = docs(spark, texts).union(docs(spark, [None], [None])).withColumn("n_tokens", F.lit("clash"))
    got = T.token_counts(df, vocabulary_path(T.MODEL), limit=1000).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = (texts[r.doc_id] if r.doc_id is not None else "") or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 1000)
    assert T.token_counts(df.limit(0), vocabulary_path(T.MODEL)).count() == 0


def test_a_small_cache_counts_alike():
    lengths = T.Lengths(vocabulary_path(T.MODEL), {"the": 1}, cached=3)
    assert all(lengths.of(t or "") == len(lengths.encode(t or "")) for t in AWKWARD + random_texts(seed=3))


@pytest.fixture(scope="module")
def reference_encoding():
    import tiktoken

    ranks = byte_bpe.read_ranks(vocabulary_path(byte_bpe.VOCABULARY))
    return ranks, tiktoken.Encoding("own", pat_str=byte_bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_library_s_and_comes_back(spark, reference_encoding):
    texts = AWKWARD + random_texts(seed=2)
    got = byte_bpe.byte_bpe(docs(spark, texts).withColumn("ids", F.lit(0)), vocabulary_path(byte_bpe.VOCABULARY), byte_bpe.default_pattern()).collect()
    hashed = byte_bpe.byte_bpe(docs(spark, texts), vocabulary_path(byte_bpe.VOCABULARY), byte_bpe.default_pattern(), carry=["doc_id"], give=("restored", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == len(hashed) == len(texts)
    for r, h in zip(sorted(got, key=lambda r: r.doc_id), sorted(hashed, key=lambda r: r.doc_id)):
        t = texts[r.doc_id] or ""
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == reference_encoding[1].encode_ordinary(t) and bytes(r.decoded) == t.encode() and r.n_tokens == len(ids)
        assert (h.n_tokens, h.ids_sha256, h.decoded_sha256) == (len(ids), hashlib.sha256(r.ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_bpe_with_a_tiny_cache_and_long_pieces(reference_encoding):
    ranks, library = reference_encoding
    coder = byte_bpe.Encoder(ranks, byte_bpe.default_pattern(), cached=2)
    rng = random.Random(8)
    for t in random_texts(80, 9) + ["".join(rng.choice("abeé") for _ in range(30_000)), "a" * 10_001]:
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == library.encode_ordinary(t)


def test_rank_queue_pops_in_order():
    queue, rng = byte_bpe.RankQueue(50_000), random.Random(1)
    ranks = rng.sample(range(50_000), 500)
    for r in ranks:
        queue.add(r, [r])
    assert [queue.pop()[0] for _ in ranks] == sorted(ranks) and queue.root == 0


def labelled(spark, n=600, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ta", "ri", "mo", "ne", "lu", "sha"]) for _ in range(rng.choice([2, 3]))) for _ in range(300)]
    bad = ["worthless", "pathetic", "disgusting", "moronic"]
    rows, labels = [], []
    for i in range(n):
        body = [rng.choice(words) for _ in range(rng.choice([5, 40, 400]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                body[rng.randrange(len(body))] = rng.choice(bad)
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"), words


def test_toxicity_holds_out_and_generalises(spark):
    df, labels, words = labelled(spark)
    more = spark.createDataFrame([(9001, None), (9002, ""), (None, "x"), (9003, " ".join(words[:30]) + " worthlesss patheticc disgustingg"), (9004, " ".join(words[:50]))], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(df.union(more).withColumn("score", F.lit("clash")), labels).collect()}
    assert len(got) == 605
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (i in set(held)) for i in truth)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    assert got[9003].score > got[9004].score and got[9003].predicted == 1 and got[9004].predicted == 0  # misspellings nobody has seen
    assert 0 <= got[9001].score == got[9002].score <= 1


def test_toxicity_of_odd_labels_and_long_texts(spark):
    df, labels, words = labelled(spark, 200)
    odd = spark.createDataFrame([(0, 0), (0, 1), (1, None), (None, 1), (77_777, 1)], "doc_id long, toxic int")
    long = spark.createDataFrame([(9001, " ".join(words * 200)), (9002, " ".join(words * 200 + ["worthless", "pathetic", "disgusting"] * 3))], "doc_id long, text string")
    rows = df.union(long).union(df.filter("doc_id = 4"))
    got = toxicity.toxicity(rows, labels.union(odd)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == rows.count() and by[9001].predicted == 0 and by[9002].predicted == 1
    assert len({r.score for r in got if r.doc_id == 4}) == 1
    texts, _ = toxicity.training_sample(rows, labels, "doc_id", "text", "toxic", F.lit(True), 50, 10_000)
    assert 0 < len(texts) <= 50 and sum(map(len, texts)) <= 10_000 and texts == toxicity.training_sample(rows, labels, "doc_id", "text", "toxic", F.lit(True), 50, 10_000)[0]


def test_toxicity_without_labels(spark):
    df, labels, _ = labelled(spark, 8)
    assert {r.predicted for r in toxicity.toxicity(df, labels.limit(0)).collect()} == {0}
    assert toxicity.toxicity(df.limit(0), labels).count() == 0


def jaccard(a, b):
    both = len(np.intersect1d(a, b))
    return both / max(1, len(a) + len(b) - both)


def cells(text):
    return dart_minhash.unit_cells(dart_minhash.shingles([text]))[0]


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    for n in (3, 40, 2000):
        words = [f"w{i}" for i in rng.integers(0, 2 * n, n + 4)]
        other = list(words)
        for i in rng.choice(len(words), max(1, len(words) // 60), replace=False):
            other[i] = "zz"
        two = dart_minhash.shingles([" ".join(words), " ".join(other)])
        a, b = dart_minhash.signatures(two, 3000)
        assert abs((a == b).mean() - jaccard(cells(" ".join(words)), cells(" ".join(other)))) < 0.04


def test_weights_beyond_one_are_regions_of_their_own():
    weighted = lambda *w: dart_minhash.Shingles(np.arange(1, 5, dtype=np.uint64).repeat(1), np.array(w), np.array([4]))
    a, b = (dart_minhash.signatures(weighted(*w), 4000)[0] for w in ((1, 2, 7, 40), (3, 2, 5, 30)))
    assert abs((a == b).mean() - (1 + 2 + 5 + 30) / (3 + 2 + 7 + 40)) < 0.03


def test_bits_of_signatures_agree_as_texts_do():
    words = [f"w{i}" for i in range(500)]
    two = dart_minhash.shingles([" ".join(words), " ".join("x" if i % 60 == 9 else w for i, w in enumerate(words))])
    bits = dart_minhash.packed(dart_minhash.signatures(two)).view(np.uint8)
    agree = 1 - np.unpackbits(bits[0] ^ bits[1]).mean()
    s = jaccard(*(dart_minhash.unit_cells(dart_minhash.shingles([t]))[0] for t in (" ".join(words), " ".join("x" if i % 60 == 9 else w for i, w in enumerate(words)))))
    assert abs(agree - (1 + s) / 2) < 0.08
    assert 0.7 * 640 < near_dedup.least_agreement(0.8) < 0.9 * 640


def test_texts_are_sketched_alike_alone_and_together():
    texts = ["", "a b", "a b c d e f g", "x " * 300, " ".join(f"w{i}" for i in range(4000)), " \n", "a b c d e f g"]
    together = dart_minhash.signatures(dart_minhash.shingles(texts))
    prints = dart_minhash.fingerprints(dart_minhash.shingles(texts))
    for t, own, own_print in zip(texts, together, prints):
        assert (dart_minhash.signatures(dart_minhash.shingles([t]))[0] == own).all() and dart_minhash.fingerprints(dart_minhash.shingles([t])) == [own_print]


def test_cells_count_repeats():
    assert len(cells("a b c")) == 1 and len(cells("A  B\nc")) == 1 and len(cells(" \n")) == 0
    assert jaccard(cells("A b C"), cells("a B c")) == 1
    assert len(cells("a " * 30)) == 26


def near_texts(seed=5):
    rng = random.Random(seed)
    texts = []
    for size, copies in ((30, 3), (200, 40), (900, 5), (60, 1), (120, 2)):
        base = [f"w{rng.randrange(3000)}" for _ in range(size)]
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 1, size // 80, size // 40])):
                own[rng.randrange(size)] = f"x{rng.randrange(99)}"
            texts.append(" ".join(own))
    return texts + [None, "", "  ", "a b", "A  b", "b a", texts[0].upper(), "solo " * 50]


def test_near_dedup_is_the_components_of_all_pairs(spark):
    texts = near_texts()
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    got = near_dedup.near_dedup(docs(spark, [texts[i] for i in order], order).withColumn("class_id", F.lit("clash"))).collect()
    sets = [cells(t or "") for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i]) and jaccard(sets[i], sets[j]) >= 0.8:
            a, b = sorted((root(i), root(j)))
            parent[b] = a
    sizes = Counter(root(i) for i in range(len(texts)))
    assert {r.doc_id: (r.class_id, r.class_size, r.kept) for r in got} == {i: (root(i), sizes[root(i)], root(i) == i) for i in range(len(texts))}


def components_of_all_pairs(texts):
    sets = [cells(t) for t in texts]
    low = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if low[i] != low[j] and jaccard(sets[i], sets[j]) >= 0.8:
            a, b = sorted((low[i], low[j]))
            low = [a if x == b else x for x in low]
    return dict(enumerate(low))


def drifting_texts(n=60, seed=11):
    """Copies of copies, each with one more word changed: the neighbours are similar, the ends are not, and the buckets are large."""
    rng = random.Random(seed)
    own, texts = [f"w{i}" for i in range(150)], []
    for i in range(n):
        own[rng.randrange(150)] = f"x{i}"
        texts.append(" ".join(own))
    return texts


def starred_texts(n=120, seed=12):
    """Copies of an origin that is not there, each too far from nearly all others; few pairs are similar."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        own = [f"w{j}" for j in range(200)]
        for j in rng.sample(range(200), 6 + i % 3):
            own[j] = f"y{i}"
        texts.append(" ".join(own))
        if i % 10 == 0:
            own[rng.randrange(200)] = "z"
            texts.append(" ".join(own))
    return texts


@pytest.mark.parametrize("texts", [drifting_texts(), starred_texts()], ids=["drifting", "starred"])
def test_links_that_every_pivot_misses_are_found(spark, monkeypatch, texts):
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs(spark, texts)).collect()}
    assert got == components_of_all_pairs(texts)


def links_of_one_bucket(spark, texts):
    """The classes of texts that all meet in one bucket."""
    own = dart_minhash.shingles(texts)
    bits = dart_minhash.packed(dart_minhash.signatures(own)).tolist()
    rows = [(i, int(n), bytearray(f), [7], b) for i, (n, f, b) in enumerate(zip(own.sizes(), dart_minhash.fingerprints(own), bits))]
    reps = spark.createDataFrame(rows, "doc_id long, n_cells long, fingerprint binary, bands array<long>, bits array<long>")
    links = near_dedup.similar_pairs(reps, docs(spark, texts), 0.8)
    classes = {} if links is None else {r.node: r.class_id for r in components(links).collect()}
    return {i: classes.get(i, i) for i in range(len(texts))}


def edited(words, **at):
    return " ".join(at.get(f"at{i}", w) for i, w in enumerate(words))


def test_settled_members_remain_partners(spark):
    origin = [f"w{i}" for i in range(100)]
    texts = [edited(origin, at10="b", at20="b", at30="c", at40="c"), edited(origin, at10="b", at20="b"), *(edited(origin, **{f"at{50 + 4 * i}": "d"}) for i in range(10)), edited(origin)]
    assert components_of_all_pairs(texts) == dict.fromkeys(range(len(texts)), 0)
    assert links_of_one_bucket(spark, texts) == components_of_all_pairs(texts)  # 0 is similar to 1 alone


def test_a_round_without_links_is_not_the_end(spark):
    texts = [" ".join([*(f"p{j}" for j in range(40)), *(f"w{i}x{j}" for j in range(60))]) for i in range(12)]
    texts[3:3] = [texts[2] + " more"]
    assert links_of_one_bucket(spark, texts) == components_of_all_pairs(texts) == {i: 2 if i == 3 else i for i in range(13)}


def test_settled_classes_are_not_gone_through_again(spark, monkeypatch):
    """Edges that are stars take no round, and a bucket joined up by one pivot no further comparison: plans stay in the driver's memory."""
    kept = []

    def counted(df):
        kept.append(df.columns)
        return written(df)

    monkeypatch.setattr(components_module, "written", counted)
    got = {r.node: r.class_id for r in components(spark.createDataFrame([(3, 1), (1, 5), (5, 1), (7, 6), (4, 4)], "a long, b long")).collect()}
    assert got == {1: 1, 3: 1, 5: 1, 6: 6, 7: 6} and len(kept) == 1
    kept.clear()
    texts = [" ".join(f"w{j}" for j in range(100 + i)) for i in range(6)]
    assert links_of_one_bucket(spark, texts) == components_of_all_pairs(texts) == dict.fromkeys(range(6), 0)
    assert len(kept) <= 4


def test_near_dedup_of_repeats_and_nothing(spark):
    rows = docs(spark, ["a b c d e f", "a b c d e f", None, "q r s t u v"], [1, 1, None, 2])
    assert {tuple(r) for r in near_dedup.near_dedup(rows).collect()} == {(1, 1, 1, True), (2, 2, 1, True)}
    assert near_dedup.near_dedup(rows.limit(0)).count() == 0


def test_near_dedup_of_long_texts_ties_and_ids_with_two_texts(spark):
    rng = random.Random(3)
    long = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    texts = [" ".join(long), " ".join(long[:-50]), "a b c d e f", "g h i j k l m n", "x " * 20_000, "X " * 20_000, "a b c d e f"]
    got = near_dedup.near_dedup(docs(spark, texts, [4, 3, 1, 1, 9, 8, 2])).collect()
    assert {tuple(r) for r in got} == {(3, 3, 2, True), (4, 3, 2, False), (1, 1, 2, True), (2, 1, 2, False), (8, 8, 2, True), (9, 8, 2, False)}


def test_bpe_of_repeated_and_null_ids(spark):
    got = byte_bpe.byte_bpe(docs(spark, ["a b", "a b", "c", None], [1, 1, 1, None]), vocabulary_path(byte_bpe.VOCABULARY), byte_bpe.default_pattern()).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in got) == [("1", b"a b"), ("1", b"a b"), ("1", b"c"), ("None", b"")]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 130)] + [(100, 100)]
    got = {r.node: r.class_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 130)}}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(10, 24))[rng.integers(0, 10, 3000)] + rng.normal(scale=0.4, size=(3000, 24))).astype(np.float32)
    v[1000:1400] = v[1000]
    df = vectors(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)])
    got = A.ann_search(df).collect()
    by, hit = {}, 0
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    exact = v.astype(np.float64)
    for q in range(0, 3000, 100):
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        near = np.lexsort((np.arange(3000), d))[:10].tolist()
        own = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 11)) and all(abs(r.score - d[r.vec_id]) < 1e-12 for r in own)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        if 1000 <= q < 1400:
            assert [r.vec_id for r in own] == near  # ties go to the smaller id
        hit += len({r.vec_id for r in own} & set(near))
    assert hit >= 0.9 * 300


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (1, [5.0, 5.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, None], 1), (6, [float("inf"), 1.0], 1), (7, [1.0], 1), (None, [1.0, 2.0], 1), (100, [1.0, 0.5], None)]
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in A.ann_search(vectors(spark, rows)).collect()}
    assert got == {(0, 1, 100, 0.5), (0, 2, 1, 1.0), (100, 1, 0, 0.5), (100, 2, 1, 0.5)}
    assert A.ann_search(vectors(spark, rows[3:5])).count() == 0


def test_chi_square_quantiles():
    assert abs(A.chi_square_quantile(0.95, 8) - 15.507) < 1e-2 and abs(A.chi_square_quantile(0.5, 2) - 2 * math.log(2)) < 1e-6


def test_language_model(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "Épsilon", "zeta"]
    texts = [" ".join(words[(i + j) % 6] for j in range(rng.choice([3, 30, 200]))) for i in range(150)] + [None, "", " \n", "never seen words here", "beta " * 3000]
    ids = [*range(len(texts) - 1), None]
    got = lm_score.lm_score(docs(spark, texts, ids).withColumn("score", F.lit("clash")), vocabulary_path(lm_score.MODEL)).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    counts = Counter()
    for i, t in zip(ids, texts):
        if not fold(i):
            counts.update([*(t or "").encode().lower().split(), 0])
    n, v = sum(counts.values()), len(counts)
    by = dict(zip(ids, texts))
    assert len(got) == len(texts)
    for r in got:
        tokens = [*(by[r.doc_id] or "").encode().lower().split(), 0]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id), len(tokens), sum(t in counts for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens), rel=1e-9)
        assert r.score < 0
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the order of words is learnt
    assert lm_score.lm_score(docs(spark, ["x"]).limit(0), vocabulary_path(lm_score.MODEL)).count() == 0


def test_the_model_learns_from_long_and_from_late_texts(spark):
    rng = np.random.default_rng(4)
    start, counts = rng.integers(3, 300, 40_000), np.zeros(500)
    texts = [start, *(np.full(50, 400) for _ in range(30)), np.array([], np.int64)]
    for ids in texts:
        counts += np.bincount(np.append(ids, attention_lm.END), minlength=500)
    rows = spark.createDataFrame([(7 * i, bytearray(ids.astype("<u2").tobytes())) for i, ids in enumerate(texts)], "key long, ids binary").repartition(3)
    near = attention_lm.neighbours(texts, attention_lm.columns(counts))
    assert (lm_score.neighbour_counts(rows, counts) == near).all()
    of = attention_lm.classes(near, counts)
    first = attention_lm.scorer(attention_lm.initial(counts, of), of, counts)
    model = lm_score.trained(rows, counts)
    values = slice(2 * attention_lm.DIM, 3 * attention_lm.DIM)
    moved = np.abs(model.table[:, values] - first.table[:, values]).sum(axis=1) / np.abs(first.table[:, values]).sum(axis=1)
    seen = np.unique(np.concatenate(texts))
    assert (model.class_of == of).all() and (moved[seen] > 0.01).all()
    assert (model.score([texts[1], start[:400]]) > first.score([texts[1], start[:400]])).all()


def test_the_model_depends_on_the_texts_alone(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "PART_IDS", 700)
    rng = np.random.default_rng(6)
    texts = [rng.integers(3, 200, n) for n in rng.integers(0, 90, 60)] * 2
    counts = np.bincount(np.concatenate(texts), minlength=300).astype(float)
    counts[attention_lm.END] = len(texts)
    rows = [(int(k), bytearray(ids.astype("<u2").tobytes())) for k, ids in zip(rng.integers(-(10**15), 10**15, len(texts)), texts)]
    for least in (400, 1):  # all parts in each round, and a part of them
        monkeypatch.setattr(lm_score, "LEAST_STEPS", least)
        one, other = (lm_score.trained(spark.createDataFrame(r, "key long, ids binary").repartition(n), counts) for n, r in ((3, rows), (11, rows[::-1])))
        assert (one.score(texts) == other.score(texts)).all() and (one.table == other.table).all()


def test_sums_pass_64_bits(spark):
    rows = spark.createDataFrame([(0, [2**62, -5] + [0] * 14)] * 6 + [(1, [7] * 16)], "at long, n array<long>")
    assert lm_score._summed(rows, 20).tolist() == [6.0 * 2**62, -30.0] + [0.0] * 14 + [7.0] * 4


def test_language_model_trains_on_texts_of_any_length(spark, monkeypatch):
    lengths = []

    def kept(texts, counts, of=lm_score.trained):
        lengths.extend(len(r.ids) // 2 for r in texts.collect())
        return of(texts, counts)

    monkeypatch.setattr(lm_score, "trained", kept)
    df = docs(spark, ["alpha beta " * 5000, "beta gamma", None], [2, 3, 4])
    fold = [i for i in (2, 3, 4) if zlib.crc32(str(i).encode()) % 5 != 1]
    lm_score.lm_score(df, vocabulary_path(lm_score.MODEL)).collect()
    assert len(lengths) == len(fold) and (2 not in fold or max(lengths) >= 10_000)


def test_language_model_of_repeated_rows(spark):
    texts = ["alpha beta gamma"] * 3 + ["delta " * 9000]
    got = lm_score.lm_score(docs(spark, texts, [2, 2, 3, 4]), vocabulary_path(lm_score.MODEL)).collect()
    learnt = [t for i, t in zip([2, 2, 3, 4], texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    assert len(got) == 4 and {r.train_tokens for r in got} == {sum(len(t.split()) + 1 for t in learnt)}
    assert len({(r.score, r.base_score) for r in got if r.n_tokens == 4}) == 1


def test_texts_are_cut_into_ids_once(spark, monkeypatch):
    coded = []

    def kept(df):
        table, path = written(df)
        if "ids" in table.columns:
            coded.append(table.count())
        return table, path

    monkeypatch.setattr(lm_score, "written", kept)
    got = lm_score.lm_score(docs(spark, [f"alpha beta w{i}" for i in range(20)]), vocabulary_path(lm_score.MODEL)).collect()
    assert len({r.held_out for r in got}) == 2 and coded == [20]  # for training and for scores, held-out texts too


def test_words_keep_their_ids_when_the_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(lm_score, "CACHED_WORDS", 3)
    words = lm_score.Words(vocabulary_path(lm_score.MODEL), {b"the": 1.5})
    for text in ["the a b the", "", "c the d", "Épsilon e the f", "g the a"]:
        found = lm_score.words_of(text)
        slots = words.slots(found)
        assert [words.words[i] for i in slots] == found and (np.isnan(words.log[slots]) == [w != b"the" for w in found]).all()
        assert words.ids_of(slots).tolist() == [i for w in found for i in words.encode([w.decode()])[0]]


def test_words_of_many_texts_are_cut_together():
    words, calls = lm_score.Words(vocabulary_path(lm_score.MODEL), {b"the": 1.5, b"a": 0.5}), []
    words.encode = lambda new, of=words.encode: calls.append(new) or of(new)
    texts = ["", " ", "\n The  b\t", "\u00c9psilon \u00c0B\u3000c the", "a\x1fb\x85c a", "zz zz \x0b\x0c ZZ the q"] + [f"w{i} a w{i + 1}" for i in range(300)]
    total, known, log, others, ids = (x.to_pylist() for x in lm_score.looked_up(words, pa.array(texts)))
    assert len(calls) == 1 and len(calls[0]) == len({w for t in texts for w in lm_score.words_of(t)})
    for i, text in enumerate(texts):
        found = lm_score.words_of(text)
        rare = Counter(w for w in found if w not in words.frequent)
        assert (total[i], known[i], log[i]) == (len(found), len(found) - rare.total(), pytest.approx(sum(words.frequent.get(w, 0) for w in found)))
        assert {r["word"]: r["times"] for r in others[i]} == rare and len(others[i]) == len(rare)
        assert np.frombuffer(ids[i], "<u2").tolist() == [x for w in found for x in words.encode([w.decode()])[0]]
    assert [len(x) for x in lm_score.looked_up(words, pa.array([], pa.string()))] == [0] * 5


def test_frequent_words_are_not_cut_again(monkeypatch):
    monkeypatch.setattr(lm_score, "CACHED_WORDS", 3)
    words, cut = lm_score.Words(vocabulary_path(lm_score.MODEL), {b"the": 1.5, b"of": 1.0}), Counter()
    words.encode = lambda new, of=words.encode: cut.update(new) or of(new)
    for i in range(20):
        words.slots([b"the", b"w%d" % i, b"of", b"v"])
    assert cut["the"] == cut["of"] == 1 < cut["v"]


def test_words_are_counted_as_they_are_split(spark, monkeypatch):
    texts = ["", " ", "\n The  b\t", "\u00c9psilon \u00c0B\u3000c the", "a\x1fb\x85c a", "zz zz \x0b\x0c ZZ the"] * 3
    want = Counter(w for t in texts for w in lm_score.words_of(t))
    for most in (lm_score.COUNTED, 1):
        monkeypatch.setattr(lm_score, "COUNTED", most)
        got = lm_score.word_counts(docs(spark, texts)).collect()
        assert {bytes(r.word): r.n for r in got} == want and len(got) == len(want)


def test_frequent_words_are_all_from_some_count_on(spark):
    counts = spark.createDataFrame([(bytearray(f"w{i}".encode()), i + 1) for i in range(300)], "word binary, n long")
    for most in (0, 1, 50, 299, 1000):
        found = lm_score.frequent_words(counts, most)
        assert len(found) <= most and (not found or len(found) == sum(math.log10(i + 1.5) >= min(found.values()) for i in range(300)))
    assert len(lm_score.frequent_words(counts, 1000)) == 300


def test_windows_score_each_token_once():
    texts = [np.arange(10, 10 + n) for n in (0, 1, 15, 16, 17, 100)]
    tokens, targets, first = attention_lm.windows(texts)
    assert targets[targets >= 0].tolist() == [x for ids in texts for x in [*ids, attention_lm.END]]
    assert tokens.shape == targets.shape == (len(first), attention_lm.STEP) and first.sum() == len(texts)


def sampled_model(passes=1):
    rng = np.random.default_rng(0)
    samples = [rng.integers(3, 1400, n) for n in (50, 0, 3000, 17, 900)]
    counts = np.bincount(np.concatenate(samples), minlength=1500).astype(float)
    counts[attention_lm.END] = len(samples)
    return samples, counts, attention_lm.fit(samples, counts, passes)


def test_class_shares_sum_to_one():
    _, _, model = sampled_model()
    assert np.allclose(np.bincount(model.class_of, weights=10**model.log_share)[np.unique(model.class_of)], 1)


def test_the_most_frequent_ids_are_classes_of_their_own():
    samples, counts, model = sampled_model()
    top = [i for i in np.argsort(-counts, kind="stable") if i != attention_lm.END][: attention_lm.SINGLES - 1]
    assert set(np.bincount(model.class_of)[model.class_of[[attention_lm.END, *top]]]) == {1}
    assert model.class_of.max() < attention_lm.N_CLASSES == 1024


def slow_log10(model, ids):
    """The model's log10 probability, token by token."""
    m, seq, total = attention_lm, [attention_lm.BEGIN, *ids, attention_lm.END], 0.0
    for i in range(len(seq) - 1):
        start = i // m.STEP * m.STEP
        q, keys = model.table[seq[i]][: m.DIM].astype(float), []
        for j in range(max(start - m.STEP, 0), i + 1):
            row = model.table[seq[j]].astype(float)
            bias = model.own[i - start, j - start] if j >= start else model.before[i - start, j - start + m.STEP]
            keys.append((math.exp(q @ row[m.DIM : 2 * m.DIM] + bias), row[2 * m.DIM : 3 * m.DIM]))
        c = sum(a * v for a, v in keys) / sum(a for a, _ in keys)
        h = np.append(np.maximum(c @ model.context + model.table[seq[i]][3 * m.DIM + 1 :], 0), 1)
        g, at = divmod(int(model.class_of[seq[i + 1]]), m.FAN)
        for z, x in ((h @ model.group, g), (h @ model.place[g], at)):
            total += (z[x] - math.log(np.exp(z).sum())) / math.log(10)
        total += model.log_share[seq[i + 1]]
    return total


def test_scores_together_are_those_of_each_token_alone(monkeypatch):
    samples, _, model = sampled_model(3)
    slow = [slow_log10(model, ids.tolist()) for ids in samples]
    for together in (1, 3, 512):
        monkeypatch.setattr(attention_lm, "TOGETHER", together)
        assert np.allclose(model.score(samples), slow, rtol=1e-4)


def test_gradients_are_the_slopes():
    rng = np.random.default_rng(1)
    m = attention_lm
    tokens, targets, first = m.windows([rng.integers(3, 60, 40), rng.integers(3, 60, 5)])
    class_of = rng.integers(0, m.N_CLASSES, 60)
    w = {n: x.astype(float) + rng.normal(0, 0.2, x.shape) for n, x in m.initial(np.ones(60), class_of).items()}

    def loss():
        total, n = 0.0, 0
        e = w["e"][tokens]
        for b in range(len(tokens)):
            for i in range(m.STEP):
                if targets[b, i] < 0:
                    continue
                keys = [(e[b - 1, j], m.STEP + i - j) for j in range(m.STEP)] * (not first[b]) + [(e[b, j], i - j) for j in range(i + 1)]
                s = np.array([(e[b, i] @ w["q"]) @ (x @ w["k"]) / np.sqrt(m.DIM) + w["d"][far] for x, far in keys])
                a = np.exp(s - s.max())
                c = (a / a.sum()) @ np.array([x @ w["v"] for x, _ in keys])
                h = np.append(np.maximum(c @ w["c"] + e[b, i] @ w["s"] + w["b"], 0), 1)
                g, x = divmod(int(class_of[targets[b, i]]), m.FAN)
                for z, y in ((h @ w["group"], g), (h @ w["place"][g], x)):
                    total -= z[y] - np.log(np.exp(z).sum())
                n += 1
        return total / n

    g, ids, rows = m.gradients(w, tokens, targets, first, class_of)
    dense = np.zeros_like(w["e"])
    dense[ids] = rows
    g["e"] = dense
    used = int(class_of[targets[0, 4]])
    for name in w:
        for _ in range(3):
            place = tuple(rng.integers(0, s) for s in w[name].shape)
            place = (int(tokens[1, rng.integers(16)]), place[1]) if name == "e" else (used // m.FAN, *place[1:]) if name == "place" else place
            before = w[name][place]
            w[name][place] = before + 1e-5
            up = loss()
            w[name][place] = before - 1e-5
            down = loss()
            w[name][place] = before
            assert g[name][place] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7), name


def test_slopes_and_scores_do_not_depend_on_windows_together(monkeypatch):
    rng, m = np.random.default_rng(8), attention_lm
    batches = [m.windows([rng.integers(3, 60, n) for n in sizes]) for sizes in ((90, 5, 0, 33, 16), (7,))]
    class_of = rng.integers(0, m.N_CLASSES, 60)
    w = {n: x.astype(float) + rng.normal(0, 0.2, x.shape) for n, x in m.initial(np.ones(60), class_of).items()}
    want, room = [m.gradients(w, *b, class_of) for b in batches], m.Room()
    for together in (1, 3, 256):
        monkeypatch.setattr(m, "TOGETHER", together)
        for b, (g, ids, rows) in zip(batches, want):  # a smaller batch after a larger one, in the same arrays
            got, same, moved = m.gradients(w, *b, class_of, room)
            assert (same == ids).all() and np.allclose(moved, rows, rtol=1e-9, atol=1e-15)
            assert all(np.allclose(got[n], g[n], rtol=1e-9, atol=1e-15) for n in g)


def test_training_uses_its_arrays_again():
    import tracemalloc

    rng, counts = np.random.default_rng(9), np.ones(500)
    tokens, targets, first = attention_lm.windows([rng.integers(3, 500, 16 * attention_lm.BATCH - 1)])
    class_of = rng.integers(0, attention_lm.N_CLASSES, 500)
    trainer = attention_lm.Trainer(attention_lm.initial(counts, class_of), class_of)
    trainer.go(tokens, targets, first, rng, lambda done: 1)
    tracemalloc.start()
    trainer.go(tokens, targets, first, rng, lambda done: 1)
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 4e6  # 4,096 positions of 64 numbers are a megabyte


def test_pipeline_stages_of_awkward_rows(spark, sf_dir):
    import corpus_pipeline as C

    line = "this very line is held by several documents"
    rows = [(1, None, "en", "a", 0), (2, "", "en", None, 0), (3, f"one\n{line}", "en", "a", 9), (4, f"two\n{line}", "en", "a", 9), (5, f"three\n{line}", None, "b", None), (6, "w " * 30_000, "en", "b", 7),
            (7, "same words here and there", "en", "a", 5), (8, "Same words here  and there", "en", "a", 5), (None, "no id", "en", "a", 2), (9, "twice", "en", "c", 1), (9, "twice", "en", "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"kept": F.lit(1), "copies": F.lit(2), "predicted": F.lit(3)})
    for case in (df, df.drop("n_chars", "lang"), df.limit(0)):
        kept = C.drop_toxic(spark, case, sf_dir)
        lined = C.drop_common_lines(spark, kept, sf_dir)
        single = C.keep_one_of_near_copies(spark, lined, sf_dir)
        mixed = C.mix_to_targets(spark, single, sf_dir)
        coded = C.encode(spark, mixed, sf_dir)
        assert kept.columns == lined.columns == single.columns == mixed.columns == case.columns
        n = case.count()
        assert kept.count() == n and lined.filter(F.col("text").contains(line)).count() == min(n, 1)
        left = [r.doc_id for r in single.select("doc_id").collect()]
        assert len(left) == max(n - 1, 0) and not (n and 8 in left) and (not n or None in left)
        assert coded.filter("NOT restored").count() == 0 and coded.count() == mixed.count()


def test_pipeline_by_its_parts(spark, sf_dir):
    import corpus_pipeline as C

    docs_in = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = C.drop_toxic(spark, docs_in, sf_dir)
    assert kept.columns == docs_in.columns and 0.7 * docs_in.count() < kept.count() < docs_in.count()
    lined = C.drop_common_lines(spark, kept, sf_dir)
    assert lined.columns == docs_in.columns and lined.count() == kept.count() and lined.filter("n_chars <> length(text)").count() == 0
    single = C.keep_one_of_near_copies(spark, lined, sf_dir)
    classes = {r.doc_id: r.class_id for r in near_dedup.near_dedup(lined).collect()}
    assert {r.doc_id for r in single.select("doc_id").collect()} == {i for i, c in classes.items() if i == c}
    mixed = C.mix_to_targets(spark, single, sf_dir)
    assert mixed.columns == docs_in.columns and max(mixed.groupBy("doc_id").count().select(F.max("count")).first()) <= 3
    coded = C.encode(spark, mixed, sf_dir)
    assert coded.filter("NOT restored").count() == 0 and coded.count() == mixed.count()
    assert C.run(spark, sf_dir).count() == coded.count()
