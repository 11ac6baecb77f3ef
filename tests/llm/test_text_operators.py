"""Exact dedup, line dedup, source mixing, secret scan: against brute force on small tables with every awkward row."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmeter.llm import exact_dedup as E
from quillmeter.llm import line_dedup as L
from quillmeter.llm import secret_scan as S
from quillmeter.llm import source_mix as M

SCHEMA = "doc_id long, text string, source string"
WS = "[\x20\x09-\x0d]"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s) for i, t, s in rows], SCHEMA)


def awkward(seed=0, n=120):
    rng = random.Random(seed)
    words = ["the", "Of", "ands", "mist", "éa", "日本", "😀", "s t", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 40, 700, 3000]))) for _ in range(n // 3)]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", "", None])) for i in range(n)]
    rows += [(n, None, None), (n + 1, "", "a"), (n + 2, " \t\n", "a"), (n + 3, "a\tb", "b"), (n + 4, "a  b", "b"), (n + 5, "y" * 60_000, "b"), (n + 6, "y" * 60_000 + "z", "b")]
    return rows


def test_exact_dedup_is_equality_of_normal_forms(spark):
    rows = awkward()
    norm = {i: re.sub(WS + "+", " ", t or "") for i, t, _ in rows}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = E.exact_dedup(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        own = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(own), len(own), r.doc_id == min(own), hashlib.sha256(norm[r.doc_id].encode()).hexdigest())


def test_chunks_are_the_text_and_resynchronise(spark):
    rng = random.Random(3)
    base = " ".join(rng.choice(["mist", "and", "on", "be", "as", "it"]) for _ in range(8000))
    df = spark.createDataFrame([(base,), ("xx " + base,), ("日" * 5000,)], "t string").select("t", E.chunks(F.col("t")).alias("c"))
    rows = df.collect()
    assert all("".join(r.c) == r.t and all(len(c) <= E.MAX_CHUNK for c in r.c) for r in rows)
    assert len(set(rows[0].c) & set(rows[1].c)) > 0.8 * len(rows[0].c)


def test_chunks_resynchronise_in_every_script(spark):
    rng = random.Random(5)
    of = lambda symbols, n: "".join(rng.choice(symbols) for _ in range(n))
    cjk, kana = "".join(map(chr, range(0x4E00, 0x9000, 7))), "".join(map(chr, range(0x3041, 0x3090)))
    cyrillic = " ".join(of("абвгдежзиклмнопрст", 6) for _ in range(4000))
    texts = [of(cjk, 20_000), of(kana, 20_000), cyrillic, of("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 20_000), of("abcdefghijklmnopqrstuvwxyz", 20_000)]
    df = spark.createDataFrame([(t, "??" + t) for t in texts], "a string, b string").select(E.chunks(F.col("a")).alias("a"), E.chunks(F.col("b")).alias("b"))
    for r in df.collect():
        assert len(set(r.a) & set(r.b)) > 0.8 * len(r.a)


def test_exact_dedup_of_repeated_and_null_ids(spark):
    rows = docs(spark, [(1, "a", None), (1, "a", None), (1, "b", None), (None, "b", None), (None, None, None)]).withColumns({"keep_id": F.lit(7), "recipe": F.lit("x"), "chunk": F.lit(0)})
    got = Counter(((r.doc_id, r.text_sha256[:4]), (r.keep_id, r.group_size, r.kept)) for r in E.exact_dedup(rows).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:4]
    assert got == {((1, sha("a")), (1, 2, True)): 2, ((1, sha("b")), (1, 2, True)): 1, ((None, sha("b")), (1, 2, False)): 1, ((None, sha("")), (None, 1, True)): 1}
    assert E.exact_dedup(rows.limit(0)).count() == 0


def test_two_contents_under_one_identifier_stop_the_job(spark):
    df = spark.createDataFrame([("a", "b", b"1")], "low string, high string, id binary")
    with pytest.raises(Exception, match="one identifier"):
        df.select(E.verified(F.col("low"), F.col("high"), F.col("id"))).collect()


def brute_lines(rows):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t, _ in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if len(key(x)) < 20 or len(holders[key(x)]) < 3 or i == max(holders[key(x)])]
        out[i] = (len(parts), len(parts) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    pool = ["Licensed under the common licence", "  LICENSED under the common licence\t", "short", "", "ÉCOLE publique de la ville entière", "école publique de la ville entière", *(f"line number {i} of the file" for i in range(12))]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 9]))), None) for i in range(40)] + [(90, None, None), (91, "", None), (92, "\n\n", None), (93, "Licensed under the common licence\r", None)]
    got = L.line_dedup(docs(spark, rows)).collect()
    expect = brute_lines(rows)
    assert len(got) == len(rows) and all((r.n_lines, r.n_dropped, r.text) == expect[r.doc_id] for r in got)


def test_line_dedup_keeps_columns_and_repeats(spark):
    line = "a line that is long enough to count"
    df = docs(spark, [(1, line, "x"), (1, line, "y"), (2, line, None), (None, line, None), (None, None, None)]).withColumns({"row": F.lit(1), "dropped": F.lit(2), "n_lines": F.lit("clash")})
    got = L.line_dedup(df).collect()
    assert sorted((str(r.doc_id), r.text, r.n_dropped, r.row, r.dropped) for r in got) == sorted([("1", "", 1, 1, 2), ("1", "", 1, 1, 2), ("2", line, 0, 1, 2), ("None", "", 1, 1, 2), ("None", "", 0, 1, 2)])
    assert L.line_dedup(df.limit(0)).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in capped]
        level = (total - sum(capped.values())) / max(1, sum(weight[s] for s in left))
        over = [s for s in left if weight[s] * level > 2 * sizes[s]]
        if not over:
            return capped | {s: weight[s] * level for s in left}
        capped |= {s: 2 * sizes[s] for s in over}


def test_source_mix(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 3, 50, 400, 2000]))), rng.choice(["a", "a", "a", "b", "c", "", None, "Z"])) for i in range(300)]
    rows += [(400, None, "only null"), (401, "x " * 30_000, "a")]
    df = docs(spark, rows).withColumns({"size": F.lit("clash"), "key": F.lit(0), "target": F.lit(0)})
    got = M.mix_sources(df, block_words=16).collect()
    sizes, taken = Counter(), Counter()
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    targets = brute_targets(sizes)
    again = M.mix_sources(df, block_words=16).collect()
    assert len(got) == len(rows) and sorted(map(str, got)) == sorted(map(str, again))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source], rel=1e-9) and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 0.03 * targets[s] + 200 for s in sizes)


def test_quotas_are_the_highest_quotients(spark):
    rng = random.Random(2)
    parts = [(f"s{k}", f"s{k}", shard, rng.randrange(1, 5000)) for k in range(30) for shard in range(6)]
    df = spark.createDataFrame(parts, "src string, source string, shard long, words long")
    targets = M.source_targets(df)
    rows = M.block_quotas(df.select("src", "shard", "words"), targets, 64).collect()
    by = {r.src: r for r in targets.collect()}
    for shard in range(6):
        own = [r for r in rows if r.shard == shard]
        votes = {r.src: int(r.target * r.words / r.source_size) for r in own}
        seats = sorted(((-v / (2 * k + 1), by[s].src_rank, s) for s, v in votes.items() for k in range(v // 32 + 3)))[: (sum(votes.values()) + 32) // 64]
        assert {r.src: r.quota for r in own} == {s: n for s in votes for n in [sum(x[2] == s for x in seats)]}


def test_mix_of_whole_documents_keeps_the_targets(spark):
    rng = random.Random(10)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 3, 50, 400, 2000]))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(400, "x " * 30_000, "a"), (401, "x " * 20_000, "c"), (402, None, "b")]
    df = docs(spark, rows).withColumns({"copies": F.lit("clash"), "group": F.lit(1), "share": F.lit(2)})
    got = M.mix_documents(df).collect()
    taken = {r.source: r.taken for r in M.mix_sources(df).groupBy("source").agg(F.sum("taken").alias("taken")).collect()}
    words, longest = Counter(), Counter()
    for r in got:
        n = len((r.text or "").split())
        assert 0 <= r.copies <= 2 and (n > 0 or r.copies == 1) and (r.group, r.share) == (1, 2)
        words[r.source] += n * r.copies
        longest[r.source] = max(longest[r.source], n)
    assert len(got) == len(rows) and all(abs(words[s] - taken[s]) <= longest[s] + 10 for s in taken)
    assert sorted(map(str, got)) == sorted(map(str, M.mix_documents(df).collect()))
    assert M.mix_documents(df.limit(0)).count() == 0


def test_shards_grow_with_the_corpus():
    assert [M.shard_count(n) for n in (0, 1 << 30, (1 << 30) + 1, 10**13)] == [256, 256, 512, 1 << 22]


def test_running_sums_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(10**6)}", rng.randrange(100)) for _ in range(500)]
    got, _ = M.running(spark.createDataFrame(rows, "k string, n long").repartition(7), [F.col("k"), F.col("n")], before="n")
    total = 0
    for r in sorted(got.collect(), key=lambda r: (r.k, r.n)):
        assert r.before == total
        total += r.n


def test_mix_of_nothing(spark):
    assert M.mix_sources(docs(spark, []).limit(0)).count() == 0
    got = M.mix_sources(docs(spark, [(None, None, None), (1, "", "a"), (1, "", "a")])).collect()
    assert [(r["size"], r.taken, r.target) for r in got] == [(0, 0, 0.0)] * 3


ASSIGN = re.compile(S.PATTERNS["assign"])


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24])


def test_secret_scan(spark):
    rng = random.Random(4)
    random_hex = "".join(rng.choice("0123456789abcdef") for _ in range(40))
    b64 = "".join(rng.choice(S.ENCODINGS[5][2]) for _ in range(64))
    texts = [
        "", None, f'é😀 token = "{random_hex}" and {b64} end', "PassWord:abc12 apikey=abcdef token:token = longvalue123", "AKIA" + "B" * 16 + " AKIAAKIA AKIA" + "0" * 15,
        "f" * 24 + "g" + "0" * 23, "x\n" + random_hex + "\n" + random_hex, "andtheand1theandthe1theandandthe1the", "a1" * 40, "sſecret=abcdefgh Key", "y " * 40_000 + "secret: abcdefg",
    ]
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(2, texts[2], None)]
    got = S.secret_scan(docs(spark, rows).withColumns({"version": F.lit(1), "spans": F.lit(2), "kind": F.lit(3)})).collect()
    assert len(got) == len(rows)
    for r in got:
        t = texts[r.doc_id] or ""
        base = brute_spans(t)
        assert [tuple(s) for s in r.base_spans] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in base) for k in range(3))
        extra = {t[s.start : s.end] for s in r.spans if s.kind == 3}
        assert [tuple(s) for s in r.spans if s.kind < 3] == base
        if r.doc_id == 2:
            assert extra == {random_hex, b64}
        if r.doc_id in (7, 8):
            assert not extra
    assert S.secret_scan(docs(spark, []).limit(0)).count() == 0


WORDS = """the of and a to in is you that it he was for on are as with his they I at be this have from or one had by word but not what all were we when your can said
there use an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more write go see number
no way could people my than first water been call who oil its now find long down day did get come made may part service handler report final release customer account
index backup cluster region module config session archive payment invoice gateway""".split()


def mixed_strings(seed, n):
    """(string, prose in front, what it is): random keys of 20 to 64 symbols, and identifiers, paths, builds and words of like lengths, and hex of words."""
    rng, out = random.Random(seed), []
    word = lambda: rng.choice(WORDS)
    for _ in range(n):
        length = rng.choice([20, 24, 28, 32, 40, 64])
        kinds = [
            "_".join(word() for _ in range(4)) + f"_v{rng.randrange(9)}_{rng.randrange(1990, 2030)}", "/".join(word() for _ in range(5)) + f"/{word()}{rng.randrange(99)}",
            f"build-2023{rng.randrange(10, 13)}{rng.randrange(10, 29)}-" + "-".join(word() for _ in range(3)), "".join(word().capitalize() for _ in range(5)) + str(rng.randrange(10)),
            "".join(word() for _ in range(6)).lower() + str(rng.randrange(100))
        ]
        alphabet = S.ENCODINGS[rng.choice([0, 4, 5])][2]
        key = "".join(rng.choice(alphabet) for _ in range(length))
        hex_words = "".join(rng.choice(["dead", "beef", "cafe", "babe", "0123", "f00d", "abcd"]) for _ in range(8))
        for text, what in ((key, "key"), (rng.choice(kinds), "text"), (hex_words, "hex words")):
            out.append((text, " ".join(word() for _ in range(300)), what))
    return out


def test_false_secrets_are_controlled(spark):
    df = spark.createDataFrame(mixed_strings(6, 600), "match string, before string, what string")
    tested = S.tested(df).persist()
    there = Counter((r.what, r.n >= 32) for r in tested.filter("NOT decoy").collect())
    got = Counter((r.what, r.n >= 32) for r in S.still_random(tested).collect())
    print("reported", got, "of", there)
    false = sum(n for (what, _), n in got.items() if what == "text")
    assert got["key", True] >= 0.8 * there["key", True] and false <= 0.1 * sum(got.values())
    assert got["hex words", True] <= 0.1 * there["hex words", True]


def test_keys_in_runs_that_mix_signs_are_candidates(spark):
    rng = random.Random(21)
    key, b64, url = ("".join(rng.choice(S.ENCODINGS[k][2]) for _ in range(40)) for k in (4, 4, 4))
    b64, url = f"{b64[:20]}+{b64[20:]}", f"{url[:20]}_{url[20:]}"
    texts = [f"é see my-app/v2/{key} end", f"a_b-{b64}", f"bucket_name/{url}/x", f"my_app/{key}", f"x-{key}/+y", "a_b/c-d/e_f/g-h/i_j/k-1"]
    wanted = [{key}, {b64}, {url}, {key}, {key}, set()]
    got = S.secret_scan(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()
    for r in got:
        spans = [texts[r.doc_id][s.start : s.end] for s in r.spans if s.kind == 3]
        assert len(spans) == len({(s.start, s.end) for s in r.spans if s.kind == 3})
        assert all(any(w in s for s in spans) for w in wanted[r.doc_id])
        assert r.doc_id not in (0, 1, 2, 3) or wanted[r.doc_id] & set(spans)
    assert not [s for r in got if r.doc_id == 5 for s in r.spans]


def test_span_texts(spark):
    df = spark.createDataFrame([([(3, 0, 9), (3, 2, 30)],), ([],)], "s array<struct<start:long,kind:int,end:long>>")
    assert [r[0] for r in df.select(S.span_text("s")).collect()] == ["assign:3:9,hex:3:30", ""]
