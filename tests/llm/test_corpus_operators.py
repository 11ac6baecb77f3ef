"""Collocations, WARC archives and lexical search against brute force."""

import io
import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from quillmeter.llm import collocations as C
from quillmeter.llm import lexical_search as S
from quillmeter.llm import warc as W

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sentences(seed, n, words=("the", "big", "Red", "dog", "ÉTÉ", "été", "日本", "x", "\x00", " ", "of")):
    rng = random.Random(seed)
    gaps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " - "]
    return ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(80))) for _ in range(n)]


def brute_collocations(rows, least=10, top=2000, contained=50):
    f, size = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            w = re.findall("[^ \t]+", piece)
            size[lang] += len(w)
            for g in (1, 2, 3):
                f[lang].update(tuple(w[i : i + g]) for i in range(len(w) - g + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in kept.items():
            if any(len(q) > len(p) and 100 * b >= contained * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in kept.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, left, right, size[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("extended,shard", [(C.EXTENDED, C.SHARD), (7, 300)])
def test_collocations_are_those_of_brute_force(spark, monkeypatch, extended, shard):
    """Small shards cut every text into blocks, of which each carries two words on."""
    counts = C.shard_counts
    monkeypatch.setattr(C, "shard_counts", lambda *a: counts(*a, shard_bytes=shard, extended=extended))
    rows = [(random.Random(i).choice(["en", "de", None]), t) for i, t in enumerate(sentences(1, 200))]
    rows += [("en", None), ("en", ""), (None, " \t . "), ("fr", "la vie en rose " * 2000), ("fr", "un mot"), ("es", "a" * 5000)] + [("de", "Guten Tag, Welt. guten tag")] * 40
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit("clash"), "f": F.lit(1), "n": F.lit(2)}).repartition(5)
    got = sorted(tuple(r) for r in C.collocations(df, top=50).collect())
    assert got == brute_collocations(rows, top=50) and {r[0] for r in got} == {"en", "de", "und", "fr"}
    assert C.collocations(df.limit(0)).count() == 0


def test_blocks_of_a_text_count_each_phrase_once():
    text = " ".join(random.Random(2).choice("abc") + random.Random(i).choice([".", "", ""]) for i in range(3000))
    every = C.Filter(np.full(16, 255, np.uint8))
    for most in (1, 7, 64):
        words, longer, hashes = Counter(), Counter(), Counter()
        for tokens, carried in C.token_blocks([text, "q r s"], most):
            shard = C.Shard(tokens, carried, b"en", every)
            names, counts = C.word_counts(tokens, carried)
            words.update(dict(zip(names, counts.tolist())))
            for phrases, counts in shard.longer(every):
                longer.update(dict(zip([p.encode() for p in phrases.to_pylist()], counts.tolist())))
            for pairs, counts in shard.pairs():
                hashes.update(dict(zip(pairs.tolist(), counts.tolist())))
        want = Counter(b" ".join(w[i : i + g]) for g in (1, 2, 3) for piece in [*text.encode().split(b"."), b"q r s"] if (w := piece.split()) for i in range(len(w) - g + 1))
        assert +words == Counter({p: n for p, n in want.items() if b" " not in p}) and +longer == Counter({p: n for p, n in want.items() if b" " in p})
        hash_of = lambda p: C.pair_hashes(*C.word_hashes(b"en", p.split(b" ")).reshape(2, 1))[0]
        assert hashes == Counter({int(hash_of(p)): n for p, n in want.items() if p.count(b" ") == 1})


def test_scores_beyond_64_bits(spark):
    a = 3_000_000_000_000
    words = spark.createDataFrame([("en", "x", 4 * a), ("en", "y", a)], "lang string, phrase string, f long")
    pairs = spark.createDataFrame([("en", "x y", a - 1)], words.schema)
    size = spark.createDataFrame([("en", 9 * a)], "lang string, n long")
    (row,) = C.ranked(words, pairs, pairs.limit(0), size, 10, 50).collect()
    assert row.score == 1_000_000 * (a - 1) ** 2 // (4 * a * a)


def test_the_filters_hold_what_is_frequent(spark):
    """Spark and the tasks hash alike: what is in the table is in the filter, and little else."""
    words = [f"w{i}é" for i in range(300)]
    table = spark.createDataFrame([("en", w) for w in words[:200]], "lang string, phrase string")
    hashes = C.word_hashes(b"en", [w.encode() for w in words])
    assert C.frequent_filter(table.select(C.word_hash().alias("hash"))).has(hashes).tolist() == [True] * 200 + [False] * 100
    joined = C.pair_hashes(hashes[:-1], hashes[1:])
    found = C.frequent_filter(spark.createDataFrame([(h,) for h in joined.view(np.int64).tolist()], "hash long"))
    assert found.has(joined).all() and not found.has(C.pair_hashes(hashes[1:], hashes[:-1])).any()


def test_a_full_filter_only_costs_rows(spark, monkeypatch):
    """A filter that lets all pass: the counts drop what is not frequent."""
    rows = [("en", t) for t in sentences(3, 60)]
    whole = C.frequent_filter
    monkeypatch.setattr(C, "frequent_filter", lambda df: C.Filter(whole(df, 15).bits | 0xFF))
    assert sorted(tuple(r) for r in C.collocations(spark.createDataFrame(rows, "lang string, text string")).collect()) == brute_collocations(rows)


def brute_search(docs, items, nearest=10):
    held = [(d, Counter(TERM.findall(lower(t or "")))) for d, t in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for d, c, n in held:
            m = 25 + 75 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in TERM.findall(lower(text or "")) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scored)[:nearest], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("entries,piece,most_items", [(S.ENTRIES, S.PIECE, S.BLOCK_ITEMS), (5, 16, 3)])
def test_search_ranks_as_brute_force_does(spark, monkeypatch, entries, piece, most_items):
    """Small limits part texts, entries and queries into many blocks."""
    whole, split = S.accumulated, S.terms
    monkeypatch.setattr(S, "accumulated", lambda *a: whole(*a, entries))
    monkeypatch.setattr(S, "terms", lambda t: split(t, piece))
    blocks = S.query_blocks
    monkeypatch.setattr(S, "query_blocks", lambda items: blocks(items, most_items))
    texts = sentences(5, 120) + [None, "", "...", "the " * 5000, "Zebra zebra ZEBRA", "naïve日本x"] + ["copied words of one text"] * 30
    docs = list(enumerate(texts)) + [(None, "copied words of one text"), (3, "zebra of ids that repeat")]
    items = [(1, "The dog of zebra"), (2, None), (3, "copied words"), (3, "copied words"), (4, "big big red"), (5, "no such thing"), (None, "été 日本"), (6, ". ,"), (7, "the " * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("clash"), "item_id": F.lit(0), "score": F.lit(1)}).repartition(4)
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in S.lexical_search(df, queries).collect()), key=str)
    assert got == brute_search(docs, items)
    if most_items == S.BLOCK_ITEMS:
        assert S.lexical_search(df.limit(0), queries).count() == 0 and S.lexical_search(df, queries.limit(0)).count() == 0


def test_keys_are_ordered_by_their_halves():
    keys = np.random.default_rng(1).integers(0, 1 << 32, 5000, dtype=np.uint32)
    keys[::3] = keys[1]
    assert (S.radix_order(keys) == np.argsort(keys, kind="stable")).all()


def test_lengths_beyond_64_bits():
    n = np.array([1, 10**9])
    assert S.length_norm(n, 10**10, 10**12).tolist() == [25 + 75 * x * 10**10 // 10**12 for x in (1, 10**9)]


PAGE = "<html><head><title>A page</title></head><body><p>%s</p></body></html>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "first": F.lit(1), "payload": F.lit("x")})


def brute_warc(rows):
    import hashlib

    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = first.get(h) if len(data) >= 100 and first.get(h) != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast_rows,archive,sample", [(W.BROADCAST_ROWS, W.ARCHIVE_BYTES, W.SAMPLE_BYTES), (0, 2000, 1500)])
def test_archives_come_back_as_they_were_written(spark, monkeypatch, tmp_path, broadcast_rows, archive, sample):
    """Small limits make many archives; without a broadcast the digests are joined by a shuffle."""
    marked = W.with_revisits
    monkeypatch.setattr(W, "with_revisits", lambda *a: marked(*a, broadcast_rows))
    rng = random.Random(4)
    html = [PAGE % " ".join(rng.choice(["lorem", "ipsum", "dolor", "日本", "été"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    rows = [(i, f"http://example.org/{i}?q=a b\r\nX: é", h) for i, h in enumerate(html)]
    rows += [(100 + i, None, html[i % 7]) for i in range(80)] + [(200, "u", None), (201, "u", ""), (202, "u", ""), (203, "", "short"), (204, "", "short")]
    rows += [(300, "u", "é" * 50), (301, "u", "é" * 50), (302, "u", "a" * 99), (303, "u", "a" * 99), (None, "u", html[3]), (None, None, PAGE % "no id" * 9), (7, "u", html[7])]
    rows += [(400, "u", "long text, " * 300_000), (401, "u", "\r\n\r\nWARC/1.1\r\n" * 20)]
    df, folder = pages(spark, rows).repartition(3), str(tmp_path / "archives")
    index = W.write_archives(df, folder, archive_bytes=archive, sample=sample).collect()
    back = W.read_archives(spark, folder, payloads=True).collect()
    got = sorted(((r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in back), key=str)
    assert got == brute_warc(rows)
    by_id = defaultdict(set)
    for i, _, h in rows:
        by_id[i].add(h or "")
    assert all(bytes(r.payload).decode() in by_id[r.page_id and int(r.page_id)] for r in back if r.record_type == "response")
    files = list((tmp_path / "archives").glob("*.warc.zst"))
    assert {p.name for p in files} == {r.archive for r in index} and len(files) >= (3 if archive < 9999 else 1)
    for path in files:
        data = path.read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        built = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
        places = sorted((r.offset, r.length, r.page_id) for r in index if r.archive == path.name)
        at = 8 + size
        for offset, length, page_id in places:  # one frame a record, without gaps, each readable alone
            assert offset == at
            frame = zstandard.ZstdDecompressor(dict_data=built).decompress(data[offset : offset + length])
            head, http, payload = W.read_record(data, offset, length)
            assert frame.startswith(b"WARC/1.1\r\n") and frame.endswith(b"\r\n\r\n") and W.page_of(head["warc-record-id"].strip("<>")) == page_id
            assert "x" not in head and head["warc-target-uri"].isascii() and " " not in head["warc-target-uri"]
            at += length
        assert at == len(data)


def test_archives_of_no_page(spark, tmp_path):
    none = pages(spark, [])
    assert W.write_archives(none, str(tmp_path / "a")).count() == 0 and W.read_archives(spark, str(tmp_path / "a")).count() == 0


def test_what_an_earlier_attempt_left_is_removed(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "pages-lost.warc.zst").write_bytes(b"half")
    W.write_archives(pages(spark, [(1, "u", PAGE % "x")]), str(tmp_path / "a"))
    assert [r.page_id for r in W.read_archives(spark, str(tmp_path / "a")).collect()] == ["1"]


def test_a_changed_payload_stops_the_job():
    import hashlib

    data = W.record("1", "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None, W.DATE)
    head, http, payload = W.parse_record(io.BufferedReader(io.BytesIO(data)))
    assert payload == b"payload" and http["content-length"] == "7"
    with pytest.raises(ValueError):
        W.parse_record(io.BufferedReader(io.BytesIO(data[:-6])))


def test_dictionaries_make_small_records_smaller():
    samples = [(PAGE % f"text {i} of {i * i}").encode() for i in range(400)]
    built = W.build_dictionary(samples)
    with_it, plain = zstandard.ZstdCompressor(dict_data=built), zstandard.ZstdCompressor()
    assert sum(len(with_it.compress(s)) for s in samples) < 0.7 * sum(len(plain.compress(s)) for s in samples)
    assert len(W.build_dictionary([b"one"]).as_bytes()) <= 8
