"""The registered queries opN_<name>, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from . import byte_bpe as bpe
from . import lm_score as lm
from . import token_counts as counts
from .ann_search import ann_search
from .collocations import collocations
from .common import table, vocabulary_path
from .exact_dedup import exact_dedup
from .lexical_search import lexical_search
from .line_dedup import line_dedup
from .near_dedup import near_dedup
from .secret_scan import secret_scan, span_text
from .source_mix import mix_sources
from .toxicity import toxicity
from .warc import read_archives, write_archives


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(span_text("base_spans"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path(counts.MODEL))


def op6_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_search(table(spark, sf_dir, "embeddings"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_score(table(spark, sf_dir, "documents"), vocabulary_path(lm.MODEL))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = ("ids_sha256", "decoded_sha256")
    return bpe.byte_bpe(table(spark, sf_dir, "documents"), vocabulary_path(bpe.VOCABULARY), bpe.default_pattern(), carry=["doc_id"], give=digests)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = table(spark, sf_dir, "pages"), f"{shared_folder(spark)}/quillmeter-warc-{uuid.uuid4().hex}"
    write_archives(pages, folder)
    id_type = pages.schema["page_id"].dataType
    return read_archives(spark, folder).withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS text FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY text) AS kept, sha256(text) AS text_sha256
FROM t
"""

OP4_SQL = r"""
WITH lines AS (
  SELECT doc_id, rid, line, pos,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, rid, unnest(parts) AS line, unnest(range(len(parts))) AS pos
        FROM (SELECT doc_id, row_number() OVER () AS rid, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
common AS (
  SELECT key, max(doc_id) AS last_doc FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT lines.*, common.key IS NOT NULL AND doc_id <> last_doc AS dropped FROM lines LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""

OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1' || coalesce(':' || CAST(doc_id AS VARCHAR), '')) AS key,
         CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src FROM documents),
shards AS (SELECT CAST(256 * pow(2, greatest(0, ceil(log2(greatest(coalesce(sum(size), 0), 1) / (256 * 4194304.0))))) AS BIGINT) AS n FROM sized),
dealt AS (SELECT sized.*, CAST('0x' || substr(key, 1, 7) AS BIGINT) % shards.n AS shard FROM sized, shards),
parts AS (SELECT src, source, shard, CAST(sum(size) AS BIGINT) AS words FROM dealt GROUP BY ALL),
sources AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS src_rank
  FROM (SELECT src, source, CAST(sum(words) AS BIGINT) AS source_size FROM parts GROUP BY ALL)),
weighed AS (SELECT *, CAST([5, 2, 1][(src_rank - 1) % 3 + 1] AS BIGINT) AS weight, source_size * 2 AS cap FROM sources),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) - CAST(sum(cap) OVER w - cap AS BIGINT))
            / CAST(sum(weight) OVER () - (sum(weight) OVER w - weight) AS BIGINT) AS level
  FROM weighed WINDOW w AS (ORDER BY CAST(cap AS DOUBLE) / weight, src_rank ROWS UNBOUNDED PRECEDING)),
targets AS (SELECT *, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM levels),
votes AS (
  SELECT src, shard, words, source_size, target, src_rank,
         CASE WHEN source_size > 0 THEN CAST(floor(target * words / source_size) AS BIGINT) ELSE 0 END AS votes
  FROM parts JOIN targets USING (src)),
seats AS (
  SELECT *, CAST(sum(votes) OVER w AS BIGINT) AS all_votes, (CAST(sum(votes) OVER w AS BIGINT) + 32) // 64 AS blocks
  FROM votes WINDOW w AS (PARTITION BY shard)),
quotients AS (
  SELECT src, shard, row_number() OVER (PARTITION BY shard ORDER BY CAST(votes AS DOUBLE) / (2 * k + 1) DESC, src_rank) AS place, blocks
  FROM (SELECT *, unnest(range(CAST(2 + 2 * votes // 64 + 2 AS BIGINT))) AS k FROM seats)),
quotas AS (SELECT src, shard, count(*) AS quota FROM quotients WHERE place <= blocks GROUP BY ALL),
blocks AS (
  SELECT src, shard, source_size, target, words, greatest((words + 63) // 64, 1) AS n,
         least(coalesce(quota, 0), 2 * ((words + 63) // 64)) AS quota,
         CAST('0x' || substr(md5('mix-1:' || src || ':' || CAST(shard AS VARCHAR)), 1, 7) AS BIGINT) % greatest((words + 63) // 64, 1) AS phase
  FROM seats LEFT JOIN quotas USING (src, shard)),
placed AS (
  SELECT doc_id, size, source_size, target, n, quota // n AS passes, quota % n AS rest, phase, to_ AS b, to_ - size AS a
  FROM (SELECT *, CAST(sum(size) OVER (PARTITION BY src, shard ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS to_ FROM dealt)
  JOIN blocks USING (src, shard))
SELECT doc_id, size, source_size, target,
       passes * size
       + ((b // 64 * rest + phase) // n * 64 + b % 64 * (((b // 64 + 1) * rest + phase) // n - (b // 64 * rest + phase) // n))
       - ((a // 64 * rest + phase) // n * 64 + a % 64 * (((a // 64 + 1) * rest + phase) // n - (a // 64 * rest + phase) // n)) AS taken
FROM placed
"""

OP11_SQL = r"""
WITH pieces AS (
  SELECT lang, pid, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT lang, piece, row_number() OVER () AS pid FROM (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents))),
grams AS (
  SELECT lang, g, array_to_string(w[i : i + g - 1], ' ') AS phrase
  FROM (SELECT lang, g, w, unnest(range(1, len(w) - g + 2)) AS i FROM pieces, (SELECT unnest([1, 2, 3]) AS g) WHERE len(w) >= g)),
f AS (SELECT lang, g, phrase, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE g = 1 GROUP BY lang),
candidates AS (SELECT lang, g, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE g >= 2 AND f >= 10),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1 : g], ' ') AS tail
  FROM (SELECT *, unnest(range(1, g)) AS k FROM candidates)),
scored AS (
  SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r,
         CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS longer FROM candidates WHERE g = 3)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest JOIN sizes USING (lang)
WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = lowest.lang AND i.phrase = lowest.phrase AND 100 * longer >= 50 * a)
QUALIFY rank <= 2000
"""

OP12_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM q
"""

OP13_SQL = r"""
WITH d AS (
  SELECT rid, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS rid FROM documents)),
i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)),
facts AS (SELECT count(DISTINCT rid) AS n_docs, count(*) AS len FROM d),
lengths AS (SELECT rid, doc_id, count(*) AS n FROM d GROUP BY ALL),
tfs AS (SELECT rid, term, count(*) AS tf FROM d GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, facts GROUP BY term, n_docs),
scored AS (
  SELECT item_id, doc_id, rid, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // len)))) AS BIGINT) AS score
  FROM i JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (rid), facts GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": op1_exact_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_secret_scan": op3_secret_scan,
        "op4_line_dedup": op4_line_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_ann_search": op6_ann_search,
        "op7_near_dedup": op7_near_dedup,
        "op8_lm_score": op8_lm_score,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_mix_sources": op10_mix_sources,
        "op11_collocations": op11_collocations,
        "op12_warc": op12_warc,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": OP1_SQL,
        "op4_line_dedup": OP4_SQL,
        "op10_mix_sources": OP10_SQL,
        "op11_collocations": OP11_SQL,
        "op12_warc": OP12_SQL,
        "op13_lexical_search": OP13_SQL,
    }
