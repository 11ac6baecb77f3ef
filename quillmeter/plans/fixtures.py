"""Driver tables as usage_events and provider_catalog: one SQL text for Spark and DuckDB, with two dialect-dependent parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEMPLATE = """
e AS (SELECT event_id AS n, user_id AS u, event_type AS et, {ts} AS created_at, {k} AS k,
 CAST(floor(value) AS BIGINT) AS v, CAST(CAST(value AS DECIMAL(10,2)) AS STRING) AS cost_txt FROM events),
usage_events AS (SELECT 'node-' || CAST(u % 7 AS STRING) || ':req-' || CAST(n AS STRING) AS event_id,
 'node-' || CAST(u % 7 AS STRING) AS node_id, 'req-' || CAST(n AS STRING) AS request_id, created_at,
 CASE u % 5 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'gemini' WHEN 3 THEN 'opencode' ELSE 'grokbuild' END AS app_type,
 'prov-' || CAST(u % 25 AS STRING) AS provider_id, 'model-' || et || '-' || CAST(k % 4 AS STRING) AS model,
 'model-' || et AS request_model, '' AS pricing_model,
 v + k * 5 AS input_tokens, k AS output_tokens, CASE WHEN n % 4 = 0 THEN k * 6 ELSE k * 2 END AS cache_read_tokens,
 k % 10 AS cache_creation_tokens, n % 3 AS input_token_semantics,
 CASE n % 97 WHEN 0 THEN '' WHEN 1 THEN 'n/a' ELSE cost_txt END AS total_cost_usd, v * 10 + k AS latency_ms,
 CAST(CASE WHEN et = 'error' AND k % 2 = 0 THEN 500 WHEN et = 'error' THEN 429 WHEN et = 'signup' THEN 204 ELSE 200 END AS BIGINT) AS status_code,
 n % 2 = 0 AS is_streaming, CASE WHEN n % 3 = 0 THEN 'proxy' ELSE 'session_log' END AS data_source FROM e),
provider_catalog AS (SELECT DISTINCT 'node-' || CAST(u % 7 AS STRING) AS node_id,
 CASE u % 5 WHEN 0 THEN 'claude' WHEN 1 THEN 'codex' WHEN 2 THEN 'gemini' WHEN 3 THEN 'opencode' ELSE 'grokbuild' END AS app_type,
 'prov-' || CAST(u % 25 AS STRING) AS provider_id,
 CASE WHEN u % 25 % 5 = 4 THEN '' WHEN u % 25 % 5 = 3 AND u % 7 % 2 = 1 THEN n_name || ' (alt)' ELSE n_name END AS name
 FROM e JOIN nation ON n_nationkey = u % 25 WHERE u % 25 < 20)"""

SPARK = TEMPLATE.format(ts="timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)", k="CAST(get_json_object(props,'$.k') AS BIGINT)")
DUCKDB = TEMPLATE.format(ts="epoch_us(ts)//1000000", k="CAST(json_extract_string(props,'$.k') AS BIGINT)")


def _from(spark: SparkSession, sf_dir: str, what: str) -> DataFrame:
    events, nation = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "nation"))
    return spark.sql(f"WITH {SPARK.replace('FROM events', 'FROM {events}').replace('JOIN nation', 'JOIN {nation}')} SELECT * FROM {what}", events=events, nation=nation)


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, "usage_events")


def provider_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _from(spark, sf_dir, "provider_catalog")
