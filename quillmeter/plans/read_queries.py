"""Registered read queries over the adapter tables, and the same in DuckDB SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import usage as U
from ..operators import analytics as A
from .fixtures import DUCKDB, provider_catalog, usage_events
from .params import resolve_daily, resolve_query

BEGIN, END = 1704067200, 1706659200  # 2024-01-01 to 2024-01-31
MONEY = ("total_cost_usd", "avg_latency_ms", "success_rate", "cache_hit_rate")


def rounded(df: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order in the last digits, so money and means are compared at four decimals."""
    return df.withColumns({c: F.round(c, 4) for c in MONEY if c in df.columns})


def _query(**more):
    return resolve_query(END, BEGIN, END, **more)


def q_summary(spark, d):
    return rounded(A.summary(usage_events(spark, d), _query()))


def q_summary_filtered(spark, d):
    return rounded(A.summary(usage_events(spark, d), _query(app_type="codex", data_source="session_log", node_id=" node-1 ")))


def q_summary_empty(spark, d):
    return rounded(A.summary(usage_events(spark, d), _query(model="no-such-model")))


def q_usage_summary(spark, d):
    return rounded(A.usage_summary(usage_events(spark, d), BEGIN + 3600, END, node_id="node-2"))


def q_fresh_input_by_app(spark, d):
    rows = usage_events(spark, d).withColumn("fresh", U.fresh_input())
    return rows.groupBy("app_type", "input_token_semantics").agg(F.count(F.lit(1)).alias("n"), F.sum("fresh").alias("fresh"))


def _trend(bucket, offset=None, begin=BEGIN, end=END):
    return lambda spark, d: rounded(A.trend(usage_events(spark, d), resolve_query(end, begin, end, bucket, offset)))


def q_daily_calendar(spark, d):
    return rounded(A.daily(usage_events(spark, d), resolve_daily(END - 7200, offset_minutes=-300)))


def q_heatmap_levels(spark, d):
    days = A.daily(usage_events(spark, d), resolve_daily(END - 7200, offset_minutes=-300))
    return A.heatmap_levels(days).select("bucket_start", "real_total_tokens", "level")


def _breakdown(dimension):
    return lambda spark, d: rounded(A.breakdown(usage_events(spark, d), _query(), dimension))


def q_breakdown_provider(spark, d):
    return rounded(A.provider_breakdown(usage_events(spark, d), provider_catalog(spark, d), _query()))


def q_top_cost_models(spark, d):
    return rounded(A.top_cost_models(A.breakdown(usage_events(spark, d), _query(), "model")))


def q_facets(spark, d):
    return A.facets(usage_events(spark, d), provider_catalog(spark, d), _query())


def _page(before=None, limit=50):
    return lambda spark, d: A.events_page(usage_events(spark, d), provider_catalog(spark, d), _query(), limit, before)


def q_daily_rollup(spark, d):
    return rounded(A.daily_rollup(usage_events(spark, d)))


def q_overview(spark, d):
    """All parts of the overview in one table: its part, key and label, requests, tokens, cost."""
    found = A.overview(usage_events(spark, d), provider_catalog(spark, d), _query())
    summary, trend = (found[n].withColumns({"key": key, "label": F.lit("")}) for n, key in (("summary", F.lit("")), ("trend", F.col("bucket_start").cast("string"))))
    parts = {"summary": summary, "trend": trend, **found["breakdowns"]}
    columns = ["key", "label", "total_requests", "real_total_tokens", F.round("total_cost_usd", 4).alias("total_cost_usd")]
    return reduce(DataFrame.unionByName, [df.select(F.lit(n).alias("part"), *columns) for n, df in parts.items()])


def q_calendar_grid(spark, d):
    months = usage_events(spark, d).select(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created_at") / 86400).cast("int")).alias("month"))
    return A.calendar_grid(months)


CURSOR = (1705363200, "node-3:req-5")

# ---- the same in DuckDB

FRESH = """CASE WHEN input_token_semantics = 2 THEN input_tokens
 WHEN app_type IN ('codex','gemini','grokbuild') AND input_token_semantics = 1 AND input_tokens >= cache_read_tokens + cache_creation_tokens
 THEN input_tokens - cache_read_tokens - cache_creation_tokens
 WHEN app_type IN ('codex','gemini','grokbuild') AND input_token_semantics = 0 AND input_tokens >= cache_read_tokens THEN input_tokens - cache_read_tokens
 ELSE input_tokens END"""
COST = r"coalesce(TRY_CAST(nullif(regexp_extract(total_cost_usd, '^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)', 1), '') AS DOUBLE), 0.0)"
M = f""", m AS (SELECT *, fresh + output_tokens + cache_creation_tokens + cache_read_tokens AS real_total
 FROM (SELECT *, {FRESH} AS fresh, CASE WHEN status_code BETWEEN 200 AND 299 THEN 1 ELSE 0 END AS ok, {COST} AS cost FROM usage_events))"""
RANGE = f"created_at >= {BEGIN} AND created_at < {END}"


def _sql(body: str) -> str:
    return f"WITH {DUCKDB}{M} {body}"


def _big(expression: str, name: str) -> str:
    return f"CAST(coalesce({expression}, 0) AS BIGINT) AS {name}"


def summary_sql(where: str) -> str:
    return _sql(f"""SELECT *, round(CASE WHEN total_requests > 0 THEN CAST(success_requests AS DOUBLE) / total_requests * 100 ELSE 0.0 END, 4) AS success_rate,
 round(CASE WHEN input_tokens + cache_creation_tokens + cache_read_tokens > 0
  THEN CAST(cache_read_tokens AS DOUBLE) / (input_tokens + cache_creation_tokens + cache_read_tokens) ELSE 0.0 END, 4) AS cache_hit_rate
 FROM (SELECT count(*) AS total_requests, {_big('sum(ok)', 'success_requests')}, {_big('sum(fresh)', 'input_tokens')}, {_big('sum(output_tokens)', 'output_tokens')},
 {_big('sum(cache_read_tokens)', 'cache_read_tokens')}, {_big('sum(cache_creation_tokens)', 'cache_creation_tokens')}, {_big('sum(real_total)', 'real_total_tokens')},
 round(coalesce(sum(cost), 0.0), 4) AS total_cost_usd, round(coalesce(avg(latency_ms), 0.0), 4) AS avg_latency_ms, min(created_at) AS first_at, max(created_at) AS last_at
 FROM m WHERE {where})""")


def trend_sql(start: str, spine: str, where: str = RANGE) -> str:
    return _sql(f""", g AS (SELECT {start} AS bucket_start, count(*) AS n, sum(ok) AS ok, sum(fresh) AS fresh, sum(cache_creation_tokens) AS cc, sum(cache_read_tokens) AS cr,
 sum(output_tokens) AS o, sum(cost) AS cost, sum(latency_ms) AS latency FROM m WHERE {where} GROUP BY 1),
 s AS ({spine})
 SELECT s.bucket_start, {_big('n', 'total_requests')}, {_big('ok', 'success_requests')}, round(CASE WHEN n > 0 THEN CAST(ok AS DOUBLE) / n * 100 ELSE 0.0 END, 4) AS success_rate,
 {_big('fresh + cc + cr', 'input_tokens')}, {_big('o', 'output_tokens')}, {_big('cc', 'cache_creation_tokens')}, {_big('cr', 'cache_read_tokens')},
 {_big('fresh + cc + cr + o', 'real_total_tokens')}, round(coalesce(cost, 0.0), 4) AS total_cost_usd,
 round(CASE WHEN n > 0 THEN CAST(latency AS DOUBLE) / n ELSE 0.0 END, 4) AS avg_latency_ms
 FROM s LEFT JOIN g USING (bucket_start)""".replace(", g AS", ", g AS", 1)).replace(f"{M} , g AS", f"{M}, g AS")


def fixed_spine(begin: int, end: int, s: int, o: int = 0) -> str:
    return f"SELECT CAST(unnest(range(({begin} + {o}) // {s} * {s} - {o}, ({end} - 1 + {o}) // {s} * {s} - {o} + {s}, {s})) AS BIGINT) AS bucket_start"


DAILY_END = (END - 7200 - 300 * 60) // 86400 * 86400 + 300 * 60 + 86400
DAILY_SQL = trend_sql("(created_at - 18000) // 86400 * 86400 + 18000", fixed_spine(DAILY_END - 365 * 86400, DAILY_END, 86400, -18000), f"created_at >= {DAILY_END - 365 * 86400} AND created_at < {DAILY_END}")


def breakdown_sql(dimension: str) -> str:
    return _sql(f"""SELECT {dimension} AS key, {dimension} AS label, count(*) AS total_requests, round(CAST(sum(ok) AS DOUBLE) / count(*) * 100, 4) AS success_rate,
 CAST(sum(real_total) AS BIGINT) AS real_total_tokens, round(sum(cost), 4) AS total_cost_usd FROM m WHERE {RANGE} GROUP BY 1 ORDER BY real_total_tokens DESC, key LIMIT 10""")


def page_sql(where: str, limit: int) -> str:
    return _sql(f"""SELECT m.event_id, m.node_id, request_id, created_at, m.app_type, m.provider_id, coalesce(nullif(p.name, ''), m.provider_id) AS provider_name, model,
 request_model, pricing_model, fresh AS input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, real_total AS real_total_tokens, cost AS total_cost_usd,
 latency_ms, status_code, is_streaming, data_source
 FROM m LEFT JOIN provider_catalog p USING (node_id, app_type, provider_id) WHERE {RANGE} AND {where} ORDER BY created_at DESC, event_id DESC LIMIT {limit}""")


QUERIES = {
    "q_summary": q_summary,
    "q_summary_filtered": q_summary_filtered,
    "q_summary_empty": q_summary_empty,
    "q_usage_summary": q_usage_summary,
    "q_fresh_input_by_app": q_fresh_input_by_app,
    "q_trend_hour": _trend("1h"),
    "q_trend_custom_90m": _trend("90m"),
    "q_trend_auto": _trend(None),
    "q_trend_day_tz": _trend("1d", 480),
    "q_trend_month": _trend("1mo", 0, BEGIN - 70 * 86400, END + 40 * 86400),
    "q_daily_calendar": q_daily_calendar,
    "q_heatmap_levels": q_heatmap_levels,
    "q_breakdown_node": _breakdown("node_id"),
    "q_breakdown_app": _breakdown("app_type"),
    "q_breakdown_model": _breakdown("model"),
    "q_breakdown_provider": q_breakdown_provider,
    "q_top_cost_models": q_top_cost_models,
    "q_facets": q_facets,
    "q_events_first_page": _page(),
    "q_events_next_page": _page(CURSOR, 37),
    "q_daily_rollup": q_daily_rollup,
    "q_overview": q_overview,
    "q_calendar_grid": q_calendar_grid,
}
ORACLES = {
    "q_summary": summary_sql(RANGE),
    "q_summary_filtered": summary_sql(f"{RANGE} AND app_type = 'codex' AND data_source = 'session_log' AND node_id = 'node-1'"),
    "q_summary_empty": summary_sql(f"{RANGE} AND model = 'no-such-model'"),
    "q_usage_summary": _sql(f"""SELECT count(*) AS requests, {_big('sum(input_tokens)', 'input_tokens')}, {_big('sum(output_tokens)', 'output_tokens')},
 {_big('sum(cache_read_tokens)', 'cache_read_tokens')}, {_big('sum(cache_creation_tokens)', 'cache_creation_tokens')}, round(coalesce(sum(cost), 0.0), 4) AS total_cost_usd
 FROM m WHERE created_at >= {BEGIN + 3600} AND created_at <= {END} AND node_id = 'node-2'"""),
    "q_fresh_input_by_app": _sql("SELECT app_type, input_token_semantics, count(*) AS n, CAST(sum(fresh) AS BIGINT) AS fresh FROM m GROUP BY 1, 2"),
    "q_trend_hour": trend_sql("created_at // 3600 * 3600", fixed_spine(BEGIN, END, 3600)),
    "q_trend_custom_90m": trend_sql("created_at // 5400 * 5400", fixed_spine(BEGIN, END, 5400)),
    "q_trend_auto": trend_sql("created_at // 86400 * 86400", fixed_spine(BEGIN, END, 86400)),
    "q_trend_day_tz": trend_sql("(created_at + 28800) // 86400 * 86400 - 28800", fixed_spine(BEGIN, END, 86400, 28800)),
    "q_trend_month": trend_sql(
        "epoch_us(date_trunc('month', make_timestamp(created_at * 1000000))) // 1000000",
        f"SELECT epoch_us(unnest(generate_series(date_trunc('month', make_timestamp({BEGIN - 70 * 86400} * 1000000::BIGINT)), "
        f"date_trunc('month', make_timestamp(({END + 40 * 86400} - 1) * 1000000::BIGINT)), INTERVAL 1 MONTH))) // 1000000 AS bucket_start",
        f"created_at >= {BEGIN - 70 * 86400} AND created_at < {END + 40 * 86400}",
    ),
    "q_daily_calendar": DAILY_SQL,
    "q_heatmap_levels": f"""WITH days AS ({DAILY_SQL}) SELECT bucket_start, real_total_tokens, CAST(CASE WHEN real_total_tokens <= 0 THEN 0
 WHEN real_total_tokens = max(real_total_tokens) OVER () THEN 4
 ELSE greatest(1, least(4, ceil(CAST(rank() OVER (PARTITION BY real_total_tokens > 0 ORDER BY real_total_tokens) AS DOUBLE) / count(*) OVER (PARTITION BY real_total_tokens > 0) * 4))) END AS INTEGER) AS level
 FROM days""",
    "q_breakdown_node": breakdown_sql("node_id"),
    "q_breakdown_app": breakdown_sql("app_type"),
    "q_breakdown_model": breakdown_sql("model"),
    "q_breakdown_provider": _sql(f"""SELECT provider_id AS key, coalesce(nullif(name, ''), provider_id) AS label, count(*) AS total_requests,
 round(CAST(sum(ok) AS DOUBLE) / count(*) * 100, 4) AS success_rate, CAST(sum(real_total) AS BIGINT) AS real_total_tokens, round(sum(cost), 4) AS total_cost_usd
 FROM m LEFT JOIN provider_catalog USING (node_id, app_type, provider_id) WHERE {RANGE} GROUP BY provider_id, name ORDER BY real_total_tokens DESC, key, label LIMIT 10"""),
    "q_top_cost_models": f"SELECT * FROM ({breakdown_sql('model')}) WHERE total_cost_usd > 0 ORDER BY total_cost_usd DESC, real_total_tokens DESC, key LIMIT 3",
    "q_facets": _sql(f"""SELECT DISTINCT 'node_id' AS facet, node_id AS value, node_id AS label FROM m WHERE {RANGE}
 UNION ALL SELECT DISTINCT 'app_type', app_type, app_type FROM m WHERE {RANGE} UNION ALL SELECT DISTINCT 'model', model, model FROM m WHERE {RANGE}
 UNION ALL SELECT DISTINCT 'data_source', data_source, data_source FROM m WHERE {RANGE}
 UNION ALL SELECT 'provider_id', provider_id, min(coalesce(nullif(name, ''), provider_id)) FROM m LEFT JOIN provider_catalog USING (node_id, app_type, provider_id)
 WHERE {RANGE} GROUP BY provider_id"""),
    "q_events_first_page": page_sql("true", 50),
    "q_events_next_page": page_sql(f"(created_at < {CURSOR[0]} OR (created_at = {CURSOR[0]} AND event_id < '{CURSOR[1]}'))", 37),
    "q_daily_rollup": _sql("""SELECT node_id, strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d') AS date, app_type, provider_id, model, request_model, pricing_model,
 count(*) AS request_count, CAST(sum(ok) AS BIGINT) AS success_count, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
 CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens, round(sum(cost), 4) AS total_cost_usd,
 round(avg(latency_ms), 4) AS avg_latency_ms FROM m GROUP BY ALL"""),
    "q_calendar_grid": _sql("""SELECT month, cell, month - CAST(dayofweek(month) AS INTEGER) + cell AS day FROM (SELECT DISTINCT CAST(date_trunc('month', make_timestamp(created_at * 1000000)) AS DATE) AS month FROM m),
 (SELECT CAST(unnest(range(42)) AS INTEGER) AS cell)"""),
}
_OVERVIEW = {"summary": ("q_summary", "''", "''"), "trend": ("q_trend_auto", "CAST(bucket_start AS VARCHAR)", "''")} | {
    part: (f"q_breakdown_{name}", "key", "label") for part, name in (("nodes", "node"), ("apps", "app"), ("models", "model"), ("providers", "provider"))
}
ORACLES["q_overview"] = " UNION ALL ".join(
    f"SELECT '{part}' AS part, {key} AS key, {label} AS label, total_requests, real_total_tokens, total_cost_usd FROM ({ORACLES[name]})" for part, (name, key, label) in _OVERVIEW.items()
)
