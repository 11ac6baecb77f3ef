"""Table schemas and null defaults of the usage model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType()}


def _fields(ddl: str) -> T.StructType:
    """A schema from "name type, ..."; Spark's own parser would need a session at import."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in ddl.split(","))])


USAGE_EVENTS = _fields(
    "event_id string, node_id string, request_id string, created_at long, app_type string, provider_id string, model string, "
    "request_model string, pricing_model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, "
    "input_token_semantics long, total_cost_usd string, latency_ms long, status_code long, is_streaming boolean, data_source string, received_at long"
)
#: Events as the store keeps them, by their UTC day.
STORED_EVENTS = T.StructType([*USAGE_EVENTS.fields, T.StructField("event_date", T.DateType())])
PROVIDER_CATALOG = _fields("node_id string, app_type string, provider_id string, name string, updated_at long")
ROLLUP_DIMENSIONS = ["node_id", "date", "app_type", "provider_id", "model", "request_model", "pricing_model"]
ROLLUP_MEASURES = [
    "request_count", "success_count", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "total_cost_usd", "avg_latency_ms"
]
#: What the importers give; the ledger adds prices to it.
USAGE_RECORD = _fields(
    "source_order int, source_path string, position long, request_id string, created_at long, app_type string, provider_id string, provider_type string, "
    "model string, request_model string, pricing_model string, input_tokens long, output_tokens long, cache_read_tokens long, cache_creation_tokens long, "
    "input_token_semantics long, latency_ms long, status_code long, is_streaming boolean, data_source string, session_id string, reported_total_cost_usd string"
)
#: Local providers, used where no provider table exists.  Fixed values: app type, provider id, name.
LOCAL_PROVIDERS = [
    ("claude", "_session", "Claude"),
    ("codex", "_codex_session", "Codex"),
    ("gemini", "_gemini_session", "Gemini"),
    ("opencode", "_opencode_session", "OpenCode"),
    ("grokbuild", "_grokbuild_session", "Grok Build"),
]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` in the given schema: missing columns become typed nulls, others are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def with_event_defaults(events: DataFrame) -> DataFrame:
    """The defaults applied on ingest; an older source without the semantics column counts as 0."""
    if "input_token_semantics" not in events.columns:
        events = events.withColumn("input_token_semantics", F.lit(0).cast("long"))
    fill = {"request_model": F.lit(""), "pricing_model": F.lit(""), "data_source": F.lit(""), "input_token_semantics": F.lit(0).cast("long")}
    return events.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill.items() if c in events.columns})


def with_event_date(events: DataFrame) -> DataFrame:
    """Adds the UTC day, the partition column of stored facts; no session time zone enters it."""
    return events.withColumn("event_date", F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("created_at") / 86400).cast("int")))
