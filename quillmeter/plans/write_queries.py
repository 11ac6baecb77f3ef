"""Registered queries of the write path, pricing, importers and streaming, and the same in DuckDB SQL where it can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import usage as U
from ..operators import ingest, ledger, pricing
from ..schema import ROLLUP_DIMENSIONS, USAGE_EVENTS, conform, with_event_defaults
from ..sources import files, sessions, tables
from ..sources.shared import shared_folder
from ..streaming import upload
from .fixtures import DUCKDB, provider_catalog, usage_events
from .read_queries import BEGIN, END

NOW = END + 86400
ROLLUP_SQL = """SELECT node_id, {day} AS date, app_type, provider_id, model, request_model, pricing_model, count(*) AS request_count,
 CAST(sum(CASE WHEN status_code BETWEEN 200 AND 299 THEN 1 ELSE 0 END) AS BIGINT) AS success_count, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
 CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
 CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens, CAST(count(*) AS STRING) AS total_cost_usd, CAST(max(latency_ms) AS BIGINT) AS avg_latency_ms
 FROM {rows} GROUP BY ALL"""


def q_cursor_scan(spark: SparkSession, d: str) -> DataFrame:
    rows = usage_events(spark, d).drop("input_token_semantics")
    return tables.cursor_scan(rows, (BEGIN + 10 * 86400, "req-5"), 512).select("created_at", "request_id", "node_id", "model", "input_token_semantics")


def q_ingest_disposition(spark: SparkSession, d: str) -> DataFrame:
    """A second batch that overlaps the store and repeats some of its own events."""
    rows = usage_events(spark, d).withColumn("n", F.regexp_extract("request_id", "[0-9]+", 0).cast("long"))
    store = rows.filter("n % 3 <> 0")
    again = rows.filter("n % 2 = 0").withColumn("seq", F.col("n")).unionByName(rows.filter("n % 12 = 0").withColumn("seq", F.col("n") + 10_000_000))
    return ingest.ingest_batch(store, again, NOW)[1]


def q_late_overlap(spark: SparkSession, d: str) -> DataFrame:
    """A rescan that starts an hour before the cursor, against what was stored up to the cursor."""
    rows = usage_events(spark, d).withColumn("n", F.regexp_extract("request_id", "[0-9]+", 0).cast("long"))
    cursor = BEGIN + 15 * 86400
    store = rows.filter((F.col("created_at") <= cursor) & (F.col("n") % 7 != 0))
    start = tables.overlap_start((cursor, ""), 86400)
    scan = rows.filter((F.col("created_at") >= start[0]) & (F.col("created_at") <= cursor)).withColumn("seq", F.col("n"))
    return ingest.ingest_batch(store, scan, NOW)[1].groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


def _rollups(spark: SparkSession, d: str, where: str) -> DataFrame:
    rows = usage_events(spark, d).filter(where)
    day = "CAST(date_add(DATE'1970-01-01', CAST(created_at div 86400 AS INT)) AS STRING)"
    return spark.sql(ROLLUP_SQL.format(day=day, rows="{rows}"), rows=rows)


def q_rollup_upsert(spark: SparkSession, d: str) -> DataFrame:
    store = _rollups(spark, d, "latency_ms % 3 <> 0").withColumns({"snapshot_key": U.rollup_key(ROLLUP_DIMENSIONS), "received_at": F.lit(BEGIN).cast("long")})
    arrived = _rollups(spark, d, "latency_ms % 2 = 0").withColumn("seq", F.lit(0))
    return ingest.upsert_rollups(store, arrived, NOW)


def q_catalog_upsert(spark: SparkSession, d: str) -> DataFrame:
    known = provider_catalog(spark, d).withColumn("updated_at", F.lit(BEGIN).cast("long"))
    renamed = known.filter("app_type = 'codex'").withColumns({"name": F.concat("name", F.lit(" 2")), "seq": F.lit(1)})
    added = known.filter("node_id = 'node-1'").withColumns({"node_id": F.lit("node-9"), "seq": F.lit(2)})
    twice = renamed.withColumns({"name": F.concat("name", F.lit("b")), "seq": F.lit(3)}).filter("node_id = 'node-2'")
    return ingest.upsert_catalog(known, renamed.union(added.select(renamed.columns)).union(twice), NOW)


PRICE_LIST = [
    ("gpt-5", 1.25, 10.0, 0.125, 0.0), ("gpt-5-mini", 0.25, 2.0, 0.025, 0.0), ("claude-sonnet-4", 3.0, 15.0, 0.3, 3.75), ("claude-opus-4-20250514", 15.0, 75.0, 1.5, 18.75),
    ("gemini-2.5-pro", 1.25, 10.0, 0.31, 0.0), ("model-click-1", 0.5, 1.5, 0.05, 0.6), ("model-view", 0.4, 1.2, 0.04, 0.5), ("model-purchase-2-x", 2.0, 4.0, 0.2, 2.5),
]
PRICE_SCHEMA = "price_key string, input double, output double, cache_read double, cache_creation double"
MODELS = [
    "openai/gpt-5", "gpt-5", "Vendor/GPT-5@2025:free", "anthropic.claude-sonnet-4", "us.anthropic.claude-sonnet-4-20250514", "claude-opus-4", "claude-sonnet-4-thinking", "gpt-5-mini-20250807",
    "bedrock.gemini-2.5-pro", "unknown-model", " ", "a/b/c:d", "global.gpt-5",
]


def _prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICE_LIST, PRICE_SCHEMA)


def _varied(names: list[str]) -> str:
    """SQL of texts t made of fixed ones and columns of the parts, with white space that trims have to know."""
    listed = ", ".join("'" + n.replace("'", "''") + "'" for n in names)
    return f"""SELECT DISTINCT element_at(FIRST({listed}), CAST(p_partkey % {len(names)} AS INT) + 1) || CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN ':' || p_brand WHEN 2 THEN '-' || CAST(20250000 + p_size AS STRING)
      WHEN 3 THEN chr(9) || chr(10) ELSE ' É' END AS t FROM part"""


def _texts(spark: SparkSession, d: str, names: list[str]) -> DataFrame:
    return spark.sql(_varied(names).replace("FIRST", "array").replace("FROM part", "FROM {part}").replace("{part}", "{p}"), p=spark.read.parquet(f"{d}/part.parquet"))


def texts_sql(names: list[str]) -> str:
    return _varied(names).replace("element_at(FIRST(", "list_extract(list_value(").replace("STRING", "VARCHAR")


def q_pricing_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d, MODELS).withColumnRenamed("t", "model")
    return rows.select("model", F.posexplode(pricing.candidates("model")).alias("pos", "candidate"))


def q_price_match(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d, MODELS).withColumnRenamed("t", "model")
    return pricing.match_prices(rows, _prices(spark))


def _record_costs(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("request_id", "[0-9]+", 0).cast("long")
    rows = usage_events(spark, d).withColumns({
        "pricing_model": F.when(n % 5 == 0, F.lit("\tUnknown \n")).otherwise(F.lit("")),
        "model": F.when(n % 7 == 0, F.lit("none")).otherwise(F.col("model")),
        "reported_total_cost_usd": F.when(n % 11 == 0, F.col("total_cost_usd")),
    }).drop("total_cost_usd")
    return pricing.with_costs(rows, _prices(spark))


def q_cost(spark: SparkSession, d: str) -> DataFrame:
    rows = _record_costs(spark, d)
    costs = {c: F.round(c, 8) for c in ledger.COSTS} | {"total": F.round(U.lenient_double("total_cost_usd"), 9)}
    return rows.withColumns(costs).select("event_id", "priced_as", *ledger.COSTS, "total")


def _ledger_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"session_id": F.lit(None).cast("string"), "provider_type": F.col("data_source")} | {c: F.lit(0.0) for c in ledger.COSTS})


def _upserted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A run in which requests return, with and without changes, from their own source and from another."""
    n = F.regexp_extract("request_id", "[0-9]+", 0).cast("long")
    rows = _ledger_rows(usage_events(spark, d)).withColumn("n", n)
    known = rows.filter("n % 3 <> 0").select(ledger.COLUMNS)

    def part(path: str, where: str, more, source=F.col("data_source")) -> DataFrame:
        told = {"output_tokens": F.col("output_tokens") + more, "data_source": source, "created_at": F.col("created_at") + 5}
        return rows.filter(where).withColumns(told | {"source_order": F.lit(0), "source_path": F.lit(path), "position": F.col("n")})

    run = part("a", "n % 2 = 0", F.when(F.col("n") % 5 == 0, 1).otherwise(0), F.when(F.col("n") % 4 == 0, F.lit("other")).otherwise(F.col("data_source")))
    for path, where, more in (("b", "n % 6 = 0", 9), ("c", "n % 18 = 0", 9), ("d", "n % 10 = 0", 4)):
        run = run.union(part(path, where, more))
    return ledger.upsert_ledger(known, run)


def q_ledger_upsert(spark: SparkSession, d: str) -> DataFrame:
    return _upserted(spark, d)[0].select("request_id", "created_at", "data_source", "provider_type", "output_tokens")


def q_ledger_counts(spark: SparkSession, d: str) -> DataFrame:
    return _upserted(spark, d)[1]


LENIENT = ["1.5xyz", "", "abc", " 1.5", "1e-7", "inf", "NaN", "0x10", "-3.", ".5", "+2e3z", "1e", "1.5d", "12"]


def q_lenient_cost(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, LENIENT).select("t", U.lenient_double("t").alias("value"))


NAMES = ["OpenAI/GPT-5-Codex-2025-08-07", "gpt-5-20250807", "a/b/C", "x-2025-08-07-20250807", "x-20250807-2025-08-07", "plain", "-20250807", " NULL", "none", ""]


def q_model_normalize(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d, NAMES)
    return rows.select("t", U.normalised_codex_model("t").alias("model"), U.is_placeholder("t").alias("placeholder"))


# ---- importers, over logs written from the events table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(
        "SELECT event_id AS n, user_id AS u, timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS t, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, event_type AS et FROM {e}",
        e=spark.read.parquet(f"{d}/events.parquet"),
    )


THREAD = "concat('00000000-0000-0000-0000-', lpad(CAST(u AS STRING), 12, '0'))"


def codex_lines(spark: SparkSession, d: str) -> DataFrame:
    """One file a user: a meta line, then cumulative counters by event, with a model line before every tenth."""
    sql = f"""
      WITH r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n) AS i, sum(k) OVER (PARTITION BY u ORDER BY n) AS total FROM CODEX_E)
      SELECT concat('/s/rollout-2024-', {THREAD}, '.jsonl') AS path, 0 AS line_no, concat('{{"type":"session_meta","timestamp":1704000000,"payload":{{"id":"', {THREAD}, '"}}}}') AS line
      FROM r WHERE i = 1
      UNION ALL SELECT concat('/s/rollout-2024-', {THREAD}, '.jsonl'), CAST(3 * i AS INT), concat('{{"type":"turn_context","payload":{{"model":"m-', et, '"}}}}') FROM r WHERE i % 10 = 1
      UNION ALL SELECT concat('/s/rollout-2024-', {THREAD}, '.jsonl'), CAST(3 * i + 1 AS INT), concat('{{"type":"event_msg","timestamp":', t,
       ',"payload":{{"type":"token_count","info":{{"total_token_usage":{{"input_tokens":', total, ',"cached_input_tokens":', total div 2, ',"output_tokens":', i, '}}}}}}}}') FROM r
      UNION ALL SELECT concat('/s/rollout-2024-', {THREAD}, '.jsonl'), CAST(3 * i + 2 AS INT), '{{"type":' FROM r WHERE i % 5 = 0"""
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("CODEX_E", "{e}"), e=_events(spark, d))


RECORD = ["request_id", "session_id", "created_at", "app_type", "model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "latency_ms", "reported_total_cost_usd"]


def q_codex_delta(spark: SparkSession, d: str) -> DataFrame:
    return sessions.codex_records(codex_lines(spark, d), NOW).select(*RECORD)


def fork_lines(lines: DataFrame) -> DataFrame:
    """Each even user's session again as a fork: a child that replays ten events of its parent and goes on."""
    child = lambda c: F.regexp_replace(c, "00000000-0000-0000-0000-0000", "00000000-0000-0000-0000-9999")
    fork = lines.filter(F.col("path").rlike("[02468].jsonl$") & (F.col("line_no") < 60))
    meta = F.regexp_replace(child(F.col("line")), r"\"id\":\"([^\"]+)\"", "\"id\":\"$1\",\"forked_from_id\":\"XX\"")
    parent = F.regexp_extract("path", r"rollout-2024-(.*)\.jsonl", 1)
    fork = fork.withColumn("line", F.when(F.col("line_no") == 0, F.replace(F.regexp_replace(meta, "1704000000", "1735600000"), F.lit("XX"), parent)).otherwise(F.col("line")))
    changed = F.regexp_replace("line", r"\"output_tokens\":", "\"output_tokens\":7")
    return fork.withColumn("line", F.when(F.col("line_no") > 31, changed).otherwise(F.col("line"))).withColumn("path", child(F.col("path")))


def q_codex_replay(spark: SparkSession, d: str) -> DataFrame:
    lines = codex_lines(spark, d)
    return sessions.codex_records(lines.union(fork_lines(lines)), NOW).select(*RECORD)


def claude_lines(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a file come several times; some lines have a stop reason, some are no answers."""
    return spark.sql("""SELECT concat('/p/', u, '.jsonl') AS path, CAST(n AS INT) AS line_no, concat('{{"type":"', CASE WHEN k % 13 = 0 THEN 'user' ELSE 'assistant' END, '","sessionId":"s', u,
      '","timestamp":', t, ',"message":{{"id":"m', u, '-', n % 40, '","model":"c-', et, '"', CASE WHEN k % 4 = 0 THEN ',"stop_reason":null' ELSE '' END,
      ',"usage":{{"input_tokens":', k, ',"output_tokens":', k % 7, ',"cache_read_tokens":"3","cache_creation_tokens":1.5}}}}}}') AS line FROM {e}""", e=_events(spark, d))


def q_claude_dedup(spark: SparkSession, d: str) -> DataFrame:
    return sessions.claude_records(claude_lines(spark, d), NOW).select(*RECORD)


def q_gemini(spark: SparkSession, d: str) -> DataFrame:
    files = spark.sql("""SELECT concat('/t/', u, '.json') AS path, concat('{{"sessionId":"g', u, '","messages":[', array_join(transform(array_sort(collect_list(struct(n, line))), x -> x.line), ','), ']}}') AS content
      FROM (SELECT u, n, concat('{{"type":"', CASE WHEN k % 6 = 0 THEN 'user' ELSE 'gemini' END, '"', CASE WHEN n % 2 = 0 THEN concat(',"id":"i', n, '"') ELSE '' END,
      ',"model":"g-', et, '","timestamp":', t, ',"tokens":{{"input":', k, ',"output":', k % 5, ',"thoughts":', k % 3, ',"cached":', k % 2, '}}}}') AS line FROM {e}) GROUP BY u""", e=_events(spark, d))
    return sessions.gemini_records(files, NOW).select(*RECORD)


def q_opencode(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql("""SELECT '/o.db' AS path, concat('i', n) AS id, concat('s', u) AS session_id, concat('{{"role":"', CASE WHEN k % 9 = 0 THEN 'user' ELSE 'assistant' END, '","modelID":"o-', et,
      '","time":{{"created":', t, '000', CASE WHEN k % 8 <> 0 THEN ',"completed":1' ELSE '' END, '}},"tokens":{{"input":', k, ',"output":', k % 5, ',"reasoning":', k % 3,
      ',"cache":{{"read":', k % 2, ',"write":', k % 4, '}}}},"cost":', k, '.25}}') AS data FROM {e}""", e=_events(spark, d))
    return sessions.opencode_records(rows, NOW).select(*RECORD)


def q_grok_explode(spark: SparkSession, d: str) -> DataFrame:
    """Turns of one or two models; those of the last minute wait."""
    lines = spark.sql("""SELECT concat('/g/sess', u, '/updates.jsonl') AS path, CAST(n AS INT) AS line_no, concat('{{"method":"_x.ai/session/update","timestamp":', t,
      ',"params":{{"update":{{', CASE WHEN k % 3 = 0 THEN '"sessionUpdate":"turn_completed",' WHEN k % 3 = 1 THEN '' ELSE '"sessionUpdate":"other",' END, '"prompt_id":"p', n, '","usage":{{"modelUsage":{{"a-', et,
      '":{{"inputTokens":', k + 1, ',"outputTokens":', k % 5, ',"cachedReadTokens":', k % 3, ',"apiDurationMs":', k * 10, ',"costUsdTicks":', k * 12345678901, '}}',
      CASE WHEN n % 2 = 0 THEN concat(',"b":{{"inputTokens":', k, ',"outputTokens":0}}') ELSE '' END, '}}}}}}}}}}') AS line FROM {e}""", e=_events(spark, d))
    return sessions.grok_records(lines, BEGIN + 20 * 86400)[0].select(*RECORD)


def q_stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The events uploaded by a stream into a store, in three runs over parts that overlap."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = conform(usage_events(spark, d), USAGE_EVENTS).withColumn("n", F.regexp_extract("request_id", "[0-9]+", 0).cast("long"))
    for condition in ("n % 3 <> 0", "n % 2 = 0", "n % 4 <> 1"):
        rows.filter(condition).drop("n").write.mode("append").parquet(f"{base}/ledger")
        upload.upload_stream(spark, f"{base}/ledger", USAGE_EVENTS, f"{base}/store", f"{base}/checkpoint", NOW, once=True).awaitTermination()
    return upload.stored(spark, f"{base}/store").select("event_id", "node_id", "created_at", "input_tokens", "received_at")


def q_ingest_batches(spark: SparkSession, d: str) -> DataFrame:
    """Batches by user: some of another version, some with a foreign node's event; within and across batches, ids and requests recur."""
    rows = usage_events(spark, d).withColumn("n", F.regexp_extract("request_id", "[0-9]+", 0).cast("long"))
    store = rows.filter("n % 5 = 0")
    rows = rows.withColumns({"batch_id": F.floor(F.col("n") / 50).cast("long"), "seq": F.col("n")})
    again = rows.filter("n % 3 = 0").withColumns({"batch_id": F.col("batch_id") + 1_000_000, "seq": F.col("n") + 1})
    other = rows.filter("n % 7 = 0").withColumns({"batch_id": F.col("batch_id") + 2_000_000, "event_id": F.concat("event_id", F.lit("x"))})
    new = rows.filter("n % 11 = 0").withColumns({"batch_id": F.col("batch_id") + 3_000_000, "request_id": F.concat("request_id", F.lit("y")), "event_id": F.concat("event_id", F.lit("x"))})
    batches = rows.union(again).union(other).union(new)
    batches = batches.withColumns({"batch_node_id": F.when(F.col("batch_id") % 13 == 0, F.lit("node-x")).otherwise(F.col("node_id")), "schema_version": F.when(F.col("batch_id") % 17 == 0, 2).otherwise(1)})
    return ingest.ingest_batch(store, batches, NOW)[1].groupBy("disposition").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("seq") % 1009).alias("seqs"))


def q_mirror(spark: SparkSession, d: str) -> DataFrame:
    """A foreign log merged into a ledger that has some of its requests with other token counts."""
    rows = _ledger_rows(usage_events(spark, d)).withColumn("n", F.regexp_extract("request_id", "[0-9]+", 0).cast("long"))
    known = rows.filter("n % 4 = 0").withColumns({"output_tokens": F.lit(1).cast("long"), "cost_input": F.lit(2.0)}).select(ledger.COLUMNS)
    return ledger.mirror_source(known, usage_events(spark, d))[0].select("request_id", "session_id", "output_tokens", "cost_input", "data_source")


def q_provider_scan(spark: SparkSession, d: str) -> DataFrame:
    names = provider_catalog(spark, d).select("app_type", F.col("provider_id").alias("id"), "name").distinct()
    blank = names.withColumns({"id": F.concat("id", F.lit("-b")), "name": F.lit("  ")})
    return tables.provider_snapshot(spark, names.union(blank))


def q_changed_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of users against the state of an earlier run, and the state after this one; deferred ones are not recorded."""
    users = _events(spark, d).groupBy("u").agg(F.max("n").alias("n"))
    found = users.select(F.concat(F.lit("/f/"), "u").alias("path"), (F.col("n") * 1000).alias("modified_ns"), "u", "n")
    state = found.filter("u % 3 <> 0").select(F.col("path").alias("file_path"), (F.col("modified_ns") - F.col("u") % 2).alias("last_modified"), F.lit(5).cast("long").alias("last_synced_at"))
    changed = files.changed_since(found, state)
    return files.new_state(state, changed, changed.filter("u % 5 = 0").select("path"), NOW)


def q_price_feed(spark: SparkSession, d: str) -> DataFrame:
    """A feed of one provider for each nation, with prices that are missing, negative or infinite."""
    feed = spark.sql("""SELECT concat('{{', array_join(array_sort(collect_list(concat('"', n_name, '":{{"models":{{"M', n_nationkey % 7, ':free":{{"cost":{{"input":', n_nationkey,
      ',"output":', CASE WHEN n_nationkey % 2 = 0 THEN '-1' ELSE '1e400' END, '}}}},"x-', n_nationkey, '":{{"cost":{{"output":0.5,"cache_write":2}}}},"none-', n_nationkey, '":{{"cost":{{"cache_read":1}}}}}}}}'))), ','), '}}') AS value
      FROM {n}""", n=spark.read.parquet(f"{d}/nation.parquet"))
    return pricing.flatten_prices(feed)


def q_null_defaults(spark: SparkSession, d: str) -> DataFrame:
    n = F.regexp_extract("request_id", "[0-9]+", 0).cast("long")
    rows = usage_events(spark, d).withColumns({
        "request_model": F.when(n % 3 != 0, F.col("request_model")), "pricing_model": F.when(n % 2 == 0, F.col("model")), "data_source": F.when(n % 5 != 0, F.col("data_source")),
        "input_token_semantics": F.when(n % 7 != 0, F.col("input_token_semantics")),
    })
    return with_event_defaults(rows).groupBy("request_model", "pricing_model", "data_source", "input_token_semantics").agg(F.count(F.lit(1)).alias("n"))


def q_plain_number(spark: SparkSession, d: str) -> DataFrame:
    """Doubles of many sizes as text, compared as text."""
    k = F.col("l_linenumber")
    x = F.col("l_extendedprice").cast("double") * F.when(k == 1, 1e-9).when(k == 2, 1e-3).when(k == 3, 1.0).when(k == 4, 1e4).when(k == 5, -1e-12).otherwise(1e16)
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", x.alias("x"))
    text = U.plain_number(F.col("x"))
    back = text.cast("double") == F.col("x")
    return rows.select("l_orderkey", "l_linenumber", back.alias("same"), text.contains("E").alias("exponent"), F.length(F.regexp_extract(text, r"^-?([0-9]+)", 1)).cast("long").alias("whole_digits"))


def _odd_metas(spark: SparkSession, d: str) -> DataFrame:
    """Of some files the first session_meta names another thread; only a later one fits."""
    lines = codex_lines(spark, d)
    odd = (F.col("line_no") == 0) & F.col("path").rlike("[13]\\.jsonl$")
    wrong = lines.filter(odd).withColumn("line", F.regexp_replace("line", r'"id":"0{8}', '"id":"00000001'))
    later = lines.filter(odd).withColumn("line_no", F.lit(2))
    return lines.filter(~odd).union(wrong).union(later)


def q_codex_meta(spark: SparkSession, d: str) -> DataFrame:
    return sessions.codex_records(_odd_metas(spark, d), NOW).groupBy("session_id").agg(F.count(F.lit(1)).alias("n"))


def q_codex_counts(spark: SparkSession, d: str) -> DataFrame:
    return sessions.codex_import(_odd_metas(spark, d), NOW)[1]


QUERIES = {
    f.__name__: f
    for f in (
        q_cursor_scan, q_ingest_disposition, q_late_overlap, q_rollup_upsert, q_catalog_upsert, q_pricing_candidates, q_price_match, q_cost, q_ledger_upsert, q_ledger_counts,
        q_lenient_cost, q_model_normalize, q_codex_delta, q_codex_replay, q_claude_dedup, q_gemini, q_opencode, q_grok_explode, q_stream_dedup,
        q_ingest_batches, q_mirror, q_provider_scan, q_changed_files, q_price_feed, q_null_defaults, q_plain_number, q_codex_meta, q_codex_counts,
    )
}

# ---- the same in DuckDB

N = "CAST(regexp_extract(request_id, '[0-9]+') AS BIGINT)"
E_SQL = "WITH ev AS (SELECT event_id AS n, user_id AS u, epoch_us(ts)//1000000 AS t, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k, event_type AS et FROM events)"
NONE = "CAST(NULL AS VARCHAR) AS reported_total_cost_usd"


def _usage(body: str) -> str:
    return f"WITH {DUCKDB} {body}"


CODEX_SQL = f"""{E_SQL}, r AS (SELECT *, row_number() OVER w AS i, sum(k) OVER w AS total FROM ev WINDOW w AS (PARTITION BY u ORDER BY n)),
 x AS (SELECT *, total - coalesce(lag(total) OVER w, 0) AS di, total // 2 - coalesce(lag(total // 2) OVER w, 0) AS dc, i - coalesce(lag(i) OVER w, 0) AS d_o,
 last_value(CASE WHEN i % 10 = 1 THEN 'm-' || et END IGNORE NULLS) OVER (PARTITION BY u ORDER BY n) AS model FROM r WINDOW w AS (PARTITION BY u ORDER BY n))
 SELECT 'codex_session:thread-v1:00000000-0000-0000-0000-' || lpad(CAST(u AS VARCHAR), 12, '0') || ':' || CAST(i AS VARCHAR) AS request_id,
 '00000000-0000-0000-0000-' || lpad(CAST(u AS VARCHAR), 12, '0') AS session_id, t AS created_at, 'codex' AS app_type, model,
 CAST(di AS BIGINT) AS input_tokens, CAST(d_o AS BIGINT) AS output_tokens, CAST(least(dc, di) AS BIGINT) AS cache_read_tokens, CAST(0 AS BIGINT) AS cache_creation_tokens,
 CAST(0 AS BIGINT) AS latency_ms, {NONE} FROM x WHERE di + dc + d_o <> 0"""

FORK_SQL = """ UNION ALL SELECT 'codex_session:thread-v1:00000000-0000-0000-0000-9999' || right(lpad(CAST(u AS VARCHAR), 12, '0'), 8) || ':' || CAST(i AS VARCHAR),
 '00000000-0000-0000-0000-9999' || right(lpad(CAST(u AS VARCHAR), 12, '0'), 8), t, 'codex', model, CAST(di AS BIGINT), CAST(CASE WHEN i = 11 THEN 701 ELSE 1 END AS BIGINT), CAST(least(dc, di) AS BIGINT), 0, 0, NULL
 FROM x WHERE u % 2 = 0 AND i BETWEEN 11 AND 19"""

ROLLUP_DAY = "strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d')"


def _rollup_sql(where: str) -> str:
    return ROLLUP_SQL.format(day=ROLLUP_DAY, rows=f"(SELECT * FROM usage_events WHERE {where})").replace("STRING", "VARCHAR")


MEASURES = ["request_count", "success_count", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "total_cost_usd", "avg_latency_ms"]
PRICES_SQL = "prices(price_key, input, output, cache_read, cache_creation) AS (VALUES " + ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for k, a, b, c, e in PRICE_LIST) + ")"
PREFIX_SQL = " ".join(
    f"UNION ALL SELECT model, {i + 2}, CASE WHEN starts_with(base, '{p}') THEN substr(base, {len(p) + 1}) END FROM b" for i, p in enumerate(pricing.VENDOR_PREFIXES)
)


def lower_sql(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def trim_sql(text: str) -> str:
    return f"trim({text}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def candidates_sql(models: str) -> str:
    """CTEs up to c(model, pos, candidate), from a CTE or table that has a column model."""
    base = lower_sql(f"replace({trim_sql("split_part(regexp_replace(model, '^.*/', '', 's'), ':', 1)")}, '@', '-')")
    return f"""b AS (SELECT DISTINCT model, {base} AS base FROM {models}),
 a AS (SELECT model, 0 AS o, base AS candidate FROM b
 UNION ALL SELECT model, 1, CASE WHEN regexp_matches(base, '^.+claude-') THEN 'claude-' || list_last(string_split(base, 'claude-')) END FROM b {PREFIX_SQL}
 UNION ALL SELECT model, 7, CASE WHEN regexp_matches(base, '-[0-9]{{8}}$') THEN regexp_replace(base, '-[0-9]{{8}}$', '') END FROM b
 UNION ALL SELECT model, 8, CASE WHEN ends_with(base, '-thinking') THEN left(base, length(base) - 9) END FROM b),
 c AS (SELECT model, CAST(row_number() OVER (PARTITION BY model ORDER BY o) - 1 AS INTEGER) AS pos, candidate
 FROM (SELECT model, candidate, min(o) AS o FROM a WHERE candidate <> '' GROUP BY model, candidate)), {PRICES_SQL},
 h AS (SELECT model, p.*, row_number() OVER (PARTITION BY model ORDER BY pos, p.price_key <> candidate, p.price_key) AS turn
 FROM c JOIN prices p ON p.price_key = candidate OR starts_with(p.price_key, candidate || '-'))"""


#: For each request of the ledger or the run: the owner, the values that its records told in order, and how many records were sent.
LEDGER_SQL = f""", r AS (SELECT *, {N} AS n FROM usage_events),
 told AS (SELECT request_id, 'a' AS path, output_tokens + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS value, CASE WHEN n % 4 = 0 THEN 'other' ELSE data_source END AS source FROM r WHERE n % 2 = 0
 UNION ALL SELECT request_id, 'b', output_tokens + 9, data_source FROM r WHERE n % 6 = 0 UNION ALL SELECT request_id, 'c', output_tokens + 9, data_source FROM r WHERE n % 18 = 0
 UNION ALL SELECT request_id, 'd', output_tokens + 4, data_source FROM r WHERE n % 10 = 0),
 lists AS (SELECT request_id, list(struct_pack(s := source, v := value) ORDER BY path) AS all_told FROM told GROUP BY request_id),
 y AS (SELECT r.*, n % 3 <> 0 AS known, coalesce(all_told, []) AS all_told FROM r LEFT JOIN lists USING (request_id)),
 x AS (SELECT *, CASE WHEN known THEN data_source ELSE all_told[1].s END AS owner, len(all_told) AS sent FROM y),
 z AS (SELECT *, [t.v FOR t IN all_told IF t.s = owner] AS own FROM x)"""


ORACLES = {
    "q_cursor_scan": _usage(f"""SELECT created_at, request_id, node_id, model, CAST(0 AS BIGINT) AS input_token_semantics FROM usage_events
 WHERE created_at > {BEGIN + 10 * 86400} OR (created_at = {BEGIN + 10 * 86400} AND request_id > 'req-5') ORDER BY created_at, request_id LIMIT 512"""),
    "q_ingest_disposition": _usage(f""", r AS (SELECT event_id, {N} AS n FROM usage_events)
 SELECT event_id, n AS seq, CASE WHEN n % 3 <> 0 THEN 'duplicate' ELSE 'accepted' END AS disposition FROM r WHERE n % 2 = 0
 UNION ALL SELECT event_id, n + 10000000, 'duplicate' FROM r WHERE n % 12 = 0"""),
    "q_late_overlap": _usage(f"""SELECT CASE WHEN {N} % 7 <> 0 THEN 'duplicate' ELSE 'accepted' END AS disposition, count(*) AS n FROM usage_events
 WHERE created_at BETWEEN {BEGIN + 14 * 86400} AND {BEGIN + 15 * 86400} GROUP BY 1"""),
    "q_rollup_upsert": _usage(f""", o AS ({_rollup_sql('latency_ms % 3 <> 0')}), w AS ({_rollup_sql('latency_ms % 2 = 0')})
 SELECT concat_ws('|', {', '.join(ROLLUP_DIMENSIONS)}) AS snapshot_key, {', '.join(ROLLUP_DIMENSIONS)}, {', '.join(f'coalesce(w.{m}, o.{m}) AS {m}' for m in MEASURES)},
 CAST(CASE WHEN w.request_count IS NOT NULL THEN {NOW} ELSE {BEGIN} END AS BIGINT) AS received_at FROM o FULL JOIN w USING ({', '.join(ROLLUP_DIMENSIONS)})"""),
    "q_catalog_upsert": _usage(f"""SELECT node_id, app_type, provider_id, name || CASE WHEN app_type = 'codex' THEN ' 2' || CASE WHEN node_id = 'node-2' THEN 'b' ELSE '' END ELSE '' END AS name,
 CAST(CASE WHEN app_type = 'codex' THEN {NOW} ELSE {BEGIN} END AS BIGINT) AS updated_at FROM provider_catalog
 UNION ALL SELECT 'node-9', app_type, provider_id, name, {NOW} FROM provider_catalog WHERE node_id = 'node-1'"""),
    "q_pricing_candidates": f"WITH m AS (SELECT t AS model FROM ({texts_sql(MODELS)})), {candidates_sql('m')} SELECT model, pos, candidate FROM c",
    "q_price_match": f"WITH m AS (SELECT t AS model FROM ({texts_sql(MODELS)})), {candidates_sql('m')} SELECT model, input, output, cache_read, cache_creation FROM h WHERE turn = 1",
    "q_cost": _usage(f""", r AS (SELECT * REPLACE (CASE WHEN {N} % 7 = 0 THEN 'none' ELSE model END AS model), CASE WHEN {N} % 11 = 0 THEN total_cost_usd END AS reported FROM usage_events),
 k AS (SELECT *, CASE WHEN lower(trim(model)) NOT IN ('', 'unknown', 'null', 'none') THEN model ELSE request_model END AS priced_as,
 input_tokens - CASE WHEN app_type IN ('codex','gemini','grokbuild') THEN cache_read_tokens + cache_creation_tokens ELSE 0 END AS fresh FROM r),
 m AS (SELECT priced_as AS model FROM k), {candidates_sql('m')},
 z AS (SELECT event_id, priced_as, reported, coalesce(fresh * p.input / 1e6, 0.0) AS ci, coalesce(output_tokens * p.output / 1e6, 0.0) AS co,
 coalesce(cache_read_tokens * p.cache_read / 1e6, 0.0) AS cr, coalesce(cache_creation_tokens * p.cache_creation / 1e6, 0.0) AS cc
 FROM k LEFT JOIN (SELECT * FROM h WHERE turn = 1) p ON p.model = priced_as)
 SELECT event_id, priced_as, round(ci, 8) AS cost_input, round(co, 8) AS cost_output, round(cr, 8) AS cost_cache_read, round(cc, 8) AS cost_cache_creation,
 round(CASE WHEN TRY_CAST(reported AS DOUBLE) > 0 THEN TRY_CAST(reported AS DOUBLE) ELSE ci + co + cr + cc END, 9) AS total FROM z"""),
    "q_ledger_upsert": _usage(LEDGER_SQL + """ SELECT request_id, CAST(CASE WHEN known THEN created_at ELSE created_at + 5 END AS BIGINT) AS created_at, owner AS data_source,
 data_source AS provider_type, CAST(coalesce(list_last(own), output_tokens) AS BIGINT) AS output_tokens FROM z WHERE known OR len(own) > 0"""),
    "q_ledger_counts": _usage(LEDGER_SQL + """, c AS (SELECT CASE WHEN len(own) = 0 THEN 0 ELSE CASE WHEN known THEN CASE WHEN own[1] <> output_tokens THEN 1 ELSE 0 END ELSE 1 END
 + len(list_filter(range(2, len(own) + 1), lambda i: own[i] <> own[i - 1])) END AS imported, sent FROM z)
 SELECT CAST(sum(imported) AS BIGINT) AS imported, CAST(sum(sent - imported) AS BIGINT) AS skipped FROM c"""),
    "q_lenient_cost": f"""SELECT t, coalesce(TRY_CAST(nullif(regexp_extract(t, '^\\s*([+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?)', 1), '') AS DOUBLE), 0.0) AS value FROM ({texts_sql(LENIENT)})""",
    "q_model_normalize": f"""SELECT t, regexp_replace(regexp_replace(regexp_replace({lower_sql('t')}, '^.*/', '', 's'), '-[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$', ''), '-[0-9]{{8}}$', '') AS model,
 {lower_sql(trim_sql('t'))} IN ('', 'unknown', 'null', 'none') AS placeholder FROM ({texts_sql(NAMES)})""",
    "q_codex_delta": CODEX_SQL,
    "q_codex_replay": CODEX_SQL + FORK_SQL,
    "q_codex_meta": CODEX_SQL.split(" SELECT 'codex_session")[0] + """ SELECT '00000000-0000-0000-0000-' || lpad(CAST(u AS VARCHAR), 12, '0') AS session_id, count(*) AS n
 FROM x WHERE di + dc + d_o <> 0 AND u % 10 NOT IN (1, 3) GROUP BY u""",
    "q_codex_counts": f"{E_SQL} SELECT count(DISTINCT u) AS files_scanned, count(DISTINCT CASE WHEN u % 10 IN (1, 3) THEN u END) AS skipped FROM ev",
    "q_ingest_batches": _usage(f""", r AS (SELECT event_id, node_id, request_id, {N} AS n FROM usage_events),
 b AS (SELECT *, n // 50 AS batch_id, n AS seq FROM r UNION ALL SELECT *, n // 50 + 1000000, n + 1 FROM r WHERE n % 3 = 0
 UNION ALL SELECT event_id || 'x', node_id, request_id, n, n // 50 + 2000000, n FROM r WHERE n % 7 = 0 UNION ALL SELECT event_id || 'x', node_id, request_id || 'y', n, n // 50 + 3000000, n FROM r WHERE n % 11 = 0),
 k AS (SELECT *, batch_id % 13 = 0 OR batch_id % 17 = 0 AS bad, (n // 50) % 13 = 0 OR (n // 50) % 17 = 0 AS bad_0, (n // 50 + 1000000) % 13 = 0 OR (n // 50 + 1000000) % 17 = 0 AS bad_1,
 (n // 50 + 2000000) % 13 = 0 OR (n // 50 + 2000000) % 17 = 0 AS bad_2 FROM b),
 d AS (SELECT seq, CASE WHEN bad THEN 'rejected' WHEN batch_id < 1000000 THEN CASE WHEN n % 5 = 0 THEN 'duplicate' ELSE 'accepted' END
 WHEN batch_id < 2000000 THEN CASE WHEN n % 5 = 0 OR NOT bad_0 THEN 'duplicate' ELSE 'accepted' END
 WHEN batch_id < 3000000 THEN CASE WHEN n % 5 = 0 OR NOT bad_0 OR (n % 3 = 0 AND NOT bad_1) THEN 'duplicate' ELSE 'accepted' END
 ELSE CASE WHEN n % 7 = 0 AND NOT bad_2 AND NOT (n % 5 = 0 OR NOT bad_0 OR (n % 3 = 0 AND NOT bad_1)) THEN 'duplicate' ELSE 'accepted' END END AS disposition FROM k)
 SELECT disposition, count(*) AS n, CAST(sum(seq % 1009) AS BIGINT) AS seqs FROM d GROUP BY disposition"""),
    "q_mirror": _usage("""SELECT request_id, CAST(NULL AS VARCHAR) AS session_id, output_tokens, CASE WHEN """ + N + """ % 4 = 0 AND output_tokens = 1 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS cost_input, data_source FROM usage_events"""),
    "q_provider_scan": _usage("SELECT DISTINCT app_type, provider_id, name FROM provider_catalog WHERE trim(name) <> ''"),
    "q_changed_files": f"""{E_SQL}, f AS (SELECT u, '/f/' || CAST(u AS VARCHAR) AS file_path, max(n) * 1000 AS m FROM ev GROUP BY u)
 SELECT file_path, CASE WHEN (u % 3 = 0 OR u % 2 = 1) AND u % 5 <> 0 THEN m ELSE m - u % 2 END AS last_modified,
 CAST(CASE WHEN (u % 3 = 0 OR u % 2 = 1) AND u % 5 <> 0 THEN {NOW} ELSE 5 END AS BIGINT) AS last_synced_at FROM f WHERE NOT (u % 3 = 0 AND u % 5 = 0)""",
    "q_price_feed": """SELECT 'm' || CAST(n_nationkey % 7 AS VARCHAR) AS price_key, CAST(arg_min(n_nationkey, n_name) AS DOUBLE) AS input, 0.0::DOUBLE AS output, 0.0::DOUBLE AS cache_read, 0.0::DOUBLE AS cache_creation
 FROM nation GROUP BY n_nationkey % 7 UNION ALL SELECT 'x-' || CAST(n_nationkey AS VARCHAR), 0.0, 0.5, 0.0, 2.0 FROM nation""",
    "q_null_defaults": _usage(f""", r AS (SELECT *, {N} AS k FROM usage_events) SELECT CASE WHEN k % 3 <> 0 THEN request_model ELSE '' END AS request_model, CASE WHEN k % 2 = 0 THEN model ELSE '' END AS pricing_model,
 CASE WHEN k % 5 <> 0 THEN data_source ELSE '' END AS data_source, CASE WHEN k % 7 <> 0 THEN input_token_semantics ELSE 0 END AS input_token_semantics, count(*) AS n FROM r GROUP BY 1, 2, 3, 4"""),
    "q_plain_number": """WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DOUBLE) * CASE l_linenumber WHEN 1 THEN 1e-9 WHEN 2 THEN 1e-3 WHEN 3 THEN 1.0 WHEN 4 THEN 1e4 WHEN 5 THEN -1e-12 ELSE 1e16 END AS x FROM lineitem)
 SELECT l_orderkey, l_linenumber, true AS same, false AS exponent, CAST(CASE WHEN abs(x) < 1 THEN 1 ELSE floor(log10(abs(x))) + 1 END AS BIGINT) AS whole_digits FROM r""",
    "q_claude_dedup": f"""{E_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY u, n % 40 ORDER BY CASE WHEN k % 4 = 0 THEN 0 ELSE 1 END, k % 7 DESC, n) AS turn FROM ev WHERE k % 13 <> 0)
 SELECT 'session:m' || CAST(u AS VARCHAR) || '-' || CAST(n % 40 AS VARCHAR) AS request_id, 's' || CAST(u AS VARCHAR) AS session_id, t AS created_at, 'claude' AS app_type, 'c-' || et AS model, k AS input_tokens, k % 7 AS output_tokens,
 CAST(0 AS BIGINT) AS cache_read_tokens, CAST(0 AS BIGINT) AS cache_creation_tokens, CAST(0 AS BIGINT) AS latency_ms, {NONE} FROM x WHERE turn = 1 AND k + k % 7 > 0""",
    "q_gemini": f"""{E_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n) - 1 AS place FROM ev)
 SELECT 'gemini_session:g' || CAST(u AS VARCHAR) || ':' || CASE WHEN n % 2 = 0 THEN 'i' || CAST(n AS VARCHAR) ELSE 'idx' || CAST(place AS VARCHAR) END AS request_id, 'g' || CAST(u AS VARCHAR) AS session_id, t AS created_at,
 'gemini' AS app_type, 'g-' || et AS model, k AS input_tokens, k % 5 + k % 3 AS output_tokens, k % 2 AS cache_read_tokens, CAST(0 AS BIGINT) AS cache_creation_tokens,
 CAST(0 AS BIGINT) AS latency_ms, {NONE} FROM x WHERE k % 6 <> 0 AND k + k % 5 + k % 3 + k % 2 <> 0""",
    "q_opencode": f"""{E_SQL} SELECT 'opencode_session:s' || CAST(u AS VARCHAR) || ':i' || CAST(n AS VARCHAR) AS request_id, 's' || CAST(u AS VARCHAR) AS session_id, t AS created_at, 'opencode' AS app_type, 'o-' || et AS model,
 k AS input_tokens, k % 5 + k % 3 AS output_tokens, k % 2 AS cache_read_tokens, k % 4 AS cache_creation_tokens, CAST(0 AS BIGINT) AS latency_ms,
 CAST(k AS VARCHAR) || '.25' AS reported_total_cost_usd FROM ev WHERE k % 9 <> 0 AND k % 8 <> 0 AND k + k % 5 + k % 3 + k % 2 + k % 4 <> 0""",
    "q_grok_explode": f"""{E_SQL}, x AS (SELECT * FROM ev WHERE k % 3 <> 2 AND t <= {BEGIN + 20 * 86400 - 60})
 SELECT 'grok_session:sess' || CAST(u AS VARCHAR) || ':p' || CAST(n AS VARCHAR) || ':a-' || et AS request_id, 'sess' || CAST(u AS VARCHAR) AS session_id, t AS created_at, 'grokbuild' AS app_type, 'a-' || et AS model,
 k + 1 AS input_tokens, k % 5 AS output_tokens, k % 3 AS cache_read_tokens, CAST(0 AS BIGINT) AS cache_creation_tokens, k * 10 AS latency_ms,
 CASE WHEN k > 0 THEN CAST(k * 12345678901 // 10000000000 AS VARCHAR) || '.' || lpad(CAST(k * 12345678901 % 10000000000 AS VARCHAR), 10, '0') END AS reported_total_cost_usd FROM x
 UNION ALL SELECT 'grok_session:sess' || CAST(u AS VARCHAR) || ':p' || CAST(n AS VARCHAR) || ':b', 'sess' || CAST(u AS VARCHAR), t, 'grokbuild', 'b', k, 0, 0, 0, 0, NULL FROM x WHERE n % 2 = 0 AND k <> 0""",
    "q_stream_dedup": _usage(f"""SELECT event_id, node_id, created_at, input_tokens, CAST({NOW} AS BIGINT) AS received_at FROM usage_events
 WHERE {N} % 3 <> 0 OR {N} % 2 = 0 OR {N} % 4 <> 1"""),
}
