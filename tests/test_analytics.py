import pytest
from pyspark.sql import functions as F

from quillmeter.functions import usage as U
from quillmeter.operators import analytics as A
from quillmeter.plans.params import resolve_query
from quillmeter.schema import USAGE_EVENTS, conform, with_event_date

COLUMNS = "app_type, input_tokens, output_tokens, cache_read_tokens, cache_creation_tokens, input_token_semantics, status_code, created_at"


def events(spark, rows, **fixed):
    fixed = {"node_id": "node-a", "provider_id": "provider-a", "model": "model-a", "total_cost_usd": "0.25", "data_source": "proxy"} | fixed
    names = COLUMNS.split(", ")
    df = spark.createDataFrame(rows, "app_type string, " + ", ".join(f"{n} long" for n in names[1:]))
    df = df.withColumn("request_id", F.concat(F.lit("r"), F.monotonically_increasing_id()))
    df = df.withColumns({k: F.lit(v) for k, v in fixed.items()}).withColumns({"latency_ms": F.lit(120), "is_streaming": F.lit(False)})
    return conform(df.withColumn("event_id", U.event_id()), USAGE_EVENTS)


@pytest.fixture
def seeded(spark):
    return events(
        spark,
        [("claude", 100, 20, 40, 10, 0, 200, 101), ("codex", 1000, 100, 600, 100, 1, 200, 102), ("codex", 1000, 0, 600, 100, 0, 512, 103), ("codex", 300, 100, 600, 100, 2, 204, 104)],
    )


def test_summary_of_the_four_semantics(spark, seeded):
    row = A.summary(seeded, resolve_query(0, 100, 110)).first()
    assert (row.total_requests, row.success_requests, row.success_rate) == (4, 3, 75.0)
    assert (row.input_tokens, row.real_total_tokens, row.first_at, row.last_at) == (1100, 3470, 101, 104)
    assert row.cache_hit_rate == 1840 / 3250 and row.total_cost_usd == 1.0
    point = A.trend(seeded, resolve_query(0, 100, 110, "1m")).filter("total_requests > 0").first()
    assert (point.cache_creation_tokens, point.cache_read_tokens, point.input_tokens, point.output_tokens) == (310, 1840, 3250, 220)


def test_summary_of_nothing(spark, seeded):
    row = A.summary(seeded.limit(0), resolve_query(0, 0, 10)).first()
    assert row.total_requests == 0 and row.success_rate == 0.0 and row.first_at is None and row.avg_latency_ms == 0.0


def test_trend_fills_empty_seconds(spark, seeded):
    rows = A.trend(seeded.limit(0), resolve_query(0, 100, 160)).collect()
    assert [r.bucket_start for r in rows] == list(range(100, 160)) and all(r.total_requests == 0 for r in rows)


def test_sums_over_the_trend_are_the_summary(spark, seeded):
    q = resolve_query(0, -1000, 1000, "7s")
    assert A.trend(seeded, q).agg(F.sum("real_total_tokens")).first()[0] == A.summary(seeded, q).first().real_total_tokens


def test_buckets_truncate_towards_zero(spark):
    df = spark.createDataFrame([(-61,), (-59,), (59,)], "created_at long")
    assert [r[0] for r in df.select(U.bucket_start(60)).collect()] == [-60, 0, 0]


def test_month_starts(spark):
    df = spark.createDataFrame([(-1,), (0,), (1709251199,)], "created_at long")
    assert [r[0] for r in df.select(U.month_start()).collect()] == [-31 * 86400, 0, 1706745600]


def test_provider_names(spark, seeded):
    catalog = spark.createDataFrame([("node-a", "codex", "provider-a", "DeepSeek")], "node_id string, app_type string, provider_id string, name string")
    q = resolve_query(0, 100, 110)
    assert {(r.key, r.label, r.total_requests) for r in A.provider_breakdown(seeded, catalog, q).collect()} == {("provider-a", "DeepSeek", 3), ("provider-a", "provider-a", 1)}
    assert ("provider_id", "provider-a", "DeepSeek") in {tuple(r) for r in A.facets(seeded, catalog, q).collect()}
    assert {r.provider_name for r in A.events_page(seeded, catalog, q).collect()} == {"DeepSeek", "provider-a"}


def test_pages_within_a_second(spark):
    one = events(spark, [("codex", 1, 1, 0, 0, 0, 200, 100)]).drop("event_id")
    rows = one.crossJoin(spark.createDataFrame([("a",), ("b",), ("c",)], "event_id string"))
    catalog = spark.createDataFrame([], "node_id string, app_type string, provider_id string, name string")
    q = resolve_query(0, 0, 200)
    page = A.events_page(rows, catalog, q, 3).collect()
    assert [r.event_id for r in page] == ["c", "b", "a"]
    assert A.next_cursor(page, 2) == (100, "b")
    rest = A.events_page(rows, catalog, q, 3, (100, "b")).collect()
    assert [r.event_id for r in rest] == ["a"] and A.next_cursor(rest, 2) is None


def test_lenient_costs(spark):
    cases = {"1.5xyz": 1.5, "": 0.0, "abc": 0.0, " 1.5": 1.5, "1e-7": 1e-7, "inf": 0.0, "NaN": 0.0, "0x10": 0.0, "-3.": -3.0, ".5": 0.5, "+2e3z": 2000.0, "1e": 1.0, "1.5d": 1.5}
    df = spark.createDataFrame(list(cases.items()) + [(None, 0.0)], "t string, v double")
    assert all(r.got == r.v for r in df.select("t", "v", U.lenient_double("t").alias("got")).collect())


def test_ranges_reach_the_scan(spark, seeded, tmp_path):
    with_event_date(seeded).write.partitionBy("event_date").parquet(str(tmp_path / "e"))
    df = A.summary(spark.read.parquet(str(tmp_path / "e")), resolve_query(0, 100, 110))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "GreaterThanOrEqual(created_at,100)" in plan


def test_keys(spark):
    df = spark.createDataFrame([("n", "r", "2026-01-01", "a", "p", "m", None, None)], "node_id string, request_id string, date string, a string, p string, m string, x string, y string")
    assert df.select(U.event_id()).first()[0] == "n:r"
    assert df.select(U.rollup_key(["node_id", "date", "a", "p", "m", "x", "y"])).first()[0] == "n|2026-01-01|a|p|m||"


def test_heatmap(spark):
    days = spark.createDataFrame([(i, v) for i, v in enumerate([0, 5, 5, 9, 20, 40])], "bucket_start long, real_total_tokens long")
    assert [r.level for r in A.heatmap_levels(days).orderBy("bucket_start").collect()] == [0, 1, 1, 3, 4, 4]


def test_uuids_and_numbers(spark):
    u = "0123abcd-0000-4000-8000-0123456789ab"
    df = spark.createDataFrame([(u.upper(),), ("{" + u + "}",), ("urn:uuid:" + u,), (u.replace("-", ""),)], "t string")
    assert {r[0] for r in df.select(U.uuid_text(F.col("t"))).collect()} == {u}
    df = spark.createDataFrame([(1e-7,), (12.0,), (0.0,), (1.25,)], "x double")
    assert [r[0] for r in df.select(U.plain_number(F.col("x"))).collect()] == ["0.0000001", "12", "0", "1.25"]
