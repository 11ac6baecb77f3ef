"""Usage questions over ``usage_events`` and ``provider_catalog``: every function takes and gives DataFrames.

Filters and the range are pushed into the Parquet scan; where facts are
partitioned by ``event_date``, the range prunes partitions too.  The provider
catalogue joins after aggregation by its key, so the fact table is never
shuffled row by row.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.usage import bucket_start, fresh_input, lenient_double, month_start, percentage, provider_label, ratio, real_total, succeeded
from ..plans.params import Query, page_limit
from ..sources.shared import shared_table

PROVIDER_KEY = ["node_id", "app_type", "provider_id"]
TOP, TOP_COST = 10, 3
DIMENSIONS = {"nodes": "node_id", "apps": "app_type", "models": "model"}


def in_range(events: DataFrame, query: Query) -> DataFrame:
    rows = events.filter((F.col("created_at") >= query.begin) & (F.col("created_at") < query.end))
    if "event_date" in events.columns:
        first = date(1970, 1, 1)
        rows = rows.filter(F.col("event_date").between(first + timedelta(days=query.begin // 86400), first + timedelta(days=(query.end - 1) // 86400)))
    for column, value in query.filters.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    return rows


def measured(events: DataFrame) -> DataFrame:
    """Adds fresh, real_total, ok and cost."""
    return events.withColumns({"fresh": fresh_input(), "ok": succeeded(), "cost": lenient_double("total_cost_usd")}).withColumn("real_total", real_total(F.col("fresh")))


def _sum(column: str) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


#: What the groups of a question add up; each is a sum of the same over finer groups, apart from the first and last time.
SUMS = ["ok", "fresh", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "real_total", "cost", "latency_ms"]


def group_sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in SUMS], F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at")]


def summary(events: DataFrame, query: Query) -> DataFrame:
    """One row, also without events: requests, successes, tokens, rates, cost, mean latency, first and last time."""
    return summary_of(measured(in_range(events, query)).agg(*group_sums()))


def summary_of(sums: DataFrame) -> DataFrame:
    whole = {"total_requests": "n", "success_requests": "ok", "input_tokens": "fresh", "real_total_tokens": "real_total"} | {c: c for c in ("output_tokens", "cache_read_tokens", "cache_creation_tokens")}
    row = sums.select(
        *[F.coalesce(F.col(c), F.lit(0)).alias(name) for name, c in whole.items()],
        F.coalesce("cost", F.lit(0.0)).alias("total_cost_usd"), ratio(F.coalesce("latency_ms", F.lit(0)), F.coalesce("n", F.lit(0))).alias("avg_latency_ms"), "first_at", "last_at",
    )
    cacheable = F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    return row.withColumns({"success_rate": percentage(F.col("success_requests"), F.col("total_requests")), "cache_hit_rate": ratio(F.col("cache_read_tokens"), cacheable)})


def usage_summary(events: DataFrame, begin: int | None = None, end: int | None = None, node_id: str | None = None, model: str | None = None) -> DataFrame:
    """Raw token sums over a closed range."""
    rows = events
    for condition in (
        None if begin is None else F.col("created_at") >= begin,
        None if end is None else F.col("created_at") <= end,
        None if node_id is None else F.col("node_id") == F.lit(node_id),
        None if model is None else F.col("model") == F.lit(model),
    ):
        rows = rows if condition is None else rows.filter(condition)
    return rows.withColumn("cost", lenient_double("total_cost_usd")).agg(
        F.count(F.lit(1)).alias("requests"),
        _sum("input_tokens").alias("input_tokens"),
        _sum("output_tokens").alias("output_tokens"),
        _sum("cache_read_tokens").alias("cache_read_tokens"),
        _sum("cache_creation_tokens").alias("cache_creation_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("total_cost_usd"),
    )


def _spine(events: DataFrame, query: Query) -> DataFrame:
    """Every bucket from the one of ``begin`` to the one of ``end - 1``: at most 20,000 rows by the query's own check."""
    ends = events.sparkSession.range(1).select(F.lit(query.begin).cast("long").alias("a"), F.lit(query.end - 1).cast("long").alias("b"))
    if query.bucket.seconds is None:
        epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
        months = f"sequence(date_trunc('MONTH', timestampadd(SECOND, a, {epoch})), date_trunc('MONTH', timestampadd(SECOND, b, {epoch})), interval 1 month)"
        return ends.select(F.explode(F.expr(months)).alias("m")).select(F.expr(f"timestampdiff(SECOND, {epoch}, m)").alias("bucket_start"))
    s, o = query.bucket.seconds, query.offset
    return ends.select(F.explode(F.expr(f"sequence(((a + {o}) div {s}) * {s} - {o}, ((b + {o}) div {s}) * {s} - {o}, {s}L)")).alias("bucket_start"))


def bucket_of(query: Query) -> Column:
    return month_start() if query.bucket.seconds is None else bucket_start(query.bucket.seconds, query.offset)


def trend(events: DataFrame, query: Query) -> DataFrame:
    """One row a bucket, empty buckets included, in order."""
    return trend_of(measured(in_range(events, query)).groupBy(bucket_of(query).alias("bucket_start")).agg(*group_sums()), query)


def trend_of(found: DataFrame, query: Query) -> DataFrame:
    sums = ["ok", "fresh", "cache_creation_tokens", "cache_read_tokens", "output_tokens", "cost", "latency_ms"]
    rows = _spine(found, query).join(found.select("bucket_start", "n", *sums), "bucket_start", "left")
    value = {c: F.coalesce(F.col(c), F.lit(0.0 if c == "cost" else 0)) for c in ["n", *sums]}
    used = value["fresh"] + value["cache_creation_tokens"] + value["cache_read_tokens"]
    return rows.select(
        "bucket_start",
        value["n"].alias("total_requests"),
        value["ok"].alias("success_requests"),
        percentage(value["ok"], value["n"]).alias("success_rate"),
        used.alias("input_tokens"),
        value["output_tokens"].alias("output_tokens"),
        value["cache_creation_tokens"].alias("cache_creation_tokens"),
        value["cache_read_tokens"].alias("cache_read_tokens"),
        (used + value["output_tokens"]).alias("real_total_tokens"),
        value["cost"].alias("total_cost_usd"),
        ratio(value["latency_ms"], value["n"]).alias("avg_latency_ms"),
    ).orderBy("bucket_start")


def daily(events: DataFrame, query: Query) -> DataFrame:
    """``trend`` of a query of ``resolve_daily``: one row a local day."""
    return trend(events, query)


def heatmap_levels(days: DataFrame, metric: str = "real_total_tokens") -> DataFrame:
    """Adds level: 0 without activity, 4 for the largest day, else the quartile of its rank among active days.

    Days are bounded by the query's range (720 at most), so one window over them is small.
    """
    v, active = F.col(metric), F.col(metric) > 0
    over = Window.partitionBy(active)
    level = F.ceil(F.rank().over(over.orderBy(v)) / F.count(F.lit(1)).over(over) * 4)
    return days.withColumn("level", F.when(~active, 0).when(v == F.max(v).over(over), 4).otherwise(F.greatest(F.lit(1), F.least(F.lit(4), level))).cast("int"))


def _breakdown_columns(key: Column, label: Column) -> list[Column]:
    return [
        key.alias("key"), label.alias("label"), F.col("n").alias("total_requests"), percentage(F.col("ok"), F.col("n")).alias("success_rate"),
        F.col("real_total").alias("real_total_tokens"), F.col("cost").alias("total_cost_usd"),
    ]


def breakdown(events: DataFrame, query: Query, dimension: str) -> DataFrame:
    """The ten largest values of node_id, app_type or model by real tokens."""
    return breakdown_of(measured(in_range(events, query)).groupBy(dimension).agg(*group_sums()), dimension)


def breakdown_of(groups: DataFrame, dimension: str) -> DataFrame:
    return groups.orderBy(F.desc("real_total"), dimension).limit(TOP).select(*_breakdown_columns(F.col(dimension), F.col(dimension)))


def provider_breakdown(events: DataFrame, catalog: DataFrame, query: Query) -> DataFrame:
    """The ten largest (provider, catalogue name) groups; a missing name and an empty one are different groups."""
    return provider_breakdown_of(measured(in_range(events, query)).groupBy(*PROVIDER_KEY).agg(*group_sums()), catalog)


def provider_breakdown_of(by_key: DataFrame, catalog: DataFrame) -> DataFrame:
    named = by_key.join(catalog.select(*PROVIDER_KEY, "name"), PROVIDER_KEY, "left")
    groups = named.groupBy("provider_id", "name").agg(*[F.sum(c).alias(c) for c in ("n", "ok", "real_total", "cost")])
    groups = groups.withColumn("label", provider_label())
    return groups.orderBy(F.desc("real_total"), "provider_id", "label").limit(TOP).select(*_breakdown_columns(F.col("provider_id"), F.col("label")))


def top_cost_models(models: DataFrame) -> DataFrame:
    """The three dearest of a model breakdown that cost anything."""
    return models.filter("total_cost_usd > 0").orderBy(F.desc("total_cost_usd"), F.desc("real_total_tokens"), "key").limit(TOP_COST)


def facets(events: DataFrame, catalog: DataFrame, query: Query) -> DataFrame:
    """(facet, value, label): the values that filters can take, in order; providers carry a name.

    One pass counts the distinct combinations; the facets are taken from those.
    """
    combos = in_range(events, query).select("node_id", "app_type", "provider_id", "model", "data_source").distinct()
    plain = combos.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("node_id", "app_type", "model", "data_source")])).alias("f")
    ).select("f.facet", "f.value", F.col("f.value").alias("label")).distinct()
    providers = combos.select(*PROVIDER_KEY).distinct().join(catalog.select(*PROVIDER_KEY, "name"), PROVIDER_KEY, "left")
    providers = providers.groupBy("provider_id").agg(F.min(provider_label()).alias("label")).select(F.lit("provider_id").alias("facet"), F.col("provider_id").alias("value"), "label")
    return plain.union(providers).orderBy("facet", "value")


def _behind(rows: DataFrame, before: tuple[int, str] | None) -> DataFrame:
    if before is None:
        return rows
    at, key = F.lit(before[0]), F.lit(before[1])
    return rows.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("event_id") < key)))


def events_page(events: DataFrame, catalog: DataFrame, query: Query, limit: int | None = None, before: tuple[int, str] | None = None) -> DataFrame:
    """The newest events before the cursor, newest first: a top-k, so only ``limit`` rows are ever sorted together."""
    page = _behind(in_range(events, query), before).orderBy(F.desc("created_at"), F.desc("event_id")).limit(page_limit(limit))
    page = measured(page).join(catalog.select(*PROVIDER_KEY, "name"), PROVIDER_KEY, "left")
    return page.select(
        "event_id", "node_id", "request_id", "created_at", "app_type", "provider_id", provider_label().alias("provider_name"), "model", "request_model", "pricing_model",
        F.col("fresh").alias("input_tokens"), "output_tokens", "cache_read_tokens", "cache_creation_tokens", F.col("real_total").alias("real_total_tokens"),
        F.col("cost").alias("total_cost_usd"), "latency_ms", "status_code", "is_streaming", "data_source",
    ).orderBy(F.desc("created_at"), F.desc("event_id"))


def newest_page(events: DataFrame, catalog: DataFrame, query: Query, limit: int | None = None, before: tuple[int, str] | None = None) -> DataFrame:
    """``events_page`` of facts partitioned by event_date that opens few days: the newest one, then four times as many, until the page is full.

    Each step counts no more rows than the page has; the range bounds the steps
    to six.  Facts without the partition column are paged as a whole.
    """
    if "event_date" not in events.columns:
        return events_page(events, catalog, query, limit, before)
    first, last = query.begin // 86400, min(query.end - 1, before[0] if before else query.end) // 86400
    span = 1
    while last - span >= first:
        near = events.filter(F.col("event_date") > date(1970, 1, 1) + timedelta(days=last - span))
        if _behind(in_range(near, query), before).limit(page_limit(limit)).count() == page_limit(limit):
            return events_page(near, catalog, query, limit, before)
        span *= 4
    return events_page(events, catalog, query, limit, before)


def next_cursor(page_and_one: list, limit: int) -> tuple[int, str] | None:
    """The cursor behind a page, from its rows and one more if there is one."""
    return (page_and_one[limit - 1]["created_at"], page_and_one[limit - 1]["event_id"]) if len(page_and_one) > limit else None


#: The groupings of the overview and the columns of each; all of them come from one pass.
GROUPINGS = {"trend": ["bucket_start"], **{name: [column] for name, column in DIMENSIONS.items()}, "providers": PROVIDER_KEY, "summary": []}


def grouped(events: DataFrame, query: Query) -> DataFrame:
    """The sums of all groupings of the overview, with grouping: its name.

    The range's rows are read once; each is put into every grouping in the task
    that reads it and added up there, so one exchange moves partial sums only.
    """
    rows = measured(in_range(events, query)).withColumn("bucket_start", bucket_of(query))
    by = ["bucket_start", *dict.fromkeys([*DIMENSIONS.values(), *PROVIDER_KEY])]
    numbers = {sum(1 << (len(by) - 1 - i) for i, c in enumerate(by) if c not in columns): name for name, columns in GROUPINGS.items()}
    sums = rows.groupingSets([[F.col(c) for c in columns] for columns in GROUPINGS.values()], *by).agg(F.grouping_id().alias("number"), *group_sums())
    names = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    return sums.withColumn("grouping", names[F.col("number").cast("int")]).drop("number")


def overview(events: DataFrame, catalog: DataFrame, query: Query) -> dict:
    """All parts of the overview, from one table of the shared folder that has a row a group."""
    sums = shared_table(grouped(events, query))
    part = {name: sums.filter(F.col("grouping") == name) for name in GROUPINGS}
    whole = part["summary"].agg(*[F.sum(c).alias(c) for c in ("n", *SUMS)], F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))  # a row, also of none
    return {
        "range": query,
        "summary": summary_of(whole),
        "trend": trend_of(part["trend"], query),
        "breakdowns": {name: breakdown_of(part[name], column) for name, column in DIMENSIONS.items()} | {"providers": provider_breakdown_of(part["providers"], catalog)},
        "data_scope": "detailOnly",
    }


def week_grid(days: DataFrame) -> DataFrame:
    """(week, weekday, day): whole weeks from the Sunday on or before the first day to the Saturday on or after the last; nothing without days.  days: day."""
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).filter("a IS NOT NULL")
    start, stop = F.date_sub("a", F.dayofweek("a") - 1), F.date_add("b", 7 - F.dayofweek("b"))
    cells = ends.select(F.posexplode(F.sequence(start, stop)).alias("cell", "day"))
    return cells.select(F.floor(F.col("cell") / 7).alias("week"), (F.col("cell") % 7).alias("weekday"), "day")


def calendar_grid(months: DataFrame) -> DataFrame:
    """(month, cell, day): the 42 days of a month's calendar page, from the Sunday on or before its first day.  months: month (a date in it)."""
    cells = months.select(F.trunc("month", "month").alias("month")).distinct().select("month", F.explode(F.sequence(F.lit(0), F.lit(41))).alias("cell"))
    return cells.withColumn("day", F.date_add(F.date_sub(F.col("month"), F.dayofweek("month") - 1), F.col("cell")))


def daily_rollup(events: DataFrame) -> DataFrame:
    """Daily measures by the seven rollup dimensions (an extension: rollups otherwise arrive made)."""
    from ..schema import ROLLUP_DIMENSIONS, with_event_date

    rows = measured(with_event_date(events)).withColumn("date", F.col("event_date").cast("string"))
    return rows.groupBy(*ROLLUP_DIMENSIONS).agg(
        F.count(F.lit(1)).alias("request_count"),
        F.sum("ok").alias("success_count"),
        *[F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")],
        F.sum("cost").alias("total_cost_usd"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )
