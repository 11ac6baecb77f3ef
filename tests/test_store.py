"""What is kept between runs: snapshots, key index, upload store, drain, sync of session files."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillmeter.operators import analytics
from quillmeter.operators import key_index as K
from quillmeter.operators import sync as S
from quillmeter.plans.params import resolve_query
from quillmeter.schema import USAGE_EVENTS, conform
from quillmeter.sources import files, sessions, tables
from quillmeter.sources.snapshots import Conflict, Snapshots, merged_run
from quillmeter.streaming import imports, upload

NOW, DAY = 1_700_000_000, 86_400
ONE = "key string"


def events(spark, rows):
    return conform(spark.createDataFrame([(n, r, t) for n, r, t in rows], "node_id string, request_id string, created_at long"), USAGE_EVENTS)


def scanned(df):
    """Input files of a plan, as it will read them."""
    return sorted(df.inputFiles())


def test_a_commit_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    schema = spark.createDataFrame([], "x int").schema
    assert store.manifest()["version"] == 0 and store.read("t", schema).count() == 0
    base = store.manifest()
    part = store.write(spark.range(3).select(F.col("id").cast("int").alias("x")), "t")
    assert store.read("t", schema).count() == 0  # written, but of no version
    one = store.commit(base, {"t": [{"folder": part}]}, {"a": 1})
    reader = store.read("t", schema)
    other = store.write(spark.range(5).select(F.col("id").cast("int").alias("x")), "t")
    with pytest.raises(Conflict):
        store.commit(base, {"t": [{"folder": other}]})  # began before version 1
    two = store.commit(one, {"t": [{"folder": part}, {"folder": other}]}, {"b": 2})
    assert two["facts"] == {"a": 1, "b": 2} and reader.count() == 3
    assert [store.read("t", schema, store.manifest(v)).count() for v in (1, 2)] == [3, 8]
    three = store.commit(two, {"t": [{"folder": other}]})
    assert store.collect_garbage(keep=2, older_than=3600) == [] and store.versions() == [2, 3]
    assert store.collect_garbage(keep=1, older_than=-1) == [part] and store.read("t", schema, three).count() == 5


def test_parts_are_merged_when_they_are_no_larger():
    sizes = []
    for _ in range(1000):
        n = merged_run([{"rows": r} for r in sizes], 1, 64)
        sizes = sizes[: len(sizes) - n] + [1 + sum(sizes[len(sizes) - n :])]
    assert sum(sizes) == 1000 and len(sizes) <= 1000 // 64 + 8 and max(sizes) <= 128


def test_the_key_index_reads_only_buckets_that_may_have_a_key(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    for first, n in ((0, 4000), (4000, 100), (4100, 100)):
        base = store.manifest()
        keys = spark.range(first, first + n).select(F.concat(F.lit("k"), "id").alias("key"))
        store.commit(base, K.index_tables(K.with_keys(store, base, keys, n, bucket_keys=100)))
    parts = store.manifest()["tables"][K.KEYS]
    assert [p["rows"] for p in parts] == [4000, 200] and parts[0]["of"] == 64
    asked = spark.createDataFrame([("k5",), ("k4150",), ("k999999",), (None,), ("k5",), ("",)], ONE)
    found = K.known_keys(store, store.manifest(), asked)
    assert sorted(r.key for r in found.collect()) == ["k4150", "k5"]
    assert {f.split("bucket=")[1].split("/")[0] for f in scanned(found) if parts[0]["folder"] in f.replace("%3D", "=")} <= {str(r.b) for r in asked.select(F.pmod(F.xxhash64("key"), F.lit(64)).alias("b")).collect()}
    none = K.known_keys(store, store.manifest(), spark.range(20).select(F.concat(F.lit("new"), "id").alias("key")))
    assert none.count() == 0 and len(scanned(none)) < 12  # filters rule nearly all buckets out
    assert K.known_keys(store, {"tables": {}}, asked).count() == 0


def test_a_request_that_returns_on_another_day_is_known(spark, tmp_path):
    store = str(tmp_path / "store")
    assert upload.accept(events(spark, [("n", "r", NOW)]), 0, store, 1)["accepted"] == 1
    assert upload.accept(events(spark, [("n", "r", NOW + 3 * DAY), ("n", "s", NOW + 3 * DAY)]), 1, store, 1) == {"sent": 2, "accepted": 1, "duplicates": 1, "rejected": 0}
    assert sorted((r.event_id, r.created_at) for r in upload.stored(spark, store).collect()) == [("n:r", NOW), ("n:s", NOW + 3 * DAY)]


def test_a_batch_of_several_days_is_seen_whole(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "store")
    upload.accept(events(spark, [("n", "a", NOW)]), 0, store, 1)
    commit = Snapshots.commit
    monkeypatch.setattr(Snapshots, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    batch = events(spark, [("n", f"r{i}", NOW + i * DAY) for i in range(5)])
    with pytest.raises(OSError):
        upload.accept(batch, 1, store, 1)
    assert upload.stored(spark, store).count() == 1  # all five days are written and none is seen
    monkeypatch.setattr(Snapshots, "commit", commit)
    assert upload.accept(batch, 1, store, 1)["accepted"] == 5 and upload.accept(batch, 1, store, 1)["accepted"] == 5  # told again, not stored again
    assert upload.stored(spark, store).count() == 6 and upload.stored(spark, store, 1).count() == 1


def test_of_two_writers_the_later_one_compares_anew(spark, tmp_path, monkeypatch):
    store, once = str(tmp_path / "store"), []
    commit = Snapshots.commit

    def overtaken(self, *a, **k):
        if not once:
            once.append(1)
            assert upload.accept(events(spark, [("n", "a", NOW)]), 0, store, 1, stream="other")["accepted"] == 1
        return commit(self, *a, **k)

    monkeypatch.setattr(Snapshots, "commit", overtaken)
    assert upload.accept(events(spark, [("n", "a", NOW + DAY), ("n", "b", NOW)]), 0, store, 2, stream="mine") == {"sent": 2, "accepted": 1, "duplicates": 1, "rejected": 0}
    assert sorted((r.event_id, r.received_at) for r in upload.stored(spark, store).collect()) == [("n:a", 1), ("n:b", 2)]


def test_many_batches_leave_few_parts_and_no_other_tables(spark, tmp_path):
    store = str(tmp_path / "store")
    for i in range(6):
        upload.accept(events(spark, [("n", f"r{i}", NOW + i)]), i, store, 1)
    table = Snapshots(spark, store)
    assert len(table.manifest()["tables"]["events"]) <= 3 and upload.stored(spark, store).count() == 6
    table.collect_garbage(keep=1, older_than=-1)
    assert len(os.listdir(f"{store}/events")) <= 3 and upload.stored(spark, store).count() == 6


def test_a_store_is_pruned_by_day(spark, tmp_path):
    store = str(tmp_path / "store")
    upload.accept(events(spark, [("n", f"r{i}", NOW + i * DAY) for i in range(4)]), 0, store, 1)
    plan = upload.stored(spark, store).filter(F.col("event_date") == F.lit("2023-11-15").cast("date"))
    assert plan.count() == 1 and "PartitionFilters: [isnotnull(event_date" in plan._jdf.queryExecution().toString()


def test_a_ledger_of_ten_thousand_and_one_is_drained_in_one_pass(spark, tmp_path):
    rows = [("n", f"r{i:05}", NOW + i // 3) for i in range(10_001)]
    random.Random(1).shuffle(rows)
    ledger, store = events(spark, rows).repartition(7), str(tmp_path / "store")
    got = [tuple(r) for r in tables.batch_cursors(tables.drain_batches(ledger)).orderBy("batch_no").collect()]
    ordered = sorted((t, r) for _, r, t in rows)
    assert got == [(b, len(part), *part[-1]) for b in range(20) if (part := ordered[b * 512 : (b + 1) * 512])]
    first = upload.drain(ledger, store, 5)
    assert first == {"sent": 10_001, "accepted": 10_001, "duplicates": 0, "rejected": 0, "batches": 20, "cursor": ordered[-1], "cursor_advanced": True}
    again = upload.drain(ledger, store, 5, overlap_seconds=1)
    late = sum(t >= ordered[-1][0] - 1 for t, _ in ordered)
    assert (again["sent"], again["accepted"], again["duplicates"], again["cursor_advanced"]) == (late, 0, late, False)
    assert upload.drain(ledger, store, 5)["sent"] == 0 and upload.stored(spark, store).count() == 10_001


def test_numbers_of_empty_and_tied_rows(spark):
    assert tables.numbered(spark.createDataFrame([], "a int"), "a").count() == 0
    tied = tables.numbered(spark.createDataFrame([(1, i) for i in range(50)], "a int, b int").repartition(5), "a")
    assert sorted(r.row_no for r in tied.collect()) == list(range(1, 51))


# ---- sync


A, B = "00000000-0000-4000-8000-00000000000a", "00000000-0000-4000-8000-00000000000b"
PRICES = "price_key string, input double, output double, cache_read double, cache_creation double"


def prices(spark):
    return spark.createDataFrame([("m", 1.0, 2.0, 0.0, 0.0)], PRICES)


def put(path, rows, at):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in rows))
    os.utime(path, (at, at))


def message(id_, out, session="s"):
    return {"type": "assistant", "sessionId": session, "timestamp": NOW, "message": {"id": id_, "model": "m", "stop_reason": "end", "usage": {"input_tokens": 5, "output_tokens": out}}}


def counter(n, at=NOW):
    return {"type": "event_msg", "timestamp": at, "payload": {"type": "token_count", "info": {"total_token_usage": {"input_tokens": n, "cached_input_tokens": 0, "output_tokens": 0}}}}


def meta(id_, at=1, **more):
    return {"type": "session_meta", "timestamp": at, "payload": {"id": id_} | more}


def told(spark, path):
    return {(r.request_id, r.input_tokens, r.output_tokens, round(float(r.total_cost_usd) * 1e6)) for r in S.ledger_at(spark, path).collect()}


def test_sync_reads_what_changed_and_keeps_the_rest(spark, tmp_path):
    root, path = tmp_path / "claude", str(tmp_path / "ledger")
    one, two = root / "projects/p/one.jsonl", root / "projects/p/two.jsonl"
    put(one, [message("a", 1)], 1000)
    put(two, [message("b", 1), message("c", 1)], 1000)
    go = lambda now=NOW: S.sync(spark, {"claude": str(root)}, prices(spark), path, now, 8)
    assert go() == {"imported": 3, "skipped": 0, "version": 1}
    assert go() == {"imported": 0, "skipped": 0, "version": 1}  # nothing changed, nothing read, no version
    before = Snapshots(spark, path).manifest()["tables"]["ledger"]
    put(two, [message("b", 1), message("c", 4)], 2000)
    state = Snapshots(spark, path).read_buckets("files", S.STATE, Snapshots(spark, path).manifest())
    changed = files.changed_files(spark, str(root), "claude", state)
    assert [r.path.rsplit("/", 1)[1] for r in changed.collect()] == ["two.jsonl"] and len(scanned(changed)) == 1
    assert [r.path.rsplit("/", 1)[1] for r in files.changed_files(spark, str(root), "claude", state, named=0).collect()] == ["two.jsonl"]
    assert go(NOW + 5) == {"imported": 1, "skipped": 1, "version": 2}
    assert told(spark, path) == {("session:a", 5, 1, 7), ("session:b", 5, 1, 7), ("session:c", 5, 4, 13)}
    after = Snapshots(spark, path).manifest()["tables"]["ledger"]
    assert after[0]["folder"] == before[0]["folder"] and set(after[0]["buckets"]) | set(after[-1]["buckets"]) >= set(before[0]["buckets"])
    assert len(after[-1]["buckets"]) <= 2  # only the buckets of b and c were written anew


def test_a_fork_finds_its_parent_in_the_index(spark, tmp_path):
    root, path = tmp_path / "codex", str(tmp_path / "ledger")
    put(root / f"sessions/rollout-1-{A}.jsonl", [meta(A), counter(1, 2), counter(3, 3)], 1000)
    go = lambda: S.sync(spark, {"codex": str(root)}, prices(spark), path, NOW, 8)
    assert go()["imported"] == 2
    put(root / f"sessions/rollout-1-{B}.jsonl", [meta(B, 10, forked_from_id=A), counter(1, 11), counter(3, 12), counter(7, 13)], 2000)
    assert go()["imported"] == 1
    assert {r for r in told(spark, path) if B in r[0]} == {(f"codex_session:thread-v1:{B}:3", 4, 0, 0)}
    whole = str(tmp_path / "whole")
    S.sync(spark, {"codex": str(root)}, prices(spark), whole, NOW, 8)
    assert told(spark, whole) == told(spark, path)


def test_sessions_are_listed_by_folder(spark, tmp_path):
    """Files are no places of their own, and neither hidden folders nor odd names get lost; what lies deeper is no session."""
    root = tmp_path / "codex"
    good = ["sessions/a.jsonl", "sessions/.h/a.jsonl", "sessions/_h/.i/a.jsonl", "sessions/_k=1/a.jsonl", "sessions/2024/1/2/a [1]{b}*.jsonl", "archived_sessions/a.jsonl"]
    for name in [*good, "sessions/1/2/3/4/a.jsonl", "archived_sessions/x/a.jsonl", "sessions/a.json", "other/a.jsonl"]:
        put(root / name, [meta(A)], 1000)
    places = files._places(spark, str(root), "codex")
    assert not [p for p in places if p.endswith(".jsonl")] and len(places) == 5
    found = files._listed(spark, f"{root}/", "codex")
    assert sorted(r["at"].split("/codex/")[1] for r in found.select("at").collect()) == sorted(good)
    nothing = files.session_files(spark, str(root), "codex").select(F.col("path").alias("file_path"), F.lit(0).cast("long").alias("last_modified"))
    for named in (0, 1, 100):  # six changed files: none, some or all of them known by name
        assert files.changed_files(spark, str(root), "codex", nothing, named).count() == 6
    put(root / good[4], [meta(A)], 2000)
    put(root / good[0], [meta(A)], 500)
    state = files.new_state(None, files.session_files(spark, str(root), "codex"), found.select("path").limit(0), 5).withColumn("last_modified", F.lit(1_000_000_000_000).cast("long"))
    assert {files.changed_files(spark, str(root), "codex", state, named).first().content for named in (0, 1, 100)} == {json.dumps(meta(A))}
    assert files.changed_files(spark, str(root), "codex", state).count() == 1


def test_sessions_without_parents_do_not_meet_in_one_task(spark, tmp_path):
    """Of many sessions without a parent no task has more than its share of records."""
    threads = [f"00000000-0000-4000-8000-{i:012}" for i in range(64)]
    rows = [(f"/s/rollout-1-{t}.jsonl", i, json.dumps(r)) for t in threads for i, r in enumerate([meta(t), counter(1), counter(2)])]
    events = sessions.codex_events(spark.createDataFrame(rows, "path string, line_no int, line string"), NOW)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        skips = sessions.codex_skips(sessions.codex_threads(events))
        per_task = [r["n"] for r in skips.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(per_task) == 64 and max(per_task) < 40


def test_a_run_that_is_cut_off_leaves_nothing_and_is_made_good(spark, tmp_path, monkeypatch):
    root, path, checkpoint = tmp_path / "claude", str(tmp_path / "ledger"), str(tmp_path / "checkpoint")
    put(root / "projects/p/one.jsonl", [message("a", 1)], 1000)
    start = lambda: imports.import_stream(spark, {"claude": str(root)}, prices(spark), path, checkpoint, lambda: NOW, True, 8).awaitTermination()
    start()
    put(root / "projects/p/one.jsonl", [message("a", 2), message("b", 2)], 2000)
    put(root / "projects/q/two.jsonl", [message("c", 3)], 2000)
    commit = Snapshots.commit
    monkeypatch.setattr(Snapshots, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(Exception):
        start()
    assert told(spark, path) == {("session:a", 5, 1, 7)}
    monkeypatch.setattr(Snapshots, "commit", commit)
    start()
    whole = str(tmp_path / "whole")
    S.sync(spark, {"claude": str(root)}, prices(spark), whole, NOW, 8)
    assert told(spark, path) == told(spark, whole) and len(told(spark, path)) == 3


def test_lines_are_parsed_once(spark, tmp_path, monkeypatch):
    """Prices read the records twice: they get them stored, not as lines to parse."""
    root, seen, with_costs = tmp_path / "claude", [], S.with_costs
    put(root / "projects/p/one.jsonl", [message("a", 1)], 1000)
    monkeypatch.setattr(S, "with_costs", lambda records, listed: seen.extend(scanned(records)) or with_costs(records, listed))
    assert S.sync(spark, {"claude": str(root)}, prices(spark), str(tmp_path / "ledger"), NOW, 8)["imported"] == 1
    assert seen and not [path for path in seen if path.endswith(".jsonl")]


def test_rebuild_replaces_all(spark, tmp_path):
    root, path = tmp_path / "claude", str(tmp_path / "ledger")
    put(root / "projects/p/one.jsonl", [message("a", 1), message("b", 1)], 1000)
    S.sync(spark, {"claude": str(root)}, prices(spark), path, NOW, 8)
    (root / "projects/p/one.jsonl").unlink()
    put(root / "projects/p/two.jsonl", [message("c", 1)], 500)
    assert S.rebuild(spark, {"claude": str(root), "gemini": str(tmp_path / "none")}, prices(spark), path, NOW, 8)["imported"] == 1
    assert {r[0] for r in told(spark, path)} == {"session:c"} and S.ledger_at(spark, path, 1).count() == 2
    assert S.sync(spark, {"claude": str(root)}, prices(spark), path, NOW, 8)["version"] == 2


def test_young_turns_are_read_again(spark, tmp_path):
    root, path = tmp_path / "grok", str(tmp_path / "ledger")
    turn = lambda at: {"method": "_x.ai/session/update", "timestamp": at, "params": {"update": {"prompt_id": f"p{at}", "usage": {"inputTokens": 3}}}}
    put(root / "a/updates.jsonl", [turn(NOW - 100), turn(NOW - 10)], 1000)
    go = lambda now: S.sync(spark, {"grok": str(root)}, prices(spark), path, now, 8)["imported"]
    assert go(NOW) == 1 and go(NOW + 60) == 1 and go(NOW + 61) == 0


def test_text_rules(spark):
    from quillmeter.functions.usage import is_placeholder, normalised_codex_model
    from quillmeter.operators.pricing import candidates

    rows = spark.createDataFrame([("\tunknown\n",), (" NULL　",), ("NONÉ",), ("É/GPT-5",), ("a\n/B",)], "t string")
    got = [tuple(r) for r in rows.select(is_placeholder("t"), normalised_codex_model("t"), candidates("t")).collect()]
    assert [g[0] for g in got] == [True, True, False, False, False]
    assert got[2][1] == "nonÉ" and got[3][1:] == ("gpt-5", ["gpt-5"]) and got[4][1:] == ("b", ["b"])
    assert got[0][2] == ["unknown"] and got[1][2] == ["null"]



# ---- reads that follow the layout


def stored_days(spark, store, n=40):
    rows = [(f"n{i % 3}", f"r{i}", NOW + i % n * DAY + i) for i in range(20 * n)]
    df = events(spark, rows).withColumns({"app_type": F.lit("codex"), "provider_id": F.lit("p"), "model": F.concat(F.lit("m"), F.col("created_at") % 4), "input_tokens": F.lit(3).cast("long"), "output_tokens": F.col("created_at") % 5})
    df = df.withColumns({c: F.lit(0).cast("long") for c in ("cache_read_tokens", "cache_creation_tokens", "latency_ms", "input_token_semantics")} | {"status_code": F.lit(200).cast("long"), "total_cost_usd": F.lit("0.5")})
    upload.accept(df, 0, store, 1)
    return upload.stored(spark, store)


def test_the_newest_page_opens_few_days(spark, tmp_path, monkeypatch):
    whole, paged = analytics.events_page, []
    monkeypatch.setattr(analytics, "events_page", lambda near, *a: paged.append(near) or whole(near, *a))
    rows, catalog = stored_days(spark, str(tmp_path / "s")), spark.createDataFrame([], "node_id string, app_type string, provider_id string, name string")
    query = resolve_query(NOW + 41 * DAY, NOW, NOW + 41 * DAY)
    for limit, days in ((5, 4), (60, 16), (200, 16)):
        page = analytics.newest_page(rows, catalog, query, limit)
        assert paged[-1].select("event_date").distinct().count() <= days and "PartitionFilters: [isnotnull(event_date" in page._jdf.queryExecution().toString()
        want = whole(rows, catalog, query, limit).collect()
        assert page.collect() == want and len(want) == limit
    before = (want[-1].created_at, want[-1].event_id)
    assert analytics.newest_page(rows, catalog, query, 50, before).collect() == whole(rows, catalog, query, 50, before).collect()
    none = resolve_query(NOW, NOW - 9 * DAY, NOW - 8 * DAY)
    assert analytics.newest_page(rows, catalog, none, 5).count() == 0 and analytics.newest_page(rows.drop("event_date"), catalog, query, 5).count() == 5


def test_the_overview_moves_rows_once(spark, tmp_path):
    rows = stored_days(spark, str(tmp_path / "s"))
    query = resolve_query(NOW + 41 * DAY, NOW, NOW + 41 * DAY)
    plan = analytics.grouped(rows, query)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1 and "keys" in plan
    found = analytics.overview(rows, spark.createDataFrame([], "node_id string, app_type string, provider_id string, name string"), query)
    assert found["summary"].collect() == analytics.summary(rows, query).collect()
    assert found["trend"].collect() == analytics.trend(rows, query).collect()
    for name, column in analytics.DIMENSIONS.items():
        assert found["breakdowns"][name].collect() == analytics.breakdown(rows, query, column).collect()
    empty = analytics.overview(rows.limit(0), spark.createDataFrame([], "node_id string, app_type string, provider_id string, name string"), query)
    assert empty["summary"].first().total_requests == 0 and empty["trend"].count() == found["trend"].count()


def test_week_grids_are_whole_weeks(spark):
    days = spark.sql("SELECT DATE'2024-05-01' AS day UNION ALL SELECT DATE'2024-05-11'")
    got = analytics.week_grid(days).orderBy("day").collect()
    assert [str(got[0].day), str(got[-1].day)] == ["2024-04-28", "2024-05-11"] and len(got) == 14
    assert [(r.week, r.weekday) for r in got] == [(i // 7, i % 7) for i in range(14)]
    assert analytics.week_grid(days.limit(0)).count() == 0


def test_streams_drop_what_comes_late_and_count_by_window(spark, tmp_path):
    rows = [("a", 0), ("a", 60), ("b", 3600), ("c", 7200), ("a", 30), ("d", 20_000)]
    source = str(tmp_path / "in")
    for i, (key, at) in enumerate(rows):
        spark.createDataFrame([(key, NOW + at)], "event_id string, t long").coalesce(1).write.mode("append").parquet(f"{source}/{i}")
    stream = lambda: spark.readStream.schema("event_id string, t long").option("maxFilesPerTrigger", 1).parquet(f"{source}/*").withColumn("ts", F.timestamp_seconds("t"))
    for name, df in (("once", upload.deduplicated(stream(), "2 hours")), ("hours", upload.streaming_trend(stream(), late="10 minutes"))):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    once = sorted(r.event_id for r in spark.table("once").collect())
    assert once[-3:] == ["b", "c", "d"] and 1 <= once.count("a") <= 2  # one that comes after its state has gone is new, or too late
    assert all(r.total_requests >= 1 for r in spark.table("hours").collect())
