import json

import pytest
from pyspark.sql import functions as F

from quillmeter.functions.usage import plain_number, uuid_text
from quillmeter.sources import files, sessions
from quillmeter.sources.tables import opencode_messages

NOW = 2_000_000_000
A, B = "00000000-0000-4000-8000-00000000000a", "00000000-0000-4000-8000-00000000000b"


def lines(spark, path, rows):
    return spark.createDataFrame([(path, i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(rows)], "path string, line_no int, line string")


def usage(at, *total, kind="total_token_usage", **more):
    names = ("input_tokens", "cached_input_tokens", "output_tokens")
    return {"type": "event_msg", "timestamp": at, "payload": {"type": "token_count", "info": {kind: dict(zip(names, total))} | more}}


def meta(id_, at=1, **more):
    return {"type": "session_meta", "timestamp": at, "payload": {"id": id_} | more}


def codex(spark, *sources):
    df = None
    for name, rows in sources:
        part = lines(spark, f"/x/rollout-2024-{name}.jsonl", rows)
        df = part if df is None else df.union(part)
    return [tuple(r) for r in sessions.codex_records(df, NOW).select("request_id", "model", "input_tokens", "cache_read_tokens", "output_tokens").orderBy("source_path", "position").collect()]


def test_codex_counters_become_increases(spark):
    got = codex(spark, (A, [meta(A), "{broken", usage(2, 10, 2, 3), usage(3, 15, 4, 5), usage(3, 15, 4, 5)]))
    assert got == [(f"codex_session:thread-v1:{A}:1", "unknown", 10, 2, 3), (f"codex_session:thread-v1:{A}:2", "unknown", 5, 2, 2)]


def test_codex_models_and_single_events(spark):
    rows = [meta(A), {"type": "turn_context", "payload": {"model": "GPT-5"}}, usage(2, 12, 2, 3), usage(3, 5, 9, 1, kind="last_token_usage", model="v/GPT-6-2025-01-02"), usage(4, 13, 2, 3), usage(5, 3, 0, 0)]
    assert [r[1:] for r in codex(spark, (A, rows))] == [("GPT-5", 12, 2, 3), ("gpt-6", 5, 5, 1), ("gpt-6", 1, 0, 0), ("gpt-6", -10, -10, -3)]


def test_codex_needs_its_own_meta(spark):
    assert codex(spark, (A, [meta(B), usage(2, 1, 0, 0)])) == [] and codex(spark, (A, [usage(2, 1, 0, 0)])) == []
    part = lines(spark, "/x/rollout.jsonl", [meta(A), usage(2, 1, 0, 0)])
    assert sessions.codex_records(part, NOW).count() == 0


def test_codex_forks_skip_what_they_replay(spark):
    parent = [meta(A), usage(2, 1, 0, 0), usage(3, 2, 0, 0), usage(99, 3, 0, 0)]
    child = [meta(B, 10, forked_from_id=A), usage(11, 1, 0, 0), usage(11, 2, 0, 0), usage(12, 3, 0, 0)]
    got = codex(spark, (A, parent), (B, child))
    assert [r[0][-2:] for r in got if B in r[0]] == [":3"]  # the parent's third event is younger than the fork
    assert [r for r in codex(spark, (B, child))] == []  # no parent file


def test_a_parent_without_events_is_still_a_parent(spark):
    child = [meta(B, 10, forked_from_id=A), usage(11, 1, 0, 0)]
    assert [r[0][-2:] for r in codex(spark, (A, ["no json"]), (B, child))] == [":1"]


def test_import_counts(spark):
    parent, replay, orphan = [meta(A), usage(2, 1, 0, 0)], [meta(B, 10, forked_from_id=A), usage(11, 1, 0, 0)], [meta("c" + A[1:], 9, forked_from_id="d" + A[1:]), usage(11, 1, 0, 0)]
    df = lines(spark, f"/x/rollout-2024-{A}.jsonl", parent).union(lines(spark, f"/x/rollout-2024-{B}.jsonl", replay)).union(lines(spark, f"/x/rollout-2024-c{A[1:]}.jsonl", orphan))
    records, counts = sessions.codex_import(df, NOW)
    assert records.count() == 1 and tuple(counts.first()) == (3, 2)
    turn = {"method": "_x.ai/session/update", "params": {"update": {"usage": {"inputTokens": 1}}}}
    df = lines(spark, "/a/s/updates.jsonl", [turn, turn | {"timestamp": 5}, {}, "junk"]).union(lines(spark, "/a/t/updates.jsonl", [{}]))
    assert tuple(sessions.grok_counts(df).first()) == (2, 1)


def test_only_changed_files_come_back(spark):
    parent, child = [meta(A), usage(2, 1, 0, 0)], [meta(B, 10, forked_from_id=A), usage(11, 1, 0, 0), usage(12, 3, 0, 0)]
    df = lines(spark, f"/x/rollout-2024-{A}.jsonl", parent).union(lines(spark, f"/x/rollout-2024-{B}.jsonl", child))
    changed = spark.createDataFrame([(f"/x/rollout-2024-{B}.jsonl",)], "path string")
    assert [r.input_tokens for r in sessions.codex_records(df, NOW, changed).collect()] == [2]


def test_repeated_keys_and_trailing_text(spark):
    answer = '{"type":"user","type":"assistant","message":{"id":"m%s","usage":{"input_tokens":1,"input_tokens":2}}}'
    rows = [answer % 1, answer % 2 + " {}", answer % 3 + ", {}", " " + answer % 4 + "\t", "[" + answer % 5 + "]", ""]
    got = sessions.claude_records(lines(spark, "/c", rows), NOW).collect()
    assert {(r.request_id, r.input_tokens) for r in got} == {("session:m1", 2), ("session:m4", 2)}
    for bad in ("{} {}", "{}, {}", "{} x", ""):
        with pytest.raises(Exception):
            sessions.gemini_records(spark.createDataFrame([("/g", bad)], "path string, content string"), NOW).collect()
    assert sessions.gemini_records(spark.createDataFrame([("/g", "[1]"), ("/h", "7")], "path string, content string"), NOW).count() == 0


UUIDS = {A: A, A.upper(): A, "{" + A + "}": A, f"urn:uuid:{A}": A, A.replace("-", ""): A, A[:-1]: None, "{" + A: None, A.replace("-", "", 1): None, "urn:uuid:" + A.replace("-", ""): None, A[:1] + "-" + A[1:8] + A[9:]: None}


def test_uuids(spark):
    df = spark.createDataFrame(list(UUIDS.items()), "text string, id string")
    assert df.select(F.count_if(~uuid_text(F.col("text")).eqNullSafe(F.col("id")))).first()[0] == 0


NUMBERS = {0.1: "0.1", 1e-7: "0.0000001", 1e21: "1000000000000000000000", 123456.789: "123456.789", -2.5e-5: "-0.000025", 0.0: "0", 3.0: "3", 5e-324: "0." + "0" * 323 + "49", 1.5e300: "15" + "0" * 299, 12345678.9: "12345678.9", 100.0: "100"}


def test_plain_numbers(spark):
    df = spark.createDataFrame(list(NUMBERS.items()), "x double, text string").select("x", "text", plain_number(F.col("x")).alias("got"))
    for r in df.collect():
        assert r.got == r.text or (r.x == 5e-324 and float(r.got) == r.x)


@pytest.mark.parametrize("child,parent,n", [("aczb", "abc", 2), ("ba", "ab", 1), ("x", "a", 0), ("abc", "abc", 3), ("a", "", 0)])
def test_replay_is_a_greedy_match(spark, child, parent, n):
    df = spark.createDataFrame([([(c,) for c in child], list(parent))], "child array<struct<s:string>>, parent array<string>")
    assert df.select(sessions.replayed("child", "parent")).first()[0] == n


def test_claude_takes_the_final_message(spark):
    def say(id_, out, stop=False, **more):
        return {"type": "assistant", "timestamp": "2026-07-30T00:00:00Z", "message": {"id": id_, "model": "x", "usage": {"input_tokens": 10, "output_tokens": out}} | ({"stop_reason": None} if stop else {})} | more

    rows = [say("m1", 3), say("m1", 9, sessionId="s1"), say("m1", 2, True), say("m1", 2, True, timestamp=5), {"type": "user"}, '{"type":"assistant"} x', say("m2", 1)]
    got = sessions.claude_records(lines(spark, "/c", rows), NOW).orderBy("request_id").collect()
    assert [(r.request_id, r.output_tokens, r.created_at, r.session_id) for r in got] == [("session:m1", 2, 1785369600, "s1"), ("session:m2", 1, 1785369600, "s1")]


def test_gemini(spark):
    m = {"type": "gemini", "model": "y", "timestamp": "2026-07-30T00:00:00+01:00", "tokens": {"input": 5, "output": 2, "thoughts": 1, "cached": 1.5}}
    doc = {"sessionId": "s2", "messages": [{"type": "user"}, m | {"id": "g1"}, m, m | {"tokens": {"input": 0}}]}
    df = spark.createDataFrame([("/g", json.dumps(doc))], "path string, content string")
    got = sessions.gemini_records(df, NOW).orderBy("position").collect()
    assert [(r.request_id, r.output_tokens, r.cache_read_tokens, r.created_at) for r in got] == [("gemini_session:s2:g1", 3, 0, 1785366000), ("gemini_session:s2:idx2", 3, 0, 1785366000)]
    with pytest.raises(Exception):
        sessions.gemini_records(spark.createDataFrame([("/g", "{")], "path string, content string"), NOW).collect()


def test_opencode(spark, tmp_path):
    import sqlite3

    path = str(tmp_path / "o.db")
    assert opencode_messages(spark, path).count() == 0
    row = {"role": "assistant", "modelID": "z", "time": {"created": 1785369600999, "completed": None}, "tokens": {"input": 4, "output": 2, "reasoning": 1, "cache": {"read": 1, "write": 0}}, "cost": 0.01}
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE message (id TEXT, session_id TEXT, data TEXT)")
        db.execute("INSERT INTO message VALUES ('n', NULL, '{}')")
        db.executemany("INSERT INTO message VALUES (?, 's', ?)", [("a", json.dumps(row)), ("b", "junk"), ("c", json.dumps(row | {"time": {"created": 1}}))])
    got = sessions.opencode_records(opencode_messages(spark, path), NOW).collect()
    assert [(r.request_id, r.output_tokens, r.created_at, r.reported_total_cost_usd) for r in got] == [("opencode_session:s:a", 3, 1785369600, "0.01")]


def test_grok(spark):
    def turn(at, **update):
        return {"method": "_x.ai/session/update", "timestamp": at, "params": {"update": {"prompt_id": "p1"} | update}}

    model = {"inputTokens": 9, "outputTokens": 2, "cachedReadTokens": 3, "apiDurationMs": 120, "costUsdTicks": 12345678901}
    rows = [turn(1000, usage={"modelUsage": {"w": model, "v": {"inputTokens": 1}}}), turn(1000, prompt_id="", usage={"inputTokens": 4}), turn(1000, sessionUpdate="x", usage=model), turn(None, usage=model), turn(1980, usage=model)]
    got, deferred = sessions.grok_records(lines(spark, "/a/sess/updates.jsonl", rows), 2000)
    got = got.orderBy("request_id").collect()
    assert [(r.request_id, r.input_tokens, r.latency_ms, r.reported_total_cost_usd, r.input_token_semantics) for r in got] == [
        ("grok_session:sess:idx1:unknown", 4, 0, None, 1), ("grok_session:sess:p1:v", 1, 0, None, 1), ("grok_session:sess:p1:w", 9, 120, "1.2345678901", 1)]
    assert [r.path for r in deferred.collect()] == ["/a/sess/updates.jsonl"]


def test_files_are_found_and_skipped_once_seen(spark, tmp_path):
    at = tmp_path / "projects" / "p"
    at.mkdir(parents=True)
    (at / "a.jsonl").write_text("one\r\ntwo")
    found = files.session_files(spark, str(tmp_path), "claude")
    assert [(r.line_no, r.line) for r in files.lines(found).orderBy("line_no").collect()] == [(0, "one"), (1, "two")]
    state = files.new_state(None, found, found.limit(0).select("path"), 5)
    assert files.changed_since(found, state).count() == 0 and files.changed_since(found, None).count() == 1
    assert files.new_state(state, found, found.select("path"), 6).count() == 1
    assert files.session_files(spark, str(tmp_path), "codex").count() == 0
    assert files.session_files(spark, str(tmp_path / "none"), "grok").count() == 0


def test_state_and_cursor_are_kept(spark, tmp_path):
    at, cursor = str(tmp_path / "state"), str(tmp_path / "cursor.json")
    assert files.load_state(spark, at) is None and files.load_cursor(spark, cursor) == (0, "")
    state = spark.createDataFrame([("/f", 5, 6)], "file_path string, last_modified long, last_synced_at long")
    files.save_state(state.limit(0), at)
    files.save_state(files.load_state(spark, at).union(state), at)  # read while it is replaced
    assert files.load_state(spark, at).count() == 1
    for c in ((5, 'r"1\n'), (7, "é")):
        files.save_cursor(spark, cursor, c)
        assert files.load_cursor(spark, cursor) == c


def test_sources_in_order(spark):
    one = sessions.codex_records(lines(spark, f"/x/rollout-1-{A}.jsonl", [meta(A), usage(2, 1, 0, 0)]), NOW)
    assert sessions.all_records(one, one).select(F.max("source_order")).first()[0] == 1
