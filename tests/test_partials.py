"""Questions answered from the partial sums of a store."""

import random
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillmeter.operators import analytics as A
from quillmeter.operators import partials as P
from quillmeter.plans.params import resolve_query
from quillmeter.schema import USAGE_EVENTS, conform
from quillmeter.sources.snapshots import Conflict, Snapshots
from quillmeter.streaming import upload

DAY = 86_400
START = 1_704_067_200  # 2024-01-01
COLUMNS = "node_id string, request_id string, created_at long, app_type string, provider_id string, model string, data_source string, input_tokens long, output_tokens long, status_code long, total_cost_usd string"


def batch(spark, first, n, seed=1):
    """Events of twelve days; some models and providers are null, some costs are no numbers."""
    r = random.Random(seed)
    rows = []
    for i in range(first, first + n):
        at = START + r.randrange(12 * DAY)
        rows.append((f"n{i % 3}", f"r{i}", at, r.choice(["codex", "claude"]), r.choice(["p", "q", ""]), r.choice(["m1", "m2", None]), "log", r.randrange(100), r.randrange(9), r.choice([200, 500]), r.choice(["0.25", "x", "1.5"])))
    df = spark.createDataFrame(rows, COLUMNS)
    zero = {c: F.lit(0).cast("long") for c in ("cache_read_tokens", "cache_creation_tokens", "latency_ms", "input_token_semantics")}
    return conform(df.withColumns(zero), USAGE_EVENTS)


def catalog(spark):
    return spark.createDataFrame([("n0", "codex", "p", "Pea"), ("n1", "codex", "p", "")], "node_id string, app_type string, provider_id string, name string")


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("filled") / "store")
    for i, (first, n) in enumerate(((0, 300), (200, 200), (400, 20), (420, 20))):  # the second returns some of the first
        upload.accept(batch(spark, first, n, seed=i), i, at, 1)
    return at


@pytest.fixture
def store(filled, tmp_path):
    """A copy that a test may change."""
    return shutil.copytree(filled, str(tmp_path / "store"))


RAGGED = (START + 2 * DAY + 1_234, START + 9 * DAY - 777)


def questions(source, spark, query):
    return {
        "summary": source.summary(query).collect(),
        "trend": source.trend(query).collect(),
        "models": source.breakdown(query, "model").collect(),
        "providers": source.provider_breakdown(catalog(spark), query).collect(),
    }


class Raw:
    def __init__(self, events):
        self.events = events

    def summary(self, query):
        return A.summary(self.events, query)

    def trend(self, query):
        return A.trend(self.events, query)

    def breakdown(self, query, dimension):
        return A.breakdown(self.events, query, dimension)

    def provider_breakdown(self, catalog, query):
        return A.provider_breakdown(self.events, catalog, query)


@pytest.mark.parametrize(
    "begin, end, more",
    [
        (*RAGGED, {"bucket": "1d", "offset_minutes": 480}),  # local days
        (*RAGGED, {"bucket": "1d", "offset_minutes": 345}),  # of a zone at three quarters of an hour
        (*RAGGED, {"bucket": "1mo", "model": "m1"}),
        (*RAGGED, {"bucket": "7m", "app_type": "codex"}),  # fits no quarter hour: from the events
        (START, START + 12 * DAY, {"bucket": "6h", "node_id": "n1"}),  # no ends
        (START + 901, START + 1_799, {"bucket": "15m"}),  # ends only
        (START + 300, START + 2_000, {"bucket": "15m"}),
        (START - 20 * DAY, START - DAY, {"bucket": "1d"}),  # nothing
    ],
)
def test_answers_are_those_of_the_events(spark, filled, begin, end, more):
    query = resolve_query(end, begin, end, **more)
    assert questions(P.StoredUsage(spark, filled), spark, query) == questions(Raw(upload.stored(spark, filled)), spark, query)  # all costs are sums of quarters, so exact


def test_only_the_ends_are_read(spark, store):
    query = resolve_query(RAGGED[1], *RAGGED, bucket="1d", offset_minutes=480)
    want = questions(P.StoredUsage(spark, store), spark, query)
    days = sorted(Path(store, "events").glob("part=*/event_date=*"))
    inner = [d for d in days if "2024-01-04" <= d.name.removeprefix("event_date=") <= "2024-01-08"]
    assert inner
    for day in inner:
        shutil.rmtree(day)
    assert A.summary(upload.stored(spark, store), query).collect() != want["summary"]
    assert questions(P.StoredUsage(spark, store), spark, query) == want


def test_sums_and_events_become_visible_together(spark, store, monkeypatch):
    table = Snapshots(spark, store)
    before = table.manifest()
    assert P.covered(before) and sum(p["rows"] for p in before["tables"][P.PARTIALS]) == 440
    assert len(before["tables"][P.PARTIALS]) < 4  # four batches: smaller parts were merged
    commit = Snapshots.commit
    monkeypatch.setattr(Snapshots, "commit", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        upload.accept(batch(spark, 1000, 10), 9, store, 1)
    monkeypatch.setattr(Snapshots, "commit", commit)
    query = resolve_query(START + 12 * DAY, START, START + 12 * DAY)
    assert table.manifest() == before and P.StoredUsage(spark, store).summary(query).first().total_requests == 440
    upload.accept(batch(spark, 1000, 10), 9, store, 1)
    assert P.StoredUsage(spark, store).summary(query).first().total_requests == 450
    assert P.StoredUsage(spark, store, before["version"]).summary(query).first().total_requests == 440


def test_a_batch_overtaken_by_another_counts_once(spark, store, monkeypatch):
    commit, once = Snapshots.commit, []

    def overtaken(self, *a, **k):
        if not once:
            once.append(1)
            raise Conflict("another writer was first")
        return commit(self, *a, **k)

    monkeypatch.setattr(Snapshots, "commit", overtaken)
    upload.accept(batch(spark, 1000, 10), 9, store, 1)
    query = resolve_query(START + 12 * DAY, START, START + 12 * DAY)
    assert P.covered(Snapshots(spark, store).manifest()) and P.StoredUsage(spark, store).summary(query).first().total_requests == 450


def test_a_store_without_sums_gets_them_with_its_next_batch(spark, store):
    table = Snapshots(spark, store)
    base = table.manifest()
    table.commit(base, {P.PARTIALS: []})  # as a store from before
    query = resolve_query(RAGGED[1], *RAGGED, bucket="1d")
    raw = questions(Raw(upload.stored(spark, store)), spark, query)
    assert not P.covered(table.manifest()) and questions(P.StoredUsage(spark, store), spark, query) == raw
    upload.accept(batch(spark, 2000, 30), 10, store, 1)
    assert P.covered(table.manifest()) and questions(P.StoredUsage(spark, store), spark, query) == questions(Raw(upload.stored(spark, store)), spark, query)


def test_an_empty_store_answers(spark, tmp_path):
    empty = P.StoredUsage(spark, str(tmp_path / "none"))
    query = resolve_query(START + DAY, START + 5, START + DAY, bucket="1h")
    assert empty.summary(query).first().total_requests == 0 and empty.trend(query).count() == 24 and empty.breakdown(query, "model").count() == 0
