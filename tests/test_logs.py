"""Audit, lineage and metric queries on small logs."""

from __future__ import annotations

import math
import os
import random
import statistics
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from wardenry import schemas as S
from wardenry.operators import audit, conformance, lineage, metrics
from wardenry.schemas import moment
from wardenry.operators.percentile import exact_percentiles

T0 = datetime(2024, 1, 1)


def audit_rows(spark, *rows):
    full = [(f"e{i}", T0 + timedelta(hours=h), action, user, tenant, None, {}, status, message, None)
            for i, (h, action, user, tenant, status, message) in enumerate(rows)]
    return spark.createDataFrame(full, S.AUDIT)


@pytest.fixture(scope="module")
def log(spark):
    return audit_rows(
        spark, (3, "MASK_RECORD", "u", "t1", "SUCCESS", None), (1, "MASK_RECORD", "u", "t2", "SUCCESS", None),
        (2, "STORE_TOKEN", "u", "t1", "FAILURE", "no vault"), (2, "mask_record", "u", "t1", "SUCCESS", None),
    ).cache()


def ids(df, column="event_id"):
    return sorted(r[column] for r in df.collect())


def test_audit_queries(log):
    assert [r.event_id for r in audit.chronological(log).collect()] == ["e1", "e2", "e3", "e0"]
    assert ids(audit.by_action(log, "MASK_RECORD")) == ["e0", "e1"]
    assert ids(audit.by_tenant(log, "t1")) == ["e0", "e2", "e3"]
    assert audit.count(log).first()[0] == 4


def test_time_range_is_closed(log):
    range_only = log.drop("dt")
    assert ids(audit.by_time_range(range_only, T0 + timedelta(hours=1), T0 + timedelta(hours=2))) == ["e1", "e2", "e3"]
    with pytest.raises(ValueError):
        audit.by_time_range(range_only, T0 + timedelta(hours=2), T0)


def test_audit_conformance(spark):
    rows = audit_rows(spark, (0, "", "u", "t", "SUCCESS", None), (0, "A", None, "t", "SUCCESS", None), (0, "A", "u", "", "OK", None),
                      (0, "A", "u", "t", "FAILURE", ""), (0, "A", "u", "t", "FAILURE", "why"))
    found = sorted((r.event_id, r.rule) for r in conformance.audit_violations(rows).collect())
    assert found == [("e0", "action_empty"), ("e1", "user_empty"), ("e2", "status_invalid"), ("e2", "tenant_id_empty"), ("e3", "failure_without_message")]


def test_moments_do_not_depend_on_the_machine(spark, monkeypatch):
    monkeypatch.setenv("TZ", "Asia/Tokyo")
    time.tzset()
    try:
        plain = spark.range(1).select(moment(T0).cast("timestamp").cast("string").alias("t")).first().t
        aware = spark.range(1).select(moment(T0.replace(tzinfo=timezone.utc)).cast("string").alias("t")).first().t
    finally:
        monkeypatch.undo()
        time.tzset()
    assert plain == aware == "2024-01-01 00:00:00"


def test_retention(log):
    assert audit.retained(log, T0 + timedelta(days=9), None).count() == 4
    end = T0 + timedelta(days=1, hours=2)
    assert ids(audit.retained(log, end, 1)) == ["e0", "e2", "e3"]
    assert ids(audit.expired(log, end, 1)) == ["e1"]
    with pytest.raises(ValueError):
        audit.retained(log, T0, -1)


def test_appended_events_are_complete(spark):
    rows = spark.createDataFrame([("t1", "r1")], "tenant_id string, rid string")
    made = audit.events(rows, "A", record_id=F.col("rid"), details={"k": F.col("rid")}, ts=T0)
    assert made.schema.fieldNames() == S.AUDIT.fieldNames()
    row = made.first()
    assert (row.action, row.tenant_id, row.record_id, row.details, row.status, row.ts) == ("A", "t1", "r1", {"k": "r1"}, "SUCCESS", T0)
    assert conformance.audit_violations(made).count() == 0
    with pytest.raises(ValueError):
        audit.events(rows, "A", status="MAYBE")


def edges(spark, *pairs):
    rows = [(f"e{i}", T0, s, d, kind, "u", tenant, {}) for i, (s, d, kind, tenant) in enumerate(pairs)]
    return spark.createDataFrame(rows, S.LINEAGE)


@pytest.fixture(scope="module")
def chain(spark):
    return edges(spark, ("raw", "masked", "MASK", "t1"), ("masked", "daily", "AGGREGATE", "t1"), ("daily", "export", "COPY", "t2"),
                 ("other", "daily", "JOIN", "t2"), ("daily", "daily", "FILTER", "t1"), ("raw", "masked", "HASH", "t1")).cache()


def test_lineage_one_hop(spark, chain):
    assert ids(lineage.touching(chain, "daily")) == ["e1", "e2", "e3", "e4"]
    assert ids(lineage.upstream(chain, "daily")) == ["e1", "e3", "e4"]
    assert ids(lineage.downstream(chain, "daily")) == ["e2", "e4"]
    assert ids(lineage.touching(chain, "nowhere")) == []
    assert ids(lineage.by_event(chain, "e3")) == ["e3"]
    assert ids(lineage.by_transformation(chain, "MASK")) == ["e0"]
    assert ids(lineage.by_tenant(chain, "t2")) == ["e2", "e3"]
    assert ids(lineage.datasets(chain), "dataset") == ["daily", "export", "masked", "other", "raw"]
    assert lineage.dataset_count(chain).first()[0] == 5 and lineage.event_count(chain).first()[0] == 6
    wanted = spark.createDataFrame([("daily",), ("raw",), ("daily",)], "dataset string")
    many = sorted((r.dataset, r.event_id) for r in lineage.touching_many(chain, wanted).collect())
    assert many == [("daily", "e1"), ("daily", "e2"), ("daily", "e3"), ("daily", "e4"), ("raw", "e0"), ("raw", "e5")]


def test_graph_counts_a_loop_as_upstream_only(chain):
    rows = sorted((r.direction, r.neighbour) for r in lineage.neighbours(chain).where("root = 'daily'").collect())
    assert rows == [("downstream", "export"), ("upstream", "daily"), ("upstream", "masked"), ("upstream", "other")]
    degree = {r.root: (r.upstream_count, r.downstream_count) for r in lineage.degrees(chain).collect()}
    assert degree["daily"] == (3, 1) and degree["raw"] == (0, 1)
    assert lineage.adjacency(chain).count() == 5


def reach(pairs, root):
    hops, frontier, depth = {}, {root}, 0
    while frontier:
        depth += 1
        frontier = {d for s, d in pairs if s in frontier} - set(hops)
        hops.update({d: depth for d in frontier})
    return hops


@pytest.mark.parametrize("seed", [1, 2])
def test_provenance_equals_breadth_first_search(spark, seed):
    rng = random.Random(seed)
    # Node 0 is a hub with a third of all edges; cycles and self-loops occur.
    pairs = {(0 if rng.random() < 0.33 else rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    rows = edges(spark, *[(str(s), str(d), "COPY", "t") for s, d in pairs])
    roots = spark.createDataFrame([(str(n),) for n in range(0, 30, 5)], "dataset string")
    for direction, links in (("downstream", pairs), ("upstream", {(d, s) for s, d in pairs})):
        got = {(r.root, r.dataset): r.hops for r in lineage.provenance(rows, roots, direction).collect()}
        want = {(str(n), str(d)): h for n in range(0, 30, 5) for d, h in reach(links, n).items()}
        assert got == want
    bounded = lineage.provenance(rows, roots, max_hops=1)
    assert {r.hops for r in bounded.collect()} == {1}


def test_provenance_of_nothing(spark, chain):
    roots = spark.createDataFrame([("export",)], "dataset string")
    assert lineage.provenance(chain, roots).count() == 0


def test_provenance_of_hubs_and_deep_graphs(spark, monkeypatch):
    """Hubs are dealt over several buckets, and what was seen is merged several times on a long chain with a way back."""
    monkeypatch.setattr(lineage, "HUB_LINKS", 3)
    monkeypatch.setattr(lineage, "MERGED_HOPS", 2)
    pairs = {(n, n + 1) for n in range(9)} | {(9, 0), (3, 3)} | {(4, n) for n in range(20, 30)}
    got = {(r.root, r.dataset): r.hops for r in lineage.provenance(edges(spark, *[(str(s), str(d), "COPY", "t") for s, d in pairs]), spark.createDataFrame([("0",), ("5",)], "dataset string")).collect()}
    assert got == {(str(n), str(d)): h for n in (0, 5) for d, h in reach(pairs, n).items()}


def test_provenance_searches_roots_together(spark, monkeypatch):
    """A dataset is one row a block of 64 roots that reach it by the same hop; all 64 bits tell their root."""
    pairs = {(n, 200) for n in range(130)} | {(n, n + 1) for n in range(200, 204)} | {(204, 0), (7, 203), (9, 9)}
    counts, write = {}, lineage._Bucketed.write

    def counted(self, df, name, by):
        counts[name] = (found := write(self, df, name, by)).count()
        return found

    monkeypatch.setattr(lineage._Bucketed, "write", counted)
    rows = edges(spark, *[(str(s), str(d), "COPY", "t") for s, d in pairs])
    roots = spark.createDataFrame([(str(n),) for n in range(130)] * 2 + [(None,)], "dataset string")
    got = [(r.root, r.dataset, r.hops) for r in lineage.provenance(rows, roots).collect()]
    assert sorted(got) == sorted((str(n), str(d), h) for n in range(130) for d, h in reach(pairs, n).items())
    assert counts["hop-2"] <= 8 and counts["hop-3"] <= 8
    monkeypatch.setattr(lineage, "ROOT_GROUP", 30)
    assert sorted((r.root, r.dataset, r.hops) for r in lineage.provenance(rows, roots).collect()) == sorted(got)


def test_provenance_never_moves_the_links(spark, monkeypatch, chain):
    plans, files = [], []
    hop, write = lineage._hop, lineage._Bucketed.write
    monkeypatch.setattr(lineage, "_hop", lambda *args: plans.append(hop(*args)) or plans[-1])
    monkeypatch.setattr(lineage._Bucketed, "write", lambda self, df, name, by: files.append(f"{self.folder}/{name}".removeprefix("file:")) or write(self, df, name, by))
    monkeypatch.setattr(lineage, "broadcast_if_small", lambda df: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    tables = {t.name for t in spark.catalog.listTables()}
    try:
        found = lineage.provenance(chain, spark.createDataFrame([("raw",)], "dataset string"))
        text = plans[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    join = text[text.index("SortMergeJoin [near"):]
    assert "Bucketed: true" in text and "Exchange" not in join[: join.index("FileScan")]
    assert found.count() > 0 and {t.name for t in spark.catalog.listTables()} == tables
    assert not os.path.exists(files[0]) and os.path.exists(files[1])


def test_tracking_pairs_edges_with_audit_rows(spark):
    rows = spark.createDataFrame([("t1",)], "tenant_id string")
    tracked = lineage.track(rows, F.lit("a"), F.lit("b"), F.lit("COPY"), ts=T0)
    assert tracked.schema.fieldNames() == S.LINEAGE.fieldNames()
    logged = lineage.tracking_events(tracked).first()
    assert logged.action == "LINEAGE_TRANSFORMATION_TRACKED" and logged.details["destination_dataset"] == "b"
    assert conformance.lineage_violations(tracked).count() == 0


def metric_rows(spark, *rows):
    return spark.createDataFrame([(f"m{i}", n, float(v), T0 + timedelta(hours=h), labels) for i, (n, v, h, labels) in enumerate(rows)], S.METRICS)


def test_metric_queries(spark):
    df = metric_rows(spark, ("lat", 5, 3, {"tenant": "a"}), ("lat", 4, 1, {}), ("ops", 7200, 2, {"tenant": "a"}), ("lat", 3, 2, {"tenant": "b"}))
    assert [r.metric_id for r in metrics.by_name(df, "lat").collect()] == ["m1", "m3", "m0"]
    assert [r.metric_id for r in metrics.by_label(df, "tenant", "a").collect()] == ["m2", "m0"]
    assert metrics.by_label(df, "absent", "a").count() == 0
    assert [r.metric_id for r in metrics.chronological(df).collect()] == ["m1", "m2", "m3", "m0"]
    # The window is closed below and open above.
    assert ids(metrics.trailing(df, "lat", T0 + timedelta(hours=3), 1), "metric_id") == ["m0", "m3"]
    assert ids(metrics.trailing(df, "lat", T0 + timedelta(hours=2), 0), "metric_id") == ["m0", "m3"]
    rates = {r.name: r.throughput for r in metrics.throughput(df, T0 + timedelta(hours=3), 2).collect()}
    assert rates == {"ops": 1.0, "lat": 0.0}
    assert metrics.count(df).first()[0] == 4
    with pytest.raises(metrics.NoData):
        metrics.throughput(df, T0 + timedelta(hours=30), 1, strict=True)
    with pytest.raises(ValueError):
        metrics.throughput(df, T0, 0)
    with pytest.raises(TypeError):
        metrics.trailing(df, "lat", T0, 1.5)
    with pytest.raises(ValueError):
        metrics.latency_percentiles(df, [101], T0)


def test_error_rate(spark):
    rows = audit_rows(spark, *[(i, "A", "u", "t", "FAILURE" if i < 2 else "SUCCESS", "m") for i in range(10)])
    row = metrics.error_rate(rows, T0, T0 + timedelta(hours=9)).first()
    assert (row.error_rate, row.event_count) == (20.0, 10)
    assert metrics.error_rate(rows, T0 - timedelta(hours=9), T0 - timedelta(hours=8)).count() == 0
    with pytest.raises(metrics.NoData):
        metrics.error_rate(rows, T0 - timedelta(hours=9), T0 - timedelta(hours=8), strict=True)


def by_rank(values, fraction):
    ordered = sorted(values)
    return ordered[min(int(len(ordered) * fraction), len(ordered) - 1)]


@pytest.mark.parametrize("task_rows", [60, 200_000])
def test_percentiles_equal_sorting(spark, task_rows):
    rng = random.Random(task_rows)
    groups = {
        "hot": [rng.choice([1.0, 2.0, rng.uniform(0, 1000)]) for _ in range(3000)], "ties": [5.0] * 100, "one": [3.5],
        "two": [1.0, 2.0], "ten": [50.0 + 50 * i for i in range(10)], "negative": [rng.gauss(0, 1) for _ in range(777)], None: [1.0, 9.0, 4.0],
    }
    fractions = [0.0, 0.25, 0.5, 0.9, 0.95, 0.99, 0.999, 1.0]
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "g string, v double").repartition(6)
    got = {(r.g, r.fraction): r.percentile for r in exact_percentiles(df, ["g"], "v", fractions, task_rows).collect()}
    assert got == {(k, f): by_rank(vs, f) for k, vs in groups.items() for f in fractions}


def test_percentiles_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("wardenry.operators.percentile.broadcast_if_small", lambda df: df)
    df = spark.createDataFrame([(i % 3, float(i)) for i in range(300)], "g int, v double")
    got = {r.g: r.percentile for r in exact_percentiles(df, ["g"], "v", [0.5], 60).collect()}
    assert got == {g: by_rank([float(i) for i in range(300) if i % 3 == g], 0.5) for g in range(3)}


def test_percentiles_with_a_wrong_sketch(spark, monkeypatch):
    """The pieces are counted, so cuts at the wrong place cost time alone."""
    monkeypatch.setattr("wardenry.operators.percentile.SKETCH_ERROR", -0.2)
    df = spark.createDataFrame([(1, float(i % 97)) for i in range(500)], "g int, v double")
    got = {r.fraction: r.percentile for r in exact_percentiles(df, ["g"], "v", [0.1, 0.5, 0.99], 100).collect()}
    assert got == {f: by_rank([float(i % 97) for i in range(500)], f) for f in (0.1, 0.5, 0.99)}


def test_percentiles_of_nan_decimals_and_nothing(spark):
    nan = float("nan")
    df = spark.createDataFrame([("a", v) for v in (1.0, nan, 2.0, nan)] + [("b", nan), ("b", nan), ("c", None)], "g string, v double")
    got = {(r.g, r.fraction): r.percentile for r in exact_percentiles(df, ["g"], "v", [0.25, 1.0], 3).collect()}
    assert got.pop(("a", 0.25)) == 2.0 and sorted(got) == [("a", 1.0), ("b", 0.25), ("b", 1.0)] and all(v != v for v in got.values())
    money = df.where("g = 'a' AND v < 5").select("g", F.col("v").cast("decimal(9,2)").alias("v"))
    assert [str(r.percentile) for r in exact_percentiles(money, ["g"], "v", [0.99]).collect()] == ["2.00"]
    assert exact_percentiles(df.where("g = 'c'"), ["g"], "v", [0.5]).count() == 0


def test_percentiles_of_the_whole_table(spark):
    df = spark.createDataFrame([(float(i),) for i in range(99)], "v double")
    assert exact_percentiles(df, [], "v", [0.5]).first().percentile == 49.0
    with pytest.raises(ValueError):
        exact_percentiles(df, [], "v", [0.5], task_rows=0)


def test_summary(spark):
    values = [50.0 + 50 * i for i in range(10)]
    df = metric_rows(spark, *[("lat", v, 0, {}) for v in values], ("single", 7, 0, {}))
    rows = {r.name: r for r in metrics.summary(df).collect()}
    lat = rows["lat"]
    assert (lat["count"], lat["mean"], lat["min"], lat["max"], lat.p50, lat.p99) == (10, 275.0, 50.0, 500.0, 300.0, 500.0)
    assert math.isclose(lat.stdev, round(statistics.stdev(values), 2))
    assert rows["single"].stdev is None and rows["single"].p99 == 7.0


def test_latency_percentiles(spark):
    df = metric_rows(spark, *[("lat", v, 0, {}) for v in range(100, 1000)])
    got = {r.percentile: r.latency for r in metrics.latency_percentiles(df, [0, 50, 99, 100], T0).collect()}
    assert got == {p: by_rank(list(range(100, 1000)), p / 100) for p in (0, 50, 99, 100)}
    near = {r.percentile: r.latency for r in metrics.latency_percentiles(df, [50], T0, approximate=True).collect()}
    assert abs(near[50.0] - 550) <= 5


def test_metric_recording_and_conformance(spark):
    rows = spark.createDataFrame([("t", 3)], "tenant_id string, n int")
    made = metrics.record(rows, "ops", F.col("n"), {"tenant": F.col("tenant_id")}, ts=T0)
    assert made.schema.fieldNames() == S.METRICS.fieldNames() and made.first().value == 3.0
    assert conformance.metric_violations(made).count() == 0
