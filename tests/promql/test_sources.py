"""Merging, source wrappers, catalog, sinks and rules, on small fixtures."""

import json
import random
from dataclasses import replace

import pytest
from dsl import load, vector

from pyspark.sql import functions as F

from tsq import catalog, rules, sinks
from tsq.operators.merge import merge_pair, merge_vectors
from tsq.plans.engine import Engine
from tsq.promql.ast import Matcher
from tsq.sources.registry import ConfigError, SourceRegistry, TargetRelabel, read_config
from tsq.sources.source import EngineSource, Federation, Group, LabelFilter, RefreshedFilter, Relabel, Source, SourceError, TimeBounds, inject_matchers, step_align, strip_added
from tsq.sources.tables import Catalog, scan_of

SCHEMA = "labels map<string,string>, t bigint, v double, stale boolean"


def walk(a, b, buf, prefer_max=False):
    """The merge as one pass over both sides."""
    if len(b) > len(a):
        a, b = b, a
    if not a or not b:
        return a or b
    out = {t: v for t, v in a}
    times = [t for t, _ in a]
    for t, v in b:
        before, after = [x for x in times if x <= t], [x for x in times if x > t]
        if not before:
            ok = t < after[0] - buf
        elif not after:
            ok = t > before[-1] + buf
        else:
            ok = after[0] - before[-1] > 2 * buf and before[-1] + buf < t < after[0] - buf
        if ok:
            out[t] = v
    if prefer_max:
        for i, (t, v) in enumerate(a):
            near = [(x, w) for x, w in b if abs(x - t) < max(buf, 1)]
            if near and near[0][1] > v and (i or b[0][0] < t):
                out[t] = near[0][1]
    return sorted(out.items())


def frame(spark, sides):
    return [spark.createDataFrame([({"s": str(k)}, t, v) for k, s in enumerate(side) for t, v in s], "labels map<string,string>, t bigint, v double") for side in sides]


def test_merge_equals_walk(spark):
    rng = random.Random(4)
    def side():
        return [(t, float(rng.randrange(10))) for t in sorted(rng.sample(range(60), rng.randrange(0, 15)))]

    a, b = [side() for _ in range(300)], [side() for _ in range(300)]
    for buf, prefer in ((0, False), (3, False), (8, False), (4, True), (1, True)):
        got: dict = {}
        for r in merge_pair(*frame(spark, (a, b)), buf, prefer_max=prefer, slice_ms=7 if buf % 2 else 1000).collect():
            got.setdefault(r["labels"]["s"], []).append((r["t"], r["v"]))
        for k in range(300):
            assert sorted(got.get(str(k), [])) == [tuple(x) for x in walk(a[k], b[k], buf, prefer)], (k, buf, prefer)


def test_dynamic_buffer(spark):
    """Half the upper median of the longer side's gaps, of both where it has under three, across slices too."""
    rng = random.Random(5)
    for width in (40, 10**6):
        a, b = ([sorted(rng.sample(range(0, 400), rng.randrange(2, 20))) for _ in range(80)] for _ in range(2))
        sides = [[[(t, 1.0) for t in x] for x in side] for side in (a, b)]
        got: dict = {}
        for r in merge_pair(*frame(spark, sides), 9, dynamic=True, slice_ms=width).collect():
            got.setdefault(int(r["labels"]["s"]), []).append((r["t"], r["v"]))
        for k in range(80):
            x, y = (a[k], b[k]) if len(a[k]) >= len(b[k]) else (b[k], a[k])
            gaps = [q - p for p, q in zip(x, x[1:], strict=False)]
            gaps = gaps if len(gaps) >= 3 else gaps + [q - p for p, q in zip(y, y[1:], strict=False)]
            buf = sorted(gaps)[len(gaps) // 2] // 2 if len(gaps) >= 3 else 9
            assert sorted(got[k]) == walk(sides[0][k], sides[1][k], buf), (k, buf)


def test_merge_vectors(spark):
    one, two = frame(spark, ([[(0, 0.0)], [(0, 3.0)]], [[(0, 5.0)], [(0, 4.0)]]))
    assert sorted(r["v"] for r in merge_vectors([one, two]).collect()) == [3.0, 5.0]
    assert sorted(r["v"] for r in merge_vectors([one, two], prefer_max=True).collect()) == [4.0, 5.0]


@pytest.fixture(scope="module")
def samples(spark):
    text = """
    load 1m
      alive{job="a", rack="x"} 1x10
      alive{job="b", rack="y"} 0x10
      hits{job="a", old="v"} 0+10x10
    """
    return spark.createDataFrame(load(text), SCHEMA).cache()


def test_source_wrappers(spark, samples):
    m = lambda *x: tuple(Matcher(*y) for y in x)
    s = Source(samples, labels={"az": "a"}, inject=m(("job", "=", "a")), relabel=(Relabel("replace", "job", "team"), Relabel("uppercase", "team"), Relabel("labeldrop", "old|job")))
    e = Engine(spark, Federation([Group([s])]).scan)
    assert vector(e.query('{az="a",__name__=~".+"}', 300_000).collect()) == {
        (("__name__", "alive"), ("az", "a"), ("rack", "x"), ("team", "A")): 1.0,
        (("__name__", "hits"), ("az", "a"), ("team", "A")): 50.0,
    }
    assert e.query('alive{az="b"}', 300_000).count() == 0
    assert e.query('alive{old=""}', 300_000).count() == 1
    for bad in (("keep", "a", "b"), ("replace", "a", "${x}"), ("replace", "a"), ("labeldrop", "a", "b"), ("lowercase", "")):
        with pytest.raises(ValueError):
            Relabel(*bad)
    f = LabelFilter.collect(samples, ["__name__", "rack"], fixed={"__name__": {"more"}}, excluded={"rack": {"y"}})
    assert f.admits(m(("__name__", "=", "more"))) and not f.admits(m(("rack", "=", "y"))) and f.admits(m(("job", "=", "z")))
    assert Source(samples, label_filter=f).scan(m(("rack", "=", "y")), 0, 10) is None
    assert inject_matchers(m(("a", "=", "1")), m(("a", "=", "1"), ("b", "=", "2"))) == m(("a", "=", "1"), ("b", "=", "2"))
    assert strip_added(m(("az", "=", "a")), {"az": "a"}) == m(("__name__", "=~", ".+"))
    assert strip_added(m(("az", "=", "b")), {"az": "a"}) is None


def test_time_bounds(samples):
    b = TimeBounds(1000, 5000, truncate=True)
    assert b.clip(0, 9000, 700) == (1400, 5000) and b.clip(6000, 9000, 700) is None
    assert b.overlaps(5000, 5000) and not b.overlaps(5001, 6000)
    assert TimeBounds(-1000, None, relative=True, truncate=True).clip(0, 10_000, 300, now=10_000) == (9000, 10_000)
    got = Source(samples, bounds=(TimeBounds(120_000, 240_000, truncate=True),)).scan((Matcher("__name__", "=", "hits"),), -1, 10**9)
    assert sorted(r["t"] for r in got.collect()) == [120_000, 180_000, 240_000]
    assert sorted(r["t"] for r in step_align(got, 1800, 3600).collect())[0] == 121_800


def test_groups(spark, samples):
    class Broken(Source):
        def scan(self, *_):
            raise OSError("down")

    gone = Source(lambda *_: spark.read.parquet("/nowhere/at/all"), "gone", spark=spark)

    name = (Matcher("__name__", "=", "hits"),)
    assert Group([Source(samples), Source(samples)]).scan(name, -1, 10**9).count() == 11
    assert Group([Source(samples), Broken(samples)]).scan(name, -1, 10**9).count() == 11
    tolerant = Group([gone, Source(samples)])
    assert tolerant.scan(name, -1, 10**9).count() == 11 and len(tolerant.warnings) == 1
    assert tolerant.label_values("job", ["alive"]).count() == 2
    with pytest.raises(SourceError):
        Group([gone]).scan(name, -1, 10**9)
    with pytest.raises(SourceError):
        Group([gone, Source(samples)], quorum=2).scan(name, -1, 10**9)
    # replicas with labels of their own are asked apart
    with pytest.raises(SourceError):
        Group([replace(gone, labels={"az": "a"}), Source(samples, labels={"az": "b"})]).scan(name, -1, 10**9)
    lost = spark.createDataFrame([], SCHEMA).select(F.raise_error(F.lit("torn")).cast("map<string,string>").alias("labels"), "t", "v", "stale")
    torn = Source(lost.unionByName(samples.select(F.raise_error(F.lit("torn")).cast("map<string,string>").alias("labels"), "t", "v", "stale")), "torn", probe=True)
    assert Group([torn, Source(samples)]).scan(name, -1, 10**9).count() == 11
    with pytest.raises(SourceError):
        Group([Broken(samples)]).scan(name, -1, 10**9)
    f = Federation([Group([Source(samples, labels={"az": "a"})]), Group([Broken(samples, name="x", warn_only=True)]), Group([Source(samples, labels={"az": "b"})])])
    assert Engine(spark, f.scan).query("sum(hits)", 300_000).first()["v"] == 100.0 and f.warnings == {"x: down"}


def test_catalog(spark, samples):
    assert [r["name"] for r in catalog.label_names(samples).collect()] == ["__name__", "job", "old", "rack"]
    assert [r["value"] for r in catalog.label_values(samples, "job", ['alive{rack="y"}']).collect()] == ["b"]
    assert catalog.series(samples, ["alive", 'hits{job="a"}']).count() == 3
    one = spark.createDataFrame([("m", "counter", "h", ""), ("n", "gauge", "", "s")], "metric string, type string, help string, unit string")
    two = spark.createDataFrame([("m", "gauge", "other", "")], "metric string, type string, help string, unit string")
    assert catalog.metadata([one, two], "m").first()["type"] == "counter"
    assert catalog.metadata([one, two], limit=1).count() == 1
    ex = spark.createDataFrame([({"__name__": "hits"}, {"trace": "1"}, 1.0, 5)], "labels map<string,string>, ex_labels map<string,string>, v double, t bigint")
    assert catalog.exemplars([ex, ex], "rate(hits[5m]) + hits", 0, 10).count() == 1


def test_sinks(spark, samples, tmp_path):
    text = sinks.exposition_text(sinks.federate(samples, ["hits", "alive"], 600_000, external={"zone": "q"}))
    assert text.splitlines()[3:] == ["# TYPE hits untyped", 'hits{instance="",job="a",old="v",zone="q"} 100 600000']
    e = Engine(spark, scan_of(samples))
    body = sinks.to_json(e.query_range("hits", 0, 120_000, 60_000), "matrix", ["w"])
    assert json.loads(body)["data"]["result"][0]["values"] == [[0.0, "0"], [60.0, "10"], [120.0, "20"]]
    back, said = sinks.from_json(spark, body)
    assert back.count() == 3 and said == {"w"}
    with pytest.raises(ValueError, match="bad_data"):
        sinks.from_json(spark, '{"status":"error","errorType":"bad_data","error":"x"}')
    rule = rules.RecordingRule("job:hits", "sum by (job) (hits)", {"x": "y"})
    sinks.write_samples(rule.evaluate(e, 0, 120_000, 60_000), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_alerts(spark, samples):
    e = Engine(spark, scan_of(samples))
    rule = rules.AlertingRule("Hot", "hits > 30", 120_000, {"sev": "page"})
    got = {r["t"] // 60_000: (r["state"], r["active_at"]) for r in rule.evaluate(e, 0, 480_000, 60_000).collect()}
    assert got == {4: ("pending", 240_000), 5: ("pending", 240_000), 6: ("firing", 240_000), 7: ("firing", 240_000), 8: ("firing", 240_000)}
    gap = spark.createDataFrame([({"a": "1"}, t * 60_000, 1.0) for t in (1, 2, 3, 5, 6)], "labels map<string,string>, t bigint, v double")
    assert [r["v"] for r in rules.alert_state(gap, 60_000, {}).orderBy("t").collect()] == [60, 60, 60, 300, 300]
    assert rules.backfill(e, rule, 60_000, 480_000).where("t = 480000").first()["v"] == 300
    assert rules.find_rule({"g": (60, [rule])}, "Hot", [Matcher("sev", "=", "page")]) == (rule, 60)
    assert rules.find_rule({"g": (60, [rule])}, "Hot", [Matcher("sev", "=", "no")]) is None


def test_streaming(spark, tmp_path):
    from tsq.streaming.windows import latest_with_ttl, sliding

    rows = [(f"2024-01-01 00:{m:02d}:00", k, float(m)) for m in range(10) for k in "ab"]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, "ts string, k string, v double").selectExpr("cast(ts as timestamp) ts", "k", "v").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(src)
    q = sliding(stream, "sum_over_time", "4 minutes", "2 minutes", "1 minute", ["k"]).writeStream.format("memory").queryName("slid").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["t"].minute, r["v"]) for r in spark.sql("select * from slid where k = 'a'").collect()} >= {(4, 6.0), (6, 14.0)}
    q = latest_with_ttl(stream, "k", "5 minutes").writeStream.format("memory").queryName("newest").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["k"], r["v"]) for r in spark.sql("select * from newest").collect()} == {("a", 9.0), ("b", 9.0)}
    assert latest_ttl_is_kept(spark, tmp_path) == {("a", 30), ("b", 31)}


def latest_ttl_is_kept(spark, tmp_path):
    """Newest times (minutes) by key where a series is silent for longer than its time to live and then comes back."""
    from tsq.streaming.windows import latest_with_ttl

    src = str(tmp_path / "ttl")
    (tmp_path / "ttl").mkdir()
    stream = spark.readStream.schema("ts timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(src)
    for k, rows in enumerate(([(0, "a", 9.0)], [(20, "b", 1.0)], [(25, "b", 1.0)], [(30, "a", 2.0)], [(31, "b", 3.0)])):
        made = [(f"2024-01-01 00:{m:02d}:00", key, v) for m, key, v in rows]
        frame = spark.createDataFrame(made, "ts string, k string, v double").selectExpr("cast(ts as timestamp) ts", "k", "v").coalesce(1)
        frame.write.mode("append").parquet(src)
        if k == 0:
            q = latest_with_ttl(stream, "k", "5 minutes").writeStream.format("memory").queryName("ttl").outputMode("update").start()
        q.processAllAvailable()
    q.stop()
    newest = {}
    for r in spark.sql("select * from ttl order by t").collect():
        newest[r["k"]] = r["t"] // 60_000 % 60
    return set(newest.items())


def test_repeated_and_alert_streams(spark, tmp_path):
    from tsq.streaming.windows import alert_states, evaluate_rules, sliding

    src = str(tmp_path / "in")
    rows = [(f"2024-01-01 00:{m:02d}:00", k, 1.0) for m in (0, 1, 2, 5, 6, 7, 8, 9) for k in "ab" for _ in range(2)]
    spark.createDataFrame(rows, "ts string, k string, v double").selectExpr("cast(ts as timestamp) ts", "k", "v").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(src)
    q = sliding(stream, "count_over_time", "4 minutes", "4 minutes", "1 minute", ["k"]).writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["t"].minute, r["v"]) for r in spark.sql("select * from once where k = 'a'").collect()} >= {(4, 3.0), (8, 3.0)}
    q = alert_states(stream, "k", "2 minutes", "1 minute").writeStream.format("memory").queryName("alerts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r["t"] // 60_000 % 60: (r["active_at"] // 60_000 % 60, r["state"]) for r in spark.sql("select * from alerts where k = 'b'").collect()}
    assert got == {0: (0, "pending"), 1: (0, "pending"), 2: (0, "firing"), 5: (5, "pending"), 6: (5, "pending"), 7: (5, "firing"), 8: (5, "firing"), 9: (5, "firing")}
    out: list = []
    plain = stream.select(F.create_map(F.lit("__name__"), F.lit("m"), F.lit("k"), F.col("k")).alias("labels"), F.unix_millis("ts").alias("t"), "v", F.lit(False).alias("stale"))
    rule = rules.RecordingRule("all:m", "sum(m)")
    q = evaluate_rules(plain, [rule], lambda batch: Engine(spark, scan_of(batch)), lambda df: out.extend(df.collect()), 60_000, str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert len(out) == 10 and {r["labels"]["__name__"] for r in out} == {"all:m"}


def test_histograms(spark):
    """Windows, sums and merges of native histograms; a fall of any part is a new start."""
    h = lambda *n: (float(sum(n)), float(sum(n) * 2), [(float(i), float(i + 1), float(x)) for i, x in enumerate(n)])
    rows = [({"__name__": "sizes", "s": s}, t * 60_000, None, False, h(*n)) for s in "ab" for t, n in enumerate([(1, 0), (3, 1), (5, 4), (1, 1), (2, 5)])]
    schema = SCHEMA + ", h struct<count double, sum double, buckets array<struct<lower double, upper double, n double>>>"
    df = spark.createDataFrame(rows, schema)
    e = Engine(spark, scan_of(df))
    (r,) = e.histograms("sum(increase(sizes[4m]))", 240_000).collect()
    # of two series each: (3, 1), (5, 4), a new start with (1, 1), then (2, 5): growth 2 - 3 + 5 and 5 - 1 + 4, over 3 of 4 minutes and half a gap
    grown = [(2 - 3 + 5) * 2, (5 - 1 + 4) * 2]
    factor = (180 + 60) / 180
    assert [round(b["n"], 9) for b in r["h"]["buckets"]] == [round(x * factor, 9) for x in grown]
    assert round(r["h"]["count"], 9) == round(sum(grown) * factor, 9)
    assert e.query("histogram_count(sizes)", 60_000).first()["v"] == 4 and e.query("histogram_quantile(0.5, sum(sizes))", 60_000).count() == 1
    assert e.query("sizes", 60_000).count() == 0 and e.query("sum(sizes)", 60_000).count() == 0
    shifted = df.withColumn("t", F.col("t") + 5000)
    both = Group([Source(df), Source(shifted)], buffer_ms=20_000).scan((Matcher("__name__", "=", "sizes"),), -1, 10**9)
    assert both.count() == 10 and {r["t"] % 60_000 for r in both.collect()} == {0}
    body = sinks.to_json(e.histograms("sizes", 60_000).withColumn("v", F.lit(None).cast("double")), "vector")
    back, _ = sinks.from_json(spark, body)
    assert sorted(map(str, back.select("h").collect())) == sorted(map(str, e.histograms("sizes", 60_000).select("h").collect()))


def test_pushed_filters(spark, tmp_path):
    """Time bounds and matchers of a source reach the file reader, below relabelling, and disjoint groups do not shuffle."""
    path = str(tmp_path / "table")
    spark.sql("SELECT timestamp_millis(id * 1000) AS ts, IF(id % 2 = 0, 'x', 'y') AS kind, CAST(id AS double) AS v FROM range(100)").write.parquet(path)
    table = Catalog(spark).add("m", spark.read.parquet(path), {"kind": "kind"}, "ts", "v").scan
    source = Source(table, labels={"az": "a"}, relabel=(Relabel("replace", "az", "zone"),), bounds=(TimeBounds(20_000, None, truncate=True),))
    store = Federation([Group([source]), Group([replace(source, labels={"az": "b"})])])
    df = store.get_value((Matcher("kind", "=~", "x|z"), Matcher("zone", "!=", "c")), -1, 50_000)
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(x in plan for x in ("GreaterThan(ts,1970-01-01 00:00:19.999", "LessThan(ts,1970-01-01 00:00:50.001", "In(kind, [x,z]"))
    assert sorted(r["v"] for r in df.where("labels['zone'] = 'a'").collect()) == [float(x) for x in range(20, 51, 2)]
    plain = Source(table, labels={"az": "a"})
    side = Federation([Group([plain]), Group([replace(plain, labels={"az": "b"})])]).get_value((), -1, 10**6)
    assert "Exchange" not in side._jdf.queryExecution().executedPlan().toString() and side.count() == 200


def test_registry(spark, samples):
    group = {"name": "g", "static_configs": [{"targets": ["t1", "t2"], "labels": {"Tier": "x"}}], "anti_affinity": "1s"}
    build = lambda **more: SourceRegistry({"server_groups": [{**group, **more}]}, lambda a: samples)
    registry = build(relabel_configs=[{"action": "keep", "source_labels": ["__address__"], "regex": "t1"}, {"action": "labelmap", "regex": "(T.*)", "replacement": "my_$1"}], ignore_error=True)
    (found,) = registry.federation.groups
    assert [(r.name, r.labels, r.optional) for r in found.replicas] == [("g/t1", {"Tier": "x", "my_Tier": "x"}, True)] and found.buffer_ms == 1000
    assert read_config(registry.dump()) == registry.config
    assert registry.federation.query("sum(hits)", 300_000).first()["v"] == 50.0
    for bad in ({"nonsense": 1}, {"relabel_configs": [{"action": "drop", "regex": ".*"}]}, {"relabel_configs": [{"action": "jump"}]}, {"relabel_configs": [{"action": "hashmod", "target_label": "x"}]}):
        with pytest.raises(ConfigError):
            build(**bad)
    one = {"a": "X1", "b": "y"}
    steps = {
        ("lowercase", ("a",), "low"): one | {"low": "x1"}, ("keepequal", ("a",), "b"): None, ("dropequal", ("a",), "b"): one,
    }
    for (action, source, target), want in steps.items():
        assert TargetRelabel(action, source, target_label=target).apply(one) == want
    assert TargetRelabel("labeldrop", regex="b").apply(one) == {"a": "X1"} and TargetRelabel("labelkeep", regex="b").apply(one) == {"b": "y"}
    assert TargetRelabel(source_labels=("a", "b"), regex="X(.);(.*)", target_label="c", replacement="${2}-$1").apply(one) == one | {"c": "y-1"}
    assert TargetRelabel("hashmod", ("a",), target_label="m", modulus=4).apply(one)["m"] in "0123"


def test_engine_source_and_refresh(spark, samples):
    inner = EngineSource(Engine(spark, scan_of(samples)))
    assert inner.query("sum(hits)", 300_000).first()["v"] == 50.0
    with pytest.raises(NotImplementedError):
        inner.series(["hits"])
    clock, loads = [0], []

    def collect():
        loads.append(clock[0])
        return LabelFilter({"job": frozenset(["a"] if clock[0] < 100 else ["b"])})

    fresh = RefreshedFilter(collect, 100, lambda: clock[0])
    b = (Matcher("job", "=", "b"),)
    assert not fresh.admits(b) and not fresh.admits(b)
    clock[0] = 150
    assert fresh.admits(b) and loads == [0, 150]


def test_rule_outputs(spark, samples, caplog):
    e = Engine(spark, scan_of(samples))
    record, alert = rules.RecordingRule("r", "sum(hits)"), rules.AlertingRule("Hot", "hits > 30", 120_000)
    with pytest.raises(rules.RuleError):
        rules.run_rules([alert, record], e, None, 0, 60_000, 60_000)
    kept: list = []
    rules.run_rules([record, alert], e, kept.append, 240_000, 480_000, 60_000)
    assert kept[0].count() == 5 and {r["state"] for r in rules.to_send(kept[1]).collect()} == {"firing"}
    sink = sinks.NullSink()
    for df in kept:
        sink.write(df)
    assert sink.warned and sum("dropped" in r.message for r in caplog.records) == 1
    cache: dict = {}
    own = spark.createDataFrame([({"__name__": "ALERTS_FOR_STATE", "alertname": "Hot"}, 1, 7.0)], "labels map<string,string>, t bigint, v double")
    assert rules.backfill(e, alert, 60_000, 480_000, own).first()["v"] == 7.0
    other = own.withColumn("labels", F.create_map(F.lit("alertname"), F.lit("Cold")))
    first = rules.backfill(e, alert, 60_000, 480_000, other, cache)
    assert first.where("t = 480000").first()["v"] == 300 and rules.backfill(e, alert, 60_000, 480_000, None, cache) is first
