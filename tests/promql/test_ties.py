"""Samples of one series at one time."""

import pytest

from tsq.operators.merge import union_shards
from tsq.plans.engine import Engine
from tsq.promql.ast import Matcher
from tsq.sources.source import Federation, Group, Relabel, Source
from tsq.sources.tables import scan_of

SCHEMA = "labels map<string,string>, t bigint, v double, stale boolean"


@pytest.fixture(scope="module")
def tied(spark):
    """Two series; one has two different and two equal samples at one time."""
    click = [({"__name__": "m", "kind": "click"}, t, v, False) for t, v in ((1, 5.0), (1, 3.0), (2, 4.0), (2, 4.0), (3, 1.0))]
    return spark.createDataFrame([*click, ({"__name__": "m", "kind": "view"}, 3, 2.0, False)], SCHEMA).cache()


def rows(df, name):
    return sorted((r["labels"].get(name, ""), r["t"], r["v"]) for r in df.collect())


def test_replace_keeps_samples_of_one_series(spark, tied):
    """Copying a label makes no series one; writing over one does, and then the largest stays where they meet."""
    got = rows(Source(tied, relabel=(Relabel("replace", "kind", "copy"),)).scan((), 0, 9), "copy")
    assert got == [("click", 1, 3.0), ("click", 1, 5.0), ("click", 2, 4.0), ("click", 2, 4.0), ("click", 3, 1.0), ("view", 3, 2.0)]
    got = rows(Source(tied, relabel=(Relabel("replace", "__name__", "kind"),)).scan((), 0, 9), "kind")
    assert got == [("m", 1, 3.0), ("m", 1, 5.0), ("m", 2, 4.0), ("m", 2, 4.0), ("m", 3, 2.0)]


def test_case_keeps_samples_of_one_series(spark, tied):
    """Spellings that become one merge where they meet; samples of one spelling stay."""
    more = spark.createDataFrame([({"__name__": "m", "kind": "Click"}, 3, 9.0, False), ({"__name__": "m", "kind": "Click"}, 4, 9.0, False)], SCHEMA)
    got = rows(Source(tied.unionByName(more), relabel=(Relabel("uppercase", "kind"),)).scan((Matcher("kind", "=", "CLICK"),), 0, 9), "kind")
    assert got == [("CLICK", 1, 3.0), ("CLICK", 1, 5.0), ("CLICK", 2, 4.0), ("CLICK", 2, 4.0), ("CLICK", 3, 9.0), ("CLICK", 4, 9.0)]


def test_shards_keep_every_sample(spark, tied):
    """Shards that hold different samples of one series; groups of a federation may hold the same ones, which count once."""
    one, two = tied.where("v <> 3.0"), tied.where("v = 3.0")
    assert rows(union_shards([one, two]), "kind") == rows(union_shards([two, one]), "kind") == rows(tied, "kind")
    store = Federation([Group([Source(tied.where("t = 3"))]), Group([Source(tied.where("t = 3"))])])
    assert rows(store.get_value((), 0, 9), "kind") == [("click", 3, 1.0), ("view", 3, 2.0)]


def test_dropped_added_label_keeps_samples(spark, tied):
    """A label that is added and dropped again makes no series one; dropping the table's own does."""
    source = Source(tied, labels={"az": "a"}, relabel=(Relabel("labeldrop", "az.*"),))
    assert rows(source.scan((Matcher("az", "=", ""),), 0, 9), "kind") == rows(tied, "kind")
    got = rows(Source(tied, relabel=(Relabel("labeldrop", "kind"),)).scan((), 0, 9), "kind")
    assert got == [("", 1, 5.0), ("", 2, 4.0), ("", 3, 2.0)]


@pytest.mark.parametrize("flip", (False, True))
def test_resets_take_ties_by_value(spark, flip):
    """Whatever order samples of one time arrive in, inside a pane and at its end."""
    samples = [(1, 1.0), (2, 20.0), (2, 5.0), (3, 30.0), (10, 50.0), (10, 35.0), (11, 40.0)]
    frame = spark.createDataFrame([({"__name__": "m"}, t, v, False) for t, v in (samples[::-1] if flip else samples)], SCHEMA).coalesce(1)
    engine = Engine(spark, scan_of(frame))
    for name, want in (("resets", [0.0, 1.0]), ("changes", [5.0, 6.0])):
        got = engine.query_range(f"{name}(m[20ms])", 10, 20, 10).orderBy("t").collect()
        assert [r["v"] for r in got] == want, name
