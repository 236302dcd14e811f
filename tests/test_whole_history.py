"""Releases and callers over whole tables, against plain versions."""

from larkspan.operators import history as hi
from larkspan.plans import registry
from larkspan.session import table


def first_tag(time, tags):
    return next((tag for at, tag in sorted(tags) if time is not None and at >= time), None)


def test_release_groups_ties_and_missing_times(spark):
    tags = [(20, "b"), (10, "z"), (20, "a")]
    times = [None, 5, 10, 11, 20, 21]
    commits = spark.createDataFrame(list(enumerate(times)), "id int, time int")
    out = hi.release_groups(commits, spark.createDataFrame(tags, "at int, tag string"), "time", "at", "tag")
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [(k, t, first_tag(t, tags)) for k, t in enumerate(times)]


def test_every_order_has_its_release(spark, data):
    orders = table(spark, data, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority").collect()
    low = {}
    for _, at, tag in orders:
        low[tag] = min(at, low.get(tag, at))
    tags = [(at, tag) for tag, at in low.items()]
    got = registry.QUERIES["release_notes_all"](spark, data).collect()
    assert sorted(map(tuple, got)) == sorted((k, first_tag(at, tags)) for k, at, _ in orders)


def test_callers_beyond_the_first_hundred_parts(spark, data):
    parts = table(spark, data, "part").select("p_partkey", "p_brand", "p_type").collect()
    gone = {(f"{b}.{t}", t) for _, b, t in parts if t == "PROMO"}
    got = registry.QUERIES["removed_callers_all"](spark, data).collect()
    assert sorted(map(tuple, got)) == sorted((n, k) for n, short in gone for k, _, t in parts if t == short)
