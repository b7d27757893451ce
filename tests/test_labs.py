from tamarind import labs
from tamarind.engine import Engine
from tamarind.operators import dml
from tamarind.sources.workload import events


def test_labs(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.run("CREATE TABLE events (id UINT, kind INT, city TEXT, payload TEXT, PRIMARY KEY (id))")
    dml.insert(e.catalog, "events", events(spark, 3000))
    e.run_script("CREATE INDEX ev_kind ON events (kind); CREATE INDEX ev_city ON events (city); ANALYZE events")
    points, _ = labs.break_even(e.catalog, "ev_kind", "payload", (0.01, 1.0), 1)
    assert [p.selectivity for p in points] == [0.01, 1.0] and all(p.scan > 0 and p.index > 0 and p.covering > 0 for p in points)
    assert labs.cost_constants(points, 3000).scan == 1
    assert labs.estimates(e.catalog, "events", "kind", [(0, 100), (0, 1000)]) == [(300.0, 300), (3000.0, 3000)]
    # Text ranges are guessed from the number of values, and skew makes that wrong.
    guess, there = labs.estimates(e.catalog, "events", "city", [("HN", "HO")])[0]
    assert there == 2970 and guess < there / 10
    tax = labs.maintenance_tax(e.catalog, "events", lambda k: [(10_000 + k, 1, "x", "y")], [["payload"]])
    assert len(tax) == 2 and e.catalog.check("events") == 0
    spark.conf.set("spark.sql.caseSensitive", "false")
    spark.conf.set("spark.sql.orderByOrdinal", "true")


def test_stages_orders_budgets_and_commits(spark, tmp_path):
    from tamarind import scenarios

    with scenarios.settings(spark):
        e = Engine(spark, str(tmp_path))
        e.run("CREATE TABLE ev (id INT, kind INT, PRIMARY KEY (id))")
        dml.insert(e.catalog, "ev", spark.range(2000).selectExpr("id", "id % 20 as kind"))
        found = labs.stages(e, "SELECT id FROM ev WHERE id < 50", 1)
        assert set(found) == {"parse", "bind", "plan", "run"} and found["parse"] < 0.1 and all(v >= 0 for v in found.values())
        assert all(v > 0 for v in labs.order_gain(e, "SELECT id, kind FROM ev ORDER BY id", 1)) and all(v > 0 for v in labs.order_gain(e, "SELECT id FROM ev ORDER BY id LIMIT 5", 1))
        assert set(labs.spilling(spark, spark.range(5000), "id", (100, 10_000), 1)) == {100, 10_000}
        off = {"spark.sql.optimizer.excludedRules": "org.apache.spark.sql.catalyst.optimizer.PushDownPredicates"}
        assert all(v > 0 for v in labs.with_and_without(spark, off, lambda: labs.discard(e.query("SELECT id FROM ev WHERE kind = 3")), 1)) and spark.conf.get("spark.sql.optimizer.excludedRules", None) is None
        assert all(v > 0 for v in labs.commits(e, "ev", lambda n: [(10_000 + k, 1) for k in range(n)], 2)) and e.catalog.check("ev") == 0
