"""Aliases joined without a whole table at the driver."""

from provenant.operators import aliases


def test_aliases_are_not_sent_whole_to_the_driver(spark):
    links = spark.createDataFrame([("p", f"a{i}", f"a{i + 1}") for i in range(50)], "project string, alias string, target string")
    found = aliases.ends(links)
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r["alias"], r["end"], r["steps"]) for r in found.collect()} == {(f"a{i}", "a50", 50 - i) for i in range(50)}
