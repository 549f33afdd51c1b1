"""Cut points against a plain search, cycles and loops included, and over the edges of all suppliers."""

import random

import pytest

from provenant.operators import graph
from provenant.plans import queries


def _reached(edges, node, without=None):
    seen, todo = set(), [node]
    while todo:
        at = todo.pop()
        for upper, lower in edges:
            if upper == at and lower not in seen:
                seen.add(lower)
                if lower != without:
                    todo.append(lower)
    return seen


@pytest.mark.parametrize("seed", range(3))
def test_cuts(spark, seed):
    rng = random.Random(seed)
    edges = {(f"{k}{rng.randrange(7)}", f"{k}{rng.randrange(7)}") for k in "abcd" for _ in range(8)}
    want = set()
    for node in {u for u, _ in edges}:
        all_ = _reached(edges, node)
        want |= {(node, c) for c in all_ - {node} if all_ - {c} - _reached(edges, node, c)}
    got = graph.cuts(spark.createDataFrame(sorted(edges), "upper string, lower string"))
    assert want and {(r.node, r.cut) for r in got.collect()} == want


def test_articulation_of_all_suppliers(spark, tmp_path):
    spark.createDataFrame([(i, i % 2) for i in range(4)], "n_nationkey int, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0,), (1,)], "r_regionkey int").write.parquet(f"{tmp_path}/region.parquet")
    spark.createDataFrame([(1, 1), (9, 2)], "s_suppkey int, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r.node, r.cut) for r in queries.articulation_all(spark, str(tmp_path)).collect()}
    assert {("region:r0", "nation:n2"), ("top:all", "nation:n2"), ("region:r1", "nation:n1")} <= got
