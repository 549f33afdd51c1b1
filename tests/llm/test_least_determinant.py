"""The estimate of the quality rules against a plain minimum-covariance-determinant search with many starts."""

import numpy as np

from provenant.llm import quality_rules as Q

NAMES = {"a": 0.05, "b": 0.05, "c": 0.05}


def _plain(x, least, starts, rng):
    """The least logarithm of a determinant that concentration finds from random starts, with its mean and covariance."""
    h, best = int(np.ceil(Q.SUBSET * len(x))), None
    for _ in range(starts):
        part = x[rng.choice(len(x), 5, replace=False)]
        mean, cov, last = part.mean(0), np.cov(part.T, bias=True) + np.diag(least**2), np.inf
        while True:
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            near = x[np.argsort(d, kind="stable")[:h]]
            mean, cov = near.mean(0), np.cov(near.T, bias=True) + np.diag(least**2)
            now = np.linalg.slogdet(cov)[1]
            if now >= last - 1e-9:
                break
            last = now
        if best is None or now < best[0]:
            best = now, mean, cov
    return best


def _data(rng, n, kind):
    mix = np.array([[1, 0.9, 0.1], [0, 0.3, 0.2], [0, 0, 0.5]])
    x = rng.normal(size=(n, 3)) @ mix
    bad = n // 6
    if kind == "cluster":
        x[:bad] = rng.normal(size=(bad, 3)) * 0.2 + [2, -2, 1]
    elif kind == "line":
        x[:bad] = np.outer(rng.normal(size=bad) * 8, [1, -1, 0])
    elif kind == "ties":
        x[:bad] = 3.0
    return x


def test_least_determinant(spark):
    """All kinds of groups in one table: they don't touch one another."""
    rng = np.random.default_rng(4)
    groups = {f"{kind} {n}": _data(rng, n, kind) * scale + shift for kind in ("none", "cluster", "line", "ties") for n, scale, shift in ((700, 1, 0), (300, 3, 5))}
    rows = [(g, i, *map(float, v)) for g, x in groups.items() for i, v in enumerate(x)]
    stats = Q.cut(spark.createDataFrame(rows, "g string, i int, a double, b double, c double"), "t")
    found = {r["g"]: r for r in Q.least_determinants(stats, ["g"], NAMES).collect()}
    judged = {(r["g"], r["i"]): r["distance"] for r in Q.robust_distance(stats, ["g"], NAMES).collect()}
    for g, x in groups.items():
        log_det, mean, cov = _plain(x, np.array(list(NAMES.values())), 100, rng)
        r = found[g]
        factor = np.array([[r[f"l_{i}_{j}"] if j <= i else 0 for j in range(3)] for i in range(3)])
        assert abs(np.linalg.slogdet(factor @ factor.T)[1] - r["log_det"]) < 1e-6
        assert r["log_det"] <= log_det + 0.03  # quantiles are approximate
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        d = d * min(1, Q.CHI2_SUBSET / np.sort(d)[int(np.ceil(Q.SUBSET * len(x))) - 1])
        own = np.array([judged[g, i] for i in range(len(x))])
        assert ((own > 16) == (d > 16)).mean() > 0.99
        if g.startswith(("cluster", "line")):
            assert (own[: len(x) // 6] > 9).mean() > (0.99 if g.startswith("cluster") else 0.7)


def test_each_start_is_compared(spark, monkeypatch):
    """More starts never give a larger determinant, and further steps never a larger one than the first."""
    rng = np.random.default_rng(6)
    x = _data(rng, 400, "line")
    stats = Q.cut(spark.createDataFrame([("g", *map(float, v)) for v in x], "g string, a double, b double, c double"), "t")
    whole = Q.least_determinants(stats, ["g"], NAMES).first()["log_det"]
    near = lambda df: df
    starts = Q._starts(stats, ["g"], NAMES, near)
    assert starts.count() == Q.STARTS
    each = [Q.concentrated(stats, Q.concentrated(stats, starts.filter(f"start = {k}").drop("start"), ["g"], NAMES, near), ["g"], NAMES, near).first()["log_det"] for k in range(Q.STARTS)]
    assert whole <= min(each) + 1e-9


def test_groups_without_spread(spark):
    rows = [("same", 1.0, 1.0, 1.0)] * 5 + [("one", 2.0, 0.0, 0.0)] + [("two", float(i), 0.0, 0.0) for i in range(2)]
    stats = Q.cut(spark.createDataFrame(rows, "g string, a double, b double, c double"), "t")
    got = Q.robust_distance(stats, ["g"], NAMES).collect()
    assert len(got) == 8 and all(r["distance"] == 0 for r in got if r["g"] in ("same", "one"))
    assert Q.robust_distance(Q.cut(stats.limit(0), "none"), ["g"], NAMES).count() == 0
