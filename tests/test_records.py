import hashlib

from pyspark.sql import functions as F

from provenant.operators import binding, records


def test_seal(spark):
    want = hashlib.sha256('{"a": [1, 2.5], "b": "é"}'.encode()).hexdigest()
    rows = [f'{{"b":"é","record_sha256":"{want}","a":[1,2.5]}}', '{"b":"é","a":[1,2.5]}', "[1]", "{", "", None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string")
    got = df.orderBy("i").select(records.seal_of(F.col("r")).alias("d"), records.sealed(F.col("r")).alias("s")).collect()
    assert [tuple(g) for g in got] == [(want, True), (want, False)] + [(None, False)] * 4


def test_binding(spark):
    claims = spark.createDataFrame([("k", "P1", "Inside here", "y"), ("k", "p2", "elsewhere", "y"), ("k", "p9", "x", "y"), ("k", "p2", None, "y"), ("k", None, "x", "y"), ("coarse", "p1", "not in it", "z"), ("bare", "p1", "x", None)], "key string, locus string, quote string, stamp string")
    manifests = spark.createDataFrame([("k", "y", None), ("coarse", "y", False)], "key string, source_sha256 string, fully_enumerable boolean")
    units = spark.createDataFrame([("k", "p1", "It is inside, here."), ("k", "p2", "two"), ("coarse", "p1", None)], "key string, locus string, text string")
    got = sorted(((r.key, r.locus or "", r.problem, r.hard) for r in binding.problems(claims, manifests, units).collect()))
    assert got == [("bare", "", "no manifest", True), ("coarse", "", "other bytes", False), ("coarse", "p1", "outside", False), ("k", "p2", "no quote", True), ("k", "p2", "outside", True), ("k", "p9", "unknown locus", True)]
    assert binding.problems(claims.limit(0), manifests.limit(0), units.limit(0)).count() == 0
