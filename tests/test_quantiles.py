"""Exact percentiles against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from callsight.operators.quantiles import FINE_BIN, exact_percentiles, percentiles

PROBS = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}


def expected(values, p):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    rank = p * (len(values) - 1)
    lo, hi = values[math.floor(rank)], values[math.ceil(rank)]
    return lo if lo == hi else lo + (hi - lo) * (rank - math.floor(rank))


def groups():
    rnd = random.Random(7)
    return {
        "spread": [rnd.expovariate(1 / 300) for _ in range(999)],
        "one hot value": [12.5] * 700 + [rnd.uniform(0, 100) for _ in range(300)],
        "one narrow bin": [100 + i * 1e-9 for i in range(400)],
        "signs": [rnd.uniform(-1e6, 1e6) for _ in range(501)] + [0.0, -0.0],
        "huge": [10.0 ** rnd.randint(-300, 300) * rnd.choice([-1, 1]) for _ in range(200)],
        "small": [3.0],
        "pair": [1.0, 2.0],
        "with nulls": [None, 5.0, None, 7.0],
        "only nulls": [None, None],
        None: [1.0, 9.0],
    }


def test_exact(spark):
    data = groups()
    rows = [(k, v) for k, vs in data.items() for v in vs]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    found = exact_percentiles(df, ["k"], "v", PROBS, {"n": F.count(F.lit(1)), "s": F.count("v")}).collect()
    assert {r.k for r in found} == set(data) and len(found) == len(data)
    for row in found:
        values = data[row.k]
        assert (row.n, row.s) == (len(values), sum(v is not None for v in values))
        for name, p in PROBS.items():
            want = expected(values, p)
            assert row[name] == (want if want is None else pytest.approx(want, rel=1e-12)), (row.k, name)


def test_without_keys_and_without_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "v double")
    assert exact_percentiles(df, [], "v", {"p": 0.25}).first().p == 25.0
    empty = exact_percentiles(df.where("v < 0"), [], "v", {"p": 0.25}, {"n": F.count("v")}).collect()
    assert [(r.n, r.p) for r in empty] == [(None, None)]
    keyed = exact_percentiles(df.where("v < 0").withColumn("k", F.lit(1)), ["k"], "v", {"p": 0.5})
    assert keyed.collect() == []


@pytest.mark.parametrize("mode,error", [("exact", 0.0), ("approx", 0.001), ("sketch", 0.02)])
def test_modes_agree(spark, mode, error):
    n = 20000
    df = spark.range(n).selectExpr("cast(id * 7919 % 20000 as double) as v", "id % 3 as k")
    rows = percentiles(mode)(df, ["k"], "v", {"a": 0.5, "b": 0.95}, {"n": F.count("v")}).collect()
    assert sorted(r.k for r in rows) == [0, 1, 2] and sum(r.n for r in rows) == n
    for r in rows:
        assert abs(r.a - n * 0.5) <= n * max(error, 0.0005) and abs(r.b - n * 0.95) <= n * max(error, 0.0005)


@pytest.mark.parametrize("mode", ["exact", "approx", "sketch"])
def test_several_groupings(spark, mode):
    rnd = random.Random(3)
    rows = [(rnd.choice(["x", "y", None]), rnd.randint(0, 2), rnd.choice([None, float(rnd.randint(0, 40))])) for _ in range(600)]
    df = spark.createDataFrame(rows, "a string, b int, v double")
    sets = [[], ["a"], ["b"], ["a", "b"]]
    found = percentiles(mode)(df, ["a", "b"], "v", {"p": 0.5}, {"n": F.count(F.lit(1))}, sets=sets).collect()
    want = {}
    for number, keys in enumerate(sets):
        for a, b, v in rows:
            want.setdefault((number, a if "a" in keys else None, b if "b" in keys else None), []).append(v)
    assert len(found) == len(want) == 1 + 3 + 3 + 9
    for r in found:
        values = want[r["set"], r.a, r.b]
        assert r.n == len(values) and abs(r.p - expected(values, 0.5)) <= (0 if mode == "exact" else 3)


def test_rows_are_read_once(spark, tmp_path):
    """One scan and one exchange of the rows, whatever the adaptive plan becomes; the steps read the counts."""
    spark.range(20_000).selectExpr("id % 7 as k", "cast(id % 999 as double) as v", "id as w").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t").dropDuplicates(["w"])
    for sets in (None, [[], ["k"]]):
        got = exact_percentiles(df, ["k"], "v", {"p": 0.5, "q": 0.99}, {"n": F.count(F.lit(1)), "s": F.sum("w")}, sets)
        assert got.agg(F.sum("n")).first()[0] == (20_000 if sets is None else 40_000)
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning(w#") == 1
        assert plan.count("ReusedExchange") == 2


def test_unknown_mode():
    with pytest.raises(ValueError):
        percentiles("guess")


def test_tiny_values_do_not_share_a_bin(spark):
    values = spark.range(100_000).selectExpr("(id + 1) * 3e-11 as _v").selectExpr("*", f"{FINE_BIN} as b")
    assert values.groupBy("b").count().agg(F.max("count")).first()[0] <= 2
    df = values.selectExpr("'g' as k", "_v as v").union(spark.sql("select 'g', -0.0D")).union(spark.sql("select 'g', -1e-300D"))
    got = exact_percentiles(df, ["k"], "v", {"p": 0.5, "low": 0.0}).first()
    assert got.p == pytest.approx(49_999.5 * 3e-11) and got.low == -1e-300
