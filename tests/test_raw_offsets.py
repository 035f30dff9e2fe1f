"""Offsets of written records: dense, in the order of time, the same for a repeated write."""

from pyspark.sql import functions as F

from callsight.sources import raw
from checks import inputs


def events(spark, low, high):
    """A third of all events belong to one session."""
    return spark.range(low, high, 1, 5).selectExpr(
        "concat('r', id) as request_id", "if(id % 3 = 0, 'hot', concat('s', id % 50)) as session_id",
        "timestamp_seconds(1704067200 + pmod(xxhash64(id), 5000)) as created_at",
    )


def records(spark, path):
    rows = raw.read_raw(spark, path).withColumn("at", F.get_json_object(F.col("value").cast("string"), "$.created_at"))
    return rows.select("partition", "offset", "key", "at").collect()


def test_offsets_are_dense_and_keep_the_order_of_time(spark, tmp_path):
    path = str(tmp_path / "raw")
    raw.write_raw(events(spark, 0, 3000), path, "1")
    first = sorted(map(tuple, records(spark, path)))
    raw.write_raw(events(spark, 3000, 4000), path, "2")
    both = sorted(map(tuple, records(spark, path)))
    raw.write_raw(events(spark, 0, 3000), path, "1")
    raw.write_raw(events(spark, 3000, 4000), path, "2")
    assert sorted(map(tuple, records(spark, path))) == both and set(first) < set(both) and len(both) == 4000
    for p in range(raw.RAW_PARTITIONS):
        own = [r for r in both if r[0] == p]
        assert [r[1] for r in own] == list(range(len(own))) and own
        n = len([r for r in first if r[0] == p])
        for part in (own[:n], own[n:]):  # by batch
            assert [r[3] for r in part] == sorted(r[3] for r in part)
    partitions = {}
    for p, _, key, _ in both:
        partitions.setdefault(key, set()).add(p)
    assert all(len(ps) == 1 for ps in partitions.values())


def test_numbers_within_a_hot_value_and_without_rows(spark):
    rows = spark.range(0, 5000, 1, 6).selectExpr("if(id % 10 < 9, 'hot', concat('k', id % 3)) as k", "pmod(xxhash64(id), 700) as v", "id")
    got = raw.numbered(rows, ["k", "v", "id"], "k").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.k, r.v, r.id)):
        assert r.number == by.get(r.k, 0)
        by[r.k] = r.number + 1
    assert sum(by.values()) == 5000
    assert raw.numbered(rows.where("false"), ["k", "v", "id"], "k").count() == 0


def test_records_are_made_once_for_the_ranges(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        made.add(1)
        return i

    rows = spark.range(0, 400, 1, 4).select(F.lit("k").alias("k"), counted("id").alias("v"))
    assert raw.numbered(rows, ["k", "v"], "k").where("number = v").count() == 400
    assert made.value == 400


def test_a_file_of_one_part_is_dealt_out_before_records_are_made_of_it(spark, sf):
    plan = inputs.raw_records(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("get_json_object") < plan.index("RebalancePartitions") < plan.index("Relation")
