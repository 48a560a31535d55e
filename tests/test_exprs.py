import math

from pyspark.sql import functions as F

from trellisq.functions import exprs as E


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_parse_time(spark):
    cases = {"08:00:10": 28810, "8:00:10": 28810, "25:01:01": 90061, "-00:00:21": -21, " 00:00:05 ": 5, "-1:02:03": -3723, "": None, "8:0:1": None, "x": None, "08:00": None, None: None, "08:00:1a": None, "--1:00:00": None}
    got = values(spark, [(k,) for k in cases], "t string", E.parse_time("t"))
    assert [g[0] for g in got] == list(cases.values())


def test_format_time(spark):
    cases = {-21.0: ("-00:00:21", "-0:21"), 90061.0: ("25:01:01", "25:01:01"), 2.5: ("00:00:02", "0:02"), 3.5: ("00:00:04", "0:04"), 0.0: ("00:00:00", "0:00"), -0.4: ("-00:00:00", "0:00"), 125.0: ("00:02:05", "2:05"), None: (None, None)}
    got = values(spark, [(k,) for k in cases], "x double", E.format_time("x"), E.format_short("x"))
    assert got == list(cases.values())


def test_differences_and_hours(spark):
    rows = [(86370, 70), (10, 20), (20, 10), (0, 90000), (-21, 0)]
    got = values(spark, rows, "a int, b int", E.wrapped_diff(F.col("a"), F.col("b")), E.near_diff(F.col("a"), F.col("b")), E.hour_bucket(F.col("a")))
    assert [g[0] for g in got] == [100, 10, 86390, 90000, 21]
    assert [g[1] for g in got] == [100, 10, -10, 3600, 21]
    assert [g[2] for g in got] == [23, 0, 0, 0, 23]


def test_half_up_mean(spark):
    for xs, want in (([1, 2], 2), ([1, 1, 2], 1), ([], 0), ([None], 0), ([10**12, 10**12 + 1], 10**12 + 1), ([3], 3)):
        df = spark.createDataFrame([(x,) for x in xs], "x long")
        assert df.agg(E.half_up_mean("x")).first()[0] == want
    assert spark.createDataFrame([(1,)], "x long").agg(E.sample_stdev("x")).first()[0] == 0.0
    assert spark.createDataFrame([], "x long").agg(E.sample_stdev("x")).first()[0] is None


def test_dotted_key(spark):
    ids = ["1.10", "1.9", "1.9140", "1.914", "E.11", "", "1.x.3", "1.91.11426565"]
    got = values(spark, [(i,) for i in ids], "id string", *E.dotted_key("id"))
    assert got == [(1, 10, 0), (1, 9, 0), (1, 9140, 0), (1, 914, 0), (0, 11, 0), (0, 0, 0), (1, 0, 3), (1, 91, 11426565)]


def test_flat_distance(spark):
    (d,) = values(spark, [(41.0, 2.0, 41.0, 2.1)], "a double, b double, c double, d double", E.flat_distance(*map(F.col, "abcd")))[0]
    assert abs(d - math.radians(0.1) * math.cos(math.radians(41)) * 6371000) < 1e-6
