import datetime as dt
import math
import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trellisq.llm import digest as D

ST = "row_no long, trip_id string, stop_id string, arrival_time string, departure_time string, service_date date, metric string"


def disc(values, q):
    return sorted(values)[max(math.ceil(q * len(values) - 1e-9), 1) - 1]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(-50, 50), max_size=30), min_size=1, max_size=6))
def test_small_groups_are_exact(groups):
    g = np.array([i for i, x in enumerate(groups) for _ in x], np.int64)
    v = np.array([y for x in groups for y in sorted(x)], np.float64)
    est, n = D.quantiles(D.cluster(g, v, np.ones(len(v)), v, v), len(groups))
    for i, x in enumerate(groups):
        assert n[i] == len(x)
        if x:
            assert est[i].tolist() == [disc(x, q) for q in D.QUANTILES]


def test_merged_parts_keep_the_bound():
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.lognormal(3, 1, 60_000), np.full(20_000, 30.0)])
    rng.shuffle(values)
    parts = [D.cluster(np.zeros(len(p), np.int64), p, np.ones(len(p)), p, p) for p in np.array_split(values, 50)]
    joined = [np.concatenate([getattr(p, f) for p in parts]) for f in ("group", "mean", "weight", "low", "high")]
    d = D.cluster(*joined)
    assert len(d.mean) <= D.DELTA / 2 + 2 and d.weight.sum() == len(values)
    est, n = D.quantiles(d, 1)
    s, g = np.sort(values), np.zeros(len(values), np.int64)
    for j, q in enumerate(D.QUANTILES):
        below, upto = (D.count_below(g, s, 1, est[:, j], side) for side in ("left", "right"))
        assert below[0] == (s < est[0, j]).sum() and upto[0] == (s <= est[0, j]).sum()
        assert D.rank_error(q, below, upto, n)[0] < 0.01


def rows(seed, n=3000):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randint(0, 90000)
        t = lambda x: f"{x // 3600}:{x // 60 % 60:02d}:{x % 60:02d}"
        out.append((i, "t", rng.choice(["hot", "hot", " hot ", "b", "c", None, " "]), rng.choice([None, t(a)]), t(a + rng.randint(-5, 60)) if a > 5 else None, dt.date(2025, 3, 1 + rng.randint(0, 3)), "clash"))
    return out


def expected(data):
    by = defaultdict(list)
    for _, _, stop, a, d, day, _ in data:
        if not stop or not stop.strip() or not a:
            continue
        sec = lambda x: sum(int(p) * f for p, f in zip(x.split(":"), (3600, 60, 1)))
        for key_day in (day, None):
            by[stop.strip(), key_day, "time_of_day"].append(sec(a) % 86400)
            if d:
                by[stop.strip(), key_day, "dwell"].append((sec(d) - sec(a) + 43200) % 86400 - 43200)
    return by


def check(df, data, bound):
    want = expected(data)
    got = {(r.stop_id, r.service_date, r.metric): r for r in df.collect()}
    assert got.keys() == want.keys()
    for k, values in want.items():
        r, s = got[k], np.sort(values)
        assert r.n == len(values) and r.rank_error <= bound
        worst = 0
        for q, x in zip(D.QUANTILES, (r.p10, r.p25, r.p50, r.p75, r.p90)):
            rank = max(math.ceil(q * len(s) - 1e-9), 1)
            lt, le = (s < x).sum(), (s <= x).sum()
            worst = max(worst, (lt + 1 - rank) / len(s), (rank - max(le, lt)) / len(s), 0)
        assert abs(worst - r.rank_error) < 1e-12


def test_table(spark):
    data = rows(1)
    check(D.stop_percentiles(spark.createDataFrame(data, ST)), data, 0.01)


def test_large_groups_are_cut(spark):
    data = rows(2)
    values = D.stop_values(spark.createDataFrame(data, ST))
    days = D.daily_digests(values, split_rows=100)
    whole = D.certify(values, D.merge(days, ["stop_id"], list(D.METRICS)), ["stop_id"], list(D.METRICS))
    from pyspark.sql import functions as F

    check(D._result(days, F.col("service_date")).unionByName(D._result(whole, F.lit(None).cast("date"))), data, 0.02)


def test_empty(spark):
    assert D.stop_percentiles(spark.createDataFrame([], ST)).count() == 0


def test_rows_without_a_day_count_over_all_days(spark):
    day = dt.date(2025, 3, 1)
    data = [(i, "t", stop, "8:00:00", f"8:00:{i:02d}", d, "") for i, (stop, d) in enumerate([("a", day)] * 5 + [("a", None)] * 20 + [("b", None)] * 4)]
    got = {(r.stop_id, r.service_date): (r.n, r.p50, r.rank_error) for r in D.stop_percentiles(spark.createDataFrame(data, ST)).where("metric = 'dwell'").collect()}
    assert got == {("a", day): (5, 2.0, 0.0), ("a", None): (25, 12.0, 0.0), ("b", None): (4, 26.0, 0.0)}
