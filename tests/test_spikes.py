import datetime as dt
import random
from collections import defaultdict

import numpy as np

from trellisq.operators.spikes import ALPHA, MAX_SHARE, NORMAL_SPAN, Cells, anomalies, decompose, esd_limit, esd_steps, outliers, spikes, stop_time_readings

ST = "row_no long, trip_id string, stop_sequence int, stop_id string, arrival_time string, departure_time string, service_date date, code string"
PW = "row_no long, pathway_id string, traversal_time int, published_on date"


def clock(s):
    return f"{'-' if s < 0 else ''}{abs(s) // 3600:02d}:{abs(s) // 60 % 60:02d}:{abs(s) % 60:02d}"


def sec(t):
    if t is None:
        return None
    n = t.startswith("-")
    h, m, s = t.lstrip("-").split(":")
    v = int(h) * 3600 + int(m) * 60 + int(s)
    return -v if n else v


def near(a, b):
    return None if a is None or b is None else (b - a + 43200) % 86400 - 43200


def brute(st, pw):
    """The rule of the data, row by row."""
    out, first = set(), {}
    for r in sorted(st):
        no, trip, seq, stop = r[:4]
        if not trip or not trip.strip() or not stop or not stop.strip() or seq is None:
            continue
        first.setdefault((trip.strip(), seq), (no, stop.strip(), sec(r[4]), sec(r[5])))
    readings = defaultdict(list)
    for (trip, seq), (no, stop, a, d) in first.items():
        dwell = near(a, d)
        if dwell is not None:
            readings["d", stop].append(("stop_times", no, dwell))
            if dwell < 0:
                out.add(("stop_times", no))
        before = first.get((trip, seq - 1))
        run = near(before[3], a) if before else None
        if run is not None:
            readings["r", before[1], stop].append(("stop_times", no, run))
            if run <= 0:
                out.add(("stop_times", no))
        for start in range(seq - 3, seq + 1):
            four = [first.get((trip, k)) for k in range(start, start + 4)]
            if all(four) and a is not None and all(x[2] == a and x[3] == a for x in four):
                out.add(("stop_times", no))
    once = {}
    for no, pid, t, day in sorted(pw, key=lambda r: r[0]):
        if pid and pid.strip():
            once.setdefault((pid.strip(), day), (no, t))
    for (pid, _), (no, t) in once.items():
        if t is not None:
            readings["t", pid].append(("pathways", no, t))
            if t <= 0:
                out.add(("pathways", no))
    for rows in readings.values():
        if len(rows) < 12:
            continue
        p10, med, p90 = np.percentile([v for _, _, v in rows], [10, 50, 90])
        out |= {(t, n) for t, n, v in rows if abs(v - med) > 20 and abs(v - med) > 3 * (p90 - p10)}
    return out


def data(seed, trips=160):
    rng = random.Random(seed)
    st, no = [], 0
    for k in range(trips):
        t = rng.randint(0, 86000)
        for seq in range(1, 9):
            stop = "hot" if rng.random() < 0.3 else f"s{seq}"
            t += rng.choice([90, 95, 100, 105, 600 if rng.random() < 0.05 else 98])
            arr = t
            t += rng.choice([20, 25, 30, 0, 900 if rng.random() < 0.05 else 22, -40 if rng.random() < 0.05 else 21])
            row = [f"t{k}", seq, stop, clock(arr), clock(t)]
            if rng.random() < 0.03:
                row[rng.randrange(5)] = None
            if rng.random() < 0.02:
                row[0] = f" {row[0]} " if row[0] else " "
            no += 1
            st.append((no, *row))
            if rng.random() < 0.03:
                no += 1
                st.append((no, row[0], row[1], row[2], clock(5), row[4]))
        if k % 10 == 0:
            x = clock(rng.randint(0, 80000))
            for seq in range(12, 12 + rng.choice([3, 4, 6])):
                no += 1
                st.append((no, f"t{k}", seq, "z", x, x))
    pw = [(i, f"p{i % 7}", rng.choice([60, 62, 64, 66, None, 0 if rng.random() < 0.1 else 61, 400 if rng.random() < 0.1 else 63]), dt.date(2025, 3, 1) + dt.timedelta(days=i // 7)) for i in range(300)]
    pw += [(1000 + i, f"p{i % 7}", 9999, dt.date(2025, 3, 1)) for i in range(7)]
    return st, pw


def run(spark, st, pw, **kw):
    rows = [(*r, dt.date(2025, 1 + r[0] % 6, 3), "clash") for r in st]
    got = spikes(spark.createDataFrame(rows, ST), spark.createDataFrame(pw, PW), **kw).collect()
    assert len(got) == len(set(map(tuple, got)))
    return {(r.table_name, r.row_no) for r in got}


def test_against_brute_force(spark):
    for seed in (1, 2):
        st, pw = data(seed)
        want = brute(st, pw)
        assert len(want) > 40
        assert run(spark, st, pw) == want


def test_long_trip_over_blocks(spark):
    x = clock(30000)
    st = [(i, "t", i, "s", x, x) for i in range(4090, 4100)] + [(9000 + i, "u", i, "s", clock(100 * i), clock(100 * i + 10)) for i in range(4090, 4100)]
    got = run(spark, st, [])
    assert got == {("stop_times", i) for i in range(4090, 4100)}
    whole = stop_time_readings(spark.createDataFrame([(*r, None, "c") for r in st], ST), block=4096).where("source like 'r%'").count()
    assert whole == 18


def test_extreme_and_missing_times(spark):
    st = [(1, "t", 1, "s", None, "-596000:00:00"), (2, "t", 2, "s", "-596000:00:00", None), (3, "t", 3, "s", "596000:00:00", "00:00:10"), (4, "t", 4, "s", "00:00:05", "00:00:01"), (5, "t", 5, "s", None, None)]
    assert run(spark, st, []) == brute(st, []) == {("stop_times", 2), ("stop_times", 3), ("stop_times", 4)}


def test_empty_and_null(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [(1, None, None, None, None, None)], [(1, None, None, None)]) == set()


def esd_brute(values, span):
    """The sequential test reading by reading: {value: whether it is an outlier} (equal readings together)."""
    left, gone, decided = sorted(values), [], 0
    most = int(np.floor(len(values) * MAX_SHARE)) + 1
    while left and len(gone) < most:
        q10, med, q90 = np.percentile(left, [10, 50, 90])
        scale = min((q90 - q10) / NORMAL_SPAN, span / NORMAL_SPAN)
        v = left[-1] if left[-1] - med >= med - left[0] else left[0]
        if abs(v - med) == 0:
            break
        if abs(v - med) > esd_limit(np.array(len(values)), len(gone) + 1, ALPHA) * scale:
            decided = len(gone) + 1
        gone += [(v, len(gone) + 1)] * left.count(v)
        left = [x for x in left if x != v]
    return {v: step <= decided for v, step in gone}


def test_sequential_test_against_brute_force():
    rng = np.random.default_rng(4)
    sources = [np.round(np.concatenate([rng.normal(0, s, n), rng.normal(0, 40 * s, n // 20 + 1)])) for s, n in ((5, 15), (3, 400), (1, 90), (30, 2000), (0.2, 50))]
    g = np.concatenate([np.full(len(x), k) for k, x in enumerate(sources)])
    span = np.array([np.subtract(*np.percentile(x, [90, 10])) for x in sources])
    flagged, step, bound = esd_steps(g, np.concatenate(sources), np.ones(len(g), np.int64), span)
    for k, x in enumerate(sources):
        want = esd_brute(x.tolist(), span[k])
        assert {v for v, yes in want.items() if yes} == set(x[flagged[g == k]])
        assert (step[g == k][flagged[g == k]] > 0).all() and (bound[g == k] >= 0).all()


def test_equal_readings_counted_or_listed():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(100, 4, 500)).astype(np.int64)
    x[:6] = 400
    month, pos = rng.integers(1, 7, 500), rng.integers(1, 5, 500)
    zero = np.zeros(500, np.int64)
    listed = outliers(Cells(zero, x, month, pos, zero + 1), None)
    cells, at, n = np.unique(np.stack([x, month, pos]), axis=1, return_index=True, return_counts=True)
    counted = outliers(Cells(zero[: len(n)], *cells, n), None)
    assert set(x[listed["index"]]) == set(cells[0][counted["index"]]) == {400}
    assert counted["uses"].max() == 6 and listed["total"].max() == 500


def test_trend_and_season_are_found():
    rng = np.random.default_rng(6)
    n = 6000
    month, pos = rng.integers(1, 13, n), rng.integers(1, 5, n)
    true = 100 + 5 * month + np.array([0, -30, 30, 0, 0])[pos]
    value = np.round(true + rng.normal(0, 3, n)).astype(np.int64)
    spike = rng.choice(n, 40, replace=False)
    value[spike] += rng.choice([-45, 45], 40)
    zero = np.zeros(n, np.int64)
    cells = Cells(zero, value, month, pos, zero + 1)
    level, span = np.array([np.median(value)]), np.array([np.subtract(*np.percentile(value, [90, 10]))])
    residual = decompose(cells, level, span)
    clean = np.delete(residual, spike)
    assert np.abs(clean).mean() < 4 and abs(residual[spike]).min() > 25
    got = set(outliers(cells, None)["index"].tolist())
    assert set(spike.tolist()) <= got and len(got) < 60
    # without the decomposition the spikes lie within the spread of months and hours
    assert len(set(spike.tolist()) & set(np.flatnonzero(esd_steps(zero, value - level[0], zero + 1, span)[0]).tolist())) < 20


def test_anomalies_table(spark):
    st, pw = data(3)
    got = anomalies(spark.createDataFrame([(*r, dt.date(2025, 1 + r[0] % 6, 3), "clash") for r in st], ST), spark.createDataFrame(pw, PW)).collect()
    assert {r.reading for r in got} == {"dwell", "run", "traversal_time"} and all(abs(r.residual) > 0 and r.step > 0 for r in got)
    assert len({(r.table_name, r.row_no, r.reading) for r in got}) == len(got)
    assert anomalies(spark.createDataFrame([], ST), spark.createDataFrame([], PW)).count() == 0


def test_a_hot_value_is_joined_in_parts(spark, monkeypatch):
    from trellisq.operators import skew

    st, pw = data(7)
    want = brute(st, pw)
    monkeypatch.setattr(skew.spread_join, "__defaults__", ("inner", 1))
    assert run(spark, st, pw) == want


def test_large_blocks_and_sources_are_combined_first(spark, monkeypatch):
    from trellisq.operators import skew, spikes as module

    st, pw = data(8)
    st += [(5000 + i, "t1", 3, "hot", clock(i), clock(i)) for i in range(40)]
    want = brute(st, pw)
    tables = lambda: (spark.createDataFrame([(*r, dt.date(2025, 1 + r[0] % 6, 3), "clash") for r in st], ST), spark.createDataFrame(pw, PW))
    plain = sorted(map(tuple, anomalies(*tables()).collect()))
    monkeypatch.setattr(module, "ROWS_PER_TASK", 9)
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (9,))
    assert run(spark, st, pw) == want
    assert sorted(map(tuple, anomalies(*tables()).collect())) == plain
