import datetime as dt

from trellisq.operators.references import Reference, orphan_counts, orphans

CHILD = "row_no long, k string, day date, loaded_at timestamp_ntz, salt int"
PARENT = "k string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, extra string"
REFS = (Reference("kids", "k", "folk", "k", "day"),)


def at(d, h=0):
    return dt.datetime(2025, 1, d, h)


def run(spark, kids, folk, **kw):
    tables = {"kids": spark.createDataFrame([(*k, 0) for k in kids], CHILD), "folk": spark.createDataFrame([(*f, "x") for f in folk], PARENT)}
    return orphans(tables, REFS, **kw)


def brute(kids, folk):
    out = set()
    for no, k, _, loaded in kids:
        if k is None or not k.strip():
            continue
        ok = any(p and p.strip() == k.strip() and since is not None and loaded is not None and since <= loaded and (gone is None or gone > loaded) for p, since, gone in folk)
        if not ok:
            out.add(no)
    return out


def test_against_brute_force(spark):
    import random

    random.seed(3)
    folk = [(f"{random.choice(['', ' '])}k{i % 9}", at(random.randint(1, 20)) if i % 7 else None, random.choice([None, at(random.randint(10, 28))])) for i in range(25)]
    kids = [(i, random.choice([None, "", " ", "k1", "k1", "k1", f"k{random.randint(0, 12)} "]), dt.date(2025, 1 + i % 3, 1), at(random.randint(1, 28)) if i % 50 else None) for i in range(900)]
    got = run(spark, kids, folk).collect()
    assert {r.row_no for r in got} == brute(kids, folk)
    assert len(got) == len({r.row_no for r in got})
    assert {r.row_no for r in run(spark, kids, folk).collect()} == brute(kids, folk)


def test_reasons_and_counts(spark):
    folk = [("a", at(5), at(10)), ("b", at(5), None)]
    kids = [(1, "a", dt.date(2025, 1, 1), at(3)), (2, "a", dt.date(2025, 1, 1), at(12)), (3, "c", None, at(6)), (4, "b", dt.date(2025, 2, 1), at(6)), (5, "a", dt.date(2025, 1, 1), at(7)), (5, "a", dt.date(2025, 1, 1), at(12))]
    got = run(spark, kids, folk)
    assert sorted((r.row_no, r.reason) for r in got.collect()) == [(1, "later"), (2, "withdrawn"), (3, "missing"), (5, "withdrawn")]
    counts = {(r.period, r.n, r.n_later, r.n_withdrawn, r.n_missing) for r in orphan_counts(got).collect()}
    assert counts == {("2025-01", 3, 1, 2, 0), (None, 1, 0, 0, 1)}


def test_empty_tables(spark):
    assert run(spark, [], [("a", at(1), None)]).count() == 0
    assert run(spark, [(1, "a", None, at(1))], []).count() == 1


def test_a_hot_key_is_joined_in_parts(spark, monkeypatch):
    from trellisq.operators import skew

    later, day = dt.datetime(2025, 5, 1), dt.date(2025, 4, 1)
    rows = [(i, "hot", None, day, dt.datetime(2025, 1, 1 + i % 28)) for i in range(60)] + [(100, "cold", None, day, later)]
    kids = spark.createDataFrame(rows, "row_no long, stop_id string, trip_id string, service_date date, loaded_at timestamp_ntz")
    empty = lambda ddl: spark.createDataFrame([], ddl)
    ends = "loaded_at timestamp_ntz, deleted_at timestamp_ntz"
    tables = {
        "stop_times": kids,
        "stops": spark.createDataFrame([("hot", dt.datetime(2025, 1, 10), None)], f"stop_id string, {ends}"),
        "trips": empty(f"trip_id string, route_id string, row_no long, service_date date, {ends}"),
        "routes": empty(f"route_id string, {ends}"),
        "pathways": empty("from_stop_id string, row_no long, published_on date, loaded_at timestamp_ntz"),
    }
    monkeypatch.setattr(skew.spread_join, "__defaults__", ("inner", 7))
    got = sorted((r.row_no, r.reason) for r in orphans(tables).collect())
    assert got == [(i, "later") for i in range(60) if 1 + i % 28 < 10] + [(100, "missing")]
