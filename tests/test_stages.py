import pytest
from pyspark.sql import functions as F

from trellisq.operators import checks as C
from trellisq.operators import stages as K
from trellisq.operators import stats as M
from trellisq.operators import timetable as T

LINES = {"1.1": ["1.10", "1.11", "1.12", "1.13", "1.14"], "1.2": ["1.20", "1.50", "1.51", "1.22"], "1.3": ["1.30", "1.50", "1.51", "1.32"]}


@pytest.fixture(scope="module")
def world(spark):
    trips, st, no = [], [], 0

    def trip(tid, line, direction, start, dwell=20, run=100, seqs=None, stops=None, same=False):
        nonlocal no
        trips.append((line, tid, direction, f"h{direction}", len(trips) + 1))
        order = stops or (LINES[line] if direction != 1 else LINES[line][::-1])
        t = start
        for k, stop in enumerate(order):
            no += 1
            clock = lambda s: f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
            end = k in (0, len(order) - 1)
            st.append((tid, (seqs or range(1, 99))[k], stop, clock(t), clock(t if end or same else t + dwell), no))
            t += (0 if end or same else dwell) + run

    for line in LINES:
        trip(f"{line}.a", line, 0, 30000)
        trip(f"{line}.b", line, 1, 40000, run=120)
        trip(f"{line}.c", line, 0, 86350)  # over midnight, hours above 23
    trip("1.1.same", "1.1", 0, 30000)  # equals 1.1.a
    trip("1.1.gap", "1.1", 0, 31000, stops=["1.10", "1.12", "1.13", "1.14"])  # a stop is skipped
    trip("1.1.one", "1.1", 0, 33000, stops=["1.12"])
    trip("lost", "9.9", 0, 30000, stops=LINES["1.1"])
    trip("blank", "1.1", None, 30000)
    st.append(("1.1.a", 1, "1.10", "23:00:00", "23:00:00", no + 1))  # repeated, later: not used
    routes = [(x, i) for i, x in enumerate([*LINES, "1.4"])]
    w = type("World", (), {})()
    w.trips = spark.createDataFrame(trips, "route_id string, trip_id string, direction_id int, trip_headsign string, row_no long")
    w.stop_times = spark.createDataFrame(st, "trip_id string, stop_sequence int, stop_id string, arrival_time string, departure_time string, row_no long")
    w.routes = spark.createDataFrame(routes, "route_id string, row_no long")
    w.ev = T.clean_stop_times(w.stop_times).cache()
    w.tr, w.gr = T.clean_trips(w.trips), T.trip_groups(w.trips, w.routes)
    w.rs = T.route_stops(w.ev, w.gr)
    w.order = T.line_order(w.rs)
    w.tx = T.transitions(w.ev, w.gr, w.rs)
    return w


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_model(world):
    assert rows(world.rs.where("line = '1.1'"), "pos", "stop_id") == list(enumerate(LINES["1.1"], 1))
    assert "lost" not in {r.trip_id for r in world.gr.collect()} and "blank" not in {r.trip_id for r in world.gr.collect()}
    assert T.expected_pairs(world.rs).count() == 2 * (4 + 3 + 3)
    assert world.ev.where("trip_id = '1.1.a' and seq = 1").first().arrival_time == "08:20:00"
    rank = {r.stop_id: r["rank"] for r in T.stop_rank(world.rs, world.order).collect()}
    assert rank["1.10"] == 0 and rank["1.20"] == 5 and rank["1.30"] == 9 and len(rank) == 11


def test_transitions_wrap_midnight(world):
    got = rows(world.tx.where("trip_id = '1.1.c'"), "a", "b", "total", "door", "run")
    assert got[0] == ("1.10", "1.11", 100, 0, 100) and got[1] == ("1.11", "1.12", 120, 20, 100)
    assert rows(world.tx.where("trip_id = '1.1.gap'"), "a", "b") == [("1.12", "1.13"), ("1.13", "1.14")]


def test_duplicates(world):
    dup = K.duplicate_trips(world.ev)
    assert rows(dup) == [("1.1.same", "1.1.a", 5), ("blank", "1.1.a", 5), ("lost", "1.1.a", 5)]
    assert rows(K.group_sizes(dup)) == [(4, 1, "1.1.a")]
    left = K.without(world.ev, dup)
    assert K.duplicate_trips(left).count() == 0  # verified again: none left


def test_order_violations_and_gaps(world):
    bad = K.order_violations(world.ev, world.tr, world.rs)
    assert rows(bad) == [("1.1.gap", "1.10", "1.12", 1, 2)]
    opened = K.open_gaps(world.ev, bad)
    assert rows(opened.where("trip_id = '1.1.gap'"), "seq", "stop_id") == [(1, "1.10"), (3, "1.12"), (4, "1.13"), (5, "1.14")]
    assert opened.count() == world.ev.count()
    assert K.order_violations(opened, world.tr, world.rs).count() == 0


def test_doors(world, spark):
    counts = K.dwell_counts(world.ev, world.tr)
    first = counts.where("line = '1.1' and stop_id = '1.10'").first()
    assert first.equal == first.terminal == first.total == 6 and len(first.samples) == 5 and first.samples[0] == "1.1.a"
    doors = {(r.stop_id, r.line): r.door_seconds for r in K.door_seconds(counts).collect()}
    assert doors["1.10", "1.1"] == 20 and doors["1.12", "1.1"] == 20
    ev = K.apply_door_times(world.ev, world.tr, K.door_seconds(counts))
    assert rows(ev.where("trip_id = '1.1.a' and seq in (1, 5)"), "arrival_time", "departure_time") == [("08:19:40", "08:20:00"), ("08:27:40", "08:28:00")]
    after = K.dwell_counts(ev, world.tr)
    assert C.equal_times_left(after).count() == 0
    assert rows(K.apply_door_times(ev, world.tr, K.door_seconds(counts))) == rows(ev)  # a second time changes nothing
    none = spark.createDataFrame([("t", 1, "s", "00:00:05", "00:00:05", 1)], world.ev.schema)
    trip = spark.createDataFrame([("t", "FM", 0, None, 1)], world.tr.schema)
    one = K.door_seconds(K.dwell_counts(none, trip))
    assert rows(one) == [("s", "FM", 0)]
    early = spark.createDataFrame([("s", "FM", 26)], "stop_id string, line string, door_seconds int")
    assert K.apply_door_times(none, trip, early).first().arrival_time == "-00:00:21"


def test_shared_platforms(world, spark):
    sh = K.shared_stops(world.rs, world.order)
    assert rows(sh, "original_stop_id", "line", "new_stop_id") == [("1.50", "1.2", "1.500"), ("1.50", "1.3", "1.501"), ("1.51", "1.2", "1.510"), ("1.51", "1.3", "1.511")]
    stops = spark.createDataFrame([("1.50", "50", "A"), ("1.10", "10", "B")], "stop_id string, stop_code string, stop_name string")
    assert rows(K.split_stop_rows(stops, sh)) == [("1.10", "10", "B"), ("1.500", "500", "A"), ("1.501", "501", "A")]
    pw = spark.createDataFrame([("PW.1.50_E.1", "1.50", "E.1", 60), ("PW.1.10_E.2", "1.10", "E.2", 60)], "pathway_id string, from_stop_id string, to_stop_id string, traversal_time int")
    got = rows(K.split_pathways(pw, sh, 15), "pathway_id", "traversal_time")
    assert ("PW.1.500_E.1", 60) in got and ("PW.1.500_1.501", 15) in got and ("PW.1.10_E.2", 60) in got and len(got) == 7
    both = spark.createDataFrame([("x", "1.50", "1.51", 60)], pw.schema)
    with pytest.raises(Exception, match="both sides"):
        K.split_pathways(both, sh, 15).collect()
    tf = spark.createDataFrame([("1.50", "1.10", 2, 90)], "from_stop_id string, to_stop_id string, transfer_type int, min_transfer_time int")
    assert K.split_transfers(tf, sh, K.least_transfer(tf).first()[0]).count() == 6
    ev = K.split_events(world.ev, world.tr, sh)
    assert rows(ev.where("trip_id = '1.3.a'"), "seq", "stop_id")[1] == (2, "1.501")


def test_weights_and_stats(world):
    w = K.edge_weights(world.ev, world.gr, world.rs, world.order)
    got = {(r.from_stop_id, r.to_stop_id): (r.weight_seconds, r.line) for r in w.collect()}
    assert got["1.50", "1.51"] == (120, "1.2/1.3") and got["1.11", "1.10"] == (140, "1.1") and got["1.10", "1.11"] == (100, "1.1")
    s = M.pair_stats(world.tx)
    asym = {(r.a, r.b): r.gap for r in M.directional_asymmetry(s).collect()}
    assert asym["1.11", "1.12"] == 20.0
    every = M.all_pair_stats(T.expected_pairs(world.rs), s)
    assert every.count() == 20
    assert {r.bucket: r.n for r in M.bucket_counts(M.cv_ranking(s), M.CV_BUCKETS).collect()}["extremely stable"] == 20
    assert rows(M.line_spread(s), "a", "b", "lines", "n_lines")[0] == ("1.50", "1.51", "1.2/1.3", 2)
    flagged = M.flagged_edges(M.cv_ranking(s), M.hourly_range(world.tx, s))
    v = M.verdict(M.cv_ranking(s), flagged).first()
    assert v.edges == 20 and v.passing == v.edges - v.flagged
    assert M.hourly(world.tx).agg(F.sum("n")).first()[0] == world.tx.count()
    ranked = K.with_ranks(w, T.stop_rank(world.rs, world.order)).orderBy(*K.canonical_order(w, world.rs)).first()
    assert (ranked.from_stop_id, ranked.to_stop_id) == ("1.10", "1.11")


def test_network_filter(spark):
    df = spark.createDataFrame([("2.1",), ("1.2",), (None,), (" 2.9",)], "id string")
    assert rows(K.network_filter(df).where("id is not null")) == [("1.2",)]
    assert K.network_filter(df).count() == 2
    assert tuple(K.network_counts(df).first()) == (4, 2, 2)
    assert tuple(K.network_counts(df.limit(0)).first()) == (0, 0, 0)


def test_checks(world, spark):
    assert rows(C.routes_without_trips(world.routes, world.tr)) == [("1.4",)]
    assert rows(C.sequence_gaps(K.open_gaps(world.ev, K.order_violations(world.ev, world.tr, world.rs)))) == [("1.1.gap", 1, 3)]
    issues = {r.line: r.issues for r in C.headsign_directions(world.tr).collect()}
    assert "1.2" not in issues and issues["1.1"] == "headsigns,directions,ambiguous" and issues["9.9"] == "headsigns,directions"
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "d")], "a string, b string")
    other = spark.createDataFrame([("b", "a"), ("e", "f"), (None, "x")], "a string, b string")
    assert rows(C.pair_differences(pairs, other)) == [("c", "d", "left"), ("e", "f", "right")]
    pw = spark.createDataFrame([("PW.1.1_E.1", "1.1", "E.1", 60, 1), ("PW.E.1_1.1", "E.1", "1.1", 70, 2), ("PW.1.2_E.2", "1.2", "E.2", None, 3)], "pathway_id string, from_stop_id string, to_stop_id string, traversal_time int, row_no long")
    assert rows(C.missing_inverse(pw)) == [("1.2", "E.2")]
    assert rows(C.invalid_times(pw), "pathway_id", "issue") == [("PW.1.2_E.2", "missing"), ("PW.E.1_1.1", "not_a_multiple")]
    assert rows(C.entrance_times(pw), "pathway_id") == [("PW.1.2_E.2",), ("PW.E.1_1.1",)]
    assert rows(C.uneven_times(spark.createDataFrame([("a", "b", 5), ("b", "a", 6), ("a", "c", 1), ("c", "a", 1)], "a string, b string, seconds int"))) == [("a", "b", 5, 6)]
    stops = spark.createDataFrame([(s, "N", i) for i, s in enumerate(["E.1", "E.2", "E.3", "1.1", "1.2", "1.3", "1.4"])], "stop_id string, stop_name string, row_no long")
    cover = C.coverage(pw)
    assert rows(C.entrance_distribution(stops, cover)) == [(0, 1), (1, 2)]
    near = spark.createDataFrame([("1.3", "1.1"), ("1.2", "1.3")], "a string, b string")
    assert rows(C.uncovered_platforms(stops, cover, near).where("neighbour is not null")) == [("1.3", "1.1", "E.1"), ("1.3", "1.2", "E.2")]
    assert C.uncovered_platforms(stops, cover, near).where("neighbour is null").first().platform == "1.4"
    assert tuple(C.same_name_transfers(stops, near).first()) == ("N", 4, 6, 2, 4)
    keys = C.foreign_keys({"k": stops.withColumn("f", F.lit(" x ")), "p": pw}, [("k", "f", "p", "pathway_id")])
    assert rows(keys) == [("k", "f", "x")]


def test_line_report(world, spark):
    names = spark.createDataFrame([("1.10", "Alpha"), ("E.1", "Door")], "stop_id string, stop_name string")
    pw = spark.createDataFrame([("1.10", "E.1"), ("E.1", "1.10"), ("1.11", "E.2")], "a string, b string")
    got = {(r.stop_id, r.entrance): (r.stop_name, r.entrance_name, r.direction) for r in M.line_report(world.rs, names, pw).collect()}
    assert got["1.10", "E.1"] == ("Alpha", "Door", "both") and got["1.11", "E.2"] == ("", None, "platform_to_entrance") and got["1.12", None] == ("", None, None)


def test_empty(world):
    none = world.ev.limit(0)
    assert T.transitions(none, world.gr, world.rs).count() == 0
    assert K.duplicate_trips(none).count() == 0 and K.door_seconds(K.dwell_counts(none, world.tr)).count() == 0
    assert M.cv_ranking(M.pair_stats(world.tx.limit(0))).count() == 0
