import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from trellisq.graph import model as G
from trellisq.graph import report as R
from trellisq.graph import search as S

EDGES = "from_stop_id string, to_stop_id string, weight_seconds int, type string, row_no long"


def random_graph(seed, n=14, m=40):
    rng = random.Random(seed)
    return {(str(a), str(b)): rng.randint(1, 20) for a, b in (rng.sample(range(n), 2) for _ in range(m))}


def adjacency(pairs):
    g = {}
    for (a, b), w in sorted(pairs.items()):
        g.setdefault(a, []).append((b, w))
        g.setdefault(b, [])
    return g


def floyd(pairs):
    nodes = sorted({x for p in pairs for x in p})
    d = {(a, b): 0 if a == b else pairs.get((a, b), float("inf")) for a in nodes for b in nodes}
    for k, a, b in itertools.product(nodes, nodes, nodes):
        d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    return nodes, d


@pytest.mark.parametrize("seed", range(6))
def test_searches_agree_with_floyd(seed):
    pairs = random_graph(seed)
    nodes, d = floyd(pairs)
    g = adjacency(pairs)
    exact = S.HeuristicTable({k: v for k, v in d.items() if v < float("inf")})
    for a in nodes:
        dist, parent, rank = S.dijkstra(g, a)
        assert dist == {b: d[a, b] for b in nodes if d[a, b] < float("inf")}
        for b in nodes:
            p = S.path(parent, a, b)
            assert sum(pairs[x] for x in zip(p, p[1:])) == dist.get(b, 0) and bool(p) == (b in dist)
            cut_dist, cut_parent, cut_rank = S.dijkstra(g, a, stop_at=b)
            if b in dist:
                assert len(cut_rank) == rank[b] and cut_dist[b] == dist[b] and S.path(cut_parent, a, b) == p
                low = sum(v < dist[b] for v in dist.values()) + 1
                assert low <= rank[b] <= sum(v <= dist[b] for v in dist.values())
            for h in (S.no_heuristic, exact):
                cost, _, n = S.a_star(g, a, b, h)
                assert (cost.get(b) if b in cost else None) == dist.get(b)
                assert h is not exact or b not in dist or n <= rank[b]


def table(spark, pairs):
    return spark.createDataFrame([(a, b, w, "SW", i) for i, ((a, b), w) in enumerate(pairs.items())], EDGES)


def test_tables_agree(spark):
    pairs = random_graph(9)
    nodes, d = floyd(pairs)
    e = G.edges(table(spark, pairs))
    want = {(a, b): d[a, b] for a in nodes for b in nodes if a != b and d[a, b] < float("inf")}
    rep = S.all_pairs(e, G.vertices(e))
    assert {(r.source, r.target): r.optimum_weight for r in rep.where("optimum_weight is not null").collect()} == want
    assert rep.count() == len(nodes) * (len(nodes) - 1)
    assert {(r.source, r.node): r.dist for r in S.relax(e, G.vertices(e)).where("source <> node").collect()} == want
    pairs_df = rep.select("source", "target")
    star = S.a_star_pairs(e, pairs_df, S.EXACT)
    R.optimum_gate({"dijkstra": rep, "a_star": star, "all": S.a_star_all(e, G.vertices(e), S.EXACT), "plain": S.a_star_all(e, G.vertices(e), S.no_heuristic)})
    with pytest.raises(AssertionError):
        R.optimum_gate({"dijkstra": rep, "other": rep.withColumn("optimum_weight", F.col("optimum_weight") + 1)})
    r = rep.where("proportion is not null").first()
    assert r.proportion == r.path_vertices / r.iterations == len(r.path) / r.iterations
    dist = spark.createDataFrame([(a, b, int(d[a, b])) for a in nodes for b in nodes if d[a, b] < float("inf")], "source string, node string, dist long")
    inside = R.settle_bounds(dist).join(rep, ["source", "target"]).where(F.col("iterations").between(F.col("low"), F.col("high"))).count()
    assert inside == len(want)
    assert R.report_means(rep).first().n == rep.count()
    assert rep.orderBy(*R.report_order()).first().proportion is not None


def test_last_edge_wins_and_modes(spark):
    rows = [("a", "b", 5, "SW", 1), ("a", "b", 7, "SW", 2), ("b", "E.1", 60, "PW", 3), ("E.1", "a", 60, "PW", 4), ("b", "a", 3, "TF", 5)]
    w = spark.createDataFrame(rows, EDGES)
    e = G.edges(w)
    assert {(r.src, r.dst): r.weight for r in e.collect()}["a", "b"] == 7
    assert G.edges(w, ("PW",)).count() == 2 and G.vertices(e).count() == 3
    stats = {r.type: (r.arcs, r.pairs) for r in G.graph_stats(e).collect()}
    assert stats == {"SW": (1, 1), "TF": (1, 1), "PW": (2, 2), "ALL": (4, 3)}
    assert G.capacity(e).first().density == 4 / 6
    cover, out, back = G.entrance_maps(e)
    assert (cover.count(), out.first().platform, back.first().platform) == (2, "b", "a")
    assert G.undirected(e).count() == 6


def test_trace_and_tree(spark):
    e = G.edges(table(spark, {("a", "b"): 1, ("b", "c"): 1, ("a", "c"): 5, ("c", "d"): 9}))
    tree = {r.node: (r.dist, r.parent, r.settled_rank) for r in S.search_tree(e, "a", "c").collect()}
    assert tree["c"] == (2, "b", 3) and "d" not in tree
    listed = [tuple(r) for r in S.distance_listing(S.search_tree(e, "a", "b"), G.vertices(e), True).collect()]
    assert listed == [("a", 0, True), ("b", 1, True), ("c", 5, False), ("d", None, False)]
    log = [tuple(r)[1:] for r in S.trace_table(e, "a").orderBy("step").collect()]
    assert log[0] == ("extract", 1, "a", 0, None, None) and ("update", 2, "c", 2, 5, "b") in log


def test_routes_over_candidates(spark):
    e = G.edges(table(spark, {("1.1", "1.2"): 10, ("1.2", "1.3"): 10, ("1.9", "1.3"): 5}))
    out_of = spark.createDataFrame([("E.1", "1.1"), ("E.1", "1.9")], "entrance string, platform string")
    into = spark.createDataFrame([("E.3", "1.3"), ("E.4", "1.1")], "entrance string, platform string")
    asked = spark.createDataFrame([("E.1", "E.3"), ("1.1", "1.3"), ("E.7", "1.3"), ("1.3", "1.1"), ("1.1", "1.1")], "source string, target string")
    got = {(r.source, r.target): (r.status, r.weight, r.path) for r in S.routes(e, asked, out_of, into, without_entrances=True).collect()}
    assert got["E.1", "E.3"] == ("ok", 125, ["E.1", "1.9", "1.3", "E.3"])
    assert got["1.1", "1.3"] == ("ok", 20, ["1.1", "1.2", "1.3"])
    assert got["E.7", "1.3"][0] == "no_pathway" and got["1.3", "1.1"][:2] == ("unreachable", None) and got["1.1", "1.1"][2] == ["1.1"]
    special = spark.createDataFrame([("1.3", "1.9", "E.3", "E.33"), ("1.9", "1.3", "E.1", "E.11")], "platform string, neighbour string, wrong string, right string")
    fixed = {(r.source, r.target): r.path for r in S.routes(e, asked, out_of, into, True, special=special, fix_after=True).collect()}
    assert fixed["E.1", "E.3"] == ["E.11", "1.9", "1.3", "E.33"] and fixed["1.1", "1.3"] == ["1.1", "1.2", "1.3"]
    before = {(r.source, r.target): r.path for r in S.routes(e, asked, out_of, into, True, special=special).collect()}
    assert before["E.1", "E.3"] == ["E.1", "1.9", "1.3", "E.3"]


def test_regions(spark):
    chain = {("b", "x1"): 10, ("x1", "b"): 11, ("x1", "x2"): 20, ("x2", "x1"): 22, ("b", "c"): 5, ("c", "b"): 5, ("c", "y1"): 7, ("y1", "c"): 8}
    e = G.edges(table(spark, chain))
    branches = spark.createDataFrame([("X", 1, "x2"), ("X", 2, "x1"), ("Y", 1, "y1")], "branch string, pos int, stop_id string")
    bridges = spark.createDataFrame([("X", "b"), ("Y", "c")], "branch string, bridge string")
    depth = {r.stop_id: (r.depth_from, r.depth_to) for r in G.branch_depths(e, branches, bridges).collect()}
    assert depth == {"x1": (10, 11), "x2": (30, 33), "y1": (7, 8)}
    plats = spark.createDataFrame([(s,) for s in ("b", "c", "x1", "x2", "y1")], "stop_id string")
    rep = S.all_pairs(e, plats.select(F.col("stop_id").alias("id")))
    cases = {r.case_: r.n for r in R.by_case(rep, branches, plats, "d").collect()}
    assert cases == {"CC": 2, "CB": 6, "BC": 6, "SB": 2, "DB": 4, "GLOBAL": 20}
    both = R.comparison({"d": rep, "s": rep}, branches, plats)
    assert all(r.d_mean == r.s_mean for r in both.collect())
    h = S.region_aware(S.no_heuristic, {"x1": "X", "x2": "X", "y1": "Y"}, {"X": "b", "Y": "c"}, {k: v[0] for k, v in depth.items()}, {k: v[1] for k, v in depth.items()})
    _, d = floyd(chain)
    for (p, q), true in d.items():
        assert p == q or h(p, q) <= true
    assert h("x2", "x1") == 22 and h("x1", "x2") == 20 and h("x2", "y1") == 33 + 7
    star = S.a_star_pairs(e, rep.select("source", "target"), h)
    R.optimum_gate({"d": rep, "s": star})
    with pytest.raises(Exception, match="unknown platform"):
        G.classify(spark.createDataFrame([("b", "zz")], "source string, target string"), branches, plats).collect()


def test_places(spark):
    xy = spark.createDataFrame([("a", "A", 41.0, 2.0), ("b", "B", 41.0, 2.01), ("c", "C", 41.0, 2.0)], "stop_id string, stop_name string, stop_lat double, stop_lon double")
    e = G.edges(table(spark, {("a", "b"): 100, ("b", "a"): 0, ("b", "c"): 50}))
    m = G.max_speed(e, xy).first()
    assert (m.src, m.dst) == ("b", "c") and m.speed > 16
    h = S.straight_line({"a": (41.0, 2.0), "b": (41.0, 2.01)}, m.speed)
    assert 0 < h("a", "b") <= 50 and h("a", "zz") == 0
    assert G.coordinate_collisions(xy).first().first_id == "a" and G.within(xy, 41.0, 2.0, 0.001).count() == 2
    cover = spark.createDataFrame([("a", "E.1"), ("b", "E.1")], "platform string, entrance string")
    assert abs(G.entrance_centroids(cover, xy).first().lon - 2.005) < 1e-9
    bound = S.over_candidates(h, {"E.1": ["b"]}, {"E.2": ["a"]})
    assert bound("E.2", "E.1") == 120 + h("a", "b") and bound("E.9", "E.1") is None and bound("a", "a") == 0
    lines = spark.createDataFrame([("a", "b", "L1")], "src string, dst string, line string")
    assert G.drawing_table(e, lines, xy).where("line = 'L1'").first().src_lat == 41.0


def test_reached_pairs_alone(spark):
    pairs = {k: w for k, w in random_graph(3, n=12, m=16).items()} | {(f"{a}x", f"{b}x"): w for (a, b), w in random_graph(4, n=9, m=12).items()}
    e = G.edges(table(spark, pairs))
    some = G.vertices(e).where("id not in ('1', '2x')").union(spark.createDataFrame([("no vertex",)], "id string"))
    for both in (
        lambda **k: S.all_pairs(e, some, **k),
        lambda **k: S.all_pairs(e, some, G.vertices(e), **k),
        lambda **k: S.a_star_all(e, some, S.EXACT, **k),
        lambda **k: S.a_star_all(e, some, S.no_heuristic, sources=G.vertices(e), **k),
    ):
        whole = both().where("optimum_weight is not null")
        assert sorted(both(reached=True).collect()) == sorted(whole.collect()) and whole.count() < both().count()


def test_work_follows_the_reached_pairs(spark):
    # 40,000 platforms in twos: 40,000 pairs are reached of 1.6 thousand million
    ids = spark.range(20_000).selectExpr("concat('a', id) as src", "concat('b', id) as dst", "id + 1 as weight", "'SW' as type")
    e = ids.union(ids.selectExpr("dst", "src", "weight + 1", "type"))
    for found in (S.all_pairs(e, G.vertices(e), reached=True), S.a_star_all(e, G.vertices(e), S.EXACT, reached=True), S.a_star_all(e, G.vertices(e), S.no_heuristic, reached=True)):
        n = 20_000
        assert found.agg(F.count(F.lit(1)), F.sum("optimum_weight"), F.max("iterations")).first() == (2 * n, n * (n + 1) // 2 + n * (n + 3) // 2, 2)


def test_too_many_edges(spark, monkeypatch):
    pairs = random_graph(1)
    nodes, d = floyd(pairs)
    e = G.edges(table(spark, pairs))
    want = {(a, b): d[a, b] for a in nodes for b in nodes if a != b and d[a, b] < float("inf")}
    rep = S.all_pairs(e, G.vertices(e), most=2).collect()
    assert {(r.source, r.target): r.optimum_weight for r in rep} == want
    exact = {(r.source, r.target): r for r in S.all_pairs(e, G.vertices(e)).where("optimum_weight is not null").collect()}
    assert all(r.iterations >= exact[r.source, r.target].iterations and r.path is None for r in rep)
    monkeypatch.setattr(S, "MAX_BROADCAST_EDGES", 2)
    assert S.adjacency(e) is None
    with pytest.raises(ValueError, match="relax"):
        S.search_tree(e, nodes[0])


def test_relaxation_merges_and_its_tree(spark):
    pairs = {(f"n{i}", f"n{i + 1}"): 2 for i in range(12)} | {("n0", "n5"): 11, ("n3", "n9"): 1}
    _, d = floyd(pairs)
    e = G.edges(table(spark, pairs))
    dist = S.relax(e, spark.createDataFrame([("n0",), ("n3",)], "id string"), merge_every=2)
    got = {(r.source, r.node): r.dist for r in dist.collect()}
    assert got == {(a, b): v for (a, b), v in d.items() if a in ("n0", "n3") and v < float("inf")}
    starts = spark.createDataFrame([("n0",), ("n3",)], "id string")
    for most in (None, 3):
        assert {(r.source, r.node): r.dist for r in S.distances(e, starts, most).collect()} == got
    parents = {(r.source, r.node): r.parent for r in S.shortest_tree(e, dist).collect()}
    assert parents["n0", "n9"] == "n3" and parents["n0", "n5"] == "n4" and len(parents) == len(got) - 2


# Small graphs (from: to weight, ...), source, target, shortest distance, edges, least and most
# extractions of a cut search.
TOYS = [
    (
        """a: v1 7, v2 8, v3 1
v1: v6 4, v5 4
v2: v1 6, v3 1, v5 3
v3: v4 6, v5 2
v4: v5 1, v9 2
v5: v7 4, v8 5, v9 1
v6: v5 1, v7 2
v7: v8 4, b 4
v8: b 1
v9: v8 3, b 6""",
        "a", "b", 8, 22, 9, 10,
    ),
    (
        """v1: v2 4, v3 2, v4 3
v2: v6 1
v3: v5 1, v6 5
v4: v5 2
v5: v6 2, v9 4
v6: v7 3, v8 2
v8: v9 1""",
        "v1", "v9", 7, 12, 7, 8,
    ),
    (
        """v0: v1 4, v7 8
v1: v0 4, v2 8, v7 11
v2: v1 8, v3 7, v5 4, v8 2
v3: v2 7, v4 9, v5 14
v4: v3 9, v5 10
v5: v2 4, v3 14, v4 10, v6 2
v6: v5 2, v7 1, v8 6
v7: v0 8, v1 11, v6 1, v8 7
v8: v2 2, v6 6, v7 7""",
        "v0", "v4", 21, 28, 9, 9,
    ),
    (
        """A: B 3, C 1
B: D 2, T 3
C: D 1, R 4
D: S 1
E: H 4
F: W 1
G: F 5
H: F 1, G 1, X 2
I: K 1
J: I 3, K 5, L 7
K: L 1
L: V 2
M: N 7
N: P 3
O: U 3
P: O 5, Q 2
Q: A 2
R: M 4
S: F 1
T: E 3
U: J 1
V: M 2
W: I 1
X: I 2""",
        "A", "K", 7, 32, 11, 11,
    ),
]


@pytest.mark.parametrize("text, s, t, best, edges, low, high", TOYS)
def test_small_graphs(text, s, t, best, edges, low, high):
    pairs = {(row.split(":")[0], to): int(w) for row in text.splitlines() for to, w in map(str.split, row.split(":")[1].split(","))}
    nodes, d = floyd(pairs)
    g = adjacency(pairs)
    assert len(pairs) == edges
    dist, parent, rank = S.dijkstra(g, s)
    assert dist[t] == best and len(rank) == len(nodes) and low <= rank[t] <= high
    p = S.path(parent, s, t)
    assert sum(pairs[x] for x in zip(p, p[1:])) == best
    h = S.exact_remaining(S.reversed_graph(g), t)
    assert S.a_star(g, s, t, h)[0][t] == best and S.a_star(g, s, t, S.no_heuristic)[0][t] == best


def test_hand_traced_a_star():
    g = adjacency({("A", "B"): 1, ("A", "C"): 3, ("B", "C"): 1, ("B", "D"): 4, ("C", "D"): 1})
    left = {"A": 3, "B": 2, "C": 1, "D": 0}
    cost, up, n = S.a_star(g, "A", "D", lambda x, _: left[x])
    assert (cost["D"], S.path(up, "A", "D"), n) == (3, ["A", "B", "C", "D"], 4)


def test_bridges_colours_and_positions(spark):
    pairs = spark.createDataFrame([("x2", "y1", "DB"), ("x2", "x1", "SB"), ("b", "x1", "CB"), ("x1", "b", "BC"), ("b", "c", "CC")], "source string, target string, case_ string")
    branches = spark.createDataFrame([("X", 1, "x2"), ("X", 2, "x1"), ("Y", 1, "y1")], "branch string, pos int, stop_id string")
    bridges = spark.createDataFrame([("X", "b"), ("Y", "c")], "branch string, bridge string")
    got = sorted(map(tuple, G.bridge_highlights(pairs, branches, bridges).collect()))
    assert got == [("b", "x1", "b"), ("x1", "b", "b"), ("x2", "x1", "b"), ("x2", "y1", "b"), ("x2", "y1", "c")]
    paths = spark.createDataFrame([(["E.1", "1.1", "1.2", "E.2"],), (["1.1", "1.2"],)], "path array<string>")
    assert [tuple(r) for r in paths.select(*G.path_ends()).collect()] == [("1.1", "1.2"), ("1.1", "1.2")]
    xy = spark.createDataFrame([("1.1", 41.0, 2.0), ("1.2", 41.0, 2.0), ("E.1", 41.001, 2.0)], "stop_id string, stop_lat double, stop_lon double")
    pos = G.spread_positions(xy)
    at = {r.stop_id: (r.lat, r.lon) for r in pos.collect()}
    assert at["1.1"] == (41.0, 2.0) and at["1.2"] != (41.0, 2.0) and at["E.1"] == (41.001, 2.0)
    far = {r.stop_id: r.lat for r in G.amplified_entrances(pos, spark.createDataFrame([("1.1", "E.1")], "platform string, entrance string"), 10).collect()}
    assert abs(far["E.1"] - 41.01) < 1e-9 and far["1.1"] == 41.0
    assert [r[0] for r in pairs.select(G.choose("case_", {"SB": "red", "DB": "blue"}, "grey")).collect()] == ["blue", "red", "grey", "grey", "grey"]


@pytest.fixture(scope="module")
def published(spark):
    """The published graph of 673 vertices, where TRELLISQ_GRAPH names its table (delimited, with header)."""
    from trellisq.sources.gtfs import scan

    place = os.environ.get("TRELLISQ_GRAPH")
    if not place:
        pytest.skip("TRELLISQ_GRAPH is not set")
    return scan(spark, place, "weights")


def test_published_graph(spark, published):
    stats = {r.type: (r.arcs, r.pairs) for r in G.graph_stats(G.edges(published)).collect()}
    assert stats == {"SW": (320, 160), "TF": (80, 40), "PW": (1019, 510), "ALL": (1419, 710)}
    assert G.vertices(G.edges(published)).count() == 673
    for left_out, vertices in (((), 673), (("PW",), 171)):
        e = G.edges(published, left_out)
        assert G.vertices(e).count() == vertices
        platforms = G.vertices(e).where("id like '1.%'")
        rep = S.all_pairs(e, platforms)
        whole = rep.agg(F.count("optimum_weight").alias("n"), F.sum("optimum_weight").alias("s")).first()
        assert (whole.n, whole.s) == (29070, 36902254)
        star = S.a_star_all(e, platforms, S.EXACT)
        R.optimum_gate({"dijkstra": rep, "a_star": star})
        assert star.agg(F.avg("proportion")).first()[0] > 0.95
    e = G.edges(published)
    tree = {r.node: r for r in S.search_tree(e, "E.13002").collect()}
    steps, at = 1, "E.11101"
    while at != "E.13002":
        at, steps = tree[at].parent, steps + 1
    assert (tree["E.11101"].dist, steps) == (1842, 22)
    cover, _, _ = G.entrance_maps(e)
    served = cover.groupBy("entrance").count().groupBy("count").agg(F.count(F.lit(1)).alias("n"))
    assert {r[0]: r[1] for r in served.collect()} == {1: 494, 2: 8}


# The branches of the published graph, outermost platform first, and the platform each is reached through.
BRANCHES = {
    "L1": (["1.111", "1.112", "1.113", "1.114", "1.115", "1.116"], "1.117"),
    "L2": (["1.227", "1.226"], "1.225"),
    "L5": (["1.509", "1.510", "1.511", "1.512", "1.513", "1.514", "1.555"], "1.515"),
    "L9S": (["1.901", "1.903", "1.904", "1.905", "1.906", "1.907", "1.909", "1.910", "1.911", "1.912", "1.913"], "1.9140"),
    "L9N": (["1.945", "1.944", "1.943"], "1.942"),
    "L10S": (["1.951", "1.952", "1.953", "1.954", "1.956", "1.957", "1.958", "1.959"], "1.9141"),
    "L11": (["1.1140", "1.1139", "1.1138", "1.1137"], "1.1136"),
    "FM": (["1.9902"], "1.9901"),
}
# Seconds from the bridge to the outermost platform and back.
DEPTHS = {"L1": (569, 562), "L2": (211, 194), "L5": (671, 668), "L9S": (1548, 1536), "L9N": (325, 317), "L10S": (901, 1066), "L11": (406, 405), "FM": (141, 141)}
# Pairs of each case; mean proportion of path vertices to extractions by Dijkstra on the whole graph and without entrances.
CASES = {"CC": (16512, 0.0644, 0.2062), "CB": (5418, 0.0395, 0.1437), "BC": (5418, 0.0737, 0.2531), "SB": (258, 0.2514, 0.6739), "DB": (1464, 0.0697, 0.2379), "GLOBAL": (29070, 0.0634, 0.209)}


def test_published_regions(spark, published):
    branches = spark.createDataFrame([(b, k, s) for b, (stops, _) in BRANCHES.items() for k, s in enumerate(stops)], "branch string, pos int, stop_id string")
    bridges = spark.createDataFrame([(b, x) for b, (_, x) in BRANCHES.items()], "branch string, bridge string")
    whole, trains = G.edges(published), G.edges(published, ("PW",))
    depth = {r.stop_id: (r.depth_from, r.depth_to) for r in G.branch_depths(whole, branches, bridges).collect()}
    assert {b: depth[stops[0]] for b, (stops, _) in BRANCHES.items()} == DEPTHS
    platforms = G.vertices(trains).select(F.col("id").alias("stop_id"))
    ids = G.vertices(trains)
    reports = {"full": S.all_pairs(whole, ids), "no_pw": S.all_pairs(trains, ids)}
    got = {r.case_: (r.n, r.full_mean, r.no_pw_mean) for r in R.comparison(reports, branches, platforms).collect()}
    assert {c: n for c, (n, _, _) in got.items()} == {c: n for c, (n, _, _) in CASES.items()}
    # the order of ties is not laid down, so means may differ a little
    assert all(abs(got[c][k] - CASES[c][k]) < 0.001 for c in CASES for k in (1, 2))
    home = {s: b for b, (stops, _) in BRANCHES.items() for s in stops}
    h = S.region_aware(S.no_heuristic, home, {b: x for b, (_, x) in BRANCHES.items()}, {s: d[0] for s, d in depth.items()}, {s: d[1] for s, d in depth.items()})
    aware = S.a_star_all(trains, ids, h)
    R.optimum_gate({"dijkstra": reports["no_pw"], "region_aware": aware, "plain": S.a_star_all(trains, ids, S.no_heuristic)})
    cases = G.classify(ids.select(F.col("id").alias("source")).limit(1).crossJoin(ids.select(F.col("id").alias("target"))).where("source <> target"), branches, platforms)  # one row on the left
    marked = G.bridge_highlights(cases, branches, bridges)
    assert set(r.bridge for r in marked.collect()) <= {x for _, x in BRANCHES.values()} and marked.count() > 0


def test_published_stages(spark):
    """Raw routes and transfers and the split ids, where TRELLISQ_ROUTES, TRELLISQ_TRANSFERS and TRELLISQ_EQUIVALENCES name their tables."""
    from trellisq.operators import stages as K
    from trellisq.sources.gtfs import Locations, scan

    names = ("routes", "transfers", "equivalences")
    if not all(os.environ.get(f"TRELLISQ_{n.upper()}") for n in names):
        pytest.skip("the published tables are not named")
    routes, transfers, split = (scan(spark, Locations().path(n), n) for n in names)
    counts = K.network_counts(routes, "2.", "route_id").first()
    assert (counts.total, counts.removed, counts.kept, K.network_filter(routes, "2.", "route_id").count()) == (114, 103, 11, 11)
    least = K.least_transfer(transfers).first()[0]
    shared = split.withColumn("idx", F.expr("substr(new_stop_id, length(original_stop_id) + 1)").cast("int"))
    out = K.split_transfers(transfers.select("from_stop_id", "to_stop_id", "transfer_type", "min_transfer_time"), shared, least)
    assert (least, transfers.count(), shared.count(), K.correspondences(shared).count(), out.count()) == (15, 60, 12, 12, 80)
