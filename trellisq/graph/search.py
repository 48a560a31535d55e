"""Shortest paths: per-source Dijkstra, target-cut iterations, A* with heuristics, candidates.

Two ways, by the size of the graph.  A graph of up to ``MAX_BROADCAST_EDGES`` edges is
sent to the tasks once, and searches are spread over them; a larger graph is never
gathered: distances are relaxed by joins, round by round, with what a round finds written
to the shared folder (:func:`relax`).

Extraction order is (priority, order of insertion), so that results do not depend on
the shape of a heap.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellisq.graph.report import settle_bounds
from trellisq.session import discard, written

MAX_BROADCAST_EDGES = 1_000_000
# Fixed value: seconds between an entrance and its platform.
ENTRY_SECONDS = 60

Adjacency = dict[str, list[tuple[str, int]]]
Heuristic = Callable[[str, str], int | None]


def adjacency(edges: DataFrame, most: int | None = None) -> Adjacency | None:
    """The edges by source in id order; None where there are more than may be sent to tasks."""
    most = most or MAX_BROADCAST_EDGES
    rows = edges.select("src", "dst", "weight").limit(most + 1).collect()
    if len(rows) > most:
        return None
    out: Adjacency = {}
    for a, b, w in sorted(rows):
        out.setdefault(a, []).append((b, w))
        out.setdefault(b, [])
    return out


def _sent(edges: DataFrame):
    """The graph as a broadcast; raises where it may not be sent to tasks."""
    graph = adjacency(edges)
    if graph is None:
        raise ValueError(f"more than {MAX_BROADCAST_EDGES} edges: use relax()")
    return edges.sparkSession.sparkContext.broadcast(graph)


def dijkstra(graph: Adjacency, source: str, stop_at: str | None = None, trace: list[tuple] | None = None) -> tuple[dict[str, int], dict[str, str | None], dict[str, int]]:
    """(distances, parents, settle rank from 1) from one source; ends when ``stop_at`` is settled.

    Distances of nodes without a rank are not final.  A source that is no vertex reaches
    only itself.
    """
    dist: dict[str, int] = {source: 0}
    parent: dict[str, str | None] = {source: None}
    rank: dict[str, int] = {}
    heap: list[tuple[int, int, str]] = [(0, 0, source)]
    pushed = 0
    while heap:
        d, _, node = heapq.heappop(heap)
        if node in rank:
            continue
        rank[node] = len(rank) + 1
        if trace is not None:
            trace.append(("extract", rank[node], node, d, None, None))
        if node == stop_at:
            break
        for nxt, w in graph.get(node, ()):
            if nxt in rank:
                continue
            new = d + w
            old = dist.get(nxt)
            if old is None or new < old:
                dist[nxt], parent[nxt] = new, node
                pushed += 1
                heapq.heappush(heap, (new, pushed, nxt))
                if trace is not None:
                    trace.append(("update", rank[node], nxt, new, old, node))
    return dist, parent, rank


def a_star(graph: Adjacency, source: str, target: str, h: Heuristic) -> tuple[dict[str, int], dict[str, str | None], int]:
    """(costs, parents, extractions) of an A* run; nodes may open again, every extraction counts.

    A heuristic of None means the target cannot be reached from the node: it is not opened.
    """
    g: dict[str, int] = {source: 0}
    parent: dict[str, str | None] = {source: None}
    start = h(source, target)
    heap: list[tuple[int, int, str]] = [] if start is None else [(start, 0, source)]
    live: dict[str, int] = {source: 0}
    pushed = extracted = 0
    while heap:
        _, k, node = heapq.heappop(heap)
        if live.get(node) != k:
            continue  # its priority was lowered, or it was taken
        del live[node]
        extracted += 1
        if node == target:
            break
        for nxt, w in graph.get(node, ()):
            new = g[node] + w
            if nxt not in g or new < g[nxt]:
                estimate = h(nxt, target)
                if estimate is None:
                    continue
                g[nxt], parent[nxt] = new, node
                pushed += 1
                live[nxt] = pushed
                heapq.heappush(heap, (new + estimate, pushed, nxt))
    return g, parent, extracted


def path(parent: dict[str, str | None], source: str, target: str) -> list[str]:
    """The vertices from source to target; empty when it was not reached."""
    if target not in parent:
        return []
    out = [target]
    while out[-1] != source:
        before = parent[out[-1]]
        if before is None:
            return []
        out.append(before)
    return out[::-1]


REPORT = "source string, target string, iterations int, path_vertices int, optimum_weight long, proportion double, path array<string>"
_COLUMNS = ["source", "target", "iterations", "path_vertices", "optimum_weight", "proportion", "path"]


def _ids(df: DataFrame, most: int | None = None) -> list[str] | None:
    most = most or MAX_BROADCAST_EDGES
    rows = df.select("id").distinct().limit(most + 1).collect()
    return sorted(r[0] for r in rows) if len(rows) <= most else None


def _frames(rows: Iterator[tuple], most: int = 20_000) -> Iterator[pd.DataFrame]:
    """Rows of the report as tables of up to ``most`` rows, whatever the number of rows a search gives."""
    while held := list(islice(rows, most)):
        yield pd.DataFrame(held, columns=_COLUMNS).astype({"path_vertices": "Int32", "optimum_weight": "Int64"})


def all_pairs(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, most: int | None = None, reached: bool = False) -> DataFrame:
    """The report of the target-cut search for every ordered pair of different nodes.

    A cut search does the same steps as a full one up to its target, so one full search
    per source gives all its targets: iterations are the target's settle rank.  Pairs
    that are not reached have nulls and the number of settled nodes as iterations; with
    ``reached`` they are no rows, and the work is that of the reached pairs alone.
    ``sources`` has id; ``targets`` (id) is the sources where not given.

    With more than ``most`` edges or targets the distances come from :func:`relax`: then
    pairs that are not reached are no rows, iterations are the most a cut search may take
    (ties included), and path and path_vertices are null (see :func:`shortest_tree`).
    """
    spark = edges.sparkSession
    graph, ends = adjacency(edges, most), _ids(targets or sources, most)
    if graph is None or ends is None:
        return _relaxed_pairs(edges, sources, targets or sources)
    sent = spark.sparkContext.broadcast((graph, ends))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, ends = sent.value
        wanted = frozenset(ends)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for s in b["id"]:
                    dist, parent, rank = dijkstra(graph, s)
                    for t in (t for t in dist if t in wanted) if reached else ends:
                        if t == s:
                            continue
                        p = path(parent, s, t)
                        n = rank.get(t, len(rank))
                        yield s, t, n, len(p) or None, dist.get(t), len(p) / n if p else None, p

        yield from _frames(rows())

    return spread(sources.select("id").distinct(), "id").mapInPandas(run, REPORT)


def _relaxed_pairs(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    dist = relax(edges, sources)
    wanted = targets.select(F.col("id").alias("node")).distinct()
    bounds = settle_bounds(dist).select("source", F.col("target").alias("node"), F.col("high").cast("int").alias("iterations"))
    none = lambda t: F.lit(None).cast(t)
    return (
        dist.join(wanted, "node", "left_semi")
        .join(bounds, ["source", "node"])
        .select("source", F.col("node").alias("target"), "iterations", none("int").alias("path_vertices"), F.col("dist").alias("optimum_weight"), none("double").alias("proportion"), none("array<string>").alias("path"))
    )


def spread(df: DataFrame, key: str) -> DataFrame:
    """Searches are heavy for their bytes: one partition per core, whatever the size of the table."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def search_tree(edges: DataFrame, source: str, stop_at: str | None = None) -> DataFrame:
    """Node, dist, parent, settled_rank (null: reached, not settled) of one search, run in a task."""
    sent = _sent(edges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            dist, parent, rank = dijkstra(sent.value, source, stop_at)
            rows = [(n, d, parent[n], rank.get(n)) for n, d in dist.items()]
            yield pd.DataFrame(rows, columns=["node", "dist", "parent", "settled_rank"]).astype({"settled_rank": "Int32"})

    return edges.sparkSession.range(1, numPartitions=1).mapInPandas(run, "node string, dist long, parent string, settled_rank int")


def trace_table(edges: DataFrame, source: str, stop_at: str | None = None) -> DataFrame:
    """Step, kind, iteration, node, dist, old, via of one search's log, run in a task."""
    sent = _sent(edges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            log: list[tuple] = []
            dijkstra(sent.value, source, stop_at, log)
            rows = [(i + 1, *x) for i, x in enumerate(log)]
            yield pd.DataFrame(rows, columns=["step", "kind", "iteration", "node", "dist", "old", "via"]).astype({"old": "Int64"})

    return edges.sparkSession.range(1, numPartitions=1).mapInPandas(run, "step int, kind string, iteration int, node string, dist long, old long, via string")


@dataclass(frozen=True)
class HeuristicTable:
    """A heuristic as a table of lower bounds (node, target); a missing pair is None, an equal pair 0."""

    values: dict[tuple[str, str], int]
    unknown: int | None = None

    def __call__(self, node: str, target: str) -> int | None:
        return 0 if node == target else self.values.get((node, target), self.unknown)


def no_heuristic(node: str, target: str) -> int:
    """A* with it is Dijkstra."""
    return 0


def straight_line(coordinates: dict[str, tuple[float, float]], v_max: float) -> Heuristic:
    """Seconds of the straight line at the greatest speed, floored; 0 where a place is unknown."""
    from math import cos, radians, sqrt

    from trellisq.functions.exprs import EARTH_RADIUS_M

    def h(node: str, target: str) -> int:
        if node not in coordinates or target not in coordinates or v_max <= 0:
            return 0
        (a, b), (c, d) = coordinates[node], coordinates[target]
        x = radians(d - b) * cos(radians((a + c) / 2)) * EARTH_RADIUS_M
        y = radians(c - a) * EARTH_RADIUS_M
        return int(sqrt(x * x + y * y) / v_max)

    return h


def reversed_graph(graph: Adjacency) -> Adjacency:
    """Every edge the other way."""
    out: Adjacency = {n: [] for n in graph}
    for a, ends in graph.items():
        for b, w in ends:
            out[b].append((a, w))
    return out


def exact_remaining(back: Adjacency, target: str) -> Heuristic:
    """The true remaining cost to one target, by one search on the reversed graph."""
    left = dijkstra(back, target)[0]
    return lambda node, _: left.get(node)


#: Stands for :func:`exact_remaining`, built for each target by the task that has its pairs.
EXACT = "exact"


def region_aware(base: Heuristic, branch: dict[str, str], bridge: dict[str, str], depth_from: dict[str, int], depth_to: dict[str, int]) -> Heuristic:
    """Bounds that know that a branch is left and entered through its bridge only.

    ``base`` bounds the way through the center; depths are those of the branches.
    """

    def h(p: str, q: str) -> int | None:
        bp, bq = branch.get(p), branch.get(q)
        if bp is not None and bp == bq:
            out = depth_from[q] - depth_from[p]
            return out if out > 0 else depth_to[p] - depth_to[q]
        a, cost_a = (bridge[bp], depth_to[p]) if bp is not None else (p, 0)
        b, cost_b = (bridge[bq], depth_from[q]) if bq is not None else (q, 0)
        mid = base(a, b)
        return None if mid is None else cost_a + mid + cost_b

    return h


def over_candidates(h: Heuristic, into: dict[str, list[str]], out_of: dict[str, list[str]]) -> Heuristic:
    """The bound over the platforms of entrances: entry costs and the least over candidate pairs; None without any.

    ``out_of`` lists the platforms an entrance leads to, ``into`` those that lead to it.
    """

    def bound(node: str, target: str) -> int | None:
        if node == target:
            return 0
        ends = into.get(target, []) if target.startswith("E.") else [target]
        starts = out_of.get(node, []) if node.startswith("E.") else [node]
        found = [x for x in (h(p, q) for p in starts for q in ends) if x is not None]
        return entry_cost(node) + min(found) + entry_cost(target) if found else None

    return bound


def entry_cost(node: str) -> int:
    """The fixed cost of an entrance."""
    return ENTRY_SECONDS if node.startswith("E.") else 0


def _a_star_row(graph: Adjacency, s: str, t: str, h: Heuristic) -> tuple:
    g, parent, n = a_star(graph, s, t, h)
    p = path(parent, s, t)
    return s, t, n, len(p) or None, g[t] if p else None, len(p) / n if p and n else None, p


def a_star_pairs(edges: DataFrame, pairs: DataFrame, heuristic: Heuristic | str) -> DataFrame:
    """The report of an A* run for every pair (source, target), under a heuristic or EXACT.

    The pairs of a target go to a few tasks, in its order, so that each builds its exact
    bounds once.
    """
    sent = _sent(edges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = sent.value
        back = reversed_graph(graph) if heuristic == EXACT else {}
        held, h = None, heuristic
        for b in batches:
            rows = []
            for s, t in zip(b["source"], b["target"]):
                if heuristic == EXACT and t != held:
                    held, h = t, exact_remaining(back, t)
                rows.append(_a_star_row(graph, s, t, h))
            yield pd.DataFrame(rows, columns=_COLUMNS).astype({"path_vertices": "Int32", "optimum_weight": "Int64"})

    part = F.pmod(F.xxhash64("source"), F.lit(8))
    spread_ = pairs.select("source", "target").repartition(edges.sparkSession.sparkContext.defaultParallelism, "target", part)
    return spread_.sortWithinPartitions("target").mapInPandas(run, REPORT)


def a_star_all(edges: DataFrame, ends: DataFrame, heuristic: Heuristic | str, sources: DataFrame | None = None, reached: bool = False) -> DataFrame:
    """The report of an A* run for every ordered pair of different nodes, without a table of the pairs.

    Targets are spread over tasks; the sources (``ends`` where not given) are sent to them.
    With ``reached`` pairs that are not reached are no rows: only the sources that a search
    from the target on the reversed graph meets are run.
    """
    sent = _sent(edges)
    starts = _ids(sources or ends)
    if starts is None:
        raise ValueError(f"more than {MAX_BROADCAST_EDGES} sources: use a_star_pairs()")
    from_ = edges.sparkSession.sparkContext.broadcast(starts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph, starts = sent.value, from_.value
        back = reversed_graph(graph) if reached or heuristic == EXACT else {}
        wanted = frozenset(starts)

        def rows() -> Iterator[tuple]:
            for b in batches:
                for t in b["id"]:
                    left = dijkstra(back, t)[0] if back else {}
                    h = (lambda node, _, left=left: left.get(node)) if heuristic == EXACT else heuristic
                    for s in (s for s in left if s in wanted) if reached else starts:
                        if s != t:
                            yield _a_star_row(graph, s, t, h)

        yield from _frames(rows())

    return spread(ends.select("id").distinct(), "id").mapInPandas(run, REPORT)


def candidates(requests: DataFrame, out_of: DataFrame, into: DataFrame, without_entrances: bool) -> DataFrame:
    """J18, J24, D18j, H17: request rows with from_node, to_node, entry (fixed cost), status.

    With entrances in the graph the nodes are the request's own.  Without them an
    entrance stands for each platform it leads to (source) or is led to from (target), at
    ENTRY_SECONDS each.  A request without a candidate has status ``no_pathway``.
    """
    if not without_entrances:
        return requests.select("*", F.col("source").alias("from_node"), F.col("target").alias("to_node"), F.lit(0).alias("entry"), F.lit("ok").alias("status"))
    s = out_of.select(F.col("entrance").alias("source"), F.col("platform").alias("s_platform"))
    t = into.select(F.col("entrance").alias("target"), F.col("platform").alias("t_platform"))
    end = lambda c, p: F.when(F.col(c).startswith("E."), F.col(p)).otherwise(F.col(c))
    fee = lambda c: F.when(F.col(c).startswith("E."), F.lit(ENTRY_SECONDS)).otherwise(F.lit(0))
    held = requests.join(s, "source", "left").join(t, "target", "left")
    return held.select(
        *requests.columns,
        end("source", "s_platform").alias("from_node"),
        end("target", "t_platform").alias("to_node"),
        (fee("source") + fee("target")).alias("entry"),
    ).withColumn("status", F.when(F.col("from_node").isNull() | F.col("to_node").isNull(), "no_pathway").otherwise("ok"))


def routes(edges: DataFrame, requests: DataFrame, out_of: DataFrame, into: DataFrame, without_entrances: bool = False, heuristic: Heuristic = no_heuristic, special: DataFrame | None = None, fix_after: bool = False) -> DataFrame:
    """Source, target, status, weight, path, iterations of each request: the best over its candidates.

    Ties between candidates go to the smaller platform ids.  Entrances are put back at
    the ends of the path, and the special entrances (see :func:`fix_entrances`) are put
    right before that, or after it with ``fix_after``.
    """
    asked = candidates(requests.select("source", "target").distinct(), out_of, into, without_entrances)
    pairs = asked.where("status = 'ok'").select(F.col("from_node").alias("source"), F.col("to_node").alias("target")).distinct()
    found = a_star_pairs(edges, pairs, heuristic).select(F.col("source").alias("from_node"), F.col("target").alias("to_node"), "iterations", "optimum_weight", "path")
    all_ = asked.join(found, ["from_node", "to_node"], "left")
    order = Window.partitionBy("source", "target").orderBy(F.col("optimum_weight").asc_nulls_last(), "from_node", "to_node")
    best = all_.withColumn("k", F.row_number().over(order)).where("k = 1")
    if special is not None and not fix_after:
        best = fix_entrances(best, special)
    restored = F.when(
        F.size("path") > 0,
        F.concat(
            F.when(F.col("from_node") != F.col("source"), F.array("source")).otherwise(F.array().cast("array<string>")),
            F.col("path"),
            F.when(F.col("to_node") != F.col("target"), F.array("target")).otherwise(F.array().cast("array<string>")),
        ),
    ).otherwise(F.array().cast("array<string>"))
    best = best.withColumn("path", restored)
    if special is not None and fix_after:
        best = fix_entrances(best, special)
    return best.select(
        "source",
        "target",
        F.when(F.col("status") != "ok", F.col("status")).when(F.col("optimum_weight").isNull(), "unreachable").otherwise("ok").alias("status"),
        (F.col("optimum_weight") + F.col("entry")).alias("weight"),
        "path",
        "iterations",
    )


def fix_entrances(df: DataFrame, special: DataFrame) -> DataFrame:
    """Put the entrance of the right direction at an end of a path that passes a special platform there.

    ``special`` (a few rows) has platform, neighbour, wrong, right: next to the platform
    the path goes on to the neighbour, so the entrance ``wrong`` is to be ``right``.
    """
    last = special.select(F.array("neighbour", "platform", "wrong").alias("_end"), F.col("right").alias("_last"))
    first = special.select(F.array("wrong", "platform", "neighbour").alias("_start"), F.col("right").alias("_first"))
    n = F.size("path")
    ends = df.withColumn("_end", F.when(n >= 3, F.slice("path", -3, 3))).withColumn("_start", F.when(n >= 3, F.slice("path", 1, 3)))
    held = ends.join(last, "_end", "left").join(first, "_start", "left")
    tail = F.when(F.col("_last").isNotNull(), F.concat(F.slice("path", F.lit(1), n - 1), F.array("_last"))).otherwise(F.col("path"))
    both = held.withColumn("path", tail)
    head = F.when(F.col("_first").isNotNull(), F.concat(F.array("_first"), F.slice("path", F.lit(2), F.greatest(n - 1, F.lit(0))))).otherwise(F.col("path"))
    return both.withColumn("path", head).select(df.columns)


def relax(edges: DataFrame, sources: DataFrame, most_rounds: int = 10_000, merge_every: int = 8) -> DataFrame:
    """J9 at any size: source, node, dist: distances by rounds of relaxation over joined tables.

    Only nodes whose distance fell in the last round send it on, and only what falls is
    written; what is known is read for the nodes met, and merged into one table every few
    rounds.  Everything written cuts the lineage and lies in the shared folder.
    """
    keys = ["source", "node"]
    fresh = written(sources.select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).cast("long").alias("dist")).distinct())
    known = [fresh]
    step = edges.select(F.col("src").alias("node"), "dst", "weight")
    least = lambda tables: reduce(DataFrame.unionByName, tables).groupBy(*keys).agg(F.min("dist").alias("dist"))
    for k in range(1, most_rounds + 1):
        sent = fresh.join(step, "node").groupBy("source", F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("weight")).alias("dist"))
        # what is sent is small beside what is known: the known ones stay where they are
        met = reduce(DataFrame.unionByName, known).join(sent.select(*keys), keys, "left_semi")
        old = met.groupBy(*keys).agg(F.min("dist").alias("old"))
        fresh = written(sent.join(old, keys, "left").where(F.col("old").isNull() | (F.col("dist") < F.col("old"))).drop("old"))
        if fresh.isEmpty():
            return least(known)
        known.append(fresh)
        if k % merge_every == 0:
            merged = written(least(known))
            # the fresh rows are still sent on in the next round
            for table in known[:-1]:
                discard(table)
            known = [merged]
    raise RuntimeError(f"no end after {most_rounds} rounds: is there a cycle of negative weight?")


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """Source, node, dist of every node reached, the source included: searches in tasks where the graph may be sent to them, else :func:`relax`."""
    graph = adjacency(edges, most)
    if graph is None:
        return relax(edges, sources)
    sent = edges.sparkSession.sparkContext.broadcast(graph)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in b["id"]:
                dist = dijkstra(sent.value, s)[0]
                yield pd.DataFrame({"source": s, "node": list(dist), "dist": list(dist.values())})

    return spread(sources.select("id").distinct(), "id").mapInPandas(run, "source string, node string, dist long")


def shortest_tree(edges: DataFrame, distances: DataFrame) -> DataFrame:
    """J17 at any size: source, node, parent of a shortest path to every node reached; the smallest parent of several."""
    before = distances.select("source", F.col("node").alias("parent"), F.col("dist").alias("at"))
    steps = before.join(edges.select(F.col("src").alias("parent"), F.col("dst").alias("node"), "weight"), "parent")
    tight = steps.join(distances, ["source", "node"]).where((F.col("at") + F.col("weight") == F.col("dist")) & (F.col("node") != F.col("source")))
    return tight.groupBy("source", "node").agg(F.min("parent").alias("parent"))


def distance_listing(tree: DataFrame, vertices: DataFrame, unreachable: bool = False) -> DataFrame:
    """Node, dist, final of a search tree by rising distance; ``final`` is false where the search was cut.

    With ``unreachable`` every vertex is listed, those not reached with nulls.
    """
    held = vertices.select(F.col("id").alias("node")).join(tree, "node", "left" if unreachable else "inner")
    return held.select("node", "dist", F.col("settled_rank").isNotNull().alias("final")).orderBy(F.col("dist").asc_nulls_last(), "node")
