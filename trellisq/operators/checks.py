"""Data-quality checks (L1-L18); each returns its violations as a DataFrame, empty when all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellisq.operators.references import bare
from trellisq.sources.gtfs import names, pathway_pairs


def foreign_keys(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]]) -> DataFrame:
    """L1-L3, D3j: table_name, field_name, key of every distinct key without a row in the parent table.

    ``links``: (child, field, parent, key).  Children are reduced to distinct keys first.
    """
    parts = []
    for child, field, parent, key in links:
        have = tables[parent].select(bare(key).alias("key")).where("key is not null").distinct()
        want = tables[child].select(bare(field).alias("key")).where("key is not null").distinct()
        parts.append(want.join(have, "key", "left_anti").select(F.lit(child).alias("table_name"), F.lit(field).alias("field_name"), "key"))
    return reduce(DataFrame.unionByName, parts)


def sequence_gaps(events: DataFrame) -> DataFrame:
    """L4: trip_id, seq, next_seq where the distinct sequence numbers of a trip do not rise by one."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    held = events.select("trip_id", "seq").distinct()
    return held.withColumn("next_seq", F.lead("seq").over(w)).where("next_seq <> seq + 1")


def headsign_directions(trips: DataFrame) -> DataFrame:
    """Line, headsigns, directions, issues of the lines without two headsigns and two directions, one to one."""
    held = trips.where("line is not null").select("line", F.coalesce("headsign", F.lit("")).alias("headsign"), F.coalesce(F.col("direction").cast("string"), F.lit("")).alias("direction")).distinct()
    per = held.groupBy("line", "headsign").agg(F.count_distinct(F.nullif("direction", F.lit(""))).alias("n"), F.min(F.nullif("direction", F.lit(""))).alias("only"))
    dirs = held.groupBy("line").agg(F.count_distinct("direction").alias("directions"))
    lines = per.groupBy("line").agg(
        F.count(F.lit(1)).alias("headsigns"),
        F.count_if(F.col("n") == 1).alias("mapped"),
        F.count_if(F.col("n") != 1).alias("ambiguous"),
        F.count_distinct(F.when(F.col("n") == 1, F.col("only"))).alias("targets"),
    )
    issues = F.filter(
        F.array(
            F.when(F.col("headsigns") != 2, "headsigns"),
            F.when(F.col("directions") != 2, "directions"),
            F.when(F.col("ambiguous") > 0, "ambiguous"),
            F.when((F.col("mapped") == 2) & (F.col("targets") != 2), "same_direction"),
        ),
        lambda x: x.isNotNull(),
    )
    return lines.join(dirs, "line").withColumn("issues", F.array_join(issues, ",")).where("issues <> ''").select("line", "headsigns", "directions", "issues")


def routes_without_trips(routes: DataFrame, trips: DataFrame) -> DataFrame:
    """Line of the routes without a trip."""
    return routes.select(bare("route_id").alias("line")).where("line is not null").distinct().join(trips.select("line"), "line", "left_anti")


def pair_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """L7, H3s, H7s: a, b, side: unordered pairs that only one of two pair tables (a, b) has."""
    canon = lambda df, s: df.where("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(s).alias("side")).distinct()
    both = canon(left, "left").unionByName(canon(right, "right"))
    return both.groupBy("a", "b").agg(F.min("side").alias("side"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")


def missing_inverse(pathways: DataFrame) -> DataFrame:
    """L8, D9j: a, b of the pathways whose way back does not exist, by pathway id."""
    pairs = pathway_pairs(pathways).distinct()
    return pairs.join(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")


def uneven_times(pathways: DataFrame) -> DataFrame:
    """L9, D10j: a, b (a < b), there, back where the way back takes another time, each unordered pair once.

    ``pathways`` has a, b, seconds with one row per ordered pair.
    """
    back = pathways.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("seconds").alias("back"))
    return pathways.where("a < b").join(back, ["a", "b"]).where("seconds <> back").select("a", "b", F.col("seconds").alias("there"), "back")


def invalid_times(pathways: DataFrame, step: int = 15) -> DataFrame:
    """pathway_id, row_no, issue of traversal times that are missing or no multiple of ``step``."""
    t = F.col("traversal_time").cast("string").try_cast("int")
    issue = F.when(F.col("traversal_time").isNull(), "missing").when(t.isNull(), "not_numeric").when(F.pmod(t, F.lit(step)) != 0, "not_a_multiple")
    return pathways.select("pathway_id", "row_no", issue.alias("issue")).where("issue is not null")


def entrance_times(pathways: DataFrame, seconds: int = 60) -> DataFrame:
    """pathway_id, row_no, traversal_time of entrance pathways that do not take exactly ``seconds``."""
    a, b = bare("from_stop_id"), bare("to_stop_id")
    between = (a.startswith("E.") & b.startswith("1.")) | (a.startswith("1.") & b.startswith("E."))
    return pathways.where(between & ~F.col("traversal_time").eqNullSafe(seconds)).select("pathway_id", "row_no", "traversal_time")


def coverage(pathways: DataFrame) -> DataFrame:
    """Platform, entrance: distinct pairs joined by a pathway in either direction."""
    pairs = pathway_pairs(pathways)
    flip = pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))
    both = pairs.unionByName(flip).where(F.col("a").startswith("1.") & F.col("b").startswith("E."))
    return both.select(F.col("a").alias("platform"), F.col("b").alias("entrance")).distinct()


def entrance_distribution(stops: DataFrame, cover: DataFrame) -> DataFrame:
    """Platforms, entrances: how many entrances serve how many platforms, none included."""
    ids = stops.select(bare("stop_id").alias("entrance")).where("entrance like 'E.%'").distinct()
    per = ids.join(cover, "entrance", "left").groupBy("entrance").agg(F.count("platform").alias("platforms"))
    return per.groupBy("platforms").agg(F.count(F.lit(1)).alias("entrances"))


def uncovered_platforms(stops: DataFrame, cover: DataFrame, neighbours: DataFrame) -> DataFrame:
    """L13, D12j: platform, neighbour, entrance: platforms without an entrance, with the neighbours that have one.

    ``neighbours`` has a, b in either order; the entrance is the neighbour's smallest.
    A platform without such a neighbour has one row with nulls.
    """
    ids = stops.select(bare("stop_id").alias("platform")).where("platform like '1.%'").distinct()
    bare_ones = ids.join(cover, "platform", "left_anti")
    first = cover.groupBy(F.col("platform").alias("neighbour")).agg(F.min("entrance").alias("entrance"))
    both = neighbours.select("a", "b").unionByName(neighbours.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    near = both.select(F.col("a").alias("platform"), F.col("b").alias("neighbour")).join(first, "neighbour")
    return bare_ones.join(near, "platform", "left").select("platform", "neighbour", "entrance")


def same_name_transfers(stops: DataFrame, transfers: DataFrame) -> DataFrame:
    """L14, D13j: stop_name, platforms, pairs, present, missing: of the platforms of one name, how many pairs have a transfer.

    Counted, not listed: the pairs of a name grow with the square of its platforms.  Only
    transfers that exist (a, b) are joined with the names.
    """
    held = names(stops.where(F.col("stop_id").startswith("1."))).where("stop_name <> ''")
    sizes = held.groupBy("stop_name").agg(F.count(F.lit(1)).alias("platforms")).where("platforms > 1")
    pairs = transfers.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = pairs.join(held.select(F.col("stop_id").alias("a"), F.col("stop_name").alias("name_a")), "a").join(held.select(F.col("stop_id").alias("b"), F.col("stop_name").alias("name_b")), "b")
    present = ends.where("name_a = name_b").groupBy(F.col("name_a").alias("stop_name")).agg(F.count(F.lit(1)).alias("present"))
    n = F.call_function("div", F.col("platforms") * (F.col("platforms") - 1), F.lit(2))
    return sizes.join(present, "stop_name", "left").select("stop_name", "platforms", n.alias("pairs"), F.coalesce("present", F.lit(0)).alias("present")).withColumn("missing", F.col("pairs") - F.col("present")).where("missing > 0")


def same_name_pairs(stops: DataFrame, transfers: DataFrame) -> DataFrame:
    """L14, D13j: stop_name, u, v: for each name its first platform with every other one that has no transfer to it, in either order.

    One row per platform at most; :func:`same_name_transfers` counts all pairs.
    """
    held = names(stops.where(F.col("stop_id").startswith("1."))).where("stop_name <> ''")
    first = held.groupBy("stop_name").agg(F.min("stop_id").alias("u"))
    pairs = held.join(first, "stop_name").where("stop_id <> u").select("stop_name", "u", F.col("stop_id").alias("v"))
    both = transfers.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    return pairs.join(both, ["u", "v"], "left_anti").select("stop_name", "u", "v")


def equal_times_left(counts: DataFrame) -> DataFrame:
    """The (line, stop) that still have events with equal arrival and departure (verify mode of K6)."""
    return counts.where("equal > 0").select("line", "stop_id", "equal", "terminal", "total")


def weight_mismatches(reports: dict[str, DataFrame]) -> DataFrame:
    """L18, J27, E28, D17j: source, target, weights, kinds of the pairs on which reports disagree.

    ``reports``: name to (source, target, weight), null for unreachable.  One union and
    one aggregate in place of chained outer joins.
    """
    tagged = [df.select("source", "target", F.col("weight").cast("long").alias("weight"), F.lit(n).alias("report")) for n, df in reports.items()]
    all_ = reduce(DataFrame.unionByName, tagged)
    per = all_.groupBy("source", "target").agg(
        F.count_distinct("weight").alias("weights"),
        F.count("weight").alias("reached"),
        *(F.max(F.when(F.col("report") == n, F.col("weight"))).alias(f"w_{n}") for n in reports),
    )
    kind = F.when(F.col("weights") > 1, "weight").when((F.col("reached") > 0) & (F.col("reached") < len(reports)), "reachability")
    return per.withColumn("mismatch", kind).where("mismatch is not null").select("source", "target", "mismatch", *(f"w_{n}" for n in reports))
