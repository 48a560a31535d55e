"""Graph tables: edges and vertices, coverage, statistics, depth of branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisq.functions.exprs import flat_distance
from trellisq.sources.gtfs import last_rows


def edges(weights: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Src, dst, weight, type; of repeated pairs the last row wins; listed types are left out."""
    held = weights.where(~F.col("type").isin(*exclude)) if exclude else weights
    if "row_no" not in held.columns:
        held = held.withColumn("row_no", F.lit(0))
    rows = held.select(F.col("from_stop_id").alias("src"), F.col("to_stop_id").alias("dst"), F.col("weight_seconds").cast("long").alias("weight"), "type", "row_no")
    return last_rows(rows, ["src", "dst"]).drop("row_no")


def vertices(edges: DataFrame) -> DataFrame:
    """H2s, S12: id of every vertex; those without outgoing edges too."""
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """J2, H8s: a, b in both orders of every pair."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).distinct()


def entrance_maps(edges: DataFrame, entrance_type: str = "PW") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(platform, entrance) pairs as coverage, platform to entrance, entrance to platform."""
    held = edges.where(F.col("type") == entrance_type)
    out = held.where(F.col("dst").startswith("E.")).select(F.col("src").alias("platform"), F.col("dst").alias("entrance")).distinct()
    back = held.where(F.col("src").startswith("E.")).select(F.col("dst").alias("platform"), F.col("src").alias("entrance")).distinct()
    return out.union(back).distinct(), out, back


def graph_stats(edges: DataFrame) -> DataFrame:
    """Type (ALL for the whole), arcs, pairs (unordered): by grouping sets."""
    pair = F.struct(F.least("src", "dst"), F.greatest("src", "dst"))
    held = edges.select("type", pair.alias("pair"))
    return held.rollup("type").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("arcs"), F.count_distinct("pair").alias("pairs")).select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("type")).alias("type"), "arcs", "pairs")


def capacity(edges: DataFrame) -> DataFrame:
    """Vertices, arcs, density arcs / (V * (V - 1)), null for fewer than two vertices."""
    both = vertices(edges).agg(F.count(F.lit(1)).alias("vertices")).crossJoin(edges.agg(F.count(F.lit(1)).alias("arcs")))  # one row each
    return both.withColumn("density", F.try_divide(F.col("arcs").cast("double"), (F.col("vertices") * (F.col("vertices") - 1)).cast("double")))


def max_speed(edges: DataFrame, coordinates: DataFrame) -> DataFrame:
    """J16, E26, D21j, H5: speed (m/s), src, dst of the fastest edge with weight and coordinates on both ends."""
    at = lambda c, k: coordinates.select(F.col("stop_id").alias(c), F.col("stop_lat").alias(f"lat{k}"), F.col("stop_lon").alias(f"lon{k}"))
    held = edges.where("weight > 0").join(at("src", 1), "src").join(at("dst", 2), "dst")
    speed = flat_distance(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")) / F.col("weight")
    return held.agg(F.max(F.struct(speed.alias("speed"), "src", "dst")).alias("m")).select("m.*")


def branch_depths(edges: DataFrame, branches: DataFrame, bridges: DataFrame) -> DataFrame:
    """Branch, stop_id, depth_from (bridge to stop), depth_to (stop to bridge).

    ``branches`` has branch, pos (outermost first), stop_id; ``bridges`` has branch,
    bridge.  Depths are two running sums along the chain from the bridge outward.
    """
    chain = branches.join(bridges, "branch")
    out = Window.partitionBy("branch").orderBy(F.col("pos").desc())
    steps = chain.withColumn("inner", F.coalesce(F.lag("stop_id").over(out), F.col("bridge")))
    w = lambda a, b, name: edges.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("weight").alias(name))
    both = steps.join(w("inner", "stop_id", "w_out"), ["inner", "stop_id"], "left").join(w("stop_id", "inner", "w_in"), ["inner", "stop_id"], "left")
    run = out.rowsBetween(Window.unboundedPreceding, 0)
    return both.select("branch", "stop_id", F.sum("w_out").over(run).alias("depth_from"), F.sum("w_in").over(run).alias("depth_to"))


def classify(pairs: DataFrame, branches: DataFrame, platforms: DataFrame) -> DataFrame:
    """Adds case_: CC, CB, BC, SB or DB by where source and target lie; anything else raises an error.

    ``platforms`` has stop_id of all platforms; those on no branch are the center (H5s).
    """
    where = platforms.select("stop_id").distinct().join(branches.select("stop_id", "branch"), "stop_id", "left").select("stop_id", F.coalesce("branch", F.lit("")).alias("region"))
    of = lambda c: where.select(F.col("stop_id").alias(c), F.col("region").alias(f"{c}_region"))
    held = pairs.join(of("source"), "source", "left").join(of("target"), "target", "left")
    s, t = F.col("source_region"), F.col("target_region")
    case = (
        F.when(s.isNull() | t.isNull(), F.raise_error(F.concat(F.lit("unknown platform in "), F.coalesce("source", F.lit("null")), F.lit(" -> "), F.coalesce("target", F.lit("null")))))
        .when((s == "") & (t == ""), "CC")
        .when(s == "", "CB")
        .when(t == "", "BC")
        .when(s == t, "SB")
        .otherwise("DB")
    )
    return held.withColumn("case_", case)


def path_ends(path: str = "path") -> tuple[Column, Column]:
    """The platforms at the ends of a path: its first and last vertex, or the ones beside them where these are entrances."""
    p, n = F.col(path), F.size(path)
    first, last = F.get(p, F.lit(0)), F.get(p, n - 1)
    return F.when(first.startswith("E."), F.get(p, F.lit(1))).otherwise(first), F.when(last.startswith("E."), F.get(p, n - 2)).otherwise(last)


def bridge_highlights(pairs: DataFrame, branches: DataFrame, bridges: DataFrame) -> DataFrame:
    """Source, target, bridge: the bridges of the branches that a pair's case names, each once; no row for CC.

    ``pairs`` has source and target platforms with case_ (:func:`classify`).
    """
    of = branches.select("stop_id", "branch").join(bridges, "branch").select("stop_id", "bridge")
    sides = [(("BC", "SB", "DB"), "source"), (("CB", "SB", "DB"), "target")]
    parts = [pairs.where(F.col("case_").isin(*cases)).join(of.withColumnRenamed("stop_id", c), c).select("source", "target", "bridge") for cases, c in sides]
    return parts[0].unionByName(parts[1]).distinct()


def spread_positions(coordinates: DataFrame, degrees: float = 0.0001) -> DataFrame:
    """stop_id, lat, lon: stops that share a place are set apart, the k-th by k steps at an angle of its own id.

    The angle is a hash of the id, so a drawing is the same every time.
    """
    w = Window.partitionBy("stop_lat", "stop_lon").orderBy("stop_id")
    k = F.row_number().over(w) - 1
    angle = F.pmod(F.xxhash64("stop_id"), F.lit(360)) * (3.141592653589793 / 180)
    return coordinates.select("stop_id", (F.col("stop_lat") + k * degrees * F.sin(angle)).alias("lat"), (F.col("stop_lon") + k * degrees * F.cos(angle)).alias("lon"))


def amplified_entrances(positions: DataFrame, cover: DataFrame, times: float) -> DataFrame:
    """stop_id, lat, lon: entrances moved away from the mean place of their platforms, ``times`` as far; other stops stay."""
    place = positions.withColumnRenamed("stop_id", "platform").withColumnsRenamed({"lat": "p_lat", "lon": "p_lon"})
    mean = cover.join(place, "platform").groupBy(F.col("entrance").alias("stop_id")).agg(F.avg("p_lat").alias("p_lat"), F.avg("p_lon").alias("p_lon"))
    away = lambda c: F.coalesce(F.col(f"p_{c}") + (F.col(c) - F.col(f"p_{c}")) * times, F.col(c)).alias(c)
    return positions.join(mean, "stop_id", "left").select("stop_id", away("lat"), away("lon"))


def choose(c: str | Column, palette: dict[str, str], default: str) -> Column:
    """The colour of a region, type or kind."""
    out = F.lit(default)
    for k, v in palette.items():
        out = F.when((F.col(c) if isinstance(c, str) else c) == k, v).otherwise(out)
    return out


def shared_vertices(ids: DataFrame, vertices: DataFrame) -> DataFrame:
    """H4s: id of those that are vertices too."""
    return ids.select("id").intersect(vertices.select("id"))


def drawing_table(edges: DataFrame, lines: DataFrame, coordinates: DataFrame) -> DataFrame:
    """D16j, J34, I21: src, dst, weight, type, line, coordinates of both ends, width: what a drawing needs."""
    at = lambda c, k: coordinates.select(F.col("stop_id").alias(c), F.col("stop_lat").alias(f"{k}_lat"), F.col("stop_lon").alias(f"{k}_lon"))
    held = edges.join(lines.select("src", "dst", "line"), ["src", "dst"], "left").join(at("src", "src"), "src", "left").join(at("dst", "dst"), "dst", "left")
    return held.withColumn("width", F.log10(F.col("weight") + 1))


def entrance_centroids(cover: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Entrance, lat, lon: the mean place of the platforms it serves."""
    return cover.join(coordinates.withColumnRenamed("stop_id", "platform"), "platform").groupBy("entrance").agg(F.avg("stop_lat").alias("lat"), F.avg("stop_lon").alias("lon"))


def coordinate_collisions(coordinates: DataFrame) -> DataFrame:
    """stop_lat, stop_lon, stops of the places that several stops share (counted, with the first id)."""
    return coordinates.groupBy("stop_lat", "stop_lon").agg(F.count(F.lit(1)).alias("stops"), F.min("stop_id").alias("first_id")).where("stops > 1")


def within(coordinates: DataFrame, lat: float, lon: float, radius: float) -> DataFrame:
    """The stops in the square of ``radius`` degrees around a place."""
    return coordinates.where(F.col("stop_lat").between(lat - radius, lat + radius) & F.col("stop_lon").between(lon - radius, lon + radius))
