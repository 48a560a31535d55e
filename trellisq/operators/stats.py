"""Statistics of travel times per directed pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisq.functions.exprs import sample_stdev
from trellisq.operators.timetable import PAIR
from trellisq.sources.gtfs import ranked_rows

# Upper bounds (exclusive) and labels.
CV_BUCKETS = ((0.05, "extremely stable"), (0.10, "stable"), (0.15, "acceptable"), (None, "unstable"))
RANGE_BUCKETS = ((0.05, "static weight is excellent"), (0.15, "static weight still reasonable"), (None, "time-dependent routing would help"))
DOMINANT_SHARE = 0.70
CV_LIMIT = RANGE_LIMIT = 0.15


def bucket(x: Column, bounds: tuple[tuple[float | None, str], ...]) -> Column:
    """The label of the first bound above x."""
    out = F.lit(bounds[-1][1])
    for limit, label in reversed(bounds[:-1]):
        out = F.when(x < limit, label).otherwise(out)
    return F.when(x.isNotNull(), out)


def pair_stats(samples: DataFrame, value: str = "total") -> DataFrame:
    """Line, direction, a, b, n, mean, stdev, median of one kind of seconds (total, door or run)."""
    v = F.col(value)
    return samples.where(v.isNotNull()).groupBy(*PAIR).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), sample_stdev(v).alias("stdev"), F.median(v).alias("median"))


def all_pair_stats(expected: DataFrame, stats: DataFrame) -> DataFrame:
    """D8, D19j: every expected pair with its statistics; n = 0 and nulls where nothing was observed."""
    return expected.join(stats, PAIR, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cv_ranking(stats: DataFrame) -> DataFrame:
    """Rank, pair, n, mean, stdev, median, cv, bucket; highest variation first, ties by line, direction and pair."""
    held = stats.where("mean > 0").withColumn("cv", F.col("stdev") / F.col("mean")).withColumn("bucket", bucket(F.col("cv"), CV_BUCKETS))
    return ranked(held, "cv")


def ranked(df: DataFrame, metric: str) -> DataFrame:
    """Rank from 1 by falling metric, then line, direction, a, b."""
    return ranked_rows(df, [F.col(metric).desc(), *PAIR], "rank")


def top(df: DataFrame, metric: str, k: int) -> DataFrame:
    """The k first by falling metric and ascending pair."""
    return df.orderBy(F.col(metric).desc(), *PAIR).limit(k)


def bucket_counts(df: DataFrame, bounds: tuple[tuple[float | None, str], ...]) -> DataFrame:
    """Bucket, n, pct for every label, zero where there is none."""
    labels = F.explode(F.array(*(F.lit(label) for _, label in bounds))).alias("bucket")
    every = df.sparkSession.range(1).select(labels)
    n = df.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return every.join(n, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n")).withColumn("pct", F.coalesce(F.try_divide(F.col("n") * 100.0, total), F.lit(0.0)))


def hourly(samples: DataFrame) -> DataFrame:
    """Pair, hour, n and mean and deviation of total, door and run (total is door + run of the row)."""
    held = samples.where("door is not null and run is not null").withColumn("total", F.col("door") + F.col("run"))
    return held.groupBy(*PAIR, "hour").agg(
        F.count(F.lit(1)).alias("n"),
        *(f(F.col(c)).alias(f"{c}_{name}") for c in ("total", "door", "run") for name, f in (("mean", F.avg), ("stdev", sample_stdev))),
    )


def hourly_range(samples: DataFrame, stats: DataFrame) -> DataFrame:
    """Pair, mean, range, range_pct, min_hours, min_mean, max_hours, max_mean, bucket, rank.

    Pairs with a positive mean and at least two hours; every hour tied for the least or
    greatest mean is listed.  Means are compared as the same quotient of whole numbers.
    """
    held = samples.where("door is not null and run is not null")
    per = held.groupBy(*PAIR, "hour").agg((F.sum(F.col("door") + F.col("run")) / F.count(F.lit(1))).alias("m"))
    w = Window.partitionBy(*PAIR)
    ends = per.withColumn("lo", F.min("m").over(w)).withColumn("hi", F.max("m").over(w))
    hours = lambda at: F.array_join(F.array_sort(F.collect_list(F.when(F.col("m") == F.col(at), F.col("hour")))).cast("array<string>"), ",")
    agg = ends.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("hours"), F.first("lo").alias("min_mean"), F.first("hi").alias("max_mean"), hours("lo").alias("min_hours"), hours("hi").alias("max_hours"))
    out = agg.where("hours >= 2").join(stats.where("mean > 0").select(*PAIR, "mean"), PAIR).withColumn("range", F.col("max_mean") - F.col("min_mean"))
    out = out.withColumn("range_pct", F.col("range") / F.col("mean")).withColumn("bucket", bucket(F.col("range_pct"), RANGE_BUCKETS))
    return ranked(out, "range_pct").select("rank", *PAIR, "mean", "range", "range_pct", "min_hours", "min_mean", "max_hours", "max_mean", "bucket")


def hourly_breakdown(samples: DataFrame, cv: DataFrame, ranges: DataFrame, k: int = 2, cv_limit: float = CV_LIMIT, range_limit: float = RANGE_LIMIT) -> DataFrame:
    """Section, place, pair, hour and the hourly figures of the k edges that vary most, by cv and by hourly range.

    Only edges beyond the limits count.  An edge of both sections has its hours under
    ``cv``; under ``range`` it has one row without hours, and ``shown_at`` tells its place
    under ``cv``.
    """
    placed = lambda df, metric, limit: top(df.where(F.col(metric) >= limit), metric, k).select(*PAIR, F.col("rank").alias("place"))
    by_cv, by_range = placed(cv, "cv", cv_limit), placed(ranges, "range_pct", range_limit)
    again = by_range.join(by_cv.withColumnRenamed("place", "shown_at"), PAIR, "left")
    shown = by_cv.select(F.lit("cv").alias("section"), *PAIR, "place", F.lit(None).cast("int").alias("shown_at")).unionByName(again.select(F.lit("range").alias("section"), *PAIR, "place", "shown_at"))
    edges = shown.where("shown_at is null")
    hours = hourly(samples.join(F.broadcast(edges.select(*PAIR).distinct()), PAIR, "left_semi"))  # 2k edges at most
    return edges.join(hours, PAIR).unionByName(shown.where("shown_at is not null"), allowMissingColumns=True)


def dominance(door: DataFrame, run: DataFrame, share: float = DOMINANT_SHARE) -> DataFrame:
    """C14: pair, door_stdev, run_stdev, dominant: which side holds at least ``share`` of the summed deviation."""
    both = door.select(*PAIR, F.col("stdev").alias("door_stdev")).join(run.select(*PAIR, F.col("stdev").alias("run_stdev")), PAIR)
    sum_ = F.col("door_stdev") + F.col("run_stdev")
    return both.withColumn("dominant", F.when(sum_ > 0, F.when(F.col("door_stdev") / sum_ >= share, "door").when(F.col("run_stdev") / sum_ >= share, "run")))


def flagged_edges(cv: DataFrame, ranges: DataFrame, cv_limit: float = CV_LIMIT, range_limit: float = RANGE_LIMIT) -> DataFrame:
    """M13, E27, H6s: pair, reasons of the edges beyond either limit."""
    a = cv.where(F.col("cv") >= cv_limit).select(*PAIR, F.lit("cv").alias("reason"))
    b = ranges.where(F.col("range_pct") >= range_limit).select(*PAIR, F.lit("range").alias("reason"))
    return a.unionByName(b).groupBy(*PAIR).agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def verdict(cv: DataFrame, flagged: DataFrame) -> DataFrame:
    """Edges, flagged, passing, passing_pct."""
    n, bad = cv.agg(F.count(F.lit(1)).alias("edges")), flagged.agg(F.count(F.lit(1)).alias("flagged"))
    both = n.crossJoin(bad)  # one row each
    return both.withColumn("passing", F.col("edges") - F.col("flagged")).withColumn("passing_pct", F.coalesce(F.try_divide(F.col("passing") * 100.0, F.col("edges")), F.lit(0.0)))


def directional_asymmetry(stats: DataFrame) -> DataFrame:
    """M14, D11j: line, a, b, mean_0, mean_1, gap: a pair against its way back on the same line."""
    one = stats.where("direction = 1").select("line", F.col("b").alias("a"), F.col("a").alias("b"), F.col("mean").alias("mean_1"), F.col("n").alias("n_1"))
    zero = stats.where("direction = 0").select("line", "a", "b", F.col("mean").alias("mean_0"), F.col("n").alias("n_0"))
    return zero.join(one, ["line", "a", "b"]).withColumn("gap", F.abs(F.col("mean_0") - F.col("mean_1")))


def line_spread(stats: DataFrame) -> DataFrame:
    """A, b, lines, n_lines, spread: largest less smallest mean over the lines of a pair (two or more)."""
    per = stats.groupBy("a", "b", "line").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("mean"))
    out = per.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.array_sort(F.collect_list("line")), "/").alias("lines"), (F.max("mean") - F.min("mean")).alias("spread"))
    return out.where("n_lines >= 2")


def line_report(route_stops: DataFrame, names: DataFrame, pathways: DataFrame) -> DataFrame:
    """M16, C15, H11s: line, pos, stop_id, stop_name, entrance, entrance_name, direction; stops without entrance once.

    ``pathways`` has a, b.  Direction says which ways between platform and entrance exist.
    """
    out_ = pathways.where(F.col("a").startswith("1.") & F.col("b").startswith("E.")).select(F.col("a").alias("stop_id"), F.col("b").alias("entrance"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    in_ = pathways.where(F.col("a").startswith("E.") & F.col("b").startswith("1.")).select(F.col("b").alias("stop_id"), F.col("a").alias("entrance"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    ways = out_.unionByName(in_).groupBy("stop_id", "entrance").agg(F.max("out").alias("out"), F.max("in").alias("in"))
    way = F.when((F.col("out") == 1) & (F.col("in") == 1), "both").when(F.col("out") == 1, "platform_to_entrance").when(F.col("in") == 1, "entrance_to_platform")
    held = route_stops.join(ways, "stop_id", "left").join(names, "stop_id", "left").join(names.select(F.col("stop_id").alias("entrance"), F.col("stop_name").alias("entrance_name")), "entrance", "left")
    return held.select("line", "pos", "stop_id", F.coalesce("stop_name", F.lit("")).alias("stop_name"), "entrance", "entrance_name", way.alias("direction"))
