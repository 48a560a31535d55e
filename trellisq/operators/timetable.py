"""The timetable model: clean events, trip groups, expected pairs, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisq.functions.exprs import dotted_key, hour_bucket, parse_time, wrapped_diff
from trellisq.operators.references import bare
from trellisq.sources.gtfs import last_rows, ranked_rows

PAIR = ["line", "direction", "a", "b"]


def clean_stop_times(stop_times: DataFrame) -> DataFrame:
    """trip_id, seq, stop_id, arrival_time, departure_time, row_no: one event per trip and sequence number.

    Ids without outer blanks; rows without trip, stop or sequence are left out; of
    repeated rows the first in file order stays.  Combined before the shuffle.
    """
    rows = stop_times.select(
        bare("trip_id").alias("trip_id"),
        F.col("stop_sequence").cast("int").alias("seq"),
        bare("stop_id").alias("stop_id"),
        F.trim("arrival_time").alias("arrival_time"),
        F.trim("departure_time").alias("departure_time"),
        F.col("row_no").cast("long").alias("row_no"),
    ).where("trip_id is not null and stop_id is not null and seq is not null")
    kept = rows.groupBy("trip_id", "seq").agg(F.min(F.struct("row_no", "stop_id", "arrival_time", "departure_time")).alias("r"))
    return kept.select("trip_id", "seq", "r.stop_id", "r.arrival_time", "r.departure_time", "r.row_no")


def clean_trips(trips: DataFrame) -> DataFrame:
    """trip_id, line, direction, headsign, row_no: the last row of each trip wins; the line is the route id."""
    rows = trips.select(
        bare("trip_id").alias("trip_id"),
        bare("route_id").alias("line"),
        F.col("direction_id").try_cast("int").alias("direction"),
        F.nullif(F.trim("trip_headsign"), F.lit("")).alias("headsign"),
        F.col("row_no").cast("long").alias("row_no"),
    )
    return last_rows(rows, ["trip_id"])


def trip_groups(trips: DataFrame, routes: DataFrame) -> DataFrame:
    """trip_id, line, direction of the trips with a known route and direction 0 or 1."""
    known = routes.select(bare("route_id").alias("line")).where("line is not null").distinct()
    return clean_trips(trips).where("direction in (0, 1)").join(known, "line", "left_semi").select("trip_id", "line", "direction")


def route_stops(events: DataFrame, groups: DataFrame) -> DataFrame:
    """Line, pos, stop_id: the stop order of each line, from its trips in direction 0.

    At each sequence number stands the line's most frequent stop (ties: the smaller id); a
    stop that leads at several numbers stays where it is most frequent (ties: the smaller
    number).  Stops of rarer trip patterns are on no place.
    """
    at = events.join(groups.where("direction = 0"), "trip_id").groupBy("line", "stop_id", "seq").agg(F.count(F.lit(1)).alias("n"))
    leading = at.groupBy("line", "seq").agg(F.min(F.struct((-F.col("n")).alias("m"), "stop_id")).alias("x"))
    usual = leading.groupBy("line", F.col("x.stop_id").alias("stop_id")).agg(F.min(F.struct("x.m", "seq"))["seq"].alias("seq"))
    w = Window.partitionBy("line").orderBy("seq")
    return usual.select("line", F.row_number().over(w).alias("pos"), "stop_id")


def line_order(lines: DataFrame) -> DataFrame:
    """F8: line, line_ord from 0 in natural dotted order (then by text)."""
    held = lines.select("line").distinct()
    return ranked_rows(held, [*dotted_key("line"), "line"], "line_ord", 0)


def forward_pairs(stops: DataFrame) -> DataFrame:
    """line, a, b: consecutive stops of each line in its order."""
    nxt = F.lead("stop_id").over(Window.partitionBy("line").orderBy("pos"))
    return stops.select("line", F.col("stop_id").alias("a"), nxt.alias("b")).where("b is not null")


def expected_pairs(stops: DataFrame) -> DataFrame:
    """M1: line, direction, a, b: the stop pairs of each line, reversed for direction 1."""
    fwd = forward_pairs(stops)
    return fwd.select("line", F.lit(0).alias("direction"), "a", "b").unionByName(fwd.select("line", F.lit(1).alias("direction"), F.col("b").alias("a"), F.col("a").alias("b")))


def first_mention(stops: DataFrame, order: DataFrame) -> DataFrame:
    """stop_id, rank: where the lines, in their order, first name the stop (a sort key: line order and place)."""
    return stops.join(order, "line").groupBy("stop_id").agg(F.min(F.struct("line_ord", "pos")).alias("rank"))


def stop_rank(stops: DataFrame, order: DataFrame) -> DataFrame:
    """stop_id, rank from 0: the order in which the lines first name the stops."""
    first = first_mention(stops, order).withColumnRenamed("rank", "at")
    return ranked_rows(first, ["at", "stop_id"], "rank", 0).drop("at")


def consecutive(events: DataFrame) -> DataFrame:
    """each event with the next one of its trip (next_ columns; null after the last)."""
    w = Window.partitionBy("trip_id").orderBy("seq", "row_no")
    return events.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in ("seq", "stop_id", "arrival_time", "departure_time")))


def transitions(events: DataFrame, groups: DataFrame, stops: DataFrame) -> DataFrame:
    """Line, direction, a, b, trip_id, hour, total, door, run: one row per valid transition.

    Events away from the line's stops are dropped before pairing; a transition joins
    neighbours with consecutive sequence numbers that are an expected pair.  Seconds
    gain whole days until they are not negative; a missing time leaves them null.
    """
    held = events.join(groups, "trip_id").join(stops.select("line", "stop_id"), ["line", "stop_id"], "left_semi")
    pairs = consecutive(held).where("next_seq = seq + 1").select("*", F.col("stop_id").alias("a"), F.col("next_stop_id").alias("b"))
    arr, dep, nxt = parse_time("arrival_time"), parse_time("departure_time"), parse_time("next_arrival_time")
    return pairs.join(expected_pairs(stops), PAIR, "left_semi").select(
        *PAIR,
        "trip_id",
        hour_bucket(arr).alias("hour"),
        wrapped_diff(arr, nxt).alias("total"),
        wrapped_diff(arr, dep).alias("door"),
        wrapped_diff(dep, nxt).alias("run"),
    )


def bounds(events: DataFrame) -> DataFrame:
    """trip_id, first_seq, last_seq."""
    return events.groupBy("trip_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def kind(c: str | Column) -> Column:
    """What the prefix of a stop id says: platform, entrance, or other."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(x.startswith("1."), "platform").when(x.startswith("E."), "entrance").otherwise("other")
