"""The stages from raw timetable to weighted edges (K1-K10), each a DataFrame transform."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisq.functions.exprs import dotted_key, format_time, parse_time
from trellisq.operators.timetable import bounds, consecutive, expected_pairs, transitions
from trellisq.sources.gtfs import ranked_rows


def network_filter(df: DataFrame, prefix: str = "2.", column: str | None = None) -> DataFrame:
    """Rows whose first (or named) column does not begin with another network's prefix; nulls stay."""
    c = F.trim(column or df.columns[0])
    return df.where(F.coalesce(~c.startswith(prefix), F.lit(True)))


def network_counts(df: DataFrame, prefix: str = "2.", column: str | None = None) -> DataFrame:
    """Total, removed, kept."""
    gone = F.coalesce(F.trim(column or df.columns[0]).startswith(prefix), F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(gone).alias("removed"), F.count_if(~gone).alias("kept"))


# Fixed value: where a row without a sequence number is sorted to.
NO_NUMBER = 10**9


def natural_order(df: DataFrame, column: str, *then: str) -> list[Column]:
    """Sort keys of dotted ids by their numbers, then the given columns."""
    return [*dotted_key(column), *(F.coalesce(c, F.lit(NO_NUMBER)) if c == "stop_sequence" else F.col(c) for c in then)]


# K2, K3: duplicate trips ------------------------------------------------------------


def trip_signatures(events: DataFrame, columns: tuple[str, ...] = ("seq", "arrival_time", "departure_time", "stop_id")) -> DataFrame:
    """trip_id and a signature of its events: number and two hash sums, combined before the shuffle.

    The events are never gathered; equal signatures are verified event by event in
    :func:`duplicate_trips`.
    """
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]
    h1, h2 = F.xxhash64(*cols), F.xxhash64(F.lit(17), *reversed(cols))
    return events.groupBy("trip_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.pmod(h1, F.lit(1 << 40))).alias("s1"),
        F.sum(F.pmod(h2, F.lit(1 << 40))).alias("s2"),
        F.bit_xor(h1).alias("x1"),
        F.bit_xor(h2).alias("x2"),
    )


def duplicate_trips(events: DataFrame, columns: tuple[str, ...] = ("seq", "arrival_time", "departure_time", "stop_id")) -> DataFrame:
    """trip_id, keep, n_events: trips whose events equal those of ``keep``, the smallest trip id of the group.

    The kept trip itself is no row.  Equality of the events is verified by a join.
    """
    sig = ["n", "s1", "s2", "x1", "x2"]
    trips = trip_signatures(events, columns)
    first = trips.groupBy(*sig).agg(F.min("trip_id").alias("keep"), F.count(F.lit(1)).alias("size")).where("size > 1")
    pairs = trips.join(first, sig).where("trip_id <> keep").select("trip_id", "keep", "n")
    own = events.join(pairs, "trip_id").select("trip_id", "keep", "n", *columns)
    kept = events.join(pairs.select(F.col("keep").alias("trip_id")).distinct(), "trip_id", "left_semi").select(F.col("trip_id").alias("k"), *(F.col(c).alias(f"k_{c}") for c in columns)).distinct()
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in columns))
    met = own.join(kept, (F.col("keep") == F.col("k")) & same).groupBy("trip_id", "keep", "n").agg(F.count(F.lit(1)).alias("equal"))
    return met.where("equal = n").select("trip_id", "keep", F.col("n").alias("n_events"))


def group_sizes(duplicates: DataFrame) -> DataFrame:
    """Size, groups, example: how many groups have how many trips, and the smallest kept trip of each size."""
    groups = duplicates.groupBy("keep").agg((F.count(F.lit(1)) + 1).alias("size"))
    return groups.groupBy("size").agg(F.count(F.lit(1)).alias("groups"), F.min("keep").alias("example"))


def group_listing(duplicates: DataFrame) -> DataFrame:
    """Place, keep, size: the groups by size, then by their members (the kept one is the smallest of its group and of no other)."""
    groups = duplicates.groupBy("keep").agg((F.count(F.lit(1)) + 1).alias("size"))
    return ranked_rows(groups, ["size", "keep"], "place").select("place", "keep", "size")


def without(df: DataFrame, ids: DataFrame, key: str = "trip_id") -> DataFrame:
    """K3, D2j: the rows whose key is not among the given ones."""
    return df.join(ids.select(key).distinct(), key, "left_anti")


# K4, K5: stop order -----------------------------------------------------------------


def order_violations(events: DataFrame, trips: DataFrame, stops: DataFrame) -> DataFrame:
    """trip_id, stop_a, stop_b, seq_a, seq_b: neighbours with consecutive numbers that break the line's order.

    Any direction but 1 counts as forward (S19); lines without a stop order pass.
    """
    lines = stops.select("line").distinct()
    run = consecutive(events.join(trips.select("trip_id", "line", "direction"), "trip_id").join(lines, "line", "left_semi"))
    pairs = run.where("next_seq = seq + 1").select(
        "trip_id",
        "line",
        F.when(F.col("direction").eqNullSafe(1), 1).otherwise(0).alias("direction"),
        F.col("stop_id").alias("a"),
        F.col("next_stop_id").alias("b"),
        F.col("seq").alias("seq_a"),
        F.col("next_seq").alias("seq_b"),
    )
    bad = pairs.join(expected_pairs(stops), ["line", "direction", "a", "b"], "left_anti")
    return bad.select("trip_id", F.col("a").alias("stop_a"), F.col("b").alias("stop_b"), "seq_a", "seq_b")


def open_gaps(events: DataFrame, breaks: DataFrame) -> DataFrame:
    """K5, D6j, F4: the events with their sequence moved up by the number of breaks (seq_b) at or before them.

    Breaks are unioned in as marks and counted by one running sum per trip, so no row
    meets all breaks of its trip.
    """
    marks = breaks.groupBy("trip_id", F.col("seq_b").alias("seq")).agg(F.count(F.lit(1)).alias("mark"))
    both = events.withColumn("mark", F.lit(0).cast("long")).unionByName(marks.select("trip_id", "seq", "mark"), allowMissingColumns=True)
    w = Window.partitionBy("trip_id").orderBy("seq", F.col("row_no").isNotNull(), "row_no").rowsBetween(Window.unboundedPreceding, 0)
    moved = both.withColumn("moved", F.sum("mark").over(w)).where("row_no is not null")
    return moved.withColumn("seq", (F.col("seq") + F.col("moved")).cast("int")).select(events.columns)


# K6, K7: door times -----------------------------------------------------------------


def dwell_counts(events: DataFrame, trips: DataFrame) -> DataFrame:
    """E5: line, stop_id, equal, terminal, total, samples, dwell_sum, dwell_n, dwell_mean, dwell_stdev.

    ``equal``: arrival and departure are the same text; ``terminal``: of these, at the
    trip's first or last event; ``samples``: the first five such trips in file order;
    dwell: non-negative departure minus arrival of the others, without a day's wrap (H7).
    """
    w = Window.partitionBy("trip_id")
    held = (
        events.withColumn("first_seq", F.min("seq").over(w))
        .withColumn("last_seq", F.max("seq").over(w))
        .join(trips.where("line is not null").select("trip_id", "line"), "trip_id")
        .where("arrival_time <> '' and departure_time <> ''")
    )
    equal = F.col("arrival_time") == F.col("departure_time")
    dwell = parse_time("departure_time") - parse_time("arrival_time")
    d = F.when(~equal & (dwell >= 0), dwell)
    ends = (F.col("seq") == F.col("first_seq")) | (F.col("seq") == F.col("last_seq"))
    early = held.withColumn("equal", equal).withColumn("d", d).withColumn("ends", ends)
    counts = early.groupBy("line", "stop_id").agg(
        F.count_if("equal").alias("equal"),
        F.count_if(F.col("equal") & F.col("ends")).alias("terminal"),
        F.count(F.lit(1)).alias("total"),
        F.sum("d").alias("dwell_sum"),
        F.count("d").alias("dwell_n"),
        F.avg("d").alias("dwell_mean"),
        F.when(F.count("d") > 0, F.coalesce(F.stddev_samp("d"), F.lit(0.0))).alias("dwell_stdev"),
    )
    place = F.row_number().over(Window.partitionBy("line", "stop_id").orderBy("row_no"))
    first = early.where("equal").select("line", "stop_id", "row_no", "trip_id", place.alias("k")).where("k <= 5")
    samples = first.groupBy("line", "stop_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "trip_id"))), lambda x: x["trip_id"]).alias("samples"))
    return counts.join(samples, ["line", "stop_id"], "left")


def door_seconds(counts: DataFrame, excluded: tuple[str, ...] = ("FM",)) -> DataFrame:
    """stop_id, line, door_seconds for every (line, stop) with equal times.

    Some equal: the stop's own mean; all equal: the line's mean, and where the line has
    no dwell at all the mean over the lines that are not ``excluded``.  Means are exact,
    halves up, 0 for none.
    """
    mean = lambda s, n: F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(0).cast("long")).otherwise(F.call_function("div", s * 2 + n, n * 2))
    per_line = counts.groupBy("line").agg(F.sum("dwell_sum").alias("line_sum"), F.sum("dwell_n").alias("line_n"))
    pool = counts.where(~F.col("line").isin(*excluded)).agg(F.sum("dwell_sum").alias("pool_sum"), F.sum("dwell_n").alias("pool_n"))
    held = counts.where("equal > 0").join(per_line, "line").crossJoin(F.broadcast(pool))  # one row on the right
    line_mean = F.when(F.col("line_n") > 0, mean(F.col("line_sum"), F.col("line_n"))).otherwise(mean(F.col("pool_sum"), F.col("pool_n")))
    return held.select("stop_id", "line", F.when(F.col("equal") == F.col("total"), line_mean).otherwise(mean(F.col("dwell_sum"), F.col("dwell_n"))).cast("int").alias("door_seconds"))


def line_dwell(counts: DataFrame) -> DataFrame:
    """Line, n, mean_seconds, stdev_seconds: dwell per line (no samples: n = 0 and nulls; one: deviation 0).

    Pooled from the stops' own means and deviations, around the line's mean.
    """
    per = counts.groupBy("line").agg(F.sum("dwell_n").alias("n"), (F.sum("dwell_sum") / F.nullif(F.sum("dwell_n"), F.lit(0))).alias("mean_seconds"))
    off = counts.join(per.select("line", "mean_seconds"), "line").groupBy("line")
    k, m = F.col("dwell_n"), F.col("dwell_mean") - F.col("mean_seconds")
    squares = off.agg(F.sum((k - 1) * F.col("dwell_stdev") * F.col("dwell_stdev") + k * m * m).alias("squares"))
    return per.join(squares, "line").select("line", "n", "mean_seconds", F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).when(F.col("n") == 1, 0.0).alias("stdev_seconds"))


def partial_dwell(counts: DataFrame) -> DataFrame:
    """The (line, stop) where some, but not all, events have equal times."""
    return counts.where("equal > 0 and equal < total").select("line", "stop_id", "equal", "total", "dwell_n", "dwell_mean", "dwell_stdev")


def apply_door_times(events: DataFrame, trips: DataFrame, doors: DataFrame) -> DataFrame:
    """K7, D5j: first events arrive and last events depart ``door_seconds`` apart where their times were equal.

    Everything else passes unchanged; a trip of one event counts as its first.
    """
    held = (
        events.join(bounds(events), "trip_id")
        .join(trips.select("trip_id", "line"), "trip_id", "left")
        .join(doors.select("stop_id", "line", "door_seconds"), ["stop_id", "line"], "left")
    )
    hit = (F.col("arrival_time") == F.col("departure_time")) & (F.col("arrival_time") != "") & F.col("door_seconds").isNotNull()
    first, last = F.col("seq") == F.col("first_seq"), F.col("seq") == F.col("last_seq")
    dep = parse_time("departure_time")
    return held.withColumn(
        "new_arrival", F.when(hit & first, format_time(dep - F.col("door_seconds"))).otherwise(F.col("arrival_time"))
    ).withColumn(
        "new_departure", F.when(hit & last & ~first, format_time(dep + F.col("door_seconds"))).otherwise(F.col("departure_time"))
    ).select("trip_id", "seq", "stop_id", F.col("new_arrival").alias("arrival_time"), F.col("new_departure").alias("departure_time"), "row_no")


# K8: shared platforms ---------------------------------------------------------------


def shared_stops(stops: DataFrame, order: DataFrame) -> DataFrame:
    """K8: original_stop_id, line, idx, new_stop_id: stops of two or more lines get one id per line."""
    w = Window.partitionBy("stop_id")
    held = stops.join(order, "line").withColumn("lines", F.count(F.lit(1)).over(w)).where("lines > 1")
    idx = F.row_number().over(w.orderBy("line_ord")) - 1
    return held.select(F.col("stop_id").alias("original_stop_id"), "line", idx.alias("idx")).withColumn("new_stop_id", F.concat("original_stop_id", F.col("idx").cast("string")))


def split_stop_rows(stops: DataFrame, shared: DataFrame) -> DataFrame:
    """D8j, I8: each shared stop's row once per line with its new id and code; other rows pass."""
    new = shared.select(F.col("original_stop_id").alias("stop_id"), "new_stop_id")
    held = stops.join(new, "stop_id", "left")
    code = F.regexp_replace("new_stop_id", r"^[^.]*\.", "")
    return held.withColumn("stop_code", F.coalesce(code, F.col("stop_code"))).withColumn("stop_id", F.coalesce("new_stop_id", "stop_id")).select(stops.columns)


def split_pairs(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """D8j, H9: rows with from_stop_id and to_stop_id, fanned out over the lines of a shared side.

    A row with shared stops on both sides raises an error when it is computed.
    """
    side = lambda c: shared.select(F.col("original_stop_id").alias(c), F.col("new_stop_id").alias(f"new_{c}"))
    ids = shared.select("original_stop_id").distinct()
    both = pairs.join(side("from_stop_id"), "from_stop_id", "left").join(ids.select(F.col("original_stop_id").alias("to_stop_id"), F.lit(True).alias("to_shared")), "to_stop_id", "left")
    checked = both.withColumn("new_from_stop_id", F.when(F.col("new_from_stop_id").isNotNull() & F.col("to_shared"), F.raise_error(F.lit("shared stops on both sides"))).otherwise(F.col("new_from_stop_id")))
    out = checked.join(side("to_stop_id"), "to_stop_id", "left")
    return out.withColumn("from_stop_id", F.coalesce("new_from_stop_id", "from_stop_id")).withColumn("to_stop_id", F.coalesce("new_to_stop_id", "to_stop_id")).select(pairs.columns)


def correspondences(shared: DataFrame) -> DataFrame:
    """D15j, H10s: from_stop_id, to_stop_id, line_a, line_b: the ordered pairs of one stop's new ids (few lines a stop)."""
    a = shared.select("original_stop_id", F.col("new_stop_id").alias("from_stop_id"), F.col("line").alias("line_a"), F.col("idx").alias("i"))
    b = shared.select("original_stop_id", F.col("new_stop_id").alias("to_stop_id"), F.col("line").alias("line_b"), F.col("idx").alias("j"))
    return a.join(b, "original_stop_id").where("i <> j").select("from_stop_id", "to_stop_id", "line_a", "line_b")


# Fixed value: how the signs of generated correspondences begin.
CAPTION = "Correspondència"


def split_pathways(pathways: DataFrame, shared: DataFrame, seconds: int, caption: str = CAPTION) -> DataFrame:
    """K8: pathways over the new ids, with the correspondences between a stop's lines."""
    fanned = split_pairs(pathways.withColumn("old", F.concat_ws("_", "from_stop_id", "to_stop_id")), shared)
    pair = F.concat_ws("_", "from_stop_id", "to_stop_id")
    renamed = fanned.withColumn("pathway_id", F.when(pair != F.col("old"), F.concat(F.lit("PW."), pair)).otherwise(F.col("pathway_id"))).drop("old")
    extra = correspondences(shared).select(
        F.concat(F.lit("PW."), pair).alias("pathway_id"),
        "from_stop_id",
        "to_stop_id",
        F.lit(2).alias("pathway_mode"),
        F.lit(0).alias("is_bidirectional"),
        F.lit(seconds).alias("traversal_time"),
        F.concat(F.lit(f"{caption} "), "line_a", F.lit(" - "), "line_b").alias("signposted_as"),
    )
    return renamed.unionByName(extra, allowMissingColumns=True)


def split_transfers(transfers: DataFrame, shared: DataFrame, seconds: int) -> DataFrame:
    """K8: transfers over the new ids, with the correspondences."""
    extra = correspondences(shared).select("from_stop_id", "to_stop_id", F.lit(2).alias("transfer_type"), F.lit(seconds).alias("min_transfer_time"))
    return split_pairs(transfers, shared).unionByName(extra, allowMissingColumns=True)


def split_events(events: DataFrame, trips: DataFrame, shared: DataFrame) -> DataFrame:
    """K8, D7j: stop_times over the new ids of the trip's line."""
    new = shared.select(F.col("original_stop_id").alias("stop_id"), "line", "new_stop_id")
    held = events.join(trips.select("trip_id", "line"), "trip_id", "left").join(new, ["stop_id", "line"], "left")
    return held.withColumn("stop_id", F.coalesce("new_stop_id", "stop_id")).select(events.columns)


def least_transfer(transfers: DataFrame) -> DataFrame:
    """min_transfer_time, the smallest one."""
    return transfers.agg(F.min("min_transfer_time").alias("min_transfer_time"))


# K9: weights ------------------------------------------------------------------------


def edge_weights(events: DataFrame, groups: DataFrame, stops: DataFrame, order: DataFrame) -> DataFrame:
    """from_stop_id, to_stop_id, weight_seconds, line: exact half-up mean over all lines of a pair."""
    samples = transitions(events, groups, stops).where("total is not null")
    per_line = samples.groupBy("a", "b", "line").agg(F.sum("total").alias("s"), F.count("total").alias("n"))
    named = per_line.join(order, "line")
    return named.groupBy("a", "b").agg(
        F.call_function("div", F.sum("s") * 2 + F.sum("n"), F.sum("n") * 2).cast("int").alias("weight_seconds"),
        F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("line_ord", "line"))), lambda x: x["line"]), "/").alias("line"),
    ).select(F.col("a").alias("from_stop_id"), F.col("b").alias("to_stop_id"), "weight_seconds", "line")


def entrance_edges(pathways: DataFrame) -> DataFrame:
    """from_stop_id, to_stop_id, weight_seconds of the pathways between an entrance and a platform."""
    a, b = F.trim("from_stop_id"), F.trim("to_stop_id")
    between = (a.startswith("E.") & b.startswith("1.")) | (a.startswith("1.") & b.startswith("E."))
    return pathways.where(between & F.col("traversal_time").isNotNull()).select(a.alias("from_stop_id"), b.alias("to_stop_id"), F.col("traversal_time").cast("int").alias("weight_seconds"))


def combined_weights(subway: DataFrame, transfers: DataFrame, entrances: DataFrame) -> DataFrame:
    """H1s: the three kinds of edges in one table, tagged SW, TF and PW."""
    part = lambda df, t: df.select("from_stop_id", "to_stop_id", "weight_seconds", F.lit(t).alias("type"))
    tf = transfers.select("from_stop_id", "to_stop_id", F.col("min_transfer_time").alias("weight_seconds"))
    return part(subway, "SW").unionByName(part(tf, "TF")).unionByName(part(entrances, "PW"))


def canonical_order(edges: DataFrame, rank: DataFrame) -> list[Column]:
    """Sort keys of an edge table joined with ranks as rank_a and rank_b: ranked stops first, then by id."""
    return [F.col("rank_a").asc_nulls_last(), F.col("from_stop_id").asc(), F.col("rank_b").asc_nulls_last(), F.col("to_stop_id").asc()]


def with_ranks(edges: DataFrame, rank: DataFrame) -> DataFrame:
    """Adds rank_a and rank_b of the stops' first mention (stop_id, rank: a number or a sort key)."""
    return edges.join(rank.select(F.col("stop_id").alias("from_stop_id"), F.col("rank").alias("rank_a")), "from_stop_id", "left").join(
        rank.select(F.col("stop_id").alias("to_stop_id"), F.col("rank").alias("rank_b")), "to_stop_id", "left"
    )


