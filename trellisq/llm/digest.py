"""Problem 2: percentiles per group by merging centroid digests, with a certified rank error.

Method: the sorted values of a group are clustered under a size function of the quantile
(k(q) = delta / 2pi * asin(2q - 1), at most one unit of k per cluster), so clusters are
small at the ends and a group of few values keeps each value.  Digests of separate
partitions or days are merged by clustering their centroids again.  A second pass counts
the values below and up to each estimate; how far the wanted quantile lies outside that
interval is the certified rank error, reported with every row.

Groups are met sorted within hash partitions and handled in arrays, many at a time; a group
that holds more than ``split_rows`` rows is cut by row number into several digests first,
so that no group, however large, is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisq.functions.exprs import near_diff, parse_time
from trellisq.operators.groups import whole_groups
from trellisq.operators.references import bare
from trellisq.operators.skew import spread_join
from trellisq.session import written

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
DELTA = 400.0
METRICS = ("dwell", "time_of_day")
#: Rows that are handled in arrays at a time (a group is never cut by it).
BATCH = 200_000


@dataclass
class Digests:
    """Centroids of consecutive groups: group number (ascending), mean, weight, least and greatest value."""

    group: np.ndarray
    mean: np.ndarray
    weight: np.ndarray
    low: np.ndarray
    high: np.ndarray


def cluster(group: np.ndarray, mean: np.ndarray, weight: np.ndarray, low: np.ndarray, high: np.ndarray, delta: float = DELTA) -> Digests:
    """Cluster values or centroids of many groups; equal values stay together."""
    if not len(group):
        return Digests(group, mean, weight, low, high)
    order = np.lexsort((mean, group))
    group, mean, weight, low, high = (x[order] for x in (group, mean, weight, low, high))
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    end = np.cumsum(weight)
    before = np.repeat(end[first] - weight[first], size)
    total = np.repeat(np.add.reduceat(weight, first), size)
    # values that are equal share the middle of their common weight
    same = np.concatenate([[True], (group[1:] != group[:-1]) | (mean[1:] != mean[:-1])])
    at = np.flatnonzero(same)
    tie = np.cumsum(same) - 1
    tie_weight = np.add.reduceat(weight, at)
    middle = (end[at] - weight[at])[tie] - before + tie_weight[tie] / 2
    unit = np.floor(delta / (2 * np.pi) * np.arcsin(np.clip(2 * middle / total - 1, -1, 1)))
    cut = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (unit[1:] != unit[:-1])]))
    w = np.add.reduceat(weight, cut)
    return Digests(group[cut], np.add.reduceat(mean * weight, cut) / w, w, np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut))


def quantiles(d: Digests, groups: int, qs: tuple[float, ...] = QUANTILES) -> tuple[np.ndarray, np.ndarray]:
    """(estimates [groups, qs], weights of the groups): the value at rank q*n, within its cluster in proportion."""
    n = np.bincount(d.group, d.weight, groups)
    end = np.cumsum(d.weight)
    base = np.cumsum(n) - n
    # a cluster of more than two values reaches half way to its neighbours, and not beyond its own values
    near = d.group[1:] == d.group[:-1]
    half = (d.mean[1:] + d.mean[:-1]) / 2
    low, high = d.low.copy(), d.high.copy()
    low[1:] = np.where(near & (d.weight[1:] > 2), np.maximum(low[1:], np.minimum(half, d.high[1:])), low[1:])
    high[:-1] = np.where(near & (d.weight[:-1] > 2), np.minimum(high[:-1], np.maximum(half, d.low[:-1])), high[:-1])
    out = np.full((groups, len(qs)), np.nan)
    some = n > 0
    for k, q in enumerate(qs):
        rank = np.maximum(np.ceil(q * n[some] - 1e-9), 1)
        i = np.searchsorted(end, base[some] + rank - 0.5)
        left = end[i] - d.weight[i]
        share = np.where(d.weight[i] > 1, (base[some] + rank - left - 1) / np.maximum(d.weight[i] - 1, 1), 0.0)
        out[some, k] = low[i] + share * (high[i] - low[i])
    return out, n


def count_below(group: np.ndarray, value: np.ndarray, groups: int, x: np.ndarray, side: str) -> np.ndarray:
    """Values of each group below x (left) or up to x (right); values sorted within ascending groups."""
    start = np.searchsorted(group, np.arange(groups))
    lo, hi = start.copy(), np.searchsorted(group, np.arange(groups), "right")
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) // 2
        up = value[mid] < x[open_] if side == "left" else value[mid] <= x[open_]
        lo[open_[up]] = mid[up] + 1
        hi[open_[~up]] = mid[~up]
        open_ = open_[lo[open_] < hi[open_]]
    return lo - start


def rank_error(q: float, below: np.ndarray, upto: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How far q*n lies outside the ranks below+1 .. upto that an estimate covers, as a share of n."""
    rank = np.maximum(np.ceil(q * n - 1e-9), 1)
    return np.maximum(np.maximum(below + 1 - rank, rank - np.maximum(upto, below)), 0) / np.maximum(n, 1)


_ESTIMATES = [f"q{j}" for j in range(len(QUANTILES))]
_FIELDS = [("n", pa.int64()), *((c, pa.float64()) for c in (*_ESTIMATES, "error")), *((c, pa.list_(pa.float64())) for c in ("mean", "weight", "low", "high"))]
_SQL = {"n": "long", **dict.fromkeys((*_ESTIMATES, "error"), "double")}


def _columns(d: Digests, groups: int, error: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> list[pa.Array]:
    """n, the estimates, error, mean, weight, low, high of one metric; null lists for groups without values."""
    est, n = quantiles(d, groups)
    none = pa.array(n == 0)
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(d.group, minlength=groups))]).astype(np.int32))
    err = pa.array(error(est, n)) if error else pa.nulls(groups, pa.float64())
    return [pa.array(n.astype(np.int64)), *map(pa.array, est.T), err, pa.ListArray.from_arrays(offsets, pa.array(d.mean), mask=none), *_spare(d, groups)]


def _spare(d: Digests, groups: int) -> list[pa.Array]:
    """weight, low and high as lists, null for the groups whose clusters hold one value each."""
    plain = np.ones(groups, bool)
    plain[d.group[d.weight > 1]] = False
    sizes = np.bincount(d.group, minlength=groups)
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.where(plain, 0, sizes))]).astype(np.int32))
    kept = ~plain[d.group]
    return [pa.ListArray.from_arrays(offsets, pa.array(x[kept].astype(np.float64)), mask=pa.array(plain)) for x in (d.weight, d.low, d.high)]


def _filled(c: pa.ListArray, sizes: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The values of the lists one after the other, those of ``rest`` where a list is null."""
    own = np.repeat(c.is_valid().to_numpy(zero_copy_only=False), sizes)
    out = rest.astype(np.float64)
    out[own] = c.flatten().to_numpy()
    return out


def _schema(df: DataFrame, keys: list[str], metrics: list[str]) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_type

    types = [(k, df.schema[k].dataType) for k in keys]
    ddl = [f"`{k}` {t.simpleString()}" for k, t in types] + [f"{m}_{f} {_SQL.get(f, 'array<double>')}" for m in metrics for f, _ in _FIELDS]
    return ", ".join(ddl), pa.schema([*((k, to_arrow_type(t)) for k, t in types), *((f"{m}_{f}", t) for m in metrics for f, t in _FIELDS)])


def build(df: DataFrame, keys: list[str], metrics: list[str], delta: float = DELTA) -> DataFrame:
    """<keys> and, per metric, n, the estimates q0 .. q4, error, mean, weight, low, high (prefixed by its name): one row per group.

    Rows are hash-partitioned by the keys and met in their order; nulls are no values
    (n = 0 without any); the error is counted on the group's own values.  weight, low and
    high are null where every cluster holds one value.
    """
    ddl, schema = _schema(df, keys, metrics)

    def digest(c: pa.Array, g: np.ndarray, groups: int) -> list[pa.Array]:
        ok = c.is_valid().to_numpy(zero_copy_only=False)
        value, group = c.drop_null().to_numpy().astype(np.float64), g[ok]
        order = np.lexsort((value, group))
        value, group = value[order], group[order]

        def error(est: np.ndarray, n: np.ndarray) -> np.ndarray:
            each = [rank_error(q, count_below(group, value, groups, est[:, j], "left"), count_below(group, value, groups, est[:, j], "right"), n) for j, q in enumerate(QUANTILES)]
            return np.max(each, axis=0)

        # equal values go in as one
        new = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])])) if len(value) else np.empty(0, np.int64)
        weight = np.diff(np.append(new, len(value))).astype(np.float64)
        return _columns(cluster(group[new], value[new], weight, value[new], value[new], delta), groups, error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, g in whole_groups(batches, len(keys), BATCH):
            groups = int(g[-1]) + 1
            firsts = pa.array(np.searchsorted(g, np.arange(groups)))
            columns = [c.combine_chunks().take(firsts) for c in t.columns[: len(keys)]]
            for k in range(len(metrics)):
                columns += digest(t.column(len(keys) + k).combine_chunks(), g, groups)
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema)], schema=schema)

    return df.select(*keys, *metrics).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl)


def merge(digests: DataFrame, keys: list[str], metrics: list[str], delta: float = DELTA) -> DataFrame:
    """Digests of the same shape per <keys>, merged by clustering the centroids again; the errors are null.

    What meets in one task is a group's digests, at most delta/2 + 1 centroids each.
    """
    ddl, schema = _schema(digests, keys, metrics)
    lists = ("mean", "weight", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, g in whole_groups(batches, len(keys), BATCH):
            groups = int(g[-1]) + 1
            firsts = pa.array(np.searchsorted(g, np.arange(groups)))
            columns = [c.combine_chunks().take(firsts) for c in t.columns[: len(keys)]]
            for k in range(len(metrics)):
                first = len(keys) + k * len(lists)
                means, *rest = (c.combine_chunks() for c in t.columns[first : first + len(lists)])
                sizes = pc.fill_null(pc.list_value_length(means), 0).to_numpy()
                mean = means.flatten().to_numpy().astype(np.float64)
                weight, low, high = (_filled(c, sizes, x) for c, x in zip(rest, (np.ones(len(mean)), mean, mean)))
                columns += _columns(cluster(np.repeat(g, sizes), mean, weight, low, high, delta), groups, None)
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, schema)], schema=schema)

    return digests.select(*keys, *(f"{m}_{c}" for m in metrics for c in lists)).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, ddl)


def certify(values: DataFrame, digests: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """The digests (a written table) with their rank errors, counted in a second pass over the values.

    Estimates of few groups are small enough for Spark to send them to the values; else
    groups that very many rows have, by the digests' own counts, are joined in parts.
    The counts are combined in each task.
    """
    qs = range(len(QUANTILES))
    wide = digests.select(*keys, *(f"{m}_{c}" for m in metrics for c in _ESTIMATES), F.greatest(*(f"{m}_n" for m in metrics)).alias("_n"))
    held = spread_join(values.select(*keys, *metrics, "row_no"), wide, keys, "_n", F.col("row_no"))
    counts = held.groupBy(*keys).agg(
        *(F.count_if(F.col(m) < F.col(f"{m}_q{j}")).alias(f"below_{m}_{j}") for m in metrics for j in qs),
        *(F.count_if(F.col(m) <= F.col(f"{m}_q{j}")).alias(f"upto_{m}_{j}") for m in metrics for j in qs),
    )

    def off(m: str, j: int, q: float) -> Column:
        n, below, upto = F.col(f"{m}_n"), F.col(f"below_{m}_{j}"), F.col(f"upto_{m}_{j}")
        rank = F.greatest(F.ceil(n * q - 1e-9), F.lit(1))
        return F.try_divide(F.greatest(below + 1 - rank, rank - F.greatest(upto, below), F.lit(0)), n)

    errors = {f"{m}_error": F.greatest(*(off(m, j, q) for j, q in enumerate(QUANTILES))) for m in metrics}
    return digests.join(counts, keys).select(*(errors[c].alias(c) if c in errors else F.col(c) for c in digests.columns))


def stop_values(stop_times: DataFrame) -> DataFrame:
    """stop_id, service_date, row_no, dwell, time_of_day: seconds of each row; rows without a stop are left out."""
    arrival, departure = parse_time("arrival_time"), parse_time("departure_time")
    return stop_times.select(
        bare("stop_id").alias("stop_id"),
        "service_date",
        F.col("row_no").cast("long").alias("row_no"),
        near_diff(arrival, departure).cast("int").alias("dwell"),
        F.pmod(arrival, F.lit(86400)).cast("int").alias("time_of_day"),
    ).where("stop_id is not null")


def _result(d: DataFrame, day: Column) -> DataFrame:
    one = lambda m: F.struct(F.lit(m).alias("metric"), *(F.col(f"{m}_{c}").alias(c) for c in ("n", *_ESTIMATES, "error")))
    rows = d.select("stop_id", day.alias("service_date"), F.explode(F.array(*map(one, METRICS))).alias("x")).where("x.n > 0")
    return rows.select("stop_id", "service_date", "x.metric", "x.n", *(F.col(f"x.q{k}").alias(f"p{int(q * 100)}") for k, q in enumerate(QUANTILES)), F.col("x.error").alias("rank_error"))


#: Stands for no day within a key: the least number of days, which is no date.
NO_DAY = -(1 << 31)


def daily_digests(values: DataFrame, split_rows: int = 1_000_000) -> DataFrame:
    """One row of digests per stop and day; groups above ``split_rows`` rows are cut, merged and certified by a second pass.

    Rows without a day are a group of their own with a null service_date.
    """
    keys, metrics = ["stop_id", "day"], list(METRICS)
    dated = values.withColumn("day", F.coalesce(F.unix_date("service_date"), F.lit(NO_DAY))).drop("service_date")
    named = lambda d: d.withColumn("service_date", F.when(F.col("day") != NO_DAY, F.date_from_unix_date("day"))).drop("day")
    # a day can only be large where its stop is: days are counted for the large stops alone
    count = lambda df, by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > split_rows)
    stops = written(count(dated, ["stop_id"]).select("stop_id"))
    if stops.isEmpty():
        return written(named(build(dated, keys, metrics)))
    days = count(dated.join(stops, "stop_id", "left_semi"), keys)
    large = written(days.withColumn("parts", F.ceil(F.col("rows") / split_rows)).drop("rows"))
    if large.isEmpty():
        return written(named(build(dated, keys, metrics)))
    whole = build(dated.join(large, keys, "left_anti"), keys, metrics)
    cut = dated.join(large, keys).withColumn("part", F.pmod("row_no", "parts"))
    merged = written(merge(build(cut, [*keys, "part"], metrics), keys, metrics))
    return written(named(whole.unionByName(certify(cut, merged, keys, metrics).select(whole.columns))))


def stop_percentiles(stop_times: DataFrame) -> DataFrame:
    """stop_id, service_date (null: all days), metric, n, p10 .. p90, rank_error.

    Dwell and time of day in seconds, per stop and day and per stop over all days, the
    latter merged from the days' digests.  A percentile is the value at rank ceil(q*n).
    Rows without a service_date count over all days only: they are in digests of their
    own, which are merged but not listed as a day.  Null times are no values, a group
    without values gives no row; repeated rows count each; an empty table gives no rows.
    """
    values, metrics = stop_values(stop_times), list(METRICS)
    days = daily_digests(values)
    # the centroids are not needed any more once they are merged
    merged = written(merge(days, ["stop_id"], metrics).select("stop_id", *(f"{m}_{c}" for m in metrics for c in ("n", *_ESTIMATES, "error"))))
    whole = certify(values, merged, ["stop_id"], metrics)
    return _result(days.where("service_date is not null"), F.col("service_date")).unionByName(_result(whole, F.lit(None).cast("date")))
