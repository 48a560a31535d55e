"""Problem 3: implausible spikes, stuck values and impossible readings, per source.

Method: robust seasonal-trend decomposition of each source's readings, residuals held
against the limits of the generalised extreme studentised deviate test, and separate
range and constant-run checks.

* *Decomposition.*  The level is the source's median.  The trend (by month, smoothed over
  its neighbours) and the season (by quarter of the day) are medians of what the other one
  leaves, in turn; a second outer round takes them again with bisquare weights of the
  residuals, so that spikes have no say.
* *Test.*  The reading farthest from the median of those that are left is taken away, again
  and again, up to a fifth of the readings; each time its distance, in robust deviations
  (10-90 % span) of those left, is held against the limit of that step.  All readings up
  to the last step beyond its limit are outliers.  Readings with the same residual (in
  whole seconds, the data's grain) are taken away together.
* *Use.*  :func:`anomalies` reports the outliers of the unbounded decomposition with
  residual, limit and step.  :func:`spikes` applies the exact rule of the data's owners
  (distance from the source's median against the 10-90 % span and a floor) to the outliers
  of a decomposition whose trend and season may move by SWAY spans at most, so that what is
  far from the level of its source cannot be explained away by a month or a time of day.

Everything per source is computed from counted cells (source, value, month, position, n),
never from gathered readings: dwell and run lie within a day, and a pathway has one reading
an edition, so the cells of a source are bounded, whatever share of the rows it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisq.functions.exprs import int_div, near_diff, parse_time
from trellisq.operators.groups import whole_groups
from trellisq.operators.references import bare
from trellisq.operators.skew import ROWS_PER_TASK, hot_keys, screened, spread_join
from trellisq.session import written

SWAY = 0.1
NORMAL_SPAN = 2.5631031310892007  # 10-90 % span of the unit normal distribution
ALPHA = 0.05
MAX_SHARE = 0.2
LEAST = 12
#: Cells that are handled in arrays at a time (a source is never cut by it).
BATCH = 1_000_000
#: First letters of a source: its kind of reading.
KINDS = {"d": "dwell", "r": "run", "t": "traversal_time"}


def normal_upper(p: np.ndarray) -> np.ndarray:
    """Upper quantile of the unit normal for tail probability p <= 0.5 (error under 4.5e-4)."""
    t = np.sqrt(-2 * np.log(p))
    return t - (t * (t * 0.010328 + 0.802853) + 2.515517) / (t * (t * (t * 0.001308 + 0.189269) + 1.432788) + 1)


def esd_limit(n: np.ndarray, i: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """Critical value of the i-th step of the generalised ESD test on n readings.

    Student's quantile is expanded around the normal one (Cornish-Fisher, two terms).
    """
    left = np.maximum(np.asarray(n, np.float64) - i + 1, 4.0)
    z, v = normal_upper(alpha / 2 / left), left - 2
    t = z + (z**3 + z) / (v * 4) + (5 * z**5 + 16 * z**3 + 3 * z) / (v * v * 96)
    return t * (left - 1) / np.sqrt((left - 2 + t * t) * left)


@dataclass
class Cells:
    """Counted readings of consecutive sources: source number (ascending), value, month, position, count."""

    source: np.ndarray
    value: np.ndarray
    month: np.ndarray
    position: np.ndarray
    n: np.ndarray

    def where(self, keep: np.ndarray) -> Cells:
        """The cells of a mask."""
        return Cells(self.source[keep], self.value[keep], self.month[keep], self.position[keep], self.n[keep])


class Ranks:
    """Order statistics of counted values within groups: values sorted within ascending groups."""

    def __init__(self, group: np.ndarray, value: np.ndarray, n: np.ndarray, groups: int) -> None:
        order = np.lexsort((value, group))
        self.value = value[order]
        self.end = np.cumsum(n[order])
        self.total = np.bincount(group, n, groups).astype(np.int64)
        self.base = np.cumsum(self.total) - self.total

    def quantile(self, q: float, which: np.ndarray) -> np.ndarray:
        """The q-quantile, interpolated between ranks, of the groups ``which`` (not empty)."""
        return quantile_between(self.value, self.end, self.base[which], self.total[which], q)


def quantile_between(value: np.ndarray, end: np.ndarray, base: np.ndarray, total: np.ndarray, q: float) -> np.ndarray:
    """The q-quantile of the ``total`` counted values after the first ``base`` ones."""
    at = (total - 1) * q
    low = np.floor(at).astype(np.int64)
    a = value[np.searchsorted(end, base + low, "right")]
    b = value[np.searchsorted(end, base + np.minimum(low + 1, total - 1), "right")]
    return a + (b - a) * (at - low)


def weighted_median(group: np.ndarray, value: np.ndarray, weight: np.ndarray, groups: int) -> np.ndarray:
    """The weighted median of each group, 0 for groups without weight."""
    order = np.lexsort((value, group))
    run = np.cumsum(weight[order])
    total = np.bincount(group, weight, groups)
    base = np.cumsum(total) - total
    at = np.minimum(np.searchsorted(run, base + total / 2), len(run) - 1)
    return np.where(total > 0, value[order][at], 0.0)


def decompose(cells: Cells, level: np.ndarray, span: np.ndarray, sway: float | None = None, least: int = LEAST, outer: int = 2, inner: int = 2) -> np.ndarray:
    """The residual of each cell: its value less level, trend and season of its source.

    Months and positions with fewer than ``least`` readings have no part of their own;
    with ``sway`` trend and season move by so many spans at most, each.
    """
    g, n = cells.source, cells.n.astype(np.float64)
    y = cells.value - level[g]
    seasons, s_of = np.unique(g * 8 + cells.position, return_inverse=True)
    months, t_of = np.unique(g * 4096 + cells.month, return_inverse=True)
    s_source, t_source = seasons // 8, months // 4096
    enough_s = np.bincount(s_of, n) >= least
    t_count = np.bincount(t_of, n)
    enough_t = t_count >= least
    near = (t_source[1:] == t_source[:-1]) & (months[1:] == months[:-1] + 1)
    trend, season, weight = np.zeros(len(months)), np.zeros(len(seasons)), n
    for _ in range(outer):
        for _ in range(inner):
            raw = np.where(enough_t, weighted_median(t_of, y - season[s_of], weight, len(months)), 0.0)
            held = np.where(enough_t, t_count, 0.0)
            up, mass = 2 * held * raw, 2 * held
            up[1:] += np.where(near, held[:-1] * raw[:-1], 0)
            mass[1:] += np.where(near, held[:-1], 0)
            up[:-1] += np.where(near, held[1:] * raw[1:], 0)
            mass[:-1] += np.where(near, held[1:], 0)
            trend = np.where(enough_t, up / np.maximum(mass, 1), 0.0)
            season = np.where(enough_s, weighted_median(s_of, y - trend[t_of], weight, len(seasons)), 0.0)
            if sway is not None:
                trend = np.clip(trend, -sway * span[t_source], sway * span[t_source])
                season = np.clip(season, -sway * span[s_source], sway * span[s_source])
        residual = y - trend[t_of] - season[s_of]
        spread = weighted_median(g, np.abs(residual), n, len(level))[g] * 6
        inside = np.clip(1 - (residual / np.where(spread > 0, spread, np.inf)) ** 2, 0, None) ** 2
        weight = n * inside
    return residual


def esd_steps(source: np.ndarray, residual: np.ndarray, n: np.ndarray, span: np.ndarray, max_share: float = MAX_SHARE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(outlier, step, bound) of each cell: the sequential test on all sources at once.

    ``bound`` is the limit of its step in the unit of the values; step and bound are 0
    where the cell was never the farthest one.
    """
    grain = np.round(residual)
    order = np.lexsort((grain, source))
    new = np.concatenate([[True], (source[order][1:] != source[order][:-1]) | (grain[order][1:] != grain[order][:-1])])
    at = np.flatnonzero(new)
    block = np.empty(len(order), np.int64)
    block[order] = np.cumsum(new) - 1
    value, count = grain[order][at], np.add.reduceat(n[order], at)
    owner = source[order][at]
    end = np.cumsum(count)
    before = end - count
    low = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    high = np.append(low[1:], len(owner)) - 1
    who = owner[low]
    total = end[high] - before[low]
    most = np.floor(total * max_share).astype(np.int64) + 1
    widest = span[who] / NORMAL_SPAN
    step, bound = np.zeros(len(value), np.int64), np.zeros(len(value))
    taken = np.zeros(len(low), np.int64)
    decided = np.zeros(len(low), np.int64)
    live = np.arange(len(low))
    while len(live):
        lo, hi = low[live], high[live]
        base, left = before[lo], end[hi] - before[lo]
        mid = quantile_between(value, end, base, left, 0.5)
        wide = quantile_between(value, end, base, left, 0.9) - quantile_between(value, end, base, left, 0.1)
        scale = np.minimum(wide / NORMAL_SPAN, widest[live])
        upper = value[hi] - mid >= mid - value[lo]
        far = np.where(upper, value[hi] - mid, mid - value[lo])
        gone = np.where(upper, hi, lo)
        i = taken[live] + 1
        edge = esd_limit(total[live], i) * scale
        beyond = (far > edge) & (far > 0)
        step[gone], bound[gone] = i, edge
        decided[live[beyond]] = i[beyond]
        taken[live] += count[gone]
        high[live[upper]] -= 1
        low[live[~upper]] += 1
        live = live[(taken[live] < most[live]) & (low[live] <= high[live]) & (far > 0)]
    flagged = (step > 0) & (step <= decided[np.searchsorted(who, owner)])
    return flagged[block], step[block], bound[block]


def outliers(cells: Cells, sway: float | None, least: int = LEAST) -> dict[str, np.ndarray]:
    """The outlying cells of the sources with ``least`` readings: index of the cell, level, span, total, uses (of its value), residual, step, bound."""
    groups = int(cells.source[-1]) + 1 if len(cells.source) else 0
    enough = np.bincount(cells.source, cells.n, groups) >= least
    index = np.flatnonzero(enough[cells.source])
    held = cells.where(index)
    if not len(index):
        return {k: np.empty(0) for k in ("index", "level", "span", "total", "uses", "residual", "step", "bound")}
    ranks = Ranks(held.source, held.value.astype(np.float64), held.n, groups)
    which = np.flatnonzero(enough)
    level, span = np.zeros(groups), np.zeros(groups)
    level[which] = ranks.quantile(0.5, which)
    span[which] = ranks.quantile(0.9, which) - ranks.quantile(0.1, which)
    residual = decompose(held, level, span, sway, least)
    flagged, step, bound = esd_steps(held.source, residual, held.n, span)
    k = np.flatnonzero(flagged)
    g = held.source[k]
    # how many readings of the source have the value, in any cell
    at = np.lexsort((held.value, held.source))
    new = np.concatenate([[True], (held.source[at][1:] != held.source[at][:-1]) | (held.value[at][1:] != held.value[at][:-1])])
    kind = np.empty(len(at), np.int64)
    kind[at] = np.cumsum(new) - 1
    uses = np.bincount(kind, held.n)[kind[k]]
    return {"index": index[k], "level": level[g], "span": span[g], "total": ranks.total[g], "uses": uses, "residual": residual[k], "step": step[k], "bound": bound[k]}


#: Stands for no time where two are packed; no text gives it.
_NO_TIME = -(1 << 31)
#: A code holds row_no (below 2^48), the month (12 bits) and the position in the cycle (3 bits).
CELLS = 1 << 15


def month_index(c: str) -> Column:
    """Months since the year 0, within 12 bits; 0 for null."""
    return F.coalesce(F.pmod(F.year(c) * 12 + F.month(c), F.lit(4095)) + 1, F.lit(0))


def pack(row_no: Column, period: Column, position: Column) -> Column:
    """One LONG of a reading's row, period and position (null: no position)."""
    return row_no.cast("long") * CELLS + period.cast("long") * 8 + F.coalesce(position.cast("long") + 1, F.lit(0))


def _without_repeats(rows: DataFrame) -> DataFrame:
    """trip, home, seq, stop, row, times: of the blocks with very many rows one row per trip, sequence and stop."""
    blocks = ["trip", "home"]
    hot = hot_keys(written(rows.groupBy(*blocks).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROWS_PER_TASK)), blocks, "n")
    if hot is None:
        return rows
    large = rows.join(F.broadcast(hot), blocks, "left_semi").groupBy(*blocks, "seq", "stop").agg(F.min("row").alias("first"), F.min_by("times", "row").alias("times"))
    return rows.join(F.broadcast(hot), blocks, "left_anti").unionByName(large.withColumnRenamed("first", "row"))


def stop_time_readings(stop_times: DataFrame, block: int = 4096) -> DataFrame:
    """source, value, code: dwell and run readings, and the hard cases (source ``h``).

    ``code`` packs row_no, month and quarter of the day (see :func:`pack`).

    Rows with a null or blank trip or stop or a null sequence are left out, then the
    lowest row_no of each (trip, sequence) is kept.  Trips are cut into blocks of sequence
    numbers with a halo of three on each side, so that no trip, however long, lies in one
    window as a whole; a block that still has very many rows has repeated ones, which a
    combining aggregate takes away before the shuffle.
    """
    # what crosses the shuffles is packed: the row with its month, and both times
    time = lambda c: F.coalesce(parse_time(c), F.lit(_NO_TIME)).cast("long")
    rows = stop_times.select(
        bare("trip_id").alias("trip"),
        F.col("stop_sequence").cast("int").alias("seq"),
        bare("stop_id").alias("stop"),
        (F.col("row_no").cast("long") * 4096 + month_index("service_date")).alias("row"),
        (time("arrival_time") * (1 << 32) + F.pmod(time("departure_time"), F.lit(1 << 32))).alias("times"),
    ).where("trip is not null and stop is not null and seq is not null")
    at = F.pmod("seq", F.lit(block))
    home = int_div(F.col("seq") - at, block).cast("int")
    kept = _without_repeats(rows.withColumn("home", home)).drop("home")
    blocks = F.when(at < 3, F.array(home, home - 1)).when(at >= block - 3, F.array(home, home + 1)).otherwise(F.array(home))
    # sequence numbers start at 0 or 1: a halo before block 0 would serve no row
    blocks = F.when((home == 0) & (at < 3), F.array(home)).otherwise(blocks)
    spread = kept.withColumn("block", F.explode(blocks))
    again = F.lag("seq").over(Window.partitionBy("trip", "block").orderBy("seq", "row")) == F.col("seq")
    arr, low = F.shiftright("times", 32), F.pmod("times", F.lit(1 << 32))
    dep = F.when(low < 1 << 31, low).otherwise(low - (1 << 32))
    spread = spread.withColumn("again", again).where(~F.coalesce("again", F.lit(False)))
    spread = spread.select(
        "trip",
        "seq",
        "stop",
        "block",
        home.alias("home"),
        F.shiftright("row", 12).alias("row_no"),
        F.pmod("row", F.lit(4096)).alias("period"),
        F.nullif(arr.cast("int"), F.lit(_NO_TIME)).alias("arr"),
        F.nullif(dep.cast("int"), F.lit(_NO_TIME)).alias("dep"),
    )
    w = Window.partitionBy("trip", "block").orderBy("seq")
    lag = lambda c, k=1: F.lag(c, k).over(w)
    lead = lambda c, k=1: F.lead(c, k).over(w)
    linked = (
        spread.withColumn("joined", lag("seq") == F.col("seq") - 1)
        .withColumn("stop0", lag("stop"))
        .withColumn("dep0", lag("dep"))
        .withColumn("stuck", F.coalesce(F.col("joined") & (F.col("arr") == F.col("dep")) & (lag("arr") == F.col("arr")) & (lag("dep") == F.col("dep")), F.lit(False)))
    )
    s = lambda k: F.col("stuck") if k == 0 else F.coalesce(lag("stuck", -k) if k < 0 else lead("stuck", k), F.lit(False))
    runs = [s(k) & s(k + 1) & s(k + 2) for k in (-2, -1, 0, 1)]
    flagged = linked.withColumn("stopped", reduce(lambda a, b: a | b, runs)).where("block = home")
    dwell = near_diff(F.col("arr"), F.col("dep"))
    run = F.when(F.col("joined"), near_diff(F.col("dep0"), F.col("arr")))
    hard = F.coalesce(dwell < 0, F.lit(False)) | F.coalesce(run <= 0, F.lit(False)) | F.col("stopped")
    item = lambda source, value: F.struct(source.alias("source"), value.cast("int").alias("value"))
    return (
        flagged.select(
            pack(F.col("row_no"), F.col("period"), int_div(F.pmod(F.col("arr"), F.lit(86400)), 21600)).alias("code"),
            F.explode(
                F.array(
                    item(F.concat(F.lit("d"), "stop"), dwell),
                    item(F.concat(F.lit("r"), F.length("stop0").cast("string"), F.lit(":"), "stop0", "stop"), run),
                    item(F.lit("h"), F.when(hard, F.lit(0))),
                )
            ).alias("x"),
        )
        .where("x.value is not null")
        .select("x.*", "code")
    )


def pathway_readings(pathways: DataFrame) -> DataFrame:
    """The same columns for traversal times (hard cases: source ``p``); rows without a pathway id are left out."""
    kept = (
        pathways.select(
            bare("pathway_id").alias("id"),
            "published_on",
            F.col("row_no").cast("long").alias("row_no"),
            F.col("traversal_time").cast("int").alias("value"),
        )
        .where("id is not null")
        .groupBy("id", "published_on")
        .agg(F.min("row_no").alias("first"), F.min_by("value", "row_no").alias("value"))
    )
    value = F.col("value")
    return (
        kept.select(
            pack(F.col("first"), month_index("published_on"), F.lit(None)).alias("code"),
            F.explode(
                F.array(
                    F.struct(F.concat(F.lit("t"), "id").alias("source"), value.alias("value")),
                    F.struct(F.lit("p").alias("source"), F.when(value <= 0, F.lit(0)).alias("value")),
                )
            ).alias("x"),
        )
        .where("x.value is not null")
        .select("x.*", "code")
    )


_OUT = pa.schema(
    [
        ("source", pa.string()),
        ("value", pa.int32()),
        ("cell", pa.int64()),
        ("n", pa.int64()),
        ("level", pa.float64()),
        ("span", pa.float64()),
        ("total", pa.int64()),
        ("uses", pa.int64()),
        ("residual", pa.float64()),
        ("step", pa.int64()),
        ("bound", pa.float64()),
    ]
)
_SOFT = "source not in ('h', 'p')"


def outlying_cells(readings: DataFrame, sway: float | None, least: int = LEAST) -> DataFrame:
    """source, value, cell (month and position), n, level, span, total, uses, residual, step, bound of the outlying cells.

    Cells meet by source and are handled in arrays, many sources at a time.  Sources with
    very many readings are counted by cell before, which leaves few rows of them; the
    others go as they are.
    """
    soft = readings.where(_SOFT).select("source", "value", F.pmod("code", F.lit(CELLS)).alias("cell"))
    hot = hot_keys(written(soft.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROWS_PER_TASK)), ["source"], "n")
    one = F.lit(1).cast("long").alias("n")
    if hot is None:
        counts = soft.select("*", one)
    else:
        large = soft.join(F.broadcast(hot), "source", "left_semi").groupBy("source", "value", "cell").agg(F.count(F.lit(1)).alias("n"))
        counts = soft.join(F.broadcast(hot), "source", "left_anti").select("*", one).unionByName(large)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, g in whole_groups(batches, 1, BATCH):
            value, cell, n = (t.column(k).to_numpy() for k in (1, 2, 3))
            got = outliers(Cells(g, value.astype(np.int64), cell >> 3, cell & 7, n), sway, least)
            # one row per cell, whether its readings came counted or one by one
            k = got.pop("index").astype(np.int64)
            _, first, kind = np.unique(np.stack([g[k], value[k], cell[k]]), axis=1, return_index=True, return_inverse=True)
            at = pa.array(k[first])
            got = {c: x[first] for c, x in got.items()} | {"n": np.bincount(kind, n[k], len(first))}
            own = [t.column(j).combine_chunks().take(at) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(own, _OUT)), *(pa.array(got[f.name].astype(f.type.to_pandas_dtype()), f.type) for f in list(_OUT)[3:])], schema=_OUT)

    ddl = "source string, value int, cell long, n long, level double, span double, total long, uses long, residual double, step long, bound double"
    return counts.repartition("source").sortWithinPartitions("source").mapInArrow(run, ddl)


def exact_rule(values: DataFrame, floor: float = 20.0, spans: float = 3.0) -> DataFrame:
    """Values farther from the source's median than the floor and than ``spans`` 10-90 % spans."""
    d = F.abs(F.col("value") - F.col("level"))
    return values.where((d > floor) & (d > F.col("span") * spans))


def _row_no() -> Column:
    return F.shiftright("code", 15)


def all_readings(stop_times: DataFrame, pathways: DataFrame) -> DataFrame:
    """The readings of both tables, written once: counting reads their values, the way back to rows reads them again."""
    return written(stop_time_readings(stop_times).unionByName(pathway_readings(pathways)))


def spikes(stop_times: DataFrame, pathways: DataFrame) -> DataFrame:
    """table_name, row_no of the rows with an impossible, stuck or implausible reading, each once.

    Nulls are no readings; empty tables give no rows; sources with fewer than 12 readings
    are only held against the range and constant-run checks.

    On the way back from bad values to rows a bit table of fixed size drops almost all
    readings before the join; values that very many rows have are joined in parts.
    """
    readings = all_readings(stop_times, pathways)
    bad = written(exact_rule(outlying_cells(readings, SWAY)).groupBy("source", "value").agg(F.max("uses").alias("uses")))
    soft = spread_join(screened(readings.where(_SOFT), bad, ["source", "value"]), bad, ["source", "value"], "uses", _row_no(), "left_semi")
    table = lambda paths: F.when(paths, "pathways").otherwise("stop_times").alias("table_name")
    hard = readings.where(f"not {_SOFT}").select(table(F.col("source") == "p"), _row_no().alias("row_no"))
    return soft.select(table(F.col("source").startswith("t")), _row_no().alias("row_no")).unionByName(hard).distinct()


def anomalies(stop_times: DataFrame, pathways: DataFrame) -> DataFrame:
    """table_name, row_no, reading, value, level, residual, bound, step: the outliers of the decomposition and the test alone.

    One row per reading; a row of stop_times may have two (dwell and run).
    """
    readings = all_readings(stop_times, pathways)
    bad = written(outlying_cells(readings, None).drop("uses", "span", "total"))
    keys = ["source", "value", "cell"]
    rows = screened(readings.where(_SOFT).withColumn("cell", F.pmod("code", F.lit(CELLS))), bad, keys)
    found = spread_join(rows, bad, keys, "n", _row_no())
    kind = F.substring("source", 1, 1)
    reading = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[kind]
    return found.select(F.when(kind == "t", "pathways").otherwise("stop_times").alias("table_name"), _row_no().alias("row_no"), reading.alias("reading"), "value", "level", "residual", "bound", "step")
