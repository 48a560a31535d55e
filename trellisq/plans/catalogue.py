"""Queries over the timetable tables with their oracle SQL: stages, checks, statistics and graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property, lru_cache
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellisq.functions import exprs
from trellisq.graph import model, report, search
from trellisq.operators import checks, labels, stages, stats
from trellisq.operators import timetable as tt
from trellisq.plans.problems import _BLANKS, _SECONDS
from trellisq.session import kept_until_release, shared_folder, written
from trellisq.sources.gtfs import coordinates, last_rows, names, pathway_pairs, ranked_rows, report_text, scan, write_table
from trellisq.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL."""

    def keep(f: Callable[["Tables"], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, d: f(Tables(spark, d))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


class Tables:
    """The tables of one folder and what is derived from them, each derived once."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def ev(self) -> DataFrame:
        return tt.clean_stop_times(self.stop_times)

    @cached_property
    def tr(self) -> DataFrame:
        return tt.clean_trips(self.trips)

    @cached_property
    def gr(self) -> DataFrame:
        return tt.trip_groups(self.trips, self.routes)

    @cached_property
    def rs(self) -> DataFrame:
        return tt.route_stops(self.ev, self.gr)

    @cached_property
    def order(self) -> DataFrame:
        """The order of the lines that have trips: from the trips alone, so that no event is read for it."""
        return tt.line_order(self.gr)

    @cached_property
    def tx(self) -> DataFrame:
        return tt.transitions(self.ev, self.gr, self.rs)

    @cached_property
    def kept_tx(self) -> DataFrame:
        """The transitions, written: for queries that read them more than once."""
        return written(self.tx)

    @property
    def pw(self) -> DataFrame:
        """The last edition of each pathway."""
        return last_rows(self.pathways.select("pathway_id", "from_stop_id", "to_stop_id", "traversal_time", "signposted_as", "row_no"), ["pathway_id"])

    @property
    def weights(self) -> DataFrame:
        """Train edges and entrance edges, entrances at their last time."""
        sw = stages.edge_weights(self.ev, self.gr, self.rs, self.order).withColumn("type", F.lit("SW"))
        pw = stages.entrance_edges(self.pw.where("traversal_time > 0")).withColumn("type", F.lit("PW"))
        return sw.select("from_stop_id", "to_stop_id", "weight_seconds", "type").unionByName(pw.groupBy("from_stop_id", "to_stop_id", "type").agg(F.min("weight_seconds").alias("weight_seconds")))


def r6(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles rounded to six decimals."""
    return df.select(*(F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns))


def cte(*parts: str) -> str:
    """WITH clause of the named parts and all that they need."""
    need: list[str] = []

    def add(name: str) -> None:
        for other in _PARTS:
            if other != name and f"{other}" in _words(_PARTS[name]):
                add(other)
        if name not in need:
            need.append(name)

    for p in parts:
        add(p)
    return "WITH " + ",\n".join(f"{n} AS ({_PARTS[n]})" for n in need) + "\n"


@lru_cache(maxsize=None)
def _words(s: str) -> frozenset[str]:
    import re

    return frozenset(re.findall(r"\w+", s))


def _dotted(c: str) -> str:
    return ", ".join(f"coalesce(CASE WHEN regexp_full_match(split_part({c}, '.', {i}), '[0-9]+') THEN TRY_CAST(split_part({c}, '.', {i}) AS BIGINT) END, 0)" for i in (1, 2, 3))


def _wrap(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) - ({a}) < 0 THEN ((({b}) - ({a})) % 86400 + 86400) % 86400 ELSE ({b}) - ({a}) END)"


def _labelled(x: str, bounds: tuple[tuple[float | None, str], ...]) -> str:
    """SQL for the label of the first bound above x."""
    return "CASE " + " ".join(f"WHEN {x} < {limit} THEN '{label}'" for limit, label in bounds[:-1]) + f" ELSE '{bounds[-1][1]}' END"


def _every(bounds: tuple[tuple[float | None, str], ...]) -> str:
    return "unnest([" + ", ".join(f"'{label}'" for _, label in bounds) + "])"


_T = lambda c: f"trim({c}, {_BLANKS})"
_STAT = "count(v) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS stdev, CAST(median(v) AS DOUBLE) AS median"
_HALF_UP = "(2 * sum(total) + count(total)) // (2 * count(total))"
_CLOCK = lambda x: f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || printf('%02d:%02d:%02d', abs({x}) // 3600, abs({x}) % 3600 // 60, abs({x}) % 60))"

_PARTS = {
    "ev": f"""SELECT {_T('trip_id')} AS trip_id, stop_sequence AS seq, {_T('stop_id')} AS stop_id, trim(arrival_time) AS arrival_time, trim(departure_time) AS departure_time, row_no
      FROM stop_times WHERE {_T('trip_id')} <> '' AND {_T('stop_id')} <> '' AND stop_sequence IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY {_T('trip_id')}, stop_sequence ORDER BY row_no) = 1""",
    "tr": f"""SELECT {_T('trip_id')} AS trip_id, nullif({_T('route_id')}, '') AS line, direction_id AS direction, nullif(trim(trip_headsign), '') AS headsign
      FROM trips WHERE {_T('trip_id')} <> '' QUALIFY row_number() OVER (PARTITION BY {_T('trip_id')} ORDER BY row_no DESC) = 1""",
    "gr": f"SELECT trip_id, line, direction FROM tr WHERE direction IN (0, 1) AND line IN (SELECT {_T('route_id')} FROM routes WHERE route_id IS NOT NULL)",
    "places": "SELECT line, stop_id, seq, count(*) AS n FROM ev JOIN gr USING (trip_id) WHERE direction = 0 GROUP BY ALL",
    "lead_stops": "SELECT * FROM places QUALIFY row_number() OVER (PARTITION BY line, seq ORDER BY n DESC, stop_id) = 1",
    "usual": "SELECT line, stop_id, seq FROM lead_stops QUALIFY row_number() OVER (PARTITION BY line, stop_id ORDER BY n DESC, seq) = 1",
    "rs": "SELECT line, stop_id, row_number() OVER (PARTITION BY line ORDER BY seq) AS pos FROM usual",
    "lo": f"SELECT line, row_number() OVER (ORDER BY {_dotted('line')}, line) - 1 AS line_ord FROM (SELECT DISTINCT line FROM rs)",
    "fp": "SELECT line, stop_id AS a, lead(stop_id) OVER (PARTITION BY line ORDER BY pos) AS b FROM rs QUALIFY b IS NOT NULL",
    "ep": "SELECT line, 0 AS direction, a, b FROM fp UNION ALL SELECT line, 1, b, a FROM fp",
    "nx": "SELECT *, lead(seq) OVER w AS next_seq, lead(stop_id) OVER w AS next_stop, lead(arrival_time) OVER w AS next_arrival FROM (SELECT ev.*, line, direction FROM ev JOIN gr USING (trip_id) WHERE (line, stop_id) IN (SELECT line, stop_id FROM rs)) WINDOW w AS (PARTITION BY trip_id ORDER BY seq, row_no)",
    "tx": f"""SELECT line, direction, stop_id AS a, next_stop AS b, trip_id, (({_SECONDS('arrival_time')}) % 86400 + 86400) % 86400 // 3600 AS hour,
      {_wrap(_SECONDS('arrival_time'), _SECONDS('next_arrival'))} AS total, {_wrap(_SECONDS('arrival_time'), _SECONDS('departure_time'))} AS door, {_wrap(_SECONDS('departure_time'), _SECONDS('next_arrival'))} AS run
      FROM nx WHERE next_seq = seq + 1 AND (line, direction, stop_id, next_stop) IN (SELECT line, direction, a, b FROM ep)""",
    "st_total": f"SELECT line, direction, a, b, count(total) AS n, avg(total) AS mean, coalesce(stddev_samp(total), 0) AS stdev, CAST(median(total) AS DOUBLE) AS median FROM tx WHERE total IS NOT NULL GROUP BY ALL",
    "st_door": "SELECT line, direction, a, b, count(door) AS n, avg(door) AS mean, coalesce(stddev_samp(door), 0) AS stdev FROM tx WHERE door IS NOT NULL GROUP BY ALL",
    "st_run": "SELECT line, direction, a, b, count(run) AS n, avg(run) AS mean, coalesce(stddev_samp(run), 0) AS stdev FROM tx WHERE run IS NOT NULL GROUP BY ALL",
    "cv": "SELECT *, stdev / mean AS cv, " + _labelled("stdev / mean", stats.CV_BUCKETS) + " AS bucket FROM st_total WHERE mean > 0",
    "hm": "SELECT line, direction, a, b, hour, sum(door + run) / count(*) AS m FROM tx WHERE door IS NOT NULL AND run IS NOT NULL GROUP BY ALL",
    "he": "SELECT *, min(m) OVER w AS lo, max(m) OVER w AS hi FROM hm WINDOW w AS (PARTITION BY line, direction, a, b)",
    "hr": f"""SELECT line, direction, a, b, mean, hi - lo AS range, (hi - lo) / mean AS range_pct, min_hours, lo AS min_mean, max_hours, hi AS max_mean,
      {_labelled("(hi - lo) / mean", stats.RANGE_BUCKETS)} AS bucket
      FROM (SELECT line, direction, a, b, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS hours, string_agg(hour, ',' ORDER BY hour) FILTER (m = lo) AS min_hours, string_agg(hour, ',' ORDER BY hour) FILTER (m = hi) AS max_hours FROM he GROUP BY ALL)
      JOIN st_total USING (line, direction, a, b) WHERE hours >= 2 AND mean > 0""",
    "viol": """SELECT trip_id, stop_id AS stop_a, next_stop AS stop_b, seq AS seq_a, next_seq AS seq_b
      FROM (SELECT ev.*, line, CASE WHEN direction = 1 THEN 1 ELSE 0 END AS direction, lead(seq) OVER w AS next_seq, lead(stop_id) OVER w AS next_stop FROM ev JOIN tr USING (trip_id) WHERE line IN (SELECT line FROM rs) WINDOW w AS (PARTITION BY trip_id ORDER BY seq, row_no)) v
      WHERE next_seq = seq + 1 AND NOT EXISTS (SELECT 1 FROM ep WHERE ep.line = v.line AND ep.direction = v.direction AND ep.a = v.stop_id AND ep.b = v.next_stop)""",
    "held": "SELECT ev.*, tr.line, min(seq) OVER (PARTITION BY trip_id) AS first_seq, max(seq) OVER (PARTITION BY trip_id) AS last_seq FROM ev JOIN tr USING (trip_id)",
    "dw": f"""SELECT line, stop_id, count(*) FILTER (eq) AS equal, count(*) FILTER (eq AND (seq = first_seq OR seq = last_seq)) AS terminal, count(*) AS total, sum(d) AS dwell_sum, count(d) AS dwell_n, avg(d) AS dwell_mean,
      CASE WHEN count(d) > 0 THEN coalesce(stddev_samp(d), 0) END AS dwell_stdev, list(trip_id ORDER BY row_no) FILTER (eq) AS all_samples
      FROM (SELECT *, arrival_time = departure_time AS eq, CASE WHEN arrival_time <> departure_time AND {_SECONDS('departure_time')} >= {_SECONDS('arrival_time')} THEN {_SECONDS('departure_time')} - {_SECONDS('arrival_time')} END AS d FROM held
        WHERE line IS NOT NULL AND arrival_time <> '' AND departure_time <> '') GROUP BY line, stop_id""",
    "ld": "SELECT line, sum(dwell_sum) AS s, sum(dwell_n) AS k FROM dw GROUP BY line",
    "pool": "SELECT sum(dwell_sum) AS ps, sum(dwell_n) AS pk FROM dw WHERE line <> 'FM'",
    "doors": """SELECT stop_id, line, CAST(CASE WHEN equal < total THEN CASE WHEN dwell_n > 0 THEN (2 * dwell_sum + dwell_n) // (2 * dwell_n) ELSE 0 END
      WHEN k > 0 THEN (2 * s + k) // (2 * k) WHEN pk > 0 THEN (2 * ps + pk) // (2 * pk) ELSE 0 END AS INTEGER) AS door_seconds FROM dw JOIN ld USING (line), pool WHERE equal > 0""",
    "sh": "SELECT stop_id AS original_stop_id, line, row_number() OVER (PARTITION BY stop_id ORDER BY line_ord) - 1 AS idx, stop_id || CAST(row_number() OVER (PARTITION BY stop_id ORDER BY line_ord) - 1 AS VARCHAR) AS new_stop_id FROM rs JOIN lo USING (line) QUALIFY count(*) OVER (PARTITION BY stop_id) > 1",
    "pl": "SELECT * FROM pathways WHERE pathway_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pathway_id ORDER BY row_no DESC) = 1",
    "pp": r"SELECT regexp_extract(pathway_id, '^PW\.([^_]+)_([^\s]+)$', 1) AS a, regexp_extract(pathway_id, '^PW\.([^_]+)_([^\s]+)$', 2) AS b FROM pathways WHERE regexp_full_match(pathway_id, 'PW\.([^_]+)_([^\s]+)')",
    "cov": "SELECT DISTINCT a AS platform, b AS entrance FROM (SELECT a, b FROM pp UNION ALL SELECT b, a FROM pp) WHERE a LIKE '1.%' AND b LIKE 'E.%'",
    "nm": "SELECT stop_id, stop_name FROM stops WHERE stop_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY row_no DESC) = 1",
    "sw": f"SELECT a AS src, b AS dst, CAST({_HALF_UP} AS BIGINT) AS weight, 'SW' AS type FROM tx WHERE total IS NOT NULL GROUP BY a, b",
    "ew": "SELECT trim(from_stop_id) AS src, trim(to_stop_id) AS dst, CAST(min(traversal_time) AS BIGINT) AS weight, 'PW' AS type FROM pl WHERE traversal_time > 0 AND (trim(from_stop_id) LIKE 'E.%' AND trim(to_stop_id) LIKE '1.%' OR trim(from_stop_id) LIKE '1.%' AND trim(to_stop_id) LIKE 'E.%') GROUP BY ALL",
    "ed": "SELECT * FROM sw UNION ALL SELECT * FROM ew",
    "vx": "SELECT src AS id FROM ed UNION SELECT dst FROM ed",
    "ng": "SELECT s_nationkey AS a, c_nationkey AS b, CAST((2 * sum(CAST(l_quantity AS BIGINT)) + count(*)) // (2 * count(*)) AS BIGINT) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2",
    "xy": "SELECT stop_id, stop_lat, stop_lon FROM (SELECT * FROM stops WHERE stop_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY row_no DESC) = 1) WHERE stop_lat IS NOT NULL AND stop_lon IS NOT NULL",
}

# --- stages -------------------------------------------------------------------------


@query("SELECT count(*) AS total, count(*) FILTER (trim(route_id) LIKE '2.%') AS removed, count(*) - count(*) FILTER (trim(route_id) LIKE '2.%') AS kept FROM trips")
def network_counts(t: Tables) -> DataFrame:
    return stages.network_counts(t.trips, "2.", "route_id")


@query("SELECT row_no, route_id, trip_id FROM trips WHERE route_id IS NULL OR NOT trim(route_id) LIKE '2.%'")
def network_filter(t: Tables) -> DataFrame:
    return stages.network_filter(t.trips, "2.", "route_id").select("row_no", "route_id", "trip_id")


@query(f"SELECT line, row_number() OVER (ORDER BY {_dotted('line')}, line) - 1 AS line_ord FROM (SELECT DISTINCT nullif({_T('route_id')}, '') AS line FROM trips WHERE {_T('route_id')} <> '')")
def natural_line_order(t: Tables) -> DataFrame:
    return tt.line_order(t.tr.where("line is not null").unionByName(t.trips.select(tt.bare("route_id").alias("line")).where("line is not null"), allowMissingColumns=True))


_SIG = """, sig AS (SELECT trip_id, list({x} ORDER BY seq) AS s, count(*) AS n FROM ev GROUP BY 1),
g AS (SELECT s, min(trip_id) AS keep FROM sig GROUP BY s HAVING count(*) > 1),
dup AS (SELECT trip_id, keep, n AS n_events FROM sig JOIN g USING (s) WHERE trip_id <> keep)
"""
_FULL = "concat_ws('|', seq, coalesce(arrival_time, '~'), coalesce(departure_time, '~'), stop_id)"


@query(cte("ev") + _SIG.format(x=_FULL) + "SELECT trip_id, keep, n_events FROM dup")
def duplicate_trips(t: Tables) -> DataFrame:
    return stages.duplicate_trips(t.ev)


@query(cte("ev") + _SIG.format(x="concat_ws('|', seq, stop_id)") + "SELECT trip_id, keep, n_events FROM dup")
def same_pattern_trips(t: Tables) -> DataFrame:
    return stages.duplicate_trips(t.ev, ("seq", "stop_id"))


@query(cte("ev") + _SIG.format(x="concat_ws('|', seq, stop_id)") + ", sizes AS (SELECT keep, count(*) + 1 AS size FROM dup GROUP BY keep) SELECT size, count(*) AS groups, min(keep) AS example FROM sizes GROUP BY size")
def pattern_sizes(t: Tables) -> DataFrame:
    return stages.group_sizes(stages.duplicate_trips(t.ev, ("seq", "stop_id")))


@query(cte("ev") + _SIG.format(x="concat_ws('|', seq, stop_id)") + "SELECT trip_id, count(*) AS n FROM ev WHERE trip_id NOT IN (SELECT trip_id FROM dup) GROUP BY trip_id")
def events_without_duplicates(t: Tables) -> DataFrame:
    ev = t.ev
    return stages.without(ev, stages.duplicate_trips(ev, ("seq", "stop_id"))).groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))


@query(cte("viol") + "SELECT * FROM viol")
def order_violations(t: Tables) -> DataFrame:
    return stages.order_violations(t.ev, t.tr, t.rs)


@query(cte("ev", "viol") + "SELECT trip_id, row_no, CAST(seq + (SELECT count(*) FROM viol WHERE viol.trip_id = ev.trip_id AND seq_b <= seq) AS INTEGER) AS seq FROM ev")
def opened_gaps(t: Tables) -> DataFrame:
    ev = t.ev
    return stages.open_gaps(ev, stages.order_violations(ev, t.tr, t.rs)).select("trip_id", "row_no", "seq")


@query(cte("dw") + "SELECT line, stop_id, equal, terminal, total, CAST(dwell_sum AS BIGINT) AS dwell_sum, dwell_n, round(dwell_mean, 6) AS dwell_mean, round(dwell_stdev, 6) AS dwell_stdev, array_to_string(all_samples[1:5], ',') AS samples FROM dw")
def dwell_counts(t: Tables) -> DataFrame:
    return r6(stages.dwell_counts(t.ev, t.tr), "dwell_mean", "dwell_stdev").withColumn("samples", F.array_join("samples", ","))


@query(cte("doors") + "SELECT * FROM doors")
def door_seconds(t: Tables) -> DataFrame:
    return stages.door_seconds(stages.dwell_counts(t.ev, t.tr))


@query(cte("dw") + "SELECT line, stop_id, equal, total, dwell_n, round(dwell_mean, 6) AS dwell_mean, round(dwell_stdev, 6) AS dwell_stdev FROM dw WHERE equal > 0 AND equal < total")
def partial_dwell(t: Tables) -> DataFrame:
    return r6(stages.partial_dwell(stages.dwell_counts(t.ev, t.tr)), "dwell_mean", "dwell_stdev")


@query(
    cte("held")
    + f"""SELECT line, count(d) AS n, round(avg(d), 6) AS mean_seconds, CASE WHEN count(d) > 0 THEN round(coalesce(stddev_samp(d), 0), 6) END AS stdev_seconds
FROM (SELECT line, CASE WHEN arrival_time <> departure_time AND {_SECONDS('departure_time')} >= {_SECONDS('arrival_time')} THEN {_SECONDS('departure_time')} - {_SECONDS('arrival_time')} END AS d FROM held WHERE line IS NOT NULL AND arrival_time <> '' AND departure_time <> '') GROUP BY line"""
)
def line_dwell(t: Tables) -> DataFrame:
    return r6(stages.line_dwell(stages.dwell_counts(t.ev, t.tr)), "mean_seconds", "stdev_seconds")


@query(
    cte("ev", "tr", "doors")
    + f""", x AS (SELECT ev.*, door_seconds, min(seq) OVER w AS f, max(seq) OVER w AS l, {_SECONDS('departure_time')} AS s,
      coalesce(arrival_time = departure_time AND arrival_time <> '', false) AND door_seconds IS NOT NULL AS hit
      FROM ev LEFT JOIN tr USING (trip_id) LEFT JOIN doors ON doors.stop_id = ev.stop_id AND doors.line = tr.line WINDOW w AS (PARTITION BY ev.trip_id))
SELECT trip_id, seq, stop_id, row_no, CASE WHEN hit AND seq = f THEN {_CLOCK('(s - door_seconds)')} ELSE arrival_time END AS arrival_time,
  CASE WHEN hit AND seq = l AND seq <> f THEN {_CLOCK('(s + door_seconds)')} ELSE departure_time END AS departure_time FROM x"""
)
def applied_door_times(t: Tables) -> DataFrame:
    ev, tr = t.ev, t.tr
    return stages.apply_door_times(ev, tr, stages.door_seconds(stages.dwell_counts(ev, tr)))


@query(cte("sh") + "SELECT original_stop_id, line, CAST(idx AS INTEGER) AS idx, new_stop_id FROM sh")
def shared_platforms(t: Tables) -> DataFrame:
    return stages.shared_stops(t.rs, t.order)


@query(cte("sh") + r"SELECT row_no, coalesce(new_stop_id, stop_id) AS stop_id, coalesce(regexp_replace(new_stop_id, '^[^.]*\.', ''), stop_code) AS stop_code FROM stops LEFT JOIN sh ON original_stop_id = stop_id")
def split_stop_rows(t: Tables) -> DataFrame:
    return stages.split_stop_rows(t.stops.select("row_no", "stop_id", "stop_code"), stages.shared_stops(t.rs, t.order))


@query(
    cte("sh", "pl")
    + """, f AS (SELECT pathway_id, from_stop_id, to_stop_id, x.new_stop_id AS nf, y.new_stop_id AS nt FROM pl LEFT JOIN sh x ON x.original_stop_id = from_stop_id LEFT JOIN sh y ON y.original_stop_id = to_stop_id)
SELECT CASE WHEN nf IS NOT NULL OR nt IS NOT NULL THEN 'PW.' || concat_ws('_', coalesce(nf, from_stop_id), coalesce(nt, to_stop_id)) ELSE pathway_id END AS pathway_id, coalesce(nf, from_stop_id) AS from_stop_id, coalesce(nt, to_stop_id) AS to_stop_id FROM f
UNION ALL SELECT 'PW.' || p.new_stop_id || '_' || q.new_stop_id, p.new_stop_id, q.new_stop_id FROM sh p JOIN sh q ON p.original_stop_id = q.original_stop_id AND p.idx <> q.idx"""
)
def split_pathways(t: Tables) -> DataFrame:
    return stages.split_pathways(t.pw, stages.shared_stops(t.rs, t.order), CORRESPONDENCE_SECONDS).select("pathway_id", "from_stop_id", "to_stop_id")


@query(cte("ev", "tr", "sh") + "SELECT row_no, coalesce(new_stop_id, ev.stop_id) AS stop_id FROM ev LEFT JOIN tr USING (trip_id) LEFT JOIN sh ON original_stop_id = ev.stop_id AND sh.line = tr.line")
def split_events(t: Tables) -> DataFrame:
    return stages.split_events(t.ev, t.tr, stages.shared_stops(t.rs, t.order)).select("row_no", "stop_id")


@query(
    cte("tx", "rs", "lo")
    + f""", w AS (SELECT a AS from_stop_id, b AS to_stop_id, CAST({_HALF_UP} AS INTEGER) AS weight_seconds FROM tx WHERE total IS NOT NULL GROUP BY a, b),
ln AS (SELECT a, b, string_agg(line, '/' ORDER BY line_ord) AS line FROM (SELECT DISTINCT a, b, line FROM tx WHERE total IS NOT NULL) JOIN lo USING (line) GROUP BY a, b),
rk AS (SELECT stop_id, row_number() OVER (ORDER BY line_ord, pos, stop_id) - 1 AS rank FROM (SELECT stop_id, line_ord, pos FROM rs JOIN lo USING (line) QUALIFY row_number() OVER (PARTITION BY stop_id ORDER BY line_ord, pos) = 1))
SELECT row_number() OVER (ORDER BY x.rank, from_stop_id, y.rank, to_stop_id) AS place, from_stop_id, to_stop_id, weight_seconds, ln.line FROM w JOIN ln ON a = from_stop_id AND b = to_stop_id JOIN rk x ON x.stop_id = from_stop_id JOIN rk y ON y.stop_id = to_stop_id"""
)
def edge_weights(t: Tables) -> DataFrame:
    rs, order = t.rs, t.order
    w = stages.with_ranks(stages.edge_weights(t.ev, t.gr, rs, order), tt.first_mention(rs, order))
    return ranked_rows(w, stages.canonical_order(w, rs), "place").select("place", "from_stop_id", "to_stop_id", "weight_seconds", "line")


# --- statistics ---------------------------------------------------------------------


def _stat_sql(v: str) -> str:
    return cte("tx") + f"SELECT line, direction, a, b, {_STAT.replace('(v)', f'({v})')} FROM tx WHERE {v} IS NOT NULL GROUP BY line, direction, a, b"


@query(_stat_sql("total"))
def pair_stats(t: Tables) -> DataFrame:
    return r6(stats.pair_stats(t.tx), "mean", "stdev")


@query(_stat_sql("door"))
def door_stats(t: Tables) -> DataFrame:
    return r6(stats.pair_stats(t.tx, "door"), "mean", "stdev")


@query(_stat_sql("run"))
def run_stats(t: Tables) -> DataFrame:
    return r6(stats.pair_stats(t.tx, "run"), "mean", "stdev")


@query(cte("ep", "st_total") + "SELECT line, direction, a, b, coalesce(n, 0) AS n, round(mean, 6) AS mean, round(stdev, 6) AS stdev, median FROM ep LEFT JOIN st_total USING (line, direction, a, b)")
def expected_pair_stats(t: Tables) -> DataFrame:
    return r6(stats.all_pair_stats(tt.expected_pairs(t.rs), stats.pair_stats(t.tx)), "mean", "stdev")


@query(cte("cv") + "SELECT row_number() OVER (ORDER BY cv DESC, line, direction, a, b) AS rank, line, direction, a, b, n, round(mean, 6) AS mean, round(stdev, 6) AS stdev, median, round(cv, 6) AS cv, bucket FROM cv")
def cv_ranking(t: Tables) -> DataFrame:
    return r6(stats.cv_ranking(stats.pair_stats(t.tx)), "mean", "stdev", "cv")


@query(cte("cv") + ", l AS (SELECT " + _every(stats.CV_BUCKETS) + " AS bucket) SELECT l.bucket, count(cv) AS n, round(count(cv) * 100.0 / sum(count(cv)) OVER (), 6) AS pct FROM l LEFT JOIN cv USING (bucket) GROUP BY l.bucket")
def cv_buckets(t: Tables) -> DataFrame:
    return r6(stats.bucket_counts(stats.cv_ranking(stats.pair_stats(t.tx)), stats.CV_BUCKETS), "pct")


_HOURLY = ", ".join(f"round(avg({c}), 6) AS {c}_mean, round(coalesce(stddev_samp({c}), 0), 6) AS {c}_stdev" for c in ("total", "door", "run"))


@query(cte("tx") + f"SELECT line, direction, a, b, hour, count(*) AS n, {_HOURLY} FROM (SELECT line, direction, a, b, hour, door, run, door + run AS total FROM tx WHERE door IS NOT NULL AND run IS NOT NULL) GROUP BY line, direction, a, b, hour")
def hourly_stats(t: Tables) -> DataFrame:
    return r6(stats.hourly(t.tx), *(f"{c}_{s}" for c in ("total", "door", "run") for s in ("mean", "stdev")))


@query(cte("hr") + "SELECT row_number() OVER (ORDER BY range_pct DESC, line, direction, a, b) AS rank, line, direction, a, b, round(mean, 6) AS mean, round(range, 6) AS range, round(range_pct, 6) AS range_pct, min_hours, round(min_mean, 6) AS min_mean, max_hours, round(max_mean, 6) AS max_mean, bucket FROM hr")
def hourly_range(t: Tables) -> DataFrame:
    tx = t.kept_tx
    return r6(stats.hourly_range(tx, stats.pair_stats(tx)), "mean", "range", "range_pct", "min_mean", "max_mean")


@query(cte("hr") + ", l AS (SELECT " + _every(stats.RANGE_BUCKETS) + " AS bucket) SELECT l.bucket, count(range_pct) AS n, round(count(range_pct) * 100.0 / sum(count(range_pct)) OVER (), 6) AS pct FROM l LEFT JOIN hr USING (bucket) GROUP BY l.bucket")
def range_buckets(t: Tables) -> DataFrame:
    tx = t.kept_tx
    return r6(stats.bucket_counts(stats.hourly_range(tx, stats.pair_stats(tx)), stats.RANGE_BUCKETS), "pct")


@query(cte("st_door", "st_run") + "SELECT line, direction, a, b, round(d.stdev, 6) AS door_stdev, round(r.stdev, 6) AS run_stdev, CASE WHEN d.stdev + r.stdev > 0 THEN CASE WHEN d.stdev / (d.stdev + r.stdev) >= 0.7 THEN 'door' WHEN r.stdev / (d.stdev + r.stdev) >= 0.7 THEN 'run' END END AS dominant FROM st_door d JOIN st_run r USING (line, direction, a, b)")
def stdev_dominance(t: Tables) -> DataFrame:
    tx = t.kept_tx
    return r6(stats.dominance(stats.pair_stats(tx, "door"), stats.pair_stats(tx, "run")), "door_stdev", "run_stdev")


_FLAGGED = "flagged AS (SELECT line, direction, a, b, string_agg(reason, ',' ORDER BY reason) AS reasons FROM (SELECT line, direction, a, b, 'cv' AS reason FROM cv WHERE cv >= 0.15 UNION ALL SELECT line, direction, a, b, 'range' FROM hr WHERE range_pct >= 0.15) GROUP BY line, direction, a, b)"


def _flagged(t: Tables) -> tuple[DataFrame, DataFrame]:
    tx = t.kept_tx
    s = stats.pair_stats(tx)
    cv = stats.cv_ranking(s)
    return cv, stats.flagged_edges(cv, stats.hourly_range(tx, s))


@query(cte("cv", "hr") + f", {_FLAGGED} SELECT * FROM flagged")
def flagged_edges(t: Tables) -> DataFrame:
    return _flagged(t)[1]


@query(cte("cv", "hr") + f", {_FLAGGED} SELECT e AS edges, f AS flagged, e - f AS passing, round((e - f) * 100.0 / e, 6) AS passing_pct FROM (SELECT count(*) AS e FROM cv), (SELECT count(*) AS f FROM flagged)")
def edge_verdict(t: Tables) -> DataFrame:
    return r6(stats.verdict(*_flagged(t)), "passing_pct")


@query(cte("st_total") + "SELECT x.line, x.a, x.b, round(x.mean, 6) AS mean_0, x.n AS n_0, round(y.mean, 6) AS mean_1, y.n AS n_1, round(abs(x.mean - y.mean), 6) AS gap FROM st_total x JOIN st_total y ON x.line = y.line AND x.a = y.b AND x.b = y.a AND x.direction = 0 AND y.direction = 1 ORDER BY abs(x.mean - y.mean) DESC, x.line, x.a, x.b LIMIT 160")
def directional_asymmetry(t: Tables) -> DataFrame:
    out = stats.directional_asymmetry(stats.pair_stats(t.tx)).orderBy(F.col("gap").desc(), "line", "a", "b").limit(160)
    return r6(out, "mean_0", "mean_1", "gap")


@query(cte("tx") + ", m AS (SELECT a, b, line, sum(total) / count(total) AS mean FROM tx WHERE total IS NOT NULL GROUP BY ALL) SELECT a, b, count(*) AS n_lines, string_agg(line, '/' ORDER BY line) AS lines, round(max(mean) - min(mean), 6) AS spread FROM m GROUP BY a, b HAVING count(*) >= 2")
def line_spread(t: Tables) -> DataFrame:
    return r6(stats.line_spread(stats.pair_stats(t.tx)), "spread")


@query(
    cte("rs", "pp", "nm")
    + """, w AS (SELECT stop_id, entrance, max(o) AS o, max(i) AS i FROM (SELECT a AS stop_id, b AS entrance, 1 AS o, 0 AS i FROM pp WHERE a LIKE '1.%' AND b LIKE 'E.%' UNION ALL SELECT b, a, 0, 1 FROM pp WHERE a LIKE 'E.%' AND b LIKE '1.%') GROUP BY ALL)
SELECT line, pos, rs.stop_id, coalesce(x.stop_name, '') AS stop_name, entrance, y.stop_name AS entrance_name, CASE WHEN o = 1 AND i = 1 THEN 'both' WHEN o = 1 THEN 'platform_to_entrance' WHEN i = 1 THEN 'entrance_to_platform' END AS direction
FROM rs LEFT JOIN w ON w.stop_id = rs.stop_id LEFT JOIN nm x ON x.stop_id = rs.stop_id LEFT JOIN nm y ON y.stop_id = entrance"""
)
def line_report(t: Tables) -> DataFrame:
    return stats.line_report(t.rs, names(t.stops), pathway_pairs(t.pathways).distinct())


# --- checks -------------------------------------------------------------------------

LINKS = [("stop_times", "stop_id", "stops", "stop_id"), ("stop_times", "trip_id", "trips", "trip_id"), ("pathways", "from_stop_id", "stops", "stop_id"), ("pathways", "to_stop_id", "stops", "stop_id"), ("trips", "route_id", "routes", "route_id")]


@query(" UNION ALL ".join(f"SELECT DISTINCT '{c}' AS table_name, '{f}' AS field_name, {_T(f)} AS key FROM {c} WHERE {_T(f)} <> '' AND {_T(f)} NOT IN (SELECT {_T(k)} FROM {p} WHERE {k} IS NOT NULL)" for c, f, p, k in LINKS))
def missing_keys(t: Tables) -> DataFrame:
    return checks.foreign_keys({n: getattr(t, n) for n in ("stop_times", "stops", "trips", "pathways", "routes")}, LINKS)


@query(cte("ev") + "SELECT * FROM (SELECT trip_id, seq, lead(seq) OVER (PARTITION BY trip_id ORDER BY seq) AS next_seq FROM (SELECT DISTINCT trip_id, seq FROM ev)) WHERE next_seq <> seq + 1")
def sequence_gaps(t: Tables) -> DataFrame:
    return checks.sequence_gaps(t.ev)


@query(
    cte("tr")
    + """, h AS (SELECT DISTINCT line, coalesce(headsign, '') AS headsign, CAST(direction AS VARCHAR) AS d FROM tr WHERE line IS NOT NULL),
p AS (SELECT line, headsign, count(DISTINCT d) AS n, min(d) AS one FROM h GROUP BY ALL),
l AS (SELECT line, count(*) AS headsigns, count(*) FILTER (n = 1) AS mapped, count(*) FILTER (n <> 1) AS ambiguous, count(DISTINCT one) FILTER (n = 1) AS targets FROM p GROUP BY line),
x AS (SELECT line, count(DISTINCT coalesce(d, '')) AS directions FROM h GROUP BY line)
SELECT line, headsigns, directions, issues FROM (SELECT *, concat_ws(',', CASE WHEN headsigns <> 2 THEN 'headsigns' END, CASE WHEN directions <> 2 THEN 'directions' END, CASE WHEN ambiguous > 0 THEN 'ambiguous' END, CASE WHEN mapped = 2 AND targets <> 2 THEN 'same_direction' END) AS issues FROM l JOIN x USING (line)) WHERE issues <> ''"""
)
def headsign_directions(t: Tables) -> DataFrame:
    return checks.headsign_directions(t.tr)


@query(cte("tr") + f"SELECT DISTINCT {_T('route_id')} AS line FROM routes WHERE {_T('route_id')} <> '' AND {_T('route_id')} NOT IN (SELECT line FROM tr WHERE line IS NOT NULL)")
def routes_without_trips(t: Tables) -> DataFrame:
    return checks.routes_without_trips(t.routes, t.tr)


@query(
    cte("pp", "pl")
    + f""", l AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM pp), r AS (SELECT DISTINCT least({_T('from_stop_id')}, {_T('to_stop_id')}) AS a, greatest({_T('from_stop_id')}, {_T('to_stop_id')}) AS b FROM pathways WHERE {_T('from_stop_id')} <> '' AND {_T('to_stop_id')} <> '')
SELECT *, 'left' AS side FROM (SELECT * FROM l EXCEPT SELECT * FROM r) UNION ALL SELECT *, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM l)"""
)
def pair_differences(t: Tables) -> DataFrame:
    return checks.pair_differences(pathway_pairs(t.pathways), t.pathways.select(tt.bare("from_stop_id").alias("a"), tt.bare("to_stop_id").alias("b")))


@query(cte("pp") + "SELECT DISTINCT a, b FROM pp WHERE (b, a) NOT IN (SELECT a, b FROM pp)")
def missing_inverse(t: Tables) -> DataFrame:
    return checks.missing_inverse(t.pathways)


@query(
    cte("pl")
    + r""", p AS (SELECT regexp_extract(pathway_id, '^PW\.([^_]+)_([^\s]+)$', 1) AS a, regexp_extract(pathway_id, '^PW\.([^_]+)_([^\s]+)$', 2) AS b, traversal_time AS seconds FROM pl WHERE regexp_full_match(pathway_id, 'PW\.([^_]+)_([^\s]+)'))
SELECT x.a, x.b, x.seconds AS there, y.seconds AS back FROM p x JOIN p y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.seconds <> y.seconds"""
)
def uneven_times(t: Tables) -> DataFrame:
    pw = t.pw
    pairs = pathway_pairs(pw.withColumn("keep", F.lit(1)))
    held = pw.where(F.col("pathway_id").startswith("PW.")).select("pathway_id", F.col("traversal_time").alias("seconds"))
    named = held.join(pairs.withColumn("pathway_id", F.concat(F.lit("PW."), "a", F.lit("_"), "b")), "pathway_id")
    return checks.uneven_times(named.select("a", "b", "seconds"))


@query("SELECT * FROM (SELECT pathway_id, row_no, CASE WHEN traversal_time IS NULL THEN 'missing' WHEN (traversal_time % 15 + 15) % 15 <> 0 THEN 'not_a_multiple' END AS issue FROM pathways) WHERE issue IS NOT NULL")
def invalid_times(t: Tables) -> DataFrame:
    return checks.invalid_times(t.pathways)


@query(f"SELECT pathway_id, row_no, traversal_time FROM pathways WHERE ({_T('from_stop_id')} LIKE 'E.%' AND {_T('to_stop_id')} LIKE '1.%' OR {_T('from_stop_id')} LIKE '1.%' AND {_T('to_stop_id')} LIKE 'E.%') AND traversal_time IS DISTINCT FROM 60")
def entrance_times(t: Tables) -> DataFrame:
    return checks.entrance_times(t.pathways)


@query(cte("cov") + f", e AS (SELECT DISTINCT {_T('stop_id')} AS entrance FROM stops WHERE {_T('stop_id')} LIKE 'E.%'), p AS (SELECT e.entrance, count(platform) AS platforms FROM e LEFT JOIN cov USING (entrance) GROUP BY 1) SELECT platforms, count(*) AS entrances FROM p GROUP BY 1")
def entrance_distribution(t: Tables) -> DataFrame:
    return checks.entrance_distribution(t.stops, checks.coverage(t.pathways))


@query(
    cte("cov", "fp")
    + f""", u AS (SELECT DISTINCT {_T('stop_id')} AS platform FROM stops WHERE {_T('stop_id')} LIKE '1.%' AND {_T('stop_id')} NOT IN (SELECT platform FROM cov)),
f AS (SELECT platform AS neighbour, min(entrance) AS entrance FROM cov GROUP BY 1), n AS (SELECT a AS platform, b AS neighbour FROM fp UNION SELECT b, a FROM fp)
SELECT u.platform, x.neighbour, x.entrance FROM u LEFT JOIN (SELECT n.platform, neighbour, entrance FROM n JOIN f USING (neighbour)) x ON x.platform = u.platform"""
)
def uncovered_platforms(t: Tables) -> DataFrame:
    return checks.uncovered_platforms(t.stops, checks.coverage(t.pathways), tt.forward_pairs(t.rs))


@query(
    cte("nm", "fp")
    + """, p AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM fp WHERE a <> b), n AS (SELECT * FROM nm WHERE stop_id LIKE '1.%' AND stop_name <> ''),
s AS (SELECT stop_name, count(*) AS platforms FROM n GROUP BY 1 HAVING count(*) > 1), h AS (SELECT x.stop_name, count(*) AS present FROM p JOIN n x ON x.stop_id = a JOIN n y ON y.stop_id = b AND x.stop_name = y.stop_name GROUP BY 1)
SELECT stop_name, platforms, platforms * (platforms - 1) // 2 AS pairs, coalesce(present, 0) AS present, platforms * (platforms - 1) // 2 - coalesce(present, 0) AS missing FROM s LEFT JOIN h USING (stop_name) WHERE platforms * (platforms - 1) // 2 > coalesce(present, 0)"""
)
def same_name_transfers(t: Tables) -> DataFrame:
    return checks.same_name_transfers(t.stops, tt.forward_pairs(t.rs))


# --- graph --------------------------------------------------------------------------


@query(cte("ed") + "SELECT src, dst, weight, type FROM ed")
def graph_edges(t: Tables) -> DataFrame:
    return model.edges(t.weights)


@query(cte("ed") + "SELECT coalesce(type, 'ALL') AS type, count(*) AS arcs, count(DISTINCT (least(src, dst), greatest(src, dst))) AS pairs FROM ed GROUP BY ROLLUP (type)")
def graph_stats(t: Tables) -> DataFrame:
    return model.graph_stats(model.edges(t.weights))


@query(cte("ed", "vx") + "SELECT v AS vertices, e AS arcs, round(e / (v * (v - 1)), 9) AS density FROM (SELECT count(*) AS v FROM vx), (SELECT count(*) AS e FROM ed)")
def graph_capacity(t: Tables) -> DataFrame:
    return model.capacity(model.edges(t.weights)).withColumn("density", F.round("density", 9))


@query(cte("ed", "xy") + """, s AS (SELECT src, dst, sqrt(power(radians(q.stop_lon - p.stop_lon) * cos(radians((p.stop_lat + q.stop_lat) / 2)) * 6371000.0, 2) + power(radians(q.stop_lat - p.stop_lat) * 6371000.0, 2)) / weight AS speed FROM ed JOIN xy p ON p.stop_id = src JOIN xy q ON q.stop_id = dst WHERE weight > 0)
SELECT round(speed, 4) AS speed, src, dst FROM s ORDER BY s.speed DESC, src DESC, dst DESC LIMIT 1""")
def max_speed(t: Tables) -> DataFrame:
    return model.max_speed(model.edges(t.weights), coordinates(t.stops)).withColumn("speed", F.round("speed", 4))


_RELAX = """WITH RECURSIVE {parts}, d(source, node, dist) USING KEY (source, node) AS (
  SELECT {start}
  UNION SELECT d.source, e.dst, min(d.dist + e.weight) FROM d JOIN {edges} e ON e.src = d.node LEFT JOIN recurring.d AS r ON r.source = d.source AND r.node = e.dst
  WHERE d.dist + e.weight < coalesce(r.dist, 1000000000000) GROUP BY d.source, e.dst)
"""


def _hub(edges: DataFrame) -> DataFrame:
    """The vertex with the most outgoing edges, the smallest id of these."""
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "src").limit(1).select(F.col("src").alias("id"))


_HUB = _RELAX.format(parts=cte("ed").removeprefix("WITH "), start="src, src, CAST(0 AS BIGINT) FROM (SELECT src FROM ed GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)", edges="ed")


@query(_HUB + "SELECT source, node, dist FROM d")
def hub_distances(t: Tables) -> DataFrame:
    e = written(model.edges(t.weights))
    return search.distances(e, _hub(e))


@query(_HUB + "SELECT source, node, dist FROM d")
def hub_relaxed(t: Tables) -> DataFrame:
    """The same by relaxation, the way of graphs that may not be sent to tasks."""
    e = written(model.edges(t.weights))
    return search.relax(e, _hub(e))


def _nations(t: Tables) -> DataFrame:
    """Every edge from a supplier's nation to a customer's."""
    rows = (
        t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
        .where(F.col("s_nationkey") != F.col("c_nationkey"))
    )
    return written(rows.groupBy(F.col("s_nationkey").cast("string").alias("src"), F.col("c_nationkey").cast("string").alias("dst")).agg(exprs.half_up_mean(F.col("l_quantity").cast("long")).alias("weight")))


_NATION = _RELAX.format(
    parts=cte("ng").removeprefix("WITH ") + ", ne AS (SELECT CAST(a AS VARCHAR) AS src, CAST(b AS VARCHAR) AS dst, w AS weight FROM ng)",
    start="src, src, CAST(0 AS BIGINT) FROM (SELECT src FROM ne UNION SELECT dst FROM ne)",
    edges="ne",
)


@query(_NATION + "SELECT source, node AS target, dist AS optimum_weight FROM d WHERE source <> node")
def all_pairs_weights(t: Tables) -> DataFrame:
    e = _nations(t)
    return search.all_pairs(e, model.vertices(e)).where("optimum_weight is not null").select("source", "target", "optimum_weight")


@query(_NATION + ", c AS (SELECT source, dist, sum(count(*)) OVER (PARTITION BY source ORDER BY dist) AS high, count(*) AS n FROM d GROUP BY source, dist) SELECT d.source, node AS target, CAST(high - n + 1 AS BIGINT) AS low, CAST(high AS BIGINT) AS high, true AS inside FROM d JOIN c ON c.source = d.source AND c.dist = d.dist WHERE d.source <> node")
def settle_bounds(t: Tables) -> DataFrame:
    e = _nations(t)
    pairs = search.all_pairs(e, model.vertices(e)).where("optimum_weight is not null")
    dist = pairs.select("source", F.col("target").alias("node"), F.col("optimum_weight").alias("dist")).unionByName(model.vertices(e).select(F.col("id").alias("source"), F.col("id").alias("node"), F.lit(0).cast("long").alias("dist")))
    return report.settle_bounds(dist).join(pairs.select("source", "target", "iterations"), ["source", "target"]).select("source", "target", "low", "high", F.col("iterations").between(F.col("low"), F.col("high")).alias("inside"))


@query(_NATION + "SELECT source, node AS target, dist AS optimum_weight FROM d WHERE source <> node")
def a_star_weights(t: Tables) -> DataFrame:
    e = _nations(t)
    return search.a_star_all(e, model.vertices(e), search.EXACT).where("optimum_weight is not null").select("source", "target", "optimum_weight")


_PLANTED = (
    _RELAX.format(
        parts=cte("ng").removeprefix("WITH ")
        + """, ne AS (SELECT CAST(a AS VARCHAR) AS src, CAST(b AS VARCHAR) AS dst, w AS weight FROM ng),
nf AS (SELECT src, dst, weight + CASE WHEN src = '5' THEN 7 ELSE 0 END AS weight FROM ne WHERE dst <> '3')""",
        start="src, src, CAST(0 AS BIGINT) FROM (SELECT src FROM ne UNION SELECT dst FROM ne)",
        edges="ne",
    ).rstrip()
    + """,
c(source, node, dist) USING KEY (source, node) AS (
  SELECT src, src, CAST(0 AS BIGINT) FROM (SELECT src FROM ne UNION SELECT dst FROM ne)
  UNION SELECT c.source, e.dst, min(c.dist + e.weight) FROM c JOIN nf e ON e.src = c.node LEFT JOIN recurring.c AS r ON r.source = c.source AND r.node = e.dst
  WHERE c.dist + e.weight < coalesce(r.dist, 1000000000000) GROUP BY c.source, e.dst)
"""
)


@query(
    _PLANTED
    + """SELECT coalesce(d.source, c.source) AS source, coalesce(d.node, c.node) AS target, CASE WHEN d.dist IS NULL OR c.dist IS NULL THEN 'reachability' ELSE 'weight' END AS mismatch, d.dist AS w_dijkstra, c.dist AS w_changed
FROM (SELECT * FROM d WHERE source <> node) d FULL JOIN (SELECT * FROM c WHERE source <> node) c ON c.source = d.source AND c.node = d.node WHERE d.dist IS DISTINCT FROM c.dist"""
)
def planted_mismatches(t: Tables) -> DataFrame:
    """The report of the searches against one by relaxation over a changed graph: no edge into one nation, seven more on each out of another."""
    e = _nations(t)
    v = model.vertices(e)
    changed = e.where("dst <> '3'").withColumn("weight", F.col("weight") + F.when(F.col("src") == "5", 7).otherwise(0))
    a = search.all_pairs(e, v).select("source", "target", F.col("optimum_weight").alias("weight"))
    b = search.relax(changed, v).where("source <> node").select("source", F.col("node").alias("target"), F.col("dist").alias("weight"))
    return checks.weight_mismatches({"dijkstra": a.where("weight is not null"), "changed": b})


@query()
def search_mismatches(t: Tables) -> DataFrame:
    """The pairs on which searches and relaxation disagree: none; planted_mismatches holds the comparison to SQL."""
    e = _nations(t)
    v = model.vertices(e)
    a = search.all_pairs(e, v).select("source", "target", F.col("optimum_weight").alias("weight"))
    b = search.relax(e, v).where("source <> node").select("source", F.col("node").alias("target"), F.col("dist").alias("weight"))
    return checks.weight_mismatches({"dijkstra": a.where("weight is not null"), "relax": b})


def _entrance_routes(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The edges, and each entrance to the first one by id, on the graph without entrances."""
    e = written(model.edges(t.weights))
    _, out, back = model.entrance_maps(e)
    ids = out.select("entrance").union(back.select("entrance")).distinct()
    asked = ids.select(F.col("entrance").alias("source")).crossJoin(ids.agg(F.min("entrance").alias("target"))).where("source <> target")  # one row on the right
    return e, search.routes(e.where("type <> 'PW'"), asked, back, out, without_entrances=True)


@query(
    _RELAX.format(
        parts=cte("ed").removeprefix("WITH ")
        + """, ids AS (SELECT dst AS id FROM ew WHERE dst LIKE 'E.%' UNION SELECT src FROM ew WHERE src LIKE 'E.%'), goal AS (SELECT min(id) AS t FROM ids), back AS (SELECT dst AS src, src AS dst, weight FROM sw)""",
        start="src, src, CAST(0 AS BIGINT) FROM ew JOIN goal ON dst = t",
        edges="back",
    )
    + """, best AS (SELECT w.src AS id, count(*) AS n, min(dist) AS dist FROM ew w LEFT JOIN d ON d.node = w.dst WHERE w.src LIKE 'E.%' GROUP BY 1)
SELECT id AS source, t AS target, CASE WHEN n IS NULL OR NOT EXISTS (SELECT 1 FROM ew WHERE dst = t) THEN 'no_pathway' WHEN dist IS NULL THEN 'unreachable' ELSE 'ok' END AS status, dist + 120 AS weight FROM ids JOIN goal ON id <> t LEFT JOIN best USING (id)"""
)
def entrance_routes(t: Tables) -> DataFrame:
    return _entrance_routes(t)[1].select("source", "target", "status", "weight")


@query()
def entrance_paths(t: Tables) -> DataFrame:
    """The paths of entrance_routes (ties leave a choice, so without SQL)."""
    return _entrance_routes(t)[1].select("source", "target", F.array_join("path", " -> ").alias("path"), "iterations")


_PLATFORM_PAIRS = _RELAX.format(parts=cte("ed", "vx").removeprefix("WITH "), start="id, id, CAST(0 AS BIGINT) FROM vx WHERE id LIKE '1.%'", edges="ed")


@query(_PLATFORM_PAIRS + "SELECT source, node AS target, dist AS optimum_weight FROM d WHERE source <> node AND node LIKE '1.%'")
def platform_pairs(t: Tables) -> DataFrame:
    """The report of all ordered pairs of platforms of the timetable graph, those that are reached."""
    e = written(model.edges(t.weights))
    return search.all_pairs(e, model.vertices(e).where("id like '1.%'"), reached=True).where("optimum_weight is not null").select("source", "target", "optimum_weight")


@query(_PLATFORM_PAIRS + "SELECT source, node AS target, dist AS optimum_weight FROM d WHERE source <> node AND node LIKE '1.%'")
def platform_pairs_a_star(t: Tables) -> DataFrame:
    """The same by A* under the exact heuristic."""
    e = written(model.edges(t.weights))
    return search.a_star_all(e, model.vertices(e).where("id like '1.%'"), search.EXACT, reached=True).where("optimum_weight is not null").select("source", "target", "optimum_weight")


# --- the graph over split platforms, with transfers ---------------------------------

CORRESPONDENCE_SECONDS = 15


def _combined(t: Tables) -> DataFrame:
    """Train, transfer and entrance edges over the ids of shared platforms; the tables have no transfers but the generated ones."""
    rs, order = t.rs, t.order
    shared = stages.shared_stops(rs, order)
    new = shared.select(F.col("original_stop_id").alias("stop_id"), "line", "new_stop_id")
    split_rs = rs.join(new, ["stop_id", "line"], "left").select("line", "pos", F.coalesce("new_stop_id", "stop_id").alias("stop_id"))
    sw = stages.edge_weights(stages.split_events(t.ev, t.tr, shared), t.gr, split_rs, order)
    none = t.spark.createDataFrame([], "from_stop_id string, to_stop_id string, transfer_type int, min_transfer_time int")
    tf = stages.split_transfers(none, shared, CORRESPONDENCE_SECONDS)
    pw = stages.split_pairs(stages.entrance_edges(t.pw.where("traversal_time > 0")), shared)
    pw = pw.groupBy("from_stop_id", "to_stop_id").agg(F.min("weight_seconds").alias("weight_seconds"))
    return model.edges(stages.combined_weights(sw, tf, pw))


_SPLIT = (
    cte("tx", "sh", "ew")
    + f""", cs AS (SELECT coalesce(x.new_stop_id, a) AS src, coalesce(y.new_stop_id, b) AS dst, CAST({_HALF_UP} AS BIGINT) AS weight, 'SW' AS type
  FROM tx LEFT JOIN sh x ON x.original_stop_id = a AND x.line = tx.line LEFT JOIN sh y ON y.original_stop_id = b AND y.line = tx.line WHERE total IS NOT NULL GROUP BY 1, 2),
ct AS (SELECT p.new_stop_id AS src, q.new_stop_id AS dst, CAST({CORRESPONDENCE_SECONDS} AS BIGINT) AS weight, 'TF' AS type FROM sh p JOIN sh q ON p.original_stop_id = q.original_stop_id AND p.idx <> q.idx),
cp AS (SELECT coalesce(x.new_stop_id, src) AS src, coalesce(y.new_stop_id, dst) AS dst, min(weight) AS weight, 'PW' AS type FROM ew LEFT JOIN sh x ON x.original_stop_id = src LEFT JOIN sh y ON y.original_stop_id = dst GROUP BY 1, 2),
ce AS (SELECT * FROM cs UNION ALL SELECT * FROM ct UNION ALL SELECT * FROM cp)
"""
)


@query(_SPLIT + "SELECT src, dst, weight, type FROM ce")
def combined_edges(t: Tables) -> DataFrame:
    return _combined(t)


@query(_SPLIT + "SELECT coalesce(type, 'ALL') AS type, count(*) AS arcs, count(DISTINCT (least(src, dst), greatest(src, dst))) AS pairs FROM ce GROUP BY ROLLUP (type)")
def combined_stats(t: Tables) -> DataFrame:
    return model.graph_stats(_combined(t))


@query(_SPLIT + "SELECT new_stop_id AS id FROM sh INTERSECT (SELECT src FROM ce UNION SELECT dst FROM ce)")
def split_vertices(t: Tables) -> DataFrame:
    return model.shared_vertices(stages.shared_stops(t.rs, t.order).select(F.col("new_stop_id").alias("id")), model.vertices(_combined(t)))


# --- labels and listings ------------------------------------------------------------

_LABELS = (
    cte("nm", "cov", "rs", "lo")
    + """, sl AS (SELECT DISTINCT stop_id, line, line_ord FROM rs JOIN lo USING (line)),
jl AS (SELECT stop_id, string_agg(line, '-' ORDER BY line_ord) AS lines FROM sl GROUP BY 1),
pl_label AS (SELECT nm.stop_id, concat_ws('-', lines, coalesce(stop_name, '(no name)')) AS label FROM nm LEFT JOIN jl USING (stop_id)),
sv AS (SELECT entrance, platform, coalesce(stop_name, '(no name)') AS name FROM cov LEFT JOIN nm ON nm.stop_id = platform),
sz AS (SELECT entrance, name, count(*) AS n, min(platform) AS first FROM sv GROUP BY ALL),
mt AS (SELECT entrance, name, line, min((platform, line_ord)) AS seen FROM sv JOIN sl ON sl.stop_id = platform GROUP BY ALL),
ml AS (SELECT entrance, name, string_agg(line, '/' ORDER BY seen) AS merged, string_agg(line, '-' ORDER BY seen) AS plain FROM mt GROUP BY ALL),
el AS (SELECT entrance, string_agg(concat_ws('-', CASE WHEN n > 1 THEN merged ELSE plain END, name), ' / ' ORDER BY first) AS parts FROM sz LEFT JOIN ml USING (entrance, name) GROUP BY 1),
en_label AS (SELECT entrance AS stop_id, coalesce(stop_name, '(no name)') || ' -- ' || parts AS label FROM el LEFT JOIN nm ON nm.stop_id = entrance),
node AS (SELECT * FROM en_label UNION ALL SELECT * FROM pl_label WHERE stop_id NOT IN (SELECT stop_id FROM en_label))
"""
)


@query(_LABELS + "SELECT stop_id, label FROM pl_label")
def stop_labels(t: Tables) -> DataFrame:
    return labels.stop_labels(names(t.stops), t.rs, t.order)


@query(_LABELS + "SELECT stop_id, label FROM en_label")
def entrance_labels(t: Tables) -> DataFrame:
    return labels.entrance_labels(names(t.stops), checks.coverage(t.pathways), t.rs, t.order)


@query(_LABELS + "SELECT stop_id, label, ' (' || label || repeat(' ', max(length(label)) OVER () - length(label)) || ')' AS padded FROM node")
def node_labels(t: Tables) -> DataFrame:
    return labels.node_labels(names(t.stops), checks.coverage(t.pathways), t.rs, t.order)


@query(f"SELECT row_number() OVER (ORDER BY {_dotted('trip_id')}, coalesce(stop_sequence, 1000000000), row_no) AS place, row_no FROM (SELECT {_T('trip_id')} AS trip_id, stop_sequence, row_no FROM stop_times WHERE {_T('trip_id')} <> '')")
def natural_stop_times(t: Tables) -> DataFrame:
    rows = t.stop_times.select(tt.bare("trip_id").alias("trip_id"), "stop_sequence", "row_no").where("trip_id is not null")
    return ranked_rows(rows, stages.natural_order(rows, "trip_id", "stop_sequence", "row_no"), "place").select("place", "row_no")


@query(f"SELECT row_number() OVER (ORDER BY {_dotted('route_id')}, coalesce(CAST(direction_id AS VARCHAR), ''), {_dotted('trip_id')}, row_no) AS place, row_no FROM (SELECT {_T('route_id')} AS route_id, {_T('trip_id')} AS trip_id, direction_id, row_no FROM trips WHERE {_T('trip_id')} <> '' AND {_T('route_id')} <> '')")
def natural_trips(t: Tables) -> DataFrame:
    rows = t.trips.select(tt.bare("route_id").alias("route_id"), tt.bare("trip_id").alias("trip_id"), F.coalesce(F.col("direction_id").cast("string"), F.lit("")).alias("direction"), "row_no").where("trip_id is not null and route_id is not null")
    return ranked_rows(rows, [*stages.natural_order(rows, "route_id", "direction"), *stages.natural_order(rows, "trip_id", "row_no")], "place").select("place", "row_no")


@query(cte("ev") + _SIG.format(x="concat_ws('|', seq, stop_id)") + "SELECT row_number() OVER (ORDER BY size, keep) AS place, keep, size FROM (SELECT keep, count(*) + 1 AS size FROM dup GROUP BY keep)")
def group_listing(t: Tables) -> DataFrame:
    return stages.group_listing(stages.duplicate_trips(t.ev, ("seq", "stop_id")))


@query(cte("cv", "hr", "lo") + f", {_FLAGGED} SELECT row_number() OVER (ORDER BY line_ord, direction, a, b) AS place, line, direction, a, b, reasons FROM flagged JOIN lo USING (line)")
def flagged_listing(t: Tables) -> DataFrame:
    held = _flagged(t)[1].join(t.order, "line")
    return ranked_rows(held, ["line_ord", "direction", "a", "b"], "place").select("place", "line", "direction", "a", "b", "reasons")


@query("SELECT row_number() OVER (ORDER BY table_name, field_name, key) AS place, * FROM (" + ORACLE["missing_keys"] + ")")
def missing_key_listing(t: Tables) -> DataFrame:
    found = checks.foreign_keys({n: getattr(t, n) for n in ("stop_times", "stops", "trips", "pathways", "routes")}, LINKS)
    return ranked_rows(found, ["table_name", "field_name", "key"], "place").select("place", "table_name", "field_name", "key")


@query(
    cte("cv", "hr")
    + f""", c AS (SELECT *, row_number() OVER (ORDER BY cv DESC, line, direction, a, b) AS place FROM cv QUALIFY cv >= 0.15 AND row_number() OVER (ORDER BY CASE WHEN cv >= 0.15 THEN 0 ELSE 1 END, cv DESC, line, direction, a, b) <= 2),
r AS (SELECT *, row_number() OVER (ORDER BY range_pct DESC, line, direction, a, b) AS place FROM hr QUALIFY range_pct >= 0.15 AND row_number() OVER (ORDER BY CASE WHEN range_pct >= 0.15 THEN 0 ELSE 1 END, range_pct DESC, line, direction, a, b) <= 2),
s AS (SELECT 'cv' AS section, line, direction, a, b, place, CAST(NULL AS BIGINT) AS shown_at FROM c UNION ALL SELECT 'range', r.line, r.direction, r.a, r.b, r.place, c.place FROM r LEFT JOIN c ON c.line = r.line AND c.direction = r.direction AND c.a = r.a AND c.b = r.b),
h AS (SELECT line, direction, a, b, hour, count(*) AS n, {_HOURLY} FROM (SELECT line, direction, a, b, hour, door, run, door + run AS total FROM tx WHERE door IS NOT NULL AND run IS NOT NULL) GROUP BY line, direction, a, b, hour)
SELECT s.*, h.* EXCLUDE (line, direction, a, b) FROM s LEFT JOIN h ON shown_at IS NULL AND h.line = s.line AND h.direction = s.direction AND h.a = s.a AND h.b = s.b"""
)
def hourly_breakdown(t: Tables) -> DataFrame:
    tx = t.kept_tx
    pairs = stats.pair_stats(tx)
    out = stats.hourly_breakdown(tx, stats.cv_ranking(pairs), stats.hourly_range(tx, pairs))
    return r6(out, *(f"{c}_{s}" for c in ("total", "door", "run") for s in ("mean", "stdev")))


@query(
    cte("nm", "fp")
    + """, n AS (SELECT * FROM nm WHERE stop_id LIKE '1.%' AND stop_name <> ''), f AS (SELECT stop_name, min(stop_id) AS u FROM n GROUP BY 1), p AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM fp)
SELECT stop_name, u, stop_id AS v FROM n JOIN f USING (stop_name) WHERE stop_id <> u AND (u, stop_id) NOT IN (SELECT a, b FROM p)"""
)
def same_name_pairs(t: Tables) -> DataFrame:
    return checks.same_name_pairs(t.stops, tt.forward_pairs(t.rs))


@query(cte("dw") + "SELECT line, stop_id, equal, terminal, total FROM dw WHERE equal > 0")
def equal_times_left(t: Tables) -> DataFrame:
    return checks.equal_times_left(stages.dwell_counts(t.ev, t.tr))


# --- text tables, places, regions ---------------------------------------------------


@query(f"SELECT row_number() OVER (ORDER BY row_no) AS row_no, nullif({_T('stop_id')}, '') AS stop_id, nullif({_T('stop_code')}, '') AS stop_code, stop_lat FROM stops")
def text_round_trip(t: Tables) -> DataFrame:
    """The stops written as semicolon-separated text and read again: sniffed delimiter, normalised header, text ids, numbered rows."""
    path = f"{shared_folder(t.spark)}/trellisq-text-{uuid4().hex}"
    write_table(t.stops.orderBy("row_no").select("stop_id", "stop_code", "stop_lat"), path, ["stop_id", "stop_code", "stop_lat"], ";")
    kept_until_release(t.spark, path)
    return scan(t.spark, path, "stops").select("row_no", "stop_id", "stop_code", "stop_lat")


@query(cte("cov", "xy") + "SELECT entrance, round(avg(stop_lat), 9) AS lat, round(avg(stop_lon), 9) AS lon FROM cov JOIN xy ON stop_id = platform GROUP BY 1")
def entrance_centroids(t: Tables) -> DataFrame:
    out = model.entrance_centroids(checks.coverage(t.pathways), coordinates(t.stops))
    return out.select("entrance", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query(cte("xy") + "SELECT stop_lat, stop_lon, count(*) AS stops, min(stop_id) AS first_id FROM xy GROUP BY 1, 2 HAVING count(*) > 1")
def coordinate_collisions(t: Tables) -> DataFrame:
    return model.coordinate_collisions(coordinates(t.stops))


@query(cte("xy") + "SELECT stop_id FROM xy, (SELECT median(stop_lat) AS a, median(stop_lon) AS b FROM xy) WHERE stop_lat BETWEEN a - 0.02 AND a + 0.02 AND stop_lon BETWEEN b - 0.02 AND b + 0.02")
def stops_within(t: Tables) -> DataFrame:
    xy = coordinates(t.stops)
    middle = xy.agg(F.median("stop_lat"), F.median("stop_lon")).first()
    return model.within(xy, *middle, 0.02).select("stop_id") if middle[0] is not None else xy.select("stop_id")


@query(cte("ed") + "SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed")
def undirected_pairs(t: Tables) -> DataFrame:
    return model.undirected(model.edges(t.weights))


@query(cte("ed") + "SELECT src, dst, weight FROM ed WHERE type <> 'PW'")
def edges_without_entrances(t: Tables) -> DataFrame:
    return model.edges(t.weights, ("PW",)).select("src", "dst", "weight")


@query(cte("ew") + "SELECT platform, entrance, bool_or(o) AS leads_out, bool_or(NOT o) AS leads_in FROM (SELECT src AS platform, dst AS entrance, true AS o FROM ew WHERE dst LIKE 'E.%' UNION ALL SELECT dst, src, false FROM ew WHERE src LIKE 'E.%') GROUP BY 1, 2")
def entrance_maps(t: Tables) -> DataFrame:
    cover, out, back = model.entrance_maps(model.edges(t.weights))
    flag = lambda d, c: d.withColumn(c, F.lit(True))
    both = cover.join(flag(out, "leads_out"), ["platform", "entrance"], "left").join(flag(back, "leads_in"), ["platform", "entrance"], "left")
    return both.na.fill(False)


@query(
    cte("ed", "xy", "tx")
    + """, l AS (SELECT a, b, min(line) AS line FROM tx WHERE total IS NOT NULL GROUP BY 1, 2)
SELECT src, dst, weight, type, line, p.stop_lat AS src_lat, p.stop_lon AS src_lon, q.stop_lat AS dst_lat, q.stop_lon AS dst_lon, round(log10(weight + 1), 9) AS width
FROM ed LEFT JOIN l ON a = src AND b = dst LEFT JOIN xy p ON p.stop_id = src LEFT JOIN xy q ON q.stop_id = dst"""
)
def drawing_table(t: Tables) -> DataFrame:
    lines = t.tx.where("total is not null").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.min("line").alias("line"))
    return model.drawing_table(model.edges(t.weights), lines, coordinates(t.stops)).withColumn("width", F.round("width", 9))


@query(_HUB + "SELECT id AS node, dist, dist IS NOT NULL AS final FROM (SELECT src AS id FROM ed UNION SELECT dst FROM ed) LEFT JOIN d ON node = id")
def hub_listing(t: Tables) -> DataFrame:
    """Every vertex by rising distance from the hub, those not reached last."""
    e = written(model.edges(t.weights))
    return search.distance_listing(search.search_tree(e, _hub(e).first()[0]), model.vertices(e), unreachable=True)


@query(_PLATFORM_PAIRS + "SELECT source, node AS target, dist AS optimum_weight FROM d WHERE source <> node AND node LIKE '1.%'")
def platform_pairs_straight(t: Tables) -> DataFrame:
    """The report of all pairs by A* under the straight line at the greatest speed."""
    e, xy = written(model.edges(t.weights)), coordinates(t.stops)
    fastest = model.max_speed(e, xy).first()[0] or 0.0
    ids = model.vertices(e).where("id like '1.%'")
    places = xy.join(model.vertices(e), F.col("stop_id") == F.col("id"), "left_semi").select("stop_id", "stop_lat", "stop_lon").limit(search.MAX_BROADCAST_EDGES).collect()  # vertices of a graph that is sent to tasks
    h = search.straight_line({r.stop_id: (r.stop_lat, r.stop_lon) for r in places}, fastest)
    return search.a_star_all(e, ids, h, reached=True).where("optimum_weight is not null").select("source", "target", "optimum_weight")


def _regions(t: Tables, e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(branches, bridges, platforms): the stops that only one of the first two lines has, each line's first stop of others as its bridge."""
    first = t.order.where("line_ord < 2").select("line")
    own = t.rs.groupBy("stop_id").agg(F.count(F.lit(1)).alias("lines"), F.min("line").alias("branch"), F.min("pos").alias("pos")).where("lines = 1")
    platforms = model.vertices(e.where("type = 'SW'")).select(F.col("id").alias("stop_id"))
    branches = own.join(first, F.col("branch") == F.col("line"), "left_semi").join(platforms, "stop_id", "left_semi").select("branch", "pos", "stop_id")
    bridges = t.rs.join(first, "line", "left_semi").join(branches.select("stop_id"), "stop_id", "left_anti").groupBy(F.col("line").alias("branch")).agg(F.min("stop_id").alias("bridge"))
    return branches, bridges, platforms


_REGIONS = (
    cte("ed", "sw", "rs", "gr")
    + f""", lo2 AS (SELECT line, row_number() OVER (ORDER BY {_dotted('line')}, line) AS k FROM (SELECT DISTINCT line FROM gr)), first2 AS (SELECT line FROM lo2 WHERE k <= 2),
plat AS (SELECT src AS stop_id FROM sw UNION SELECT dst FROM sw),
br AS (SELECT stop_id, min(line) AS branch FROM rs GROUP BY 1 HAVING count(*) = 1 AND min(line) IN (SELECT line FROM first2) AND stop_id IN (SELECT stop_id FROM plat)),
bg AS (SELECT line AS branch, min(stop_id) AS bridge FROM rs WHERE line IN (SELECT line FROM first2) AND stop_id NOT IN (SELECT stop_id FROM br) GROUP BY 1),
pc AS (SELECT x.stop_id AS source, y.stop_id AS target, CASE WHEN p.branch IS NULL AND q.branch IS NULL THEN 'CC' WHEN p.branch IS NULL THEN 'CB' WHEN q.branch IS NULL THEN 'BC' WHEN p.branch = q.branch THEN 'SB' ELSE 'DB' END AS case_, p.branch AS pb, q.branch AS qb
  FROM plat x JOIN plat y ON x.stop_id <> y.stop_id LEFT JOIN br p ON p.stop_id = x.stop_id LEFT JOIN br q ON q.stop_id = y.stop_id)
"""
)


def _report(t: Tables) -> tuple[DataFrame, tuple[DataFrame, DataFrame, DataFrame]]:
    e = written(model.edges(t.weights))
    regions = _regions(t, e)
    return search.all_pairs(e.where("type = 'SW'"), regions[2].select(F.col("stop_id").alias("id"))), regions


@query(_REGIONS + "SELECT coalesce(case_, 'GLOBAL') AS case_, count(*) AS n, round_even(count(*) * 100.0 / (SELECT count(*) FROM pc), 4) AS pct FROM pc GROUP BY ROLLUP (case_)")
def region_cases(t: Tables) -> DataFrame:
    """The report of all pairs by the regions of its ends."""
    found, (branches, _, platforms) = _report(t)
    return report.by_case(found, branches, platforms, "dijkstra").select("case_", "n", "pct")


@query(_REGIONS + "SELECT source, target, bridge FROM pc JOIN bg ON branch = pb WHERE case_ IN ('BC', 'SB', 'DB') UNION SELECT source, target, bridge FROM pc JOIN bg ON branch = qb WHERE case_ IN ('CB', 'SB', 'DB')")
def bridge_highlights(t: Tables) -> DataFrame:
    found, (branches, bridges, platforms) = _report(t)
    return model.bridge_highlights(model.classify(found.select("source", "target"), branches, platforms), branches, bridges)


@query(
    cte("rs", "sw")
    + """, ch AS (SELECT line AS branch, stop_id, pos, lag(stop_id) OVER (PARTITION BY line ORDER BY pos) AS inner_ FROM rs)
SELECT branch, ch.stop_id, sum(o.weight) OVER w AS depth_from, sum(i.weight) OVER w AS depth_to FROM ch LEFT JOIN sw o ON o.src = inner_ AND o.dst = ch.stop_id LEFT JOIN sw i ON i.src = ch.stop_id AND i.dst = inner_ WHERE pos > 1 WINDOW w AS (PARTITION BY branch ORDER BY pos)"""
)
def line_depths(t: Tables) -> DataFrame:
    """Each line as a branch of its first stop: seconds from there to every stop and back."""
    chain = t.rs.where("pos > 1").select(F.col("line").alias("branch"), (-F.col("pos")).alias("pos"), "stop_id")
    bridges = t.rs.where("pos = 1").select(F.col("line").alias("branch"), F.col("stop_id").alias("bridge"))
    return model.branch_depths(model.edges(t.weights).where("type = 'SW'"), chain, bridges)


@query(cte("cv") + "SELECT line, direction, a, b, coalesce(printf('%.5f', round(cv, 9)), 'NA') AS proportion, coalesce(CAST(n AS VARCHAR), 'NA') AS n, 'NA' AS path FROM cv")
def report_rows(t: Tables) -> DataFrame:
    """Figures as report text: five decimals, NA for what is missing."""
    cv = stats.cv_ranking(stats.pair_stats(t.tx)).select("line", "direction", "a", "b", F.round("cv", 9).alias("proportion"), "n", F.lit(None).cast("array<string>").alias("path"))
    return report_text(cv).withColumn("direction", F.col("direction").cast("int"))


@query(f"SELECT row_no, CASE WHEN abs(s) >= 3600 THEN printf('%s%d:%02d:%02d', m, abs(s) // 3600, abs(s) % 3600 // 60, abs(s) % 60) WHEN s IS NOT NULL THEN printf('%s%d:%02d', m, abs(s) // 60, abs(s) % 60) END AS text FROM (SELECT row_no, s, CASE WHEN s < 0 THEN '-' ELSE '' END AS m FROM (SELECT row_no, {_SECONDS('arrival_time')} AS s FROM stop_times))")
def short_times(t: Tables) -> DataFrame:
    return t.stop_times.select("row_no", exprs.format_short(exprs.parse_time("arrival_time")).alias("text"))


# --- scalar functions ---------------------------------------------------------------


@query(f"SELECT row_no, {_SECONDS('arrival_time')} AS seconds, CASE WHEN {_SECONDS('arrival_time')} IS NOT NULL THEN {_CLOCK(_SECONDS('arrival_time'))} END AS text FROM stop_times")
def time_round_trip(t: Tables) -> DataFrame:
    s = exprs.parse_time("arrival_time")
    return t.stop_times.select("row_no", s.alias("seconds"), exprs.format_time(s).alias("text"))


@query("SELECT event_type AS a, next_type AS b, count(*) AS n, CAST((2 * sum(s) + count(*)) // (2 * count(*)) AS BIGINT) AS weight_seconds FROM (SELECT event_type, lead(event_type) OVER w AS next_type, (epoch_us(lead(ts) OVER w) - epoch_us(ts)) // 1000000 AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE next_type IS NOT NULL GROUP BY 1, 2")
def event_transitions(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.select(F.col("event_type").alias("a"), F.lead("event_type").over(w).alias("b"), (F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))).alias("us"))
    return rows.where("b is not null").select("a", "b", exprs.int_div(F.col("us"), 1000000).alias("s")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), exprs.half_up_mean("s").alias("weight_seconds"))
