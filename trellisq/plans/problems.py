"""Queries and oracle SQL of the general data problems (1, 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.operators.references import TIMETABLE, orphan_counts, orphans
from trellisq.operators.spikes import anomalies, spikes
from trellisq.sources.malformed import FEEDS, load_feed, rejected
from trellisq.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected(table(spark, d, "raw_feed")).select("line_id")


def p1_stop_times(spark: SparkSession, d: str) -> DataFrame:
    return load_feed(table(spark, d, "raw_feed"), "stop_times.txt")


def p1_pathways(spark: SparkSession, d: str) -> DataFrame:
    return load_feed(table(spark, d, "raw_feed"), "pathways.txt")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return rejected(table(spark, d, "raw_feed")).groupBy("feed_name", "reason").agg(F.count(F.lit(1)).alias("n"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return spikes(table(spark, d, "stop_times"), table(spark, d, "pathways"))


def p3_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return anomalies(table(spark, d, "stop_times"), table(spark, d, "pathways"))


def _timetable(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {t: table(spark, d, t) for t in ("stop_times", "pathways", "trips", "stops", "routes")}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(_timetable(spark, d)).select("table_name", "field_name", "row_no")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(orphans(_timetable(spark, d)))


QUERIES = {f.__name__: f for f in (p1_found, p1_stop_times, p1_pathways, p1_reasons, p3_found, p3_anomalies, p5_found, p5_counts)}

_FIELD = r'(?:"(?:[^"]|"")*"|[^",\r\n]*)'
_NUMBER = r'(?:"[ \t]*[0-9]+[ \t]*"|[ \t]*[0-9]+[ \t]*)'
_EMPTY = r'(?:"[ \t]*"|[ \t]*)'
_STOP_TIMES = rf"{_FIELD},{_NUMBER},{_FIELD},{_FIELD},{_FIELD}\r?"
_PATHWAYS = rf"(?:{_FIELD},){{5}}(?:{_NUMBER}|{_EMPTY}),{_FIELD}\r?"


def _get(n: int) -> str:
    """SQL for field n (from 0) of a valid record."""
    raw = rf"regexp_extract(raw_line, '^(?:{_FIELD},){{{n}}}({_FIELD})', 1)"
    return f"(CASE WHEN {raw} LIKE '\"%' THEN replace(substr({raw}, 2, length({raw}) - 2), '\"\"', '\"') ELSE {raw} END)"


def _num(n: int) -> str:
    return rf"TRY_CAST(nullif(trim({_get(n)}, chr(32) || chr(9)), '') AS HUGEINT)"


_VALID = f"""
valid AS (
  SELECT *, feed_name = 'stop_times.txt' AND regexp_full_match(raw_line, '{_STOP_TIMES}') AND {_num(1)} <= 2147483647
         OR feed_name = 'pathways.txt' AND regexp_full_match(raw_line, '{_PATHWAYS}') AND coalesce({_num(5)}, 0) <= 2147483647 AS ok
  FROM raw_feed)"""


# fields as the strict reader takes them: a quote inside an unquoted field is text there
_LOOSE = r'(?:"(?:[^"]|"")*"|[^",\r\n][^,\r\n]*|)'
_COUNTED = lambda n: rf"(?:{_FIELD},){{{n}}}{_FIELD}"


def _why(width: int, number: int, required: bool) -> str:
    """SQL for the reason of an invalid record x of one feed."""
    text = f"trim({_get(number).replace('raw_line', 'x')}, chr(32) || chr(9))"
    return rf"""CASE
      WHEN regexp_full_match(x, '(?:{_LOOSE},)*"(?:[^"]|"")*') THEN 'unclosed_quote'
      WHEN regexp_matches(x, '^(?:{_LOOSE},)*"(?:[^"]|"")*"[^",
]') THEN 'text_after_quote'
      WHEN regexp_matches(x, '^(?:{_LOOSE},)*{_LOOSE}[
]+') THEN 'bare_line_break'
      WHEN NOT regexp_full_match(x, '(?:{_FIELD},)*{_FIELD}') THEN 'stray_quote'
      WHEN NOT regexp_full_match(x, '{_COUNTED(width - 1)}') THEN CASE WHEN regexp_full_match(x, '{_COUNTED(width)}(?:,{_FIELD})*') THEN 'too_many_fields' ELSE 'too_few_fields' END
      WHEN {text} = '' THEN {"'empty_number'" if required else "NULL"}
      WHEN NOT regexp_full_match({text}, '[0-9]+') THEN 'not_a_number'
      ELSE 'number_too_large' END"""


def _reasons() -> str:
    rows = [(feed, _why(len(f.columns), f.columns.index(f.number), f.required)) for feed, f in FEEDS.items()]
    cases = " ".join(f"WHEN feed_name = '{feed}' THEN {why}" for feed, why in rows)
    return f"""WITH {_VALID}, bad AS (SELECT feed_name, regexp_replace(raw_line, '\r$', '') AS x FROM valid WHERE NOT coalesce(ok, false))
SELECT feed_name, reason, count(*) AS n FROM (SELECT feed_name, CASE WHEN feed_name IS NULL OR feed_name NOT IN ({', '.join(f"'{f}'" for f in FEEDS)}) THEN 'unknown_feed' WHEN x IS NULL THEN 'null_line' {cases} END AS reason FROM bad) GROUP BY ALL"""


def _loaded(feed: str) -> str:
    cols = FEEDS[feed].columns
    number = FEEDS[feed].number
    return f"WITH {_VALID} SELECT line_id, feed_date, " + ", ".join(f"CAST({_num(i)} AS INTEGER) AS {c}" if c == number else f"{_get(i)} AS {c}" for i, c in enumerate(cols)) + f" FROM valid WHERE coalesce(ok, false) AND feed_name = '{feed}'"


_SECONDS = lambda c: f"""(CASE WHEN regexp_full_match(trim({c}), '-?[0-9]+:[0-9]{{2}}:[0-9]{{2}}') THEN
  (CASE WHEN trim({c}) LIKE '-%' THEN -1 ELSE 1 END) * TRY_CAST(TRY_CAST(split_part(ltrim(trim({c}), '-'), ':', 1) AS BIGINT)::HUGEINT * 3600
   + CAST(split_part(trim({c}), ':', 2) AS INT) * 60 + CAST(split_part(trim({c}), ':', 3) AS INT) AS INT) END)"""  # noqa: E731
_NEAR = lambda a, b: f"((({b}) - ({a}) + 43200) % 86400 + 86400) % 86400 - 43200"

_P3 = f"""
WITH st AS (
  SELECT trim(trip_id) AS trip, stop_sequence AS seq, trim(stop_id) AS stop, {_SECONDS('arrival_time')} AS arr, {_SECONDS('departure_time')} AS dep, row_no
  FROM stop_times WHERE trim(trip_id) <> '' AND trim(stop_id) <> '' AND stop_sequence IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY trim(trip_id), stop_sequence ORDER BY row_no) = 1),
linked AS (
  SELECT b.row_no, b.stop, a.stop AS stop0, {_NEAR('b.arr', 'b.dep')} AS dwell, {_NEAR('a.dep', 'b.arr')} AS run
  FROM st b LEFT JOIN st a ON a.trip = b.trip AND a.seq = b.seq - 1),
pw AS (
  SELECT pathway_id, traversal_time, row_no FROM pathways WHERE trim(pathway_id) <> ''
  QUALIFY row_number() OVER (PARTITION BY pathway_id, published_on ORDER BY row_no) = 1),
readings AS (
  SELECT 'stop_times' AS table_name, row_no, 'd' || stop AS source, dwell AS value FROM linked WHERE dwell IS NOT NULL
  UNION ALL SELECT 'stop_times', row_no, 'r' || stop0 || '>' || stop, run FROM linked WHERE run IS NOT NULL
  UNION ALL SELECT 'pathways', row_no, 't' || pathway_id, traversal_time FROM pw WHERE traversal_time IS NOT NULL),
stats AS (
  SELECT source, quantile_cont(value, 0.5) AS med, quantile_cont(value, 0.9) - quantile_cont(value, 0.1) AS span
  FROM readings GROUP BY source HAVING count(*) >= 12),
still AS (SELECT trip, seq, row_no, arr, seq - row_number() OVER (PARTITION BY trip, arr ORDER BY seq) AS island FROM st WHERE arr = dep)
SELECT 'stop_times' AS table_name, row_no FROM linked WHERE dwell < 0 OR run <= 0
UNION SELECT 'pathways', row_no FROM pw WHERE traversal_time <= 0
UNION SELECT table_name, row_no FROM readings JOIN stats USING (source) WHERE abs(value - med) > 20 AND abs(value - med) > 3 * span
UNION SELECT 'stop_times', row_no FROM (SELECT row_no, count(*) OVER (PARTITION BY trip, arr, island) AS n FROM still) WHERE n >= 4"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(13)"


def _orphan_sql(r, cols: str) -> str:
    return f"""
SELECT '{r.child}' AS table_name, '{r.field}' AS field_name, {cols} FROM {r.child} c
WHERE trim(c.{r.field}, {_BLANKS}) <> '' AND NOT EXISTS (
  SELECT 1 FROM {r.parent} p WHERE trim(p.{r.key}, {_BLANKS}) = trim(c.{r.field}, {_BLANKS})
  AND p.loaded_at <= c.loaded_at AND (p.deleted_at IS NULL OR p.deleted_at > c.loaded_at))"""


def _known(r, more: str) -> str:
    return f"EXISTS (SELECT 1 FROM {r.parent} p WHERE trim(p.{r.key}, {_BLANKS}) = trim(c.{r.field}, {_BLANKS}) AND (p.deleted_at IS NULL OR p.deleted_at > p.loaded_at) {more})"


def _reason(r) -> str:
    return f"CASE WHEN NOT {_known(r, '')} THEN 'missing' WHEN {_known(r, 'AND p.loaded_at <= c.loaded_at')} THEN 'withdrawn' ELSE 'later' END AS reason"


ORACLE = {
    "p1_found": f"WITH {_VALID} SELECT line_id FROM valid WHERE NOT coalesce(ok, false)",
    "p1_stop_times": _loaded("stop_times.txt"),
    "p1_pathways": _loaded("pathways.txt"),
    "p1_reasons": _reasons(),
    "p3_found": _P3,
    "p5_found": " UNION ALL ".join(_orphan_sql(r, "c.row_no") for r in TIMETABLE),
    "p5_counts": "SELECT table_name, field_name, period, count(*) AS n, "
    + ", ".join(f"count(*) FILTER (reason = '{x}') AS n_{x}" for x in ("missing", "withdrawn", "later"))
    + " FROM ("
    + " UNION ALL ".join(_orphan_sql(r, f"strftime(c.{r.period}, '%Y-%m') AS period, {_reason(r)}") for r in TIMETABLE)
    + ") GROUP BY ALL",
}
