"""Queries and oracle SQL of the text and digest problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.llm.bpe import encode
from trellisq.llm.digest import QUANTILES, stop_percentiles
from trellisq.llm.mojibake import garbled_names
from trellisq.llm.splitting import split
from trellisq.llm.tiling import leaks
from trellisq.sources.tables import table


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return stop_percentiles(table(spark, d, "stop_times"))


def p2_checked(spark: SparkSession, d: str) -> DataFrame:
    """Every row of p2_percentiles: its count, its percentiles where the group is small enough to be exact, and whether its error is in bounds."""
    exact = F.col("n") <= EXACT
    return p2_percentiles(spark, d).select(
        "stop_id", "service_date", "metric", "n", *(F.when(exact, F.col(c)).alias(c) for c in _PERCENTILES), ((F.col("rank_error") <= F.greatest(F.lit(BOUND), 1 / F.col("n"))) & (~exact | (F.col("rank_error") == 0))).alias("bounded")
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_names(spark, d).select("table_name", "row_no")


def p4_names(spark: SparkSession, d: str) -> DataFrame:
    return garbled_names({t: table(spark, d, t) for t in ("stops", "pathways")})


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("stretch").select("item_id", "doc_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split(table(spark, d, "documents"))


#: Groups of up to so many values have a centroid for each; the rank error of larger ones stays within BOUND or one rank.
EXACT, BOUND = 100, 0.005
_PERCENTILES = [f"p{int(q * 100)}" for q in QUANTILES]

QUERIES = {f.__name__: f for f in (p2_percentiles, p2_checked, p4_found, p4_names, p6_ids, p7_found, p7_report, p8_pieces)}

_SECONDS = lambda c: f"(CASE WHEN {c} LIKE '-%' THEN -1 ELSE 1 END * (CAST(split_part(ltrim({c}, '-'), ':', 1) AS INT) * 3600 + CAST(split_part({c}, ':', 2) AS INT) * 60 + CAST(split_part({c}, ':', 3) AS INT)))"
_AT = lambda q: f"s[CAST(greatest(ceil({q} * n - 1e-9), 1) AS INT)]"

ORACLE: dict[str, str] = {
    "p2_checked": f"""
WITH t AS (SELECT trim(stop_id) AS stop_id, service_date, {_SECONDS('arrival_time')} AS a, {_SECONDS('departure_time')} AS d FROM stop_times WHERE trim(stop_id) <> ''),
v AS (SELECT stop_id, service_date, 'dwell' AS metric, ((d - a + 43200) % 86400 + 86400) % 86400 - 43200 AS x FROM t WHERE a IS NOT NULL AND d IS NOT NULL
  UNION ALL SELECT stop_id, service_date, 'time_of_day', (a % 86400 + 86400) % 86400 FROM t WHERE a IS NOT NULL),
g AS (SELECT stop_id, service_date, metric, count(*) AS n, list(x ORDER BY x) AS s FROM v WHERE service_date IS NOT NULL GROUP BY ALL
  UNION ALL SELECT stop_id, NULL, metric, count(*), list(x ORDER BY x) FROM v GROUP BY stop_id, metric)
SELECT stop_id, service_date, metric, n, {', '.join(f"CASE WHEN n <= {EXACT} THEN CAST({_AT(q)} AS DOUBLE) END AS {c}" for q, c in zip(QUANTILES, _PERCENTILES))}, true AS bounded FROM g""",
}
