"""Reports over searches: ordering, means, regions, comparisons and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisq.graph.model import classify
from trellisq.operators.checks import weight_mismatches


def report_order() -> list[Column]:
    """Rising proportion, pairs without a path last, then by pair."""
    return [F.col("proportion").asc_nulls_last(), F.col("source"), F.col("target")]


def report_means(report: DataFrame) -> DataFrame:
    """N, proportion_mean, proportion_median over the pairs with a path."""
    return report.agg(F.count(F.lit(1)).alias("n"), F.avg("proportion").alias("proportion_mean"), F.median("proportion").alias("proportion_median"))


def by_case(report: DataFrame, branches: DataFrame, platforms: DataFrame, name: str) -> DataFrame:
    """case_ (and GLOBAL), n, pct, <name>_mean, <name>_median, rounded to four decimals."""
    held = classify(report, branches, platforms)
    rolled = held.rollup("case_").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.avg("proportion").alias("m"), F.median("proportion").alias("d"))
    total = report.agg(F.count(F.lit(1)).alias("total"))
    return rolled.crossJoin(total).select(  # one row on the right
        F.when(F.col("g") == 1, "GLOBAL").otherwise(F.col("case_")).alias("case_"),
        "n",
        F.bround(F.try_divide(F.col("n") * 100.0, F.col("total")), 4).alias("pct"),
        F.bround("m", 4).alias(f"{name}_mean"),
        F.bround("d", 4).alias(f"{name}_median"),
    )


def comparison(reports: dict[str, DataFrame], branches: DataFrame, platforms: DataFrame) -> DataFrame:
    """D22j: the case summaries of several reports side by side."""
    parts = [by_case(r, branches, platforms, n) for n, r in reports.items()]
    return reduce(lambda a, b: a.join(b.drop("n", "pct"), "case_", "full"), parts)


def optimum_gate(reports: dict[str, DataFrame]) -> None:
    """Raise where reports disagree on an optimum weight or on reachability."""
    bad = weight_mismatches({n: r.select("source", "target", F.col("optimum_weight").alias("weight")) for n, r in reports.items()})
    n = bad.count()
    if n:
        raise AssertionError(f"{n} pairs differ between {', '.join(reports)}")


def settle_bounds(distances: DataFrame) -> DataFrame:
    """source, target, low, high: between how many extractions a cut search settles its target, whatever the order of ties.

    ``distances`` has source, node, dist of every reached node, the source included.
    """
    per = distances.groupBy("source", "dist").agg(F.count(F.lit(1)).alias("n"))


    w = Window.partitionBy("source").orderBy("dist").rowsBetween(Window.unboundedPreceding, 0)
    run = per.withColumn("high", F.sum("n").over(w)).withColumn("low", F.col("high") - F.col("n") + 1)
    return distances.where("source <> node").join(run.select("source", "dist", "low", "high"), ["source", "dist"]).select("source", F.col("node").alias("target"), "low", "high")
