"""Problem 5: references to records that do not exist, were withdrawn or came later.

Parent and child keys are brought into one long form, tagged by side, and grouped by
parent table and key.  Before the shuffle each side is reduced per key: children to the
range of their load times and a count, parents to their validity spans.  Groups without
a parent flag are orphans as a whole; groups whose spans cover the children's whole
range are sound as a whole; only the keys in between are looked at row by row.

A key that holds a third of all rows therefore crosses the first shuffle as one row per
map task.  In the second pass over the rows a bit table of fixed size drops those of other
keys before the join, and keys that very many rows have are joined in parts.  A parent with
very many versions is reduced to its separate times of validity before these are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisq.operators.skew import screened, spread_join
from trellisq.session import written

FAR = "9999-12-31 00:00:00"


@dataclass(frozen=True)
class Reference:
    """A field of a child table that names the key of a parent table."""

    child: str
    field: str
    parent: str
    key: str
    period: str


TIMETABLE = (
    Reference("stop_times", "stop_id", "stops", "stop_id", "service_date"),
    Reference("stop_times", "trip_id", "trips", "trip_id", "service_date"),
    Reference("pathways", "from_stop_id", "stops", "stop_id", "published_on"),
    Reference("trips", "route_id", "routes", "route_id", "service_date"),
)


def bare(c: str | Column) -> Column:
    """An id without outer blanks (spaces, tabs, line breaks); null when nothing is left."""
    return F.nullif(F.btrim(c, F.lit(" \t\r\n\u00a0")), F.lit(""))


def children(tables: dict[str, DataFrame], refs: Sequence[Reference]) -> DataFrame:
    """Long form of the referring rows: parent, key, table_name, field_name, row_no, period, loaded_at."""
    parts = [
        tables[r.child].select(
            F.lit(r.parent).alias("parent"),
            bare(r.field).alias("key"),
            F.lit(r.child).alias("table_name"),
            F.lit(r.field).alias("field_name"),
            F.col("row_no").cast("long").alias("row_no"),
            F.date_format(r.period, "yyyy-MM").alias("period"),
            F.col("loaded_at"),
        )
        for r in refs
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("key").isNotNull())


def parents(tables: dict[str, DataFrame], refs: Sequence[Reference]) -> DataFrame:
    """Validity spans of the parent keys: parent, key, since, until, disjoint per key.

    ``until`` is far away for rows that were never withdrawn.  Rows that never were valid
    for anyone (a null load time, or withdrawn before they were loaded) are left out.
    Versions are combined per load time before the shuffle, then spans that touch are
    joined, so a key has as many spans as it had separate times of validity.
    """
    out = None
    for name, key in dict.fromkeys((r.parent, r.key) for r in refs):
        p = tables[name].select(
            F.lit(name).alias("parent"),
            bare(key).alias("key"),
            F.col("loaded_at").alias("since"),
            F.coalesce(F.col("deleted_at"), F.to_timestamp(F.lit(FAR)).cast("timestamp_ntz").cast(tables[name].schema["deleted_at"].dataType)).alias("until"),
        )
        out = p if out is None else out.unionByName(p)
    versions = out.where(F.col("key").isNotNull() & (F.col("since") < F.col("until"))).groupBy("parent", "key", "since").agg(F.max("until").alias("until"))
    w = Window.partitionBy("parent", "key").orderBy("since")
    before = F.max("until").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = versions.withColumn("new", F.coalesce(F.col("since") > before, F.lit(True)).cast("long")).withColumn("island", F.sum("new").over(w))
    return islands.groupBy("parent", "key", "island").agg(F.min("since").alias("since"), F.max("until").alias("until")).drop("island")


def orphans(tables: dict[str, DataFrame], refs: Sequence[Reference] = TIMETABLE) -> DataFrame:
    """table_name, field_name, row_no, period, reason of every reference without a valid parent.

    A reference counts when it is neither null nor blank.  ``reason`` is ``missing`` (no
    parent row has the id), ``later`` (the first parent row was loaded after the
    reference) or ``withdrawn``.  A null load time of the referring row meets no parent.
    Empty tables give no rows; repeated rows are reported each.
    """
    kids = children(tables, refs)
    keys = ["parent", "key"]
    child_side = kids.groupBy(keys).agg(
        F.min("loaded_at").alias("first"),
        F.max("loaded_at").alias("last"),
        F.max(F.col("loaded_at").isNull()).alias("unknown"),
        F.count(F.lit(1)).alias("uses"),
    )
    spans = parents(tables, refs)
    parent_side = spans.groupBy(keys).agg(F.collect_list(F.struct("since", "until")).alias("spans"))
    tagged = child_side.select(*keys, "first", "last", "unknown", "uses", F.lit(None).cast(parent_side.schema["spans"].dataType).alias("spans")).unionByName(
        parent_side.select(
            *keys,
            F.lit(None).cast(child_side.schema["first"].dataType).alias("first"),
            F.lit(None).cast(child_side.schema["last"].dataType).alias("last"),
            F.lit(None).cast("boolean").alias("unknown"),
            F.lit(None).cast("long").alias("uses"),
            "spans",
        )
    )
    groups = tagged.groupBy(keys).agg(
        F.max("first").alias("first"),
        F.max("last").alias("last"),
        F.max("unknown").alias("unknown"),
        F.max("uses").alias("uses"),
        F.first("spans", ignorenulls=True).alias("spans"),
    )
    covered = F.exists("spans", lambda s: (s["since"] <= F.col("first")) & (F.col("last") < s["until"]))
    suspects = written(groups.where(F.col("unknown").isNotNull() & (F.col("unknown") | ~F.coalesce(covered, F.lit(False)))).select(*keys, "spans", "uses"))
    rows = screened(kids, suspects, keys)
    valid = F.exists("spans", lambda s: (s["since"] <= F.col("loaded_at")) & (F.col("loaded_at") < s["until"]))
    return (
        spread_join(rows, suspects, keys, "uses", F.col("row_no"))
        .where(~F.coalesce(valid, F.lit(False)))
        .select(
            "table_name",
            "field_name",
            "row_no",
            "period",
            F.when(F.col("spans").isNull(), "missing")
            .when(F.coalesce(F.exists("spans", lambda s: s["since"] <= F.col("loaded_at")), F.lit(False)), "withdrawn")
            .otherwise("later")
            .alias("reason"),
        )
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """Counts of orphan references per table, field and period, with the reasons apart."""
    return found.groupBy("table_name", "field_name", "period").agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("missing", "withdrawn", "later")),
    )
