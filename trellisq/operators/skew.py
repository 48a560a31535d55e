"""Joins of rows with per-key results where one key may hold a third of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisq.functions.exprs import int_div

#: Rows of one key that may meet in one task.
ROWS_PER_TASK = 1_000_000
#: Hot keys that may be broadcast at a time.
MOST_HOT = 100_000


def hot_keys(keyed: DataFrame, keys: Sequence[str], n: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame | None:
    """<keys>, parts: the keys with more than ``rows_per_task`` rows and in how many parts they go; None without any.

    ``keyed`` has one row per key and in ``n`` how many rows have it.  There are at most
    total/rows_per_task such keys; the size is raised until MOST_HOT or fewer are left, so
    the table may be broadcast.
    """
    while True:
        hot = keyed.where(F.col(n) > rows_per_task)
        found = hot.limit(MOST_HOT + 1).count()
        if found <= MOST_HOT:
            break
        rows_per_task *= 4
    if not found:
        return None
    return hot.select(*keys, (int_div(F.col(n) - 1, rows_per_task) + 1).cast("int").alias("parts"))


def spread_join(rows: DataFrame, keyed: DataFrame, keys: Sequence[str], n: str, by: Column, how: str = "inner", rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``rows`` joined with ``keyed`` (one row per key, ``n`` rows each): hot keys in as many parts as they need.

    ``by`` (a LONG of the rows) tells the parts apart.  Only keys counted as hot are
    repeated, once per part; the joined rows have the part as ``_part``, 0 for all others,
    so that an aggregate may go by key and part first.  ``keyed`` is read twice: it
    should be a written table.
    """
    keys = list(keys)
    hot = hot_keys(keyed, keys, n, rows_per_task)
    if hot is None:
        return rows.join(keyed.drop(n), keys, how).withColumn("_part", F.lit(0))
    parts = F.broadcast(hot)
    left = rows.join(parts, keys, "left").withColumn("_part", F.coalesce(F.pmod(by, F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    right = keyed.drop(n).join(parts, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return left.join(right, [*keys, "_part"], how)


def screened(rows: DataFrame, wanted: DataFrame, keys: list[str], bits: int = 23) -> DataFrame:
    """The rows whose keys may be among the wanted ones: all that are, and few others.

    A table of 2^bits bits is set at the hashes of the wanted keys and broadcast: at most
    2^(bits-6) rows of two numbers, whatever the size of either side.  It only spares
    shuffling; the join after it decides.
    """
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << bits))
    word, bit = F.shiftright(place, 6).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    table = wanted.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("set"))
    return rows.withColumn("word", word).join(F.broadcast(table), "word").where(F.col("set").bitwiseAND(bit) != 0).drop("word", "set")
