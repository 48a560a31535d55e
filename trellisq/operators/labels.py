"""Labels of stops and entrances for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_NAME = "(no name)"


def _joined(items: str, sep: str) -> Column:
    """The texts of an array of (order, text), in order."""
    return F.array_join(F.transform(F.array_sort(items), lambda x: x["text"]), sep)


def stop_labels(names: DataFrame, route_stops: DataFrame, order: DataFrame) -> DataFrame:
    """I16: stop_id, label: the lines of the stop in their order, then its name, joined by hyphens; the name alone without a line."""
    lines = route_stops.select("stop_id", "line").distinct().join(order, "line")
    per = lines.groupBy("stop_id").agg(F.collect_list(F.struct(F.col("line_ord").alias("at"), F.col("line").alias("text"))).alias("lines"))  # the lines of one stop
    named = names.select("stop_id", F.coalesce("stop_name", F.lit(NO_NAME)).alias("name")).join(per, "stop_id", "left")
    return named.select("stop_id", F.concat_ws("-", F.when(F.col("lines").isNotNull(), _joined("lines", "-")), "name").alias("label"))


def entrance_labels(names: DataFrame, cover: DataFrame, route_stops: DataFrame, order: DataFrame) -> DataFrame:
    """stop_id, label of every entrance with a platform: its name, " -- ", and its platforms by name, joined by " / ".

    A name with one platform is labelled as the platform is (I16); the lines of several
    platforms of one name are merged in order of their first mention, by slashes.
    ``cover`` has platform, entrance.
    """
    held = names.select("stop_id", F.coalesce("stop_name", F.lit(NO_NAME)).alias("name"))
    served = cover.select("platform", "entrance").distinct().join(held.withColumnRenamed("stop_id", "platform"), "platform", "left").withColumn("name", F.coalesce("name", F.lit(NO_NAME)))
    sizes = served.groupBy("entrance", "name").agg(F.count(F.lit(1)).alias("platforms"), F.min("platform").alias("first"))
    lines = route_stops.select(F.col("stop_id").alias("platform"), "line").distinct().join(order, "line")
    mention = served.join(lines, "platform").groupBy("entrance", "name", "line").agg(F.min(F.struct("platform", "line_ord")).alias("at"))
    per = mention.groupBy("entrance", "name").agg(F.collect_list(F.struct("at", F.col("line").alias("text"))).alias("lines"))  # the lines of one entrance
    sep = F.when(F.col("platforms") > 1, _joined("lines", "/")).otherwise(_joined("lines", "-"))
    label = F.concat_ws("-", F.when(F.col("lines").isNotNull(), sep), "name")
    named = sizes.join(per, ["entrance", "name"], "left").select("entrance", F.struct(F.col("first").alias("at"), label.alias("text")).alias("part"))
    whole = named.groupBy("entrance").agg(F.collect_list("part").alias("parts"))  # the names of one entrance
    return whole.join(held.withColumnRenamed("stop_id", "entrance"), "entrance", "left").select(
        F.col("entrance").alias("stop_id"), F.concat(F.coalesce("name", F.lit(NO_NAME)), F.lit(" -- "), _joined("parts", " / ")).alias("label")
    )


def node_labels(names: DataFrame, cover: DataFrame, route_stops: DataFrame, order: DataFrame) -> DataFrame:
    """stop_id, label, padded: of every stop, entrances by their platforms; ``padded`` in brackets, all of one width."""
    by_platform = entrance_labels(names, cover, route_stops, order)
    rest = stop_labels(names, route_stops, order).join(by_platform.select("stop_id"), "stop_id", "left_anti")
    both = rest.unionByName(by_platform)
    width = both.agg(F.max(F.length("label")).alias("width"))
    return both.crossJoin(F.broadcast(width)).select("stop_id", "label", F.concat(F.lit(" ("), F.rpad("label", F.col("width"), F.lit(" ")), F.lit(")")).alias("padded"))  # one row on the right
