"""Text sources and sinks of timetable tables.

Ids are text and are never inferred: ``1.9140`` and ``1.914`` are different stops.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellisq.session import written

DELIMITERS = (",", ";", "\t")

#: Columns of the timetable tables; everything is read as text, then cast where the type is not text.
TABLES: dict[str, dict[str, str]] = {
    "routes": {"route_id": "string", "route_short_name": "string", "route_long_name": "string", "route_type": "int", "route_url": "string", "route_color": "string", "route_text_color": "string"},
    "stops": {"stop_id": "string", "stop_code": "string", "stop_name": "string", "stop_lat": "double", "stop_lon": "double"},
    "trips": {"route_id": "string", "trip_id": "string", "direction_id": "int", "trip_headsign": "string"},
    "stop_times": {"trip_id": "string", "stop_sequence": "int", "stop_id": "string", "arrival_time": "string", "departure_time": "string"},
    "pathways": {"pathway_id": "string", "from_stop_id": "string", "to_stop_id": "string", "pathway_mode": "int", "is_bidirectional": "int", "traversal_time": "int", "signposted_as": "string"},
    "transfers": {"from_stop_id": "string", "to_stop_id": "string", "transfer_type": "int", "min_transfer_time": "int"},
    "wrong_stop_sequences": {"trip_id": "string", "stop_a": "string", "stop_b": "string", "seq_a": "int", "seq_b": "int"},
    "doors": {"stop_id": "string", "line": "string", "door_seconds": "int"},
    "equivalences": {"original_stop_id": "string", "line": "string", "new_stop_id": "string"},
    "subway_weights": {"from_stop_id": "string", "to_stop_id": "string", "weight_seconds": "int", "line": "string"},
    "weights": {"from_stop_id": "string", "to_stop_id": "string", "weight_seconds": "int", "type": "string"},
}


@dataclass(frozen=True)
class Locations:
    """Where each stage keeps its tables; environment variables of the form TRELLISQ_<NAME> take precedence."""

    root: str = "data"
    names: dict[str, str] = field(default_factory=dict)

    def path(self, name: str) -> str:
        """The place of a table."""
        return os.environ.get(f"TRELLISQ_{name.upper()}") or self.names.get(name) or f"{self.root}/{name}.txt"


def require_files(spark: SparkSession, paths: Sequence[str]) -> None:
    """Raise FileNotFoundError naming every path that does not exist."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    missing = [p for p in paths if not path(p).getFileSystem(conf).exists(path(p))]
    if missing:
        raise FileNotFoundError("missing: " + ", ".join(missing))


def first_line(spark: SparkSession, path: str) -> str:
    """The header line, without byte order mark and carriage return."""
    row = spark.read.text(path).limit(1).first()
    if row is None:
        raise RuntimeError(f"no header in {path}")
    return row[0].removeprefix("\ufeff").rstrip("\r")


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """A1: the most frequent of comma, semicolon and tab in the header; comma where there is none."""
    line = first_line(spark, path)
    return max(DELIMITERS, key=lambda d: (line.count(d), d == ","))


def read_header(spark: SparkSession, path: str) -> list[str]:
    """A2: column names in lower case without outer blanks or quotes."""
    return [c.strip().strip('"').strip().lower() for c in first_line(spark, path).split(sniff_delimiter(spark, path))]


def scan(spark: SparkSession, path: str, name: str | None = None, null_value: str = "", encoding: str = "UTF-8", numbered: bool = True) -> DataFrame:
    """A delimited text table with normalised header, trimmed text cells and empty cells as null.

    With ``name`` the columns are those of TABLES in their types: a missing column is
    null, a cell that does not cast is null.  ``row_no`` is the place in the file order
    (path, then position), from 1.
    """
    columns = read_header(spark, path)
    raw = (
        spark.read.schema(T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(columns))]))
        .option("sep", sniff_delimiter(spark, path))
        .option("header", True)
        .option("enforceSchema", True)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .option("encoding", encoding)
        .option("multiLine", False)
        .csv(path)
    )
    cells = {c: F.nullif(F.trim(F.col(f"_{i}")), F.lit(null_value)) for i, c in enumerate(columns)}
    wanted = TABLES[name] if name else dict.fromkeys(columns, "string")
    out = raw.select(
        F.monotonically_increasing_id().alias("_at"),
        *((cells[c].try_cast(t) if t != "string" else cells[c]) if c in cells else F.lit(None).cast(t) for c, t in wanted.items()),
    ).toDF("_at", *wanted)
    if not numbered:
        return out.drop("_at")
    return number_rows(out)


def number_rows(df: DataFrame, at: str = "_at", name: str = "row_no") -> DataFrame:
    """``name`` from 1 in the order of ``at`` (ascending within and over partitions), without one global sort.

    Rows of each partition are counted, the counts become offsets, and each partition is
    numbered by itself.
    """
    part = F.shiftright(at, 33).cast("int")
    tagged = df.withColumn("_part", part).withColumn("_in", F.col(at).bitwiseAND((1 << 33) - 1))
    sizes = tagged.groupBy("_part").agg((F.max("_in") + 1).alias("_size"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return tagged.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_in") + 1).drop("_part", "_in", "_before", at)


def ranked_rows(df: DataFrame, order: Sequence[Column | str], name: str, first: int = 1) -> DataFrame:
    """the rows with their place in ``order`` (no ties), from ``first``, as INT column ``name``.

    The rows are sorted by range partitions and written with their place within their
    partition; the sizes of the partitions become offsets.  No task meets all rows.
    """
    placed = written(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    return number_rows(placed, name="row_no_").withColumn(name, (F.col("row_no_") - 1 + first).cast("int")).drop("row_no_")


def scan_any_encoding(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 where the file is valid UTF-8, Latin-1 otherwise."""
    bad = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count()
    return scan(spark, path, encoding="ISO-8859-1" if bad else "UTF-8")


def text_files(spark: SparkSession, folder: str, name: str | None = None) -> list[str]:
    """The *.txt files of a folder in name order, or the named one."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    files = sorted(f.getPath().toString() for f in found if f.isFile() and f.getPath().getName().endswith(".txt"))
    if name is None:
        return files
    files = [f for f in files if f.rsplit("/", 1)[-1] in (name, f"{name}.txt")]
    if not files:
        raise FileNotFoundError(f"{folder}/{name}")
    return files


def keys(df: DataFrame, column: str) -> DataFrame:
    """A4: the distinct non-blank values of a column, trimmed."""
    return df.select(F.trim(column).alias(column)).where(F.col(column) != "").distinct()


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """A4: the distinct non-blank lines of a text file."""
    return keys(spark.read.text(path), "value")


def last_rows(df: DataFrame, key: Sequence[str], order: str = "row_no") -> DataFrame:
    """One row per key, the last in file order wins; keys with a null are left out."""
    rest = [c for c in df.columns if c not in key]
    kept = df.dropna(subset=list(key)).groupBy(*key).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("_r"))
    return kept.select(*key, "_r.*").select(df.columns)


def names(stops: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """A5: stop_id, stop_name, the last row of an id; optionally only of the given ids."""
    held = stops.join(ids.select("stop_id"), "stop_id", "left_semi") if ids is not None else stops
    return last_rows(held.select("stop_id", "stop_name", "row_no"), ["stop_id"]).drop("row_no")


def coordinates(stops: DataFrame) -> DataFrame:
    """stop_id, stop_name, stop_lat, stop_lon of the stops with coordinates."""
    return last_rows(stops.select("stop_id", "stop_name", "stop_lat", "stop_lon", "row_no"), ["stop_id"]).where("stop_lat is not null and stop_lon is not null").drop("row_no")


def transfer_pairs(transfers: DataFrame) -> DataFrame:
    """Pairs with at least one side."""
    return transfers.where("coalesce(from_stop_id, '') <> '' or coalesce(to_stop_id, '') <> ''").select("from_stop_id", "to_stop_id")


def transfer_weights(transfers: DataFrame) -> DataFrame:
    """A10: pairs with both sides and a time."""
    return transfers.where("from_stop_id <> '' and to_stop_id <> '' and min_transfer_time is not null").select("from_stop_id", "to_stop_id", "min_transfer_time")


# Fixed value: the form of pathway ids.
PATHWAY_ID = r"^PW\.([^_]+)_([^\s]+)$"


def pathway_pairs(pathways: DataFrame) -> DataFrame:
    """A and b of pathway ids of the form PW.<a>_<b>; other ids are left out."""
    return pathways.where(F.col("pathway_id").rlike(PATHWAY_ID)).select(
        F.regexp_extract("pathway_id", PATHWAY_ID, 1).alias("a"), F.regexp_extract("pathway_id", PATHWAY_ID, 2).alias("b")
    )


def write_table(df: DataFrame, path: str, columns: Sequence[str], sep: str = ",", null_value: str = "") -> None:
    """B1, B2: delimited text with header, the given columns in their order, CRLF as line end."""
    df.select(*columns).write.mode("overwrite").option("header", True).option("sep", sep).option("nullValue", null_value).option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Sorted plain lines."""
    df.select(F.col(column).cast("string").alias("value")).orderBy("value").write.mode("overwrite").text(path)


def report_text(report: DataFrame) -> DataFrame:
    """A report's rows as text: NA for null, five decimals, the path joined by arrows."""
    shown = {
        "path": F.when(F.size("path") > 0, F.array_join("path", " -> ")),
        "proportion": F.format_string("%.5f", "proportion"),
    }
    return report.select(*(F.coalesce(F.when(F.col(c).isNotNull(), shown.get(c, F.col(c).cast("string"))), F.lit("NA")).alias(c) for c in report.columns))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """A report written by report_text, NA read as null and the path as an array."""
    raw = scan(spark, path, null_value="NA", numbered=False)
    out = raw.withColumn("path", F.split("path", " -> ")) if "path" in raw.columns else raw
    numbers = {"proportion": "double", "iterations": "int", "path_vertices": "int", "optimum_weight": "long"}
    for c, t in numbers.items():
        if c in out.columns:
            out = out.withColumn(c, F.col(c).try_cast(t))
    return out


# Fixed value: data rows of one spreadsheet file.
ROWS_PER_FILE = 799_999


def numbered_parts(df: DataFrame, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Adds ``part`` (from 1): which spreadsheet file a row belongs to, by row_no."""
    return df.withColumn("part", (F.floor((F.col("row_no") - 1) / rows_per_file) + 1).cast("int"))


def write_parts(df: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """One folder of delimited text per spreadsheet part."""
    numbered_parts(df, rows_per_file).repartition("part").sortWithinPartitions("row_no").write.mode("overwrite").partitionBy("part").option("header", True).csv(path)
