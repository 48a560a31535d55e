"""Problem 1: separate the rows that fail to parse from the valid ones, with the reason.

Records are read quote-aware and strictly inside ``mapInArrow`` (one pass over each
partition, no shuffle, nothing collected).  For each record the steps are

1. *assembly* (:func:`assemble`, for deliveries that come as text files): physical lines
   are joined while a quoted field is open;
2. *strict parse* with Python's ``csv`` reader, whose structural exceptions are caught
   before any typed value is built and give the reason; what that reader lets pass (a
   quote inside an unquoted field, a line break after the last field) is looked for next;
3. *shape*: the number of fields must be that of the feed's file;
4. *typed constructor* of the number field.

Empty results, null feed names, unknown feeds, null lines and very long lines are
ordinary cases: each yields exactly one output row per input row.
"""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellisq.sources.gtfs import text_files

INT_MAX = 2147483647


@dataclass(frozen=True)
class Feed:
    """Shape of one delivered file: its columns, the number column, and whether that may be empty."""

    columns: tuple[str, ...]
    number: str
    required: bool


FEEDS: dict[str, Feed] = {
    "stop_times.txt": Feed(("trip_id", "stop_sequence", "stop_id", "arrival_time", "departure_time"), "stop_sequence", True),
    "pathways.txt": Feed(
        ("pathway_id", "from_stop_id", "to_stop_id", "pathway_mode", "is_bidirectional", "traversal_time", "signposted_as"),
        "traversal_time",
        False,
    ),
}

_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",\r\n]*+)'
_RECORD = re.compile(rf"{_FIELD}(?:,{_FIELD})*+\Z")
_DIGITS = re.compile(r"[0-9]+\Z")

# How the messages of Python's csv reader begin or go on, and the reason each stands for.
_MESSAGES = (("unexpected end of data", "unclosed_quote"), ("expected after", "text_after_quote"), ("new-line character", "bare_line_break"))


def strict_fields(line: str) -> tuple[str | None, list[str]]:
    """(reason, fields) of one record as text: the structural reason, or None and the fields."""
    try:
        rows = list(csv.reader([line], strict=True))
    except csv.Error as e:
        return next((r for m, r in _MESSAGES if m in str(e)), f"csv_error: {e}"), []
    fields = rows[0] if rows else [""]
    # the strict reader takes a quote inside an unquoted field for text, and a last line break for the line's end
    if line.endswith(("\n", "\r")):
        return "bare_line_break", fields
    if '"' in line and not _RECORD.match(line):
        return "stray_quote", fields
    return None, fields


def _scan_quotes(line: str, is_open: bool) -> tuple[bool, bool]:
    """(whether a quoted field is open after the line, whether its quoting is sound), from the state before it."""
    i, n = 0, len(line)
    while True:
        if is_open:
            j = line.find('"', i)
            if j < 0:
                return True, True
            if line.startswith('"', j + 1):
                i = j + 2
                continue
            i = j + 1
            if i < n and line[i] != "," and line[i:] != "\r":
                return False, False
            is_open = False
        else:
            # at the start of a field, or after a closed one
            j = line.find('"', i)
            if j < 0:
                return False, True
            if j and line[j - 1] != ",":
                return False, False
            is_open, i = True, j + 1


def assemble(lines: Iterator[str], width: int | None = None) -> Iterator[str]:
    """Join physical lines into records: a record goes on while a quoted field is open.

    A quote opens a field only at its start; the joined record keeps the line breaks.
    Where the open field is never closed, or closes in the middle of a field, or the
    joined record has another number of fields than ``width``, its first line is a record
    of its own (to be rejected) and reading goes on at the next line, so that an open
    quote costs one line and not all that follow.  No line is lost.

    The quote state is kept from line to line.  A line that an open field runs through
    holds only doubled quotes and therefore opens nothing itself: every line is looked at
    twice at most.
    """
    held: list[str] = []
    is_open = False
    for line in lines:
        todo = [line]
        while todo:
            line = todo.pop()
            held.append(line)
            was_open = is_open
            is_open, sound = _scan_quotes(line, is_open)
            if is_open:
                continue
            if was_open and not (sound and _has_width("\n".join(held), width)):
                yield held[0]
                # the lines in between open nothing; the last one is read anew
                yield from held[1:-1]
                todo.append(held[-1])
            else:
                yield "\n".join(held)
            held = []
    yield from held


def _has_width(record: str, width: int | None) -> bool:
    return width is None or len(strict_fields(record.removesuffix("\r"))[1]) == width


def parse_line(feed_name: str | None, line: str | None, feeds: dict[str, Feed] = FEEDS) -> tuple[str | None, list[str] | None, int | None]:
    """(reason, fields, number) of one record; the reason is None when it is valid."""
    feed = feeds.get(feed_name) if feed_name is not None else None
    if feed is None:
        return "unknown_feed", None, None
    if line is None:
        return "null_line", None, None
    reason, fields = strict_fields(line.removesuffix("\r"))
    if reason:
        return reason, None, None
    if len(fields) != len(feed.columns):
        return "too_few_fields" if len(fields) < len(feed.columns) else "too_many_fields", fields, None
    text = fields[feed.columns.index(feed.number)].strip(" \t")
    if not text:
        return ("empty_number" if feed.required else None), fields, None
    if not _DIGITS.match(text):
        return "not_a_number", fields, None
    digits = text.lstrip("0")
    if len(digits) > 10 or int(digits or "0") > INT_MAX:
        return "number_too_large", fields, None
    return None, fields, int(digits or "0")


def parse_records(df: DataFrame, feeds: dict[str, Feed] = FEEDS) -> DataFrame:
    """line_id, feed_name, feed_date, raw_line, reason, fields, number: one row per delivered record.

    ``df`` needs line_id, feed_name, feed_date, raw_line; other columns are ignored.
    Python runs one pass per partition; the output keeps the input's partitioning.
    """
    schema = "line_id long, feed_name string, feed_date date, raw_line string, reason string, fields array<string>, number int"
    out = pa.schema(
        [
            ("line_id", pa.int64()),
            ("feed_name", pa.string()),
            ("feed_date", pa.date32()),
            ("raw_line", pa.string()),
            ("reason", pa.string()),
            ("fields", pa.list_(pa.string())),
            ("number", pa.int32()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for b in batches:
            got = [parse_line(f, x, feeds) for f, x in zip(b.column(1).to_pylist(), b.column(3).to_pylist())]
            reasons, fields, numbers = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).cast(pa.int64()),
                    b.column(1).cast(pa.string()),
                    b.column(2).cast(pa.date32()),
                    b.column(3).cast(pa.string()),
                    pa.array(reasons, pa.string()),
                    pa.array(fields, pa.list_(pa.string())),
                    pa.array(numbers, pa.int32()),
                ],
                schema=out,
            )

    return df.select("line_id", "feed_name", "feed_date", "raw_line").mapInArrow(run, schema)


def read_deliveries(spark: SparkSession, folder: str, header: bool = False, feeds: dict[str, Feed] = FEEDS, batch: int = 10_000) -> DataFrame:
    """line_id, feed_name, feed_date, raw_line: the records of delivered *.txt files, assembled quote-aware.

    The feed is the file's name, the date null.  Where a record begins depends on all
    quotes before it, so a file is one task, read as a stream: what is held is the open
    record and a batch, whatever the size of the file.
    """
    paths = text_files(spark, folder)
    out = pa.schema([("feed_name", pa.string()), ("raw_line", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for b in batches:
            for path in b.column(0).to_pylist():
                name = path.rsplit("/", 1)[-1]
                width = len(feeds[name].columns) if name in feeds else None
                store, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
                with store.open_input_stream(place) as raw, io.TextIOWrapper(raw, "utf-8-sig", "replace", newline="\n") as text:
                    lines = (x.removesuffix("\n") for x in text)
                    held: list[str] = []
                    for k, record in enumerate(assemble(lines, width)):
                        if k == 0 and header:
                            continue
                        held.append(record)
                        if len(held) == batch:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * batch, pa.string()), pa.array(held, pa.string())], schema=out)
                            held = []
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(held), pa.string()), pa.array(held, pa.string())], schema=out)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(len(paths), 1))
    return files.mapInArrow(run, "feed_name string, raw_line string").select(
        F.monotonically_increasing_id().alias("line_id"), "feed_name", F.lit(None).cast("date").alias("feed_date"), "raw_line"
    )


def load_feed(df: DataFrame, feed_name: str, feeds: dict[str, Feed] = FEEDS) -> DataFrame:
    """The valid records of one feed as typed columns (the number column INT, the others STRING)."""
    feed = feeds[feed_name]
    ok = parse_records(df.where(F.col("feed_name") == feed_name), feeds).where(F.col("reason").isNull())
    return ok.select(
        "line_id",
        "feed_date",
        *(F.col("number").alias(c) if c == feed.number else F.col("fields")[i].alias(c) for i, c in enumerate(feed.columns)),
    )


def rejected(df: DataFrame, feeds: dict[str, Feed] = FEEDS) -> DataFrame:
    """line_id, feed_name, feed_date, raw_line, reason of the records that cannot be loaded."""
    return parse_records(df, feeds).where(F.col("reason").isNotNull()).select("line_id", "feed_name", "feed_date", "raw_line", "reason")
