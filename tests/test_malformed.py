import csv

import pytest
from hypothesis import given
from hypothesis import strategies as st

from trellisq.sources.malformed import assemble, load_feed, parse_line, parse_records, read_deliveries, rejected

ROW = "line_id long, feed_name string, feed_date date, raw_line string"


def reason(line, feed="stop_times.txt"):
    return parse_line(feed, line)[0]


@pytest.mark.parametrize(
    "line, want",
    [
        ("t,1,s,08:00:00,08:00:10", None),
        ("t,1,s,08:00:00,08:00:10\r", None),
        ('"t","1 ","s","",""', None),
        ('"a,b\nc""d",\t007,s,x,y', None),
        ("t,2147483647,s,x,y", None),
        ("t,2147483648,s,x,y", "number_too_large"),
        ("t," + "0" * 5000 + "7,s,x,y", None),
        ("t," + "9" * 5000 + ",s,x,y", "number_too_large"),
        ("t,-1,s,x,y", "not_a_number"),
        ("t,1 ,s,x,y", "not_a_number"),
        ("t,٣,s,x,y", "not_a_number"),
        ("t,,s,x,y", "empty_number"),
        ("t, ,s,x,y", "empty_number"),
        ("t,1,s,x", "too_few_fields"),
        ("", "too_few_fields"),
        ("t,1,s,x,y,", "too_many_fields"),
        ('t,1,s,"x,y', "unclosed_quote"),
        ('t,1,s,"x"z,y', "text_after_quote"),
        ('t,1,s,x"z,y', "stray_quote"),
        ('t,1, "s",x,y', "stray_quote"),
        ("t,1,s\nq,x,y", "bare_line_break"),
        ("t,1,s,x,y\r\r", "bare_line_break"),
        (None, "null_line"),
    ],
)
def test_stop_times_lines(line, want):
    assert reason(line) == want


def test_pathways_number_may_be_empty():
    assert reason("p,a,b,1,0,,sign", "pathways.txt") is None
    assert reason('p,a,b,1,0," ",', "pathways.txt") is None
    assert reason("p,a,b,1,0,x,sign", "pathways.txt") == "not_a_number"
    assert reason("p,a,b,1,0,60", "pathways.txt") == "too_few_fields"
    assert reason("p", "other.txt") == "unknown_feed"
    assert reason("p", None) == "unknown_feed"


def test_very_long_line():
    csv.field_size_limit(10**9)
    assert reason(f'"{"x" * 1_000_000}",1,s,x,y') is None


@given(st.lists(st.text(alphabet='a,"\n\r 1', max_size=6), min_size=5, max_size=5))
def test_written_records_read_again(fields):
    fields[1] = "12"
    line = ",".join('"' + f.replace('"', '""') + '"' for f in fields)
    got = parse_line("stop_times.txt", line)
    assert got == (None, fields, 12)


@given(st.text(alphabet='a,"\n1', max_size=14))
def test_valid_means_every_quote_is_in_place(line):
    why, fields, _ = parse_line("stop_times.txt", line)
    if why is None:
        rebuilt = [f for f in fields]
        assert len(rebuilt) == 5 and (line.count('"') - 2 * sum(f.count('"') for f in fields)) % 2 == 0


def test_assemble_joins_open_quotes():
    assert list(assemble(["a,1", 'b,"x', 'y",2', "c"])) == ["a,1", 'b,"x\ny",2', "c"]
    assert list(assemble([])) == []


def test_an_open_quote_costs_one_line():
    assert list(assemble(['a,"x', "y"])) == ['a,"x', "y"]
    assert list(assemble(['a,"x', "b,1", 'c,"d"', 'e,"f', 'g"'])) == ['a,"x', "b,1", 'c,"d"', 'e,"f\ng"']
    # closed at a field's end, but with too many fields for the file
    assert list(assemble(['a,"x', "b,1", 'y",2,3'], 3)) == ['a,"x', "b,1", 'y",2,3']
    assert list(assemble(['a,"x', "b,1", 'y",2'], 3)) == ['a,"x\nb,1\ny",2']
    lines = ['t,0,s,"x,y'] + [f"t,{i},s,x,y" for i in range(4000)]
    assert list(assemble(lines, 5)) == lines
    assert sum(parse_line("stop_times.txt", r)[0] is None for r in assemble(lines, 5)) == 4000


def test_assembly_is_linear():
    import time

    def took(n):
        lines = ['a,"x'] + ['say ""this"" and ""that""'] * n + ['y",2'] + ['b,"z'] * n
        began = time.perf_counter()
        assert "\n".join(assemble(lines)) == "\n".join(lines)
        return time.perf_counter() - began

    took(2000)
    assert took(16000) < 40 * took(2000) + 0.2


@given(st.lists(st.text(alphabet='a,"1', max_size=6), max_size=12))
def test_no_line_is_lost(lines):
    assert "\n".join(assemble(lines, 3)) == "\n".join(lines)


@given(st.lists(st.lists(st.text(alphabet='a,"\n1', max_size=5), min_size=3, max_size=3), max_size=6))
def test_sound_records_are_assembled_as_written(rows):
    records = [",".join('"' + f.replace('"', '""') + '"' for f in r) for r in rows]
    assert list(assemble("\n".join(records).split("\n") if records else [], 3)) == records


def test_reasons_come_from_the_strict_reader():
    for line in ('a,"x', 'a,"x"y', "a\nb"):
        with pytest.raises(csv.Error):
            list(csv.reader([line], strict=True))
        assert reason(line) in ("unclosed_quote", "text_after_quote", "bare_line_break")


def test_tables(spark):
    rows = [(1, "stop_times.txt", None, "t,5,s,x,y"), (2, "stop_times.txt", None, "t,z,s,x,y"), (3, "pathways.txt", None, "p,a,b,1,0,30,w"), (4, None, None, "q"), (5, "stop_times.txt", None, None)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], ROW + ", reason string")
    assert [tuple(r) for r in load_feed(df, "stop_times.txt").drop("feed_date").collect()] == [(1, "t", 5, "s", "x", "y")]
    assert load_feed(df, "pathways.txt").first().traversal_time == 30
    assert sorted((r.line_id, r.reason) for r in rejected(df).collect()) == [(2, "not_a_number"), (4, "unknown_feed"), (5, "null_line")]
    assert parse_records(df.limit(0)).count() == 0


def test_delivered_files(spark, tmp_path):
    (tmp_path / "stop_times.txt").write_bytes('\ufefft,1,"a\nb",x,y\r\nt,2,s,"x,y\nt,3,s,x,y\n'.encode())
    (tmp_path / "pathways.txt").write_bytes(b"p,a,b,1,0,60,w\n")
    (tmp_path / "other.csv").write_bytes(b"ignored")
    df = read_deliveries(spark, str(tmp_path))
    assert sorted((r.feed_name, r.raw_line) for r in df.collect()) == [("pathways.txt", "p,a,b,1,0,60,w"), ("stop_times.txt", 't,1,"a\nb",x,y\r'), ("stop_times.txt", 't,2,s,"x,y'), ("stop_times.txt", "t,3,s,x,y")]
    assert sorted(r.stop_id for r in load_feed(df, "stop_times.txt").collect()) == ["a\nb", "s"]
    assert [(r.raw_line, r.reason) for r in rejected(df).collect()] == [('t,2,s,"x,y', "unclosed_quote")]
    assert df.select("line_id").distinct().count() == 4
