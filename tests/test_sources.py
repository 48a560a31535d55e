import os

import pytest

from trellisq.sources import gtfs as G


def put(path, text, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="") as f:
        f.write(text)
    return str(path)


def test_scan_keeps_ids_as_text(spark, tmp_path):
    p = put(tmp_path / "w.txt", "﻿from_stop_id; To_Stop_Id ;weight_seconds\r\n1.9140;1.914; 60 \r\n1.10;;x\r\n")
    assert G.sniff_delimiter(spark, p) == ";"
    assert G.read_header(spark, p) == ["from_stop_id", "to_stop_id", "weight_seconds"]
    rows = G.scan(spark, p, "subway_weights").orderBy("row_no").collect()
    assert [(r.from_stop_id, r.to_stop_id, r.weight_seconds, r.line, r.row_no) for r in rows] == [("1.9140", "1.914", 60, None, 1), ("1.10", None, None, None, 2)]


def test_delimiters_and_missing_header(spark, tmp_path):
    assert G.sniff_delimiter(spark, put(tmp_path / "a.txt", "only\r\n1\r\n")) == ","
    assert G.sniff_delimiter(spark, put(tmp_path / "b.txt", "a\tb\n")) == "\t"
    with pytest.raises(RuntimeError):
        G.first_line(spark, put(tmp_path / "c.txt", ""))


def test_row_numbers_over_files(spark, tmp_path):
    for k in range(3):
        put(tmp_path / f"p{k}.txt", "a\n" + "".join(f"{k}{i}\n" for i in range(4)))
    files = G.text_files(spark, str(tmp_path))
    assert [os.path.basename(f) for f in files] == ["p0.txt", "p1.txt", "p2.txt"]
    got = spark.read.schema("a string").option("header", True).csv(str(tmp_path)).selectExpr("monotonically_increasing_id() as _at", "a")
    rows = G.number_rows(got).collect()
    assert sorted(r.row_no for r in rows) == list(range(1, 13))
    with pytest.raises(FileNotFoundError):
        G.text_files(spark, str(tmp_path), "none")
    with pytest.raises(FileNotFoundError, match="nowhere"):
        G.require_files(spark, [files[0], "/nowhere/x.txt"])


def test_latin1(spark, tmp_path):
    assert G.scan_any_encoding(spark, put(tmp_path / "l.txt", "a\nPlaça\n", "latin-1")).first().a == "Plaça"
    assert G.scan_any_encoding(spark, put(tmp_path / "u.txt", "a\nPlaça\n")).first().a == "Plaça"


def test_last_row_wins(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 3), ("a", "z", 2), (None, "n", 4)], "stop_id string, stop_name string, row_no long")
    assert [tuple(r) for r in G.names(df).collect()] == [("a", "y")]
    assert G.keys(df.unionByName(spark.createDataFrame([(" b ", "", 9)], df.schema)), "stop_id").count() == 2


def test_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", "b", 3, 2, 10, 0.123456, ["a", "b"]), ("a", "c", 5, None, None, None, [])], "source string, target string, iterations int, path_vertices int, optimum_weight long, proportion double, path array<string>")
    text = G.report_text(df)
    assert [tuple(r) for r in text.orderBy("target").collect()][1] == ("a", "c", "5", "NA", "NA", "NA", "NA")
    out = str(tmp_path / "report")
    G.write_table(text, out, text.columns)
    back = G.read_report(spark, out).orderBy("target").collect()
    assert back[0].proportion == 0.12346 and back[0].path == ["a", "b"] and back[1].optimum_weight is None and back[1].path is None
    raw = next(open(os.path.join(out, f), newline="").read() for f in os.listdir(out) if f.endswith(".csv"))
    assert raw.split("\r\n")[0] == ",".join(df.columns)


def test_parts_and_lines(spark, tmp_path):
    df = spark.range(10).selectExpr("id + 1 as row_no")
    assert [r.part for r in G.numbered_parts(df, 4).orderBy("row_no").collect()] == [1] * 4 + [2] * 4 + [3] * 2
    G.write_parts(df, str(tmp_path / "parts"), 4)
    assert {r.part: r.n for r in spark.read.option("header", True).csv(str(tmp_path / "parts")).groupBy("part").agg({"row_no": "count"}).withColumnRenamed("count(row_no)", "n").collect()} == {1: 4, 2: 4, 3: 2}
    G.write_lines(spark.createDataFrame([("b",), ("a",)], "x string"), "x", str(tmp_path / "lines"))
    assert [r.value for r in spark.read.text(str(tmp_path / "lines")).collect()] == ["a", "b"]


def test_pairs(spark):
    df = spark.createDataFrame([("PW.1.1_E.2",), ("PW.x",), (None,), ("PW.a_b c",)], "pathway_id string")
    assert [tuple(r) for r in G.pathway_pairs(df).collect()] == [("1.1", "E.2")]


def test_locations(monkeypatch):
    monkeypatch.setenv("TRELLISQ_STOPS", "/elsewhere/stops.txt")
    where = G.Locations("base", {"trips": "t.csv"})
    assert (where.path("stops"), where.path("trips"), where.path("routes")) == ("/elsewhere/stops.txt", "t.csv", "base/routes.txt")


def test_views_over_a_folder(spark, tmp_path):
    from trellisq.sources.tables import register

    for name, rows in (("stops", [("1.1",), ("1.10",)]), ("trips", [])):
        spark.createDataFrame(rows, "stop_id string").write.parquet(str(tmp_path / f"{name}.parquet"))
    (tmp_path / "notes.txt").write_text("ignored")
    assert register(spark, str(tmp_path)) == ["stops", "trips"]
    assert spark.sql("SELECT count(DISTINCT stop_id) FROM stops").first()[0] == 2 and spark.table("trips").count() == 0
