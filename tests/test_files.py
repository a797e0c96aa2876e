"""Text files with the quirks that exports have."""

import csv
import io
import random

import pytest

from hustings.sources import files


def test_csv_quirks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id,geometry,note\r\n1,"POLYGON ((0 0, 1 0, 1 1))","said ""so"""\r\n2,"two\nlines"\r\n'.encode())
    df = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["id", "geometry", "note"]
    assert [tuple(r) for r in df.collect()] == [("1", "POLYGON ((0 0, 1 0, 1 1))", 'said "so"'), ("2", "two\nlines", None)]


@pytest.mark.parametrize("multi_line", [True, False])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_blank_and_short_rows_stay(spark, tmp_path, multi_line, end):
    (tmp_path / "a.csv").write_bytes(end.join(["a,b", "1,x", "", "2,y", ",", "3", ' 4 ,"p,q"', "", ""]).encode())
    rows = [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), multi_line=multi_line).collect()]
    assert rows == [("1", "x"), (None, None), ("2", "y"), (None, None), ("3", None), (" 4 ", "p,q"), (None, None)]


def test_header_only_and_open_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n")
    (tmp_path / "b.csv").write_text('a,b\n1,"open\n2,x')
    assert files.read_csv(spark, str(tmp_path / "a.csv")).count() == 0
    assert files.read_csv(spark, str(tmp_path / "b.csv")).count() == 1
    typed = files.read_csv(spark, str(tmp_path / "a.csv"), "a int, b string")
    assert typed.dtypes == [("a", "int"), ("b", "string")]


def test_large_cells(spark, tmp_path):
    long = "x" * 200_000 + '"" , \n' * 2000
    (tmp_path / "a.csv").write_text(f'a,b\n1,"{long}"\n2,y\n')
    rows = files.read_csv(spark, str(tmp_path / "a.csv")).collect()
    assert [r.a for r in rows] == ["1", "2"] and rows[0].b == long.replace('""', '"')


def test_folders_are_released(spark):
    import os

    from hustings import shared

    shared.release(spark)
    df = shared.materialize(spark.range(5))
    path = shared._written[-1]
    assert df.count() == 5 and os.path.isdir(path)
    assert shared.release(spark) == 1 and not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from hustings import shared

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_folder(session)


def test_required_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id\n1\n")
    with pytest.raises(ValueError, match="County"):
        files.read_csv(spark, str(tmp_path / "a.csv"), required=["id", "County"])


def test_directory(spark, tmp_path):
    for n in ("x", "y"):
        (tmp_path / f"{n}.csv").write_text("id\n1\n2\n")
    assert {k: v.count() for k, v in files.read_directory(spark, str(tmp_path)).items()} == {"x": 2, "y": 2}


@pytest.mark.parametrize("size", ["300b", "5k", "1m"])
def test_one_file_of_many_splits(spark, tmp_path, size):
    """Cells with newlines, commas and quotes, blank rows, a cell longer than several splits, a header cell with a newline, CRLF; the same rows whatever the splits."""
    rng = random.Random(8)
    rows = [["id", "no\nte", "more"]]
    for i in range(400):
        cell = rng.choice(["plain", 'a "quoted"\ntext', "\n\n", "x,y\r\nz", "", 'end"', "é \U0001f600\n" * rng.randint(1, 40)])
        rows.append([str(i), cell, rng.choice(["", "last"])])
    rows[200][1] = "long\n\"line\"\n" * 300
    out = io.StringIO()
    csv.writer(out, lineterminator="\r\n").writerows(rows)
    lines = out.getvalue()
    half = lines.index("\r\n300,") + 2
    (tmp_path / "one.csv").write_bytes((lines[:half] + "\n" + lines[half:]).encode())
    (tmp_path / "two.csv").write_bytes(b'id,"no\nte",more\r\n1000,two,"open to\nthe end')
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1b")
        df = files.read_csv(spark, str(tmp_path))
        got = [(r[0], r[1], r[2]) for r in df.collect()]
        if size == "300b":
            assert spark.read.text(str(tmp_path / "one.csv")).rdd.getNumPartitions() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = [(a, b or None, c or None) for a, b, c in rows[1:]] + [(None, None, None), ("1000", "two", "open to\nthe end")]
    key = lambda r: str(r).replace("\\r", "")
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_a_row_like_the_header_stays(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\nx,y\n")
    for multi_line in (True, False):
        assert sorted(map(tuple, files.read_csv(spark, str(tmp_path), multi_line=multi_line).collect())) == [("1", "2"), ("x", "y")]
