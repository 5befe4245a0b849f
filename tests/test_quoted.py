"""Quoted cells with line breaks, files cut at every byte."""

import csv
import io
import random

import pytest

from gaugeline.sources import quoted
from gaugeline.sources.tables import read_table, read_text_table


@pytest.fixture
def small_splits(spark):
    """`small_splits(bytes)` makes scans cut files after so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}

    def cut(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "1")
        spark.conf.set(names[2], "1")

    yield cut
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def whole(spark, path):
    """The file by one task."""
    return (spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(path)))


def same(spark, path):
    records = quoted.csv_records(spark, str(path))
    names = whole(spark, path).columns
    got = sorted(map(repr, quoted.cells(records, names).collect()))
    assert got == sorted(map(repr, whole(spark, path).collect()))
    return len(got)


def random_rows(draw, n):
    parts = ["a", "bc", ",", '"', "\n", "\n\n", " ", "ü", "", '""', ",\n"]
    return [[str(i), *["".join(draw.choices(parts, k=draw.randrange(7))) for _ in range(2)]] for i in range(n)]


@pytest.mark.parametrize("size, seed, end", [(7, 1, "\n"), (16, 2, "\n"), (37, 3, "\r\n"), (64, 4, "\n")])
def test_splits_anywhere(spark, tmp_path, small_splits, size, seed, end):
    draw, out = random.Random(seed), io.StringIO()
    write = csv.writer(out, lineterminator=end)
    write.writerow(["id", "head, \n line", "c"])
    write.writerows(random_rows(draw, 40))
    text = out.getvalue() if end == "\n" else out.getvalue().replace("\r\n", "\n").replace("\n", "\r\n")
    path = tmp_path / "x.csv"
    path.write_bytes(text.encode())
    small_splits(size)
    assert spark.read.option("lineSep", "\n").text(str(path)).rdd.getNumPartitions() > 5
    assert same(spark, path) == 40


def test_signs_that_open_nothing(spark, tmp_path, small_splits):
    path = tmp_path / "x.csv"
    path.write_text('a,b\n5" pipe,x\nq"q"q,"two\nlines"\n\n"a ""b""\n"",",y\n"",""\n,\nlast,"open until\nthe end')
    small_splits(5)
    assert same(spark, path) == 6


def test_a_cell_over_many_splits_and_several_files(spark, tmp_path, small_splits):
    long = "\n".join(f"line {i}" for i in range(500))
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text(f'id,t\n{name}1,"{long}"\n{name}2,x\n{name}3,"{long}"\n')
    (tmp_path / "c.csv").write_text("id,t\n")
    small_splits(300)
    got = {r["id"]: r["t"] for r in read_table(spark, str(tmp_path), multi_line=True).collect()}
    assert got == {f"{n}{i}": long if i != 2 else "x" for n in "ab" for i in (1, 2, 3)}


def test_empty_files_and_texts(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("a, b\n")
    assert read_table(spark, str(path), multi_line=True).columns == ["a", "b"]
    assert read_text_table(spark, str(path), multi_line=True).count() == 0
    path = tmp_path / "y.csv"
    path.write_text('\n\na,b\n"x\ny",\nNA,""\n')
    assert sorted(map(tuple, read_text_table(spark, str(path), True).collect())) == [("NA", ""), ("x\ny", "")]
    assert read_table(spark, str(path), True).where("a IS NULL").count() == 1


@pytest.mark.parametrize("line, outside, inside", [
    ("", False, True), ("a,b", False, True), ('"', True, False), ('a"', False, False), ('a,"b', True, False),
    ('""', False, True), ('"a""', True, False), ('"a"",b', True, False), ('"a","b', True, True), ('a""b,"', True, False),
    ('","', False, True), ('x"y",z', False, False),
])
def test_line_ends(line, outside, inside):
    assert quoted.ends_inside(line, False) is outside
    assert quoted.ends_inside(line, True) is inside
