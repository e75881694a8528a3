from __future__ import annotations

import random

import pytest

from millrace.sources import split_csv


@pytest.fixture
def small_ranges(spark):
    def of(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield of
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def messy(kind, n=80):
    """Rows with too few and too many fields, line breaks and doubled quotes within quotes, quotes where none belong, empty lines."""
    rng, rows = random.Random(kind), ["A,B,C"]
    inner = ["a", "b", " ", "é", "\n", "x", "\r\n" if kind in ("crlf", "mixed") else "\n", ",", '""', "'", "0"]
    stray = ['5" disk', 'a"b"', '"ab"c d', ' "lead"', '"q" ', '"a""b"', '""', '"x"y"z"']
    for i in range(n):
        cells = [f"id{i}"]
        for _ in range(rng.choice([3, 3, 3, 2, 4, 1]) - 1):
            plain = "".join(rng.choices("abc xyz'.é", k=rng.randint(0, 6)))
            cells.append(rng.choice(['"' + "".join(rng.choices(inner, k=rng.randint(0, 14))) + '"', plain, rng.choice(stray) if kind == "stray" else plain]))
        rows.append(",".join(cells))
        if rng.random() < 0.05:
            rows.append("")
    return ("\r\n" if kind == "crlf" else "\n").join(rows) + "\n" * (kind != "open")


@pytest.mark.parametrize("kind", ["lf", "crlf", "stray", "mixed", "open"])
def test_rows_and_order_are_those_of_the_whole_reader(spark, tmp_path, small_ranges, kind):
    (tmp_path / "in.csv").write_bytes(messy(kind).encode())
    path = f"file://{tmp_path}/in.csv"
    wanted = [tuple(r) for r in spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE").collect()]
    for size in ("128m", "50", "9"):
        small_ranges(size)
        rows = split_csv.read(spark, path)
        assert [tuple(r)[:-1] for r in rows.orderBy("_row").collect()] == wanted
        assert rows.columns == ["A", "B", "C", "_row"]


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    (tmp_path / "in.csv").write_bytes(messy("lf", 2000).encode())
    small_ranges("4k")
    assert split_csv.read(spark, f"file://{tmp_path}/in.csv").rdd.getNumPartitions() > 8


def test_files_of_a_folder_each_have_a_header(spark, tmp_path, small_ranges):
    for name, text in (("a.csv", 'X,Y\n1,"one\ntwo\nthree\nfour"\n'), ("b.csv", 'X,Y\n2,"never closed\n3,more\n'), ("c.csv", "X,Y\n"), ("d.csv", "")):
        (tmp_path / name).write_text(text)
    small_ranges("6")
    got = [tuple(r)[:-1] for r in split_csv.read(spark, f"file://{tmp_path}").orderBy("_row").collect()]
    assert got[0] == ("1", "one\ntwo\nthree\nfour") and len(got) == 2 and got[1][0] == "2" and got[1][1].endswith("never closed\n3,more")


@pytest.mark.parametrize("line, within, after", [('a,b', False, False), ('a,"b', False, True), ('b",c', True, False), ('b""', True, True), ('5" disk', False, False), ('x"y,"z', True, True), ("", True, True)])
def test_lines(line, within, after):
    assert split_csv.ends_within(line, within) is after


def test_batches_are_bounded_by_characters():
    """Long records are given out in small batches, though they are fewer than a batch may have."""
    import pyarrow as pa

    text = "x" * 10_000
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * 2000), pa.array([0] * 2000), pa.array([text] * 2000)], names=["file", "start", "line"])
    out = list(split_csv._records({("f", 0): (0, None)})(iter([batch])))
    assert sum(b.num_rows for b in out) == 2000 and max(b.nbytes for b in out) < 5_000_000
    assert [at for b in out for at in b.column(3).to_pylist()] == list(range(2000))
