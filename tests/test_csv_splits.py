"""Quoted line breaks in files that are read in many splits."""

import csv
import random

import pytest

from millrace.sources import readers

SCHEMA = "k long, t string, u string"


def write(path, data, newline="\n", header=True):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=newline, quoting=csv.QUOTE_MINIMAL)
        if header:
            w.writerow(["k", "t\nname", "u"])
        w.writerows(data)


def rows(seed, n, longest):
    rng = random.Random(seed)
    parts = ["a", "é", '"', '""', "\n", "\n\n", ",", " x ", "\r\n", 'b"\n"c']
    return [(k, "x" + "".join(rng.choice(parts) for _ in range(rng.randint(1, longest))) + "x", rng.choice(["u", "w\nv", "plain"])) for k in range(n)]


@pytest.fixture
def small_splits(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(request.param))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("small_splits", [97, 1009, 1 << 20], indirect=True)
@pytest.mark.parametrize("newline, header", [("\n", True), ("\r\n", False)])
def test_records_across_splits(spark, tmp_path, small_splits, newline, header):
    data = rows(3, 300, 12) + [(1000, "x" + "long\n" * 600 + "x", "u"), (1001, "x" + "no line " * 300 + "x", 'q"')]
    write(tmp_path / "a.csv", data, newline, header)
    write(tmp_path / "b.csv", [(k + 5000, t, u) for k, t, u in data[:90]], newline, header)
    df = readers.read_csv(spark, str(tmp_path), header=header, schema=SCHEMA, multi_line=True)
    if small_splits < 2000:
        assert df.rdd.getNumPartitions() > 8
    want = sorted(data + [(k + 5000, t, u) for k, t, u in data[:90]])
    assert sorted(tuple(r) for r in df.collect()) == want


def test_one_task_per_file_takes_stray_quotes(spark, tmp_path):
    (tmp_path / "s.csv").write_text('k,t,u\n1,5" pipe,x\n2,"a\nb",y\n')
    df = readers.read_csv(spark, str(tmp_path), schema=SCHEMA, multi_line="file")
    assert sorted(tuple(r) for r in df.collect()) == [(1, '5" pipe', "x"), (2, "a\nb", "y")]


def test_empty_files(spark, tmp_path):
    (tmp_path / "e.csv").write_text("")
    (tmp_path / "h.csv").write_text("k,t,u\n\n")
    assert readers.read_csv(spark, str(tmp_path), schema=SCHEMA, multi_line=True).count() == 0


def test_where_records_began():
    blocks = [(1, 0, 3), (1, 10, 0), (1, 20, 2), (1, 30, 1), (1, 40, 0), (2, 0, 0), (2, 10, 1), (2, 20, 0), (2, 30, 1)]
    assert readers._open_blocks(blocks) == {
        (1, 0): (0, 0), (1, 10): (1, 0), (1, 20): (1, 0), (1, 30): (1, 20), (1, 40): (0, 20),
        (2, 0): (0, 0), (2, 10): (0, 0), (2, 20): (1, 10), (2, 30): (1, 10),
    }
