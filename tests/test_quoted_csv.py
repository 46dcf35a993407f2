"""Parallel CSV and zip members against plain parsers, with ranges far smaller than records."""

from __future__ import annotations

import csv
import io
import os
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from presslens.registry.q_sources import FIXTURE_SCHEMA, _raw
from presslens.sources import io as IO
from presslens.sources import quoted_csv as QC

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("n", T.LongType()), ("a", T.StringType()), ("b", T.StringType()))])


@pytest.fixture
def small_ranges(spark):
    """Ranges of 64 bytes."""
    own = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def one_task(spark, path):
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in SCHEMA.fields])
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(text).csv(path)
    return df.selectExpr("try_cast(n AS bigint) n", "a", "b")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def _cells(rng):
    pieces = ["x", "long " * 60, "\n", "\n\n", '"', '""', ",", "\r\n", "é", " ", '",\n"', "end"]
    return "".join(rng.choices(pieces, k=rng.randint(0, 6)))


def _file(path, seed, n=40, line_end="\n"):
    rng = random.Random(seed)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f, lineterminator=line_end)
        out.writerow(["n", "a", 'a "head"\nof two lines'])
        for i in range(n):
            out.writerow([i, _cells(rng), _cells(rng)])


def test_equals_the_one_task_reader(spark, tmp_path, small_ranges):
    for seed in range(3):
        _file(tmp_path / f"f{seed}.csv", seed)
    path = f"file://{tmp_path}"
    got = IO.read_articles_csv(spark, path, SCHEMA)
    assert got.schema == SCHEMA
    assert rows_of(got) == rows_of(one_task(spark, path))
    assert got.count() == 120


def test_line_ends_of_two_characters(spark, tmp_path, small_ranges):
    """Cells keep their line ends as they are (Spark's own reader makes them one character)."""
    _file(tmp_path / "f.csv", 5, line_end="\r\n")
    with open(tmp_path / "f.csv", newline="", encoding="utf-8") as f:
        want = [(int(n), a or None, b or None) for n, a, b in list(csv.reader(f))[1:]]
    assert rows_of(IO.read_articles_csv(spark, f"file://{tmp_path}/f.csv", SCHEMA)) == sorted(want, key=str)


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_ranges):
    _file(tmp_path / "f.csv", 9)
    lines = spark.read.option("lineSep", "\n").text(f"file://{tmp_path}/f.csv")
    assert lines.rdd.getNumPartitions() > 20
    records = QC.read_records(spark, f"file://{tmp_path}/f.csv")
    assert records.select("begin").distinct().count() > 10  # records begin in many ranges


def test_record_longer_than_many_ranges(spark, tmp_path, small_ranges):
    text = "\n".join(f"line {i} of one cell" for i in range(400))
    with open(tmp_path / "f.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["n", "a", "b"], [1, text, "x"], [2, "y", text + '"'], [3, "", "z"]])
    got = rows_of(IO.read_articles_csv(spark, f"file://{tmp_path}/f.csv", SCHEMA))
    assert got == [(1, text, "x"), (2, "y", text + '"'), (3, None, "z")]


@pytest.mark.parametrize("content, want", [
    ("", []), ("n,a,b", []), ("n,a,b\n", []), ("n,a,b\n\n\n1,x,y\n\r\n2,,\n", [(1, "x", "y"), (2, None, None)]),
    ('n,a,b\n1,"open\nto the end', [(1, "open\nto the end", None)]),
    ('n,a,b\nbad,5" pipe,6" pipe\n3,x,y', [(3, "x", "y"), (None, '5" pipe', '6" pipe')]),
    ('n,a,b\n1,only\n2,x,y,more\n', [(1, "only", None), (2, "x", "y")])])
def test_edges(spark, tmp_path, content, want):
    (tmp_path / "f.csv").write_text(content)
    assert rows_of(IO.read_articles_csv(spark, f"file://{tmp_path}/f.csv", SCHEMA)) == sorted(want, key=str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.text('a",\n\r ', max_size=6), min_size=1, max_size=3), max_size=6))
def test_cutter_gives_the_records_of_a_csv_writer(rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n", quoting=csv.QUOTE_ALL).writerows([["head"], *rows])
    cutter = QC.Cutter()
    found = [x for line in out.getvalue().split("\n")[:-1] if (x := cutter.line(line))]
    assert cutter.rest() is None and [place for place, _ in found] == list(range(-1, len(rows)))
    assert [next(csv.reader(io.StringIO(text + "\n", newline=""))) for _, text in found[1:]] == rows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text('a",', max_size=8), max_size=12), st.data())
def test_maps_compose(lines, data):
    """States before each range from the scanned maps equal those of one reading."""
    def walk(lines, inside):
        for line in lines:
            inside = QC.open_after(line, inside)
        return inside
    cuts = sorted(data.draw(st.lists(st.integers(0, len(lines)), max_size=4)))
    state = False
    for i, k in zip([0, *cuts], [*cuts, len(lines)]):
        to = walk(lines[i:k], False), walk(lines[i:k], True)
        assert state == walk(lines[:i], False)
        state = to[state]


def test_zip_equals_the_table(spark, sf_dir, tmp_path):
    raw = _raw(spark, sf_dir)
    path = IO.write_csv(raw.coalesce(2), f"file://{tmp_path}/csv").removeprefix("file://")
    parts = sorted(f for f in os.listdir(path) if f.endswith(".csv"))
    with zipfile.ZipFile(tmp_path / "all.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for i, f in enumerate(parts):
            z.write(f"{path}/{f}", f"folder/part{i}.csv")
        z.writestr("readme.txt", "not a table")
    got = IO.read_articles_zip(spark, f"file://{tmp_path}/all.zip", FIXTURE_SCHEMA, partitions=4)
    assert got.exceptAll(raw).isEmpty() and raw.exceptAll(got).isEmpty()


def test_zip_member_is_streamed(spark, tmp_path, monkeypatch):
    """Batches of bounded size, whatever the member's size."""
    monkeypatch.setattr(QC, "HELD", 1000)
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.csv", "n,a\n" + "".join(f'{i},"{"y" * 90}\n"\n' for i in range(500)))
    reader = QC._ZipReader([f"file://{tmp_path}/a.zip"], r"\.csv$")
    batches = list(reader.read(reader.partitions()[0]))
    assert sum(b.num_rows for b in batches) == 500 and max(b.num_rows for b in batches) <= 12
