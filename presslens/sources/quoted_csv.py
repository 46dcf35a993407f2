"""Quoted CSV read by many tasks, and CSV members of zip archives.

Cells in quotes may hold line ends, so a byte range of a file can't tell by
itself whether it begins inside a cell. Three steps settle that without
reading a file in one task:

1. Spark's text source cuts the files into ranges and lines. Every range
   gives its state map: for a beginning outside and inside quotes, the state
   at its end, and whether a record that begins in it is still open there.
2. The maps are composed by a prefix scan per file (a window over one small
   row a range): a map is constant, a flip or the identity, so the state
   before a range is the last constant plus the flips since.
3. The lines are read again; each range is cut into records from its true
   state. What lies before the first and after the last record end goes out as
   fragments, a few a range, which are put together by the range that the
   record began in, so records may be longer than ranges.

Both readings must see the same ranges. They run inside ``read_records`` with
the settings that decide the ranges pinned, and the records are written as a
stage. A file has at most one range per ``spark.sql.files.maxPartitionBytes``,
which is raised where there would be more than ``MOST_RANGES``; only ranges
after a file's first that begin inside a cell are broadcast.

Quotes follow RFC 4180: a cell that begins with a quote ends at the next quote
that is not doubled, what follows it up to the comma belongs to the cell; a
quote inside a cell that doesn't begin with one is an ordinary character. Each
file's first record is its header. Lines end with LF or CR LF; empty records
are passed over. A record that is still open at the end of its file ends there.
"""

from __future__ import annotations

import contextlib
import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import filesystem, materialize

#: Ranges of all files at most, besides one a file.
MOST_RANGES = 1 << 20
#: Characters of records that a task holds before it gives them out.
HELD = 8 << 20

def open_after(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open behind ``line``; ``inside``: whether one is before it."""
    at = 0
    if not inside:
        if not line.startswith('"'):
            at = line.find(',"') + 1  # outside quotes every comma parts cells
            if not at:
                return False
        at += 1
    while True:
        end = line.find('"', at)
        if end < 0:
            return True
        if line.startswith('"', end + 1):
            at = end + 2
            continue
        at = line.find(',"', end + 1) + 2
        if at == 1:
            return False


class Cutter:
    """Records of consecutive lines. ``inside``: the first line continues a record that began elsewhere."""

    def __init__(self, inside: bool = False, header: bool = True):
        self.inside, self.lines = inside, []
        self.foreign = inside
        self.place = -1 if header else 0  # of the next record; the header is -1

    def line(self, line: str) -> tuple[int | None, str] | None:
        """(place, record) if a record ends with this line; place is null for the end of a foreign record."""
        if self.inside:
            self.lines.append(line)
            self.inside = '"' not in line or open_after(line, True)
        elif '"' in line and open_after(line, False):
            self.lines, self.inside = [line], True
        elif line in ("", "\r"):
            return None
        else:
            self.lines = [line]
        return None if self.inside else self._record(line)

    def _record(self, last: str) -> tuple[int | None, str]:
        self.lines[-1] = last.removesuffix("\r")
        return self.rest()

    def rest(self) -> tuple[int | None, str] | None:
        """What is open: the same as of a record."""
        if not self.lines:
            return None
        text, self.lines = "\n".join(self.lines), []
        if self.foreign:
            self.foreign = False
            return None, text
        self.place += 1
        return self.place - 1, text


def _ranges_of(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(file, begin, first row, row after the last) of each stretch of one range."""
    files, begins = batch.column("file").to_pylist(), batch.column("begin").to_pylist()
    i = 0
    while i < len(files):
        k = i
        while k < len(files) and begins[k] == begins[i] and files[k] == files[i]:
            k += 1
        yield files[i], begins[i], i, k
        i = k


_MAPS = "file string, begin long, outside_to boolean, inside_to boolean, fresh boolean"


def _state_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines without quotes come as null: they leave both states."""
    at, state = None, None

    def row():
        return pa.RecordBatch.from_pylist([dict(zip(("file", "begin", "outside_to", "inside_to", "fresh"), (*at, *state)))])
    for batch in batches:
        for file, begin, i, k in _ranges_of(batch):
            if at != (file, begin):
                if at is not None:
                    yield row()
                at, state = (file, begin), (False, True, False)
            outside, inside, fresh = state
            for line in pc.drop_null(batch.column("value")[i:k]).to_pylist():
                outside, inside = open_after(line, outside), open_after(line, inside)
                fresh = fresh or not inside
            state = outside, inside, fresh
    if at is not None:
        yield row()


_RECORDS = "file string, begin long, place long, part long, record string, whole boolean"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, owner, cutter, rows, held = None, None, None, [], 0

    def put(found, whole: bool) -> int:
        place, text = found
        if whole and place == -1:
            return 0
        foreign = place is None
        rows.append((at[0], owner if foreign else at[1], place, at[1], text, whole and not foreign))
        return len(text)

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
            pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))],
            names=["file", "begin", "place", "part", "record", "whole"])
    for batch in batches:
        for file, begin, i, k in _ranges_of(batch):
            if at != (file, begin):
                if cutter is not None and (open_ := cutter.rest()):
                    held += put(open_, False)
                at, owner = (file, begin), batch.column("owner")[i].as_py()
                cutter = Cutter(owner is not None, begin == 0)
            for line in batch.column("value")[i:k].to_pylist():
                if found := cutter.line(line):
                    held += put(found, True)
                    if held >= HELD:
                        yield given()
                        rows, held = [], 0
    if cutter is not None and (open_ := cutter.rest()):
        put(open_, False)
    if rows:
        yield given()


@contextlib.contextmanager
def _pinned(spark: SparkSession, path: str | list[str]):
    """Ranges that don't depend on the executors there are, ``MOST_RANGES`` of them at most."""
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    own = {"spark.sql.files.minPartitionNum": str(max(2, spark.sparkContext.defaultParallelism))}
    most = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    if size > most * MOST_RANGES:
        own["spark.sql.files.maxPartitionBytes"] = str(-(-size // MOST_RANGES))
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def entry_states(maps: DataFrame) -> DataFrame:
    """(file, begin, owner) of the ranges that begin inside a cell; ``owner``: begin of the range that its record began in."""
    before = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    constant = F.col("outside_to") == F.col("inside_to")
    flips = F.coalesce(F.sum((F.col("outside_to") & ~F.col("inside_to")).cast("int")).over(before), F.lit(0))
    own_flip = (F.col("outside_to") & ~F.col("inside_to")).cast("int")
    counted = maps.withColumn("flips", flips)
    last = F.last(F.when(constant, F.struct(F.col("outside_to").cast("int").alias("to"), (F.col("flips") + own_flip).alias("flips"))),
                  ignorenulls=True).over(before)
    inside = F.pmod(F.coalesce(last["to"], F.lit(0)) + F.col("flips") - F.coalesce(last["flips"], F.lit(0)), F.lit(2)) == 1
    known = counted.withColumn("inside", inside)
    opens = F.when(F.col("inside"), F.col("inside_to") & F.col("fresh")).otherwise(F.col("outside_to"))
    owner = F.last(F.when(opens, F.col("begin")), ignorenulls=True).over(before)
    return known.withColumn("owner", owner).filter("inside").select("file", "begin", "owner")


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, begin, place, record): every record but the headers; ``place``: its number in the range at ``begin``.

    The result is written as a stage.
    """
    def lines():
        text = spark.read.option("lineSep", "\n").text(path)
        return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")
    with _pinned(spark, path):
        quoted = lines().withColumn("value", F.when(F.contains("value", F.lit('"')), F.col("value")))
        maps = materialize(quoted.mapInArrow(_state_maps, _MAPS))
        inside = materialize(entry_states(maps))
        # at most MOST_RANGES rows (see _pinned)
        met = lines().join(F.broadcast(inside), ["file", "begin"], "left").select("file", "begin", "owner", "value")
        cut = materialize(met.mapInArrow(_cut, _RECORDS))
    whole = cut.filter("whole").select("file", "begin", "place", "record")
    # one record a group
    parts = F.transform(F.array_sort(F.collect_list(F.struct("part", "record"))), lambda x: x["record"])
    joined = (cut.filter("not whole").groupBy("file", "begin").agg(F.max("place").alias("place"), F.array_join(parts, "\n").alias("record"))
              .filter("place >= 0"))
    return whole.unionByName(joined.withColumn("record", F.regexp_replace("record", r"\r$", "")))


def parsed(records: DataFrame, schema: T.StructType, typed: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """The cells of ``record`` by position; ``typed``: cast to the schema, malformed values null, else as text."""
    as_text = ", ".join(f"`{f.name}` STRING" for f in schema.fields)
    cells = F.from_csv("record", as_text, {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"})
    rows = records.select(*keep, cells.alias("cells"))
    return rows.select(*keep, *[
        (F.col("cells").getField(f.name).try_cast(f.dataType) if typed else F.col("cells").getField(f.name)).alias(f.name)
        for f in schema.fields])


class _Member(InputPartition):
    def __init__(self, uri: str, name: str):
        self.uri, self.name = uri, name


class _ZipReader(DataSourceReader):
    def __init__(self, uris: list[str], pattern: str):
        self.uris, self.pattern = uris, re.compile(pattern)

    def partitions(self) -> list[InputPartition]:
        """One a member; only the archives' directories are read here."""
        found = []
        for uri in self.uris:
            with _opened(uri) as archive:
                found += [_Member(uri, i.filename) for i in archive.infolist() if not i.is_dir() and self.pattern.search(i.filename)]
        return found

    def read(self, partition: _Member) -> Iterator[pa.RecordBatch]:
        """The member is unpacked as a stream; at most HELD characters and one record are in memory."""
        cutter, rows, held = Cutter(), [], 0

        def given() -> pa.RecordBatch:
            places, records = zip(*rows)
            return pa.RecordBatch.from_arrays([
                pa.array([f"{partition.uri}!/{partition.name}"] * len(rows), pa.string()), pa.array([0] * len(rows), pa.int64()),
                pa.array(places, pa.int64()), pa.array(records, pa.string())], names=["file", "begin", "place", "record"])
        with _opened(partition.uri) as archive, archive.open(partition.name) as member:
            for line in io.TextIOWrapper(member, encoding="utf-8-sig", errors="replace", newline="\n"):
                found = cutter.line(line.removesuffix("\n"))
                if found and found[0] >= 0:
                    rows.append(found)
                    held += len(found[1])
                    if held >= HELD:
                        yield given()
                        rows, held = [], 0
            if (found := cutter.rest()) and found[0] >= 0:
                rows.append(found)
        if rows:
            yield given()


@contextlib.contextmanager
def _opened(uri: str) -> Iterator[zipfile.ZipFile]:
    store, path = filesystem(uri)
    with store.open_input_file(path) as source, zipfile.ZipFile(pa.PythonFile(source, "r") if not hasattr(source, "seekable") else source) as archive:
        yield archive


class ZipRecords(DataSource):
    """Records of the CSV members of zip archives: options ``uris`` (JSON list), ``pattern`` (of member names)."""

    @classmethod
    def name(cls) -> str:
        return "presslens_zip"

    def schema(self) -> str:
        return "file string, begin long, place long, record string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ZipReader(json.loads(self.options["uris"]), self.options.get("pattern", r"\.csv$"))


def read_zip_records(spark: SparkSession, path: str | list[str], pattern: str = r"\.csv$") -> DataFrame:
    """As ``read_records`` for the members of zip archives whose names match; a member is one task (deflate has no
    places to begin at), streamed."""
    listed = spark.read.format("binaryFile").load(path).select("path").collect()  # names of archives, not their contents
    spark.dataSource.register(ZipRecords)
    return (spark.read.format("presslens_zip").option("uris", json.dumps(sorted(r["path"] for r in listed)))
            .option("pattern", pattern).load())
