"""Table sources and sinks.

A catalog is a base path with one folder per layer (``raw``, ``text_eda``,
``simple_topic``) and one Parquet table per folder. Writes enforce the
declared schema; reads never infer one.
"""

from __future__ import annotations

import shutil
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LAYER_SCHEMAS
from ..session import checkpoint_dir, filesystem, qualified
from . import quoted_csv

TABLE_SUFFIX = ".parquet"
EXPORT_COLUMNS = ("date", "publication", "author", "title", "section", "simple_topic")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/presslens-scratch/{name}-{uuid.uuid4().hex}"


def table_path(base: str, layer: str, table: str) -> str:
    if not table.endswith(TABLE_SUFFIX):
        table = table + TABLE_SUFFIX
    return f"{base.rstrip('/')}/catalog/{layer}/{table}"


def read_articles_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None) -> DataFrame:
    """CSV with header, ``"`` quoting (doubled quotes inside), UTF-8 and
    multi-line cells, read against a declared schema (all columns as text,
    then ``try_cast`` so malformed values become null instead of failing).
    A file is read by as many tasks as it has ranges (``quoted_csv``)."""
    return quoted_csv.parsed(quoted_csv.read_records(spark, path), schema or LAYER_SCHEMAS["raw"])


def read_articles_zip(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None,
                      pattern: str = r"\.csv$", partitions: int | None = None) -> DataFrame:
    """The same from the members of zip archives, each streamed by one task.
    ``partitions`` deals the records out to that many before they are parsed."""
    records = quoted_csv.read_zip_records(spark, path, pattern)
    return quoted_csv.parsed(records.repartition(partitions) if partitions else records, schema or LAYER_SCHEMAS["raw"])


def read_table(spark: SparkSession, base: str, layer: str, table: str) -> DataFrame:
    """S3: read a catalog table (suffix added when missing)."""
    return spark.read.parquet(table_path(base, layer, table))


def conform(df: DataFrame, schema: T.StructType, extra: Sequence[str] = ()) -> DataFrame:
    """Select and cast to ``schema``; a missing column is an error."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing for the declared schema: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], *extra)


def write_table(df: DataFrame, base: str, layer: str, table: str, schema: T.StructType | None = None,
                mode: str = "append", partition_by: Sequence[str] | None = None,
                slices: int | None = None, extra: Sequence[str] = ()) -> str:
    """S5 (+S6): write with the declared schema, append by default; with
    ``slices`` the output is repartitioned into that many files."""
    out = conform(df, schema or LAYER_SCHEMAS[layer], extra)
    if slices:
        out = out.repartition(slices)
    w = out.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    path = table_path(base, layer, table)
    w.parquet(path)
    return path


def balanced_slices(df: DataFrame, n: int) -> DataFrame:
    """Exactly ``n`` roughly equal slices (round-robin repartition)."""
    return df.repartition(n)


def slice_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("slice")).agg(F.count(F.lit(1)).alias("rows"))


def clear_table(spark: SparkSession, base: str, layer: str, table: str) -> bool:
    """Delete a table's files; a missing table is ignored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(base, layer, table))
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())  # the one that Spark writes to
    return store.exists(path) and store.delete(path, True)


def read_files(spark: SparkSession, path: str, n: int | None = None, shuffle: bool = False,
               seed: int = 42) -> DataFrame:
    """Read the first ``n`` data files of a table (all when ``n`` is
    None or larger than the file count) by path, or in a seeded random order.

    Files are ranked as rows of their own (no data column is read); the driver
    gets the ``n`` paths, and the filter on the files' path prunes the scan, so
    other files are not opened. Files without rows are not counted."""
    df = spark.read.parquet(path)
    if n is None:
        return df
    file = F.col("_metadata.file_path")
    listed = df.select(file.alias("file")).distinct()
    order = [F.xxhash64(F.lit(seed), "file"), F.col("file")] if shuffle else [F.col("file")]
    chosen = [r["file"] for r in listed.orderBy(*order).limit(n).collect()]
    return df.filter(file.isin(chosen)) if chosen else df.limit(0)


def list_files(spark: SparkSession, location: str, pattern: str = ".*", recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of files under ``location``
    whose path matches ``pattern``; file contents are never read."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
          .load(location).select("path", "length", "modificationTime"))
    return df.filter(F.col("path").rlike(pattern))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a table, from the listing."""
    return list_files(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def profile(df: DataFrame) -> DataFrame:
    """Per column its type, non-null count and the row count, from one
    aggregate (unpivoted)."""
    aggs = [F.count(F.lit(1)).alias("__rows")] + [F.count(F.col(c)).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    long = wide.unpivot("__rows", df.columns, "column", "non_null")
    type_map = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(types[c]))])
    return long.select("column", type_map[F.col("column")].alias("type"), "non_null",
                       F.col("__rows").alias("rows"))


def labelled_export(df: DataFrame, drop_topic: str | None = None) -> DataFrame:
    """Rows with title, article and topic, without geography sections
    (``is_geo``, if the layer has it) and without one topic, six columns,
    sorted by date."""
    out = df.filter(~F.col("is_geo")) if "is_geo" in df.columns else df
    out = out.na.drop(subset=["title", "article", "simple_topic"])
    if drop_topic is not None:
        out = out.filter(F.col("simple_topic") != drop_topic)
    return out.select(*EXPORT_COLUMNS).orderBy("date")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def write_zip(spark: SparkSession, path: str, archive: str) -> str:
    """The CSV files below ``path`` as members of one zip archive, copied in pieces of 1 MiB."""
    members = sorted(r["path"] for r in list_files(spark, path, r"\.csv$").select("path").collect())
    store, inner = filesystem(qualified(spark, archive))
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    with store.open_output_stream(inner) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
        for member in members:
            own, place = filesystem(member)
            with own.open_input_stream(place) as data, packed.open(member.rpartition("/")[2], "w", force_zip64=True) as to:
                shutil.copyfileobj(data, to, 1 << 20)
    return archive


def write_reports(reports: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """One report folder per (experiment, model)."""
    reports.write.mode(mode).partitionBy("experiment", "model").format(fmt).save(path)
    return path
