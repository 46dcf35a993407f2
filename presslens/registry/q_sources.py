"""Sources, sinks and the incremental ingest stream.

Round trips write the fixture articles below the session's checkpoint
folder (shared storage on a cluster) and read them back.
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures as fx
from ..operators import clean as N
from ..plans import features as FE
from ..schema import RAW_FIELDS
from ..sources import io as IO
from ..streaming.ingest import ROWS_PER_CHUNK, ingest_stream
from . import duck as D
from . import register
from .q_models import REPORT_SQL, _pred

W = fx.sql_with
NORM = W("articles") + ", " + D.normalised_articles_cte() + "\n"
FIXTURE_SCHEMA = T.StructType([T.StructField("article_id", T.LongType(), True)]
                              + [T.StructField(n, t, True) for n, t in RAW_FIELDS])
RAW_COLS = "article_id, " + ", ".join(n for n, _ in RAW_FIELDS)


def _raw(spark, sf):
    return fx.articles(spark, sf).select(*FIXTURE_SCHEMA.fieldNames())


#: Bytes of the documents table that a written file stands for at most.
FILE_BYTES = 64 << 20


def _files(spark, sf, least):
    """Files to write the articles in: ``least``, or as many times that as large input needs."""
    return least * max(1, -(-IO.stored_bytes(spark, f"{sf}/documents.parquet") // (least * FILE_BYTES)))


@register("s1_csv_source", W("articles") + f"SELECT {RAW_COLS} FROM articles")
def s1_csv_source(spark, sf):
    path = IO.write_csv(_raw(spark, sf), IO.scratch_path(spark, "csv"))
    return IO.read_articles_csv(spark, path, FIXTURE_SCHEMA)


@register("s5_table_write_read", W("articles") + f"SELECT {RAW_COLS} FROM articles")
def s5_table_write_read(spark, sf):
    base = IO.scratch_path(spark, "catalog")
    IO.write_table(_raw(spark, sf), base, "raw", "articles", FIXTURE_SCHEMA, mode="append",
                   partition_by=["year"])
    return IO.read_table(spark, base, "raw", "articles").select(*FIXTURE_SCHEMA.fieldNames())


@register("s3_table_read_suffix", W("articles") + f"SELECT {RAW_COLS} FROM articles")
def s3_table_read_suffix(spark, sf):
    base = IO.scratch_path(spark, "catalog")
    IO.write_table(_raw(spark, sf), base, "raw", "articles.parquet", FIXTURE_SCHEMA, mode="overwrite")
    return IO.read_table(spark, base, "raw", "articles").select(*FIXTURE_SCHEMA.fieldNames())


@register("s7_clear_then_append", W("articles") + f"SELECT {RAW_COLS} FROM articles")
def s7_clear_then_append(spark, sf):
    base = IO.scratch_path(spark, "catalog")
    IO.write_table(_raw(spark, sf), base, "raw", "articles", FIXTURE_SCHEMA)
    IO.clear_table(spark, base, "raw", "articles")
    IO.clear_table(spark, base, "raw", "missing_table")  # ignored
    IO.write_table(_raw(spark, sf), base, "raw", "articles", FIXTURE_SCHEMA)
    return IO.read_table(spark, base, "raw", "articles")


@register("s4_file_read_all", W("articles") + f"SELECT {RAW_COLS} FROM articles")
def s4_file_read_all(spark, sf):
    """More files asked for than there are (9 of 4 in a small table): the whole table, whatever the order."""
    path, files = IO.scratch_path(spark, "files"), _files(spark, sf, 4)
    _raw(spark, sf).repartition(files).write.parquet(path)
    return IO.read_files(spark, path, n=2 * files + 1, shuffle=True, seed=7).select(*FIXTURE_SCHEMA.fieldNames())


@register("s4_limited_file_read")
def s4_limited_file_read(spark, sf):
    """Half of the files (2 of 4 in a small table)."""
    path, files = IO.scratch_path(spark, "files"), _files(spark, sf, 4)
    _raw(spark, sf).repartition(files).write.parquet(path)
    return IO.read_files(spark, path, n=files // 2, shuffle=True, seed=7)


@register("s4_first_files", W("articles") + f"SELECT {RAW_COLS} FROM articles WHERE article_id % 5 < 2")
def s4_first_files(spark, sf):
    """The files of two of five parts, in the order of their paths; a part of a small table is one file."""
    path, slices = IO.scratch_path(spark, "files"), _files(spark, sf, 5) // 5
    raw = _raw(spark, sf).withColumns({"part": F.col("article_id") % 5,
                                       "slice": F.pmod(F.xxhash64("article_id", "url", "title"), F.lit(slices))})
    raw.repartition("part", "slice").write.partitionBy("part", "slice").parquet(path)
    files = IO.list_files(spark, path, r"\.parquet$").groupBy(F.regexp_extract("path", "/part=([^/]*)/", 1).alias("part")).count()
    n = files.orderBy("part").limit(2).agg(F.sum("count")).first()[0]
    return IO.read_files(spark, path, n=n).select(*FIXTURE_SCHEMA.fieldNames())


@register("s6_balanced_slices", W("articles") + "SELECT CAST(25 AS BIGINT) AS slices, count(*) AS rows FROM articles")
def s6_balanced_slices(spark, sf):
    sizes = IO.slice_sizes(IO.balanced_slices(_raw(spark, sf), 25))
    return sizes.agg(F.count("slice").alias("slices"), F.sum("rows").alias("rows"))


@register("s8_file_inventory")
def s8_file_inventory(spark, sf):
    return IO.list_files(spark, sf, r".*\.parquet$")


def _profile_sql():
    parts = []
    types = {"article_id": "bigint", "date": "date", "year": "bigint", "month": "bigint", "day": "bigint"}
    for c in FIXTURE_SCHEMA.fieldNames():
        parts.append(f"SELECT '{c}' AS \"column\", '{types.get(c, 'string')}' AS type, count({c}) AS non_null, "
                     f"count(*) AS rows FROM articles")
    return W("articles") + "\nUNION ALL ".join(parts)


@register("s9_profile", _profile_sql())
def s9_profile(spark, sf):
    return IO.profile(_raw(spark, sf))


@register("s10_labelled_export", NORM + """
SELECT date, publication, author, title, section, simple_topic FROM narticles
WHERE title IS NOT NULL AND article IS NOT NULL AND simple_topic IS NOT NULL AND simple_topic <> '5-LOW'
  AND section IS DISTINCT FROM 'U.S.'""")
def s10_labelled_export(spark, sf):
    """The exported CSV, read back."""
    a = N.empty_to_null(N.text_null_fix(fx.articles(spark, sf)))
    a = a.withColumn("is_geo", F.coalesce(F.col("section") == "U.S.", F.lit(False)))
    out = IO.labelled_export(a, drop_topic="5-LOW")
    path = IO.write_csv(out, IO.scratch_path(spark, "export"))
    return IO.read_articles_csv(spark, path, out.schema)


@register("s11_report_sink", REPORT_SQL + "SELECT *, 'labels_parity' AS experiment, 'parity' AS model FROM report")
def s11_report_sink(spark, sf):
    rep = FE.classification_report(_pred(spark, sf)).select(
        F.lit("labels_parity").alias("experiment"), F.lit("parity").alias("model"), "*")
    path = IO.write_reports(rep, IO.scratch_path(spark, "reports"))
    return spark.read.parquet(path)


@register("t1_incremental_ingest", NORM + f"SELECT {RAW_COLS} FROM narticles")
def t1_incremental_ingest(spark, sf):
    """Two new files, or as many times that as large input needs."""
    src = IO.scratch_path(spark, "incoming")
    IO.write_csv(_raw(spark, sf).repartition(_files(spark, sf, 2)), src)
    target, ckpt = IO.scratch_path(spark, "raw"), IO.scratch_path(spark, "stream-ckpt")
    ingest_stream(spark, src, target, ckpt, FIXTURE_SCHEMA)
    return spark.read.parquet(target)


@register("s2_chunked_append", NORM + f"SELECT {RAW_COLS} FROM narticles")
def s2_chunked_append(spark, sf):
    """Chunked append: two files or more, cut into chunks of 300 rows that end in the middle of files. A
    micro-batch takes as many of these small chunks as make up one of the usual size."""
    src = IO.scratch_path(spark, "incoming")
    IO.write_csv(_raw(spark, sf).repartition(_files(spark, sf, 2)), src)
    target, ckpt = IO.scratch_path(spark, "raw"), IO.scratch_path(spark, "stream-ckpt")
    ingest_stream(spark, src, target, ckpt, FIXTURE_SCHEMA, rows_per_chunk=300, chunks_per_batch=ROWS_PER_CHUNK // 300)
    return spark.read.parquet(target)


@register("s1_zip_source", W("articles") + f"SELECT {RAW_COLS} FROM articles")
def s1_zip_source(spark, sf):
    """The CSV files of the fixture as members of one archive."""
    path = IO.write_csv(_raw(spark, sf), IO.scratch_path(spark, "csv"))
    archive = IO.write_zip(spark, path, f"{IO.scratch_path(spark, 'zip')}/articles.zip")
    return IO.read_articles_zip(spark, archive, FIXTURE_SCHEMA)
