"""Incremental ingest of article CSV files into the raw layer, in chunks of a stated number of rows.

Two streams, each with its own checkpoint below one folder:

1. Files. A file-source stream lists new files (names only, no contents). Each
   micro-batch reads its files with ``quoted_csv``, so one large file is many
   tasks, numbers the records by file and place, and writes chunks of
   ``rows_per_chunk`` records, a file a chunk, to the batch's own folder. A
   batch that runs again overwrites that folder.
2. Chunks. A stream over those files admits ``chunks_per_batch`` chunks a
   micro-batch (one, if not stated), cleans them (N1-N3, N5) and appends them to
   the table through the file sink, a task and a file a chunk, so a chunk is in
   the table exactly once; a run that ends between two micro-batches is continued
   by the next from the checkpoint. Small chunks are admitted in numbers, as the
   time of a micro-batch hardly falls with its rows.

Numbers come from the counts of the ranges (a row a range), not from a sort of
the records. The chunk files are the queue between the streams; they can be
expired with the checkpoint's folder once the second stream has passed them.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import normalise_nulls
from ..schema import RAW_SCHEMA
from ..session import materialize
from ..sources import quoted_csv

ROWS_PER_CHUNK = 50_000  # fixed value of the reference's ingest
#: Bytes of a row group of a chunk file: a large chunk is read by several tasks.
CHUNK_GROUP = 16 << 20
_FILES = "path string, modificationTime timestamp, length long, content binary"
_CHUNKS = "file string, number long, record string, batch long, chunk long"


def clean_raw(df: DataFrame, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Text columns -> declared types (malformed -> null), then N1-N3."""
    return normalise_nulls(df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields]))


def numbered(records: DataFrame) -> DataFrame:
    """``number`` 0.. of records (file, begin, place, record) in the order of files, ranges and places."""
    sizes = records.groupBy("file", "begin").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    earlier = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.withColumn("in_file", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # a row a file of the batch
    files = sizes.groupBy("file").agg(F.sum("n").alias("n_file")).withColumn("before", F.coalesce(
        F.sum("n_file").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = materialize(ranges.join(files, "file").select("file", "begin", (F.col("in_file") + F.col("before") - F.col("first")).alias("start")))
    # a row a range: at most quoted_csv.MOST_RANGES besides one a file
    return records.join(F.broadcast(start), ["file", "begin"]).select("file", (F.col("start") + F.col("place")).alias("number"), "record")


def write_chunks(records: DataFrame, path: str, rows_per_chunk: int) -> None:
    """``records`` in files of ``rows_per_chunk`` below ``path``/chunk=..., the last of fewer."""
    chunk = F.floor(F.col("number") / rows_per_chunk).cast("long")
    (numbered(records).withColumn("chunk", chunk).repartition("chunk").sortWithinPartitions("chunk", "number")
     .write.mode("overwrite").option("parquet.block.size", CHUNK_GROUP).partitionBy("chunk").parquet(path))


def stage_chunks(spark: SparkSession, source: str, queue: str, checkpoint: str, rows_per_chunk: int,
                 max_files_per_trigger: int | None) -> None:
    """The first stream: files not seen yet -> chunk files."""
    files = spark.readStream.format("binaryFile").schema(_FILES)
    if max_files_per_trigger:
        files = files.option("maxFilesPerTrigger", max_files_per_trigger)

    def admitted(batch: DataFrame, number: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # names of the batch's files
        if paths:
            write_chunks(quoted_csv.read_records(batch.sparkSession, paths), f"{queue}/batch={number}", rows_per_chunk)
    q = (files.load(source).select("path").writeStream.foreachBatch(admitted)
         .option("checkpointLocation", f"{checkpoint}/files").trigger(availableNow=True).start())
    q.awaitTermination()


def ingest_stream(spark: SparkSession, source_dir: str, target_path: str, checkpoint_path: str,
                  schema: T.StructType = RAW_SCHEMA, max_files_per_trigger: int | None = None,
                  rows_per_chunk: int = ROWS_PER_CHUNK, chunks_per_batch: int = 1):
    """Ingest what is new below ``source_dir``; returns the finished stream over the chunks."""
    queue, checkpoint = f"{checkpoint_path}/queue", checkpoint_path
    spark._jvm.org.apache.hadoop.fs.Path(queue).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(
        spark._jvm.org.apache.hadoop.fs.Path(queue))
    stage_chunks(spark, source_dir, queue, checkpoint, rows_per_chunk, max_files_per_trigger)
    q = chunk_stream(spark, queue, target_path, checkpoint, schema, chunks_per_batch)
    q.awaitTermination()
    return q


def chunk_stream(spark: SparkSession, queue: str, target_path: str, checkpoint: str, schema: T.StructType = RAW_SCHEMA,
                 chunks_per_batch: int = 1):
    """The second stream: ``chunks_per_batch`` chunks a micro-batch -> the table."""
    chunks = spark.readStream.schema(_CHUNKS).option("maxFilesPerTrigger", chunks_per_batch).option("basePath", queue).parquet(queue)
    out = (clean_raw(quoted_csv.parsed(chunks, schema, typed=False), schema).writeStream.format("parquet").outputMode("append")
           .option("checkpointLocation", f"{checkpoint}/chunks").trigger(availableNow=True))
    with _file_a_task(spark) if chunks_per_batch > 1 else contextlib.nullcontext():  # the stream keeps the settings it begins with
        return out.start(target_path)


@contextlib.contextmanager
def _file_a_task(spark: SparkSession):
    """Files of a scan are not put together in a task: to open one counts as a whole task's share."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, str(int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())))
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)
