"""Two files, two availableNow runs -> batch result; a third adds nothing. S2: chunks of rows, continued after an end."""

from pyspark.sql import functions as F

from presslens import fixtures as fx
from presslens.registry.q_sources import FIXTURE_SCHEMA, _raw
from presslens.sources import io as IO
from presslens.streaming.ingest import chunk_stream, clean_raw, ingest_stream, stage_chunks


def test_incremental_ingest(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    src = IO.scratch_path(spark, "incoming")
    target, ckpt = IO.scratch_path(spark, "raw"), IO.scratch_path(spark, "ckpt")
    first = raw.filter("article_id % 2 = 0")
    second = raw.filter("article_id % 2 = 1")
    IO.write_csv(first.coalesce(1), src + "/part1", mode="overwrite")
    ingest_stream(spark, src + "/*", target, ckpt, FIXTURE_SCHEMA)
    n1 = spark.read.parquet(target).count()
    IO.write_csv(second.coalesce(1), src + "/part2", mode="overwrite")
    ingest_stream(spark, src + "/*", target, ckpt, FIXTURE_SCHEMA)
    got = spark.read.parquet(target)
    assert n1 == first.count()
    expected = clean_raw(IO.read_articles_csv(spark, src + "/*", FIXTURE_SCHEMA)
                         .select(*[c for c in FIXTURE_SCHEMA.fieldNames()]), FIXTURE_SCHEMA)
    assert got.count() == raw.count()
    assert got.exceptAll(expected).count() == 0
    ingest_stream(spark, src + "/*", target, ckpt, FIXTURE_SCHEMA)
    assert spark.read.parquet(target).count() == raw.count()


def _chunks(spark, target):
    return sorted(r["count"] for r in spark.read.parquet(target).groupBy(F.input_file_name()).count().collect())


def test_chunks_have_the_stated_number_of_rows(spark, sf_dir):
    """One large file and a small one: chunks end inside files, each micro-batch adds one chunk."""
    raw = _raw(spark, sf_dir)
    src, target, ckpt = (IO.scratch_path(spark, x) for x in ("incoming", "raw", "ckpt"))
    IO.write_csv(raw.filter("article_id >= 150").coalesce(1), src + "/a")
    IO.write_csv(raw.filter("article_id < 150").coalesce(1), src + "/b")
    q = ingest_stream(spark, src + "/*/*.csv", target, ckpt, FIXTURE_SCHEMA, rows_per_chunk=128)
    got = spark.read.parquet(target)
    n = raw.count()
    assert [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [128] * (n // 128) + [n % 128]
    assert got.count() == n and got.select("article_id").distinct().count() == n


def test_a_run_that_ends_between_chunks_is_continued(spark, sf_dir):
    raw = _raw(spark, sf_dir)
    src, target, ckpt = (IO.scratch_path(spark, x) for x in ("incoming", "raw", "ckpt"))
    IO.write_csv(raw.coalesce(1), src)
    stage_chunks(spark, src + "/*.csv", ckpt + "/queue", ckpt, 100, None)
    q = chunk_stream(spark, ckpt + "/queue", target, ckpt, FIXTURE_SCHEMA)
    while not q.recentProgress:
        q.awaitTermination(0.02)
    q.stop()
    done = spark.read.parquet(target).count()
    assert 0 < done <= raw.count()
    ingest_stream(spark, src + "/*.csv", target, ckpt, FIXTURE_SCHEMA, rows_per_chunk=100)
    got = spark.read.parquet(target)
    assert got.count() == raw.count() == got.select("article_id").distinct().count()


def test_small_chunks_are_appended_in_numbers_a_file_each(spark, sf_dir):
    """Micro-batches of several chunks; every chunk is still a file of its own in the table."""
    raw = _raw(spark, sf_dir)
    src, target, ckpt = (IO.scratch_path(spark, x) for x in ("incoming", "raw", "ckpt"))
    IO.write_csv(raw.coalesce(2), src)
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    q = ingest_stream(spark, src, target, ckpt, FIXTURE_SCHEMA, rows_per_chunk=60, chunks_per_batch=8)
    n = raw.count()
    assert spark.conf.get("spark.sql.files.openCostInBytes") == before
    assert [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [480] * (n // 480) + [n % 480]
    assert _chunks(spark, target) == sorted([60] * (n // 60) + [n % 60])
    assert spark.read.parquet(target).select("article_id").distinct().count() == n


def test_chunked_append_takes_more_than_one_chunk_a_micro_batch(spark, sf_dir, monkeypatch):
    from presslens.registry import q_sources
    runs = []
    monkeypatch.setattr(q_sources, "ingest_stream", lambda *a, **b: runs.append(ingest_stream(*a, **b)))
    got = q_sources.s2_chunked_append(spark, sf_dir)
    n = _raw(spark, sf_dir).count()
    assert [p["numInputRows"] for p in runs[0].recentProgress if p["numInputRows"]] == [n]
    assert got.count() == n and _chunks_of(got) == sorted([300] * (n // 300) + [n % 300])


def test_ingest_of_large_input_reads_more_files(spark, sf_dir, monkeypatch):
    from presslens.registry import q_sources
    size = IO.stored_bytes(spark, f"{sf_dir}/documents.parquet")
    assert q_sources._files(spark, sf_dir, 2) == 2
    monkeypatch.setattr(q_sources, "FILE_BYTES", size // 5)
    sources = []
    monkeypatch.setattr(q_sources, "ingest_stream", lambda spark, src, *a, **b: (sources.append(src), ingest_stream(spark, src, *a, **b)))
    got = q_sources.t1_incremental_ingest(spark, sf_dir)
    assert IO.list_files(spark, sources[0], r"\.csv$").count() == 6
    assert got.count() == _raw(spark, sf_dir).count() == got.select("article_id").distinct().count()


def test_file_reads_of_large_input_write_and_read_more_files(spark, sf_dir, monkeypatch):
    """The shares of the files that are read stay: all, half, and those of two of five parts."""
    from presslens.registry import q_sources
    monkeypatch.setattr(q_sources, "FILE_BYTES", IO.stored_bytes(spark, f"{sf_dir}/documents.parquet") // 15)
    raw = _raw(spark, sf_dir).select("article_id")
    files = lambda df: df.select("_metadata.file_path").distinct().count()
    got = q_sources.s4_file_read_all(spark, sf_dir)
    assert len(got.inputFiles()) == 16 and sorted(got.select("article_id").collect()) == sorted(raw.collect())
    got = q_sources.s4_limited_file_read(spark, sf_dir)
    assert files(got) == 8 and 0 < got.count() < raw.count()
    got = q_sources.s4_first_files(spark, sf_dir)
    assert len(got.inputFiles()) > 10
    assert sorted(got.select("article_id").collect()) == sorted(raw.filter("article_id % 5 < 2").collect())


def _chunks_of(df):
    return sorted(r["count"] for r in df.groupBy(F.input_file_name()).count().collect())
