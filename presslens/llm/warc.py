"""WARC archives: indexed writing, and reading by coalesced byte ranges.

Writing. Payload digests come from one pass over the pages; equal payloads of
at least ``min_bytes`` bytes share the page of least id, which is written as a
``response``, the others as ``revisit`` records without payload that refer to
it (WARC 1.1, profile identical-payload-digest). Each task then writes its
records as one archive, a gzip member a record, below a folder that all
machines share, and returns the index: file, offset, length, URL, digest, type
and reference of every record. The index is a table of its own and is complete
before any archive is read. A task that runs again writes another file; index
rows come from the attempt that Spark committed, so files of lost attempts are
never read.

Reading. Selected index rows are dealt by file and ``BLOCK`` bytes of offset
and sorted by offset in each task; ranges that lie at most ``GAP`` bytes apart
are read at once, up to ``MOST`` bytes. Every record is parsed, its lengths
are checked, and a response's payload must have the digest of its header.

Archives go through ``pyarrow.fs``: the folder may be on a shared disk or any
store that pyarrow opens by URI (hdfs, s3, gs ...). A folder without scheme is
the one that Spark resolves it to, not a folder of each machine.

Defined cases: a null payload is empty; a null id comes last among equal
payloads; rows that repeat the id and payload of a response are responses too;
null URLs are written as ``about:blank`` and read back as such; an empty table
gives an empty index and no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import filesystem, qualified, stage_path
from .util import join_by_key, stage

#: Bytes of a file that one reading task's group covers, and of one read at most.
BLOCK, MOST, GAP = 8 << 20, 4 << 20, 64 << 10
LEVEL = 4
#: Bytes after which a task begins another archive.
ROLL = 256 << 20
DATE = "2024-01-01T00:00:00Z"  # fixed value: capture date of all records, so that archives are the same in every run
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("file string, offset long, length long, url string, digest string, page_id {id}, record_type string, "
         "refers_to {id}, payload_bytes long")


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def record(page_id: object, url: str | None, payload: bytes, digest: str, refers_to: tuple[object] | None) -> bytes:
    """One record. ``refers_to``: the id of the response, in a tuple, for a revisit."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)),
            ("WARC-Date", DATE), ("WARC-Target-URI", " ".join((url or "about:blank").split())),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        head.append(("X-Page-Id", quote(str(page_id))))
    block = payload
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to[0], digest))]
        if refers_to[0] is not None:
            head.append(("X-Refers-To-Page-Id", quote(str(refers_to[0]))))
        block = b""
    head += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Parsed:
    head: dict[str, str]
    block: bytes


def parse(data: bytes) -> Parsed:
    top, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    size = int(head["Content-Length"])
    if not version.startswith("WARC/") or len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"broken record {head.get('WARC-Record-ID')}")
    return Parsed(head, rest[:size])


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _Archive:
    """An archive being written; its index rows are given out once the file is closed."""

    def __init__(self, folder: str):
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        self.uri, self.at = f"{folder}/{name}", 0
        self.out = store.open_output_stream(f"{path}/{name}", compression=None)  # members are compressed here
        self.index: list[pa.RecordBatch] = []

    def close(self) -> list[pa.RecordBatch]:
        self.out.close()
        return self.index


def _archived(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            if not batch.num_rows:
                continue
            archive = archive or _Archive(folder)
            digests = [base64.b32encode(bytes.fromhex(x)).decode() for x in batch.column("digest").to_pylist()]
            columns = [batch.column(c) for c in ("page_id", "url", "html", "is_revisit", "refers_to")]
            offsets, lengths, sizes = [], [], []
            for digest, page_id, url, html, is_revisit, refers_to in zip(digests, *[c.to_pylist() for c in columns]):
                payload = html or b""
                data = _member(record(page_id, url, payload, digest, (refers_to,) if is_revisit else None))
                archive.out.write(data)
                offsets.append(archive.at)
                lengths.append(len(data))
                sizes.append(len(payload))
                archive.at += len(data)
            kinds = ["revisit" if x else "response" for x in columns[3].to_pylist()]
            archive.index.append(pa.RecordBatch.from_arrays(
                [pa.array([archive.uri] * len(kinds), pa.string()), pa.array(offsets, pa.int64()),
                 pa.array(lengths, pa.int64()), columns[1], pa.array(digests, pa.string()), columns[0],
                 pa.array(kinds, pa.string()), columns[4], pa.array(sizes, pa.int64())],
                names=["file", "offset", "length", "url", "digest", "page_id", "record_type", "refers_to", "payload_bytes"]))
            if archive.at >= ROLL:
                yield from archive.close()
                archive = None
        if archive is not None:
            yield from archive.close()
    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id",
                   url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives below ``folder`` (a new stage folder by default); returns the index, itself written."""
    spark = pages.sparkSession
    folder = qualified(spark, folder or stage_path(spark))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").cast("binary").alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    rows = rows.withColumn("digest", F.sha1(F.coalesce("html", F.lit(b""))))
    digests = stage(rows.select("page_id", "digest", F.coalesce(F.octet_length("html"), F.lit(0)).alias("n_bytes")))
    total = digests.count()
    shared = stage(digests.filter(F.col("n_bytes") >= min_bytes).groupBy("digest")
                   .agg(F.count("*").alias("n"), F.min("page_id").alias("first_id")).filter(F.col("n") > 1))
    met = join_by_key(rows, shared, ["digest"], "n", total, ["page_id", "url"])
    is_revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    typed = met.select("page_id", "url", "html", "digest", is_revisit.alias("is_revisit"),
                       F.when(is_revisit, F.col("first_id")).alias("refers_to"))
    return stage(typed.mapInArrow(_archived(folder), INDEX.format(id=kind)))


def _read(with_payload: bool):
    """Records of index rows sorted by file and offset."""
    def records(file: str, ranges: list[tuple[int, int]]) -> Iterator[Parsed]:
        store, path = filesystem(file)
        with store.open_input_file(path) as source:
            k = 0
            while k < len(ranges):
                first, end = ranges[k][0], sum(ranges[k])
                n = k + 1
                while n < len(ranges) and ranges[n][0] - end <= GAP and sum(ranges[n]) - first <= MOST:
                    end = max(end, sum(ranges[n]))
                    n += 1
                data = source.read_at(end - first, first)
                for offset, length in ranges[k:n]:
                    yield parse(zlib.decompress(data[offset - first:offset - first + length], 31))
                k = n

    def row(r: Parsed) -> tuple:
        digest = r.head["WARC-Payload-Digest"].removeprefix("sha1:")
        size = int(r.head["X-Payload-Length"])
        is_response = r.head["WARC-Type"] == "response"
        if is_response and (len(r.block) != size or sha1(r.block) != digest):
            raise ValueError(f"payload of {r.head['WARC-Record-ID']} is not what its header says")
        page_id, refers_to = (None if (x := r.head.get(k)) is None else unquote(x)
                              for k in ("X-Page-Id", "X-Refers-To-Page-Id"))
        return (page_id, r.head["WARC-Target-URI"], r.head["WARC-Type"], digest, size, refers_to,
                r.block if with_payload and is_response else None)

    names = ("page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload")
    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("file").to_pylist()
            ranges = list(zip(batch.column("offset").to_pylist(), batch.column("length").to_pylist()))
            k = 0
            while k < len(files):
                n = k
                while n < len(files) and files[n] == files[k]:
                    n += 1
                rows, held = [], 0
                for r in records(files[k], ranges[k:n]):
                    rows.append(row(r))
                    held += len(r.block) if with_payload else 0
                    if held > MOST:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)
                k = n
    return run


def read_archives(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the rows of ``index`` (any selection of it) point at:
    page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload (null for revisits)."""
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    n = max(spark.sparkContext.defaultParallelism, -(-total // BLOCK))
    kind = index.schema["page_id"].dataType.simpleString()
    dealt = (index.select("file", "offset", "length").repartition(n, "file", F.floor(F.col("offset") / BLOCK))
             .sortWithinPartitions("file", "offset"))
    found = dealt.mapInArrow(_read(with_payload), "page_id string, url string, record_type string, "
                             "payload_digest string, payload_bytes long, refers_to string, payload binary")
    return found.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
