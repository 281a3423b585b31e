"""Deterministic sharded WARC writing, and reading back.

Records are range-sorted by page_id, in shards whose bounds are told from exact counts, never from samples, and written one gzip member each to files that roll at a compressed size. Headers and
digests are made anew from the rows: record ids are UUIDs of the page, dates are a parameter, so the same rows give the
same bytes. Of records with equal payloads of at least ``REVISIT_BYTES`` the one with the smallest page_id is a response
and the others are revisits that name it.

Tasks write to temporary names that hold their attempt; the rows they return, a manifest, are a table in the shared folder
before anything else happens, so files of lost or repeated attempts are in no manifest. Only files of the manifest get
their last name, each by one rename that may be done twice; a commit marker with the manifest comes last, and readers
take only what the manifest lists. Names hold the shard and file number, and the manifest the size and SHA-256.

Null html is an empty payload; a null url is an empty target. Rows that repeat a page_id are each a record; equal payloads
under the smallest page_id are all responses. A null page_id comes last and is never referred to unless all are null, when
it is a response. Files go through pyarrow's file systems, so the folder may be in any store that it knows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scope, new_folder, salted_join

REVISIT_BYTES = 100
#: A file is closed once it has this many compressed bytes.
ROLL_BYTES = 16 << 20
#: Compressed bytes that are read at once.
PIECE = 1 << 14
DATE = "2024-01-01T00:00:00Z"
_SPACE = uuid.UUID("6f1c9c3e-6a8e-5d0e-9d8b-2f4f6f5f7a10")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def _target(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP headers alone, with the payload's true length and digest."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {_target(url)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"WARC-Refers-To-Page: {refers_to}"]
    lines += [f"WARC-Page: {'' if page_id is None else page_id}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


_MANIFEST = pa.schema([("shard", pa.int32()), ("number", pa.int32()), ("temporary", pa.string()), ("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_page", pa.int64()), ("last_page", pa.int64())])
_MANIFEST_SQL = "shard int, number int, temporary string, name string, records long, bytes long, sha256 string, first_page long, last_page long"


def _write(folder: str, roll: int, date: str):
    def run(batches):
        system, root = _file_system(folder)
        shard, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        system.create_dir(f"{root}/_temporary", recursive=True)
        out, number, done = None, 0, []

        def close():
            nonlocal out, number
            out["stream"].close()
            done.append((shard, number, out["temporary"], f"part-{shard:05d}-{number:05d}.warc.gz", out["records"], out["bytes"], out["hash"].hexdigest(), out["first"], out["last"]))
            out, number = None, number + 1

        mark = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["refers_to"] is not None:
                    mark = row
                    continue
                refers_to = mark["refers_to"] if mark and (mark["page_id"], mark["digest"]) == (row["page_id"], row["digest"]) else None
                member = gzip.compress(record(row["page_id"], row["url"], row["html"].encode(), row["digest"], refers_to, date), 6, mtime=0)
                if out and out["bytes"] + len(member) > roll:
                    close()
                if not out:
                    temporary = f"_temporary/{shard:05d}-{number:05d}-{attempt}"
                    out = {"temporary": temporary, "stream": system.open_output_stream(f"{root}/{temporary}", compression=None), "records": 0, "bytes": 0, "hash": hashlib.sha256(), "first": row["page_id"], "last": None}
                out["stream"].write(member)
                out["hash"].update(member)
                out["records"] += 1
                out["bytes"] += len(member)
                out["last"] = row["page_id"]
        if out:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _MANIFEST)] if done else [pa.array([], f.type) for f in _MANIFEST], schema=_MANIFEST)

    return run


def _rename(folder: str):
    def run(batches):
        from pyarrow import fs

        system, root = _file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    system.move(f"{root}/{row['temporary']}", f"{root}/{row['name']}")
                except OSError:  # an attempt before this one may have done it
                    if system.get_file_info(f"{root}/{row['name']}").type != fs.FileType.File:
                        raise
            yield batch

    return run


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest and refers_to of the pages whose payload an earlier page has.

    The smallest page_id of each payload is an aggregate that Spark combines before the shuffle; only payloads that occur
    twice are joined back, by digest and salt, so a payload that a third of all pages share is no single task's."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.where(F.octet_length(html) >= REVISIT_BYTES).select(F.col("page_id").cast("long").alias("page_id"), F.unhex(F.sha2(html, 256)).alias("key"))
    firsts = keyed.groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    later = salted_join(keyed.where("page_id is not null"), firsts, ["key"], "page_id").where("page_id > first")
    return later.select("page_id", F.lower(F.hex("key")).alias("digest"), F.col("first").alias("refers_to")).distinct()


#: Pages in a shard, the most shards, the ranges of page_id that are counted at first, and bits by which they get finer.
SHARD_PAGES, MOST_SHARDS, RANGES, FINER = 8192, 20000, 4096, 6


def shard_table(ids: DataFrame, shards: int | None) -> tuple[int, list[tuple[int, int, int]]]:
    """(shards, ranges) from a table of page_ids: each (range, shift, shard) holds the page_ids that agree with it beyond the
    lowest ``shift`` bits. Ranges with more pages than a shard should have are counted again in finer ones, so the driver gets
    RANGES rows, and 64 for each range that is too large, of which there are no more than shards. A single page_id is never
    parted."""
    low, high, total = ids.agg(F.min("page_id"), F.max("page_id"), F.count("page_id")).first()
    if not total:
        return shards or 1, []
    shards = shards or min(MOST_SHARDS, -(-total // SHARD_PAGES))
    shift = max(0, (high - low).bit_length() - RANGES.bit_length() + 1)
    count = lambda df, k: [(r.range, k, r.n) for r in df.groupBy(F.shiftright("page_id", k).alias("range")).agg(F.count("*").alias("n")).collect()]
    ranges = count(ids.where("page_id is not null"), shift)
    while heavy := {(r, k) for r, k, n in ranges if k and n * shards > total}:
        # all of them are of the round before, so of one shift
        shift = min(k for _, k in heavy)
        inside = ids.where(F.shiftright("page_id", shift).isin([r for r, _ in heavy]))
        ranges = [x for x in ranges if x[:2] not in heavy] + count(inside, max(0, shift - FINER))
    out, upto = [], 0
    for r, k, n in sorted(ranges, key=lambda x: x[0] << x[1]):
        out.append((r, k, min(shards - 1, upto * shards // total)))
        upto += n
    return shards, out


def write_warc(pages: DataFrame, folder: str, shards: int | None = None, roll: int = ROLL_BYTES, date: str = DATE) -> DataFrame:
    """Write the archives to an empty folder and return the manifest that is committed. The same rows give the same files.

    Pages are moved once, to their shards; a revisit's mark is sorted right before its page."""
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    with Scope(spark) as scope:
        marks = scope.store(revisits(pages), "warc-marks").select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
        by, then = [F.col("page_id").asc_nulls_last(), F.col("digest")], [F.col("refers_to").asc_nulls_last(), F.col("url")]
        shards, ranges = shard_table(rows.select("page_id"), shards)
        every = rows.unionByName(marks)
        # a few thousand ranges at most for each level of counting; null page_ids are in none and come last
        shard = F.lit(None).cast("int")
        for k in sorted({k for _, k, _ in ranges}):
            told = spark.createDataFrame([(r, s) for r, at, s in ranges if at == k], f"range{k} long, shard{k} int")
            every = every.withColumn(f"range{k}", F.shiftright("page_id", k)).join(F.broadcast(told), f"range{k}", "left")
            shard = F.coalesce(shard, F.col(f"shard{k}"))
        every = every.withColumn("shard", F.coalesce(shard, F.lit(shards - 1)))
        dealt = every.repartitionById(shards, F.col("shard")).sortWithinPartitions(*by, *then).select("page_id", "url", "html", "digest", "refers_to")
        manifest = scope.store(dealt.mapInArrow(_write(folder, roll, date), _MANIFEST_SQL), "warc-manifest")
        # stored, so that the renames are spread over tasks and the commit alone is one
        renamed = scope.store(manifest.repartition("name").mapInArrow(_rename(folder), _MANIFEST_SQL), "warc-renamed")
        renamed.coalesce(1).sortWithinPartitions("shard", "number").write.mode("overwrite").json(f"{folder}/_manifest")
    return spark.read.schema(_MANIFEST_SQL).json(f"{folder}/_manifest")


def records(data: bytes):
    """The records of an archive: (headers, block). One gzip member at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        # in small pieces: what follows a member is copied for each one
        member, parts = zlib.decompressobj(31), []
        while at < len(view) and not member.eof:
            piece = view[at : at + PIECE]
            parts.append(member.decompress(piece))
            at += len(piece) - len(member.unused_data)
        raw = b"".join(parts) + member.flush()
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        block = rest[: int(headers["content-length"])]
        if base64.b32encode(hashlib.sha1(block).digest()).decode() != headers["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError(f"block digest differs in {headers['warc-record-id']}")
        yield headers, block


_READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("record_id", pa.string()), ("html", pa.string())])
_READ_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string, html string"


def _parse(with_payload: bool):
    def run(batches):
        for batch in batches:
            for content, sha256 in zip(batch.column(0), batch.column(1).to_pylist()):
                data, rows = content.as_py(), []
                if hashlib.sha256(data).hexdigest() != sha256:
                    raise ValueError("an archive differs from its manifest")
                for headers, block in records(data):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    length = int(next(line for line in head.split(b"\r\n") if line.startswith(b"Content-Length: "))[16:])
                    told = headers["warc-payload-digest"].removeprefix("sha256:")
                    revisit = headers["warc-type"] == "revisit"
                    if not revisit and (len(payload) != length or hashlib.sha256(payload).hexdigest() != told):
                        raise ValueError(f"payload differs in {headers['warc-record-id']}")
                    page, first = headers["warc-page"], headers.get("warc-refers-to-page")
                    rows.append((int(page) if page else None, length, told, headers["warc-type"], int(first) if first else None, headers["warc-target-uri"], headers["warc-record-id"], payload.decode() if with_payload and not revisit else None))
                for k in range(0, len(rows), 512):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 512]), _READ)], schema=_READ)

    return run


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """One row a record of the committed archives; digests of files, blocks and payloads are verified."""
    manifest = spark.read.schema(_MANIFEST_SQL).json(f"{folder}/_manifest").select("name", "sha256")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.join(manifest, "name").select("content", "sha256").mapInArrow(_parse(with_payload), _READ_SQL)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write to a new folder in the shared one, then read back."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_warc(pages, folder)
    return read_warc(spark, folder, with_payload=False)
