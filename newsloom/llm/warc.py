"""Deterministic sharded WARC writer and reader.

Writing: payload digests pick, among equal payloads of at least ``revisit_from`` bytes, the record
with the largest key as the response; the others become revisits of it and store headers only. Rows
are range-sorted by (key, digest) over boundaries taken from a hash sample, so the shards depend on
the rows and not on how they were partitioned. Each task writes gzip members, one a record, to a
temporary name and rolls to the next file at a compressed size. HTTP and WARC headers, lengths and
digests are made anew. A task's files are listed in a manifest that Spark's own commit protocol
writes, so of several attempts exactly one counts; the files in the manifest are then renamed, which
can be repeated. Reading goes file by file from the manifest, as a stream.

Equal payloads are found by SHA-1 and length. Only (key, digest) pairs are shuffled and joined for that,
with partial maxima before; what a record revisits travels to its shard as a note, so that payloads are
shuffled once.

Defined results: a null payload is empty; a null key is written as such and never chosen over a
number; rows that repeat the largest key of their payload are all responses; an empty table gives no
file and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from newsloom.llm.common import drop_dir, work_dir, written

#: Fixed values of the WARC/1.1 format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"

#: A null key sorts first.
_LEAST = -(1 << 63)


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri:
        uri = f"file://{uri[5:] if uri.startswith('file:') else uri}"
    return pafs.FileSystem.from_uri(uri)


def _sha1(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC record: a response, or a revisit with the headers of one."""
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    b32 = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:key:{key}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {''.join(c for c in url or '' if c > ' ')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: {b32}",
        f"WARC-Block-Digest: {_sha1(block)}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:key:{refers_to}>"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def _sharder(bounds):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = bounds.value
        for batch in batches:
            keys, digests = batch.column("k").to_pylist(), batch.column("digest").to_pylist()
            shard = [bisect_right(cuts, (_LEAST if k is None else k, d)) for k, d in zip(keys, digests, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], names=[*batch.schema.names, "shard"])

    return run


def _writer(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        task = TaskContext.get()
        made: list[tuple[int, int, str, str, int, int, str]] = []
        out, size, count, sums = None, 0, 0, None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                shard, name = task.partitionId(), f"part-{task.partitionId():06d}-{len(made):05d}.warc.gz"
                made.append((shard, len(made), temporary, name, count, size, sums.hexdigest()))
                out = None

        noted = None
        for batch in batches:
            for row in batch.to_pylist():
                if not row["note"]:
                    noted = (row["k"], row["digest"], row["refers"])
                    continue
                refers = noted[2] if noted and noted[:2] == (row["k"], row["digest"]) else None
                if out is not None and size >= roll_bytes:
                    close()
                if out is None:
                    # the attempt is in the name: a second attempt never touches the first one's file
                    temporary = f"_temporary/{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):05d}"
                    out = system.open_output_stream(f"{root}/{temporary}", compression=None)
                    size, count, sums = 0, 0, hashlib.sha256()
                raw = _member(record(row["k"], row["url"], row["payload"], refers, row["digest"]))
                out.write(raw)
                sums.update(raw)
                size += len(raw)
                count += 1
        close()
        if made:
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "seq", "temporary", "name", "records", "bytes", "sha256"), m, strict=True)) for m in made])

    return run


_MANIFEST = "shard bigint, seq bigint, temporary string, name string, records bigint, bytes bigint, sha256 string"


def _commit(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                there = system.get_file_info(f"{root}/{row['temporary']}")
                if there.type != pafs.FileType.NotFound:
                    system.move(there.path, f"{root}/{row['name']}")
                size = system.get_file_info(f"{root}/{row['name']}").size
                if size != row["bytes"]:
                    raise OSError(f"{row['name']}: {size} bytes, the manifest says {row['bytes']}")
            yield batch

    return run


def named(pages: DataFrame, key_col: str, payload_col: str, folder: str) -> DataFrame:
    """(k, digest, size) of each row, written: counts, boundaries and revisits come from it, not from the payloads."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    return written(pages.select(F.col(key_col).cast("bigint").alias("k"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("size")), f"{folder}/named")


def keyed(pages: DataFrame, names: DataFrame, key_col: str, payload_col: str, url_col: str, revisit_from: int, folder: str) -> DataFrame:
    """Pages as (k, url, payload, digest, note = 1), and a row without payload (note = 0, refers) for each (k, digest) to revisit.

    Both kinds go to the same place by (k, digest), so payloads need no join to learn what they revisit.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key_col).cast("bigint").alias("k"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    slim = names.where(F.col("size") >= revisit_from)
    best = slim.groupBy("digest", "size").agg(F.max("k").alias("best"), F.count(F.lit(1)).alias("n")).where("n > 1 and best is not null").drop("n")
    best = written(best, f"{folder}/best")  # so that a join with the rows of one frequent payload can be split
    notes = slim.join(best, ["digest", "size"]).where(~F.col("best").eqNullSafe(F.col("k"))).groupBy("k", "digest").agg(F.first("best").alias("refers"))
    notes = notes.select("k", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers", F.lit(0).alias("note"))
    return rows.select("k", "url", "payload", "digest", F.lit(None).cast("bigint").alias("refers"), F.lit(1).alias("note")).union(notes)


def _bounds(rows: DataFrame, shards: int, per_shard: int = 24) -> list[tuple[int, str]]:
    """Up to shards - 1 keys (key, digest) that cut the rows evenly: from a sample by hash."""
    n = rows.count()
    if shards < 2 or not n:
        return []
    step = max(1, n // (shards * per_shard))
    sample = rows.where(F.pmod(F.xxhash64("k", "digest"), F.lit(step)) == 0).select("k", "digest")
    # a number of rows fixed by `shards`, on average; sorted here
    keys = sorted((_LEAST if r[0] is None else r[0], r[1]) for r in sample.toLocalIterator())
    return sorted({keys[i * len(keys) // shards] for i in range(1, shards)}) if keys else []


def write(
    pages: DataFrame, folder: str, key_col: str = "page_id", payload_col: str = "html", url_col: str = "url",
    revisit_from: int = 1000, roll_bytes: int = 16 << 20, rows_per_shard: int = 4096, max_shards: int = 100_000,
) -> DataFrame:
    """Write the archives to ``folder`` (a URI that all executors reach); the manifest comes back.

    ``folder`` must be new: files of an earlier call are not looked at.
    """
    spark = pages.sparkSession
    system, root = _file_system(folder)
    system.create_dir(f"{root}/_temporary", recursive=True)
    aside = work_dir(spark, "warc-names")
    names = named(pages, key_col, payload_col, aside)
    shards = min(max_shards, max(1, -(-names.count() // rows_per_shard)))
    bounds = spark.sparkContext.broadcast(_bounds(names, shards))
    rows = keyed(pages, names, key_col, payload_col, url_col, revisit_from, aside)

    schema = "k bigint, url string, payload binary, digest string, refers bigint, note int, shard int"
    dealt = rows.mapInArrow(_sharder(bounds), schema).repartitionById(len(bounds.value) + 1, F.col("shard"))
    dealt = dealt.sortWithinPartitions(F.col("k").asc_nulls_first(), "digest", "note", "url")
    manifest = dealt.select("k", "url", "payload", "digest", "refers", "note").mapInArrow(_writer(folder, roll_bytes), _MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest")
    listed = spark.read.schema(manifest.schema).parquet(f"{folder}/_manifest")
    done = _by_file(listed).mapInArrow(_commit(folder), _MANIFEST)
    done.write.parquet(f"{folder}/_committed")
    with system.open_output_stream(f"{root}/_SUCCESS") as f:
        f.write(json.dumps({"shards": len(bounds.value) + 1, "roll_bytes": roll_bytes}).encode())
    drop_dir(spark, aside)
    return spark.read.schema(manifest.schema).parquet(f"{folder}/_committed")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            head[name.decode().lower()] = value.strip().decode()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]):
            raise ValueError("a record is cut short")
        yield head, block


def _key(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:key:").removesuffix(">")
    return int(text) if text and text != "None" else None


def _reader(folder: str):
    import gzip

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _file_system(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                out: dict[str, list] = {c: [] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")}
                with system.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in records(stream):
                        if _sha1(block) != head["warc-block-digest"]:
                            raise ValueError(f"{name}: a block's digest differs")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        said = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
                        size = int(http.lower().partition(b"content-length:")[2].split(b"\r\n")[0])
                        if head["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != said or len(payload) != size):
                            raise ValueError(f"{name}: a payload's digest differs")
                        out["page_id"].append(_key(head["warc-record-id"]))
                        out["payload_bytes"].append(size)
                        out["payload_digest"].append(said)
                        out["record_type"].append(head["warc-type"])
                        out["refers_to"].append(_key(head.get("warc-refers-to")))
                        out["url"].append(head["warc-target-uri"])
                kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.string())) for c, v in out.items()], names=list(out))

    return run


def _by_file(manifest: DataFrame, most: int = 50_000) -> DataFrame:
    """The manifest's rows dealt to as many tasks as there are files, up to ``most``; a stated number is not coalesced."""
    return manifest.repartition(min(most, max(1, manifest.count())), "name")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    files = _by_file(manifest.select("name"))
    return files.mapInArrow(_reader(folder), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to a fresh shared folder and read the archives back."""
    folder = work_dir(pages.sparkSession, "warc")
    return read(write(pages, folder, **options), folder)
