"""WARC: a deterministic sharded writer and a reader.

Writing
1. Equal payloads of at least `REVISIT` bytes share one response, the one with the smallest page_id; digests of single payloads are
   dropped before the join, so it is small (and Spark splits a hot digest's partition).
2. Global prefix sums of payload bytes in order of page_id cut the pages into ranges of equal size. Ranges depend on
   the data alone, so files have the same records whatever partitions Spark makes.
3. Each range is sorted and streamed to gzip members, one per record; files roll at `ROLL` compressed bytes. A task writes under a
   temporary name with its own suffix and returns a line of the manifest.
4. The manifest is stored; its files are renamed to their final names (again harmless if a task is repeated), then the manifest goes to
   the archive folder. Files of lost or repeated attempts are in no manifest and go with the temporary folder.

Headers and digests are made anew from the payload: record ids are name-based UUIDs, dates are a parameter. A revisit names its response's
record id, target and date.

The archive folder is any that Spark and pyarrow.fs reach by URI (file, hdfs, s3, gs), shared by all machines.

Defined cases: a null html is an empty payload; a null url has the target urn:page:<id>; control and non-ASCII characters of URLs are
percent-encoded; pages without page_id come first and are responses; rows that repeat the smallest page_id of a payload are
responses each; an empty table gives no file and an empty result; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.sharding import prefix_sums
from fieldloom.session import materialise, new_path, remove

REVISIT = 100
ROLL = 256 << 20
RANGE_BYTES = 256 << 20
LEAST_RANGES = 24
#: Digests of repeated payloads, and bytes of their URLs, that are broadcast; more are joined by shuffling.
SHARED_BROADCAST, SHARED_BYTES = 200_000, 64 << 20
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard bigint, seq int, temp string, name string, records bigint, bytes bigint, sha256 string"


def record_id(kind: str, *parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, (kind, *parts))))}>"


def _record(kind: str, rid: str, headers: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), *headers, ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def target_uri(page_id: int | None, url: str | None) -> str:
    return urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page_id}"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """A response record, or a revisit record (HTTP head only) of the response of page refers_to with refers_url, if refers_to is given."""
    target = target_uri(page_id, url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Target-URI", target), ("WARC-Payload-Digest", "sha256:" + digest), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if refers_to is None:
        return _record("response", record_id("response", page_id, target, digest), headers, http + payload, date)
    first = target_uri(refers_to, refers_url)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", refers_to, first, digest)), ("WARC-Refers-To-Target-URI", first), ("WARC-Refers-To-Date", date)]
    headers.append(("X-Refers-To-Page-Id", str(refers_to)))
    return _record("revisit", record_id("revisit", page_id, target, digest), headers, http, date)


class _File:
    """One archive file under a temporary name."""

    def __init__(self, fs: pyarrow.fs.FileSystem, folder: str, shard: int, seq: int, date: str) -> None:
        self.shard, self.seq, self.records, self.bytes, self.sum = shard, seq, 0, 0, hashlib.sha256()
        self.name = f"{folder}/pages-{shard:06d}-{seq:04d}.warc.gz"
        self.temp = f"{folder}/_temporary/{shard:06d}-{seq:04d}-{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.temp)
        info = f"software: fieldloom\r\nformat: WARC File Format 1.1\r\nisPartOf: pages-{shard:06d}\r\n".encode()
        self.add(_record("warcinfo", record_id("warcinfo", shard, seq), [("Content-Type", "application/warc-fields")], info, date), 0)

    def add(self, record: bytes, count: int = 1) -> None:
        c = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without a time stamp
        member = c.compress(record) + c.flush()
        self.out.write(member)
        self.sum.update(member)
        self.bytes, self.records = self.bytes + len(member), self.records + count

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.seq, self.temp, self.name, self.records, self.bytes, self.sum.hexdigest()


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else "file://" + uri)


def described(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to and refers_url (null for responses)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select("page_id", "url", payload.alias("payload"), F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_digest"))
    shared = base.filter(F.col("payload_bytes") >= REVISIT).groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared = materialise(shared, "warc-shared")
    rows, urls = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("head.url")), F.lit(0))).first()
    shared = F.broadcast(shared) if rows <= SHARED_BROADCAST and urls <= SHARED_BYTES else shared  # payloads then aren't shuffled for it
    refers = F.when((F.col("payload_bytes") >= REVISIT) & (F.col("page_id") > F.col("head.page_id")), F.col("head"))
    return base.join(shared, "payload_digest", "left").select("page_id", "url", "payload", "payload_bytes", "payload_digest", refers["page_id"].alias("refers_to"), refers["url"].alias("refers_url"))


def write(pages: DataFrame, folder: str, roll: int = ROLL, range_bytes: int = RANGE_BYTES, date: str = DATE) -> DataFrame:
    """Write the pages' archive to folder; returns the manifest (one row per file) as stored there."""
    spark = pages.sparkSession
    sizes = pages.select("page_id", (F.coalesce(F.octet_length("html"), F.lit(0)) + 512).cast("long").alias("cost"))
    sums, _, total = prefix_sums(sizes, ["page_id", "cost"], "cost", "warc-order")
    ranges = max(LEAST_RANGES, -(-total // range_bytes))
    at = F.floor(F.col("row_start").cast("decimal(38,0)") * ranges / F.lit(max(1, total))).cast("long")
    # the first page of each range: as many rows as the manifest will have files, at least
    begins = sorted(r.first for r in sums.withColumn("range", at).groupBy("range").agg(F.min("page_id").alias("first")).collect() if r.first is not None)
    cuts = np.array(begins[1:], np.int64)

    @F.pandas_udf("bigint")
    def shard_of(page_id: pd.Series) -> pd.Series:
        known = page_id.notna().to_numpy()
        out = np.zeros(len(page_id), np.int64)
        out[known] = np.searchsorted(cuts, page_id[known].to_numpy(np.int64), "right")
        return pd.Series(out)

    fs, path = _filesystem(folder)
    fs.create_dir(f"{path}/_temporary", recursive=True)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        file: _File | None = None
        done: list[tuple] = []
        for b in batches:
            for i in range(b.num_rows):
                shard, *page = (b.column(k)[i].as_py() for k in range(7))
                if file and (file.shard != shard or file.bytes >= roll):
                    done.append(file.close())
                    file = _File(fs, path, shard, file.seq + 1 if file.shard == shard else 0, date)
                file = file or _File(fs, path, shard, 0, date)
                file.add(page_record(*page, date))
        if file:
            done.append(file.close())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], ["shard", "seq", "temp", "name", "records", "bytes", "sha256"])

    rows = described(pages).withColumn("shard", shard_of("page_id")).select("shard", "page_id", "url", "payload", "payload_digest", "refers_to", "refers_url")
    keys = ["shard", F.col("page_id").asc_nulls_first(), "payload_digest", F.col("url").asc_nulls_first()]
    written = materialise(rows.repartitionByRange(len(cuts) + 1, "shard").sortWithinPartitions(*keys).mapInArrow(save, MANIFEST), "warc-manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(folder)
        for b in batches:
            for temp, name, size in zip(b["temp"].to_pylist(), b["name"].to_pylist(), b["bytes"].to_pylist(), strict=True):
                if fs.get_file_info(temp).type != pyarrow.fs.FileType.NotFound:
                    fs.move(temp, name)
                elif fs.get_file_info(name).size != size:
                    raise OSError(f"{name}: neither its temporary file nor a complete one is there")
            yield b

    written.repartition("shard", "seq").mapInArrow(commit, MANIFEST).drop("temp").write.mode("overwrite").json(f"{folder}/_manifest")
    remove(spark, f"{folder}/_temporary")
    return spark.read.schema(", ".join(x for x in MANIFEST.split(", ") if not x.startswith("temp "))).json(f"{folder}/_manifest")


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and blocks of an uncompressed WARC stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() == b"":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        block = stream.read(int(head["content-length"]))
        if len(block) != int(head["content-length"]) or head["warc-block-digest"] != "sha256:" + hashlib.sha256(block).hexdigest():
            raise ValueError(f"damaged record {head.get('warc-record-id')}")
        yield head, block


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per page record of the archive, checked against its digests; html as well."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = _filesystem(folder)
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for b in batches:
            for name in b["name"].to_pylist():
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(name, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw, 1 << 20)) as stream:  # ty: ignore
                    for head, block in records(stream):
                        if head["warc-type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                        digest = head["warc-payload-digest"].partition(":")[2]
                        if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                            raise ValueError(f"damaged payload in {name}")
                        page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
                        target = head["warc-target-uri"]
                        rows.append((page and int(page), None if target.startswith("urn:page:") else target, size, digest, head["warc-type"], refers and int(refers), payload.decode() if head["warc-type"] == "response" else None))
                        held += len(payload) + 256
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    ddl = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string"
    return manifest.select("name").repartition(max(1, manifest.count())).mapInArrow(load, ddl)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages to an archive in the shared folder and read it back."""
    folder = new_path(spark, "warc")
    return read(write(pages, folder), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
