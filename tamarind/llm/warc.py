"""Deterministic sharded WARC archives of web pages.

Records are range-sorted by page id, so that a shard holds neighbouring ids.  How many shards there are and where they
begin follows from the pages alone (their bytes, and the ids of a sample taken by hashes), not from the cluster's settings, so the
same table gives the same files wherever it is written.  Each record is a gzip member of its own;
a file is closed and the next begun once it has ``roll_bytes`` compressed bytes.  Files are written under temporary names and
renamed when whole.  A task then leaves a manifest of each shard's files in the same way, and the driver commits the archive
with one manifest of the shards' manifests.  Readers only open files that the manifests name, so what a lost or
repeated task leaves behind is never read.  Headers, record ids and digests are made from the record's content alone,
so a repeated task writes the same bytes.

Records of equal payload, if at least ``least_bytes`` long, are written once: that with the least page id is the
response (an HTTP message), the others are revisits without a block that refer to its record.  Which these are is found from
digests alone; no payload is shuffled but for the one range-sort.

Special input: null html is an empty payload; page ids may be null (they come last; a null-id response is only referred
to as null) or repeat: of rows with equal id and payload the first written is the response and the others revisit it;
null urls are written as empty; a page of any length is one record; an empty table gives an archive without records;
other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .workspace import join_by_key, new_dir, stored

LEAST = 100
ROLL = 64 << 20
#: Bytes of payload in a shard: at least the first, until there are SHARDS of them; then more, up to the second.
SHARD_BYTES, SHARDS = (12 << 20, 1 << 30), 4096
#: Page ids that the driver gets for each shard, to find where shards begin.
SAMPLED = 64
#: What stands before a payload in a response's block.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"  # archives are a function of their input, so records bear no clock time
END = b"\r\n\r\n"


def store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def rename(fs: pyarrow.fs.FileSystem, a: str, b: str) -> None:
    """Renames; where a store refuses to replace a file, an earlier attempt's (which has the same bytes) goes first."""
    try:
        fs.move(a, b)
    except OSError:
        fs.delete_file(b)
        fs.move(a, b)


def commit(path: str, data: bytes) -> None:
    """Writes a small file under a temporary name, then renames it."""
    fs, at = store(path)
    with fs.open_output_stream(temporary := f"{at}.{uuid.uuid4().hex}.tmp") as f:
        f.write(data)
    rename(fs, temporary, at)


class Shard:
    """The files of one task, rolled by their compressed size."""

    def __init__(self, folder: str, number: int, roll: int):
        self.fs, self.folder = store(folder)
        self.number, self.roll, self.out, self.files = number, roll, None, []

    def add(self, record: bytes) -> None:
        z = zlib.compressobj(4, zlib.DEFLATED, 31)
        member = z.compress(record) + z.flush()
        if self.out and self.size + len(member) > self.roll and self.size:
            self.close()
        if not self.out:
            self.name = f"part-{self.number:06d}-{len(self.files):05d}.warc.gz"
            self.temporary = f"{self.folder}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size, self.records, self.sum = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            self.add(header("warcinfo", f"file:{self.name}", b"software: tamarind\r\nformat: WARC File Format 1.1\r\n", {"WARC-Filename": self.name, "Content-Type": "application/warc-fields"}))
        self.out.write(member)
        self.size, self.records = self.size + len(member), self.records + 1
        self.sum.update(member)

    def close(self) -> None:
        if self.out:
            self.out.close()
            rename(self.fs, self.temporary, f"{self.folder}/{self.name}")
            self.files.append({"name": self.name, "bytes": self.size, "records": self.records, "sha256": self.sum.hexdigest()})
            self.out = None


def record_id(kind: str, about: str, block: bytes) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {about} {hashlib.sha256(block).hexdigest()}')}>"


def header(kind: str, about: str, block: bytes, fields: dict[str, str]) -> bytes:
    """A whole record.  Its id is made from its kind, subject and block."""
    lines = {"WARC-Type": kind, "WARC-Record-ID": record_id(kind, about, block), "WARC-Date": DATE, "WARC-Block-Digest": digest(block), **fields, "Content-Length": str(len(block))}
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in lines.items()), "\r\n"]).encode() + block + END


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def quoted(url: str) -> str:
    return "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def first_pages(pages: DataFrame, total: int) -> DataFrame:
    """page_id, sha, first: for every page in a group of equal payloads, the group's least id.  pages: page_id, sha, size."""
    large = pages.filter(F.col("size") >= LEAST)
    groups = stored(large.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("many")).filter("many > 1"), new_dir(pages.sparkSession, "groups"))
    return join_by_key(large.select("page_id", "sha").distinct(), groups, "sha", "many", total).select("page_id", "sha", "first")


def shard_starts(pages: DataFrame, shards: int, total: int) -> np.ndarray:
    """The page ids at which shards after the first begin, so that shards have about equal bytes.  pages: page_id, sha, size.

    They come from a sample by hashes of about SAMPLED ids a shard, so they are the same however pages are partitioned.
    """
    every = max(1, total // (shards * SAMPLED))
    some = pages.filter(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0)).groupBy("page_id").agg(F.sum(F.col("size") + 512).alias("bytes")).toArrow().sort_by("page_id")
    ids, done = some.column("page_id").to_numpy(), np.cumsum(some.column("bytes").to_numpy())
    if not len(ids):
        return np.zeros(0, np.int64)
    return np.unique(ids[np.searchsorted(done, done[-1] * np.arange(1, shards) / shards)])


def write_archive(pages: DataFrame, folder: str, shards: int | None = None, roll_bytes: int = ROLL, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archive and commits its manifest; returns the files: shard, name, bytes, records, sha256."""
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("sha"))
    ids = stored(rows.select("page_id", "sha", F.octet_length("html").alias("size")), new_dir(spark, "digests"))
    total, size = ids.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    first = first_pages(ids, total)
    least, most = SHARD_BYTES
    shards = shards or max(1, -(-size // most), min(SHARDS, -(-size // least)))
    starts = shard_starts(ids, shards, total)

    @F.arrow_udf("int")
    def shard_of(column: pa.Array) -> pa.Array:
        place = np.searchsorted(starts, pc.fill_null(column, np.iinfo(np.int64).max).to_numpy(), "right")
        return pa.array(np.where(column.is_null().to_numpy(zero_copy_only=False), len(starts), place).astype(np.int32))

    # Marks come before the pages they are about: one sort brings both together, and payloads are shuffled once.
    void = F.lit(None).cast("string")
    marks = first.select("page_id", "sha", F.lit(0).alias("kind"), "first", void.alias("url"), void.alias("html"))
    both = marks.unionByName(rows.select("page_id", "sha", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "url", "html"))
    order = [F.col("shard"), F.col("page_id").asc_nulls_last(), F.col("sha"), F.col("kind"), F.col("url")]
    ordered = both.withColumn("shard", shard_of("page_id")).repartitionById(len(starts) + 1, "shard").sortWithinPartitions(*order)
    fs, at = store(folder)
    fs.create_dir(at, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, mark, last, copies = None, None, None, 0

        def ended() -> pa.RecordBatch:
            shard.close()
            commit(f"{folder}/shard-{shard.number:06d}.json", json.dumps(shard.files).encode())
            return pa.RecordBatch.from_pylist([{"shard": shard.number} | x for x in shard.files], pa.schema([("shard", pa.int32()), ("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())]))

        for batch in batches:
            columns = (batch.column(x) for x in ("shard", "page_id", "sha", "kind", "first", "url", "html"))
            for number, page, sha, kind, origin, url, text in zip(*(c.to_pylist() for c in columns), strict=True):
                if shard is None or number != shard.number:
                    if shard:
                        yield ended()
                    shard = Shard(folder, number, roll_bytes)
                if not kind:
                    mark = (page, sha, origin)
                    continue
                payload = text.encode()
                copies = copies + 1 if last == (page, sha) else 0
                last = (page, sha)
                about = f"{page} {copies}"
                block = (HTTP % len(payload)).encode() + payload
                fields = {"WARC-Target-URI": quoted(url), "X-Page-ID": "" if page is None else str(page), "X-Payload-SHA256": sha, "WARC-Payload-Digest": digest(payload), "Content-Type": "application/http; msgtype=response"}
                if mark and mark[:2] == last and (page != mark[2] or copies):
                    origin = mark[2]
                    fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id("response", f"{origin} 0", block), "X-Refers-To-Page": "" if origin is None else str(origin), "X-Payload-Length": str(len(payload))}
                    shard.add(header("revisit", f"{about} {url}", b"", fields))
                else:
                    shard.add(header("response", about, block, fields))
        if shard:
            yield ended()

    files = stored(ordered.mapInArrow(write, "shard int, name string, bytes long, records long, sha256 string"), new_dir(spark, "files"))
    found = files.groupBy("shard").agg(F.count("*").alias("files")).orderBy("shard").collect()  # two numbers a shard
    commit(f"{folder}/manifest.json", json.dumps({"shards": [r.shard for r in found], "files": sum(r.files for r in found)}).encode())
    return files


def manifest_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files that the committed manifest names, one a task: name, bytes, records, sha256."""
    fs, at = store(folder)
    manifest = json.loads(fs.open_input_stream(f"{at}/manifest.json").read())
    schema = T.StructType.fromDDL("name string, bytes long, records long, sha256 string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = store(folder)
        for batch in batches:
            for n in batch.column("shard").to_pylist():
                files = json.loads(fs.open_input_stream(f"{at}/shard-{n:06d}.json").read())
                yield pa.RecordBatch.from_pylist(files, pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())]))

    numbers = spark.createDataFrame([(n,) for n in manifest["shards"]], "shard int").repartition(max(1, min(1000, len(manifest["shards"]))))
    return numbers.mapInArrow(read, schema).repartition(max(1, manifest["files"]))


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Reads a gzipped WARC stream record by record."""
    z, held = zlib.decompressobj(31), b""
    parts: list[bytes] = []
    while True:
        if not held:
            held = stream.read(1 << 18)
            if not held:
                break
        parts.append(z.decompress(held))
        held = z.unused_data
        if z.eof:
            yield parse(b"".join(parts))
            z, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("an archive ends within a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(fields["Content-Length"])
    if not version.startswith("WARC/") or rest[size:] != END:
        raise ValueError("not a WARC record")
    return fields, rest[:size]


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Reads a committed archive, checking every file's size and sum and every record's digests.

    Returns page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def number(text: str) -> int | None:
        return int(text) if text else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = store(folder)
        for batch in batches:
            for f in batch.to_pylist():
                stream, rows, size, seen = Summed(fs.open_input_stream(f"{at}/{f['name']}", compression=None)), [], 0, 0
                for fields, block in records(stream):
                    seen += 1
                    if fields["WARC-Block-Digest"] != digest(block):
                        raise ValueError(f"{f['name']}: a block's digest is wrong")
                    if (kind := fields["WARC-Type"]) == "warcinfo":
                        continue
                    if kind == "response":
                        block = block.partition(b"\r\n\r\n")[2]
                        sha, length = hashlib.sha256(block).hexdigest(), len(block)
                        if sha != fields["X-Payload-SHA256"] or fields["WARC-Payload-Digest"] != digest(block):
                            raise ValueError(f"{f['name']}: a payload's digest is wrong")
                    else:
                        sha, length = fields["X-Payload-SHA256"], int(fields["X-Payload-Length"])
                    rows.append((number(fields["X-Page-ID"]), fields["WARC-Target-URI"], kind, block if kind == "response" else None, length, sha, number(fields.get("X-Refers-To-Page", ""))))
                    size += len(block)
                    if size > 8 << 20 or len(rows) > 20_000:
                        yield to_batch(rows, schema)
                        rows, size = [], 0
                if (stream.size, stream.sum.hexdigest(), seen) != (f["bytes"], f["sha256"], f["records"]):
                    raise ValueError(f"{f['name']}: the file is not what the manifest says")
                if rows:
                    yield to_batch(rows, schema)

    return manifest_files(spark, folder).mapInArrow(read, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class Summed(io.RawIOBase):
    """Sums what is read."""

    def __init__(self, inner):
        self.inner, self.sum, self.size = inner, hashlib.sha256(), 0

    def read(self, n: int = -1) -> bytes:
        data = self.inner.read(n)
        self.sum.update(data)
        self.size += len(data)
        return data
