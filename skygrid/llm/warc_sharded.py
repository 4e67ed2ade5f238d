"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id and written by one task a range.  The ranges follow from the pages alone:
a sample of ids picked by their hash, weighted with the payloads' bytes, is cut at even shares, so neither the
input's layout nor the run changes a file.  A task rolls its file once the compressed size reaches a limit; every record is a gzip member of its own with headers, ids and digests
made anew from its content, so a repeated attempt writes the same bytes.  Files get their names by a
rename from an attempt's own temporary name; the manifest table, itself committed by Spark's job commit,
lists the files that count, in parts that can be read separately.

The folder must be one that executors share; it is opened through ``pyarrow.fs``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL_BYTES = 1 << 28
PART_BYTES = 8 << 20
#: Bytes of payload for which a shard is made, so many shards at most, and ids that decide their bounds.
SHARD_BYTES, MOST_SHARDS, SAMPLE = 16 << 20, 1 << 15, 20_000
LEAST = 100
#: Tasks over which one payload's pages are dealt to meet the page they revisit.
SALTS = 16
MANIFEST_SCHEMA = "file string, start long, stop long, n_records long, sha256 string"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page}:{digest}')}>"


def _header(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _member(head: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", str(len(block)))])
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def page_record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page, digest)), ("WARC-Date", date),
        ("WARC-Target-URI", _header(url) if url else "urn:page:unknown"), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"), ("X-Page-Id", "" if page is None else str(page)),
    ]
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    return _member(head, block)


class ShardWriter:
    """Files of one range, rolled by compressed size; yields the manifest's rows."""

    def __init__(self, folder: str, shard: int, attempt: int, roll: int, date: str):
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.folder, self.shard, self.attempt, self.roll, self.date = folder, shard, attempt, roll, date
        self.number, self.out = 0, None

    def _open(self) -> None:
        self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
        self.temp = f"{self.root}/_temporary/{self.attempt}-{uuid.uuid4().hex}-{self.name}"
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.fs.create_dir(f"{self.root}/data", recursive=True)
        self.out, self.at, self.parts = self.fs.open_output_stream(self.temp, compression=None), 0, []
        self._part()
        info = f"software: skygrid\r\nformat: WARC file version 1.1\r\nisPartOf: {self.name}\r\n".encode()
        name = hashlib.sha256(self.name.encode()).hexdigest()
        self._put(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info), 0)

    def _part(self) -> None:
        self.start, self.count, self.sha = self.at, 0, hashlib.sha256()

    def _end_part(self) -> None:
        if self.at > self.start:
            self.parts.append((f"data/{self.name}", self.start, self.at, self.count, self.sha.hexdigest()))
        self._part()

    def _put(self, data: bytes, records: int) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.at += len(data)
        self.count += records

    def add(self, *record) -> list[tuple]:
        """Manifest rows of the file that this record completed, if any."""
        if self.out is None:
            self._open()
        self._put(page_record(*record, self.date), 1)
        if self.at >= self.roll:
            return self.close()
        if self.at - self.start >= PART_BYTES:
            self._end_part()
        return []

    def close(self) -> list[tuple]:
        if self.out is None:
            return []
        self._end_part()
        self.out.close()
        self.fs.move(self.temp, f"{self.root}/data/{self.name}")
        self.out, self.number = None, self.number + 1
        return self.parts


def shard_bounds(sizes: DataFrame, shards: int | None = None) -> list[int]:
    """Least ids of all shards but the first, from (page_id, n_bytes); the same for the same pages, whatever their layout.

    Only about SAMPLE ids reach the driver: those whose hash falls into one of enough classes.
    """
    own = sizes.where("page_id is not null").groupBy("page_id").agg(F.sum(F.col("n_bytes") + 1).alias("w"))
    n, total = own.agg(F.count(F.lit(1)), F.sum("w")).first()
    if not n:
        return []
    shards = shards or int(min(MOST_SHARDS, total // SHARD_BYTES + 1))
    classes = n // SAMPLE + 1
    rows = sorted(map(tuple, own.where(F.pmod(F.xxhash64("page_id"), F.lit(classes)) == 0).collect()))
    share, bounds, done = sum(w for _, w in rows) / shards, [], 0
    for page, w in rows:
        if done and done >= share * (len(bounds) + 1):
            bounds.append(page)
            while done >= share * (len(bounds) + 1):  # a page as large as several shards
                share = max(share, (done + 1) / (len(bounds) + 1))
        done += w
    return bounds[: shards - 1]


def shard_of(page, bounds: list[int]):
    """Number of bounds up to the page, by binary search in a constant array; null ids are in shard 0."""
    steps = len(bounds).bit_length()
    table = F.array(*[F.lit(x).cast("long") for x in bounds + [2**63 - 1] * ((1 << steps) - len(bounds))])
    halves = F.array(*[F.lit(1 << k) for k in range(steps - 1, -1, -1)]) if steps else F.array().cast("array<int>")
    return F.aggregate(halves, F.lit(0), lambda low, step: F.when(F.get(table, low + step - 1) <= page, low + step).otherwise(low))


def write_warc(
    pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, date: str = "2024-01-01T00:00:00Z", shards: int | None = None,
    id_name: str = "page_id", url_name: str = "url", html_name: str = "html",
) -> DataFrame:
    """Write a record for each page; returns the manifest (file, start, stop, n_records, sha256).

    Of pages with equal payloads of LEAST bytes or more, the one with the smallest id is a response and the others
    revisit it; smaller payloads are responses.  A null html is an empty payload; a null url gets a placeholder;
    rows that share the smallest id are all responses; pages with a null id revisit a page with an id, if there is one.
    """
    own = pages.select(c.cell(id_name).cast("long").alias("page_id"), c.cell(url_name).cast("string").alias("url"), F.coalesce(c.cell(html_name).cast("string"), F.lit("")).alias("html"))
    narrow = c.cut(own.select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes")), "digests")
    bounds = shard_bounds(narrow, shards)
    large = narrow.where(F.col("n_bytes") >= LEAST).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    # a payload that all hosts share is dealt out over several tasks
    salted = large.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id"), F.lit(SALTS)), F.lit(0)).cast("int"))
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    revisits = salted.join(first, ["digest", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()
    # one shuffle of the payloads: a page and the row that makes it a revisit meet in the range sort
    marks = revisits.select("page_id", F.lit(0).alias("side"), F.lit(None).cast("string").alias("url"), F.col("digest").alias("html"), F.col("first"))
    rows = own.select("page_id", F.lit(1).alias("side"), "url", "html", F.lit(None).cast("long").alias("first")).unionByName(marks)
    rows = rows.withColumn("shard", shard_of(F.col("page_id"), bounds))
    ranged = rows.repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "page_id", "side", "url", "html").select("page_id", "side", "url", "html", "first", "shard")
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("n_records", pa.int64()), ("sha256", pa.string())])

    def run(records):
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        out, page, refers = None, object(), {}
        done: list[tuple] = []
        for rec in records:
            for r in c.rows_of([rec]):
                if out is None or r["shard"] != out.shard:  # a task may hold several shards, one after another
                    done += out.close() if out else []
                    out, page = ShardWriter(folder, r["shard"], attempt, roll_bytes, date), object()
                if r["page_id"] != page:
                    page, refers = r["page_id"], {}
                if r["side"] == 0:
                    refers[r["html"]] = r["first"]
                    continue
                payload = r["html"].encode()
                digest = hashlib.sha256(payload).hexdigest()
                done += out.add(page, r["url"], payload, digest, refers.get(digest), digest in refers)
        done += out.close() if out else []
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)

    pages.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(c.ARROW_BYTES))
    return c.cut(ranged.mapInArrow(run, MANIFEST_SCHEMA), "warc-manifest")


def _members_of(data: bytes, step: int = 1 << 20):
    """The members of a part without copying the rest for each of them."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, out, used = zlib.decompressobj(31), [], at
        while not z.eof and used < len(data):
            piece = view[used : used + step]
            out.append(z.decompress(piece))
            used += len(piece)
        at = used - len(z.unused_data)
        yield b"".join(out), z.eof


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the files that the manifest lists, parts side by side; checks digests and lengths."""
    names = [x.split(" ")[0] for x in RECORD_SCHEMA.split(", ")]

    def run(records):
        files, root = fs.FileSystem.from_uri(folder)
        for part in c.rows_of(records):
            with files.open_input_file(f"{root}/{part['file']}") as f:
                f.seek(part["start"])
                data = f.read(part["stop"] - part["start"])
            if hashlib.sha256(data).hexdigest() != part["sha256"]:
                raise ValueError(f"{part['file']}: bytes differ from the manifest")
            rows = []
            for raw, whole in _members_of(data):
                if not whole:
                    raise ValueError("truncated WARC record")
                head, _, rest = raw.partition(b"\r\n\r\n")
                lines = head.decode().split("\r\n")
                fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in lines[1:])
                block = rest[: int(fields["Content-Length"])]
                if lines[0] != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
                    raise ValueError("bad WARC record")
                if fields["WARC-Type"] == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "revisit"
                if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
                    raise ValueError("payload differs from its digest")
                page = fields["X-Page-Id"]
                rows.append((int(page) if page else None, fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], int(fields["X-Refers-To-Page"]) if revisit else None, payload if payloads and not revisit else None))
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    parts = manifest.repartition(c.partitions(spark))
    return parts.mapInArrow(run, RECORD_SCHEMA)


def archive_and_read(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write all pages, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = folder or c.shared_path(spark, "warc")
    manifest = write_warc(pages, folder, **options)
    return read_warc(spark, folder, manifest, payloads=False).drop("payload", "url")
