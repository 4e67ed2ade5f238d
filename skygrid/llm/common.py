"""Helpers shared by the training-data operators: shared storage, packed corpora, word kernels."""

from __future__ import annotations

import atexit
import ctypes
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64

# --- shared storage -------------------------------------------------------------------------


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or, where all run in one process, an own one if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile

        root = "file://" + tempfile.mkdtemp(prefix="skygrid-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root, removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/skygrid/{name}-{uuid.uuid4().hex}"
    atexit.register(remove_path, spark, path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system layer; silent once Spark has stopped."""
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at interpreter exit
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared root and read it back: lineage ends in a durable table."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# --- packed corpora -------------------------------------------------------------------------

PACK_BYTES = 4 << 20
#: Bytes of one Arrow batch on the way to Python.
ARROW_BYTES = 4 << 20
PACK_SCHEMA = "batch long, size long, doc_ids binary, known binary, lens binary, blob binary, rest binary"
_PACK = pa.schema([("batch", pa.int64()), ("size", pa.int64()), *((k, pa.binary()) for k in ("doc_ids", "known", "lens", "blob", "rest"))])


class Batch:
    """Whole texts of some documents: ids, byte lengths, offsets and the joined UTF-8 bytes."""

    def __init__(self, number: int, ids: np.ndarray, known: np.ndarray, lens: np.ndarray, buf: bytes, rest: pa.Table | None = None):
        self.number, self.ids, self.known, self.lens, self.buf, self.rest = number, ids, known, lens, buf, rest
        self.off = np.zeros(len(lens) + 1, np.int64)
        np.cumsum(lens, out=self.off[1:])

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.buf[self.off[i] : self.off[i + 1]]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Byte lengths (null: 0), null mask and joined bytes of an Arrow string column, without a Python object per row."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string())
    n, at = len(col), col.offset
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, bool), b""
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, at * 8)
    null = np.asarray(col.is_null())
    lens = np.diff(off)
    if null.any() and lens[null].any():
        texts = [b"" if x is None else x.encode() for x in col.to_pylist()]
        return np.array([len(x) for x in texts], np.int64), null, b"".join(texts)
    data = col.buffers()[2]
    return lens.astype(np.int64), null, data[off[0] : off[-1]].to_pybytes() if data else b""


def to_batches(records, id_name: str, text_name: str, pack_bytes: int = PACK_BYTES):
    """Split Arrow record batches into ``Batch`` es of about ``pack_bytes``; a longer document is alone in its own."""
    from pyspark import TaskContext

    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 32
    held: list[tuple] = []
    size = 0

    def out():
        nonlocal held, size, number
        parts = list(zip(*held))
        b = Batch(number, *(np.concatenate(p) for p in parts[:3]), b"".join(parts[3]), pa.Table.from_batches(parts[4]) if parts[4][0].num_columns else None)
        held, size, number = [], 0, number + 1
        return b

    for rec in records:
        ids = rec.column(rec.schema.get_field_index(id_name)).cast(pa.int64())
        known = ~np.asarray(ids.is_null())
        ids = np.asarray(ids.fill_null(0))
        lens, _, buf = text_bytes(rec.column(rec.schema.get_field_index(text_name)))
        off = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])
        rest = rec.select([k for k in rec.schema.names if k.startswith(CARRIED)])
        a = 0
        while a < len(ids):
            b = int(np.searchsorted(off, off[a] + pack_bytes - size, "right")) - 1
            if b <= a:
                if held:
                    yield out()
                    continue
                b = a + 1
            b = min(b, len(ids))
            held.append((ids[a:b], known[a:b], lens[a:b], buf[off[a] : off[b]], rest.slice(a, b - a)))
            size += int(off[b] - off[a])
            a = b
            if size >= pack_bytes:
                yield out()
    if held:
        yield out()


#: Prefix of the carried columns inside a pass, so that their names clash with none of the pass's own.
CARRIED = "carried_"


def pack_documents(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text", carry: list[str] | None = None, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Documents as compressed batches, written once to shared storage and read by every later pass.

    ``carry`` names further columns that travel with their rows, whatever they are called.
    """

    def pack(records):
        z = zstandard.ZstdCompressor(level=3)
        for b in to_batches(records, "doc_id", "text", pack_bytes):
            rest = None
            if b.rest is not None:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.rest.schema) as out:
                    out.write_table(b.rest)
                rest = z.compress(sink.getvalue().to_pybytes())
            cells = (b.ids.tobytes(), b.known.tobytes(), b.lens.tobytes(), z.compress(b.buf), rest)
            yield pa.RecordBatch.from_arrays([pa.array([b.number], pa.int64()), pa.array([len(b.buf)], pa.int64()), *(pa.array([x], pa.binary()) for x in cells)], schema=_PACK)
            release()

    return cut(select_documents(docs, id_name, text_name, carry).mapInArrow(pack, PACK_SCHEMA), "pack")


def cell(name: str):
    """A column by its plain name, whatever signs that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def select_documents(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text", carry: list[str] | None = None) -> DataFrame:
    """doc_id, text and the carried columns under their inner names.

    Arrow batches of the session are bounded in bytes, as texts may be long: a batch holds ARROW_BYTES or one row.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return docs.select(cell(id_name).cast("long").alias("doc_id"), cell(text_name).cast("string").alias("text"), *(cell(k).alias(CARRIED + k) for k in carry or []))


def release() -> None:
    """Give freed memory back to the system: a worker that keeps it counts against its executor."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    _TRIM = None


def unpack(row: dict) -> Batch:
    release()
    lens = np.frombuffer(row["lens"], np.int64)
    z = zstandard.ZstdDecompressor()
    buf = z.decompress(row["blob"]) if lens.sum() else b""
    rest = pa.ipc.open_stream(z.decompress(row["rest"])).read_all() if row["rest"] is not None else None
    return Batch(row["batch"], np.frombuffer(row["doc_ids"], np.int64), np.frombuffer(row["known"], bool), lens, buf, rest)


def rows_of(records):
    """One dict at a time from Arrow record batches."""
    for rec in records:
        for i in range(rec.num_rows):
            yield {k: rec.column(j)[i].as_py() for j, k in enumerate(rec.schema.names)}


# --- hashing --------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(0, 2**64, 256, dtype=U64)
P = 0x9E3779B97F4A7C15
_LEAP = 1 << 15


def powers(base: int, n: int) -> np.ndarray:
    out, step = np.ones(n, U64), 1
    for _ in range(n.bit_length()):
        if step >= n:
            break
        out[step : 2 * step] = out[: min(step, n - step)] * U64(pow(base, step, 2**64))
        step *= 2
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of a 64-bit hash."""
    h = h ^ (h >> U64(32))
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def grams(values: np.ndarray, k: int, base: int = P) -> np.ndarray:
    """Polynomial hash of every k consecutive values, before mixing; out[i] covers i .. i + k - 1."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    done, block, length = 0, values, 1
    bits = k
    while bits:
        if bits & 1:
            out += block[done : done + n] * U64(pow(base, done, 2**64))
            done += length
        bits >>= 1
        if bits:
            block = block[: len(block) - length] + block[length:] * U64(pow(base, length, 2**64))
            length *= 2
    return out


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Least value of every w consecutive ones."""
    step = 1
    while 2 * step <= w:
        a = np.minimum(a[:-step], a[step:])
        step *= 2
    rest = w - step
    return np.minimum(a[:-rest], a[rest:]) if rest else a


#: Bytes that ``segment_hash`` handles at once.
HASHED = 1 << 18
_POW, _INV = powers(P, HASHED + 1), powers(pow(P, -1, 2**64), HASHED + 1)


def segment_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of the byte ranges [starts, ends), ascending and disjoint; blocks bound the memory."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = min(len(starts), int(np.searchsorted(ends, starts[i] + HASHED, "right")))
        if j <= i:  # one very long range
            b, h, done = buf[starts[i] : ends[i]], U64(0), 0
            while done < len(b):
                part = BYTE[b[done : done + HASHED]]
                h += (part * _POW[: len(part)]).sum(dtype=U64) * U64(pow(P, done, 2**64))
                done += len(part)
            out[i] = h
            i += 1
            continue
        a, z = starts[i], ends[j - 1]
        c = np.zeros(z - a + 1, U64)
        np.cumsum(BYTE[buf[a:z]] * _POW[: z - a], out=c[1:])
        out[i:j] = (c[ends[i:j] - a] - c[starts[i:j] - a]) * _INV[starts[i:j] - a]
        i = j
    return mix(out + (ends - starts).astype(U64) * U64(0x632BE59BD9B4E019))


# --- words ----------------------------------------------------------------------------------

#: Bytes of words [^\x20\x09-\x0D]+ ; other code points are all above 0x7F in UTF-8.
BLANK_WORD = np.ones(256, bool)
BLANK_WORD[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower-cased.
LETTER_WORD = np.zeros(256, bool)
LETTER_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def word_bounds(b: Batch, table: np.ndarray, buf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) : byte ranges of all words; words of document i are first[i] .. first[i + 1] - 1."""
    raw = np.frombuffer(b.buf, np.uint8) if buf is None else buf
    edge = np.zeros(len(raw) + 1, bool)  # edge[i]: byte i and byte i - 1 differ in kind, or a document begins
    inside = table[raw]
    if len(raw):
        edge[0] = inside[0]
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[-1] = inside[-1]
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    cuts = np.unique(b.off[1:-1])
    k = np.searchsorted(starts, cuts, "left") - 1  # the word that begins before the cut
    hit = (k >= 0) & (ends[np.maximum(k, 0)] > cuts) if len(starts) else np.zeros(len(cuts), bool)
    if hit.any():
        starts = np.sort(np.concatenate([starts, cuts[hit]]))
        ends = np.sort(np.concatenate([ends, cuts[hit]]))
    return starts, ends, np.searchsorted(starts, b.off, "left")
