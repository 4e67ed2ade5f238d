"""Find repeated windows of a corpus without sending every window through a shuffle.

All operators that look for equal windows (words, bytes or line chunks) share these passes.

1. *pack*: documents are written once as compressed batches to the shared folder.
2. *keys*: every batch cuts its documents into segments.  A segment holds consecutive windows that
   share one anchor, picked from the window's content alone, so equal windows always carry equal
   anchors.  Only the distinct 64-bit anchor keys of a batch travel (one entry a batch, however often
   a key occurs there); what comes back is one bit a key: does it occur elsewhere?  A 128-bit digest of
   each whole text travels as well, so that exact copies are settled once.
3. *reads*: segments whose anchor occurs once cannot hold a repeated window and are dropped, which
   loses nothing.  Equal segments of a batch, and frequent ones of a task, are combined before the shuffle.
   The others go, as text, to the bucket of their anchor, where the operator's own index decides on the symbols
   themselves.  There is a bucket for so many bytes of text, whatever the number of tasks.
4. *finish*: each batch receives its runs of repeated windows and writes one row a document.

Each pass ends in a durable table or a shuffle keyed by bucket or batch; nothing is gathered on the
driver.  Two windows count as equal after a comparison of their symbols only, never by a 64-bit hash; whole
texts count as copies by their 128-bit BLAKE2 digest.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import common as c
from .common import Batch

LAST = np.iinfo(np.int64).max
#: Bytes of text for which a bucket is made; a bucket is resolved in one Python process.
BUCKET_BYTES = 16 << 20
LEAST_BUCKETS = 16
#: Bytes of reads that a task remembers, so that a frequent read travels once a task and not once a batch.
HELD_BYTES = 8 << 20


@dataclass
class Segments:
    """Runs of windows with one anchor; positions count the operator's symbols within the batch."""

    key: np.ndarray  # uint64 anchor key
    doc: np.ndarray  # document's place in the batch
    start: np.ndarray  # first symbol
    stop: np.ndarray  # behind the last symbol
    anchor: np.ndarray  # symbol at which equal windows are aligned


@dataclass
class Reads:
    """Distinct segment texts of one bucket."""

    batch: np.ndarray
    doc: np.ndarray  # place in the batch
    order: np.ndarray  # doc_id; null ids come last
    start: np.ndarray
    anchor: np.ndarray  # offset within the read
    texts: list[bytes]


class Windows:
    """What an operator supplies; see the modules that subclass it."""

    schema = ""
    copies = True  # settle exact copies of whole texts first
    least = 1  # bytes a text needs to hold a window

    def segments(self, b: Batch):  # -> (Segments, state)
        raise NotImplementedError

    def read_texts(self, b: Batch, state, s: Segments, at: np.ndarray) -> list[bytes]:
        raise NotImplementedError

    def resolve(self, r: Reads):  # -> (read number, first symbol, behind the last symbol) of repeated runs
        raise NotImplementedError

    def whole(self, b: Batch, state, docs: np.ndarray):  # -> (start, stop) of copies
        raise NotImplementedError

    def finish(self, b: Batch, starts: np.ndarray, stops: np.ndarray) -> list[pa.Array]:
        raise NotImplementedError

    def same_document_counts(self) -> bool:
        """Does an earlier window of the same document make a window repeated?"""
        return True


def pack_data(*parts) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(parts, protocol=5))


def unpack_data(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def order_of(b: Batch) -> np.ndarray:
    return np.where(b.known, b.ids, LAST)


def digests(b: Batch, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents long enough, and 16-byte digests of their texts as pairs of uint64."""
    docs = np.flatnonzero(b.lens >= max(1, least))
    raw = b"".join(hashlib.blake2b(b.text(i), digest_size=16).digest() for i in docs)
    return docs, np.frombuffer(raw, np.uint64).reshape(-1, 2)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending in the key, so sorted keys fall into consecutive buckets."""
    return ((key >> c.U64(32)) * c.U64(buckets) >> c.U64(32)).astype(np.int64)


def split_by(bucket: np.ndarray, buckets: int):
    """(bucket, slice) for each bucket that occurs in an ascending array."""
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), slice(edges[k], edges[k + 1])


def _distinct(b: Batch, least: int):
    """Digests of a batch, ascending: (documents, place of each one's digest, digests, least id of each)."""
    docs, d = digests(b, least)
    u, inv = np.unique(d, axis=0, return_inverse=True) if len(d) else (d, np.zeros(0, np.int64))
    first = np.full(len(u), LAST, np.int64)
    np.minimum.at(first, inv.ravel(), order_of(b)[docs])
    return docs, inv.ravel(), u, first


KEY_SCHEMA = "side int, bucket int, batch long, data binary"


def _send_keys(w: Windows, buckets: int):
    schema = pa.schema([("side", pa.int32()), ("bucket", pa.int32()), ("batch", pa.int64()), ("data", pa.binary())])

    def run(records):
        for row in c.rows_of(records):
            b = c.unpack(row)
            out = []
            s, _ = w.segments(b)
            u, n = np.unique(s.key, return_counts=True)
            for k, at in split_by(bucket_of(u, buckets), buckets):
                out.append((0, k, b.number, pickle.dumps((u[at], np.packbits(n[at] > 1)), protocol=5)))
            if w.copies:
                _, _, d, first = _distinct(b, w.least)
                for k, at in split_by(bucket_of(d[:, 0], buckets), buckets):
                    out.append((1, k, b.number, pickle.dumps((d[at], first[at]), protocol=5)))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)

    return run


def _match_keys(table: pa.Table) -> pa.Table:
    """One bit a key (is it elsewhere too?), or the least id of each digest."""
    batches = table.column("batch")
    sets = [pickle.loads(x.as_py()) for x in table.column("data")]
    sizes = np.cumsum([len(x[0]) for x in sets])[:-1]
    if table.column("side")[0].as_py() == 0:
        keys = np.concatenate([x[0] for x in sets])
        multi = np.concatenate([np.unpackbits(x[1], count=len(x[0])) for x in sets]).astype(bool)
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = np.zeros(len(k) + 1, bool)
        same[1:-1] = k[1:] == k[:-1]
        shared = np.empty(len(k), bool)
        shared[order] = same[1:] | same[:-1]
        data = [np.packbits(x).tobytes() for x in np.split(shared | multi, sizes)]
    else:
        d = np.concatenate([x[0] for x in sets])
        first = np.concatenate([x[1] for x in sets])
        u, inv = np.unique(d, axis=0, return_inverse=True)
        least = np.full(len(u), LAST, np.int64)
        np.minimum.at(least, inv.ravel(), first)
        data = [x.tobytes() for x in np.split(least[inv.ravel()], sizes)]
    return pa.table({"side": table.column("side"), "bucket": table.column("bucket"), "batch": batches, "data": pa.array(data, pa.binary())})


READ_SCHEMA = "bucket int, batch long, data binary"


def _send_reads(w: Windows, buckets: int):
    schema = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("data", pa.binary())])

    def run(records):
        held: dict[tuple, int] = {}  # frequent reads of the task's earlier batches, with the least id of each
        size = 0
        for row in c.rows_of(records):
            b = c.unpack(row)
            order = order_of(b)
            back: dict[tuple[int, int], bytes] = {(x["side"], x["bucket"]): x["data"] for x in row["back"] or []}
            s, state = w.segments(b)
            u, inv = np.unique(s.key, return_inverse=True)
            shared = np.zeros(len(u), bool)
            for k, at in split_by(bucket_of(u, buckets), buckets):
                shared[at] = np.unpackbits(np.frombuffer(back[0, k], np.uint8), count=at.stop - at.start).astype(bool)
            keep = shared[inv.ravel()]
            done: list[tuple[np.ndarray, np.ndarray]] = []
            if w.copies:
                docs, place, d, _ = _distinct(b, w.least)
                least = np.zeros(len(d), np.int64)
                for k, at in split_by(bucket_of(d[:, 0], buckets), buckets):
                    least[at] = np.frombuffer(back[1, k], np.int64)
                copy = docs[order[docs] > least[place]]
                done.append(w.whole(b, state, copy))
                is_copy = np.zeros(len(b), bool)
                is_copy[copy] = True
                keep &= ~is_copy[s.doc]
            at = np.flatnonzero(keep)
            at = at[np.lexsort((s.start[at], s.doc[at], order[s.doc[at]]))]
            texts = w.read_texts(b, state, s, at)
            # Equal reads of the batch: the earliest travels, later ones are settled here.
            first: dict[tuple, int] = {}
            send, drop, known = [], [], []
            shift = s.anchor[at] - s.start[at]
            docs_at, same_doc = s.doc[at], w.same_document_counts()
            for i, (t, k) in enumerate(zip(texts, shift.tolist())):
                j, mine = first.setdefault((t, k), i), int(order[docs_at[i]])
                if j != i and (mine > order[docs_at[j]] or (same_doc and docs_at[i] == docs_at[j])):
                    drop.append(i)
                elif held.get((t, k), mine) < mine:
                    known.append(i)
                else:  # the first of its kind, or of the same doc_id and not earlier
                    send.append(i)
                    if (t, k) not in held:
                        size += len(t) + 200
                    held[t, k] = mine
            gone = at[np.array(drop, np.int64)]
            done.append((s.start[gone], s.stop[gone]))
            starts, stops = (np.concatenate(x) for x in zip(*done))
            out = []
            if len(starts):
                out.append((-1 - b.number % buckets, b.number, pack_data(starts, stops)))
            if size > HELD_BYTES:
                held, size = {}, 0
            # what an earlier batch of the task settles goes the way of the read that settles it: if the task
            # is tried again and meets its batches in another order, either all of a key or nothing is replaced
            send, known = np.array(send, np.int64), np.array(known, np.int64)
            both = np.concatenate([send, known])
            to, is_known = bucket_of(s.key[at[both]], buckets), np.arange(len(both)) >= len(send)
            by = np.argsort(to, kind="stable")
            for k, part in split_by(to[by], buckets):
                i, rest = both[by[part]], is_known[by[part]]
                i, rest = i[~rest], i[rest]
                mine = [texts[j] for j in i]
                sizes = np.array([len(t) for t in mine], np.int64)
                g, r = at[i], at[rest]
                out.append((k, b.number, pack_data(s.doc[g].astype(np.int32), order[s.doc[g]], s.start[g], shift[i].astype(np.int32), sizes, b"".join(mine), s.start[r], s.stop[r])))
            if out:
                cols = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)

    return run


def _resolve_reads(w: Windows):
    def run(table: pa.Table) -> pa.Table:
        numbers = table.column("batch").to_pylist()
        if table.column("bucket")[0].as_py() < 0:
            return table.select(["batch", "data"])
        parts = [unpack_data(x.as_py()) for x in table.column("data")]
        texts: list[bytes] = []
        for p in parts:
            off = np.concatenate([np.zeros(1, np.int64), np.cumsum(p[4])]).tolist()
            texts += [p[5][a:z] for a, z in zip(off, off[1:])]
        r = Reads(np.repeat(np.array(numbers, np.int64), [len(p[0]) for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in range(4)), texts)
        settled = [np.repeat(np.array(numbers, np.int64), [len(p[6]) for p in parts]), *(np.concatenate([p[i] for p in parts]) for i in (6, 7))]
        del parts
        read, starts, stops = w.resolve(r) if texts else ((np.zeros(0, np.int64),) * 3)
        batch, starts, stops = (np.concatenate(x) for x in zip((r.batch[read], starts, stops), settled))
        c.release()
        by = np.argsort(batch, kind="stable")
        found, cuts = np.unique(batch[by], return_index=True)
        data = [pack_data(starts[i], stops[i]) for i in np.split(by, cuts[1:])] if len(found) else []
        return pa.table({"batch": pa.array(found, pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def merge(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of ranges, as ascending disjoint ranges that do not touch."""
    if not len(starts):
        return starts, stops
    by = np.argsort(starts, kind="stable")
    starts, stops = starts[by], np.maximum.accumulate(stops[by])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > stops[:-1]
    last = np.ones(len(starts), bool)
    last[:-1] = new[1:]
    return starts[new], stops[last]


def find_repeats(docs: DataFrame, w: Windows, id_name: str = "doc_id", text_name: str = "text", carry: list[str] | None = None, pack_bytes: int = c.PACK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Run the passes; one row a document, in the columns of ``w.schema`` and those carried."""
    packed = c.pack_documents(docs, id_name, text_name, carry, pack_bytes)
    total = packed.agg(F.sum("size")).first()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-total // bucket_bytes))

    def with_back(back: DataFrame) -> DataFrame:
        return packed.join(back.hint("shuffle_hash"), "batch", "left")

    keys = packed.mapInArrow(_send_keys(w, buckets), KEY_SCHEMA)
    bits = keys.groupBy("side", "bucket").applyInArrow(_match_keys, KEY_SCHEMA)
    bits = bits.groupBy("batch").agg(F.collect_list(F.struct("side", "bucket", "data")).alias("back"))
    reads = with_back(bits).mapInArrow(_send_reads(w, buckets), READ_SCHEMA)
    runs = reads.groupBy("bucket").applyInArrow(_resolve_reads(w), "batch long, data binary")
    runs = c.cut(runs.groupBy("batch").agg(F.collect_list("data").alias("back")), "runs")

    fields = StructType.fromDDL(w.schema)
    for k in carry or []:
        fields = fields.add(c.CARRIED + k, docs.schema[k].dataType)
    names = fields.names

    def finish(records):
        for row in c.rows_of(records):
            b = c.unpack(row)
            found = [unpack_data(x) for x in row["back"] or []]
            starts, stops = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            rest = [b.rest.column(k).combine_chunks() for k in b.rest.schema.names] if b.rest is not None else []
            yield pa.RecordBatch.from_arrays(w.finish(b, *merge(starts, stops)) + rest, names=names)

    return with_back(runs).mapInArrow(finish, fields)


def id_array(b: Batch) -> pa.Array:
    return pa.array(b.ids, pa.int64(), mask=~b.known)


def rank_pairs(order: np.ndarray, batch: np.ndarray, doc: np.ndarray, pos: np.ndarray):
    """(rank by (id, row, position), rank of the id, rank of the row)."""
    by = np.lexsort((pos, doc, batch, order))
    prio = np.empty(len(by), np.int64)
    prio[by] = np.arange(len(by))
    new_id = np.ones(len(by), bool)
    new_id[1:] = order[by][1:] != order[by][:-1]
    new_row = new_id.copy()
    new_row[1:] |= (batch[by][1:] != batch[by][:-1]) | (doc[by][1:] != doc[by][:-1])
    ids, rows = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
    ids[by], rows[by] = np.cumsum(new_id), np.cumsum(new_row)
    return prio, ids, rows
