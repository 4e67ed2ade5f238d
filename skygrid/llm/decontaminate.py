"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

The windows of all benchmark items are hashed into a sorted table with a bit filter before it.  Training
documents are scanned window by window with vectorised rolling hashes; windows whose hash is known are
compared word by word before they count.  The item table is broadcast only in blocks of a checked size.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import common as c

#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 8 << 20
FILTER_BITS = 22
SCAN_SCHEMA = "doc_id long, text string, hit_runs binary, item_ids array<string>, n_words long, n_hit long"


def words_of(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased."""
    return text.translate(_SPLIT).split()


_SPLIT = bytes(x if c.LETTER_WORD[x] else 0x20 for x in c.LOWER)


class ItemWindows:
    """Windows of benchmark items by length: sorted hashes with a bit filter before them, and where each window's words stand.

    All of it is a few arrays (about five times the items' text), made once on the driver and broadcast.
    """

    def __init__(self, items: list[tuple[str | None, str]], width: int = 13):
        self.ids = np.array([x for x, _ in items], object)
        words = [words_of(text.encode()) for _, text in items]
        count = np.array([len(w) for w in words], np.int64)
        self.text = b" ".join(b" ".join(w) for w in words if w)
        b = c.Batch(0, np.zeros(1, np.int64), np.ones(1, bool), np.array([len(self.text)]), self.text)
        self.starts, self.ends, _ = c.word_bounds(b, c.LETTER_WORD)
        del words
        h = c.segment_hash(np.frombuffer(self.text, np.uint8), self.starts, self.ends)
        off = np.cumsum(count) - count
        sizes = np.minimum(count, width)
        self.sizes: dict[int, tuple] = {}
        for size in np.unique(sizes[sizes > 0]).tolist():
            own = np.flatnonzero(sizes == size)
            n = count[own] - size + 1
            item = np.repeat(own, n)
            at = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + off[item]
            g = window_hash(h, size)[at]
            order = np.lexsort((at, g))
            g, at, item = g[order], at[order], item[order]
            # entries of one hash whose words differ from the first one's are kept apart
            first = np.ones(len(g), bool)
            first[1:] = g[1:] != g[:-1]
            head = np.flatnonzero(first)
            odd: dict[bytes, list[int]] = {}
            group = np.cumsum(first) - 1
            good = np.ones(len(g), bool)
            for i in np.flatnonzero(~first).tolist():
                words_i = self._window(at[i], size)
                if words_i != self._window(at[head[group[i]]], size):
                    odd.setdefault(words_i, []).append(int(item[i]))
                    good[i] = False
            g, at, item = g[good], at[good], item[good].astype(np.int32)
            begin = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
            bits = np.zeros(1 << FILTER_BITS, bool)
            bits[(g >> c.U64(64 - FILTER_BITS)).astype(np.int64)] = True
            self.sizes[size] = (g[begin], at[begin].astype(np.int32), np.append(begin, len(g)).astype(np.int32), item, np.packbits(bits), odd)

    def _window(self, at: int, size: int) -> bytes:
        return self.text[self.starts[at] : self.ends[at + size - 1]]

    def find(self, size: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the hashes that windows of this length have, and those windows' numbers."""
        known, _, _, _, packed, _ = self.sizes[size]
        cell = (hashes >> c.U64(64 - FILTER_BITS)).astype(np.int64)
        at = np.flatnonzero((packed[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1)
        which = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
        same = known[which] == hashes[at]
        return at[same], which[same]

    def items_of(self, size: int, which: int, words: bytes) -> list[int]:
        """Items in which a window with these words stands; none if only the hash was equal."""
        _, at, begin, item, _, odd = self.sizes[size]
        if self._window(at[which], size) == words:
            return item[begin[which] : begin[which + 1]].tolist()
        return odd.get(words, [])


def window_hash(h: np.ndarray, size: int) -> np.ndarray:
    return c.mix(c.grams(h, size))


def scan(b: c.Batch, items: ItemWindows):
    """(word starts, word ends, first word of each document, hit mask, item ids of each document)."""
    low = b.buf.translate(c.LOWER)
    raw = np.frombuffer(low, np.uint8)
    starts, ends, first = c.word_bounds(b, c.LETTER_WORD, raw)
    n = len(starts)
    step = np.zeros(n + 1, np.int32)
    found: list[set] = [set() for _ in range(len(b))]
    if n and items.sizes:
        h = c.segment_hash(raw, starts, ends)
        met = set()
        for size in items.sizes:
            at, which = items.find(size, window_hash(h, size))
            doc = np.searchsorted(first, at, "right") - 1
            inside = first[doc + 1] >= at + size
            for i, d, k in zip(at[inside].tolist(), doc[inside].tolist(), which[inside].tolist()):
                words = b" ".join(low[x:y] for x, y in zip(starts[i : i + size].tolist(), ends[i : i + size].tolist()))
                own = items.items_of(size, k, words)
                if own:
                    step[i] += 1
                    step[i + size] -= 1
                    if (d, words) not in met:  # a window met before in this document adds no item
                        met.add((d, words))
                        found[d].update(items.ids[own])
    return starts, ends, first, np.cumsum(step)[:n] > 0, found


def _pieces(text: str, limit: int, width: int):
    """The text, or, if it is longer than the limit, pieces of it that together hold the same windows."""
    if len(text) <= limit // 4:
        yield text
        return
    words = words_of(text.encode())
    a = 0
    while a < len(words):
        z, size = a, 0
        while z < len(words) and (size < limit // 2 or z - a < width):
            size += len(words[z]) + 1
            z += 1
        yield b" ".join(words[a:z]).decode()
        if z == len(words):
            break
        a = z - width + 1


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str, limit: int, width: int):
    """Items in blocks of at most about ``limit`` bytes, fetched a partition at a time; an item beyond that comes in pieces."""
    items = benchmark.select(c.cell(item_id).cast("string").alias("item"), F.coalesce(c.cell(item_text).cast("string"), F.lit("")).alias("text"))
    block, size = [], 0
    for item, text in items.distinct().toLocalIterator():
        for piece in _pieces(text, limit, width):
            more = len(piece.encode()) + 32
            if block and size + more > limit:
                yield block
                block, size = [], 0
            block.append((item, piece))
            size += more
    yield block


def find_hits(
    docs: DataFrame, benchmark: DataFrame, width: int = 13, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None, percent: int | None = None,
    id_name: str = "doc_id", text_name: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Documents with the words that lie in an occurring benchmark window.

    Adds ``hit_runs`` (int64 pairs: byte ranges of the text from the first to the last word of a run of hit words),
    ``item_ids`` (sorted as strings), ``n_words`` and ``n_hit``.  Benchmarks beyond ``block_bytes`` are scanned in blocks,
    one pass each, with the documents written to shared storage in between.  A null text has no words; an item
    with a null id marks words but is not listed; equal ids are one item; an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    fields = StructType.fromDDL(SCAN_SCHEMA)
    for k in carry or []:
        fields = fields.add(c.CARRIED + k, docs.schema[k].dataType)
    out, number, blocks = c.select_documents(docs, id_name, text_name, carry), 0, item_blocks(benchmark, item_id, item_text, block_bytes, width)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        table = spark.sparkContext.broadcast(ItemWindows(block, width))
        last = after is None and percent is not None
        end = StructType([*fields, StructField("cut", StringType())]) if last else fields
        out = out.mapInArrow(_scanner(table, width, end.names, number > 0, percent), end)
        if after is not None:
            out = c.cut(out, "hits")
            table.destroy()
        block, number = after, number + 1
    return out


def _scanner(table, width: int, names: list[str], again: bool, percent: int | None):
    def run(records):
        items = table.value
        for rec in records:
            # whole record batches: the carried columns and nulls stay as they are
            lens, _, buf = c.text_bytes(rec.column(rec.schema.get_field_index("text")))
            off = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])
            a = 0
            while a < len(lens):
                z = max(a + 1, int(np.searchsorted(off, off[a] + c.PACK_BYTES, "right")) - 1)
                z = min(z, len(lens))
                part = rec.slice(a, z - a)
                b = c.Batch(0, np.zeros(z - a, np.int64), np.ones(z - a, bool), lens[a:z], buf[off[a] : off[z]])
                starts, ends, first, hit, found = scan(b, items)
                if again:
                    for d, (runs, ids) in enumerate(zip(part.column(part.schema.get_field_index("hit_runs")).to_pylist(), part.column(part.schema.get_field_index("item_ids")).to_pylist())):
                        found[d] |= set(ids)
                        for x, y in np.frombuffer(runs, np.int64).reshape(-1, 2):
                            i, j = np.searchsorted(starts, [x + b.off[d], y + b.off[d]])
                            hit[i:j] = True
                total = np.concatenate([np.zeros(1, np.int64), np.cumsum(hit)])
                n_hit = total[first[1:]] - total[first[:-1]]
                runs = [b""] * len(b)
                for d in np.flatnonzero(n_hit):
                    mask = hit[first[d] : first[d + 1]].astype(np.int8)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
                    pairs = np.stack([starts[first[d] + edge[0::2]], ends[first[d] + edge[1::2] - 1]], axis=1) - b.off[d]
                    runs[d] = pairs.astype(np.int64).tobytes()
                ids = [sorted(x for x in s if x is not None) for s in found]
                own = {"hit_runs": pa.array(runs, pa.binary()), "item_ids": pa.array(ids, pa.list_(pa.string())), "n_words": pa.array(np.diff(first).astype(np.int64)), "n_hit": pa.array(n_hit.astype(np.int64))}
                if "cut" in names:
                    words = np.diff(first)
                    own["cut"] = pa.array([without(b.text(d), runs[d]) if 0 < n_hit[d] and n_hit[d] * 100 < words[d] * percent else None for d in range(len(b))], pa.string())
                yield pa.RecordBatch.from_arrays([own[k] if k in own else part.column(part.schema.get_field_index(k)) for k in names], names=names)
                a = z

    return run


def contaminated(percent: int = 5):
    """Share of hit words at which a document counts as contaminated."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * F.lit(100) >= F.col("n_words") * F.lit(percent))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 13, **names) -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = find_hits(docs, benchmark, width, **names)
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, percent: int = 5, id_name: str = "doc_id", text_name: str = "text", **names) -> DataFrame:
    """The documents, in their own columns, without benchmark passages.

    Documents with at least ``percent`` per cent of hit words go; from the others the hit runs are cut out, each
    leaving one space.  Untouched documents, null and empty texts included, stay as they are; an integer column ``n_chars``
    is counted anew where text was cut.
    """
    carry = [k for k in docs.columns if k != text_name]
    hits = find_hits(docs, benchmark, width, carry=carry, percent=percent, id_name=id_name, text_name=text_name, **names).where(~contaminated(percent))
    cells = []
    for k in docs.columns:
        own = c.cell(c.CARRIED + k)
        if k == text_name:
            own = F.when(F.col("n_hit") > 0, F.col("cut")).otherwise(F.col("text"))
        elif k == "n_chars":
            own = F.when(F.col("n_hit") > 0, F.length("cut").cast(docs.schema[k].dataType)).otherwise(own)
        cells.append(own.alias(k))
    return hits.select(*cells)


def without(raw: bytes, runs: bytes) -> str:
    """The text with byte ranges replaced by one space each."""
    parts, at = [], 0
    for x, y in np.frombuffer(runs, np.int64).reshape(-1, 2):
        parts.append(raw[at:x])
        at = y
    return b" ".join([*parts, raw[at:]]).decode()


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
