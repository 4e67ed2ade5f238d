"""Line deduplication by content-defined chunks of lines.

A rolling hash over the hashes of the last ``roll`` lines puts a boundary behind a line when it falls
into one of ``mean`` classes, so boundaries follow the content and move with it when lines are inserted
elsewhere.  Chunks of several lines that occur again anywhere in the collection are candidates; they are
compared byte by byte, the earliest stays and the others are removed.

A repeated passage need not hold a whole chunk, and goes on beyond those it holds.  Therefore each line with
words and the next one (with the blank lines between) are a chunk of their own as well: these overlap, so
every line of a repeated passage of two or more lines with words is removed, up to both ends.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .column_bwt import repeated
from .exchange import Reads, Segments, Windows, find_repeats, id_array, rank_pairs


def line_bounds(b: c.Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges of all ``\\n``-separated lines, and the first line of each document (a text has one line at least)."""
    raw = np.frombuffer(b.buf, np.uint8)
    nl = np.flatnonzero(raw == 10)
    doc = np.searchsorted(b.off[1:], nl, "right")
    count = np.bincount(doc, minlength=len(b)) + 1 if len(b) else np.zeros(0, np.int64)
    first = np.concatenate([np.zeros(1, np.int64), np.cumsum(count)])
    starts, ends = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    at = np.arange(len(nl)) + doc  # the line that the k-th newline ends
    ends[at], starts[at + 1] = nl, nl + 1
    starts[first[:-1]], ends[first[1:] - 1] = b.off[:-1], b.off[1:]
    return starts, ends, first


class LineChunks(Windows):
    schema = "doc_id long, n_lines long, n_removed long, n_chunks_removed long, kept_sha256 string"
    copies = False

    def __init__(self, mean: int = 4, roll: int = 2, keep_text: bool = False):
        if mean < 1 or roll < 1:
            raise ValueError("mean and roll must be positive")
        self.mean, self.roll, self.keep_text = mean, roll, keep_text
        if keep_text:
            self.schema = self.schema + ", kept string"

    def segments(self, b):
        raw = np.frombuffer(b.buf, np.uint8)
        starts, ends, first = line_bounds(b)
        n = len(starts)
        if not n:
            empty = np.zeros(0, np.int64)
            return Segments(np.zeros(0, np.uint64), empty, empty, empty, empty), (starts, ends, first)
        h = c.segment_hash(raw, starts, ends)
        last = np.zeros(n, bool)
        if n >= self.roll:
            last[self.roll - 1 :] = c.mix(c.grams(h, self.roll)) % c.U64(self.mean) == 0
        # the rolling hash begins anew in each document
        line = np.arange(n) - np.repeat(first[:-1], np.diff(first))
        last &= line >= self.roll - 1
        last[first[1:] - 1] = True
        z = np.flatnonzero(last) + 1
        a = np.concatenate([np.zeros(1, np.int64), z[:-1]])
        words = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(c.BLANK_WORD[raw], out=words[1:])
        full = np.concatenate([np.zeros(1, np.int64), np.cumsum(words[ends] > words[starts])])
        some = words[ends] > words[starts]
        # a chunk of two lines with words, and no others at its ends, is a pair already
        multi = (full[z] - full[a] > 2) | (full[z] - full[a] == 2) & ~(some[a] & some[z - 1])
        a, z = a[multi], z[multi]
        key = c.segment_hash(raw, starts[a], ends[z - 1])
        own = np.flatnonzero(some)
        p, q = own[:-1], own[1:]
        inside = np.repeat(np.arange(len(b)), np.diff(first))
        one = inside[p] == inside[q]
        p, q = p[one], q[one]
        key = np.concatenate([key, c.mix(c.mix(h[p] + c.U64(1)) + h[q] * c.U64(c.P))])
        a, z = np.concatenate([a, p]), np.concatenate([z, q + 1])
        doc = np.searchsorted(first, a, "right") - 1
        return Segments(key, doc, a, z, a), (starts, ends, first)

    def read_texts(self, b, state, s, at):
        starts, ends, _ = state
        return [b.buf[i:j] for i, j in zip(starts[s.start[at]].tolist(), ends[s.stop[at] - 1].tolist())]

    def resolve(self, r: Reads):
        number: dict[bytes, int] = {}
        group = np.array([number.setdefault(t, len(number)) for t in r.texts], np.int64)
        prio, ids, rows = rank_pairs(r.order, r.batch, r.doc, r.start)
        order = np.lexsort((prio, group))
        equal = np.zeros(len(order), bool)
        equal[1:] = group[order][1:] == group[order][:-1]
        bad = repeated(order, equal, prio, ids, rows) if equal.any() else np.zeros(0, np.int64)
        lines = np.array([t.count(b"\n") + 1 for t in r.texts], np.int64)
        return bad, r.start[bad], r.start[bad] + lines[bad]

    def whole(self, b, state, docs):
        raise NotImplementedError

    def finish(self, b, starts, stops):
        ls, le, first = line_bounds(b)
        step = np.zeros(len(ls) + 1, np.int32)
        np.add.at(step, starts, 1)
        np.add.at(step, stops, -1)
        gone = np.cumsum(step)[: len(ls)] > 0
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(gone)])
        removed = total[first[1:]] - total[first[:-1]]
        runs = np.zeros(len(b), np.int64)
        if len(starts):
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            edge[first[:-1][first[:-1] < len(gone)]] |= gone[first[:-1][first[:-1] < len(gone)]]
            np.add.at(runs, np.searchsorted(first, np.flatnonzero(edge), "right") - 1, 1)
        sha, kept = [], []
        for i in range(len(b)):
            text = b.text(i)
            if removed[i]:
                mask = gone[first[i] : first[i + 1]].tolist()
                text = b"\n".join(x for x, g in zip(text.split(b"\n"), mask) if not g)
            sha.append(hashlib.sha256(text).hexdigest())
            if self.keep_text:
                kept.append(text.decode())
        out = [id_array(b), pa.array(np.diff(first).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(runs), pa.array(sha, pa.string())]
        return out + ([pa.array(kept, pa.string())] if self.keep_text else [])


def remove_repeated_chunks(
    docs: DataFrame, mean: int = 4, roll: int = 2, keep_text: bool = False, carry: list[str] | None = None, id_name: str = "doc_id", text_name: str = "text"
) -> DataFrame:
    """Remove every passage of several lines, at least two of which hold a word, that also occurs earlier in the collection.

    Earlier: in a document with a smaller id, or before it in the same document.  Lines are compared whole; a passage
    ends with its first and last line that holds a word, or with those of a content-defined chunk.  A line that is
    repeated without a neighbour stays.  ``n_chunks_removed`` counts maximal removed runs
    of lines.  A null text is one empty line; a null id comes last; rows that share an id are separate, of which
    none is earlier.  ``keep_text`` adds the text that is left (lines joined by newlines), ``carry`` further columns
    under the prefix of ``common.CARRIED``.
    """
    return find_repeats(docs, LineChunks(mean, roll, keep_text), id_name, text_name, carry)


def dedup_lines(docs: DataFrame, mean: int = 4, roll: int = 2, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """The documents with repeated chunks removed, in their own columns; those left without a word go.

    A document that lost nothing stays as it is, empty or null ones included.  An integer column
    ``n_chars`` is counted anew where lines went.
    """
    none = "none"
    while none in docs.columns:  # a name that no column of the documents has
        none += "_"
    carry = [k for k in docs.columns if k != text_name] + [none]
    # the text travels once: where nothing went, what is left is the text, and a null one is marked
    out = remove_repeated_chunks(docs.withColumn(none, c.cell(text_name).isNull()), mean, roll, True, carry, id_name, text_name)
    changed = F.col("n_removed") > 0
    out = out.where(~changed | F.col("kept").rlike("[^\\x20\\x09-\\x0D]"))
    cells = []
    for k in docs.columns:
        own = c.cell(c.CARRIED + k)
        if k == text_name:
            own = F.when(~c.cell(c.CARRIED + none), F.col("kept"))
        elif k == "n_chars":
            own = F.when(changed, F.length("kept").cast(docs.schema[k].dataType)).otherwise(own)
        cells.append(own.alias(k))
    return out.select(*cells)
