"""Suffix-array deduplication by column-wise construction over many documents.

Reads (segments of documents that may repeat) are laid side by side.  Each round moves one column to
the left and inserts one symbol of every read: the order of the suffixes that begin in this column
follows from the order of the column before by one stable distribution on the inserted symbols (the
column of the collection's Burrows-Wheeler transform), and the common prefix of two neighbours is one
more than the least common prefix between their places in the column before.  Neighbours with a common
prefix of ``width`` bytes hold the same string.

Equal strings pick the same anchor byte, so reads are aligned at their anchors and only suffixes of
one column have to be compared: the transform is kept by column (positional) instead of being merged
over all columns.  A merged transform would rewrite all inserted symbols in each round; this form costs
a fixed amount per symbol.  Rounds need the column before and nothing else; the reads by column and the
transform's parts are sequential files, kept in memory up to SPOOL bytes each and beyond that in the task's own
scratch folder, from which nothing is read by another task.  A bucket's reads are in memory once, while the
file is written; after that memory holds one column, its order and common prefixes, and the matches.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c
from .common import Batch
from .exchange import Reads, Segments, Windows, find_repeats, id_array, rank_pairs

SPOOL = 8 << 20
SLICE = 1 << 17


def anchored_runs(grams: np.ndarray, w: int, valid: np.ndarray, fresh: np.ndarray):
    """Runs of valid window starts with one anchor: (first window, last window, anchor position).

    The anchor of a window is its leftmost gram of least 32-bit hash, so it depends on the window alone.
    ``fresh`` marks window starts that begin a document.
    """
    n = min(len(valid), max(0, len(grams) - w + 1))
    if not n or not valid[:n].any():
        return (np.zeros(0, np.int64),) * 3
    key = (grams & c.U64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=c.U64)
    at = (c.sliding_min(key, w)[:n] & c.U64(0xFFFFFFFF)).astype(np.int64)
    valid = valid[:n]
    first = valid.copy()
    first[1:] &= (at[1:] != at[:-1]) | fresh[1:n] | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    a, z = np.flatnonzero(first), np.flatnonzero(last)
    return a, z, at[a]


class Columns:
    """The reads of one column after another, right to left, through a sequential external file.

    Once it is made, the reads' bytes are in the file alone and the caller may let go of them.
    """

    def __init__(self, buf: np.ndarray, off: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.left, self.right = left, right
        self.low, self.high = (int(left.min()), int(right.max())) if len(left) else (0, 0)
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL)  # noqa: SIM115
        self.sizes = []
        for col in range(self.high - 1, self.low - 1, -1):
            active = np.flatnonzero((left <= col) & (right > col))
            self.sizes.append(len(active))
            self.file.write(active.astype(np.int32).tobytes())
            self.file.write(buf[off[active] + (col - left[active])].tobytes())

    def __iter__(self):
        self.file.seek(0)
        for col, n in zip(range(self.high - 1, self.low - 1, -1), self.sizes):
            reads = np.frombuffer(self.file.read(4 * n), np.int32)
            yield col, reads, np.frombuffer(self.file.read(n), np.uint8)


class Transform:
    """The collection's Burrows-Wheeler transform, column by column, with the common prefixes, built by insertion.

    A round inserts one symbol of every read.  The symbols in the order of the suffixes that they precede are the
    transform's part of this column; they go to a second sequential file, from which ``parts`` reads them back.
    """

    def __init__(self, columns: Columns):
        self.columns = columns
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOL)  # noqa: SIM115
        self.sizes: list[tuple[int, int]] = []

    def rounds(self):
        """For every column: (column, reads in suffix order, common prefix of each suffix with the one before it)."""
        right = self.columns.right
        order, lcp = np.zeros(0, np.int32), np.zeros(0, np.int32)
        symbol = np.zeros(len(right), np.uint8)
        here = np.zeros(len(right), bool)
        for col, active, symbols in self.columns:
            here[:] = False
            here[active] = True
            symbol[active] = symbols
            new = active[right[active] == col + 1]
            if len(new):
                order = np.concatenate([new, order])
                lcp = np.concatenate([np.zeros(len(new), np.int32), lcp])
            stay = np.flatnonzero(here[order])
            s = symbol[order[stay]]
            self.sizes.append((col, len(s)))
            self.file.write(s.tobytes())
            by = np.argsort(s, kind="stable")
            pos, s = stay[by], s[by]
            grown = np.zeros(len(pos), np.int32)
            if len(pos) > 1:
                same = s[1:] == s[:-1]
                ends = np.empty(2 * (len(pos) - 1), np.int64)
                ends[0::2], ends[1::2] = pos[:-1] + 1, pos[1:] + 1
                least = np.minimum.reduceat(np.append(lcp, 0), ends)[0::2]
                grown[1:][same] = least[same] + 1
            order, lcp = order[pos], grown
            yield col, order, lcp

    def parts(self):
        """(column, its part of the transform) of all rounds so far."""
        self.file.seek(0)
        for col, n in self.sizes:
            yield col, self.file.read(n)


def equal_windows(columns: Columns, width: int):
    """For every column: (column, reads in suffix order, mask "equals the string before it over width bytes")."""
    for col, order, lcp in Transform(columns).rounds():
        full = np.flatnonzero(columns.right[order] - col >= width)
        if len(full) > 1:
            # between two long suffixes lie no shorter ones with a common prefix of the width
            equal = np.zeros(len(full), bool)
            equal[1:] = (np.diff(full) == 1) & (lcp[full[1:]] >= width)
            if equal.any():
                yield col, order[full], equal


class ByteWindows(Windows):
    """Strings of ``width`` bytes of whole UTF-8 texts."""

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def __init__(self, width: int = 100, gram: int = 16, keep_text: bool = False):
        if width < gram:
            raise ValueError("width must be at least gram")
        self.width, self.gram, self.least = width, gram, width
        self.keep_text = keep_text
        if keep_text:
            self.schema = self.schema + ", kept binary, removed array<struct<start:bigint,stop:bigint>>"

    def segments(self, b: Batch):
        raw = np.frombuffer(b.buf, np.uint8)
        n, w = len(raw), self.width - self.gram + 1
        starts, stops, anchors, keys = [], [], [], []
        # window i is valid if its document ends at i + width or later
        ends = b.off[1:]
        for a in range(0, max(0, n - self.width + 1), SLICE):
            z = min(n, a + SLICE + self.width - 1)
            part = raw[a:z]
            count = len(part) - self.width + 1
            d0, d1 = np.searchsorted(b.off, a, "right") - 1, np.searchsorted(b.off, a + count, "left")
            step = np.zeros(count + 1, np.int32)
            fresh = np.zeros(count, bool)
            begin, stop = np.maximum(b.off[d0:d1], a) - a, np.minimum(ends[d0:d1] - self.width + 1 - a, count)
            ok = stop > begin
            np.add.at(step, begin[ok], 1)
            np.add.at(step, stop[ok], -1)
            fresh[begin[ok]] = True
            g = c.mix(c.grams(c.BYTE[part], self.gram))
            i, j, at = anchored_runs(g, w, np.cumsum(step[:-1]) > 0, fresh)
            starts.append(i + a)
            stops.append(j + a + self.width)
            anchors.append(at + a)
            keys.append(c.mix(g[at] ^ c.U64(0xA5A5A5A5A5A5A5A5)))
        if not starts:
            empty = np.zeros(0, np.int64)
            return Segments(np.zeros(0, np.uint64), empty, empty, empty, empty), raw
        s = np.concatenate(starts)
        doc = np.searchsorted(b.off, s, "right") - 1
        return Segments(np.concatenate(keys), doc, s, np.concatenate(stops), np.concatenate(anchors)), raw

    def read_texts(self, b, state, s, at):
        return [b.buf[i:j] for i, j in zip(s.start[at].tolist(), s.stop[at].tolist())]

    def whole(self, b, state, docs):
        return b.off[docs], b.off[docs + 1]

    def resolve(self, r: Reads):
        size = np.array([len(t) for t in r.texts], np.int64)
        buf = np.frombuffer(b"".join(r.texts), np.uint8)
        off = np.cumsum(size) - size
        left, right = -r.anchor.astype(np.int64), size - r.anchor
        prio, ids, rows = rank_pairs(r.order, r.batch, r.doc, r.start + r.anchor)
        columns = Columns(buf, off, left, right)
        r.texts, buf = [], None  # from here on the bytes are in the columns' file
        found, at = [], []
        for col, order, equal in equal_windows(columns, self.width):
            bad = repeated(order, equal, prio, ids, rows)
            found.append(bad)
            at.append(np.full(len(bad), col, np.int64))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        read, col = np.concatenate(found).astype(np.int64), np.concatenate(at)
        begin = r.start[read] + (col - left[read])
        by = np.lexsort((begin, read))
        read, begin = read[by], begin[by]
        new = np.ones(len(read), bool)
        new[1:] = (read[1:] != read[:-1]) | (begin[1:] > begin[:-1] + 1)
        last = np.ones(len(read), bool)
        last[:-1] = new[1:]
        return read[new], begin[new], begin[last] + self.width

    def finish(self, b, starts, stops):
        raw, n = b.buf, len(b)
        # ranges of neighbouring documents may touch: cut them at document ends
        a, z = np.searchsorted(starts, b.off[:-1], "right") - 1, np.searchsorted(starts, b.off[1:], "left")
        removed, spans, kept, sha, cuts = np.zeros(n, np.int64), np.zeros(n, np.int64), [], [], []
        for i in range(n):
            lo, hi = int(b.off[i]), int(b.off[i + 1])
            parts, at, mine = [], lo, []
            for k in range(max(0, a[i]), z[i]):
                x, y = max(lo, int(starts[k])), min(hi, int(stops[k]))
                if x < y:
                    parts.append(raw[at:x])
                    at = y
                    mine.append((x - lo, y - lo))
            parts.append(raw[at:hi])
            text = b"".join(parts)
            removed[i], spans[i] = hi - lo - len(text), len(mine)
            sha.append(hashlib.sha256(text).hexdigest())
            if self.keep_text:
                kept.append(text)
                cuts.append([{"start": x, "stop": y} for x, y in mine])
        out = [id_array(b), pa.array(b.lens, pa.int64()), pa.array(removed), pa.array(spans), pa.array(sha, pa.string())]
        if self.keep_text:
            out += [pa.array(kept, pa.binary()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
        return out


def repeated(order: np.ndarray, equal: np.ndarray, prio: np.ndarray, ids: np.ndarray, rows: np.ndarray, same_row: bool = True) -> np.ndarray:
    """Members of groups of equal strings that also start earlier (smaller id, or same row and earlier)."""
    member = equal.copy()
    member[:-1] |= equal[1:]
    order, equal = order[member], equal[member]
    begin = np.flatnonzero(~equal)
    group = np.cumsum(~equal) - 1
    p = prio[order]
    least = np.minimum.reduceat(p, begin)
    first = order[np.flatnonzero(p == least[group])]
    bad = ids[order] > ids[first][group]
    if same_row:
        own = (ids[order] == ids[first][group]) & (p != least[group])
        if own.any():
            bad |= own & (rows[order] == rows[first][group])
            rest = np.flatnonzero(own & (rows[order] != rows[first][group]))  # another row with the same id
            if len(rest):
                by = rest[np.lexsort((p[rest], rows[order[rest]], group[rest]))]
                again = (group[by][1:] == group[by][:-1]) & (rows[order[by]][1:] == rows[order[by]][:-1])
                bad[by[1:][again]] = True
    return order[bad]


def remove_repeated_bytes(docs: DataFrame, width: int = 100, keep_text: bool = False, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """Remove each byte covered by a ``width``-byte string that also starts earlier in the collection.

    Earlier: in a document with a smaller id, or in the same document at an earlier start.  Matches never
    cross documents, overlaps count, and strings are judged on the input.  A null text is empty; a null id
    comes last; rows that share an id are separate documents of which none is earlier.  Columns other than
    the two named are ignored.  With ``keep_text`` the remaining bytes and the removed ranges are returned.
    """
    return find_repeats(docs, ByteWindows(width, keep_text=keep_text), id_name, text_name)
