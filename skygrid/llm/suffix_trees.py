"""Substring deduplication over words by prefix-partitioned suffix trees.

The suffixes of all segments that may repeat are split by prefixes of variable length: first, across
the cluster, by the ``gram``-word phrase at which a window is anchored (see ``exchange``), then, inside
a bucket, word by word until a group of suffixes fits the memory bound.  For each group the suffix
subtree is laid out as the sorted suffixes with their common prefix lengths; its internal nodes are the
intervals of neighbours with a common prefix, and an internal node of at least ``width`` words is a
repeat.  The leaves below such a node start equal windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common as c
from .column_bwt import anchored_runs, repeated
from .exchange import Reads, Segments, Windows, find_repeats, id_array, rank_pairs

#: Suffixes of one subtree; bounds its memory.
GROUP = 1 << 16


def prefix_groups(sym: np.ndarray, at: np.ndarray, width: int, limit: int = GROUP):
    """Split suffixes by prefixes of variable length: (suffixes, symbols they are known to share).

    A group over the limit is split by one more symbol; neighbouring small groups stay together.  Suffixes
    that share ``width`` symbols are never split.
    """
    todo = [(at, 0)]
    while todo:
        group, depth = todo.pop()
        if len(group) <= limit or depth == width:
            if len(group):
                yield group, depth
            continue
        s = sym[group + depth]
        by = np.argsort(s, kind="stable")
        group, s = group[by], s[by]
        edges = np.append(np.flatnonzero(np.append(True, s[1:] != s[:-1])), len(s))
        begin = 0
        for a, z in zip(edges[:-1], edges[1:]):
            if z - a > limit:
                todo.append((group[a:z], depth + 1))
                if a > begin:
                    todo.append((group[begin:a], depth))
                begin = z
            elif z - begin > limit:
                todo.append((group[begin:a], depth))
                begin = a
        todo.append((group[begin:], depth))


def subtree(sym: np.ndarray, at: np.ndarray, depth: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the common prefix of each with the one before it, up to ``width`` symbols."""
    cols = [sym[at + k] for k in range(depth, width)]
    by = np.lexsort(cols[::-1]) if cols else np.arange(len(at))
    lcp = np.full(len(at), depth, np.int32)
    going = np.ones(len(at), bool)
    for col in cols:
        s = col[by]
        going[1:] &= s[1:] == s[:-1]
        lcp += going
    if len(lcp):
        lcp[0] = 0
    return at[by], lcp


class WordWindows(Windows):
    """Windows of ``width`` words ``[^\\x20\\x09-\\x0D]+`` of whole texts."""

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def __init__(self, width: int = 13, gram: int = 4, keep_text: bool = False, group: int = GROUP):
        if not 1 <= gram <= width:
            raise ValueError("gram must be between 1 and width")
        self.width, self.gram, self.keep_text, self.group = width, gram, keep_text, group
        self.least = 2 * width - 1
        if keep_text:
            self.schema = self.schema + ", kept string, removed array<struct<start:bigint,stop:bigint>>"

    def same_document_counts(self):
        return False

    def segments(self, b):
        raw = np.frombuffer(b.buf, np.uint8)
        starts, ends, first = c.word_bounds(b, c.BLANK_WORD)
        state = starts, ends, first
        n = len(starts)
        if n < self.width:
            empty = np.zeros(0, np.int64)
            return Segments(np.zeros(0, np.uint64), empty, empty, empty, empty), state
        g = c.mix(c.grams(c.segment_hash(raw, starts, ends), self.gram))
        count = n - self.width + 1
        step = np.zeros(n + 1, np.int32)
        ok = first[1:] - first[:-1] >= self.width
        begin = first[:-1][ok]
        np.add.at(step, begin, 1)
        np.add.at(step, first[1:][ok] - self.width + 1, -1)
        fresh = np.zeros(n, bool)
        fresh[begin] = True
        i, j, at = anchored_runs(g, self.width - self.gram + 1, np.cumsum(step)[:count] > 0, fresh)
        doc = np.searchsorted(first, i, "right") - 1
        return Segments(c.mix(g[at] ^ c.U64(0x5A5A5A5A5A5A5A5A)), doc, i, j + self.width, at), state

    def read_texts(self, b, state, s, at):
        starts, ends, _ = state
        a, z = starts[s.start[at]].tolist(), ends[s.stop[at] - 1].tolist()
        return [b" ".join(b.buf[i:j].split()) for i, j in zip(a, z)]

    def whole(self, b, state, docs):
        first = state[2]
        docs = docs[first[docs + 1] - first[docs] >= self.width]
        return first[docs], first[docs + 1]

    def resolve(self, r: Reads):
        number: dict[bytes, int] = {}
        flat = [number.setdefault(x, len(number)) for t in r.texts for x in t.split(b" ")]
        size = np.array([t.count(b" ") + 1 for t in r.texts], np.int64)
        sym, off = np.array(flat, np.int32), np.cumsum(size) - size
        del flat, number
        count = size - self.width + 1
        read = np.repeat(np.arange(len(size)), count)
        at = np.arange(len(read)) - np.repeat(np.cumsum(count) - count, count) + off[read]
        owner = np.empty(len(sym), np.int32)
        owner[at] = read
        prio, ids, rows = rank_pairs(r.order, r.batch, r.doc, r.start)
        found = []
        for group, depth in prefix_groups(sym, at, self.width, self.group):
            suffixes, lcp = subtree(sym, group, depth, self.width)
            deep = lcp >= self.width
            if deep.any():
                o = owner[suffixes]
                place = np.arange(len(suffixes))
                # among windows of one row the earliest represents the row
                found.append(suffixes[repeated(place, deep, prio[o], ids[o], rows[o], same_row=False)])
        if not found:
            return (np.zeros(0, np.int64),) * 3
        hit = np.sort(np.concatenate(found))
        o = owner[hit].astype(np.int64)
        begin = r.start[o] + hit - off[o]
        new = np.ones(len(hit), bool)
        new[1:] = (o[1:] != o[:-1]) | (begin[1:] != begin[:-1] + 1)
        last = np.ones(len(hit), bool)
        last[:-1] = new[1:]
        return o[new], begin[new], begin[last] + self.width

    def finish(self, b, starts, stops):
        ws, we, first = c.word_bounds(b, c.BLANK_WORD)
        gone = np.zeros(len(ws) + 1, np.int32)
        np.add.at(gone, starts, 1)
        np.add.at(gone, stops, -1)
        gone = np.cumsum(gone)[: len(ws)] > 0
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(gone)])
        removed = total[first[1:]] - total[first[:-1]]
        sha, kept, cuts = [], [], []
        for i in range(len(b)):
            words = b.text(i).split()
            spans = []
            if removed[i]:
                mask = gone[first[i] : first[i + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                spans = [{"start": int(x), "stop": int(y)} for x, y in zip(edge[0::2], edge[1::2])]
                words = [x for x, g in zip(words, mask.tolist()) if not g]
            text = b" ".join(words)
            sha.append(hashlib.sha256(text).hexdigest())
            if self.keep_text:
                kept.append(text.decode())
                cuts.append(spans)
        out = [id_array(b), pa.array(np.diff(first).astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array(sha, pa.string())]
        if self.keep_text:
            out += [pa.array(kept, pa.string()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))]
        return out


def remove_repeated_words(docs: DataFrame, width: int = 13, keep_text: bool = False, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """Remove each word covered by a window of ``width`` words that also starts in a document with a smaller id.

    Windows stay inside one document and are judged on the input.  A null text has no words; a null id
    comes last; rows with one id are not earlier than each other, so they keep what only they share.
    Columns other than the two named are ignored.  ``keep_text`` adds the kept words and the removed word ranges.
    """
    return find_repeats(docs, WordWindows(width, keep_text=keep_text), id_name, text_name)
