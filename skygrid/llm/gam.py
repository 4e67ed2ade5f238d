"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins.  Training visits the features in turn, many times; each visit fits a
shallow regression tree on one feature to the current residuals and adds it, shrunk, to the feature's
lookup table.  Then the pairs of features that explain most of what is left are boosted the same way on
two-dimensional tables.  A score is the logistic function of a sum of table entries, looked up for whole
arrays at once.

Features are counts of the text alone.  Training takes a bounded sample of the labelled rows
(``sample``); everything else covers all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Labelled rows that training sees at most.
SAMPLE = 20_000
HELD_OUT = 5
#: Bytes of text that are measured at once.
PART_BYTES = 1 << 20

FEATURES = [
    "log_words", "letters_a_word", "capital_share", "symbol_share", "exclaim_a_word", "bar_a_word", "digit_share", "stop_a_word", "comma_a_word",
    "lines_a_word", "distinct_words", "same_as_previous", "distinct_pairs", "repeated_lines", "long_word_share", "wide_share",
]


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[list(chars)] = 1
    return out


_KINDS = np.stack([
    _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"#$%&*<>^~=+@"), _table(b"!"), _table(b"|"), _table(b"0123456789"),
    _table(b".?"), _table(b",;:"), _table(b"\n"), _table(bytes(range(0xC0, 0x100))),
])


def _per_document(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    by = np.lexsort((h, doc))
    new = np.ones(len(by), bool)
    new[1:] = (doc[by][1:] != doc[by][:-1]) | (h[by][1:] != h[by][:-1])
    return np.bincount(doc[by][new], minlength=n)


def features(b: c.Batch) -> np.ndarray:
    """A row a document; an empty text has zeros throughout."""
    n = len(b)
    raw = np.frombuffer(b.buf, np.uint8)
    upper, lower, symbol, exclaim, bar, digit, stop, comma, newline, lead = (_per_document(k[raw], b.off).astype(float) for k in _KINDS)
    # Latin capitals with marks are C3 80 .. C3 9E
    accent = np.zeros(len(raw), np.int32)
    accent[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    upper += _per_document(accent, b.off)
    starts, ends, first = c.word_bounds(b, c.BLANK_WORD)
    words = np.diff(first).astype(float)
    doc = np.repeat(np.arange(n), np.diff(first))
    size = ends - starts
    h = c.segment_hash(raw, starts, ends)
    letters = np.bincount(doc, size, minlength=n)
    long = np.bincount(doc, size > 24, minlength=n)
    inner = doc[1:] == doc[:-1]
    same = np.bincount(doc[1:][inner], (h[1:] == h[:-1])[inner], minlength=n)
    pairs = c.mix(c.grams(h, 2))[inner] if len(h) > 1 else h[:0]
    pair_doc = doc[1:][inner]
    from .line_chunks import line_bounds

    ls, le, lf = line_bounds(b)
    line_doc = np.repeat(np.arange(n), np.diff(lf))
    full = le > ls
    lh = c.segment_hash(raw, ls, le)
    lines = np.bincount(line_doc[full], minlength=n)
    w, q = np.maximum(words, 1), np.maximum(letters, 1)
    return np.stack([
        np.log1p(words), letters / w, upper / np.maximum(upper + lower + lead, 1), symbol / q, exclaim / w, bar / w, digit / q, stop / w, comma / w, newline / w,
        _distinct(doc, h, n) / w, same / w, _distinct(pair_doc, pairs, n) / np.maximum(words - 1, 1), 1 - _distinct(line_doc[full], lh[full], n) / np.maximum(lines, 1), long / w, lead / q,
    ], axis=1) * (words > 0)[:, None]


@dataclass
class Gam:
    """Bin edges and lookup tables.  Their size depends on features and bins only."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j], "right")]
        for (j, k), table in zip(self.pairs, self.pair_tables):
            out += table[np.searchsorted(self.coarse[j], x[:, j], "right"), np.searchsorted(self.coarse[k], x[:, k], "right")]
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Edges between distinct values, at even ranks where there are many."""
    u = np.unique(x)
    mids = (u[1:] + u[:-1]) / 2
    if len(mids) <= bins - 1:
        return mids
    q = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])
    at = np.unique(np.clip(np.searchsorted(u, q), 1, len(u) - 1))
    return mids[at - 1]


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, l2: float, least: float) -> np.ndarray:
    """A regression tree over the bins of one feature, grown best split first: its value in each bin."""
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    gain = lambda a, z: (cg[z] - cg[a]) ** 2 / (ch[z] - ch[a] + l2)

    def best(a: int, z: int):
        m = np.arange(a + 1, z)
        if not len(m):
            return 0.0, 0
        ok = (ch[m] - ch[a] >= least) & (ch[z] - ch[m] >= least)
        value = np.where(ok, gain(a, m) + gain(m, z) - gain(a, z), 0)
        i = int(np.argmax(value))
        return float(value[i]), int(m[i])

    parts = [(0, len(g), *best(0, len(g)))]
    while len(parts) < leaves:
        i = max(range(len(parts)), key=lambda k: parts[k][2])
        a, z, value, m = parts[i]
        if value <= 1e-12:
            break
        parts[i : i + 1] = [(a, m, *best(a, m)), (m, z, *best(m, z))]
    out = np.zeros(len(g))
    for a, z, _, _ in parts:
        out[a:z] = (cg[z] - cg[a]) / (ch[z] - ch[a] + l2)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, float]:
    """The best depth-two tree that splits one feature and then, on either side, the other: table and gain."""
    best, top = np.zeros_like(g), 0.0
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for m in range(1, a.shape[0]):
            out, total = np.empty_like(a), 0.0
            for rows in (slice(0, m), slice(m, None)):
                ga, ha = a[rows].sum(0), b[rows].sum(0)
                leaf = _tree(ga, ha, 2, l2, least)
                out[rows] = leaf
                total += float((leaf * ga).sum())
            if total > top:
                top, best = total, out.T if turn else out
    return best, top


def fit(x: np.ndarray, y: np.ndarray, bins: int = 24, rounds: int = 150, rate: float = 0.1, leaves: int = 4, pairs: int = 6, pair_bins: int = 6, pair_rounds: int = 30, l2: float = 2.0, least: float = 0.5) -> Gam:
    """Cyclic boosting.  Without rows, or with one class only, the model is its prior."""
    n, m = x.shape
    rate_of_one = (y.sum() + 0.5) / (n + 1) if n else 0.5
    edges, coarse = [cuts(x[:, j], bins) if n else np.zeros(0) for j in range(m)], [cuts(x[:, j], pair_bins) if n else np.zeros(0) for j in range(m)]
    gam = Gam(float(np.log(rate_of_one / (1 - rate_of_one))), edges, [np.zeros(len(e) + 1) for e in edges], [], coarse, [])
    if n == 0 or y.min() == y.max():
        return gam
    at = [np.searchsorted(edges[j], x[:, j], "right") for j in range(m)]
    f = np.full(n, gam.bias)
    chance = lambda: 1 / (1 + np.exp(-f))
    for _ in range(rounds):
        for j in range(m):
            p = chance()
            size = len(gam.tables[j])
            step = rate * _tree(np.bincount(at[j], y - p, size), np.bincount(at[j], p * (1 - p), size), leaves, l2, least)
            gam.tables[j] += step
            f += step[at[j]]
    low = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(m)]

    def grids(j: int, k: int):
        p, shape = chance(), (len(coarse[j]) + 1, len(coarse[k]) + 1)
        cell = low[j] * shape[1] + low[k]
        return np.bincount(cell, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(cell, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_pair_tree(*grids(j, k), l2, least)[1], j, k) for j in range(m) for k in range(j)), reverse=True)
    gam.pairs = [(j, k) for gain, j, k in ranked[:pairs] if gain > 0]
    gam.pair_tables = [np.zeros((len(coarse[j]) + 1, len(coarse[k]) + 1)) for j, k in gam.pairs]
    for _ in range(pair_rounds):
        for i, (j, k) in enumerate(gam.pairs):
            step = rate * _pair_tree(*grids(j, k), l2, least)[0]
            gam.pair_tables[i] += step
            f += step[low[j], low[k]]
    # tables are centred, so that the bias is the mean score
    for j in range(m):
        mean = gam.tables[j][at[j]].mean()
        gam.tables[j] -= mean
        gam.bias += float(mean)
    return gam


def document_batches(rec: pa.RecordBatch, ids: int = 0, text: int = 1):
    """(first row, Batch) over an Arrow record batch, about PART_BYTES at a time."""
    lens, _, buf = c.text_bytes(rec.column(text))
    off = np.concatenate([np.zeros(1, np.int64), np.cumsum(lens)])
    a = 0
    while a < len(lens):
        z = min(len(lens), max(a + 1, int(np.searchsorted(off, off[a] + PART_BYTES, "right")) - 1))
        yield a, c.Batch(0, np.zeros(z - a, np.int64), np.ones(z - a, bool), lens[a:z], buf[off[a] : off[z]])
        a = z


def held_out(id_name: str = "doc_id"):
    """Rows whose labels are never learnt; a null id is held out."""
    return F.coalesce(F.crc32(F.col(id_name).cast("string")) % HELD_OUT == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_name: str = "doc_id", text_name: str = "text", label: str = "quality", **options) -> Gam:
    """Fit on at most ``sample`` labelled rows outside the held-out fold, those of least hash of their id.

    Null labels and ids are left out; of several labels of an id the largest counts, of several documents any.
    """
    rows = labels.where(F.col(id_name).isNotNull() & F.col(label).isNotNull() & ~held_out(id_name))
    rows = rows.groupBy(F.col(id_name).cast("long").alias("doc_id")).agg(F.max(label).cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = dict(map(tuple, rows.collect()))  # at most ``sample`` pairs
    spark = docs.sparkSession
    if not known:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), **options)
    ids = spark.createDataFrame(list(known.items()), "doc_id long, y double")

    def run(records):
        for rec in records:
            x = [features(b) for _, b in document_batches(rec)]
            flat = np.concatenate(x) if x else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([rec.column(0), pa.array(list(flat), pa.list_(pa.float64()))], names=["doc_id", "x"])

    labelled = c.select_documents(docs, id_name, text_name).join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")
    got = sorted((r.doc_id, tuple(r.x)) for r in labelled.mapInArrow(run, "doc_id long, x array<double>").toLocalIterator())
    return fit(np.array([x for _, x in got]).reshape(-1, len(FEATURES)), np.array([known[d] for d, _ in got]), **options)


def score_documents(docs: DataFrame, model: Gam, carry: list[str] | None = None, id_name: str = "doc_id", text_name: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, score (0 to 1), the text if asked for, and the carried columns of every document; null and empty texts are scored alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    picked = c.select_documents(docs, id_name, text_name, carry)
    first = 1 if keep_text else 2
    fields = picked.select("doc_id", F.lit(0.0).alias("score"), *["text"][: 2 - first], *[c.cell(c.CARRIED + k) for k in carry or []]).schema

    def run(records):
        model = shared.value
        for rec in records:
            parts = [model.score(features(b)) for _, b in document_batches(rec)]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([rec.column(0), pa.array(s), *rec.columns[first:]], names=fields.names)

    return picked.mapInArrow(run, fields)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE, **names) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    out = score_documents(docs, train(docs, labels, sample, **names), **{k: v for k, v in names.items() if k in ("id_name", "text_name")})
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier accepts, in their own columns."""
    carry = [k for k in docs.columns if k != "text"]
    out = score_documents(docs, train(docs, labels, sample), carry, keep_text=True).where(F.col("score") >= threshold)
    return out.select(*[(F.col("text") if k == "text" else c.cell(c.CARRIED + k)).alias(k) for k in docs.columns])
