"""Near-duplicate detection with Order MinHash.

A sketch takes, under one hash function, the ``length`` least occurrence-labelled k-mers (five-word
shingles; the n-th occurrence of a shingle is an element of its own) and keeps them in text order, so
two texts share a sketch when they share the k-mers *and* their order: a measure of edit similarity.

1. Texts with equal words are one node.  Texts of more than ``SHORT`` words have sketches.
2. Shorter texts are found exactly: cut into one part more than the edits allowed, a text shares a part, at
   nearly the same place, with every text similar to it.  Parts are keyed by content, length of the text,
   edits allowed and number of the part; texts up to the longest that can be similar look for them.
3. Only 64-bit keys and nodes travel, packed, to the bucket of the key.  Texts that share a key are
   candidates.  Each key contributes a star around its least node, and the stars' connected components
   bound what can be similar; no pairs of a key are written.
4. A component too large for one task is split first, without loss: similar texts share most of their word pairs, so
   they share some of those that the fewest texts of the component have (``_finer``).
5. Each candidate text travels to the group of its component (what is still too large for one task is dealt
   out in classes of length and blocks; blocks of one class or of neighbouring ones meet, and a text travels
   once for each of them).  Inside a group, texts are linked if their word
   edit distance is at most (1 - threshold) of the longer one, by banded alignment; a prefix filter on
   their rarest words finds the texts to compare, and texts already connected are not compared again.
6. Components of the verified links are the classes.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .exchange import bucket_of, split_by
from .gam import document_batches

K = 5
SKETCHES = 192
LENGTH = 2
THRESHOLD = 0.8
#: Texts of at most so many words are compared by parts, which misses no similar pair.
SHORT = 40
#: Bytes of text that one group of a component may hold; larger components are dealt out in blocks.
GROUP_BYTES = 4 << 20

#: Hash values that one step of sketching holds.
CELLS = 1 << 16

_SEEDS = np.random.default_rng(7).integers(0, 2**64, 4096, dtype=np.uint64)


def occurrence_labels(h: np.ndarray) -> np.ndarray:
    """0 for the first occurrence of a value, 1 for the second, and so on."""
    by = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    new[1:] = h[by][1:] != h[by][:-1]
    place = np.arange(len(h))
    out = np.empty(len(h), np.int64)
    out[by] = place - np.maximum.accumulate(np.where(new, place, 0))
    return out


def sketches(shingles: np.ndarray, count: int = SKETCHES, length: int = LENGTH) -> np.ndarray:
    """``count`` order-preserving sketches of a sequence of k-mer hashes."""
    items = c.mix(shingles + occurrence_labels(shingles).astype(np.uint64) * c.U64(0x9E6C63D0876A9A47))
    length = min(length, len(items))
    out = np.full(count, 0, np.uint64)
    step = max(1, CELLS // len(items))  # functions evaluated at once, within bounded memory
    for j in range(0, count, step):
        v = (items ^ _SEEDS[j : j + step, None][: count - j]) * c.U64(0x9E3779B97F4A7C15)
        v ^= v >> c.U64(29)
        v *= c.U64(0xBF58476D1CE4E5B9)
        if length == 2 < len(items):  # two least values, without a partition of all
            rows = np.arange(len(v))
            first = v.argmin(axis=1)
            v[rows, first] = np.iinfo(np.uint64).max
            second = v.argmin(axis=1)
            at = np.stack([np.minimum(first, second), np.maximum(first, second)], axis=1)
        else:
            at = np.sort(np.argpartition(v, length - 1, axis=1)[:, :length], axis=1) if length < len(items) else np.broadcast_to(np.arange(length), (len(v), length))
        h = np.arange(j + 1, j + 1 + len(v), dtype=np.uint64)
        for k in range(length):
            h = (h ^ items[at[:, k]]) * c.U64(0xD6E8FEB86659FD93) + c.U64(0x2545F491)
        out[j : j + len(v)] = h
    return c.mix(out)


def _places(a) -> dict:
    """Bit vector of the places of each word."""
    at: dict = {}
    for i, x in enumerate(a):
        at.setdefault(x, []).append(i)
    out = {}
    for x, p in at.items():
        if len(p) < 32:
            bits = 0
            for i in p:
                bits |= 1 << i
        else:
            mark = np.zeros(p[-1] + 1, np.uint8)
            mark[p] = 1
            bits = int.from_bytes(np.packbits(mark, bitorder="little").tobytes(), "little")
        out[x] = bits
    return out


def _whole_distance(a, b) -> int:
    """Edit distance with one bit vector over all rows."""
    n, match = len(a), _places(a)
    mask, top = (1 << n) - 1, 1 << (n - 1)
    vp, vn, score = mask, 0, n
    for x in b:
        eq = match.get(x, 0)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp, hn = vn | (mask ^ ((d0 | vp) & mask)), d0 & vp
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = (hp << 1 | 1) & mask, hn << 1 & mask
        vp, vn = hn | (mask ^ ((d0 | hp) & mask)), d0 & hp
    return score


def banded_distance(a, b, limit: int) -> int:
    """Word edit distance of two sequences if at most ``limit``, else limit + 1.

    Only a band of about 2 * limit diagonals is kept: a bit vector of vertical differences that moves one row
    down with each column.  The distance is followed along the band's lower edge and then along the last row.
    """
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    if len(a) < len(b):
        a, b = b, a
    n, m, lo = len(a), len(b), 0
    while lo < m and a[lo] == b[lo]:
        lo += 1
    while m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[lo:n], b[lo:m]
    n, m = len(a), len(b)
    if m == 0:
        return min(n, limit + 1)
    width = 2 * limit + 2
    if width >= n:
        return min(_whole_distance(a, b), limit + 1)
    match = _places(a)
    mask, edge, row = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    vp, vn, score, first = mask ^ ((1 << (width - limit - 1)) - 1), 0, limit, limit + 1 - width
    for j, x in enumerate(b):
        eq = match.get(x, 0)
        eq = (eq >> first if first >= 0 else eq << -first) & mask
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp, hn = vn | (mask ^ (d0 | vp)), d0 & vp
        if j < n - limit:
            score += not d0 & edge
        else:
            score += bool(hp & row) - bool(hn & row)
            row >>= 1
        d0 >>= 1
        vp, vn = hn | (mask ^ (d0 | hp)), d0 & hp
        first += 1
    return min(score, limit + 1)


def allowed(n: int, m: int, threshold: float) -> int:
    """The largest edit distance at which texts of n and m words are similar."""
    return int((1 - threshold) * max(n, m) + 1e-9)


def link(texts, threshold: float, across: int | None = None) -> list[tuple[int, int]]:
    """Links that connect every two similar texts of a group, directly or over others.

    ``texts`` yields the words of one text after another; only their numbers are kept.  With ``across``, only texts before
    that place are held against those from it on.  Two texts within the allowed distance share all but that many words,
    so each shares one of the rarest words of either; texts that are already connected are not aligned.
    """
    number: dict[bytes, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in t], np.int32) for t in texts]
    del number
    size = np.array([len(d) for d in docs], np.int64)
    flat = [d.astype(np.int64) * (1 << 31) + occurrence_labels(d) for d in docs]
    # the n-th occurrence of a word is a token of its own
    code = np.unique(np.concatenate(flat), return_inverse=True)[1].ravel() if docs else np.zeros(0, np.int64)
    labelled = np.split(code, np.cumsum(size)[:-1]) if docs else []
    del flat
    count = np.bincount(code)
    rank = np.empty(len(count), np.int64)
    rank[np.lexsort((np.arange(len(count)), count))] = np.arange(len(count))
    tokens = [np.sort(rank[x]) for x in labelled]
    parent = list(range(len(docs)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    lists: dict[int, list[int]] = {}
    out = []
    for i in np.argsort([len(d) for d in docs], kind="stable").tolist():
        n = len(docs[i])
        if n == 0:
            continue
        # the other text is at most n / threshold words long, so n - spare words are shared at least
        head = tokens[i][: allowed(n, n, threshold) + 1].tolist()
        found: dict[int, int] = {}
        for t in head:
            for j in lists.get(t, ()):
                found[j] = found.get(j, 0) + 1
        mine = root(i)
        for j in sorted(found, key=lambda j: (-found[j], j)):
            theirs = root(j)
            if theirs == mine or (across is not None and (i < across) == (j < across)):
                continue
            limit = allowed(n, len(docs[j]), threshold)
            if n - len(docs[j]) > limit or np.intersect1d(tokens[i], tokens[j], assume_unique=True).size < n - limit:
                continue
            if banded_distance(docs[i].tolist(), docs[j].tolist(), limit) <= limit:
                parent[theirs] = mine
                out.append((i, j))
        for t in head:
            lists.setdefault(t, []).append(i)
    return out


#: Neighbours from which a node's edges are spread over several tasks, and over how many.
HOT_DEGREE, SPREAD = 4096, 32
#: Pairs that one task may finish.
LOCAL_PAIRS = 1 << 19


def _with_value(edges: DataFrame, values: DataFrame, hot: DataFrame) -> DataFrame:
    """Each edge with the value of its node ``u``; edges of hot nodes are dealt out over SPREAD tasks."""
    hot = F.broadcast(hot.withColumn("hot", F.lit(True)))
    edges = edges.join(hot, "u", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("v"), F.lit(SPREAD))).otherwise(F.lit(0)).cast("int")).drop("hot")
    values = values.join(hot, "u", "left").withColumn("salt", F.explode(F.expr(f"if(hot, sequence(0, {SPREAD - 1}), array(0))"))).drop("hot")
    return edges.join(values, ["u", "salt"]).drop("salt")


def _hot_nodes(pairs: DataFrame, name: str, limit: int) -> DataFrame:
    """Nodes with more neighbours than ``limit``; at most the number of pairs over ``limit`` of them."""
    return c.cut(pairs.groupBy(F.col(name).alias("u")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("u"), "hot")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for undirected edges (a, b): each node's least connected node.

    Rounds of large-star and small-star; every round ends in a written table, and only counts reach the driver.  Each
    round leaves fewer pairs, one a node in the end; once there are LOCAL_PAIRS at most (16 bytes each), one task
    finishes them.  A node with many neighbours (the limit grows with the edges, so that there are some thousands of them at most)
    does not meet them in one task.
    """
    edges = edges.where("a <> b")
    pairs = c.cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while (n := pairs.count()) > LOCAL_PAIRS:
        limit = max(HOT_DEGREE, n // HOT_DEGREE)
        # large star: the larger neighbours of a node point to the least of its neighbourhood
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        up = pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = _with_value(up, least, _hot_nodes(pairs, "v", limit)).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours point to the least of them; after a large star these are few
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        after = c.cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if after.count() == n and not after.exceptAll(pairs).limit(1).count():  # the same pairs as before: all are stars
            stars = after.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
        pairs = after
    kind = pairs.schema["u"].dataType.simpleString()
    return pairs.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(_least_connected, f"node {kind}, root {kind}")


def _least_connected(table: pa.Table) -> pa.Table:
    """The least connected node of each node of at most LOCAL_PAIRS pairs."""
    kind = table.schema.field("u").type
    u, v = (np.asarray(table.column(k)) if pa.types.is_integer(kind) else np.array(table.column(k).to_pylist(), object) for k in ("u", "v"))
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    i, j = np.split(place.ravel(), 2)
    root = np.arange(len(nodes))
    while True:
        least, new = np.minimum(root[i], root[j]), root.copy()
        np.minimum.at(new, root[i], least)
        np.minimum.at(new, root[j], least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return pa.table({"node": pa.array(nodes, kind), "root": pa.array(nodes[root], kind)})


@lru_cache(maxsize=None)
def _parts(n: int, threshold: float, short: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first word, behind the last, tag, is a part) of all keys of a text of n words, parts and those it looks for.

    If two texts of l <= n words are at most d edits apart and the shorter is cut into d + 1 parts, some part i lies
    unchanged in the longer, shifted by at most i edits before it and d - i edits behind it.
    """
    rows = set()

    def cut(size: int, d: int):
        edges = [size * i // (d + 1) for i in range(d + 2)]
        return enumerate(zip(edges, edges[1:]))

    if n <= short:
        longest = n
        while longest + 1 - n <= allowed(longest + 1, longest + 1, threshold) and longest < 50 * n:
            longest += 1
        for d in range(allowed(n, n, threshold), allowed(longest, longest, threshold) + 1):
            rows |= {(a, z, (n << 40) | (d << 20) | i, 1) for i, (a, z) in cut(n, d)}
    d = allowed(n, n, threshold)
    for size in range(max(1, n - d), min(n, short) + 1):
        more = n - size
        for i, (a, z) in cut(size, d):
            for at in range(max(0, a - i, a + more - d + i), min(n - (z - a), a + i, a + more + d - i) + 1):
                rows.add((at, at + z - a, (size << 40) | (d << 20) | i, 0))
    out = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return out[:, 0], out[:, 1], c.mix(out[:, 2].astype(np.uint64)), out[:, 3].astype(np.uint64)


def candidate_keys(words: np.ndarray, threshold: float = THRESHOLD, count: int = SKETCHES, length: int = LENGTH, k: int = K, short: int = SHORT) -> np.ndarray:
    """Keys of a text of some word hashes: texts may be similar if they share a key without its lowest bit, which one has set."""
    n, out = len(words), []
    if n - allowed(n, n, threshold) <= short:
        starts, stops, tags, part = _parts(n, threshold, short)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(words * c._POW[:n], out=total[1:])
        h = c.mix((total[stops] - total[starts]) * c._INV[starts] ^ tags)
        out.append(np.unique((h & ~c.U64(1)) | part))
    if n > short:
        out.append(sketches(c.mix(c.grams(words, min(k, n))), count, length) | c.U64(1))
    return np.concatenate(out)


NODE_SCHEMA = "doc_id long, node binary, nid long, n_bytes long, n_words long"


def _words(b: c.Batch, i: int) -> bytes:
    return b" ".join(b.text(i).split())


def node_documents(docs: DataFrame, id_name: str = "doc_id", text_name: str = "text") -> DataFrame:
    """doc_id, node (digest of the words; null without words), its first 8 bytes, n_bytes and n_words of every document."""

    def run(records):
        for rec in records:
            for a, b in document_batches(rec):
                words = [_words(b, i) for i in range(len(b))]
                nodes = [hashlib.blake2b(w, digest_size=16).digest() if w else None for w in words]
                short = [None if x is None else int.from_bytes(x[:8], "little", signed=True) for x in nodes]
                cells = [rec.column(0).slice(a, len(b)), pa.array(nodes, pa.binary()), pa.array(short, pa.int64()), pa.array(b.lens, pa.int64()), pa.array([w.count(b" ") + 1 for w in words], pa.int64())]
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "node", "nid", "n_bytes", "n_words"])

    return c.select_documents(docs, id_name, text_name).mapInArrow(run, NODE_SCHEMA)


def by_key(keys: np.ndarray, nids: np.ndarray):
    """Keys and nodes ascending, each key's least node, and whether a part or sketch has the key (else texts only look for the same)."""
    order = np.lexsort((nids, keys >> c.U64(1)))
    keys, nids = keys[order], nids[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] >> c.U64(1) != keys[:-1] >> c.U64(1)
    begin, group = np.flatnonzero(new), np.cumsum(new) - 1
    part = np.maximum.reduceat(keys & c.U64(1), begin)[group] == 1
    # equal nodes of a key are one
    part_first = nids[begin][group]
    same = np.zeros(len(keys), bool)
    same[1:] = ~new[1:] & (nids[1:] == nids[:-1])
    keep = ~same
    return keys[keep], nids[keep], part_first[keep], part[keep]


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs that connect the same nodes as the edges (a, b), one less than nodes."""
    differ = a != b
    pairs = np.unique(np.stack([a[differ], b[differ]], axis=1), axis=0)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for x, y in pairs.tolist():
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    out = [(x, root(x)) for x in parent]
    return np.array([p for p in out if p[0] != p[1]], np.int64).reshape(-1, 2)


#: Keys that are held before they are sent.
HELD = 1 << 18
#: Least number of buckets of keys, and bytes of keys and nodes that one should have at most.
BUCKETS, BUCKET_BYTES = 64, 16 << 20


def _send_keys(buckets: int, threshold: float, count: int, length: int, k: int, short: int):
    def run(records):
        held, size = [], 0

        def out():
            keys = np.concatenate([x for x, _ in held])
            nids = np.repeat(np.array([n for _, n in held], np.int64), [len(x) for x, _ in held])
            keys, nids, centre, part = by_key(keys, nids)
            edges = forest(nids[part], centre[part])
            # what shares a key here is settled here; its least node stands for it elsewhere
            stay = ~part | (nids == centre)
            keys, nids = keys[stay] | part[stay], nids[stay]
            parts = [(-1 - int(keys[0] % c.U64(buckets)), edges.tobytes())] if len(edges) else []
            parts += [(i, keys[at].tobytes() + nids[at].tobytes()) for i, at in split_by(bucket_of(keys, buckets), buckets)]
            return pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["bucket", "data"])

        seen: set[int] = set()
        for rec in records:
            for _, b in document_batches(rec):
                starts, ends, first = c.word_bounds(b, c.BLANK_WORD)
                h = c.segment_hash(np.frombuffer(b.buf, np.uint8), starts, ends)
                for i in range(len(b)):
                    if first[i] == first[i + 1]:
                        continue
                    nid = int.from_bytes(hashlib.blake2b(_words(b, i), digest_size=16).digest()[:8], "little", signed=True)
                    if nid in seen:
                        continue
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(nid)
                    held.append((candidate_keys(h[first[i] : first[i + 1]], threshold, count, length, k, short), nid))
                    size += len(held[-1][0])
                    if size >= HELD:
                        yield out()
                        held, size = [], 0
        if held:
            yield out()

    return run


def _stars(table: pa.Table) -> pa.Table:
    """Edges from each key's least node to its others, as few as connect them."""
    data = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("data")]
    if table.column("bucket")[0].as_py() < 0:
        pairs = np.concatenate(data).view(np.int64).reshape(-1, 2)
    else:
        keys = np.concatenate([x[: len(x) // 2] for x in data])
        nids = np.concatenate([x[len(x) // 2 :] for x in data]).view(np.int64)
        del data
        keys, nids, centre, part = by_key(keys, nids)
        pairs = forest(nids[part], centre[part])
    return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})


def _link_groups(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        z = zstandard.ZstdDecompressor()
        nodes, texts, side = table.column("num").to_pylist(), table.column("text").to_pylist(), table.column("side").to_pylist()
        by = sorted(range(len(nodes)), key=lambda i: (side[i], nodes[i]))
        by = [i for k, i in enumerate(by) if k == 0 or nodes[i] != nodes[by[k - 1]]]
        across = sum(side[i] == 0 for i in by) if any(side) else None
        found = link((z.decompress(texts[i]).split() for i in by), threshold, across)
        return pa.table({"a": pa.array([nodes[by[i]] for i, _ in found], pa.int64()), "b": pa.array([nodes[by[j]] for _, j in found], pa.int64())})

    return run


#: Grams that two texts of a large component must have in common among their rarest ones.
SHARED = 4
#: Texts with a gram up to which its pairs are counted; those of a more frequent one stay together wherever their lengths allow.
COUNTED = 64
#: Bytes of words in a chunk of a large component, least number of buckets of rare grams, and postings whose pairs are made at once.
CHUNK_BYTES, PAIR_BUCKETS, POSTINGS = 2 << 20, 12, 1 << 16


def _gram_words(threshold: float) -> int:
    """Words of a gram.  Texts of n and m words at distance d share max(n, m) - k + 1 - k * d grams of k words at least, occurrences labelled."""
    return 2 if threshold >= 0.75 else 1


@lru_cache(maxsize=None)
def _rarest(n: int, threshold: float) -> int:
    """Rarest grams of a text of n words: any similar text has SHARED of them among its own rarest (or all that they must share, if fewer)."""
    k, most, m = _gram_words(threshold), 0, n
    while m - n <= allowed(m, m, threshold):
        most, m = max(most, n - m + k * allowed(m, m, threshold)), m + 1
    return most + SHARED


def _chunks(records):
    """(chunk, bucket -1, data): numbers, components, lengths and compressed words of some texts."""
    from pyspark import TaskContext

    number, z, shut = TaskContext.get().partitionId() << 32, zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
    held, size = [], 0

    def out():
        nums, roots, texts = zip(*held)
        head = np.array([len(nums), *nums, *roots, *map(len, texts)], np.int64).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([-1], pa.int32()), pa.array([head + shut.compress(b"".join(texts))], pa.binary())], names=["chunk", "bucket", "data"])

    for row in c.rows_of(records):
        held.append((row["num"], row["root"], z.decompress(row["text"])))
        size += len(held[-1][2])
        if size >= CHUNK_BYTES:
            yield out()
            held, size, number = [], 0, number + 1
    if held:
        yield out()


def _chunk_grams(data: bytes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, words, grams, text of each gram) of a chunk; a gram is one of its component and of its occurrence in the text."""
    n = int(np.frombuffer(data, np.int64, 1)[0])
    nums, roots, lens = np.frombuffer(data, np.int64, 3 * n, 8).reshape(3, n)
    b = c.Batch(0, nums, np.ones(n, bool), lens, zstandard.ZstdDecompressor().decompress(data[8 + 24 * n :]))
    starts, ends, first = c.word_bounds(b, c.BLANK_WORD)
    h = c.segment_hash(np.frombuffer(b.buf, np.uint8), starts, ends)
    salts, grams = c.mix(roots.view(np.uint64)), []
    for i in range(n):
        g = c.mix(c.grams(h[first[i] : first[i + 1]], k))
        grams.append(c.mix(g + occurrence_labels(g).astype(np.uint64) * c.U64(0x9E6C63D0876A9A47) ^ salts[i]))
    return nums, np.diff(first), np.concatenate(grams), np.repeat(np.arange(n), [len(g) for g in grams])


def _send_grams(buckets: int, k: int):
    def run(records):
        for row in c.rows_of(records):
            c.release()
            grams, count = np.unique(_chunk_grams(row["data"], k)[2], return_counts=True)
            parts = [(i, grams[at].tobytes() + count[at].astype(np.uint32).tobytes()) for i, at in split_by(bucket_of(grams, buckets), buckets)]
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(parts), pa.int64()), pa.array([i for i, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], names=["chunk", "bucket", "data"])

    return run


def _count_grams(table: pa.Table) -> pa.Table:
    """How many texts have each gram, in the order in which each chunk has sent them."""
    data = [x.as_py() for x in table.column("data")]
    size = [len(x) // 12 for x in data]
    grams = np.concatenate([np.frombuffer(x, np.uint64, n) for x, n in zip(data, size)])
    count = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(data, size)])
    inverse = np.unique(grams, return_inverse=True)[1].ravel()
    total = np.minimum(np.bincount(inverse, weights=count), 2**32 - 1).astype(np.uint32)[inverse]
    edges = np.concatenate([[0], np.cumsum(size)])
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "data": pa.array([total[a:z].tobytes() for a, z in zip(edges, edges[1:])], pa.binary())})


def _rare_grams(buckets: int, pair_buckets: int, threshold: float):
    """The rarest grams of each text of a chunk, without those that no other text has, to the bucket of the gram."""
    k = _gram_words(threshold)

    def run(table: pa.Table) -> pa.Table:
        counts = dict(zip(table.column("bucket").to_pylist(), table.column("data").to_pylist()))
        nums, words, grams, text = _chunk_grams(counts[-1], k)
        sent, inverse = np.unique(grams, return_inverse=True)
        count = np.zeros(len(sent), np.uint32)
        for i, at in split_by(bucket_of(sent, buckets), buckets):
            count[at] = np.frombuffer(counts[i], np.uint32)
        count = count[inverse.ravel()]
        by = np.lexsort((grams, count, text))
        grams, count, text = grams[by], count[by], text[by]
        place = np.arange(len(text)) - np.searchsorted(text, text)
        rarest = np.array([_rarest(int(n), threshold) for n in words], np.int64)
        keep = (place < rarest[text]) & (count > 1)
        grams, text = grams[keep], text[keep]
        by = np.argsort(grams, kind="stable")
        grams, text = grams[by], text[by]
        parts = [(i, grams[at].tobytes() + nums[text[at]].tobytes() + words[text[at]].astype(np.int64).tobytes()) for i, at in split_by(bucket_of(grams, pair_buckets), pair_buckets)]
        return pa.table({"bucket": pa.array([i for i, _ in parts], pa.int32()), "data": pa.array([x for _, x in parts], pa.binary())})

    return run


def _sum_pairs(a: np.ndarray, b: np.ndarray, shared: np.ndarray, needed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair once, with the sum of what it shares."""
    by = np.lexsort((b, a))
    a, b, shared, needed = a[by], b[by], shared[by], needed[by]
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[begin], b[begin], np.add.reduceat(shared, begin) if len(a) else shared, needed[begin]


def _gram_pairs(threshold: float):
    """Pairs of texts that share rare grams: how many, and how many they have to share; a tree for those that share enough in one bucket."""
    k = _gram_words(threshold)

    def most(n: np.ndarray) -> np.ndarray:
        return ((1 - threshold) * n + 1e-9).astype(np.int64)

    def pairs(grams: np.ndarray, nums: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
        new = np.concatenate([[True], grams[1:] != grams[:-1]])
        group = np.cumsum(new) - 1
        few = np.bincount(group)[group] <= COUNTED
        out, off = [], 1
        while off < len(grams):
            same = group[off:] == group[:-off]
            counted = same & few[off:]
            if off > 1 and not counted.any():
                break
            # texts with a frequent gram stand in order of their words: neighbours connect all whose lengths allow it
            take = (counted | (same & (off == 1))) & (words[off:] - words[:-off] <= most(words[off:]))
            a, b, longer = nums[:-off][take], nums[off:][take], words[off:][take]
            needed = np.clip(longer - k + 1 - k * most(longer), 1, SHARED)
            out.append((np.minimum(a, b), np.maximum(a, b), np.where(few[off:][take], 1, SHARED), needed))
            off += 1
        return _sum_pairs(*map(np.concatenate, zip(*out))) if out else (nums[:0],) * 4

    def run(table: pa.Table) -> pa.Table:
        data = [np.frombuffer(x.as_py(), np.int64) for x in table.column("data")]
        grams, nums, words = (np.concatenate([x.reshape(3, -1)[i] for x in data]) for i in range(3))
        del data
        by = np.lexsort((nums, words, grams))
        grams, nums, words = grams[by], nums[by], words[by]
        out, at = [], 0
        while at < len(grams):
            stop = int(np.searchsorted(grams, grams[min(at + POSTINGS, len(grams)) - 1], "right"))
            out.append(pairs(grams[at:stop], nums[at:stop], words[at:stop]))
            at = stop
        a, b, shared, needed = _sum_pairs(*map(np.concatenate, zip(*out)))
        # pairs that share enough here are connected by as few as do; others inside what they connect say nothing new
        sure = shared >= needed
        tree = forest(a[sure], b[sure])
        tree = tree[np.argsort(tree[:, 0])]

        def top(x: np.ndarray) -> np.ndarray:
            if not len(tree):
                return x
            at = np.minimum(np.searchsorted(tree[:, 0], x), len(tree) - 1)
            return np.where(tree[at, 0] == x, tree[at, 1], x)

        rest = ~sure & (top(a) != top(b))
        enough = np.full(len(tree), SHARED)
        cells = [tree[:, 1], a[rest]], [tree[:, 0], b[rest]], [enough, shared[rest]], [enough, needed[rest]]
        return pa.table(dict(zip(("a", "b", "shared", "needed"), (pa.array(np.concatenate(x), pa.int64()) for x in cells))))

    return run


def _finer(texts: DataFrame, n_bytes: int, threshold: float) -> DataFrame:
    """(node, root) of texts (num, root, text) of large components: similar texts of a component stay together, texts without a partner are left out.

    Each text's grams are ordered by the number of texts that have them.  Two similar texts share so many grams that SHARED of
    them are among the rarest ones of both.  Counts travel by gram and back to the chunk of texts; then only the rarest grams that
    another text has too travel again.  Pairs with enough of them in common are connected.
    """
    k = _gram_words(threshold)
    buckets = max(BUCKETS, math.ceil(n_bytes / 5 * 12 / BUCKET_BYTES))
    pair_buckets = max(PAIR_BUCKETS, math.ceil(n_bytes * 0.6 / BUCKET_BYTES))
    packed = "chunk long, bucket int, data binary"
    chunks = c.cut(texts.mapInArrow(_chunks, packed), "chunks")
    counts = chunks.mapInArrow(_send_grams(buckets, k), packed).groupBy("bucket").applyInArrow(_count_grams, packed)
    rare = chunks.unionByName(counts).groupBy("chunk").applyInArrow(_rare_grams(buckets, pair_buckets, threshold), "bucket int, data binary")
    pairs = rare.groupBy("bucket").applyInArrow(_gram_pairs(threshold), "a long, b long, shared long, needed long")
    pairs = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.max("needed").alias("needed")).where("shared >= needed")
    return components(pairs.select("a", "b"))


#: Digests of texts that a task remembers, so that it sends copies once.
SEEN = 200_000


def _compressed_texts(docs: DataFrame, id_name: str, text_name: str) -> DataFrame:
    """doc_id, node and compressed words of every document that can be the first of its copies: its id is the least that the task has met."""

    def run(records):
        z = zstandard.ZstdCompressor(level=3)
        seen: dict[bytes, int | None] = {}
        for rec in records:
            ids, nodes, texts = [], [], []
            for doc, t in zip(rec.column(0).to_pylist(), rec.column(1).to_pylist()):
                words = b" ".join((t or "").encode().split())
                if not words:
                    continue
                node = hashlib.blake2b(words, digest_size=16).digest()
                if node in seen and (doc is None or (seen[node] is not None and seen[node] <= doc)):
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen[node] = doc
                ids.append(doc)
                nodes.append(node)
                texts.append(z.compress(words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.binary()), pa.array(texts, pa.binary())], names=["doc_id", "node", "text"])

    return c.select_documents(docs, id_name, text_name).mapInArrow(run, "doc_id long, node binary, text binary")


def near_duplicates(
    docs: DataFrame, threshold: float = THRESHOLD, count: int = SKETCHES, length: int = LENGTH, k: int = K, group_bytes: int = GROUP_BYTES,
    short: int = SHORT, id_name: str = "doc_id", text_name: str = "text",
) -> DataFrame:
    """doc_id and class_id (the least id of its class) of every document.

    Two texts are similar if their word edit distance is at most (1 - threshold) of the longer one's words; classes are
    the connected components of similar texts.  Every similar pair is found of which a text has at most ``short`` words;
    two longer texts are found if they share a sketch.  Texts without words (null ones too) are alone, each row its own class.  Rows that share an id may fall in
    different classes; a null id gets the class of its text, null if no row of the class has an id.
    """
    rows = c.cut(node_documents(docs, id_name, text_name), "rows")
    # one document stands for all rows with its words; from here on a node is a number, which hashes and compares as one
    nodes = rows.where("node is not null").groupBy("node", "nid").agg(F.min("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("n_rows"))
    nodes = c.cut(nodes.withColumn("num", F.monotonically_increasing_id()), "nodes")
    buckets = max(BUCKETS, math.ceil(nodes.count() * count * 16 / BUCKET_BYTES))
    keys = c.select_documents(docs, id_name, text_name).mapInArrow(_send_keys(buckets, threshold, count, length, k, short), "bucket int, data binary")
    stars = keys.groupBy("bucket").applyInArrow(_stars, "a long, b long")
    # two nodes of one nid are in the same component, where their texts tell them apart
    candidates = components(stars).withColumnRenamed("node", "nid")
    # joins are told to shuffle, so that small and large inputs run the same plan
    sized = c.cut(nodes.join(candidates.hint("shuffle_hash"), "nid").select("num", "node", "root", "n_bytes", "n_words", "doc_id"), "candidates")
    # only the row that stands for a candidate sends its text; should rows repeat, the group drops the others
    texts = _compressed_texts(docs, id_name, text_name)
    named = sized.select("num", "node", F.col("doc_id").alias("chosen"))
    picked = texts.join(named.hint("shuffle_hash"), (texts["node"] == named["node"]) & texts["doc_id"].eqNullSafe(F.col("chosen"))).select("num", "text")
    large = sized.groupBy("root").agg(F.sum("n_bytes").alias("bytes")).where(F.col("bytes") >= group_bytes)
    if 0.5 <= threshold <= 1 and (n_bytes := large.agg(F.sum("bytes")).first()[0]):
        picked = c.cut(picked, "texts")
        parts = sized.join(large.select("root", F.lit(True).alias("large")), "root", "left")
        finer = _finer(picked.join(parts.where("large").select("num", "root").hint("shuffle_hash"), "num"), n_bytes, threshold)
        split = parts.where("large").drop("root").join(finer.withColumnRenamed("node", "num").hint("shuffle_hash"), "num")
        sized = c.cut(parts.where("large is null").unionByName(split).select(sized.columns), "finer")
    shares = sized.groupBy("root").agg((F.sum("n_bytes") / group_bytes).cast("long").alias("more"))
    # similar texts are of one class of length or of neighbouring ones
    step = 1e-6 - math.log(threshold) if 0 < threshold <= 1 else math.inf
    level = F.when(F.col("more") > 0, F.floor(F.log(F.col("n_words").cast("double")) / F.lit(step))).otherwise(F.lit(0)).cast("long")
    placed = sized.join(shares, "root").select("num", "root", "n_bytes", "more", level.alias("level"))
    blocks = placed.groupBy("root", "level").agg((F.sum("n_bytes") / group_bytes).cast("long").alias("last"))
    own = placed.join(blocks, ["root", "level"]).select("num", "root", "more", "level", F.pmod(F.xxhash64("num"), F.col("last") + 1).alias("block"))
    meets = own.select("*", F.explode(F.expr("if(more > 0, array(-1L, 0L, 1L), array(0L))")).alias("to"))
    meets = meets.join(blocks.select("root", F.col("level").alias("other"), F.col("last").alias("others")), (F.col("other") == F.col("level") + F.col("to")) & (meets["root"] == blocks["root"])).drop(blocks["root"])
    # a block meets itself and each other block: two blocks, the lower one side 0, form a group
    groups = meets.select("num", "root", F.least("level", "other").alias("low"), (F.col("to") != 0).alias("mixed"), F.explode(F.expr(
        "transform(sequence(0L, others), x -> if(to = 0, struct(least(x, block) as i, greatest(x, block) as j, if(x < block, 1, 0) as side), if(to > 0, struct(block as i, x as j, 0 as side), struct(x as i, block as j, 1 as side))))"
    )).alias("g"))
    groups = groups.select("num", "root", "low", "mixed", "g.i", "g.j", "g.side").distinct()
    sent = picked.join(groups.hint("shuffle_hash"), "num")
    links = sent.groupBy("root", "low", "mixed", "i", "j").applyInArrow(_link_groups(threshold), "a long, b long")
    classes = components(c.cut(links, "links")).withColumnRenamed("node", "num").withColumnRenamed("root", "of")
    named = nodes.select("node", "doc_id", "n_rows", "num").join(classes.hint("shuffle_hash"), "num", "left").withColumn("of", F.coalesce("of", "num"))
    named = c.cut(named, "classes")
    least = named.groupBy("of").agg(F.min("doc_id").alias("class_id"), F.sum("n_rows").alias("n")).where("n > 1").drop("n")
    shared = named.join(least.hint("shuffle_hash"), "of").select("node", "class_id", F.lit(True).alias("shared"))
    out = rows.select("doc_id", "node").join(shared.hint("shuffle_hash"), "node", "left")
    return out.select("doc_id", F.when(F.col("shared"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, id_name: str = "doc_id", text_name: str = "text", **options) -> DataFrame:
    """One document of each class, in the documents' own columns: the row with the least id.

    Rows without an id or without words stay; so do rows that share the least id of their class.
    """
    classes = near_duplicates(docs, threshold, id_name=id_name, text_name=text_name, **options)
    name = "gone"
    while name.lower() in map(str.lower, docs.columns):  # a name that no column of the documents has
        name += "_"
    gone = classes.where("class_id is not null and doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, c.cell(id_name) == F.col(name), "left_anti")
