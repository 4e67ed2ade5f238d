import hashlib
import random

import numpy as np
import pytest

from skygrid.llm.column_bwt import ByteWindows, Columns, Transform, remove_repeated_bytes
from skygrid.llm.exchange import find_repeats


def brute(rows, width):
    """rows: (doc_id, text); earlier: smaller id, or the same row and an earlier start."""
    data = [(LAST if d is None else d, i, (t or "").encode()) for i, (d, t) in enumerate(rows)]
    where = {}
    for d, i, b in data:
        for s in range(len(b) - width + 1):
            where.setdefault(b[s : s + width], []).append((d, i, s))
    out = []
    for d, i, b in data:
        gone = [False] * len(b)
        for s in range(len(b) - width + 1):
            if any(x[0] < d or (x[1] == i and x[2] < s) for x in where[b[s : s + width]]):
                gone[s : s + width] = [True] * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out.append((rows[i][0], len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


LAST = 2**63 - 1


def check(spark, rows, width):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, bucket string, batch int")
    got = sorted((tuple(r) for r in remove_repeated_bytes(df, width).collect()), key=str)
    assert got == brute(rows, width)


def words(rng, n, kinds=500):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) if rng.random() < 0.9 else f"w{rng.randint(0, kinds)}" for _ in range(n))


def test_against_brute_force(spark):
    rng = random.Random(3)
    passage, other = words(rng, 40), words(rng, 60)
    rows = []
    for i in range(40):
        parts = [words(rng, rng.randint(1, 60))]
        if i % 3 == 0:
            parts.append(passage)
        if i % 4 == 0:
            parts.append(other[: rng.randint(50, len(other))])
        parts.append(words(rng, rng.randint(0, 30)))
        rows.append((i * 7 % 41, " ".join(parts)))
    rows += [(100 + i, rows[i % 5][1]) for i in range(12)]  # exact copies
    rows += [(200 + i, rows[3][1].replace("a", "b", 1 + i)) for i in range(5)]  # near copies
    check(spark, rows, 30)
    check(spark, rows, 100)


def test_edge_cases(spark):
    rng = random.Random(4)
    long = words(rng, 3000)
    rows = [(1, None), (2, ""), (3, "é" * 15), (4, "é" * 16), (5, "ab" * 200), (6, "ab" * 200 + "c"), (7, "x" * 29), (7, "x" * 30)]
    rows += [(8, long), (9, long), (9, long), (None, long), (None, None), (10, long[500:] + long[:400]), (11, "Orre " * 300), (12, "\x00" * 64 + "\r\n" * 40)]
    check(spark, rows, 30)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_bytes(df).collect() == []


def test_kept_text_and_ranges(spark):
    df = spark.createDataFrame([(1, "a" * 40 + "b" * 40), (2, "c" + "b" * 40 + "d")], "doc_id long, text string")
    rows = {r.doc_id: r for r in remove_repeated_bytes(df, 35, keep_text=True).collect()}
    assert rows[2].kept == b"cd"
    assert [(x.start, x.stop) for x in rows[2].removed] == [(1, 41)]
    assert rows[1].n_removed == 78  # runs of one letter repeat themselves: all but the first byte of each


def test_width_is_checked():
    from skygrid.llm.column_bwt import ByteWindows

    with pytest.raises(ValueError):
        ByteWindows(8)


def test_many_packs_of_one_task(spark):
    """Reads that a task met in an earlier pack are settled by it, whatever the order of the ids."""
    rng = random.Random(9)
    hot, rows = words(rng, 30), []
    for i in range(60):
        rows.append((i * 17 % 61 if i % 7 else None, " ".join([words(rng, rng.randint(0, 9)), hot, words(rng, rng.randint(0, 9))])))
    rows += [(5, hot), (5, hot + " " + hot), (None, hot)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for pack, bucket in ((300, 2000), (1500, 1 << 20)):
        got = find_repeats(df, ByteWindows(40), pack_bytes=pack, bucket_bytes=bucket)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 40)


def test_transform_against_sorted_suffixes():
    """Each column's order, common prefixes and part of the transform, against plain sorting; spilled to the file as well."""
    rng = np.random.default_rng(5)
    reads = [bytes(rng.integers(97, 99, rng.integers(1, 30)).astype(np.uint8)) for _ in range(200)]
    anchor = np.array([int(rng.integers(0, len(t))) for t in reads])
    size = np.array([len(t) for t in reads])
    columns = Columns(np.frombuffer(b"".join(reads), np.uint8), np.cumsum(size) - size, -anchor, size - anchor)
    t = Transform(columns)
    before = {}
    for col, order, lcp in t.rounds():
        suffix = lambda i: reads[i][col + anchor[i] :]  # noqa: B023, E731
        have = [i for i in range(200) if -anchor[i] <= col < size[i] - anchor[i]]
        assert sorted(order.tolist()) == have and [suffix(i) for i in order] == sorted(map(suffix, have))
        for k in range(1, len(order)):
            a, b = suffix(order[k - 1]), suffix(order[k])
            assert lcp[k] == next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        before[col] = order.tolist()
    for col, part in t.parts():
        # symbols before the suffixes of the next column, in their order, and last symbols of reads that end here
        after = [i for i in before.get(col + 1, []) if -anchor[i] <= col]
        ending = [i for i in range(200) if size[i] - anchor[i] == col + 1]
        assert part == bytes(reads[i][col + anchor[i]] for i in ending + after)
