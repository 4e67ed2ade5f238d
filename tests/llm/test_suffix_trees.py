import hashlib
import random
import re

import numpy as np

from skygrid.llm.suffix_trees import WordWindows, prefix_groups, remove_repeated_words, subtree
from skygrid.llm.exchange import find_repeats

LAST = 2**63 - 1


def brute(rows, width):
    data = [(LAST if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    least = {}
    for d, ws in data:
        for s in range(len(ws) - width + 1):
            k = tuple(ws[s : s + width])
            least[k] = min(d, least.get(k, d))
    out = []
    for (d, ws), (own, _) in zip(data, rows):
        gone = [False] * len(ws)
        for s in range(len(ws) - width + 1):
            if least[tuple(ws[s : s + width])] < d:
                gone[s : s + width] = [True] * width
        kept = " ".join(w for w, g in zip(ws, gone) if not g)
        out.append((own, len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows, width=13, **options):
    df = spark.createDataFrame([(d, t, 1, "b") for d, t in rows], "doc_id long, text string, batch int, back string")
    got = find_repeats(df, WordWindows(width, **options)) if options else remove_repeated_words(df, width)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, width)


def sample(rng):
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    some = lambda n: [word() for _ in range(n)]
    a, b = some(60), some(25)
    rows = []
    for i in range(50):
        ws = some(rng.randint(0, 40))
        if i % 3 == 0:
            ws += a[rng.randint(0, 30) :]
        if i % 4 == 0:
            ws += b
        ws += some(rng.randint(0, 20))
        rows.append((i * 7 % 53, rng.choice([" ", "\n", " \t"]).join(ws)))
    rows += [(100 + i, rows[i % 6][1]) for i in range(12)]
    return rows


def test_against_brute_force(spark):
    rows = sample(random.Random(5))
    check(spark, rows)
    check(spark, rows, 5)
    check(spark, rows, 7, group=16)


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "x " * 12), (5, "x " * 13), (6, "x " * 400), (6, "x " * 400), (None, "x " * 20), (None, None)]
    rows += [(7, "a b " * 13), (8, "a b " * 14), (8, "q " * 14), (8, "q " * 14), (9, "y" * 50_000), (10, "y" * 50_000)]
    check(spark, rows)


def test_empty_table(spark):
    assert remove_repeated_words(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_prefix_groups_cover_all_suffixes_and_keep_equal_ones_together():
    rng = np.random.default_rng(1)
    sym = rng.integers(0, 3, 3000).astype(np.int32)
    at = np.arange(2990)
    seen, windows = [], {}
    for k, (group, depth) in enumerate(prefix_groups(sym, at, 6, 50)):
        seen.append(group)
        order, lcp = subtree(sym, group, depth, 6)
        keys = [tuple(sym[i : i + 6]) for i in order]
        assert keys == sorted(keys)
        for i in range(1, len(keys)):
            assert (lcp[i] == 6) == (keys[i] == keys[i - 1])
        for x in keys:
            assert windows.setdefault(x, k) == k
    assert sorted(np.concatenate(seen)) == list(at)


def test_many_packs_of_one_task(spark):
    rows = sample(random.Random(15)) * 2 + [(None, sample(random.Random(15))[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = find_repeats(df, WordWindows(7), pack_bytes=400, bucket_bytes=1500)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 7)
