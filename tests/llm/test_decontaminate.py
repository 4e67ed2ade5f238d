import hashlib
import pickle
import random
import re

import numpy as np

from skygrid.llm.decontaminate import ItemWindows, _pieces, contamination, decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, width=13):
    windows = {}
    for i, t in items:
        ws = words(t)
        n = min(width, len(ws))
        for k in range(len(ws) - n + 1 if n else 0):
            windows.setdefault(tuple(ws[k : k + n]), set()).add(i)
    out = []
    for d, t in docs:
        ws, found = words(t), set()
        hit = [False] * len(ws)
        for n in {len(w) for w in windows}:
            for k in range(len(ws) - n + 1):
                if tuple(ws[k : k + n]) in windows:
                    hit[k : k + n] = [True] * n
                    found |= windows[tuple(ws[k : k + n])]
        ids = ",".join(sorted(str(i) for i in found if i is not None))
        n_items = len({i for i in found if i is not None})
        out.append((d, len(ws), sum(hit), n_items, hashlib.sha256(ids.encode()).hexdigest(), sum(hit) > 0 and 20 * sum(hit) >= len(ws)))
    return sorted(out, key=str)


def sample():
    rng = random.Random(4)
    some = lambda n: [rng.choice(["Ab", "cd", "É", "x9", "w"]) + str(rng.randint(0, 400)) for _ in range(n)]
    items = [(i, " ".join(some(rng.randint(10, 40)))) for i in range(12)] + [(20, "two Words"), (21, None), (22, ""), (23, "..."), (None, " ".join(some(20)))]
    items += [(24, items[0][1]), (3, items[3][1])]
    docs = []
    for i in range(60):
        ws = some(rng.randint(0, 300))
        if i % 3 == 0:
            part = items[i % 12][1].split()
            at = rng.randint(0, len(ws))
            ws[at:at] = part[rng.randint(0, 3) :] if i % 2 else [w.upper() for w in part]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(ws)))
    docs += [(70, None), (71, ""), (72, "TWO-words"), (None, items[1][1]), (5, docs[0][1]), (73, "q " * 30_000 + items[2][1]), (74, items[-3][1] or "")]
    return docs, items


def frames(spark):
    docs, items = sample()
    return spark.createDataFrame([(d, t, "s", 3) for d, t in docs], "doc_id long, text string, item_ids string, n_chars long"), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark):
    docs, bench = frames(spark)
    want = brute(*sample())
    assert sorted(map(tuple, contamination(docs, bench).collect()), key=str) == want
    assert sorted(map(tuple, contamination(docs, bench, block_bytes=300).collect()), key=str) == want  # several broadcast blocks


def test_documents_and_spans_go(spark):
    docs, bench = frames(spark)
    out = decontaminate(docs, bench)
    assert out.schema == docs.schema
    gone = {r.doc_id for r in contamination(docs, bench).collect() if r.contaminated}
    rows = out.collect()
    assert not gone & {r.doc_id for r in rows if r.doc_id not in (5, None)}
    assert contamination(out, bench).where("n_hit > 0 and n_items > 0 and n_hit >= 13").count() == 0
    assert decontaminate(docs.limit(0), bench).collect() == []
    assert contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_a_long_item_comes_in_pieces_with_the_same_windows():
    text = " ".join(f"w{i % 37}x{i}" for i in range(3000))
    blocks = list(_pieces(text, 4000, 13))
    assert len(blocks) > 3 and max(map(len, blocks)) < 4000
    cut = lambda t: {tuple(t.split()[i : i + 13]) for i in range(len(t.split()) - 12)}
    assert set().union(*map(cut, blocks)) == cut(text)


def test_windows_of_equal_hash_are_told_apart(monkeypatch):
    from skygrid.llm import decontaminate as module

    monkeypatch.setattr(module, "window_hash", lambda h, size: module.c.grams(h, size) % module.c.U64(7))
    docs, items = sample()
    index = ItemWindows([(None if i is None else str(i), t or "") for i, t in items])
    for d, t in docs[:20]:
        raw = (t or "").encode()
        b = module.c.Batch(0, np.zeros(1, np.int64), np.ones(1, bool), np.array([len(raw)]), raw)
        *_, hit, found = module.scan(b, index)
        want = next(r for r in brute([(d, t)], items))
        assert int(hit.sum()) == want[2] and len({x for x in found[0] if x is not None}) == want[3]


def test_the_index_is_small():
    rng = np.random.default_rng(3)
    items = [(str(i), " ".join(map(str, rng.integers(0, 10**6, 300)))) for i in range(500)]
    size = sum(len(t) for _, t in items)
    assert len(pickle.dumps(ItemWindows(items))) < 8 * size + (1 << 20)
