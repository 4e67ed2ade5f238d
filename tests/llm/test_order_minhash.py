import random

import numpy as np

from skygrid.llm import order_minhash as om


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_distance_equals_the_full_table():
    rng = random.Random(2)
    for _ in range(1500):
        a = [rng.randint(0, rng.choice([2, 9, 99])) for _ in range(rng.randint(0, 70))]
        b = list(a)
        for _ in range(rng.randint(0, 14)):
            at = rng.randint(0, len(b))
            rng.choice([lambda: b.insert(at, rng.randint(0, 9)), lambda: b[at : at + 1].clear() or b.__delitem__(slice(at, at + 1)), lambda: b.__setitem__(slice(at, at + 1), [7])])()
        d = distance(a, b)
        for limit in {0, 1, 3, d, max(0, d - 1), d + 1, 20}:
            assert om.banded_distance(a, b, limit) == min(d, limit + 1), (a, b, limit, d)


def test_sketches_see_the_order():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**64, 200, dtype=np.uint64)
    a, b = om.sketches(h), om.sketches(np.concatenate([h[100:], h[:100]]))
    assert (a == om.sketches(h)).all()
    assert 0 < (a == b).sum() < len(a)  # the same k-mers, some pairs in the other order


def documents(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(rng.randint(30, 90))] for _ in range(12)]
    rows = []
    for i in range(70):
        ws = list(rng.choice(base))
        for _ in range(rng.randint(0, len(ws) // 12)):
            ws[rng.randrange(len(ws))] = word()
        rows.append((i * 13 % 71, " ".join(ws)))
    rows += [(100 + i, " ".join(word() for _ in range(40))) for i in range(20)]
    rows += [(200, rows[0][1]), (201, rows[0][1].replace(" ", "\n")), (202, None), (203, ""), (204, "a b"), (205, "a b"), (206, "a c"), (207, "x " * 20_000), (208, "x " * 19_000), (None, rows[1][1]), (None, None)]
    return rows


def brute(rows, threshold=0.8):
    ws = [(t or "").split() for _, t in rows]
    parent = list(range(len(rows)))
    root = lambda i: i if parent[i] == i else root(parent[i])
    for i in range(len(rows)):
        for j in range(i):
            n = max(len(ws[i]), len(ws[j]))
            if ws[i] and ws[j] and (ws[i] == ws[j] or (n < 500 and distance(ws[i], ws[j]) <= (1 - threshold) * n + 1e-9) or (len(ws[i]) > 500 < len(ws[j]))):
                parent[root(i)] = root(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((d, min(ids) if ids else None))
    return sorted(out, key=str)


def test_classes_against_all_pairs(spark):
    rows = documents()
    df = spark.createDataFrame([(d, t, "r", b"n") for d, t in rows], "doc_id long, text string, root string, node binary")
    got = sorted(map(tuple, om.near_duplicates(df).collect()), key=str)
    assert got == brute(rows)
    small = sorted(map(tuple, om.near_duplicates(df, group_bytes=3000).collect()), key=str)
    assert small == got  # components in blocks


def test_keep_first(spark):
    rows = documents(5)
    df = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    out = om.keep_first(df)
    assert out.schema == df.schema
    want = {d for d, k in brute(rows) if d is not None and d == k} | {d for d, t in rows if d is not None and not (t or "").split()}
    assert {r.doc_id for r in out.collect() if r.doc_id is not None} == want


def test_empty_table(spark):
    assert om.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components(spark):
    edges = [(b"%03d" % i, b"%03d" % (i + 1)) for i in range(40) if i != 20] + [(b"900", b"000"), (b"5", b"5")]
    got = dict(map(lambda r: (bytes(r.node), bytes(r.root)), om.components(spark.createDataFrame(edges, "a binary, b binary")).collect()))
    assert {got[b"%03d" % i] for i in range(21)} == {b"000"} and {got[b"%03d" % i] for i in range(21, 41)} == {b"021"} and got[b"900"] == b"000" and b"5" not in got


def edited(rng, ws, edits, new):
    """At most so many substituted, inserted or deleted words, at random places."""
    out = list(ws)
    for _ in range(edits):
        at = rng.randrange(len(out)) if out else 0
        out[at : at + rng.randint(0, 1)] = [new()] if rng.random() < 0.7 else []
    return out


def test_short_texts_share_a_part_with_every_similar_text():
    rng = random.Random(11)
    new = lambda: rng.getrandbits(63)
    for n in range(1, 51):
        for _ in range(25):
            a = [new() for _ in range(n)]
            b = edited(rng, a, om.allowed(n, n, 0.8), new) or a
            if min(len(a), len(b)) > om.SHORT or distance(a, b) > om.allowed(len(a), len(b), 0.8):
                continue
            x, y = (om.candidate_keys(np.array(t, np.uint64)) for t in (a, b))
            assert len(set((x >> np.uint64(1)).tolist()) & set((y >> np.uint64(1)).tolist())), (a, b)


def test_isolated_pairs_just_above_the_threshold(spark):
    rng = random.Random(12)
    new = lambda: "%09x" % rng.getrandbits(36)
    rows, pairs = [], {}
    for n in (10, 20, 40, 60, 100, 400):
        for share in (0.8, 0.82, 0.85):
            for _ in range(20):
                a = [new() for _ in range(n)]
                b = list(a)
                for at in rng.sample(range(n), om.allowed(n, n, share)):
                    b[at] = new()
                pairs[len(rows)] = n, share
                rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    got = {r.doc_id: r.class_id for r in om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i + 1] in (i, i + 1) and got[i] == i for i in pairs)
    for n in (10, 20, 40, 60, 100, 400):
        found = [got[i + 1] == i for i, (m, _) in pairs.items() if m == n]
        assert sum(found) >= (1 if n <= om.SHORT else 0.93) * len(found), (n, sum(found), len(found))


def test_hot_nodes_are_spread(spark, monkeypatch):
    rng = random.Random(31)
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1000 + rng.randrange(i)) for i in range(1, 200)] + [(2000, i) for i in range(2001, 2100)] + [(2050, 7)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {(r.node, r.root) for r in om.components(frame).collect()}
    monkeypatch.setattr(om, "HOT_DEGREE", 20)
    monkeypatch.setattr(om, "LOCAL_PAIRS", 0)
    assert {(r.node, r.root) for r in om.components(frame).collect()} == want
    assert len(want) == 300 + 200 + 100 and {r for n, r in want} == {0, 1000}


def test_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 7, "x"), (2, "a b c d e f", 8, "y"), (3, None, 9, "z")], "doc_id long, text string, gone int, `num.of` string")
    assert sorted(r.gone for r in om.keep_first(df).collect()) == [7, 9]
    other = df.withColumnsRenamed({"doc_id": "my.id", "text": "t`t"})
    assert sorted(r.gone for r in om.keep_first(other, id_name="my.id", text_name="t`t").collect()) == [7, 9]


def edit_some(rng, a, share, kind, new):
    """The words after so many edits of a kind, all of which count."""
    b, d = list(a), om.allowed(len(a), len(a), share)
    if kind == "substitutions":
        for at in rng.sample(range(len(a)), d):
            b[at] = new()
    elif kind == "deletions":
        for at in sorted(rng.sample(range(len(a)), d), reverse=True):
            del b[at]
    elif kind == "insertions":
        for _ in range(int(d / share) if share else d):
            b.insert(rng.randrange(len(b) + 1), new())
    else:  # a run of words moves: it is deleted and inserted again
        n = d // 2
        at = rng.randrange(len(a) - n)
        run = b[at : at + n]
        del b[at : at + n]
        to = rng.randrange(len(b) + 1)
        b[to:to] = run
    return b


def test_recall_at_the_threshold():
    """Share of isolated pairs that are candidates, over lengths and kinds of edits: all short ones, 0.9 of the others at least."""
    rng = random.Random(41)
    new = lambda: rng.getrandbits(63)
    for n in (12, 30, 45, 60, 120, 300, 600):
        for share in (0.8, 0.83):
            for kind in ("substitutions", "deletions", "insertions", "moves"):
                met = total = 0
                for _ in range(60):
                    a = [new() for _ in range(n)]
                    b = edit_some(rng, a, share, kind, new)
                    x, y = (om.candidate_keys(np.array(t, np.uint64)) for t in (a, b))
                    met += bool(len(np.intersect1d(x >> np.uint64(1), y >> np.uint64(1))))
                    total += 1
                assert met >= (1 if min(len(a), len(b)) <= om.SHORT else 0.9) * total, (n, share, kind, met, total)


def test_similar_texts_of_a_large_component_stay_together(monkeypatch):
    import pyarrow as pa
    import pyarrow.compute
    import zstandard

    rng = random.Random(11)
    z = zstandard.ZstdCompressor()
    for threshold, counted in ((0.8, 64), (0.8, 2), (0.75, 3), (0.6, 4), (1.0, 64)):
        monkeypatch.setattr(om, "COUNTED", counted)
        k, word = om._gram_words(threshold), lambda: rng.choice("abcdefghij") + rng.choice("klmn")
        texts = []
        for _ in range(60):
            ws = [word() for _ in range(rng.randint(1, 70))]
            texts.append(ws)
            for _ in range(2):  # copies near the limit
                other = list(ws)
                for _ in range(int((1 - threshold) * len(ws))):
                    at = rng.randrange(len(other) + 1)
                    other[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
                texts.append(other or [word()])
        rows = [{"num": i, "root": i % 2, "text": z.compress(" ".join(t).encode())} for i, t in enumerate(texts)]
        with monkeypatch.context() as m:
            m.setattr("pyspark.TaskContext.get", lambda: type("Task", (), {"partitionId": lambda self: 1})())
            m.setattr(om, "CHUNK_BYTES", 3000)
            chunks = list(om._chunks([pa.RecordBatch.from_pylist(rows)]))
        assert len(chunks) > 3
        by = lambda parts, name: [t.filter(pa.compute.equal(t[name], x)) for t in [pa.Table.from_batches(parts) if isinstance(parts[0], pa.RecordBatch) else pa.concat_tables(parts)] for x in t[name].unique()]
        sent = by(list(om._send_grams(5, k)(chunks)), "bucket")
        replies = pa.concat_tables([om._count_grams(t) for t in sent] + [pa.Table.from_batches(chunks)])
        rare = [om._rare_grams(5, 3, threshold)(t) for t in by([replies], "chunk")]
        shared: dict = {}
        for t in by(rare, "bucket"):
            for x in om._gram_pairs(threshold)(t).to_pylist():
                n, _ = shared.get((x["a"], x["b"]), (0, 0))
                shared[x["a"], x["b"]] = n + x["shared"], x["needed"]
        parent = list(range(len(texts)))
        root = lambda i: i if parent[i] == i else root(parent[i])
        for (a, b), (n, needed) in shared.items():
            if n >= needed:
                parent[root(a)] = root(b)
        similar = [(i, j) for i, a in enumerate(texts) for j in range(i % 2, i, 2) if a != texts[j] and distance(a, texts[j]) <= om.allowed(len(a), len(texts[j]), threshold)]
        assert len(similar) > 10 or threshold == 1
        assert all(root(i) == root(j) for i, j in similar)


def test_a_large_component_sends_its_texts_about_once(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(5))
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(150):  # texts that share a passage and no more, every third with a near copy
        ws = [word() for _ in range(50)] + passage + [word() for _ in range(50)]
        rows.append((2 * i, " ".join(ws)))
        if i % 3 == 0:
            ws[7] = ws[90] = word()
            rows.append((2 * i + 1, " ".join(ws)))
    sent, real = spark.sparkContext.accumulator(0), om._link_groups

    def counting(threshold):
        run = real(threshold)

        def link(table):
            sent.add(table.num_rows)
            return run(table)

        return link

    monkeypatch.setattr(om, "_link_groups", counting)
    got = {d: x for d, x in om.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=8000).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}
    assert 0 < sent.value <= 2 * len(rows)
