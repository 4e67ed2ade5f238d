import hashlib
import random

from skygrid.llm import common as c
from skygrid.llm.line_chunks import LineChunks, dedup_lines, remove_repeated_chunks

LAST = 2**63 - 1


def one(text):
    """Chunks of one text, by the operator's own boundaries: (lines, [(first, behind last)])."""
    import numpy as np

    raw = text.encode()
    b = c.Batch(0, np.zeros(1, np.int64), np.ones(1, bool), np.array([len(raw)]), raw)
    s, _ = LineChunks().segments(b)
    return text.split("\n"), list(zip(s.start.tolist(), s.stop.tolist()))


def brute(rows):
    where = []
    for i, (d, t) in enumerate(rows):
        lines, chunks = one(t or "")
        where += [("\n".join(lines[a:z]), LAST if d is None else d, i, a) for a, z in chunks]
    out = []
    for i, (d, t) in enumerate(rows):
        lines, chunks = one(t or "")
        gone = set()
        for a, z in chunks:
            if any(x == "\n".join(lines[a:z]) and (e < (LAST if d is None else d) or (j == i and s < a)) for x, e, j, s in where):
                gone |= set(range(a, z))
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((d, len(lines), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def rows():
    rng = random.Random(8)
    line = lambda: " ".join(rng.choice(["ab", "cd", "é", "fgh"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(0, 5)))
    block = [line() for _ in range(30)]
    out = []
    for i in range(40):
        ls = [line() for _ in range(rng.randint(0, 12))]
        if i % 3 == 0:
            ls += block[rng.randint(0, 9) :]
        out.append((i * 11 % 43, "\n".join(ls + [line() for _ in range(rng.randint(0, 5))])))
    out += [(90, out[0][1]), (91, out[0][1]), (91, out[0][1]), (None, out[0][1]), (92, None), (93, ""), (94, "\n\n\n"), (95, "a\nb\n" * 200), (96, "z" * 30_000 + "\n" + "y" * 30_000)]
    return out


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(d, t, "s") for d, t in data], "doc_id long, text string, kept string")
    got = remove_repeated_chunks(df)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_lines", "n_removed", "kept_sha256").collect()), key=str) == brute(data)


def test_boundaries_resist_shifts():
    lines = [f"line {i * i % 97} of {i}" for i in range(200)]
    cut = lambda ls: {"\n".join(ls[a:z]) for a, z in one("\n".join(ls))[1]}
    whole, shifted = cut(lines), cut(["something new", *lines[:100], "and here", *lines[100:]])
    assert len(whole - shifted) <= 3 and len(whole) > 25


def test_stage_keeps_columns(spark):
    data = rows()
    df = spark.createDataFrame([(d, t, "en", len(t or ""), "keep") for d, t in data], "doc_id long, text string, lang string, n_chars long, n_removed string")
    out = dedup_lines(df)
    assert out.schema == df.schema
    got = out.collect()
    assert all(r.n_removed == "keep" and (r.text is None or r.n_chars == len(r.text)) for r in got)
    assert any(r.doc_id == 92 and r.text is None for r in got) and any(r.doc_id == 93 for r in got)
    assert dedup_lines(df.limit(0)).collect() == []


def test_passages_go_as_a_whole(spark):
    rng = random.Random(21)
    line = lambda: " ".join("%08x" % rng.getrandbits(32) for _ in range(rng.randint(5, 12)))
    data, want = [], {}
    for n in (2, 3, 4, 6, 10, 20) * 5:
        passage = [line() for _ in range(n)]
        if n > 4:
            passage[2] = " "
        for k in range(2):
            head, tail = [line() for _ in range(rng.randint(1, 8))], [line() for _ in range(rng.randint(1, 8))]
            want[len(data)] = n if k else 0
            data.append((len(data), "\n".join([*head, *passage, *tail])))
    got = remove_repeated_chunks(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == want


def chunks_of(text, mean=4, roll=2):
    """Chunk boundaries by a chunker of the test's own: plain integers, one line after another."""
    lines = text.encode().split(b"\n")
    hashes = [int(c.segment_hash(c.np.frombuffer(x, c.np.uint8), c.np.array([0]), c.np.array([len(x)]))[0]) for x in lines]

    def mix(h):
        for _ in range(2):
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
        return h ^ h >> 32

    out, a = [], 0
    for i in range(len(lines)):
        window = hashes[i - roll + 1 : i + 1] if i >= roll - 1 else None
        value = mix(sum(h * pow(c.P, k, 2**64) for k, h in enumerate(window)) % 2**64) if window else None
        if i == len(lines) - 1 or (window and value % mean == 0):
            out.append((a, i + 1))
            a = i + 1
    full = [bool(x.strip(b"\x20\x09\x0a\x0b\x0c\x0d")) for x in lines]
    own = [(a, z) for a, z in out if sum(full[a:z]) > 2 or (sum(full[a:z]) == 2 and not (full[a] and full[z - 1]))]
    words = [i for i, f in enumerate(full) if f]
    return sorted(own + [(p, q + 1) for p, q in zip(words, words[1:])])


def test_boundaries_against_another_chunker():
    for _, t in rows():
        assert sorted(one(t or "")[1]) == chunks_of(t or ""), t
