import random
import re

from skygrid.llm import rule_ledger as rl


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    grams = [tuple(ws[i : i + 5]) for i in range(len(ws) - 4)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    hit = set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit |= set(range(i, i + 5))
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def texts():
    rng = random.Random(6)
    out = [None, "", " \n\t ", "a b c d", "a b c d e", "a b c d e f", "x " * 5, "x " * 6, "x " * 3000, "é🏳️ " * 9, "a\nb\na\n\n \na ", "\x0b#*\x0c$ %&|<> \r\n", "q" * 20_000]
    for _ in range(60):
        ws = [rng.choice("abcdé") * rng.randint(1, 2) for _ in range(rng.randint(0, 60))]
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in ws))
    return out


def test_measures_against_brute_force(spark):
    rows = [(i, t, "m") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, measured string")
    got = {r.doc_id: r for r in rl.judge(df).collect()}
    for i, t, _ in rows:
        r = got[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)[:80]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (r.fail_bits & rl.mask_of("v1") == 0)
    assert rl.judge(df.limit(0)).collect() == []
    null_id = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert rl.judge(null_id).count() == 3


def test_ablation(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "text string")
    entries = rl.ledger(df)
    bits = [r.fail_bits for r in entries.select("fail_bits").collect()]
    mask = rl.mask_of("v1")
    got = {r.rule: (r.n_failed, r.n_only) for r in rl.ablation(entries, "v1").collect()}
    for rule in rl.RULES:
        if mask >> rule.bit & 1 and rule.name in got:
            assert got[rule.name] == (sum(b & mask >> 0 & 1 << rule.bit > 0 for b in bits), sum(b & mask == 1 << rule.bit for b in bits))
