import base64

import public_tokenizers
import pytest
import sentencepiece
import tiktoken

from skygrid.llm.queries import op9_token_rollups
from skygrid.llm.token_rollups import Rollup, count_tokens, deletes, inserts, load_tokenizer, reversed_images, revisions

VERSIONS = {"piece": public_tokenizers.path("piece_bpe_32k.model"), "bytes": public_tokenizers.path("byte_bpe_50k.tiktoken")}


def docs(spark, rows):
    return spark.createDataFrame(rows, "source string, lang string, text string")


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens, r.n_bytes) for r in rollup.totals().collect()}


def test_batches_add_up_once(spark, tmp_path):
    a = [("s", "en", "Hello world"), ("s", "en", "again"), ("t", None, None), (None, "de", "Größe <|endoftext|>"), ("u", "en", "x " * 20_000)]
    rollup = Rollup(spark, f"file://{tmp_path}/r")
    assert totals(rollup) == {}
    assert rollup.apply("b1", inserts(docs(spark, a)), VERSIONS)
    assert not rollup.apply("b1", inserts(docs(spark, a)), VERSIONS)
    got = totals(rollup)
    lib = sentencepiece.SentencePieceProcessor(model_file=VERSIONS["piece"])
    assert got["s", "en", "piece"] == (2, len(lib.encode("Hello world")) + len(lib.encode("again")), 16)
    assert got["t", None, "bytes"] == (1, 0, 0) and got[None, "de", "piece"][0] == 1
    assert rollup.apply("b2", revisions(docs(spark, a[1:2]), docs(spark, [("s", "en", "again and again")])), VERSIONS)
    assert rollup.apply("b3", deletes(docs(spark, a[4:])), VERSIONS)
    after = totals(rollup)
    assert after["s", "en", "piece"] == (2, len(lib.encode("Hello world")) + len(lib.encode("again and again")), 26)
    assert ("u", "en", "piece") not in after
    assert rollup.compact() and totals(rollup) == after
    assert rollup.committed() == {"b1", "b2", "b3"} and not rollup.apply("b2", inserts(docs(spark, a)), VERSIONS)
    assert rollup.apply("b4", inserts(docs(spark, a[:0])), VERSIONS) and totals(rollup) == after
    assert rollup.apply("b5", inserts(docs(spark, a[:1])), VERSIONS) and totals(rollup)["s", "en", "piece"][0] == 3


def test_long_blanks_count_as_the_library_would(monkeypatch):
    from skygrid.llm import token_rollups as module

    path = VERSIONS["bytes"]
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("lib", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    count = load_tokenizer(path)
    assert count([" " * 2_000_000, "ab" + "\n" * 2_000_000 + "cd"])[0] > 0  # the library alone overflows its stack
    monkeypatch.setattr(module, "LONG_BLANKS", module.regex.compile(r"\p{White_Space}{3,}"))
    texts = ["a   b", "a\n\n\nb", "   ", "x  \t\u00a0\u2003 y", " \u3000  \n", "a    \nb   c", "", "\x1c\x1d\x1e\x1f a", "a" + " " * 300 + "1", "'s    's"]
    assert count(texts) == [len(lib.encode_ordinary(t)) for t in texts]


def test_a_lost_driver_leaves_no_commit(spark, tmp_path, monkeypatch):
    a = docs(spark, [("s", "en", "Hello")] * 2)
    rollup = Rollup(spark, f"file://{tmp_path}/r")
    with monkeypatch.context() as m:
        m.setattr(Rollup, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            rollup.apply("b", inserts(a), VERSIONS)
    assert rollup.committed() == set() and totals(rollup) == {}
    assert rollup.apply("b", inserts(a), VERSIONS)
    assert totals(rollup)["s", "en", "piece"][0] == 2  # repeated rows count each
    assert not rollup._settle("b", {"batches": ["b"], "data": "data/none"}) and rollup.committed() == {"b"}


def test_names_and_counted_images(spark, tmp_path):
    rows = spark.createDataFrame([("s", "en", "Hello", -7, "t")], "`my.source` string, tokenizer string, body string, sign int, n_tokens string")
    images = count_tokens(inserts(rows, "my.source", "tokenizer", "body"), VERSIONS)
    rollup = Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.apply_counted("a", images) and {k[:2] for k in totals(rollup)} == {("s", "en")}
    assert rollup.apply_counted("b", reversed_images(images)) and totals(rollup) == {}


def test_query_against_plain_counts(spark):
    sf = "/root/testdata/sf0.001"
    known = {name: load_tokenizer(public_tokenizers.path(name)) for name in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken")}
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for name, count in known.items():
            own = want.setdefault((r.source, r.lang, name), [0, 0, 0])
            for i, x in enumerate((1, count([r.text or ""])[0], len((r.text or "").encode()))):
                own[i] += x
    assert {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens, r.n_bytes] for r in op9_token_rollups(spark, sf).collect()} == want
