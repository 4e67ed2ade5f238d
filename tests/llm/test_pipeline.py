"""The pipeline's stages held against brute force, on their own inputs."""

import hashlib
import shutil

import corpus_pipeline
import pytest
import sentencepiece

from skygrid.llm import gam, order_minhash
from skygrid.llm.queries import PIECE_MODEL, tokenizer_path

from . import test_decontaminate, test_line_chunks

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_stay(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns and df.dtypes == steps[0].dtypes
    assert [len(ids(df)) for df in steps] == sorted((len(ids(df)) for df in steps), reverse=True)


def test_classifier_decides(spark, steps):
    scores = gam.classify(steps[0], spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(steps[1]) == {r.doc_id for r in scores.collect() if r.predicted == 1}


def test_near_copies_leave_one(steps):
    rows = {r.doc_id: r.text.split() for r in steps[2].collect()}
    kept = ids(steps[3])
    parent = {d: d for d in rows}

    def root(d):
        return d if parent[d] == d else root(parent[d])

    names = sorted(rows)
    for i, a in enumerate(names):
        for b in names[:i]:
            limit = order_minhash.allowed(len(rows[a]), len(rows[b]), 0.8)
            if abs(len(rows[a]) - len(rows[b])) <= limit and len(set(rows[a]) & set(rows[b])) * 2 > len(set(rows[a])) and order_minhash.banded_distance(rows[a], rows[b], limit) <= limit:
                parent[root(a)] = root(b)
    groups = {}
    for d in names:
        groups.setdefault(root(d), set()).add(d)
    assert kept == {min(g) for g in groups.values()}


def test_encoding_of_what_is_left(steps):
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
    want = {r.doc_id: len(lib.encode(r.text)) for r in steps[4].collect()}
    assert {r.doc_id: r.n_tokens for r in steps[5].collect()} == want


def test_run_is_the_stages(spark, steps):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, steps[5].collect()))
    assert corpus_pipeline.ORACLE_SQL is None


def test_lines_against_another_chunker(steps):
    """What is left of each text, with chunks and pairs by the test's own chunker."""
    rows = [(r.doc_id, r.text or "") for r in steps[1].collect()]
    first, of = {}, {}
    for d, t in sorted(rows):
        lines = t.split("\n")
        of[d] = lines, test_line_chunks.chunks_of(t)
        for a, z in of[d][1]:
            first.setdefault("\n".join(lines[a:z]), (d, a))
    want = {}
    for d, (lines, chunks) in of.items():
        gone = {i for a, z in chunks if first["\n".join(lines[a:z])] != (d, a) for i in range(a, z)}
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or text.split():
            want[d] = text
    assert {r.doc_id: r.text or "" for r in steps[2].collect()} == want


def test_benchmark_passages_against_brute_force(spark, steps):
    docs = [(r.doc_id, r.text) for r in steps[3].collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    hits = {r[0]: r for r in test_decontaminate.brute(docs, items)}
    after = {r.doc_id: r.text for r in steps[4].collect()}
    assert set(after) == {d for d, r in hits.items() if not r[5]}
    for d, t in docs:
        if d in after:
            assert (after[d] == t) == (hits[d][2] == 0)


def odd_tables(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_odd_rows_and_empty_tables(spark, tmp_path):
    good = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(25).collect()]
    texts = [*good, (900, None), (901, ""), (902, " \n"), (None, "only words here"), (None, None), (903, "w " * 60_000), good[0], good[0], (904, good[1][1])]
    rows = [(d, t, "en", None, len(t or ""), "keep") for d, t in texts]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").limit(40).collect()]
    for name, (r, own, items) in {"all": (rows, labels, [(1, good[2][1][:400]), (None, None)]), "no_labels": (rows, [], []), "no_documents": ([], labels, [(1, "a b c")])}.items():
        folder = f"{tmp_path}/{name}"
        odd_tables(spark, folder, r, own, items)
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, folder)
            assert k == 4 or out.columns == docs.columns
            out.write.parquet(f"{folder}/out{k}")
            docs = spark.read.parquet(f"{folder}/out{k}")
            assert k == 4 or all(x.gone == "keep" for x in docs.collect())
        assert (docs.count() == 0) == (not r)
        lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(PIECE_MODEL))
        before = {(x.doc_id, len(lib.encode(x.text or ""))) for x in spark.read.parquet(f"{folder}/out3").collect()}
        assert {(x.doc_id, x.n_tokens) for x in docs.collect()} == before
        assert all(x.ids_sha256 == hashlib.sha256(b"").hexdigest() for x in docs.collect() if x.n_tokens == 0)
        shutil.rmtree(folder)
