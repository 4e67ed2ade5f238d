import numpy as np

from skygrid.llm import common as c
from skygrid.llm import gam


def test_tables_learn_main_effects_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0) | (x[:, 2] > 1.2)).astype(float)
    model = gam.fit(x[:2000], y[:2000])
    assert (0, 1) in [tuple(sorted(p)) for p in model.pairs]
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.93
    assert (model.score(x) == model.score(x)).all()


def test_priors():
    empty = gam.fit(np.zeros((0, 3)), np.zeros(0))
    assert empty.score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    one = gam.fit(np.ones((5, 3)), np.ones(5))
    assert one.score(np.zeros((1, 3)))[0] > 0.8


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["", "Hello world.\nHello world.", "ÉÈ!! $$$ | a", "w " * 5000, "\n\n", "x" * 9000, "äöü 123"]

    def batch(ts):
        raw = [t.encode() for t in ts]
        n = len(raw)
        return c.Batch(0, np.arange(n), np.ones(n, bool), np.array([len(r) for r in raw]), b"".join(raw))

    together = gam.features(batch(texts))
    alone = np.concatenate([gam.features(batch([t])) for t in texts])
    assert np.allclose(together, alone) and np.isfinite(together).all() and (together[0] == 0).all()


def test_held_out_quality(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = gam.classify(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "quality").toPandas()
    assert len(out) > 50 and (out.predicted == out.quality).mean() > 0.9
    assert out.score.between(0, 1).all()


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "text here", "c"), (3, "x", "d"), (3, "x", "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = gam.classify(docs, labels).collect()
    assert len(rows) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    kept = gam.keep_good(docs, labels)
    assert kept.schema == docs.schema and kept.count() == 5
    assert gam.classify(docs.limit(0), labels).collect() == []
