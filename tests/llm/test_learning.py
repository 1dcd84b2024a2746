"""What the classifiers learn: gradients, held-out documents, and the bounds of what they are fitted on."""

from pathlib import Path

import numpy as np
import pytest

from kilnflow.llm import labelled, quality_model, toxicity


@pytest.fixture(scope="module")
def larger(spark, sf_dir):
    at = Path(sf_dir).parent / "sf0.1"
    return spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(2)
    net = quality_model.Net.start(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.integers(0, 256, (5, quality_model.CHUNK)).astype(np.uint8)
    doc, y = np.array([0, 0, 1, 2, 2]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = np.bincount(doc, weights=net.scores(x)) / np.bincount(doc)
        return float(np.mean(np.logaddexp(0, s) - y * s))

    g = net.gradients(x, doc, y)
    for name, p in net.p.items():
        for at in map(tuple, np.argwhere(np.abs(g[name]) > np.abs(g[name]).max() * 0.3)[:3]):
            was = p[at]
            p[at] = was + 1e-5
            up = loss()
            p[at] = was - 1e-5
            down = loss()
            p[at] = was
            assert g[name][at] == pytest.approx((up - down) / 2e-5, rel=0.02), name


def test_quality_of_held_out_documents(larger):
    docs, labels = larger
    rows = quality_model.score(docs, labels).filter("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    right = lambda y: np.mean([r.predicted == y for r in rows if r.quality == y])
    assert len(rows) > 500 and right(1) >= 0.98 and right(0) >= 0.9


def test_toxicity_of_held_out_documents(larger):
    docs, labels = larger
    rows = toxicity.score(docs, labels).filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    right = lambda y: np.mean([r.predicted == y for r in rows if r.toxic == y])
    assert len(rows) > 500 and right(0) >= 0.97 and right(1) >= 0.75


def test_long_texts_count_to_their_end(spark):
    """What marks a document stands in the last of very many chunks, beyond any prefix."""
    rng = np.random.default_rng(5)
    noise = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    rows = [(i, noise(3000) + ("#@!%" * 700 if i % 2 else noise(2800)), i % 2) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_model.score(docs, labels).collect()}
    assert np.mean([(got[i].score >= 0.5) == (y == 1) for i, _, y in rows if got[i].held_out]) >= 0.95


def test_samples_are_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 + 1000 * (i % 5 == 0))) for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    few, y, _ = labelled.sample(docs, labels, "quality", 5, 0, (10, 12))
    assert (y == 0).sum() == 10 and (y == 1).sum() == 12
    small, y, _ = labelled.sample(docs, labels, "quality", 5, 0, (50, 50), most_bytes=500)
    assert sum(map(len, small)) <= 500 and len(small) >= 40 and all(len(t) == 10 for t in small)
    assert labelled.sample(docs, labels.limit(0), "quality", 5, 0, (5, 5))[0] == []


def test_rare_features_are_a_parameter(spark):
    rows = [(i, "a zorg here" if i % 4 == 0 else "plain words here", int(i % 4 == 0)) for i in range(24)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    score = lambda n: {r.doc_id: r.score for r in toxicity.score(docs, labels, min_seen=n).collect()}
    one, none = score(1), score(100)
    assert one[0] > one[1] and none[0] == pytest.approx(none[1])
