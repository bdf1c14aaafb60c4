"""The network against loops over every byte, its gradient against differences, and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notelake.llm import byte_cnn
from notelake.llm.byte_cnn import CHUNK, FILTERS, HALF, PAD, WIDTH, Network, cut, quality, scored
from notelake.llm.queries import op13_quality_classifier


def brute(net, text):
    """Every window of every chunk, one by one."""
    w = net.w
    codes = list(text) + [PAD] * (WIDTH - 1 + (not text))
    value = [[float(np.concatenate([w["vector"][c] for c in codes[i : i + WIDTH]]) @ w["filter"][:, f]) for f in range(FILTERS)] for i in range(len(codes) - WIDTH + 1)]
    starts = range(0, max(1, len(text) - HALF), HALF)
    chunks = np.array([[max(max(row[f] for row in value[s : s + CHUNK]) + w["shift"][f], 0) for f in range(FILTERS)] for s in starts])
    line = np.tanh(np.concatenate([chunks.mean(0), chunks.max(0), chunks.min(0)]) @ w["hidden"] + w["hidden_shift"]) @ w["out"] + w["out_shift"][0]
    return 1 / (1 + np.exp(-line))


@pytest.fixture()
def net():
    made = Network(3)
    made.w["shift"] += np.linspace(-0.5, 0.5, FILTERS).astype(np.float32)
    return made


def test_equals_loops_over_all_bytes(net, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, WIDTH, HALF, HALF + 1, CHUNK, CHUNK + 1, 1700)]
    want = [brute(net, t) for t in texts]
    assert np.allclose([net.probability(t) for t in texts], want, atol=1e-5)
    monkeypatch.setattr(byte_cnn, "BLOCK", CHUNK)  # blocks give what the whole gives
    assert np.allclose([net.probability(t) for t in texts], want, atol=1e-5)


def test_every_byte_counts(net):
    text = b"a" * 5_000
    assert all(net.probability(text[:i] + b"\xf0" + text[i + 1 :]) != net.probability(text) for i in (0, 2_500, 4_999))


def test_gradient(net):
    texts = [b"some short text", b"", b"x" * 900 + b"!!" * 60, bytes(range(256)) * 4]
    labels = np.array([1.0, 0.0, 0.0, 1.0])
    net.w = {k: v.astype(float) for k, v in net.w.items()}
    loss = lambda: float(np.mean([-np.log(p if y else 1 - p) for p, y in ((net.probability(t), y) for t, y in zip(texts, labels))]))
    slope = net.gradients([cut(t, 99) for t in texts], labels)
    for name, at in (("filter", (3, 4)), ("hidden", (5, 2)), ("hidden", (FILTERS + 1, 3)), ("hidden", (2 * FILTERS, 1)), ("shift", (2,)), ("out", (1,)), ("vector", (ord("!"), 1)), ("vector", (ord("x"), 0))):
        kept = net.w[name][at]
        net.w[name][at] = kept + 1e-5
        above = loss()
        net.w[name][at] = kept - 1e-5
        below = loss()
        net.w[name][at] = kept
        assert slope[name][at] == pytest.approx((above - below) / 2e-5, rel=2e-2, abs=1e-5), name


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    made = op13_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good, bad = made[made.quality == 1].score.to_numpy(), made[made.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.9
    assert made.score.between(0, 1).all() and ((made.score >= 0.3) == (made.predicted == 1)).all()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text", 0.1), (1, "good text", 0.2), (None, None, 0.3), (2, "", 0.4), (3, "bad!!! bad!!!", 0.5)], "doc_id long, text string, score double").withColumn("c0", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (None, 1), (2, None)], "doc_id long, quality int")
    made = quality(docs, labels).collect()
    assert len(made) == 5 and len({r.score for r in made if r.doc_id == 1}) == 1
    assert [r.score for r in made if r.doc_id == 2] == [r.score for r in made if r.doc_id is None]
    assert [r.held_out for r in made if r.doc_id is None] == [False]
    assert {r.score for r in quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality(docs.limit(0), labels).collect() == []
    kept = scored(docs, None)
    assert kept.columns == ["doc_id", "text", "c0", "score", "predicted"] and kept.count() == 5
