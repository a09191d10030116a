import zlib

import numpy as np
import pyarrow as pa

from graphloom.llm import quality
from graphloom.llm import textops as T
from graphloom.runtime import table


def test_gradient_equals_differences():
    r = np.random.default_rng(0)
    model, upto = quality.Attention(), np.array([0, 3, 4, 9])
    x, y = r.normal(size=(9, quality.FEATURES)), np.array([1.0, 0.0, 1.0])
    found = model.gradient(x, upto, y)
    loss = lambda: -(y * np.log(p := model.score(x, upto)) + (1 - y) * np.log(1 - p)).mean()
    for k in model.p:
        spot = tuple(0 for _ in model.p[k].shape)
        model.p[k][spot] += 1e-6
        up = loss()
        model.p[k][spot] -= 2e-6
        assert abs((up - loss()) / 2e-6 - found[k][spot]) < 1e-5
        model.p[k][spot] += 1e-6


def test_passages_cover_whole_texts():
    texts = ["", None, "a b c", "w " * 130, "\n\n", "X!! Y!! Z!!"]
    out, upto = quality.passages(*T.text_bytes(pa.array(texts)))
    assert np.diff(upto).tolist() == [1, 1, 1, 3, 1, 1]
    one, _ = quality.passages(*T.text_bytes(pa.array([texts[5]])))
    assert np.allclose(out[-1], one[0])


def test_fitting_is_bounded(spark, monkeypatch):
    """Repeated ids give one row each, long texts a bounded number of passages."""
    seen = []
    monkeypatch.setattr(quality.Attention, "fit", lambda self, bags, label: seen.append([len(b) for b in bags]) or self)
    docs = spark.createDataFrame([(k % 4 + 1, "word " * 64 * 300) for k in range(20)] + [(5, None), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 6)] + [(None, 1), (2, None)], "doc_id long, quality int")
    quality.fit_quality(docs, labels)
    fold = [k for k in range(1, 6) if zlib.crc32(str(k).encode()) % 5]
    assert sorted(seen[0]) == sorted(1 if k == 5 else quality.TRAIN_PASSAGES for k in fold)


def test_held_out_accuracy_and_edges(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scores = quality.quality_scores(docs, labels)
    assert scores.count() == docs.count()
    held = scores.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").toPandas()
    assert (held.predicted == held.quality).mean() > 0.9
    assert held[held.quality == 1].predicted.mean() > 0.95
    odd = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 3)], "doc_id long, text string, score int")
    rows = quality.quality_scores(odd, labels.limit(0)).collect()
    assert [r.score for r in rows] == [0.5] * 3
    assert quality.keep_good(odd, labels.limit(0)).columns == ["doc_id", "text", "score"]
    assert quality.quality_scores(docs.limit(0), labels).collect() == []
