import zlib

import numpy as np

from metricloom.llm import toxicity


def auc(scores, truth):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(scores))
    values = np.asarray(scores)[order]
    for v in np.unique(values):
        at = np.flatnonzero(values == v)
        ranks[order[at]] = at.mean() + 1
    truth = np.asarray(truth, bool)
    return (ranks[truth].sum() - truth.sum() * (truth.sum() + 1) / 2) / (truth.sum() * (~truth).sum())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.score(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in zip(got["doc_id"], got["held_out"], strict=True))
    both = got[got["held_out"]].merge(labels.toPandas(), on="doc_id")
    right = auc(both["score"], both["toxic"] == 1)
    caught = (both["predicted"] & both["toxic"]).sum()
    precision, recall = caught / max(1, both["predicted"].sum()), caught / both["toxic"].sum()
    print("auc", right, "precision", precision, "recall", recall)
    assert right > 0.9 and precision > 0.8 and recall > 0.8
    again = toxicity.score(docs.repartition(5), labels).toPandas().sort_values("doc_id")
    assert np.allclose(again["score"], got.sort_values("doc_id")["score"])


def test_hidden_positives_do_not_flip_the_fit():
    rng = np.random.default_rng(0)
    rows, p, u = [], [], []
    for k in range(4000):
        toxic = rng.random() < 0.2
        rows.append(np.array(sorted({0} if toxic and rng.random() < 0.95 else set()) + [1] * int(rng.random() < 0.5), np.int32))
        p.append(float(toxic and k % 2 == 0))
        u.append(1.0)
    w, bias = toxicity.minimise(rows, np.array(p), np.array(u), 2, 0.2)
    known = 1 / (1 + np.exp(-(w[0] + bias)))
    assert known > 0.8 and 1 / (1 + np.exp(-(w[1] + bias))) < 0.15 and abs(w[1]) < 0.5


def plain_risk(w, rows, p, u, prior):
    """Non-negative risk, text by text."""
    def loss(z):
        return float(np.log1p(np.exp(-z)))

    known = unknown = both = 0.0
    for words, a, b in zip(rows, p, u, strict=True):
        g = w[-1] + sum(w[j] for j in words)
        known, both, unknown = known + a / sum(p) * loss(g), both + a / sum(p) * loss(-g), unknown + b / sum(u) * loss(-g)
    return prior * known + max(0.0, unknown - prior * both)


def test_weights_have_the_least_risk():
    """No nearby weights have a risk that is less by more than the shrinkage allows."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(3) < (0.7 if k % 4 == 0 else 0.2)).astype(np.int32) for k in range(200)]
    p, u = np.array([float(k % 8 == 0) for k in range(200)]), np.ones(200)
    w, bias = toxicity.minimise(rows, p, u, 3, 0.25, steps=2000)
    best = np.append(w, bias)
    least = plain_risk(best, rows, p, u, 0.25)
    for step in rng.normal(size=(200, 4)) * rng.choice([0.05, 0.3, 1.0], (200, 1)):
        assert plain_risk(best + step, rows, p, u, 0.25) > least - 1e-3


def test_repeated_rows_of_one_identifier_are_taken_once(spark, monkeypatch):
    """A third of the rows share an identifier: the sample stays bounded and the scores the same."""
    rows = [(i, ("bad words here " if i % 5 == 0 else "fine words there ") + f"n{i % 7}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int")
    seen = []
    plain = toxicity.minimise
    monkeypatch.setattr(toxicity, "minimise", lambda rows, *a, **k: seen.append(len(rows)) or plain(rows, *a, **k))
    once = spark.createDataFrame(rows, "doc_id long, text string")
    more = once.union(spark.range(3000).selectExpr("5L", "'bad words here n5'"))
    scores = [{r["doc_id"]: r["score"] for r in toxicity.score(d, labels).collect()} for d in (once, more)]
    assert seen[0] == seen[1] <= 300 and scores[0].keys() == scores[1].keys()
    assert max(scores[0][i] for i, t in rows if t.startswith("fine")) < min(scores[0][i] for i, t in rows if t.startswith("bad"))


def test_odd_texts(spark, odd, empty):
    labels = spark.createDataFrame([(3, 1), (4, None), (5, 0), (6, 1), (None, 1), (10, 1)], "doc_id long, toxic int")
    got = toxicity.score(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.0}
