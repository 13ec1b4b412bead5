"""Embedding links and the toxicity classifier on small fixtures."""

import random
import zlib

import numpy as np
import pytest

from logvigil.llm import embeddings, toxicity


@pytest.mark.parametrize("tile", [embeddings.TILE, 40])
def test_links(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(12, 24))
    vectors = [list(map(float, c + rnd.normal(scale=s, size=24))) for c in centres for s in (0.05, 0.15, 0.2, 0.25) * 4]
    vectors += [vectors[0]] * 5 + [None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [1e200] * 24, [2e-200] * 24, [-0.0] * 23 + [1.0]]
    rows = [(7 * i % 1009, v, 1) for i, v in enumerate(vectors)] + [(None, vectors[0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 AS rep", "2 AS n", "3 AS name", "4 AS root")
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    good = {i: np.array(v) / max(np.abs(v)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = {i: {j for j in good if i != j and good[i] @ good[j] / np.sqrt((good[i] @ good[i]) * (good[j] @ good[j])) >= 0.95} for i in good}
    for i, _, _ in rows[:-1]:
        reach, todo = {i}, [i]
        while todo:
            new = links.get(todo.pop(), set()) - reach
            reach |= new
            todo += new
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, ())), min(reach), i == min(reach))
    assert got[None].n_links == 0 and got[None].kept
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_error_bound():
    rnd = np.random.default_rng(6)
    a, b = rnd.normal(size=(500, 64)) ** 3, rnd.normal(size=(500, 64))
    (p, s, e), (q, t, f) = embeddings.quantised(a), embeddings.quantised(b)
    exact = embeddings.cosine(a, b)
    assert (np.abs(exact - s * t * (p.astype(float) * q).sum(1)) <= e + f * (1 + e)).all()


def test_scores_equal_a_dense_forward_pass():
    rnd = np.random.default_rng(11)
    words = [f"word{i}" for i in range(40)] + ["vile", "the", "der", "Ünder"]
    texts = [" ".join(rnd.choice(words, rnd.integers(0, 90))) for _ in range(150)]
    net = toxicity.fit([(toxicity.slots(t.encode()), int("vile" in t)) for t in texts])
    toxicity.calibrate(net, [(toxicity.slots(t.encode()), int("vile" in t)) for t in texts])

    def dense(text):
        """Every position of every filter, one after the other."""
        hashes = toxicity.slots(text.encode()).tolist()
        known = net.keys.tolist()
        rows = [known.index(h) + 1 if h in known else 0 for h in hashes]
        pooled = []
        for width in toxicity.WIDTHS:
            padded = [net.table[r] for r in rows] + [np.zeros(toxicity.DIM)] * max(0, width - len(rows))
            for f in range(toxicity.FILTERS):
                pooled.append(max(float(np.concatenate(padded[i:i + width]) @ net.filters[width][:, f]) for i in range(len(padded) - width + 1)))
        z = float(np.maximum(np.array(pooled) + net.bias, 0) @ net.out + net.out_bias)
        hits = net.tongues[rows].sum(0) if rows else np.zeros(1)
        middle, scale = net.thresholds[list(toxicity.TONGUES)[int(hits.argmax())] if hits.max() else "none"]
        return 1 / (1 + np.exp(-np.clip(4 * (z - middle) / scale, -30, 30)))

    for text in [*texts[:40], "", "unknown", "vile " * 50]:
        assert abs(toxicity.score(net, text.encode()) - dense(text)) < 1e-4
    words = toxicity.indexed(net, toxicity.slots(" ".join(texts).encode()))
    assert all(abs(toxicity.logit(net, words, block) - toxicity.logit(net, words)) < 1e-4 for block in (1, 2, 7, 100))


def test_toxicity(spark, make):
    rnd = random.Random(7)
    words = [f"word{i}" for i in range(300)]
    toxic = ["vile", "rotten", "scoundrel"]

    def text(bad):
        out = [rnd.choice(words) for _ in range(rnd.randrange(20, 120))]
        for _ in range(3 * bad):
            out.insert(rnd.randrange(len(out)), rnd.choice(toxic))
        return " ".join(out)

    marks = [int(rnd.random() < 0.3) for _ in range(600)]
    docs = make([text(m) for m in marks] + [None, "", "x " * 30_000 + "vile rotten vile", (None, "vile rotten", None), (5, "vile rotten", "s")])
    labels = spark.createDataFrame([(i, 1, m) for i, m in enumerate(marks)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == 605
    by = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 5}
    for i, r in by.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [i for i in range(600) if i in by and by[i].held_out]
    assert sum(by[i].predicted == marks[i] for i in held) >= 0.97 * len(held)
    assert by[600].score == by[601].score and by[602].predicted == 1
    # Labels of held-out ids change nothing.
    flipped = spark.createDataFrame([(i, 1, 1 - m if zlib.crc32(str(i).encode()) % 5 == 0 else m) for i, m in enumerate(marks)], labels.schema)
    again = {r.doc_id: r.score for r in toxicity.classify(docs, flipped).collect()}
    assert all(again[i] == r.score for i, r in by.items())
    assert toxicity.classify(make([]), labels.limit(0)).count() == 0
