import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagelens.llm import mixing, quality


def test_model_learns_shapes_and_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 5))
    y = ((np.abs(x[:, 0]) < 0.7) ^ (x[:, 1] > 0)) & (x[:, 2] * x[:, 3] < 1)
    model = quality.fit(x[:3000], y[:3000].astype(float))
    single = quality.fit(x[:3000], y[:3000].astype(float), pairs=0)
    hit = lambda m: ((m.score(x[3000:]) >= 0.5) == y[3000:]).mean()
    assert hit(model) > 0.8 and hit(model) > hit(single) + 0.1
    assert len(model.single) == 5 and {(0, 1)} <= {(i, j) for i, j, _ in model.pairs}


def test_trees_and_scores_match_plain_ones():
    rng = np.random.default_rng(8)
    for _ in range(20):
        grad, weight = rng.normal(size=7), rng.random(7) + 0.1
        ridge = 2.0
        gain = lambda a, b: grad[a:b].sum() ** 2 / (weight[a:b].sum() + ridge)  # noqa: E731, B023
        cut = max(range(1, 7), key=lambda c: gain(0, c) + gain(c, 7))  # noqa: B023
        leaf = lambda a, b: grad[a:b].sum() / (weight[a:b].sum() + ridge)  # noqa: E731, B023
        want = [leaf(0, 7)] * 7 if gain(0, cut) + gain(cut, 7) - gain(0, 7) <= 1e-9 else [leaf(0, cut)] * cut + [leaf(cut, 7)] * (7 - cut)
        assert np.allclose(quality._tree(grad, weight, 2, ridge), want)
        g, w = rng.normal(size=(4, 5)), rng.random((4, 5)) + 0.1
        parts = lambda i, j: [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, 5)), (slice(i, 4), slice(0, j)), (slice(i, 4), slice(j, 5))]
        value = lambda i, j: sum(g[p].sum() ** 2 / (w[p].sum() + ridge) for p in parts(i, j))  # noqa: E731, B023
        i, j = max(((i, j) for i in range(1, 4) for j in range(1, 5)), key=lambda ij: value(*ij))  # noqa: B023
        got, table = quality._quadrants(g, w, ridge)
        assert got == pytest.approx(value(i, j)) and all(np.allclose(table[p], g[p].sum() / (w[p].sum() + ridge)) for p in parts(i, j))
    x = rng.normal(size=(300, 3))
    model = quality.fit(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float), rounds=10, pairs=2)
    for row, score in zip(x[:50], model.score(x[:50]), strict=True):
        bins = [sum(e <= v for e in edges) for v, edges in zip(row, model.edges, strict=True)]
        total = model.base + sum(t[b] for t, b in zip(model.single, bins, strict=True)) + sum(t[bins[i], bins[j]] for i, j, t in model.pairs)
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_models_without_a_choice():
    assert quality.fit(np.zeros((0, 18)), np.zeros(0)).score(np.zeros((2, 18))).tolist() == [0.5, 0.5]
    assert (quality.fit(np.zeros((3, 18)), np.ones(3)).score(np.zeros((2, 18))) > 0.9).all()


def test_features_of_odd_texts():
    for t in (b"", b" \n", "é".encode(), b"x" * 100_000, b"a a a\n\na a a"):
        f = quality.text_features(t)
        assert len(f) == len(quality.NAMES) and np.isfinite(f).all()


@pytest.fixture(scope="module")
def held_out_accuracy(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 7))) for _ in range(rng.randrange(3, 60))]
        good = rng.random() < 0.7
        rows.append((i, " ".join(words).capitalize() + "." if good else "*** ".join(words).upper(), int(good)))
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows] + [(1000, None, None, None), (1001, "", 1.0, None), (5, rows[5][1], 0.1, "again")], "doc_id long, text string, score double, features string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (7, rows[7][2]), (5000, 1)], "doc_id long, quality int")
    return docs, labels, {i: y for i, _, y in rows}


def test_held_out_accuracy(spark, held_out_accuracy):
    docs, labels, truth = held_out_accuracy
    model = quality.learn(docs, labels)
    got = quality.score(docs, model, ["doc_id"]).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    import zlib

    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    test = [(r.score >= 0.5) == truth[r.doc_id] for r in got if r.held and r.doc_id in truth]
    assert len(test) > 100 and np.mean(test) > 0.95
    again = {r.doc_id: r.score for r in quality.score(docs, quality.learn(docs, labels), ["doc_id"]).collect()}
    assert all(again[r.doc_id] == r.score for r in got)
    kept = quality.score(docs, model, docs.columns[:2])
    assert kept.columns == ["doc_id", "text", "score"] and quality.score(docs.limit(0), model, ["doc_id"]).count() == 0
    assert quality.learn(docs, labels.limit(0)).single == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1000), max_size=12))
def test_targets(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    got = mixing.targets(sizes, weights, 1.5 * sum(sizes), 2.0)
    assert sum(got) == pytest.approx(1.5 * sum(sizes)) and all(0 <= g <= 2 * s + 1e-6 for g, s in zip(got, sizes, strict=True))
    level = [g / w for g, w, s in zip(got, weights, sizes, strict=True) if s and g < 2 * s - 1e-6]
    assert not level or max(level) == pytest.approx(min(level))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=6), st.integers(1, 9))
def test_quotas(blocks, shards):
    got = mixing.shard_quotas(np.array(blocks), shards, np.random.default_rng(0))
    assert (got >= 0).all() and got.sum(axis=0).tolist() == blocks
    rows = got.sum(axis=1)
    assert rows.max() - rows.min() <= max(1, shards.bit_length())


def sized(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_mix(spark):
    rng = random.Random(2)
    names = ["b", "a", None, "é", "Z", "hot"]
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 40))), rng.choice(names) if i % 3 else "hot", 1, "x") for i in range(400)]
    rows += [(500, None, "a", 1, "x"), (501, "long " * 5000, "b", 1, "x"), (502, "same text", "a", 1, "x"), (502, "same text", "a", 1, "x"), (503, "", "empty", 1, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, taken string")
    plain = frame.select("doc_id", "text", "source")
    got = mixing.mix(plain, shards=5).collect()
    assert len(got) == len(rows) and all(r["size"] == sized(r.text) and 0 <= r.taken <= 2 * r["size"] for r in got)
    order = sorted({r.source for r in got}, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in got if r.source == s) for s in order]
    want = dict(zip(order, mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes), 2.0), strict=True))
    for s, n in zip(order, sizes, strict=True):
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {n} and own[0].target == pytest.approx(want[s]) and abs(sum(r.taken for r in own) - want[s]) <= 2
    assert all(len(r.shards) == r.copies + (r.part > 0) and set(r.shards) <= set(range(5)) for r in got if r["size"])
    again = mixing.mix(plain.repartition(3), shards=5).collect()
    assert sorted((r.doc_id, r.taken, r.shards) for r in again) == sorted((r.doc_id, r.taken, r.shards) for r in got)
    made = mixing.materialise(mixing.mix(plain, shards=5), plain.columns)
    assert made.columns == plain.columns and made.agg(F.sum(mixing.words(F.col("text")))).first()[0] == sum(r.taken for r in got)
    assert mixing.mix(plain.limit(0)).count() == 0


def test_mix_without_words(spark):
    rows = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(rows).collect()] == [0, 0]
