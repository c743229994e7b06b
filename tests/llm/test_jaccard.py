import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from pagelens.llm import jaccard, shingles
from pagelens.llm.components import components


def brute_set(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
            continue
        common = len(sets[i] & sets[j])
        if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common) or rows[i][0] == rows[j][0]:
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), None if d is None else least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aBé \t\n\x0b\x1c\x85.", max_size=60), max_size=4))
def test_shingles_tell_texts_apart_as_words_do(texts):
    sets = shingles.shingle_sets([t.encode() for t in texts], 3)
    want = [brute_set(t, 3) for t in texts]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for (a, x), (b, y) in combinations(zip(sets, want, strict=True), 2):
        assert len(np.intersect1d(a, b)) == len(x & y)


def test_long_texts_are_hashed_in_segments(monkeypatch):
    text = (" ".join(f"word{i}" for i in range(3000)) + " " + "y" * 500).encode()
    whole = shingles.word_hashes(text)
    monkeypatch.setattr(shingles, "SEGMENT", 100)
    cut = shingles.word_hashes(text)
    assert np.array_equal(whole[0], cut[0]) and np.array_equal(whole[1], cut[1])


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    passage = [word() for _ in range(40)]
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n, " ".join(words)))
        n += 1

    for _ in range(6):  # groups of near copies, some in chains
        base = [word() for _ in range(rng.choice([30, 90, 200]))]
        for _ in range(rng.choice([2, 5, 12])):
            add(base)
            base = list(base)
            for _ in range(rng.choice([0, 1, 2, 4])):
                base[rng.randrange(len(base))] = word()
    for _ in range(25):  # a passage that many texts share
        add([*(word() for _ in range(rng.choice([5, 30]))), *passage, *(word() for _ in range(rng.choice([0, 3, 30])))])
    for _ in range(10):
        add(passage)
    for t in ("", "  \n", "a b", "A B", "a b c", "solo"):
        rows.append((n, t))
        n += 1
    rows += [(n, None), (None, "a b"), (None, None), (3, rows[0][1])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_components_match_brute_force(spark, rows):
    got = jaccard.jaccard_components(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, component_id string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_leaders_only_save_work(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "LEADER_ROUNDS", 1)
    some = [r for r in rows if r[0] is not None]
    got = jaccard.jaccard_components(spark.createDataFrame(some, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(some)


def test_one_of_each(spark):
    texts = ["one two three four five six", "One  two three four five six", "other words are in this one", "", None, ""]
    frame = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    assert sorted(r.doc_id for r in jaccard.one_of_each(frame).collect()) == [0, 2, 3, 4, 5]
    assert jaccard.one_of_each(frame).columns == frame.columns
    assert jaccard.jaccard_components(frame.limit(0)).count() == 0


def test_links_is_exact():
    x = np.arange(0, 100, dtype=np.uint64)
    assert jaccard.links(x, np.arange(10, 100, dtype=np.uint64), 80) and jaccard.links(x, x[:80], 80) and not jaccard.links(x, x[:79], 80)


def test_components(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, 900), (900, 5), (7, 7), (2, 3), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and got[5] == got[900] == got[1] == 1 and got[3] == 2 and 7 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_posting_of_one_label_gives_no_pairs_of_its_own(spark):
    """20,000 classes of one label and one other class in a posting: a pair for each of them, not for each two."""
    own = spark.range(20_000).selectExpr("7L AS token", "id AS node", "10 AS n", "10L AS shared", "0 AS position", "0L AS label", "1.0D AS weight")
    other = spark.range(1).selectExpr("7L AS token", "50000L AS node", "10 AS n", "10L AS shared", "0 AS position", "50000L AS label", "1.0D AS weight")
    pairs = jaccard.posting_pairs(own.union(other), 80)
    assert pairs.count() == 20_000 and pairs.filter("b = 50000").count() == 20_000
    few = spark.createDataFrame([(1, 1, 1), (2, 1, 1), (3, 2, 1), (4, 3, 1), (5, 3, 1)], "node long, label long, token long").selectExpr("token", "node", "10 AS n", "10L AS shared", "0 AS position", "label", "1.0D AS weight")
    want = {(a, b) for a in range(1, 6) for b in range(a + 1, 6)} - {(1, 2), (4, 5)}
    assert {(r.a, r.b) for r in jaccard.posting_pairs(few, 80).collect()} == want


def test_a_class_of_many_pairs_is_cut(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CLASS_PAIRS", 3)
    sets = spark.createDataFrame([(i, bytes([i])) for i in range(30)], "node long, tokens binary")
    pairs = spark.createDataFrame([(i, 29) for i in range(29)] + [(0, i) for i in range(1, 29)], "a long, b long")
    got = jaccard._beside(pairs, sets, [F.col("tokens")]).collect()
    assert sorted((r.a, r.b) for r in got) == sorted((r.a, r.b) for r in pairs.collect()) and all(bytes(r["_x0"]) == bytes([r.a]) and bytes(r["_y0"]) == bytes([r.b]) for r in got)
