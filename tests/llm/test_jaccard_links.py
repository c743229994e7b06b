"""Every link of the n-gram join, against brute force."""

from itertools import combinations

from test_jaccard import brute, brute_set, corpus

from pagelens.llm import jaccard


def linked(x, y):
    common = len(x & y)
    return bool(x and y) and 100 * common >= 80 * (len(x) + len(y) - common)


def test_links_match_brute_force(spark):
    rows = corpus()
    sets = [brute_set(t) for _, t in rows]
    times = [0] * len(rows)
    for i, j in combinations(range(len(rows)), 2):
        if rows[i][0] is not None and rows[j][0] is not None and linked(sets[i], sets[j]):
            times[i] += 1
            times[j] += 1
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_links(frame).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in got), key=str) == sorted(((d, len(s), k) for (d, _), s, k in zip(rows, sets, times, strict=True)), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    different = {frozenset((frozenset(x), frozenset(y))) for (i, x), (j, y) in combinations(enumerate(sets), 2) if x != y and rows[i][0] is not None and rows[j][0] is not None and linked(x, y)}
    _, classes, pairs = jaccard.class_links(frame)
    assert pairs.count() == pairs.distinct().count() == len(different) and max(times) > 5
    assert jaccard.jaccard_links(frame.limit(0)).count() == 0
