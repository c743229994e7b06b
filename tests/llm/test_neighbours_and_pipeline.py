import numpy as np
import pytest

from pagelens.llm import neighbours


def brute(rows, k):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    out = {}
    for i, v in rows:
        if i % 100 == 0:
            d = np.sqrt(((x - np.array(v, float)) ** 2).sum(axis=1))
            out[i] = [(ids[j], d[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def test_transform_is_orthonormal():
    for n in (1, 8, 64, 256):
        h = neighbours.hadamard(np.eye(n))
        assert np.allclose(h @ h.T, np.eye(n)) and np.allclose(h, [[(-1) ** (i & j).bit_count() / n**0.5 for j in range(n)] for i in range(n)])


def test_few_rows_are_reranked_on_isotropic_vectors():
    x = np.random.default_rng(3).normal(size=(9000, 64))
    index = neighbours.CrossPolytope(64)
    least, _ = neighbours.choose_votes(x[: neighbours.SAMPLE_ROWS], index, 10, neighbours.TARGET_RECALL)
    block, hits, share = neighbours.Block(np.arange(len(x)), x, index), 0, 0.0
    for q, probes in zip(x[-100:], neighbours.probes_of(x[-100:], index), strict=True):
        want = np.argsort(neighbours.distances(x, q), kind="stable")[:11]
        hits += len(np.intersect1d(want, block.nearest(q, probes, least, 10)[0]))
        share += len(block.candidates(probes, least, 10)) / len(x) / 100
    assert hits >= 0.9 * 1100 and share < 0.25


def test_votes_count_the_tables_that_name_a_row():
    x = np.random.default_rng(4).normal(size=(200, 12))
    index = neighbours.CrossPolytope(12, 5)
    block, probes = neighbours.Block(np.arange(200), x, index), neighbours.probes_of(x[:7], index)
    codes = np.array([index.codes(x, t) for t in range(5)])
    for p in probes:
        assert block.votes(p).tolist() == sum(np.isin(codes[t], p[t]).astype(int) for t in range(5)).tolist()


def test_repeated_ids_count_once(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.1, 0.9]), (2, [0.0, 1.0]), (0, [1.0, 0.0])]
    for order in (rows, rows[::-1]):
        got = search(spark, order)
        assert set(got) == {0} and [(r, v) for r, v, _ in got[0]] == [(1, 1), (2, 2)] and got[0][0][2] == pytest.approx(np.hypot(0.9, 0.9), abs=1e-6)


def test_probes_begin_with_the_own_bucket():
    x = np.random.default_rng(0).normal(size=(50, 10))
    for hashes in (1, 2):
        index = neighbours.CrossPolytope(10, 2, hashes)
        assert np.array_equal(index.probes(x, 1, 5)[:, 0], index.codes(x, 1)) and index.codes(x, 0).max() < 32**hashes
        assert np.array_equal(index.codes(x * 7, 0), index.codes(x, 0))


def search(spark, rows, **more):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = {}
    for r in neighbours.search(frame, F.col("vec_id") % 100 == 0, k=10, **more).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in got.items()}


def test_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(3000)]
    got, want = search(spark, rows), brute(rows, 10)
    found = sum(len({v for _, v, _ in got[q]} & {v for v, _ in w}) for q, w in want.items())
    assert set(got) == set(want) and found >= 0.9 * 10 * len(want)
    for q, found in got.items():
        assert [r for r, _, _ in found] == list(range(1, 11)) and [s for _, _, s in found] == sorted(s for _, _, s in found)
        assert all(s == pytest.approx(float(np.linalg.norm(x[q].astype(float) - x[v].astype(float))), abs=1e-12) for _, v, s in found)


def test_hot_and_odd_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 400)] + [(500 + i, [1.0, 2.0, 3.0 + i]) for i in range(1, 6)]
    odd = [(1000, None), (1100, [0.0, 0.0, 0.0]), (1200, [1.0, None, 2.0]), (1300, [float("nan"), 1.0, 1.0]), (1400, [float("inf"), 1.0, 1.0]), (1500, [1.0])]
    got = search(spark, rows + odd, block_rows=3)
    assert set(got) == {0, 100, 200, 300}
    for q, found in got.items():
        assert [v for _, v, _ in found] == [v for v in range(12) if v != q][:10] and all(s == 0 for _, _, s in found)


def test_few_and_no_candidates(spark):
    got = search(spark, [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, [-1.0, 0.5])], target=1.0)
    assert [v for _, v, _ in got[0]] == [1, 2]
    assert search(spark, [(1, [1.0, 0.0])]) == {} and search(spark, [(0, None)]) == {}


def test_pipeline(spark, tmp_path):
    """The stages in turn against brute force on what each was given."""
    import zlib

    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.quality_filter(spark, docs, sf).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and np.mean([(d in ids) == bool(q) for d, q in labels.items()]) > 0.9
    single = corpus_pipeline.near_copies(spark, kept, sf).cache()
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} <= ids
    texts = [r.text for r in single.collect()]
    assert len({" ".join(t.lower().split()) for t in texts}) == len(texts)
    mixed = corpus_pipeline.source_mix(spark, single, sf).cache()
    words = sum(len(t.split()) for t in texts)
    assert mixed.columns == docs.columns and abs(sum(len(r.text.split()) for r in mixed.collect()) - 1.5 * words) < 0.02 * words
    packed = corpus_pipeline.pack(spark, mixed, sf).collect()
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    want = sorted((r.doc_id, k, zlib.crc32(np.array(x[k * 2048 : (k + 1) * 2048], "<u4").tobytes())) for r in mixed.collect() for x in [[*encode(r.text, add_special_tokens=False).ids, 0]] for k in range(-(-len(x) // 2048)))
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed) == want
    assert corpus_pipeline.run(spark, sf).count() == len(packed)
