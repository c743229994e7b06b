import tracemalloc

from pagelens.llm import mixing, scratch, shingles


def test_hash_tables_go_with_the_task():
    """A worker that hashed slices of several sizes keeps no tables; while it hashes, one pair of 8 MB each at most."""

    @scratch.tidy
    def run(batches):
        for n in batches:
            yield sum(map(len, shingles.shingle_sets([b"ab cde fgh ij " * (n // 14)] * 2, 5)))

    list(run(iter([100])))
    tracemalloc.start()
    held = []
    for _ in run(iter([40_000, 100_000, 200_000, 400_000, 1_000_000])):
        held.append(tracemalloc.get_traced_memory()[0])
    after = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert max(held) < 18_000_000 and after < 500_000


def test_a_long_word_has_the_hash_of_its_bytes():
    word, rest = b"x" * 2_500_000, b" aa bb " * 10
    _, whole = shingles.word_hashes(rest + word + rest)
    shingles.forget()
    assert shingles.word_hashes(word)[1][0] == whole[20] and shingles.word_hashes(rest)[1].tolist() == whole[:20].tolist()


def test_the_plan_of_a_mix_needs_no_python_worker(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert "ExistingRDD" not in mixing.mix(docs)._jdf.queryExecution().toString()


def test_small_table(spark):
    schema = "a boolean, b string, c int, d array<int>, e long, f double"
    rows = [(False, "é", 1, [1, 2], None, 0.5), (True, "", -2, [], 1 << 40, 2.0), (None, None, None, None, None, None)]
    got = scratch.small_table(spark, rows, schema)
    want = spark.createDataFrame(rows, schema)
    assert got.schema == want.schema and [tuple(r) for r in got.collect()] == rows
    assert scratch.small_table(spark, [], schema).schema == want.schema and not scratch.small_table(spark, [], schema).count()
