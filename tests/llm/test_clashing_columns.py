"""Columns that bear the names the operators use pass through untouched, alone and in every stage of the pipeline."""

from pyspark.sql import functions as F

from pagelens.llm import mixing, quality

NAMES = ("score", "quality_score", "size", "source_size", "target", "part", "copies", "taken", "shards", "shuffle_key", "_gone", "_row", "_text", "_copy", "features", "node", "Size")


def with_clashes(docs):
    return docs.withColumns({n: F.concat(F.lit(n + "-"), F.col("doc_id").cast("string")) for n in NAMES[:-1]})


def untouched(rows):
    return all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in NAMES[:-1])


def test_every_stage(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    plain = spark.read.parquet(f"{sf}/documents.parquet")
    docs, bare = with_clashes(plain), plain
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, bare = stage(spark, docs, sf).cache(), stage(spark, bare, sf).cache()
        rows = docs.collect()
        assert docs.columns == with_clashes(plain).columns and untouched(rows) and len(rows) > 50, name
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in bare.collect())
    packed = corpus_pipeline.pack(spark, docs, sf)
    assert packed.count() == corpus_pipeline.pack(spark, bare, sf).count()


def test_mix_and_score(spark):
    docs = with_clashes(spark.createDataFrame([(i, "w " * (i % 5), "ab"[i % 2]) for i in range(40)] + [(None, None, None)], "doc_id long, text string, source string")).withColumn("score", F.lit("s"))
    mixed = mixing.mix(docs)
    names = mixing.added_names(docs.columns)
    assert names["size"] == "mix_size" and mixed.columns == [*docs.columns, *names.values()]
    rows = mixed.collect()
    assert len(rows) == 41 and all(r["mix_size"] == (r.doc_id or 0) % 5 and r["size"] == (None if r.doc_id is None else f"size-{r.doc_id}") for r in rows)
    assert mixing.mix(docs.limit(0)).columns == mixed.columns
    scored = quality.score(docs, quality.AdditiveModel(), docs.columns)
    assert scored.columns == [*docs.columns, "quality_quality_score"] and {r.score for r in scored.collect()} == {"s"}
