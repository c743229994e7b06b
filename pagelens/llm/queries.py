"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, htmltext, idfiles, jaccard, mixing, neighbours, packing, quality, unigram, warc


def word_tokenizer() -> str:
    """Path of the word tokenizer, as the installed vocabulary package gives it."""
    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, ["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), word_tokenizer(), 0, 2048)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=5, percent=80)


def op5_ngram_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of op5 with every link verified and counted."""
    return jaccard.jaccard_links(table(spark, sf_dir, "documents").select("doc_id", "text"), width=5, percent=80)


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, k=10)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "part", "shards")


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(spark, table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = audio.AudioSettings()
    media = audio.store(table(spark, sf_dir, "documents").select("doc_id", "text"), 576, settings)
    described = audio.describe(media, settings)
    number = lambda x: F.round(x, 2).cast("string")
    active = F.aggregate("segments", F.lit(0.0), lambda t, s: t + s["end_s"] - s["start_s"])
    feature = F.concat_ws("|", F.col("frames").cast("string"), F.size("segments").cast("string"), number(active), F.concat_ws(",", F.transform("mean_mel", number)))
    return described.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op10_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, entries = idfiles.write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), word_tokenizer(), 1, null_ids=True)
    return idfiles.read_ids(spark, entries, digest=True).select("doc_id", "start", F.col("n_tokens"), "ids_crc32")


def token_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that SQL can count."""
    return op3_token_counts(spark, sf_dir).select("doc_id", "n_words")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7 that no seed decides."""
    return op7_source_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9 that SQL can hash."""
    return op9_audio_features(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_token_counts": op3_token_counts,
    "op4_html_extraction": op4_html_extraction,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op5_ngram_jaccard_links": op5_ngram_jaccard_links,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_source_mixing": op7_source_mixing,
    "op8_warc_index": op8_warc_index,
    "op9_audio_features": op9_audio_features,
    "op10_id_files": op10_id_files,
    "token_words": token_words,
    "mix_targets": mix_targets,
    "media_payloads": media_payloads,
}

_SHINGLES = r"""
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
x AS (SELECT doc_id, g FROM s JOIN (SELECT g FROM s GROUP BY g HAVING count(*) > 1) USING (g)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
"""

#: Where an operator's results follow from no model, search or seed.
ORACLE_SQL: dict[str, str] = {
    "op5_ngram_jaccard_join": f"WITH RECURSIVE {_SHINGLES} SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id",
    "op5_ngram_jaccard_links": f"""
WITH RECURSIVE {_SHINGLES},
k AS (SELECT a AS doc_id, count(*) AS k FROM e GROUP BY 1)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(any_value(k.k), 0) AS n_links, min(r.c) AS component_id FROM r LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) GROUP BY doc_id
""",
    "op8_warc_index": """
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f
""",
    "token_words": r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_words FROM documents",
    # targets: of sources in order of size to weight, those before the first that the rest of the budget does not fill are full
    "mix_targets": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (SELECT source, n, [5, 2, 1][1 + (k % 3)::INT] AS w FROM s),
o AS (SELECT *, 2.0 * n / w AS r, 1.5 * (SELECT sum(size) FROM d) - coalesce(sum(2 * n) OVER (ORDER BY 2.0 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(w) OVER (ORDER BY 2.0 * n / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM w WHERE n > 0),
m AS (SELECT (SELECT rest / open FROM o WHERE rest / open <= r ORDER BY r, source LIMIT 1) AS level)
SELECT doc_id, size, n::BIGINT AS source_size, round(CASE WHEN level IS NULL THEN 2.0 * n ELSE least(2.0 * n, level * w) END, 3)::DOUBLE AS target
FROM d JOIN w ON w.source IS NOT DISTINCT FROM d.source, m
""",
    "media_payloads": r"""
WITH b AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), p AS (SELECT doc_id, octet_length(b) AS n, b, greatest(1, (octet_length(b) + 575) // 576) * 576 AS size FROM b)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(b || from_hex(repeat('FF', (size - n)::INT))) AS payload_sha256 FROM p
""",
}
