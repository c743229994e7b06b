"""Rows without a doc_id have a place in the id files."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from pagelens.llm import idfiles, queries


def test_null_doc_ids_come_first_and_are_read_back(spark, tmp_path):
    big = (1 << 53) + 1  # no float holds it
    rows = [(7, "some words here"), (None, "nobody's text"), (big, "large id"), (None, None), (0, "zero"), (-3, "below"), (None, "nobody's text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(queries.op10_id_files(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, None, -3, 0, 7, big]
    tok = Tokenizer.from_file(queries.word_tokenizer())
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in got) == sorted((str(d), len(ids(t)), zlib.crc32(ids(t).tobytes())) for d, t in rows)
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_only_null_doc_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (None, "b")], "doc_id long, text string")
    _, entries = idfiles.write_ids(docs, queries.word_tokenizer(), 1, null_ids=True)
    assert [r.doc_id for r in idfiles.read_ids(spark, entries).collect()] == [None, None]
