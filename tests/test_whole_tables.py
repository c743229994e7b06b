"""Queries keep every row of their table, those with no counterpart in the other engine included."""

import pytest

from pagelens.functions import text
from pagelens.operators import verify
from pagelens.plans import registry

SF = "/root/testdata/sf0.001"


def test_stale_documents_keep_every_order(spark):
    got = registry.QUERIES["stale_documents"](spark, SF)
    orders = registry.table(spark, SF, "orders")
    old = orders.filter("year(o_orderdate) < 2000").select("o_orderkey")
    assert got.count() == orders.count() and old.count() > 0
    assert {(r.document_age, r.is_stale) for r in got.join(old, "o_orderkey").collect()} == {(None, False)}


def test_verify_bm25_scores_every_document(spark):
    docs = {r.doc_id: r for r in registry.table(spark, SF, "documents").collect()}
    got = {r.page_id: r.score for r in registry.QUERIES["verify_bm25"](spark, SF).collect()}
    assert got.keys() == docs.keys() and any(got[i] > 0 and r.lang != "en" for i, r in docs.items())
    for i, r in docs.items():
        assert got[i] == pytest.approx(verify.bm25(r.text or "", ["the eran"]), abs=2e-6)


def test_bm25_of_chunks_that_sql_cannot_cut(spark):
    texts = ["the eran", "short\nthe", "ＴＨＥ eran " * 9 + "\n\n" + "Straße the " * 9, "", None, "\u00a0"]
    frame = spark.createDataFrame(list(enumerate(texts)), "page_id long, text string")
    got = {r.page_id: r.score for r in verify.bm25_table(verify.text_chunks(frame), ["the eran", "STRASSE"]).collect()}
    assert got == {i: pytest.approx(verify.bm25(texts[i], ["the eran", "STRASSE"])) for i in range(3)}


def test_text_queries_keep_every_text(spark):
    for name, source, key, out, plain in (("text_normal_form", "benchmark", "item_id", "normal", text.normal_form), ("text_without_unseen", "documents", "doc_id", "clean", text.strip_unseen)):
        rows = {r[key]: r.text for r in registry.table(spark, SF, source).collect()}
        got = {r[key]: r[out] for r in registry.QUERIES[name](spark, SF).collect()}
        assert not all(t.isascii() for t in rows.values())
        assert got == {k: plain(t) for k, t in rows.items()}


def test_texts_that_sql_cannot_fold(spark, tmp_path):
    odd = ["ＣＥＯ Straße", "so\u00adft ze\u200bro \u2060\ufeffmark", "C1 \x85\x9fend \x7f", "ﬁne\u00a0print\u2003İ", "plain\tASCII\r\n", "", None]
    frame = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    frame.withColumnRenamed("doc_id", "item_id").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, key, out, plain in (("text_normal_form", "item_id", "normal", text.normal_form), ("text_without_unseen", "doc_id", "clean", text.strip_unseen)):
        got = {r[key]: r[out] for r in registry.QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {i: None if t is None else plain(t) for i, t in enumerate(odd)}


def test_titles_that_end_within_a_reference(spark, tmp_path):
    want = {"a&amp;&amp": "a&&", "a &am": "a &am", "a&": "a&", "a &lt": "a <", "x&quot": 'x"', "x&amp;lt": "x&lt", "plain": "plain"}
    spark.createDataFrame([(i, "https://e.com/", f"<html><head><title>{t}</title></head><body>b</body></html>") for i, t in enumerate(want)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.title for r in registry.QUERIES["page_title"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))
