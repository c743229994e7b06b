import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelens.functions import urls


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTPS://Example.COM/page", "https://example.com/page"),
        ("http://example.com:80/", "http://example.com/"),
        ("https://example.com:8443/", "https://example.com:8443/"),
        ("http://example.com/a/b/c/../../d", "http://example.com/a/d"),
        ("http://example.com//leading", "http://example.com/leading"),
        ("http://example.com", "http://example.com/"),
        ("http://example.com/?b=2&a=1&b=3&a=4", "http://example.com/?a=1&a=4&b=2&b=3"),
        ("http://example.com/page?", "http://example.com/page"),
        ("http://example.com/page/", "http://example.com/page"),
        ("http://example.com/%41%2F%7e#x", "http://example.com/A%2F~"),
        ("http://User:Pw@Example.com/", "http://User:Pw@example.com/"),
        ("http://[2001:DB8::1]:8080/x", "http://[2001:db8::1]:8080/x"),
        ("http://example.com/..", "http://example.com/"),
        ("http://example.com/?q=a b", "http://example.com/?q=a%20b"),
        ("", None),
        ("/relative", None),
        ("http://example.com:99999/", None),
    ],
)
def test_normalize(url, want):
    assert urls.normalize(url) == want


def test_normalize_resolves_against_the_page():
    assert urls.normalize("../x", "http://example.com/a/b/c") == "http://example.com/a/x"


@settings(max_examples=200, deadline=None)
@given(st.from_regex(r"https?://[a-z]{1,8}\.com(/[a-z.%0-9A-F]{0,6}){0,4}(\?[a-z]=[a-z0-9]{0,3}(&[a-z]=[0-9]{0,2}){0,3})?(#[a-z]*)?", fullmatch=True))
def test_normal_form_is_stable(url):
    once = urls.normalize(url)
    assert once is None or urls.normalize(once) == once


@pytest.mark.parametrize(
    "url", ["file:///etc/passwd", "http://localhost./", "http://127.0.0.1/", "http://2130706433/", "http://0x7f000001/", "http://0177.0.0.1/", "http://127.1/", "http://10.0.0.8/", "http://[::1]/", "http://169.254.169.254/", "http://metadata.google.internal/", "http://100.64.0.1/"]
)
def test_unsafe(url):
    assert urls.unsafe_reason(url)


def test_safe():
    assert urls.unsafe_reason("https://example.com/") is None
    assert urls.unsafe_reason("http://8.8.8.8/") is None


def test_domains_and_documents():
    assert urls.in_domains("a.b.example.com", {"example.com"}) and not urls.in_domains("badexample.com", {"example.com"})
    assert urls.start_domain("https://www.Example.com/x") == "example.com"
    assert urls.is_document("https://e.com/a.PDF?x=1") and not urls.is_document("https://e.com/a.pdf/b") and not urls.is_document("https://e.com/pdf")
    assert urls.nested_documents("https://e.com/v?doc=https%3A%2F%2Fc.com%2Fa.pdf&x=1") == ["https://c.com/a.pdf"]
    assert urls.resolve("mailto:x@y.z", "https://e.com/") is None


def test_columns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("https://U:p@Www.Example.com:80/a/Service-names.pdf?x#y", 'attachment; filename="b c.pdf"'), (None, None), ("nonsense", "")], "url string, cd string")
    got = rows.select(urls.host_expr(F.col("url")).alias("h"), urls.is_document_expr(F.col("url")).alias("d"), urls.path_tokens(F.col("url")).alias("t"), urls.filename_expr(F.col("cd"), F.col("url")).alias("f"), urls.is_web_url(F.col("url")).alias("w"), urls.normalize_udf(F.col("url")).alias("n")).collect()
    assert got[0].h == "www.example.com" and got[0].d and got[0].t == ["service", "names", "name"] and got[0].f == "b c.pdf" and got[0].w
    assert got[1].n is None and got[2].w is False and got[2].f is None
