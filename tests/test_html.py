from pagelens.functions import html as H


def visible(page):
    return H.text_of(H.sanitize(H.parse(page)))


def test_hidden_elements_go():
    page = """<style>.gone{display:none} #x > b{visibility:hidden} @media print{.kept{display:none}} p:hover{display:none}</style>
    <p class="gone">a</p><div id="x"><b>b</b><i>kept1</i></div><p class="kept">kept2</p><p hidden>c</p><p style="opacity: 0">d</p><p style="opacity:0.5">kept3</p>
    <p style="font-size:0px">e</p><p style="position:absolute;left:-9999px">f</p><p style="text-indent:-999px">g</p><script>h</script><noscript>i</noscript><!-- j --><p>k​ept4</p>"""
    assert visible(page) == "kept1 kept2 kept3 kept4"


def test_zones_order_text_and_links():
    page = "<header>555-0000</header><nav><a href='/n'>N</a></nav><main>555-1234 <a href='/m'>M</a></main><p><a href='/p'>P</a></p><footer>Copyright</footer>"
    title, text, links = H.read_page(page, "https://e.com/")
    assert text.startswith("555-1234 M") and text.endswith("Copyright") and title == ""
    assert [x["url"] for x in H.rank_by_zone(links)] == ["https://e.com/m", "https://e.com/p", "https://e.com/n"]


def test_links_from_everywhere():
    page = '<a href=" /a ">A  <b>b</b></a><a href="mailto:x">no</a><iframe src="/f.pdf" title="T"></iframe><object data="/o.pdf"></object><embed src="/e.pdf"><a href="/v?d=https://c.com/x.pdf">V</a><a href="/a#2">again</a>'
    links = H.links_of(H.parse(page), "https://e.com/")
    assert [(x["text"], x["url"]) for x in links] == [
        ("A b", "https://e.com/a"), ("V", "https://e.com/v?d=https://c.com/x.pdf"), ("again", "https://e.com/a#2"), ("T", "https://e.com/f.pdf"), ("[embedded document]", "https://e.com/o.pdf"),
        ("[embedded document]", "https://e.com/e.pdf"), ("V", "https://c.com/x.pdf"),
    ]
    assert len(H.rank_by_zone(links)) == 6


def test_titles_and_caps():
    assert H.read_page("<title> A &amp;\tB </title><p>" + "x " * 20000, "https://e.com/")[0] == "A & B"
    assert len(visible("<p>" + "x " * 20000)) == H.MAX_TEXT
    assert H.read_page(None, "https://e.com/") == ("", "", [])


def test_deep_nesting_and_broken_markup():
    assert visible("<div>" * 5000 + "deep") == "deep"
    assert visible("<p>a<b>b<p>c</b></i>d") == "a b c d"


def test_round_trip_of_sanitised_html():
    out = H.to_html(H.sanitize(H.parse('<p class="a">x &lt; y<br><script>z</script><meta content="evil" name="n"></p>')))
    assert out == '<p class="a">x &lt; y<br><meta name="n"></p>'
    assert H.to_html(H.parse(out)) == out


def test_selectors():
    root = H.parse('<div class="a b" id="i" data-x="foo bar"><p><span>s</span></p></div>')
    count = lambda s: len(H.select(root, s))
    assert [count(s) for s in ("div.a.b", "#i span", "div > span", "p > span", "[data-x]", "[data-x~=bar]", "[data-x^=foo]", "*", "div:hover", "p,", "")] == [1, 1, 0, 1, 1, 1, 1, 3, 0, 0, 0]
