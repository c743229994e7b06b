import hashlib
import html as entities
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagelens.llm import audio, htmltext, warc


# audio


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 2), (2, 3), (5, 8), (1, 1)])
def test_resampling_matches_direct_convolution(up, down):
    s = audio.AudioSettings(up=up, down=down)
    x = np.random.default_rng(0).normal(size=3001)
    got = np.concatenate(list(audio.resample(iter(np.split(x, [10, 500, 2000, 2001])), s)))
    centre = s.half_taps * max(up, down)
    t = np.arange(2 * centre + 1) - centre
    taps = np.sinc(t / max(up, down)) * np.blackman(len(t) + 2)[1:-1]
    taps *= up / taps.sum()
    wide = np.zeros(len(x) * up)
    wide[::up] = x
    want = np.convolve(wide, taps)[centre:][: len(wide)][::down]
    assert len(got) == len(want) and np.allclose(got, want)


def test_log_mel_matches_a_plain_transform():
    s = audio.AudioSettings(block=500)
    data = np.random.default_rng(1).integers(0, 256, 4000).astype(np.uint8).tobytes()
    got = np.concatenate(list(audio.log_mel(data, s)))
    signal = np.concatenate(list(audio.resample(iter([(np.frombuffer(data, np.uint8) - 127.5) / 127.5]), s)))
    window, bank = audio._mel_bank(s)
    want = np.array([np.log(np.abs(np.fft.rfft(signal[a : a + s.window] * window, s.fft)) ** 2 @ bank + 1e-10) for a in range(0, len(signal) - s.window + 1, s.hop)])
    assert got.shape == want.shape and np.allclose(got, want, atol=1e-6)


def test_segments_have_hysteresis():
    s = audio.AudioSettings()
    step = s.hop / s.out_rate
    assert audio.segments(np.array([0.0, -4, -5, -9, -4, -1, -7]), s) == [(0.0, round(3 * step, 4)), (round(5 * step, 4), round(6 * step, 4))]
    assert audio.segments(np.zeros(0), s) == []


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=700), st.integers(1, 64))
def test_wav_round_trip(data, unit):
    padded = audio.pad(data, unit)
    assert len(padded) % unit == 0 and len(padded) >= unit and padded.startswith(data) and set(padded[len(data) :]) <= {255}
    assert audio.from_wav(audio.to_wav(padded, 8000)) == (padded, 8000)


def test_media_columns(spark):
    texts = [None, "", "héllo", "x" * 576, "y" * 577, "same", "same", "long " * 5000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    s = audio.AudioSettings()
    got = sorted(audio.describe(audio.store(docs, 576, s), s).collect(), key=lambda r: r.doc_id)
    for r, t in zip(got, texts, strict=True):
        payload = audio.pad((t or "").encode(), 576)
        assert r.n_bytes == len((t or "").encode()) and r.payload_bytes == len(payload) and r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.media_sha256 == hashlib.sha256(audio.to_wav(payload, s.rate)).hexdigest() and r.frames > 0 and len(r.mean_mel) == s.mels
    assert got[5][1:] == got[6][1:] and got[0][1:] == got[1][1:]
    assert audio.describe(audio.store(docs.limit(0), 576, s), s).count() == 0
    files = audio.write_tensors(audio.store(docs, 576, s), s)
    stored = [b for f in files.collect() for b in audio.read_tensors(f.path)]
    assert all(isinstance(b.schema.field("log_mel").type, pa.FixedShapeTensorType) and b.schema.field("log_mel").type.shape == [s.tensor_frames, s.mels] for b in stored)
    long = pa.Table.from_batches(stored).to_pylist()
    at = next(i for i, r in enumerate(long) if r["doc_id"] == 7)
    assert long[at]["begins"] and not long[at + 1]["begins"] and long[at]["end_s"] == long[at + 1]["start_s"]
    want = audio.features(audio.pad(texts[7].encode(), 576), s)
    assert got[7].frames == want["frames"] and np.allclose(got[7].mean_mel, want["mean_mel"], atol=0.01)


def test_tensors():
    s = audio.AudioSettings()
    table = audio.tensor_table(b"ab" * 20_000, s)
    got = audio.features(b"ab" * 20_000, s, tensors=True)
    assert isinstance(table.schema.field("log_mel").type, pa.FixedShapeTensorType) and table.num_rows == -(-got["frames"] // s.tensor_frames)
    assert table.column("log_mel").combine_chunks().to_numpy_ndarray().shape == (table.num_rows, s.tensor_frames, s.mels)
    assert table.column("end_s").to_pylist()[-1] == pytest.approx(got["frames"] * s.hop / s.out_rate)


# pages

ARTICLE = "<h1>Title &amp; more</h1><p>First <b>bold</b> word.<br>Next   line</p><p>Second &eacute;</p>"
TEXT = "Title & more First bold word. Next line Second é"


def shell(body, menu="<nav><a href=/>Home</a></nav>"):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{menu}<!-- c -->{body}<footer>&copy; x</footer></body></html>"


@pytest.mark.parametrize(
    "body",
    [
        f"<article>{ARTICLE}</article>",
        f"<main>{ARTICLE}</main><aside>Side</aside>",
        f"<div id='content'>{ARTICLE}</div>",
        f"<header>Site</header><div class='cookie-notice'>We use cookies</div><article>{ARTICLE}<div class='ad'>Buy</div><form><label>Name</label><input></form></article><section id='comments'><p>Nice!</p></section>",
        f"<article>{ARTICLE}<ul class='social-share'><li>Tweet</li></ul><div hidden>x</div><div style='display: none'>y</div></article><div class='Sidebar'>z</div>",
        f"<div role='banner'>B</div><article>{ARTICLE}<template>t</template><select><option>o</option></select></article>",
        f"<article><p><b>Title &amp; more<p>First <i>bold</i> word.<br><p>Next line<p>Second &#233;</article>",
    ],
)
def test_main_text(body):
    assert htmltext.main_text(shell(body)) == TEXT


def test_broken_pages():
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<script>x") == ""
    assert htmltext.main_text("<article><p>a</p><p>b &am") == "a b &am" and htmltext.main_text("plain") == "plain"
    assert htmltext.main_text("<p>" + "x " * 100_000) == ("x " * 100_000).strip()
    assert htmltext.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<p>a <span style="display:none"><span>in</span>secret</span>b</p>', "a b"),
        ("<p>a</p><svg><svg><text>x</text></svg><text>y</text></svg><p>b</p><object><object></object>z</object>", "a b"),
        ('<p title="abc>broken text</p><p>more', "broken text more"),
        ("<p title='abc>broken</p><p>more", "broken more"),
        ('<article><header>Head</header><p>main <span class="ad">AD</span><a class="share" href="x">Share</a></p></article>', "main"),
        ("<article><header><h1>Title</h1><p>By me</p></header><p>main</p></article>", "Title main"),
        ('<p>a <span hidden>b <em>c</em></span><i aria-hidden="true">d</i>e</p><p>f</p>', "a e f"),
        ('<div><p>a <span class="ad">b</p></div><p>c</p>', "a c"),
        ('<pre>x <span class="comment"># y</span></pre><p>z</p>', "x # y z"),
        ('<p>1 < 2 and "q" it\'s</p>', "1 < 2 and \"q\" it's"),
    ],
)
def test_silent_and_broken_markup(html, text):
    assert htmltext.main_text(html) == text


def test_differencing_removes_what_neighbours_share():
    a = shell("<div>Welcome to the site</div><p>All about zebras and their stripes.</p><div>Call us any time</div>")
    b = shell("<div>Welcome to the site</div><p>All about lions and their long manes.</p><div>Call us any time</div>")
    assert htmltext.main_text(a, b) == "All about zebras and their stripes."
    assert htmltext.main_text(a, a) == "Welcome to the site All about zebras and their stripes. Call us any time"
    marked = shell(f"<article>{ARTICLE}</article>")
    assert htmltext.main_text(marked, marked) == TEXT


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=12), st.lists(st.sampled_from("abcd"), max_size=12))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    length = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            length[i + 1][j + 1] = length[i][j] + 1 if x == y else max(length[i][j + 1], length[i + 1][j])
    kept = [x for x, s in zip(a, htmltext.common_lines(a, b), strict=True) if s]
    rest = iter(b)
    assert len(kept) == length[-1][-1] and all(x in rest for x in kept)


def test_extract(spark):
    rng = random.Random(5)
    rows = [(i, f"https://h{rng.randrange(3)}.com/{rng.choice("ab")}/{i}", shell(f"<div>Shared line</div><p>Own words {i}</p>")) for i in range(60)]
    rows += [(100, None, "<p>x</p>"), (101, "https://solo.com/", None), (None, "https://solo2.com/", "<p>y</p>"), (103, "odd", ""), (3, rows[3][1], rows[3][2])]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    got = htmltext.extract(pages).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(texts[i] == f"Own words {i}" for i in range(60)) and texts[100] == "x" and texts[101] == "" and texts[None] == "y" and texts[103] == ""
    one = {(r.page_id, r.text) for r in htmltext.extract(pages, ranges=1).collect()}
    assert one == {(r.page_id, r.text) for r in htmltext.extract(pages, ranges=13).collect()}
    assert htmltext.extract(pages.limit(0)).count() == 0


# archives


def test_url_keys():
    assert warc.url_key("HTTP://www.Blog.Example.com:80/a?b#c") == "com,example,blog)/a?b" and warc.url_key(None) == "-" and warc.url_key("odd") == "odd"


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 7)
    big = "<p>" + "é" * 60
    rows = [(i, f"https://h{i % 3}.com/{i}", f"<p>{i}</p>" + "x" * 200) for i in range(40)]
    rows += [(50, "https://a.com/", big), (41, "https://a.com/", big), (60, "https://b.com/\r\nx", big), (70, "https://c.com/", "tiny"), (71, "https://c.com/", "tiny"), (80, None, None), (81, "u", ""), (None, "https://d.com/", "n" * 150), (90, "https://d.com/2", "z" * 100_000), (41, "https://a.com/", big)]
    pages = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    _, directory = warc.write_archives(pages)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(directory).collect()), key=str)
    want = []
    for page, _, body in rows:
        data = (body or "").encode()
        revisit = body == big and page != 41
        want.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 41 if revisit else None))
    assert got == sorted(want, key=str)
    looked = warc.fetch(pages.repartition(3), directory).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in looked), key=str) == got
    some = warc.fetch(pages.filter("page_id IN (3, 41, 90)").unionByName(pages.selectExpr("CAST(999 AS long) AS page_id", "'https://none.com/' AS url", "html", "digest").limit(1)), directory)
    assert sorted(r.page_id for r in some.collect()) == [3, 41, 41, 90]
    payloads = {r.page_id: r.payload for r in warc.read_archives(directory, payloads=True).collect()}
    assert bytes(payloads[90]) == b"z" * 100_000 and payloads[50] is None
    blocks = warc.load_directory(directory)
    assert len(blocks) > 4
    for page, url, _ in rows[:40]:
        assert [warc._page(h["warc-record-id"]) for h, _, _ in warc.look_up(blocks, url)] == [page]
    assert sorted(warc._page(h["warc-record-id"]) for h, _, _ in warc.look_up(blocks, "https://a.com/")) == [41, 41, 50] and warc.look_up(blocks, "https://none.com/") == []
    assert warc.round_trip(spark, pages.limit(0)).count() == 0
