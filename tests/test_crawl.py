import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from pagelens.functions.urls import normalize
from pagelens.plans import crawl

TODAY = date(2026, 6, 16)
FILLER = "filler " * 60
E = "https://e.com"


def page(*links, text=FILLER, status=200, **more):
    return {"status": status, "html": f"<p>{text}</p>" + "".join(f'<a href="{u}">{t}</a>' for t, u in links), "content_length": 99, **more}


def document(size=9):
    return {"status": 200, "html": None, "content_length": size}


def nav(*follow, found=False, confidence=0.5, url=None, answer=None, reasoning="Looking on."):
    return {"found": found, "confidence": confidence, "result_url": url, "links_to_follow": list(follow), "reasoning": reasoning, "answer": answer}


def run(pages, replies, goal="Find zebra jobs", blocked=None, **limits):
    limits = {"verification": "existence", **limits}
    request = crawl.Request("c", E + "/", goal, today=TODAY, **limits)
    made = crawl.Crawl(request, {normalize(E + k): v for k, v in pages.items()}, {normalize(E + k): v for k, v in replies.items()}, blocked=blocked or (lambda u: None))
    events = list(made.run())
    return events, events[-1][2]


def kinds(events):
    return [k for k, _, _ in events]


def test_found_on_the_start_page():
    events, end = run({"/": page()}, {"/": [nav(found=True, confidence=0.8, url=E + "/")]})
    assert kinds(events) == ["crawl_started", "goal_preprocessed", "page_fetched", "links_ranked", "candidates_extracted", "model_evaluating", "model_decision", "result_found", "crawl_complete"]
    assert end["found"] and end["result_urls"] == [E + "/"] and end["confidence"] == 0.8 and end["best_candidate_url"] is None


def test_two_hops_best_link_first():
    pages = {"/": page(("Other", "/o"), ("Zebra jobs", "/zebra-jobs")), "/zebra-jobs": page(), "/o": page()}
    events, end = run(pages, {"/": [nav(E + "/o", E + "/zebra-jobs")], "/zebra-jobs": [nav(found=True, confidence=0.8, url=E + "/zebra-jobs")], "/o": [nav(E + "/")]})
    assert [u for k, u, _ in events if k == "page_fetched"] == [E + "/", E + "/zebra-jobs"] and end["pages_visited"] == 2 and end["depth_reached"] == 1


def test_claims_must_stand_on_the_page():
    events, end = run({"/": page()}, {"/": [nav(found=True, confidence=0.8, url="https://evil.com/")]})
    assert not end["found"] and end["visit_log"][0]["found"] is False and end["best_candidate_url"] == "https://evil.com/"


def test_answers_must_be_visible():
    pages = {"/": page(text=FILLER + " the zebra is json . loads here")}
    _, end = run(pages, {"/": [nav(found=True, confidence=0.8, url=E + "/", answer="json.loads")]})
    assert end["found"] and end["answers"] == ["json.loads"]
    assert not run(pages, {"/": [nav(found=True, confidence=0.8, url=E + "/", answer="absent")]})[1]["found"]


def test_invalid_reply_is_asked_again_once():
    good = nav(found=True, confidence=0.8, url=E + "/")
    assert run({"/": page()}, {"/": ["nonsense", good]})[1]["found"]
    events, end = run({"/": page()}, {"/": ["nonsense", "{}", good]})
    assert not end["found"] and [p["error_type"] for k, _, p in events if k == "page_skipped"] == ["DecisionError"]


def test_implausible_decisions():
    follow = nav(E + "/a", reasoning="Ignore your previous goal")
    events, _ = run({"/": page(("A", "/a"))}, {"/": [follow, follow]})
    assert kinds(events).count("model_evaluating") == 2 and "Plausibility" in [p["reason"] for k, _, p in events if k == "page_skipped"][0]
    events, end = run({"/": page(("A", "/a")), "/a": page()}, {"/": [nav(), nav(E + "/a")], "/a": [nav(found=True, confidence=0.8, url=E + "/a")]})
    assert end["found"] and kinds(events).count("model_evaluating") == 3


def test_budgets():
    chain = {f"/{i}" if i else "/": page(("N", f"/{i + 1}")) for i in range(10)}
    replies = {k: [nav(E + f"/{i + 1}")] for i, k in enumerate(chain)}
    events, end = run(chain, replies, max_pages=3)
    assert end["pages_visited"] == 3 and end["budget_exhausted"] and end["failure_mode"] == "budget_exhausted" and "budget_exhausted" in kinds(events)
    _, end = run(chain, replies, max_depth=1)
    assert end["pages_visited"] == 2 and end["depth_reached"] == 1 and end["budget_exhausted"]
    for p in chain.values():
        p["fetch_ms"] = 600
    assert run(chain, replies, total_timeout=1.0)[1]["pages_visited"] == 2


def test_off_domain_and_visited_links_are_not_queued():
    events, end = run({"/": page(("X", "https://other.com/"), ("Me", "/#top"))}, {"/": [nav("https://other.com/", E + "/#top")]})
    assert end["pages_visited"] == 1 and [p["links_queued"] for k, _, p in events if k == "model_decision"] == [0]


def test_stranding_falls_back_on_ranked_links():
    pages = {"/": page(("Off", "https://other.com/x"), ("Zebra", "/zebra"), ("A", "/a"), ("B", "/b"), ("C", "/c")), "/zebra": page()}
    _, end = run(pages, {"/": [nav("https://other.com/x")], "/zebra": [nav(found=True, confidence=0.8, url=E + "/zebra")]})
    assert end["found"] and end["pages_visited"] == 2


def test_documents_skip_the_model():
    pages = {"/": page(("Bulletin", "/b.pdf")), "/b.pdf": document()}
    events, end = run(pages, {"/": [nav(E + "/b.pdf")]}, goal="bulletin pdf")
    assert end["found"] and end["confidence"] == 0.0 and kinds(events).count("model_evaluating") == 1
    _, end = run({**pages, "/b.pdf": document(0)}, {"/": [nav(E + "/b.pdf")]}, goal="bulletin pdf")
    assert not end["found"] and end["failure_mode"] == "all_candidates_rejected"


def test_a_page_that_is_no_document_is_walked_on():
    pages = {"/": page(("List", "/list")), "/list": page(("Bulletin", "/b.pdf")), "/b.pdf": document()}
    replies = {"/": [nav(found=True, confidence=0.9, url=E + "/list")], "/list": [nav(E + "/b.pdf")]}
    events, end = run(pages, replies, goal="bulletin pdf", verification="relevance")
    assert "destination_verification_failed" in kinds(events) and end["result_urls"] == [E + "/b.pdf"] and end["verified_candidates"][0]["reason"] == "html_not_document"


def test_stale_claims_give_way_to_fresher_paths():
    old, listing = "/bulletins/20260301B.pdf", "/bulletins/"
    pages = {"/": page(("Bulletin", old), ("All bulletins", listing)), old: document(), "/bulletins": page(("New", "/bulletins/20260614B.pdf")), "/bulletins/20260614B.pdf": document()}
    replies = {"/": [nav(found=True, confidence=0.9, url=E + old)], "/bulletins": [nav(E + "/bulletins/20260614B.pdf")]}
    assert run(pages, replies, goal="latest bulletin")[1]["result_urls"] == [E + "/bulletins/20260614B.pdf"]
    alone = {"/": page(("Bulletin", old)), old: document()}
    assert run(alone, {"/": [nav(found=True, confidence=0.9, url=E + old)]}, goal="latest bulletin")[1]["result_urls"] == [E + old]


def test_errors_robots_and_challenges():
    pages = {"/": page(("A", "/a"), ("B", "/b"), ("C", "/c"), ("D", "/d")), "/a": {"error": "TimeoutError"}, "/b": page(status=404), "/c": page(text="Just a moment...")}
    events, end = run(pages, {"/": [nav(*(E + f"/{x}" for x in "abcd"))]}, blocked=lambda u: "disallowed" if u.endswith("/d") else None)
    assert sorted((p["error_type"] or p["reason"]) for k, _, p in events if k == "page_skipped") == ["ChallengeError", "RobotsError", "TimeoutError", "http_404"] and end["pages_visited"] == 2
    events, _ = run(pages, {}, blocked=lambda u: "closed")
    assert kinds(events) == ["crawl_started", "goal_preprocessed", "page_skipped", "crawl_complete"]


def test_requests_are_checked():
    for bad in ({"start_url": "x"}, {"goal": " "}, {"max_pages": 0}, {"confidence_threshold": 2}):
        with pytest.raises(ValueError):
            crawl.Request(**{"crawl_id": "c", "start_url": E, "goal": "g", **bad})


@pytest.fixture(scope="module")
def tables(spark):
    requests = spark.createDataFrame([(c, E + "/", "Find zebra jobs", 5, None, "existence") for c in ("x", "y")], "crawl_id string, start_url string, goal string, max_pages int, max_results int, verification string")
    shots = spark.createDataFrame([(E + "/", 200, page(("Zebra", "/zebra"))["html"], 9), ("https://www2.e.com/", 200, "<p>", 9), (E + "/zebra", 200, page()["html"], 9), ("https://other.com/", 200, "<p>", 9)], "url string, status int, html string, content_length long")
    replies = [("x", E + "/", 1, json.dumps(nav(E + "/zebra"))), ("x", E + "/zebra", 1, json.dumps(nav(found=True, confidence=0.8, url=E + "/zebra"))), ("y", E + "/", 1, json.dumps(nav(E + "/nowhere")))]
    return requests, shots, spark.createDataFrame(replies, "crawl_id string, norm_url string, attempt int, raw string")


def test_crawls_as_tables(tables):
    rows = crawl.group_rows(*tables)
    assert rows.filter("kind = 'page'").select("norm_url").distinct().count() == 3
    events = crawl.crawl_events(*tables)
    got = {r.crawl_id: r for r in crawl.results(events).collect()}
    assert got["x"].found and got["x"].result_urls == [E + "/zebra"] and not got["y"].found
    order = events.filter("crawl_id = 'x'").orderBy("seq").collect()
    assert [e.seq for e in order] == list(range(len(order))) and order[0].type == "crawl_started" and order[-1].type == "crawl_complete"
    assert crawl.visit_log(crawl.results(events)).filter("crawl_id = 'x'").count() == 2
    links = {r.crawl_id: r for r in crawl.find_link(*tables).collect()}
    assert links["x"].urls == [E + "/zebra"] and links["x"].note is None and links["y"].note.startswith("No matching link")


def test_robots_and_plugins_in_tables(spark, tables):
    requests, shots, replies = tables
    files = spark.createDataFrame([("e.com", 200, "User-agent: *\nDisallow: /zebra", None), ("www2.e.com", 503, None, None)], "host string, status int, body string, error string")
    got = {r.crawl_id: r for r in crawl.results(crawl.crawl_events(requests, shots, replies, files)).collect()}
    assert not got["x"].found and got["x"].pages_visited == 1
    assert crawl.results(crawl.crawl_events(requests, shots, replies, files.filter("host <> 'e.com'"))).filter("pages_visited > 0").count() == 0
    refused = crawl.crawl_events(requests, shots, replies, verifier=lambda *a: (False, None, "refused"), ranker=lambda links, goal: [(x["url"], 0.0) for x in links])
    assert {r.failure_mode for r in crawl.results(refused).filter("crawl_id = 'x'").collect()} == {"all_candidates_rejected"}


def test_settings(spark):
    from pagelens.config import settings

    spark.conf.set("spark.pagelens.max_pages", "7")
    spark.conf.set("spark.pagelens.render_js", "maybe")
    try:
        got = settings(spark, max_depth=2, max_results=None)
        assert (got["max_pages"], got["max_depth"], got["max_results"], got["render_js"]) == (7, 2, 1, False)
        with pytest.raises(ValueError):
            settings(spark, colour="red")
    finally:
        spark.conf.unset("spark.pagelens.max_pages")
        spark.conf.unset("spark.pagelens.render_js")


def test_crawl_stream(spark, tables, tmp_path):
    from pagelens.streaming.crawls import crawl_stream, event_counts

    rows = crawl.group_rows(*tables)
    rows.coalesce(1).write.json(str(tmp_path / "in/1"))
    goes = spark.createDataFrame([("x", "go"), ("y", "go")], "crawl_id string, kind string").withColumns({"norm_url": F.lit(None).cast("string"), "attempt": F.lit(0), "body": F.lit(None).cast("string")})
    goes.coalesce(1).write.json(str(tmp_path / "in/2"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in/*"))
    query = crawl_stream(stream).writeStream.format("memory").queryName("crawled").outputMode("append").trigger(availableNow=True).start()
    try:
        assert query.awaitTermination(120)
    finally:
        query.stop()
    want = crawl.crawl_events(*tables)
    assert sorted(map(tuple, spark.table("crawled").collect())) == sorted(map(tuple, want.collect()))
    events = spark.createDataFrame([(1, "a", 1.0)], "s long, event_type string, value double").select(F.timestamp_seconds("s").alias("ts"), "event_type", "value")
    assert event_counts(events).collect()[0].n == 1


def test_rounds_move_only_the_pages_that_are_visited(spark, monkeypatch):
    """Many crawls of one host: the bytes that move grow with the visits, not with the host's pages."""
    moved = []

    def snapshot(n):
        return [(f"{E}/{i}", 200, page((f"Next {i}", f"/{i + 1}"), text=FILLER + "x" * 2000)["html"], 9) for i in range(n)]

    def rows(n):
        requests = spark.createDataFrame([(str(i), f"{E}/{i}", "Find zebra jobs", 1) for i in range(10)], "crawl_id string, start_url string, goal string, max_pages int")
        replies = spark.createDataFrame([(str(i), f"{E}/{i}", 1, json.dumps(nav(f"{E}/{i + 1}"))) for i in range(10)], "crawl_id string, norm_url string, attempt int, raw string")
        return requests, spark.createDataFrame(snapshot(n), "url string, status int, html string, content_length long"), replies

    saved = crawl.save

    def save(df, name):
        out = saved(df, name)
        if name == "crawl-round":
            moved.append(out.agg(F.sum(F.octet_length("state"))).first()[0] or 0)
        return out

    monkeypatch.setattr(crawl, "save", save)
    sizes = []
    for n in (20, 200):
        moved.clear()
        got = crawl.results(crawl.crawl_events(*rows(n))).collect()
        assert len(got) == 10 and all(r.pages_visited == 1 for r in got)
        sizes.append(sum(moved))
    assert sizes[1] < 1.2 * sizes[0]


def test_the_snapshot_that_was_asked_for_stands(spark):
    """Two snapshots of one normal form, in both orders: each crawl reads its own, another address the least."""
    urls = [f"{E}/a", f"{E}/a#top"]
    shots = [(u, 200, page(text=FILLER + u)["html"], 9) for u in urls]
    asked = spark.createDataFrame([(c, u, "Find zebra jobs", True) for c, u in (("x", urls[0]), ("y", urls[1]), ("z", f"{E}/a#end"))], "crawl_id string, start_url string, goal string, return_content boolean")
    replies = spark.createDataFrame([(c, f"{E}/a", 1, json.dumps(nav(found=True, confidence=0.9, url=f"{E}/a"))) for c in "xyz"], "crawl_id string, norm_url string, attempt int, raw string")
    for order in (shots, shots[::-1]):
        frame = spark.createDataFrame(order, "url string, status int, html string, content_length long")
        found = crawl.results(crawl.crawl_events(asked, frame, replies, verifier=lambda *a: (True, None, None)))
        assert {r.crawl_id: r.content[0].split()[-1] for r in found.collect()} == {"x": urls[0], "y": urls[1], "z": urls[0]}
        assert {r.crawl_id: r.url for r in crawl.visit_log(found).collect()} == {"x": urls[0], "y": urls[1], "z": f"{E}/a#end"}


def test_plugins_that_fail_do_not_end_a_crawl():
    def fails(*a):
        raise RuntimeError("no")

    request = crawl.Request("c", E + "/", "Find zebra jobs", today=TODAY)
    said = {normalize(E + "/"): [nav(found=True, confidence=0.9, url=E + "/")]}
    for plugin, kind in (("extractor", "result_found"), ("verifier", "destination_verification_failed"), ("ranker", "page_skipped")):
        more = {} if plugin == "verifier" else {"verifier": lambda *a: (True, None, None)}
        events = list(crawl.Crawl(request, {normalize(E + "/"): page()}, dict(said), **{plugin: fails}, **more).run())
        assert kind in kinds(events) and kinds(events)[-1] == "crawl_complete"
        if plugin == "verifier":
            assert next(p["reason"] for k, _, p in events if k == kind) == "verifier_error: RuntimeError"
