"""Pages beside copies, and short articles in long templates."""

import random

from pagelens.llm import htmltext

TEMPLATE = [f"The {w} line of a long site template that no element or class marks" for w in ("first", "second", "third", "fourth", "fifth", "sixth")]
ARTICLES = ["Zebras have stripes", "Lions roar at dusk", "Otters float on rivers", "Owls hunt by ear", "Bees dance for food", "Whales sing far", "Crabs walk aside", "Storks nest high"]


def page(*lines):
    return "<html><body>" + "".join(f"<div>{x}</div>" for x in lines) + "</body></html>"


def framed(*article):
    return page(*TEMPLATE[:3], *article, *TEMPLATE[3:])


def test_short_articles_in_a_long_template():
    a, b, c = (framed(x) for x in ARTICLES[:3])
    assert htmltext.main_text(a, b) == htmltext.main_text(a, b, c) == ARTICLES[0]


def test_edited_copies_keep_their_text():
    body = [f"Paragraph about {x.lower()} and much more that the article has to say of it" for x in ARTICLES]
    a = page(*body, "Read 17 times")
    for other in (page(*body), page(*body, "Read 17 times", "One more line here"), page(*body, "Read 18 times"), page(*body[:-1], body[-1] + " now", "Read 17 times")):
        assert htmltext.main_text(a, other) == htmltext.main_text(a) and htmltext.main_text(other, a) == htmltext.main_text(other)
    # two that replaced a line each, beside a page that shows what the site's furniture is
    x, y, far = (page("Welcome to us", *lines) for lines in (["Zebra news", *body], ["Weather from the north", *body], ["Nothing of this"]))
    assert htmltext.main_text(x, y, far) == " ".join(["Zebra news", *body])
    # what only one of two close pages shares stays
    p, q, r = (page(*TEMPLATE, *lines) for lines in (["Zebras", "Lions"], ["Zebras", "Otters"], ["Owls", "Lions"]))
    assert htmltext.main_text(p, q, r) == "Zebras Lions"


def test_runs_of_copies_lose_their_furniture(spark):
    rows, want = [], {}
    order = random.Random(2)
    for host in "ab":
        for k, times in enumerate((5, 1, 30, 2, 1, 9, 3, 40)):  # variants of a URL by query, longer than a range of 13
            for _ in range(times):
                i = len(rows)
                rows.append((i, f"https://{host}.com/p{k}?v={i}", framed(ARTICLES[k])))
                want[i] = ARTICLES[k]
    rows += [(1000 + i, f"https://c.com/same?v={i}", framed(ARTICLES[0])) for i in range(20)]  # nothing differs on this host
    want |= {1000 + i: " ".join([*TEMPLATE[:3], ARTICLES[0], *TEMPLATE[3:]]) for i in range(20)}
    order.shuffle(rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for ranges in (1, 13, 60):
        assert {r.page_id: r.text for r in htmltext.extract(pages, ranges=ranges).collect()} == want


def test_neighbours_are_the_nearest_pages_with_other_texts(spark):
    """Every page against the definition, on unmarked pages where differencing alone tells furniture from text."""
    rng = random.Random(7)
    rows = []
    for i in range(150):
        lines = rng.sample(TEMPLATE, 3) + rng.sample(ARTICLES, rng.randrange(0, 4))
        rows.append((i, f"https://{rng.choice('abc')}.com/{rng.choice('xy')}/{rng.choice('uvw')}/{rng.randrange(9)}", page(*lines)))
    rows += [(200 + i, *rng.choice(rows)[1:]) for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    keys = {i: tuple(u.split("//")[1].split("/", 1)) for i, u, _ in rows}
    order = sorted(rows, key=lambda r: (keys[r[0]], r[0]))
    want, changed = {}, 0
    for at, (i, _, html) in enumerate(order):
        own = [b.text for b in htmltext.blocks(html)]
        near = []
        for way in (range(at - 1, -1, -1), range(at + 1, len(order))):
            beside = next((order[k] for k in way if keys[order[k][0]][0] != keys[i][0] or [b.text for b in htmltext.blocks(order[k][2])] != own), None)
            if beside is not None and keys[beside[0]][0] == keys[i][0]:
                near.append(beside)
        near.sort(key=lambda r: -htmltext.nearness("/" + keys[r[0]][1], "/" + keys[i][1]))
        want[i] = htmltext.main_text(html, *(r[2] for r in near))
        changed += want[i] != htmltext.main_text(html)
    assert changed > 100
    for ranges in (1, 11):
        assert {r.page_id: r.text for r in htmltext.extract(frame, ranges=ranges).collect()} == want
