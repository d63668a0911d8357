from collections import Counter, defaultdict

import pyarrow as pa

from semtag.llm import extraction
from semtag.llm.extraction import blocks, cut_slots, deduce_templates, extract_main, occurrences, page_tokens

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href="/x">Menu</a></nav><div class="ad">Buy</div>'
    "<article><h1>Head &amp; more</h1><p><b>One\n  two<br>three<p>Four&nbsp;five</p><script>var t='</p>';</script><!-- no --><form>F</form>"
    '<div class="comments"><p>first!</p></div><aside>side</aside></article><footer>&copy; x</footer></body></html>'
)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    return {x["page_id"]: x for x in extract_main(df).collect()}, extract_main(df).count()


def test_article_and_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "http://a.org/1", PAGE), (2, "http://a.org/2", None), (3, None, ""), (4, "bad url", "plain < text & more"), (5, "http://a.org/5", "<article><p>open"), (6, "http://a.org/6", "<main>" + deep + "</main>"), (7, "http://a.org/7", "<article></article>"), (8, "http://a.org/8", "<p")]
    got, n = run(spark, [*rows, rows[0]])
    assert n == len(rows) + 1
    assert got[1]["text"] == "Head & more\nOne two three\nFour five" and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "" and got[3]["text"] == "" and got[4]["text"] == "plain < text & more"
    assert got[5]["text"] == "open" and got[6]["text"] == "deep" and got[7]["text"] == "" and got[8]["text"] == ""
    assert run(spark, [])[1] == 0


def test_template_of_pages_without_an_article(spark):
    shell = '<html><body><div class="x">Welcome to our site</div><div><p>{0}</p><p>{1}</p></div><p>All rights reserved</p></body></html>'
    rows = [(i, f"http://b.org/{i}", shell.format(f"story {i}", f"more of {i}")) for i in range(6)]
    rows += [(100, "http://c.org/1", shell.format("single", "page"))]
    got, _ = run(spark, rows)
    assert all(got[i]["text"] == f"story {i}\nmore of {i}" for i in range(6))
    assert got[100]["text"] == "Welcome to our site\nsingle\npage\nAll rights reserved"


def test_repeated_articles_stay(spark):
    got, _ = run(spark, [(i, f"http://d.org/{i}", PAGE) for i in range(8)])
    assert {x["text"] for x in got.values()} == {"Head & more\nOne two three\nFour five"}


def test_classes_of_occurrence_vectors(spark):
    rows = [(i, "h", f"<div>same</div><span>{i}</span><p>often</p>" if i else "<div>same</div>", i) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, host string, html string, page_key long")
    assert {x["token"] for x in deduce_templates(df).collect()} >= {"div\nsame", "p\noften"}


def test_blocks_close_like_browsers():
    assert [t for _, t, *_ in blocks("<ul><li>a<li>b</ul><p>c<div>d</div>e")] == ["a", "b", "c", "d", "e"]


def test_rows_without_an_article_stay_apart(spark):
    rows = [(1, "http://e.org/1", "<p>one</p><p>two</p>", "x")] * 6 + [(None, None, f"<p>null {i}</p><p>more {i}</p>", "x") for i in range(5)] + [(2, "http://e.org/2", f"<p>same key {i}</p>", "x") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, kind string")
    want = ["one\ntwo"] * 6 + [f"null {i}\nmore {i}" for i in range(5)] + [f"same key {i}" for i in range(3)]
    assert sorted(x["text"] for x in extract_main(df).collect()) == sorted(want)


def test_marks_are_whole_tokens_and_spare_the_main_element():
    kept = [
        "<div class='content has-sidebar'><article>x</article></div>",
        "<div class='sidebar'><article>x</article></div>",
        "<main class='with-comments'>x</main>",
        "<article id='notice-12'>x</article>",
        "<article class='sponsored-none share'>x</article>",
        "<article><section class='related-work'>x</section></article>",
        "<article><div class='article-header'>x</div></article>",
        "<article><p title='the hidden cost'>x</p></article>",
        "<article><p title=\"a class='ad'\">x</p></article>",
        "<article><figure><img src=a><figcaption>x</figcaption></figure></article>",
    ]
    dropped = ["<article><div class='big Ad'>x</div></article>", "<article><p hidden>x</p></article>", "<article><p style='display: none'>x</p></article>", "<p aria-hidden=true>x</p>", "<nav class='a'><article>x</article></nav>"]
    assert [[(t, bad) for _, t, _, bad in blocks(h)] for h in kept] == [[("x", False)]] * len(kept)
    assert [[(t, bad) for _, t, _, bad in blocks(h)] for h in dropped] == [[("x", True)]] * len(dropped)


def test_lines_that_articles_share_stay(spark):
    a = "<html><body><nav>Menu</nav><article><p>Licensed under some terms.</p><p>story {0} is told here at length, and not briefly</p><p>All figures are in euros.</p></article></body></html>"
    c = "<html><body><table><tr><td>Old shell</td><td>cell {0}</td><td>Old end</td></tr></table></body></html>"
    rows = [(100 * k + i, f"http://f.org/{k}/{i}", shell.format(i)) for k, shell in enumerate((a, c)) for i in range(8)]
    got, n = run(spark, rows)
    assert n == 16
    for i in range(8):
        assert got[i]["text"] == f"Licensed under some terms.\nstory {i} is told here at length, and not briefly\nAll figures are in euros."
        assert got[100 + i]["text"] == f"cell {i}"


def test_furniture_inside_articles_goes():
    for name in ("comment-list", "reader-comments", "newsletter-signup", "ad-slot", "comments", "post_ads", "sponsored-box"):
        assert [(t, bad) for _, t, _, bad in blocks(f"<article><p>x</p><div class='{name}'><p>y</p></div></article>")] == [("x", False), ("y", True)], name


def plain_template(pages, support=0.5, least_pages=4, least_tokens=2):
    """Classes of one host by their whole vectors, page by page."""
    out = set()
    layouts = defaultdict(list)
    for page in dict.fromkeys(pages):
        number, tokens = page_tokens(page)
        layouts[number].append(occurrences(tokens))
    for number, own in layouts.items():
        vectors, follows = defaultdict(dict), defaultdict(Counter)
        for i, seen in enumerate(own):
            for t in seen:
                vectors[t["token"], t["text"]][i] = t["times"]
                follows[t["token"], t["text"]][t["first"]] += t["first"] == t["last"]
        usual = {k: max((n, f) for f, n in c.items()) for k, c in follows.items()}
        fit = {k: v for k, v in vectors.items() if len(v) >= max(least_pages, support * len(own)) and usual[k][0] >= support * len(v)}
        sizes = Counter(tuple(sorted(v.items())) for v in fit.values())
        for k, v in fit.items():
            if sizes[tuple(sorted(v.items()))] >= least_tokens:
                out.add((number, *k, v == dict.fromkeys(range(len(own)), 1), usual[k][1]))
    return out


def test_classes_equal_a_plain_deduction_and_nest(spark):
    pages = []
    for i in range(9):
        items = "".join(f"<li><b>n{i}{j}</b><p>says {j}</p></li>" for j in range(1 + i % 4))
        more = "<aside>now and then</aside>" if i % 3 == 0 else ""
        pages.append(f"<body><nav>Menu</nav>{more}<main><h1>T{i}</h1><p>text {i}</p></main><ul class='talk'>{items}</ul><footer>End</footer></body>")
    pages += [pages[0], "<table><tr><td>other</td></tr></table>"]
    df = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    got = {(x["layout"], x["token"], x["text"], x["once"], x["follows"]) for x in deduce_templates(df).collect()}
    assert got == plain_template(pages)
    nested = [x for x in got if not x[3] and not x[2]]
    assert {x[1] for x in nested} >= {"body/ul.talk/li", "body/ul.talk/li/p"} and len({x[4] for x in nested if "li" in x[1]}) == 1


def test_pages_are_cut_at_their_template(spark):
    """On the given pages, every host and layout with enough pages has a template, and its pages' slots come from it."""
    import os

    import pytest

    tables = os.environ.get("SEMTAG_TEST_TABLES", "/root/testdata/sf0.001")
    if not os.path.isdir(tables):
        pytest.skip("no tables")
    pages = spark.read.parquet(f"{tables}/pages.parquet")
    hosts, cut = Counter(), Counter()
    for x in pages.collect():
        hosts[x["url"].split("/")[2], page_tokens(x["html"])[0]] += 1
    for x in cut_slots(pages).collect():
        cut[sum(s["once"] and s["after"] != "" for s in x["slots"]) > 0] += 1
    assert cut[True] >= sum(n for n in hosts.values() if n >= 4) and (cut[True] or max(hosts.values()) < 4)


def test_a_repeated_tag_is_judged_once_but_for_its_place(monkeypatch):
    """Attributes are read once for each distinct tag; what its parents are still decides anew."""
    calls = Counter()
    plain = extraction.attributes
    monkeypatch.setattr(extraction, "attributes", lambda source: (calls.update([source]), plain(source))[1])
    mark = " class='once-judged-page'"
    found = list(blocks(f"<div{mark}><article><p{mark}>in main</p></article></div><p{mark}>out</p><aside><p{mark}>beside</p></aside>" * 50))
    assert [x[1:] for x in found[:3]] == [("in main", True, False), ("out", False, False), ("beside", False, True)]
    assert found == found[:3] * 50 and calls == {mark: 2}  # of a div and of a p
    ad = " class='share once-judged-ad'"
    assert [x[1:] for x in blocks(f"<article{ad}><p>x</p></article><section{ad}><p>y</p></section><body{ad}>z")] == [("x", True, False), ("y", False, True), ("z", False, False)]
    long = f" data-x='{'x' * extraction.REMEMBERED}'"
    before = extraction.remembered.cache_info().currsize
    assert [t for _, t, *_ in blocks(f"<p{long}>a<p{long}>b")] == ["a", "b"] and calls[long] == 2
    assert extraction.remembered.cache_info().currsize == before


def test_lists_of_tokens_go_through_arrow_field_by_field():
    kind = pa.struct([("name", pa.string()), ("text", pa.string()), ("main", pa.bool_()), ("bad", pa.bool_())])
    rows = [page_tokens(p)[1] for p in (PAGE, "", "<p>é &amp; \x00", "<br>", PAGE[:200])]
    column = extraction.lists(rows, kind)
    assert column.to_pylist() == [[dict(zip(("name", "text", "main", "bad"), t, strict=True)) for t in own] for own in rows]
    assert list(extraction.items(column)) == rows and list(extraction.items(column[1:4])) == rows[1:4]
    assert list(extraction.items(extraction.lists([], kind))) == []
    assert list(extraction.items(pa.array([None, [], [{"name": None, "text": "x", "main": None, "bad": True}], None], pa.list_(kind)))) == [[], [], [(None, "x", None, True)], []]
