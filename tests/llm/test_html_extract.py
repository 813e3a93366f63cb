import pytest

from millrace.llm import html_extract as H
from millrace.llm.html_training import LABELLED


def brute_region(scores):
    best = (0.0, 0, 0)
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            s = sum(scores[i:j])
            if s > best[0] + 1e-12:
                best = (s, i, j)
    return best[0]


def test_scan_finds_a_maximum_region():
    import random

    rng = random.Random(2)
    for _ in range(100):
        x = [rng.choice([-2.0, -1.0, -0.5, 1.0, 3.0]) for _ in range(rng.randrange(1, 25))]
        i, j = H.best_region(x)
        assert sum(x[i:j]) == pytest.approx(brute_region(x))


def test_labelled_pages():
    weights = H.default_weights()
    assert len(LABELLED) > 500
    assert [k for k, (page, text) in enumerate(LABELLED) if H.extract_text(page, weights) != text] == []


def test_pages_that_the_weights_were_not_learned_from():
    """Every tenth page is held out."""
    weights = H.learn([p for k, p in enumerate(LABELLED) if k % 10])
    assert [k for k, (page, text) in enumerate(LABELLED) if not k % 10 and H.extract_text(page, weights) != text] == []


def brute_text(page):
    """All regions tried, and the text put together from the items one by one."""
    import html

    w, parsed = H.default_weights(), H.parse(page)
    H.place(parsed, w)
    items, scores = parsed.items, H.score(parsed, w)
    best, where = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-9:
                best, where = total, (i, j)
    if where is None:
        return ""
    numbers, block = [], 0  # of the block that each item is in
    for x in items:
        block += x.kind != "text" and x.brk
        numbers.append(block)
    lo, hi = numbers[where[0]], numbers[where[1]]
    out = {}
    for x, b in zip(items, numbers):
        if lo <= b <= hi and x.kind == "text" and not x.node.side:
            out[b] = out.get(b, "") + x.text
    return "\n\n".join(t for t in (" ".join(html.unescape(v).split()) for v in out.values()) if t)


def test_whole_text_against_brute_force(spark):
    pages = [p for k, (p, _) in enumerate(LABELLED) if k % 23 == 0]
    pages += [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()]
    for page in pages:
        assert H.extract_text(page) == brute_text(page)


PARAGRAPHS = "<p>One two three four five.</p><p>Six seven eight nine ten.</p><p>A short end.</p>"
PARAGRAPHS_TEXT = "One two three four five.\n\nSix seven eight nine ten.\n\nA short end."


@pytest.mark.parametrize(
    "page",
    [
        f"<body><article><h1>T</h1><script>for(i=0;i<n;i++){{}}</script>{PARAGRAPHS}</article>",
        f"<body><article><h1>T</h1><script>var a = '<!--';</script>{PARAGRAPHS}</article>",
        f"<body><article><h1>T</h1><script>var a = \"'<p>\";</script>{PARAGRAPHS}</article>",
        f"<body><article><h1>T</h1><style>a<b {{}}</style>{PARAGRAPHS}</article>",
        f"<body><div class='content has-sidebar'><h1>T</h1>{PARAGRAPHS}</div>",
        f"<body><main><section class='legal'><h1>T</h1>{PARAGRAPHS}</section></main>",
        f"<body><div class='related-work'><h1>T</h1>{PARAGRAPHS}</div>",
        f"<head><title>Page<body><article><h1>T</h1>{PARAGRAPHS}</article>",
        f"<body><!-- never closed ><article><h1>T</h1>{PARAGRAPHS}</article>",
        f"<body><article><h1>T</h1><textarea><p>no</p></textarea><svg><text>no</text></svg>{PARAGRAPHS}</article>",
        f"<body><article><h1>T</h1>{PARAGRAPHS}<div class='ad'>{'Buy this now. ' * 60}</div></article>",
        f"<body><article><h1>T</h1><div class='ad'>{'Buy this now. ' * 60}</div>{PARAGRAPHS}</article>",
    ],
)
def test_nothing_of_the_text_is_lost(page):
    assert H.extract_text(page) == "T\n\n" + PARAGRAPHS_TEXT


@pytest.mark.parametrize("deep", ["<b>", "<div>", "<div class='ad x'>", "<span><p>", "<ul><li>", "<p>", "<a href=x>", "<form>"])
def test_time_is_linear_in_the_depth(deep):
    import time

    page = f"<article><p>Some words first.</p>{deep * 20000}inner words</article>"
    start = time.perf_counter()
    H.extract_text(page)
    assert time.perf_counter() - start < 3


def test_extra_columns_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, ARTICLE, "old", None)] * 2, "page_id int, html string, text string, other string")
    rows = H.extract(df).collect()
    assert [tuple(r) for r in rows] == [(1, ARTICLE, WANT, None)] * 2


ARTICLE = "<article><h1>T &amp; U</h1><p><b>One  two\n three.<br><p>Four &lt;five&gt; &copy;</p><ul><li>six</li></ul></article>"
WANT = "T & U\n\nOne two three.\n\nFour <five> ©\n\nsix"
SIDE = "<nav><a href='/a'>menu of many words here</a></nav><div class='ad'>Buy this thing right now please.</div>"


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body>{SIDE}{ARTICLE}<footer>all rights reserved here</footer></body></html>",
        f"<body>{ARTICLE}<section id='comments'><p>{'I disagree with this one. ' * 40}</p></section></body>",
        f"<body><div class='cookie-notice'>We use cookies, is that fine?</div>{ARTICLE}<aside>{'Related story title. ' * 20}</aside>",
        f"<body><script>var a = '<p>no</p>';</script><style>p {{}}</style>{ARTICLE}<form>Name <input> <button>Go</button></form>",
        f"<!-- <article>no</article> --><body>{ARTICLE}",
    ],
)
def test_main_text_without_the_rest(page):
    assert H.extract_text(page) == WANT


COMMENTS = f"<section id='comments'><article><p>{'I disagree with this one. ' * 40}</p></article><article><p>So do I.</p></article></section>"


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{SIDE}<div class='page with-sidebar'>{ARTICLE}<div class='sidebar'>{'Related story title. ' * 20}</div></div></body>",
        f"<body><div class='has-comments'>{ARTICLE}</div><div id='comments'>{'I disagree with this one. ' * 40}</div></body>",
        f"<body><div class='search-results'><main>{ARTICLE}</main></div>{COMMENTS}</body>",
        f"<body><form action='/'>{SIDE}{ARTICLE}<input><button>Go</button></form></body>",
        f"<form><div class='no-sidebar'>{SIDE}<div class='text'>{ARTICLE[9:-10]}</div></div></form>",
    ],
)
def test_wrappers_do_not_hide_the_main_text(page):
    assert H.extract_text(page) == WANT


@pytest.mark.parametrize("comments", [COMMENTS, f"<div class='comments'>{'I disagree. ' * 90}</div>", "<div id='respond'><article>I disagree.</article></div>"])
def test_comments_stay_out(comments):
    text = "<h1>Title of it</h1><div><p>First part of the text.</p><p>Second part of the text.</p></div>"
    assert H.extract_text(f"<body>{text}{comments}</body>") == "Title of it\n\nFirst part of the text.\n\nSecond part of the text."


def test_inside_an_article_side_parts_go():
    page = "<article><p>First part of it.</p><div class='advert'>An offer.</div><form>Mail <input></form><p>Second part of it.</p><div class='share-buttons'>Share</div></article>"
    assert H.extract_text(page) == "First part of it.\n\nSecond part of it."


@pytest.mark.parametrize("cut", range(0, len(ARTICLE), 7))
def test_truncated_pages_never_fail(cut):
    text = H.extract_text("<body>" + ARTICLE[:cut])
    assert isinstance(text, str) and "<p" not in text


def test_edge_cases(spark):
    long = "<article>" + "<p>word word</p>" * 5000 + "</article>"
    rows = [(1, None, "x"), (2, "", "x"), (3, "<nav>a b</nav>", "x"), (4, long, "x"), (5, long, "x"), (6, "< < <<>> <a", "x"), (7, '<a title="open>' + "y" * 50, "x")]
    df = spark.createDataFrame(rows, "page_id int, html string, text string")
    got = {r.page_id: r.text for r in H.extract(df).collect()}
    assert got[1] == got[2] == got[3] == "" and got[4] == got[5] == "\n\n".join(["word word"] * 5000)
    assert H.extract(df.limit(0)).collect() == []
