import random
from collections import Counter

import pytest

from arborstream.llm import html


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t[0][0]


def test_shared_lines_are_a_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(0, 12))] for _ in range(2))
        found = sorted(html.shared_lines(a, b))
        assert len(found) == lcs(a, b)
        it = iter(b)
        assert all(any(x == a[i] for x in it) for i in found)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li>Home<li>News</ul></nav><!-- x > y --><div class="ad">Buy</div>
<article><h1>A &amp; B</h1><p>one
two &lt;3&nbsp;<b>bold</b><br>more<p>second</p><aside>side</aside><div class="comments">me too</div><form>Name<input></form></article>
<footer>&copy; site</footer></body></html>"""


def test_article_text(spark):
    rows = [(1, "http://a.b/x/1", PAGE, 0), (2, None, None, 0), (3, "http://a.b/x/2", "", 0), (4, "http://c.d/", "plain <b>text", 0), (5, "not a url", "<p>a</p>" * 3, 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert got[1].text == "A & B\none two <3 bold more\nsecond"
    assert (got[2].text, got[3].text, got[4].text, got[5].text) == ("", "", "plain text", "a\na\na")
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html.extract(df.where("page_id = 99")).count() == 0


def test_unmarked_frames_go_by_differencing(spark):
    frame = "<div>Menu one</div><div>Menu two</div>{}<div>All rights reserved</div>"
    rows = [(i, f"http://h.x/a/{i}", frame.format(f"<p>story {i}</p><p>end {i}</p>")) for i in range(40)]
    rows += [(100, "http://alone.x/", frame.format("<p>only</p>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert all(got[i] == f"story {i}\nend {i}" for i in range(40))
    assert got[100] == "Menu one\nMenu two\nonly\nAll rights reserved"


def test_shared_article_lines_stay(spark):
    page = "<nav>x</nav><article><p>same</p><p>lines</p></article>"
    df = spark.createDataFrame([(i, f"http://h.x/{i}", page) for i in range(4)], "page_id long, url string, html string")
    assert {r.text for r in html.extract(df).collect()} == {"same\nlines"}


def test_differencing_decides_beside_an_article(spark):
    page = "<div>Menu</div><div><p>own text {0}</p></div><article>teaser {0}</article><div>Imprint</div>"
    df = spark.createDataFrame([(i, f"http://h.x/{i}", page.format(i)) for i in range(4)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {i: f"own text {i}\nteaser {i}" for i in range(4)}


def test_long_pages_follow_the_rule_of_short_ones():
    rng = random.Random(2)
    a, b = ([rng.choice("abcdefgh") for _ in range(2100)] for _ in range(2))
    found = sorted(html.shared_lines(a, b))
    it = iter(b)
    assert all(any(x == a[i] for x in it) for i in found)
    assert len(found) == lcs(a, b)


def test_copies_do_not_erase_each_other(spark):
    page = "<div>Menu one</div><p>story {0} is told in a line of its own</p><p>and ends {0}</p><div>Imprint</div>"
    rows = [(i, f"http://h.x/a?utm={i}", page.format("first")) for i in range(30)]  # one path
    rows += [(100 + i, f"http://h.x/b/{i}", page.format("second") + f"<p>{i}</p>") for i in range(30)]  # nearly one text
    rows += [(200, "http://h.x/c", page.format("third")), (300, "http://k.x/a?1", page.format("lone")), (301, "http://k.x/a?2", page.format("lone"))]
    for n in (1, 7):
        got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)).collect()}
        story = "story {0} is told in a line of its own\nand ends {0}"
        assert len(got) == len(rows)
        assert all(got[i] == story.format("first") for i in range(30))
        assert all(got[100 + i] == story.format("second") + f"\n{i}" for i in range(30))
        assert got[200] == story.format("third")
        assert got[300] == got[301] == "Menu one\n" + story.format("lone") + "\nImprint"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="site no-sidebar"><article><p>a</p></article></div>', "a"),
        ('<div class="sidebar"><main><p>a</p></main>b</div>', "a"),
        ('<article title="The hidden cost"><p>a</p></article>', "a"),
        ('<article class="post category-ad"><p class="social-policy">a</p><div class="share-price">b</div></article>', "a\nb"),
        ("<p title=it's>Hello there.</p><p>It doesn't stop.</p>", "Hello there.\nIt doesn't stop."),
        ('<p a="unclosed>a</p><p>b</p>', "a\nb"),
        ('<a href="x>y">a</a> <b class=q"r>b</b>', "a b"),
        ("<p hidden>n</p><p HIDDEN=''>n</p><p hidden=until-found>a</p><p style='Display : none'>n</p><p aria-hidden=\"true\">n</p><p data-hidden=1 data-class='ad'>b</p>", "a\nb"),
        ('<div id="comments"><article><p>n</p></article></div><div role="navigation">n</div><div role="main"><p class="AD">n</p>a</div>', "a"),
        ('<aside><article>n</article></aside><article>a<nav>n</nav></article>', "a"),
        ('<nav>n</nav><div class="share"><p>a</p></div>', "a"),
        ('<div class="menu">n</div><p>a &amp;amp; b</p>', "a &amp; b"),
    ],
)
def test_marks_are_read_as_html_says(page, text):
    assert html.main_text(html.blocks(page), None)[0] == text


def test_a_part_of_a_class_leaves_it_to_the_neighbour():
    page = '<article><p>own {0}</p><div class="share-bar"><p>tell a friend</p></div><div class="share-price"><p>up by {0}</p></div></article>'
    one, two = (html.blocks(page.format(i)) for i in (1, 2))
    assert html.main_text(one, two)[0] == "own 1\nup by 1"


def shared(a, b):
    """Places of a that the first longest common subsequence holds, from the full table."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if x[i] == y[j] else max(t[i + 1][j], t[i][j + 1])
    found, i, j = {*range(head), *range(len(a) - tail, len(a))}, 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            found.add(head + i)
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def test_pairing_and_text_match_brute_force(spark):
    """Pages are made of lines whose kind is known; the brute force never sees the markup."""
    rng = random.Random(4)
    wrap = {"plain": "<p>{}</p>", "nav": "<nav>{}</nav>", "ad": '<div class="x ad">{}</div>', "article": "<article><p>{}</p></article>"}
    pages = []
    for i in range(400):
        host, path = f"h{i % 5}.x", rng.choice([f"/a/{rng.randrange(30)}", f"/b/c/{rng.randrange(30)}", f"/i?id={rng.randrange(40)}", "/same"])
        lines = [(rng.choice(["plain", "plain", "article", "nav", "ad"]), f"line {rng.randrange(60)} of the site {host}") for _ in range(rng.randrange(0, 12))]
        if pages and rng.random() < 0.3:
            lines = list(rng.choice(pages)[3])
        pages.append((i, host, path, lines))
    rows = [(i, f"http://{h}{p}", "".join(wrap[k].format(t) for k, t in ls), "t") for i, h, p, ls in pages]

    def copy(a, b):
        u, v = (Counter() for _ in range(2))
        for c, ls in ((u, a[3]), (v, b[3])):
            for k, t in ls:
                c[t] += len(t) * (k in ("plain", "article"))
        longer = max(u.total(), v.total())
        return a[1] == b[1] and (a[2] == b[2] or (longer > 0 and (u & v).total() >= 0.9 * longer))

    order = sorted(pages, key=lambda p: (p[1], p[2], p[0]))
    runs = []
    for p in order:
        if runs and copy(runs[-1][-1], p):
            runs[-1].append(p)
        else:
            runs.append([p])
    want = {}
    for k, run in enumerate(runs):
        for p in run:
            best = None
            for r in (runs[k - 1][-1] if k else None, runs[k + 1][0] if k + 1 < len(runs) else None):
                if r is not None and r[1] == p[1] and not copy(p, r):
                    near = next((n for n, (x, y) in enumerate(zip(p[2].split("/"), r[2].split("/"))) if x != y), min(p[2].count("/"), r[2].count("/")) + 1)
                    if best is None or near > best[0]:
                        best = near, r
            gone = shared([t for _, t in p[3]], [t for _, t in best[1][3]]) if best else set()
            least = {"plain", "article"} if any(c in ("plain", "article") for c, _ in p[3]) else {"ad"}
            want[p[0]] = "\n".join(t for n, (c, t) in enumerate(p[3]) if c in least and (c == "article" or n not in gone))
    for n in (1, 9):
        got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(n)).collect()}
        assert got == want
    assert len({k for k, _, p, _ in pages if p.startswith("/i?")}) and any(want[i] for i in want)


def test_many_long_pages_of_one_path(spark):
    rows = [(i, "http://h.x/i?id=1", "<div>Menu</div>" + "".join(f"<p>line {j} of page {i % 3}</p>" for j in range(800))) for i in range(60)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)).collect()
    assert len(got) == 60
    assert all(r.text == "Menu\n" + "\n".join(f"line {j} of page {r.page_id % 3}" for j in range(800)) for r in got)
