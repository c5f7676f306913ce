import random
import re
import time
from html import unescape

import pytest

from diurna.llm import htmlmain as hm

SCHEMA = "page_id long, url string, html string"
WORDS = "ala bori cena dult evan foti grum hesk ilno jarp".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n)) + f" {r.randrange(10**6)}."


def extracted(spark, rows):
    return {r.page_id: r.text for r in hm.extract(spark.createDataFrame(rows, SCHEMA)).collect()}


def matched(one, other):
    """Size of the largest matching, by the textbook recursion over all pairs of children."""
    a, ac = hm.tree_of(one)
    b, bc = hm.tree_of(other)

    def w(x, y):
        if a[x] != b[y]:
            return 0
        m = [[0] * (len(bc[y]) + 1) for _ in range(len(ac[x]) + 1)]
        for i, c in enumerate(ac[x], 1):
            for j, d in enumerate(bc[y], 1):
                m[i][j] = max(m[i - 1][j], m[i][j - 1], m[i - 1][j - 1] + w(c, d))
        return m[-1][-1] + 1

    return w(0, 0)


def random_layout(r, n):
    taken, lines = set(), []
    for _ in range(n):
        p, label = r.randrange(len(lines) + 1), r.choice("abcdef")
        if (p, label) not in taken:
            taken.add((p, label))
            lines.append(f"{p} {label}")
    return "\n".join(lines)


def test_tree_matching_is_the_largest_one():
    r = random.Random(4)
    for _ in range(300):
        one, other = random_layout(r, r.randrange(0, 25)), random_layout(r, r.randrange(0, 25))
        got = hm.match_trees(one, other)
        assert sum(p >= 0 for p in got) == matched(one, other)
        (a, ac), (b, bc) = hm.tree_of(one), hm.tree_of(other)
        for x, children in enumerate(ac):  # labels, parents and order hold
            partners = [got[c] for c in children if got[c] >= 0]
            assert all(a[c] == b[got[c]] and got[c] in bc[got[x]] for c in children if got[c] >= 0)
            assert partners == sorted(partners, key=bc[got[x]].index if got[x] >= 0 else None)


def test_many_siblings_are_matched_in_linear_time():
    one = "\n".join(f"0 x{i}" for i in range(20_000))
    began = time.perf_counter()
    assert hm.match_trees(one, "\n".join(f"0 x{i}" for i in range(1, 20_001))).count(-1) == 1
    assert time.perf_counter() - began < 5


def test_test_tables_against_their_one_form(spark):
    """The tables' pages have one known frame, so a plain pattern finds the article."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    got = {r.page_id: (r.text, r.n_chars) for r in hm.extract(pages).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}


def test_constant_nodes_of_a_host_are_template(spark):
    """No names tell the frame here: only that it is the same on the host's pages does."""
    r = random.Random(5)
    rows, want = [], {}
    for i in range(12):
        body = [prose(r, 20) for _ in range(r.randrange(1, 6))]
        extra = "<section class='x9'><p>Known for honest bread</p></section>" if i % 3 else ""
        rows.append((i, f"http://a.example/{i}", f"<body><div class='k1'>All about bread</div>{extra}<div class='k2'>{''.join(f'<p>{b}' for b in body)}</div><div class='k3'>Written in the old mill</div></body>"))
        want[i] = "\n\n".join(body)
    # the same frame on a host with two contents only, one of them copied, tells nothing
    for i in range(12, 20):
        rows.append((i, f"http://b.example/{i}", f"<body><div class='k1'>All about bread</div><div class='k2'><p>{i % 2} ala bori</div></body>"))
        want[i] = f"All about bread\n\n{i % 2} ala bori"
    assert extracted(spark, rows) == want


def test_copies_of_an_article_stay(spark):
    page = "<body><nav>{0}</nav><article><h1>Bread</h1><p>One loaf.</p><p>Two loaves.</p></article><footer>{0}</footer>"
    rows = [(i, "http://c.example/", page.format(i)) for i in range(9)]
    near = [(i, "http://d.example/", page.format(i).replace("Two", f"{i}")) for i in range(20, 24)]
    got = extracted(spark, rows + near)
    assert {got[i] for i in range(9)} == {"Bread\n\nOne loaf.\n\nTwo loaves."}
    assert [got[i] for i in range(20, 24)] == [f"Bread\n\nOne loaf.\n\n{i} loaves." for i in range(20, 24)]


CASES = {
    "<article>a &amp; b&nbsp;&#233;<br>c\n\t d<p>e</article>": "a & b é c d\n\ne",
    "<article><p>one <b>two</b><i>three</i> <!-- x > y --> four</p><script>var t='</p>'</script><style>p{}</style>five</article>": "one twothree four\n\nfive",
    "<body><header>Site</header><div class='cookie-banner'>ok?</div><main><p>x</p></main><aside>y</aside></body>": "x",
    "<article><header><h1>T</h1></header><p>x</p><form>f<input></form><section id='comments'><article>me too</article></section></article>": "T\n\nx",
    "<div class='ad-slot'>buy</div><p>plain <a href='/'>li</a></p><ul><li><a href='/'>all link</a><li><a href='/b'>more</a></ul>": "plain li",
    "<article><ul><li>one<li>two<ul><li>deep</ul><li>three</ul><table><tr><td>a<td>b<tr><td>c</table></article>": "one\n\ntwo\n\ndeep\n\nthree\n\na b\n\nc",
    "<article><p title='a > b' class=x>t</p></article": "t",
    "<b>x<article><p>y</b>z</p>w</article>": "yz\n\nw",
    "a < b <i>c</i> <3 &lt;p&gt;": "a < b c <3 <p>",
    "<article>only <textarea>typed</textarea><noscript>no</noscript></article> tail": "only",
    "<script>never closed <p>x</p>": "",
    "<!-- never closed <p>x</p>": "",
    "": "",
    "   ": "",
    None: "",
}


def test_cases(spark):
    rows = [(i, f"http://h{i}.example/", h) for i, h in enumerate(CASES)]
    assert extracted(spark, rows) == dict(enumerate(CASES.values()))


def test_odd_rows(spark):
    html = "<article><p>x</p></article>"
    rows = [(1, None, html, "t", 5), (None, "no host", html, None, None), (2, "http://e/", None, "t", 5), (2, "http://e/", html, "t", 5), (2, "http://e/", html, "t", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, `host.x` int")
    out = hm.extract(df)
    assert out.columns == ["page_id", "url", "host.x", "text", "n_chars"]
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in out.collect()) == [(0, "no host", "x", 1), (1, "", "x", 1), (2, "http://e/", "", 0), (2, "http://e/", "x", 1), (2, "http://e/", "x", 1)]
    assert hm.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html",
    ["<div>" * 100_000 + "x", "<b>" * 100_000 + "x" + "</i>" * 100_000, "<p>x" * 200_000, "<a " * 200_000, "<p title='" * 100_000, "<!--" * 100_000, "&" * 300_000, "<div class=c{}>y</div>".format("{}") * 1],
    ids=["deep", "inline", "many", "unclosed", "quotes", "comments", "references", "plain"],
)
def test_hostile_pages_take_linear_time(html):
    began = time.perf_counter()
    page = hm.Page(html)
    hm.match_trees(page.layout(), page.layout())
    assert time.perf_counter() - began < 5
