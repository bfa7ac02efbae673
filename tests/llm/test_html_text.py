import pyarrow as pa
import pytest

from jurybox.llm import html_text as ht


def text_of(page, templates=()):
    texts, plain, elements = ht.parse(page)
    gone = [e for e, h in ht.subtree_hashes(plain, elements) if h in templates]
    return ht.article_text(texts, elements, gone + [e for e in elements if e.dropped])


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain  text", "plain text"), ("<article><h1>T</h1><p>a<br>b</p></article>", "T a b"),
    ("<nav>menu</nav><article><p><b>one<br><p>two</p></article><footer>f</footer>", "one two"),
    ("<article>a<script>var t='</p>';</script>b<style>p{}</style></article>x", "ab"),
    ("<article><p>x &amp; y&nbsp;&#233; &am</p></article>", "x & y é &am"),
    ("<body><div class='side-bar sidebar'>s</div><p>kept</p><form>f</form></body>", "kept"),
    ("<article><p>a</p><aside>b</aside><div class=\"ad\">c</div></article><section id=comments><article class=comment>d</article></section>", "a"),
    ("<article><p title=\"a>b\">q</p><!-- x > y --><ul><li>1<li>2</ul></article>", "q 1 2"),
    ("<article><p>open", "open"), ("<article><p>cut <a href='x", "cut"), ("a < b <3 c", "a < b <3 c"),
    ("<article>w<b>o</b>r<i>d</i></article>", "word"), ("<title>t</title><p>body</p>", "body"),
    ("<main><h2>m</h2></main><p>out</p>", "m"), ("<div>" * 3000 + "deep", "deep"),
    ("<form><label>l</label><article><h1>T</h1><p class='related-work'>a</p></article><input><button>go</button></form>", "T a"),
    ("<article><p class=related>gone</p><p>b</p></article>", "b"), ("<p>" + "long " * 50000, ("long " * 50000).strip()),
])
def test_parse(page, want):
    assert text_of(page) == want


def pages(table, rows):
    return table({"page_id": pa.int64(), "url": pa.string(), "html": pa.string()}, page_id=[r[0] for r in rows], url=[r[1] for r in rows],
                 html=[r[2] for r in rows], host=["h"] * len(rows), text=["t"] * len(rows), templates=[1] * len(rows))


def test_recurring_subtrees_go(table):
    rows = [(i, f"http://U@Site.example:80/{i}", f"<body><div><span>Our site since 1999</span></div><div>own words {i}</div></body>") for i in range(10)]
    rows += [(20, "http://other.example/", "<body><div><span>Our site since 1999</span></div></body>"), (21, None, "<div>no host</div>"), (22, "x", None)]
    got = {r.page_id: r for r in ht.extract_text(pages(table, rows)).collect()}
    assert got[3].text == "own words 3" and got[20].text == "Our site since 1999" and got[21].text == "no host" and got[22].text == ""
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_article_prose_is_no_template(table):
    rows = [(i, "http://a.example/", "<nav>n</nav><article><p>the same passage</p><p>x</p></article>") for i in range(12)]
    assert {r.text for r in ht.extract_text(pages(table, rows)).collect()} == {"the same passage x"}


def brute_templates(rows):
    """Subtrees beside at least MIN_PAGES different longest article blocks, counted page by page."""
    beside = {}
    for _, url, page in rows:
        texts, plain, elements = ht.parse(page)
        sign = ht.article_sign(texts, elements)
        for _, h in ht.subtree_hashes(plain, elements):
            beside.setdefault((url.split("/")[2], h), set()).add(sign)
    return {key for key, signs in beside.items() if len(signs) >= ht.MIN_PAGES}


@pytest.mark.parametrize("limit", [ht.BROADCAST_BYTES, -1])
def test_copies_keep_their_article(table, monkeypatch, limit):
    monkeypatch.setattr(ht, "BROADCAST_BYTES", limit)
    menu = "<div><span>All about us</span></div>"
    copy = menu + "<article><h1>T0</h1><div class='content'><p>one body of many words</p><p>more of it</p></div></article>"
    rows = [(i, f"http://c.example/{i}", copy) for i in range(10)]
    rows += [(10 + i, f"http://c.example/{i}", menu + f"<article><h1>T{i}</h1><div class='content'><p>own text {i}</p></div></article>") for i in range(90)]
    # A rotating notice: each of 5 variants beside ten articles, a small share of the host.
    rows += [(100 + i, "http://n.example/", f"<div><b>notice {i % 5}</b></div><div>page {i}</div>") for i in range(50)]
    rows += [rows[0]] * 3
    df = pages(table, rows)
    got = {r.page_id: r.text for r in ht.extract_text(df.repartition(4)).collect()}
    assert got[0] == "T0 one body of many words more of it" and got[15] == "T5 own text 5"
    assert [got[100 + i] for i in range(50)] == [f"page {i}" for i in range(50)]
    assert {(r.host, r.hash) for r in ht.host_templates(df).collect()} == brute_templates(rows)


def test_shuffled_join_and_empty(table, monkeypatch):
    monkeypatch.setattr(ht, "BROADCAST_BYTES", -1)
    rows = [(i % 3, "http://s.example/", f"<div>footer line</div><div>page {i}</div>") for i in range(9)]
    assert sorted(r.text for r in ht.extract_text(pages(table, rows)).collect()) == [f"page {i}" for i in range(9)]
    assert ht.extract_text(pages(table, [])).count() == 0
