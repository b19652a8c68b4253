"""Wrappers of pages, and the text that they give."""

import json

from riskweave.llm import wrappers

PAGES = "page_id long, url string, html string"


def _text(spark, rows):
    return {r["page_id"]: r["text"] for r in wrappers.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_article_without_its_surroundings(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=x>Menu</a></ul></nav>"
        "<header><h2>Site</h2></header><div class='cookie-notice'>We use cookies</div><aside>Side</aside><div class=ad>Buy</div>"
        "<article><h1>Head &amp; line</h1><p>One <b>two</b>\n  three<br>four<p>Five &lt;six&gt;&#233;<ul><li>item 1<li>item 2</ul>"
        "<form>Search <input></form><div class='share'>Share</div><blockquote>quoted</blockquote><!-- hidden <p>no</p> -->"
        "<section class='comments'><article>A reader</article></section></article><footer>&copy; x</footer></body></html>"
    )
    expected = "Head & line\nOne two three four\nFive <six>é\nitem 1\nitem 2\nquoted"
    rows = [(1, "http://a.example/1", page), (2, "http://a.example/2", page.replace("</body></html>", "")), (3, "http://A.example:80/3", page)]
    assert set(_text(spark, rows).values()) == {expected}


def test_main_class_and_plain_pages(spark):
    plain = "<body><div id=menu>Go</div><div><p>Text {0} of a page that has no mark, long enough</p></div><p>Same below</p></body>"
    rows = [(i, "http://p.example/x", plain.format(i)) for i in range(5)]
    rows += [(10, "http://m.example/", "<body><div>beside</div><main><p>in main</p></main></body>")]
    rows += [(11, "http://c.example/", "<body><p>beside</p><div class='post-body entry-content'><p>in post</p></div></body>")]
    got = _text(spark, rows)
    assert got[3] == "Text 3 of a page that has no mark, long enough"
    assert (got[10], got[11]) == ("in main", "in post")


def test_nulls_ties_and_broken_pages(spark):
    long = "<article>" + "".join(f"<p>block {i}</p>" for i in range(5000)) + "</article>"
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "<article>a<"), (3, "not a url", "<article>a<"), (None, "http://x/", "</p></div><article>b"), (5, "http://x/", long), (6, "http://x/", "no tags")]
    df = spark.createDataFrame(rows, PAGES).selectExpr("*", "'h' AS host", "1 AS text", "array('p') AS paths")
    out = wrappers.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in out.collect()]
    assert all(n == len(t) for _, t, n in got)
    texts = {i: t for i, t, _ in got}
    assert len(got) == 7 and (texts[1], texts[2], texts[3], texts[None]) == ("", "", "a<", "b")
    assert texts[5] == "\n".join(f"block {i}" for i in range(5000))
    assert wrappers.extract(df.where("false")).collect() == []


def test_expression_has_optional_and_repeated_groups():
    a = wrappers.Page("<body><nav><a>x</a></nav><article><h1>t</h1><p>1</p><p>2</p></article></body>").pattern
    b = wrappers.Page("<body><article><h1>t</h1><p>1</p></article><footer>f</footer></body>").pattern
    c = wrappers.Page("<body><article><h1>t</h1><h2>s</h2><p>1</p><h2>s</h2><p>1</p></article></body>").pattern
    whole = wrappers.merge(wrappers.merge(a, b), c)
    text = wrappers.expression(whole)
    # The heading is the same on all three pages: a literal.
    assert text.startswith('<body>(<nav>#</>)?<article><h1>"</>') and text.endswith("(<footer>#</>)?</>")
    assert "(<h2>#</><p>#</>)*" in text and "(<p>#</>)" in text
    assert json.loads(json.dumps(whole)) == whole


def test_parts_do_not_change_the_text(spark):
    rows = [(i, "http://h.example/", "<body>" + "<div>x</div>" * (i % 7) + f"<article><p>t{i}</p></article></body>") for i in range(40)]
    pages = spark.createDataFrame(rows, PAGES).selectExpr("page_id", "html", "'h.example' AS host")
    one, many = (wrappers.infer(pages, most).collect() for most in (256, 2))
    assert len(one) == len(many) == 1
    for i, _, source in rows:
        assert [wrappers.main_text(source, json.loads(got[0]["tree"])) for got in (one, many)] == [f"t{i}"] * 2


def _unmarked(i, name, menu="Home"):
    """A page without any telling tag or name: menu, notice, text with parts that some pages lack, links, foot."""
    sub = f"<div>Part of {i}</div><div>More about the part of {i}</div>" if i % 3 else ""
    links = "".join(f"<div><a href=/{k}>Read page {i * 7 + k} as well</a></div>" for k in range(4))
    body = "".join(f"<div>Sentence {k} of page {i}, which is long enough to weigh.</div>" for k in range(2 + i % 4))
    return (
        f"<body><div class={name()}><div class={name()}>{menu}</div><div>Contact</div></div><div id={name()}>All rights reserved, always.</div>"
        f"<div class={name()}><h2>Title {i}</h2>{body}{sub}</div><div class={name()}>{links}</div><div>Made by us</div></body>"
    ), "\n".join([f"Title {i}", *(f"Sentence {k} of page {i}, which is long enough to weigh." for k in range(2 + i % 4)), *([f"Part of {i}", f"More about the part of {i}"] if i % 3 else [])])


def test_the_wrapper_decides_where_no_name_does(spark):
    import random

    words = ["".join(random.Random(k).choices("bcdfgkmpqvxz", k=9)) for k in range(6)]
    names = lambda: (w for w in words)
    rows, expected = [], {}
    for i in range(24):
        given = names()
        page, expected[i] = _unmarked(i, lambda: next(given))
        rows.append((i, "http://u.example/", page))
    assert _text(spark, rows) == expected
    # Without the other pages there is no template: the same page alone gives its menu and foot as well.
    alone = _text(spark, [(0, "http://u.example/", rows[0][2])])[0]
    assert "Contact" in alone and "Made by us" in alone
    # Copies of one page are one page, however many.
    assert set(_text(spark, [(k, "http://u.example/", rows[0][2]) for k in range(30)]).values()) == {alone}


def test_places_not_paths_tell_template_from_text(spark):
    """Two blocks of one path: the first is a literal on all pages, the second differs."""
    rows = [(i, "http://q.example/", f"<body><p>Same words on every page</p><hr><h3>Head {i}</h3><p>Own words of {i}</p></body>") for i in range(6)]
    assert _text(spark, rows) == {i: f"Head {i}\nOwn words of {i}" for i in range(6)}


def test_template_in_an_article_element_gives_way_to_slots(spark):
    rows = [(i, "http://v.example/", f"<body><article>Welcome to our site</article><div><h2>T {i}</h2><p>Own text of page {i}, of some length</p></div></body>") for i in range(5)]
    assert _text(spark, rows)[3] == "T 3\nOwn text of page 3, of some length"


def test_repeated_groups_match_any_number_of_turns(spark):
    def page(i, turns):
        return "<body><nav>n</nav><article>" + "".join(f"<h2>h{i}.{k}</h2><p>p{i}.{k}</p>" + ("<ul><li>a<li>b</ul>" if (i + k) % 3 == 0 else "") for k in range(turns)) + "</article></body>"

    rows = [(i, "http://r.example/", page(i, i % 6)) for i in range(20)]
    got = _text(spark, rows)
    for i in range(20):
        told = [t for k in range(i % 6) for t in (f"h{i}.{k}", f"p{i}.{k}", *(["a", "b"] if (i + k) % 3 == 0 else []))]
        assert got[i] == "\n".join(told)


def test_longest_common_order_against_brute_force():
    import random
    import time

    dice = random.Random(5)
    for _ in range(300):
        a, b = (["abcd"[dice.randrange(4)] for _ in range(dice.randrange(9))] for _ in range(2))
        pairs = wrappers.common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]
    begun = time.time()
    long = [["abcdefgh"[dice.randrange(8)] for _ in range(4000)] for _ in range(2)]
    assert len(wrappers.common(*long)) > 1500 and time.time() - begun < 5


def test_table_against_an_extraction_of_its_own(spark):
    """The pages of the small table hold one article element each; another parser reads it."""
    import html
    import re
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.parts = False, []

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag in ("h1", "h2", "h3", "p", "ul", "ol", "li", "div", "blockquote", "pre", "table", "tr", "td", "section"):
                self.parts.append("\0")
            elif tag == "br":
                self.parts.append(" ")

        def handle_endtag(self, tag):
            if tag == "article":
                self.inside = False
            if tag not in ("b", "i", "a", "em", "strong", "span", "br"):
                self.parts.append("\0")

        def handle_data(self, data):
            if self.inside:
                self.parts.append(data)

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {(r["page_id"], r["url"]): r["text"] for r in wrappers.extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows) > 100 and html.unescape("&amp;") == "&"
    for r in rows:
        reader = Reader()
        reader.feed(r["html"] or "")
        reader.close()
        blocks = (re.sub(r"\s+", " ", b).strip() for b in "".join(reader.parts).split("\0"))
        assert got[r["page_id"], r["url"]] == "\n".join(b for b in blocks if b)


def test_slashes_in_names_lose_no_text(spark):
    page = "<body><div class='md:w-2/3 w-1/2'><article id='post/12'><h1>Title</h1><div class='w-1/2'><p>Body</p></div></article></div><div class='w-1/2'>beside</div></body>"
    assert _text(spark, [(1, "http://s.example/", page), (2, "http://t.example/", "<body><div class='w-1/2'>Only text</div></body>")]) == {1: "Title\nBody", 2: "Only text"}


def test_self_closing_svg_hides_nothing():
    page = "<body><nav><svg class='i'/>Menu</nav><article><h1><svg />Title</h1><p>One<svg viewBox='0 0 1 1'><g/>drawn</svg></p><p>Two</p></article></body>"
    texts = [text for _, text, _ in wrappers.Page(page).blocks]
    assert texts == ["Menu", "Title", "One", "Two"]
    assert [t for _, t, _ in wrappers.Page("<p><svg/>all</p><p>kept</p>").blocks] == ["all", "kept"]
    assert [t for _, t, _ in wrappers.Page("<p><svg class=i/>drawn</svg>all</p><p>kept</p>").blocks] == ["all", "kept"]
    assert [t for _, t, _ in wrappers.Page("<p><svg>never closed</p><p>kept</p>").blocks][-1] == "kept"


def test_names_of_layout_are_no_asides(spark):
    pages = [
        "<body class='has-sidebar'><nav>n</nav><article><p>text</p></article></body>",
        "<body class='header-fixed'><article><p>text</p></article></body>",
        "<div class='content with-sidebar'><p>text</p><div class='sidebar'>s</div></div>",
        "<article class='post comments-open'><p>text</p><div class='comments'><article class='comment'>c</article></div></article>",
        "<div class='sidebar'><article><p>text</p></article></div><div class='menu'>m</div>",
        "<div class='menu'><main><p>text</p></main></div>",
        "<div class='page--sidebar overflow-hidden'><article><p>text</p></article></div>",
        "<article><p>text</p></article><div id='comments'><article class='comment'>c</article></div>",
        "<div class='entry'><p>text</p></div><div class='related'><article>r</article></div>",
        "<div class='content'><div class='sidebar'><article><p>text</p><div class='share'>s</div></article></div></div>",
        "<body><article><p>text</p></article><div class='cookie-banner'>b</div><div class='is-hidden'>h</div></body>",
    ]
    got = _text(spark, [(i, f"http://h{i}.example/", p) for i, p in enumerate(pages)])
    assert got == dict.fromkeys(range(len(pages)), "text")


def test_copies_of_a_page_are_no_template(spark):
    page = "<body><div>The only text</div></body>"
    assert set(_text(spark, [(i, "http://d.example/", page) for i in range(5)]).values()) == {"The only text"}
    rows = [(i, "http://e.example/", f"<body><h2>Site name</h2><div>Text {i // 2}</div></body>") for i in range(12)]
    assert _text(spark, rows)[4] == "Text 2"


def _words_of(source):
    return [t for _, t, _ in wrappers.Page(source).blocks]


def test_deep_pages_and_open_tags_are_read_in_linear_time(spark):
    import time

    deep = "<div>" * 5000 + "<p>deep text</p>" + "</div>" * 5000 + "<p>after</p>"
    assert _words_of("<article>" + deep + "</article>") == ["deep text", "after"]
    pages = spark.createDataFrame([(i, "http://h/", "<article>" + deep + f"<p>own {i}</p></article>") for i in range(3)], "page_id long, url string, html string")
    assert {r["text"] for r in wrappers.extract(pages).collect()} == {f"deep text\nafter\nown {i}" for i in range(3)}
    begun = time.time()
    for piece in ("<a ", "<a x='", '<a x="', "<!-- ", "</", "<p title='>"):
        wrappers.Page(piece * 40000)
        wrappers.Page(piece * 40000 + ">")
    assert time.time() - begun < 20


def test_broken_quotes_and_comments():
    assert _words_of("<p title=it's>one</p><p a='x>y' b=\">\">two</p>") == ["one", "two"]
    assert _words_of("<p>one</p> tail <b") == ["one", "tail <b"]
    assert _words_of("<p>one</p> tail <!-- open") == ["one", "tail"]
    assert _words_of("<p>one</p><!-- open <p>two</p> three") == ["one"]
    assert _words_of("a < b") == ["a < b"] and _words_of("") == []


def test_ids_inside_an_article_name_its_parts(spark):
    body = "<p>intro</p><section id='related-work'><p>one</p></section><h2 id='discussion'>Two</h2><section id='comments'><p>gone</p></section>"
    pages = spark.createDataFrame([(1, "http://h/1", f"<body><article>{body}</article></body>")], "page_id long, url string, html string")
    assert wrappers.extract(pages).first()["text"] == "intro\none\nTwo"
