import html as escapes

from epitide.llm.pages import host, main_text, page_blocks

SCHEMA = "page_id long, url string, html string, host string, node long"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 0) for i, u, h in rows], SCHEMA)


def texts(spark, rows):
    return {r.page_id: r.text for r in main_text(table(spark, rows)).collect()}


def test_article_without_the_rest(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
      <header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>ad</p> --><div class="ad">Buy</div>
      <div class="cookie-notice">Cookies</div><article><h1>Head &amp; line</h1><p>One
      two &lt;b&gt; <b>bold</b> three&nbsp;four<br>five<p>Next &#233;t&eacute;<form><input value="x">Sign</form>
      <div class="comments"><p>Nice!</p></div><ul><li>a<li>b</ul></article><aside>Side</aside><footer>&copy; me</footer></body>"""
    assert texts(spark, [(1, "http://h.org/1", page)]) == {
        1: "Head & line\n\nOne two <b> bold three four five\n\nNext été\n\na\n\nb"}


def test_entropy_decides_where_names_do_not(spark):
    """No element says what it is: what a host repeats goes, what differs stays."""
    rows = []
    for i in range(40):
        body = "".join(f"<p>text {i} part {j} of its own</p>" for j in range(3))
        rows.append((i, f"http://one.org/{i}", f"<body><div class='x1'>Welcome to this place</div><div class='x2'>{body}</div>"
                     f"<div class='x3'>Call {i % 2}</div></body>"))
    rows += [(50 + i, f"http://few.org/{i}", "<body><div class='x1'>Welcome to this place</div></body>") for i in range(4)]
    rows.append((99, "http://other.org/", "<body><div class='x1'>Welcome to this place</div></body>"))
    got = texts(spark, rows)
    for i in range(40):
        assert got[i] == "\n\n".join(f"text {i} part {j} of its own" for j in range(3))
    assert got[99] == got[50] == "Welcome to this place"


def test_edge_rows(spark):
    rows = [(1, None, None), (2, "", ""), (None, "http://h/", "<p>x</p>"), (4, "http://h/", "plain &amp; simple"), (4, "http://h/", "plain &amp; simple"),
            (5, "no url", "<article>" + "<p>para</p>" * 3 + "<p>" + "y " * 50_000)]
    got = main_text(table(spark, rows)).collect()
    assert len(got) == 6
    by = {r.page_id: r.text for r in got}
    assert by[1] == by[2] == "" and by[None] == "x" and by[4] == "plain & simple"
    assert by[5] == "para\n\npara\n\npara\n\n" + "y " * 49_999 + "y"
    assert main_text(table(spark, [])).count() == 0


def test_broken_markup():
    assert [b["text"] for b in page_blocks("<p><b>a<br><p>b</b></i></p></div><table><tr><td>c<td>d</table>e<")] == ["a", "b", "c", "d", "e<"]
    assert [b["text"] for b in page_blocks("x<script>if (a</p>b) {}")] == ["x"]
    nested = page_blocks("<div>" * 3000 + "deep" + "</div>" * 3000)
    assert [b["text"] for b in nested] == ["deep"]
    many = escapes.escape("a < b & c") * 3
    assert page_blocks(f"<p>{many}</p>")[0]["text"] == "a < b & c" * 3


def test_host(spark):
    from pyspark.sql import functions as F
    urls = ["http://A.org/x", "https://u:p@b.org:80?q", "c.org/x", None, "ftp://d.org#f"]
    got = [r.h for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host(F.col("u")).alias("h")).collect()]
    assert got == ["a.org", "b.org", "", "", "d.org"]


def test_a_name_does_not_empty_a_page_with_an_article(spark):
    article = "<article><p>All of it</p><div class='comments'><p>Nice!</p></div></article>"
    pages = [f"<body class='no-sidebar'>{article}</body>", f"<html id='page-search'><body>{article}</body></html>",
             f"<body><div class='widget-area content'>{article}</div></body>",
             f"<body><div class='has-nav'><div class='site-header'><h1>Name</h1></div><div id='login-wrap'>{article}</div></div></body>",
             "<body><main class='has-sidebar'><p>All of it</p></main></body>",
             "<body><article><p>All of it</p></article><div class='comments'><article class='comment'>Nice!</article></div></body>"]
    got = texts(spark, [(i, f"http://h{i}.org/", page) for i, page in enumerate(pages)])
    assert got == {i: "All of it" for i in range(len(pages))}


def test_copies_of_a_page_count_once(spark):
    """Copies are no boilerplate: neither alone on a host nor as a third of its pages."""
    page = "<body><div class='x1'>Welcome to this place</div><div class='x2'><p>text {}</p></div></body>"
    rows = [(i, "http://alone.org/copy", page.format("of copies")) for i in range(20)]
    rows += [(100 + i, f"http://third.org/{i}", page.format(max(i, 40))) for i in range(120)]
    got = texts(spark, rows)
    assert len(got) == 140
    assert all(got[i] == "Welcome to this place\n\ntext of copies" for i in range(20))
    assert all(got[100 + i] == f"text {max(i, 40)}" for i in range(120))


def test_repeated_branch_inside_an_article(spark):
    """An article loses what its host repeats on all of many pages; on few pages repetition says little."""
    page = "<article><p>text {} of its own</p><div class='x7'>Rate this text</div></article>"
    rows = [(i, f"http://many.org/{i}", page.format(i)) for i in range(40)]
    rows += [(100 + i, f"http://few.org/{i}", page.format(i)) for i in range(3)]
    got = texts(spark, rows)
    assert all(got[i] == f"text {i} of its own" for i in range(40))
    assert all(got[100 + i] == f"text {i} of its own\n\nRate this text" for i in range(3))


def test_importance_moves_gradually_with_the_pages(spark):
    """A repeated branch loses importance with every page, without a jump at some number of pages."""
    from pyspark.sql import functions as F

    from epitide.llm.pages import style_tree
    rows = [(f"h{m}", 1, 2, True, True, 3, 0.5) for m in range(2, 30) for _ in range(m)]
    blocks = spark.createDataFrame(rows, "host string, node long, feature long, fresh boolean, first boolean, style long, prior double")
    tree = {r.pages: r.importance for r in style_tree(blocks).orderBy(F.col("pages")).collect()}
    steps = [tree[m] - tree[m + 1] for m in range(2, 29)]
    assert all(0 < s < 0.1 for s in steps) and steps == sorted(steps, reverse=True)


def test_frames_open_menus_and_partial_names(spark):
    """A form around the page, a menu without an end tag and a name with more words than one keep their texts."""
    article = "<article><p>All of it</p><form>Sign</form></article>"
    pages = [f"<body><form id='aspnet'><div class='ad'>Buy</div>{article}<footer>Me</footer></form></body>",
             f"<body><nav><ul><li>Menu</li></ul>{article}<footer>Me</footer></body>",
             f"<body><nav><ul><li>Menu</li></ul><div id='wrap'><div class='menu'>More</div>{article}</div></body>",
             "<body><div class='search-results'><p>All of it</p></div></body>",
             "<body><div class='social-science'><p>All of it</p></div><div class='social-links'>Share</div></body>",
             "<body><section id='header-story'><p>All of it</p><div class='comments-list'>Nice!</div></section></body>",
             "<body><article><p>All of it</p></article><aside><article><p>Teaser</p></article></aside></body>",
             "<body><fieldset><label>Name</label></fieldset><form><p>Sign here</p></form><p>All of it</p></body>"]
    assert texts(spark, [(i, f"http://h{i}.org/", page) for i, page in enumerate(pages)]) == {i: "All of it" for i in range(len(pages))}


def test_partial_names_go_where_a_host_repeats_them(spark):
    """The same name: texts of their own stay, what all pages of the host repeat goes."""
    page = "<body><div class='search-results'><p>text {} of its own</p></div><div class='header-story'><p>Story of the day</p></div></body>"
    got = texts(spark, [(i, f"http://h.org/{i}", page.format(i)) for i in range(20)])
    assert got == {i: f"text {i} of its own" for i in range(20)}
