import random

from leadloom.llm import page_diff as pd_


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_common_is_a_longest_common_subsequence():
    rnd = random.Random(3)
    for _ in range(1500):
        a, b = ([rnd.choice("abcdef") for _ in range(rnd.randint(0, 25))] for _ in range(2))
        got = pd_.common(a, b)
        rest = iter(b)
        assert len(got) == lcs(a, b) and all(any(a[i] == y for y in rest) for i in got)
    assert len(pd_.common(["x"] * 20_000 + ["y"], ["z"] + ["x"] * 15_000)) == 15_000


def text(html, *others):
    return pd_.main_text(pd_.read_page(html), [pd_.read_page(o) for o in others])


def test_elements():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body class="menu">
      <header>Site</header><nav><ul><li>Home<li>News</ul></nav><!-- <p>no</p> --><div class="ad">Buy</div><div class='cookie-notice'>We use</div>
      <article><h1>Title &amp; more</h1><p>One<b> two</b>th&eacute;ee<br>four   five&nbsp;six<p>Seven <i>ei</i>ght</p><aside>Side</aside><form>Mail <input></form>
      <section class="comments"><p>First!</p></section><div>Ni&#110;e</div></article><footer>&copy; me</footer></body></html>"""
    assert text(page) == "Title & more One twothéee four five six Seven eight Nine"
    assert text("<main><p>a</p><div id=sidebar>x</div>b</main><p>c") == "a b"
    assert text("") == "" and text("plain words") == "plain words"
    assert text("<article><p>torn <b>te") == "torn te" and text("<article><p>torn</p><p cla") == "torn"
    assert text("<article>5 < 6 &lt; 7</article>") == "5 < 6 < 7"
    assert text("<p>" * 20_000 + "deep") == "deep"


def test_self_closing_elements_are_empty():
    assert text('<article>a <svg class="icon"/>b<p>c</p><math/> d <svg><path d="x"/></svg>e <svg a="1>2" hidden\n/>f</article>') == "a b c d e f"
    assert text("<article>a <svg href=/x/>no</svg>b <script src=x />no</script>c</article>") == "a b c"
    assert text("<article>a <svg " + "x=1 / " * 20_000) == "a"


def test_difference_without_an_article_element():
    page = "<div>Top bar</div><p>{}</p><p>All rights reserved</p>"
    one, two, three = (page.format(t) for t in ("The first story is long.", "Another story.", "The first story is long."))
    assert text(one, two) == "The first story is long."
    # A copy shares nearly all and shows no template; the next neighbour does.
    assert text(one, three, two) == "The first story is long."
    assert text(one, three) == "Top bar The first story is long. All rights reserved"


def test_articles_keep_lines_that_they_share():
    page = "<div>Top bar</div><article><p>{}</p><p>A quoted line.</p></article>"
    one, two = (page.format(t) for t in ("The first story.", "Another story."))
    assert text(one, two) == "The first story. A quoted line." and text(two, one) == "Another story. A quoted line."


def test_rows(spark):
    page = "<div>Top bar</div><p>Story number {} is told here</p><p>All rights reserved</p>"
    rows = [(i, f"https://h.example/en/{i:03d}?x={i}", page.format(i)) for i in range(40)]
    rows += [(100, "https://alone.example/a", page.format(100)), (101, None, page.format(101)), (102, "https://h2.example/", None), (103, "not a url", ""),
             (None, "https://h3.example/q", "<article>Z</article>"), (None, "https://h3.example/q", "<article>Z</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as path", "3 as text").repartition(5).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    got = pd_.extract(df).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert all(by_id[i] == f"Story number {i} is told here" for i in range(40))
    assert by_id[100] == "Top bar Story number 100 is told here All rights reserved"
    assert by_id[101] == "Top bar Story number 101 is told here All rights reserved"
    assert by_id[102] == by_id[103] == "" and by_id[None] == "Z"
    assert pd_.extract(df.limit(0)).collect() == []


def test_copies_and_long_templates(spark):
    short = "<div>Top bar</div><p>{}</p><p>All rights reserved</p>"
    long = "<div>" + "The bar " * 20 + "</div><p>Tale {}.</p><p>" + "All rights " * 20 + "</p>"
    rows = [(i, f"https://a.example/{i:02d}", short.format("One story" if 2 <= i < 8 else f"Story {i}")) for i in range(10)]
    rows += [(i, f"https://b.example/{i:02d}", long.format(i)) for i in range(20, 26)]
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    got = {r.page_id: r.text for r in pd_.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {i: "One story" if 2 <= i < 8 else f"Story {i}" for i in range(10)} | {i: f"Tale {i}." for i in range(20, 26)}
    # A revision is passed over where another page is a witness.
    story = "The same long story. " * 20
    assert text(short.format(story + "<p>New"), short.format(story + "<p>Old"), short.format("Other")) == story.strip() + " New"


def test_a_line_that_articles_of_four_neighbours_repeat_is_template():
    def page(i, notice="Read our new terms of use."):
        return f"<html><body><article><p>Words of article {i}, which no other page of this host has said before, and which go on for as long as it takes to be far longer than any notice would be.</p><p>{notice}</p></article></body></html>"

    plain = "Words of article 0, which no other page of this host has said before, and which go on for as long as it takes to be far longer than any notice would be."
    assert text(page(0), *map(page, range(1, 5))) == plain
    assert text(page(0), *map(page, range(1, 4))) == f"{plain} Read our new terms of use."  # too few to tell a notice from a quotation
    assert text(page(0), page(1, "Other."), *map(page, range(2, 5))) == f"{plain} Read our new terms of use."
    assert text(page(0, "A"), *(page(0, x) for x in "BCDEF")) == f"{plain} A"  # revisions are no witnesses


def test_article_lines_are_differenced_over_a_table(spark):
    words = "the words of an article that no other page of this host has ever said, and that are far longer than a notice, number"
    rows = [(i, f"http://h/{i:03}", f"<article><p>{words} {i}</p><p>Read our new terms.</p></article>") for i in range(40)]
    got = pd_.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    assert sorted((r.page_id, r.text) for r in got) == [(i, f"{words} {i}") for i in range(40)]
