import html
import math
import random
import re

from pressloom.llm import htmltext
from pressloom.llm.htmltext import main_text


def test_article_without_its_surroundings():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head>
    <body class="has-sidebar"><header>Site name</header><nav><ul><li><a href=/>Home</a></ul></nav>
    <div class="cookie-notice">We use cookies on this site, and more of them.</div><!-- <p>no</p> -->
    <main><article><header><h1>A  title</h1></header><p>First   paragraph with <b>bold</b> and <a href=x>a link</a>&nbsp;&amp; more, a < b.
    <p>Short.<ul><li>one<li>two</ul><form><input><p>Subscribe to our letter</form></article>
    <section id="comments"><p>I like this a lot, it is a very good text indeed.</p></section></main>
    <aside>Other stories you may like</aside><footer>&copy; all</footer>"""
    assert main_text(page).split("\n\n") == ["A title", "First paragraph with bold and a link & more, a < b.", "Short.", "one", "two"]


def test_broken_and_empty():
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == main_text("<script>x") == ""
    assert main_text("plain &lt;text&gt; &am") == "plain <text> &am"
    assert main_text("<p>one</b></div><p>two<br>three<di") == "one\n\ntwo three"
    assert main_text("<div>" * 20_000 + "deep") == "deep"
    assert main_text("<p>" + "word " * 100_000) == ("word " * 100_000).strip()
    assert main_text('<body><div title="a > b">text</div><img alt=x src="y"/></body>') == "text"


TEXT = "some words of an article that goes on and on " * 6
ARTICLE = "<h1>A title</h1>" + "".join(f"<p>{n} {TEXT}</p>" for n in range(5))
FOUND = ["A title", *(f"{n} {TEXT.strip()}" for n in range(5))]


def test_density_decides_on_pages_without_telling_names(monkeypatch):
    links = "".join(f"<div><a href=/{n}>Link {n}</a></div>" for n in range(12))
    page = f"<body><div>{links}</div><div><div>{ARTICLE}</div></div><div>{links}</div></body>"
    assert main_text(page).split("\n\n") == FOUND
    monkeypatch.setattr(htmltext.Page, "content", lambda self: [True] * len(self.tag))
    assert "Link 3" in main_text(page)


def test_names_do_not_cost_the_article():
    for name in ('class="post notice-board"', 'id="share-of-voters"', "class=content", "class=related"):
        page = f"<body><div {name}>{ARTICLE}</div><div class=cookie-notice>We use cookies on this site.</div></body>"
        assert main_text(page).split("\n\n") == FOUND
    page = f"<article>{ARTICLE}<p class='ad-hoc-report'>The report.</p><div class=ad>Buy this now</div></article>"
    assert main_text(page).split("\n\n") == [*FOUND, "The report."]


def test_elements_in_a_line():
    assert main_text("<p>one <img src=x> two<script>3</script> <picture><source><img></picture>three <button>b</button>four</p>") == "one two three four"


def test_stray_end_tags_in_deep_nesting():
    assert main_text("<div>" * 50_000 + "x</b></i></span>" * 50_000) == "x" * 50_000


def test_densities_of_random_trees():
    """Every element's density, counted from its own subtree."""
    random.seed(4)

    def tree(depth):
        inside = "".join(tree(depth - 1) for _ in range(random.randint(0, 3))) if depth else ""
        text = "word" * random.randint(0, 30)
        return random.choice(["<div>{}{}</div>", "<section class=ad>{}{}</section>", "<a>{}{}</a>", "<div>{}<b>{}</b></div>"]).format(text, inside)

    for _ in range(60):
        page = htmltext.Page(f"<body>{tree(4)}{tree(4)}</body>")
        density, body = page.densities()
        n = len(page.tag)

        def up(i, page=page):
            return [] if i < 0 else [i, *up(page.parent[i], page)]

        inside = [{j for j in range(n) if i in up(j)} for i in range(n)]

        def counts(i, page=page, inside=inside):
            links = [any(page.tag[u] == "a" for u in up(j, page)) for j in range(len(page.tag))]
            sizes = [(node, len(t)) for node, _, t in page.texts if node in inside[i]]
            own = inside[i] - {i}
            return (
                sum(s for _, s in sizes), max(1, len(own)), sum(s for node, s in sizes if links[node]),
                max(1, sum(page.tag[j] == "a" for j in own)),
            )

        c_body, _, lc_body, _ = counts(body)
        for i in range(n):
            c, t, lc, lt = counts(i)
            wanted = 0.0
            if c:
                lc = max(1, lc)
                base = math.log(c / max(1, c - lc) * lc + lc_body / max(1, c_body) * c + math.e)
                wanted = c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(base)) if base > 1 else 0.0
                wanted *= 0.1 if any(page.doubtful[u] for u in up(i)) else 1
            assert math.isclose(density[i], wanted, rel_tol=1e-9, abs_tol=1e-12)


def test_sample_pages(spark):
    """The articles of the sample, cut out by their tags."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    found = {r.page_id: r.text for r in htmltext.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    assert len(found) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert found[r.page_id] == "\n\n".join(filter(None, blocks))


def test_empty_table(spark):
    df = spark.createDataFrame([(1, None, "x")], "page_id int, html string, text string")
    assert [tuple(r) for r in htmltext.extract(df).collect()] == [(1, None, "")]
    assert htmltext.extract(df.limit(0)).count() == 0
