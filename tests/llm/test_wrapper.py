"""Wrapper induction: tree matching, extraction, odd cases."""

import html
import re

from tastegrid.llm import wrapper


def tree(text):
    return wrapper.template(wrapper.Shape([wrapper.parse(text)]))


def test_simple_tree_matching():
    a, b = tree("<div><p>a</p><ul><li>x</li></ul></div>"), tree("<div><h1>t</h1><p>b</p><ul><li>y</li><li>z</li></ul></div>")
    assert wrapper.matching(a, b) == 5
    assert wrapper.aligned(a["k"][0]["k"], b["k"][0]["k"]) == [(None, 0), (0, 1), (1, 2)]


def page(title, slot):
    return (f'<html><head><title>{title}</title></head><body><header>Site</header><div class="cookie-notice">We use</div>'
            f'<div class="box">Subscribe now</div><h1>{title}</h1><p>Text {title} one &amp; two<br>three</p><div>{slot}'
            f'<form><input>go</form></div><aside>x</aside><section class="comments"><p>c {title}</p></section></body></html>')


def test_constant_nodes_are_template_and_slots_content(spark):
    rows = [(i, "http://h.example/x", page(f"T{i}", f"slot {i}"), 1, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int, template int")
    for r in wrapper.main_text(df).collect():
        assert r.text == f"T{r.page_id}\nText T{r.page_id} one & two three\nslot {r.page_id}"


def test_articles_of_the_tables(spark):
    folder = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    for r in wrapper.query(spark, folder).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert r.text == want and r.n_chars == len(want)


def test_odd_cases(spark):
    deep = "<div>" * 5_000 + "deep" + "</div>" * 5_000 + "<p>after</p>"
    odd = [(1, None, None), (2, "http://[", ""), (3, "x", "plain &lt;b"), (4, "http://h/", "<p>a<b>c</p>d<script>x"),
           (5, "http://u:p@H:80/", deep), (6, "http://h/", "<p>cut <a href='"), (7, None, "<!-- open"), (7, None, "<!-- open"),
           (None, "http://h/", "<ul><li>a<li>b</ul>"), (8, "http://h/", "<p>" + "word " * 200_000)]
    df = spark.createDataFrame(odd, "page_id bigint, url string, html string")
    got = [(r.page_id, r.text) for r in wrapper.main_text(df).collect()]
    want = [(1, ""), (2, ""), (3, "plain <b"), (4, "ac\nd"), (5, "deep\nafter"), (6, "cut"), (7, ""), (7, ""), (None, "a\nb"),
            (8, ("word " * 200_000).strip())]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert wrapper.main_text(df.limit(0)).count() == 0


def extracted(spark, pages):
    df = spark.createDataFrame([(i, "http://h.example/x", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    return [r.text for r in wrapper.main_text(df).orderBy("page_id").collect()]


def test_story_beside_teaser_articles_is_content(spark):
    pages = [f'<body><div id="story"><h1>Title {i}</h1><p>Story {i} is long enough</p></div><aside><article class="card"><p>a {i}'
             f'</p></article></aside><article class="card"><p>Same teaser</p></article></body>' for i in range(5)]
    assert extracted(spark, pages) == [f"Title {i}\nStory {i} is long enough" for i in range(5)]


def test_constant_notice_in_the_article_is_template(spark):
    pages = [f"<body><article><h1>Title {i}</h1><p>First {i}</p><p>Support <b>our</b> work</p><p>Last {i}</p></article>"
             f"<div>Beside {i}</div></body>" for i in range(5)]
    assert extracted(spark, pages) == [f"Title {i}\nFirst {i}\nLast {i}\nBeside {i}" for i in range(5)]


def test_copies_of_an_article_are_one_page(spark):
    pages = [f'<body><div class="ad">{i}</div><article><h1>Title</h1><p>One</p><p>Two</p></article></body>' for i in range(6)]
    assert extracted(spark, pages) == ["Title\nOne\nTwo"] * 6


def test_pages_without_article(spark):
    pages = [f"<body><div><p>Welcome to the site</p><p>Story {i}</p></div><div><p>Imprint</p></div></body>" for i in range(5)]
    assert extracted(spark, pages) == [f"Story {i}" for i in range(5)]


def test_names_do_not_drop_the_main_content():
    story = "<h1>Head</h1><p>Story</p>"
    for page in (f'<body class="right-sidebar">{story}</body>', f'<body class="sidebar">{story}</body>',
                 f'<div id="content-with-sidebar">{story}</div>', f'<article class="share-enabled">{story}</article>',
                 f'<article class="related">{story}</article>', f"<form>{story}</form>", f'<div class="widget">{story}</div>',
                 f'<form role="form"><main>{story}</main></form>', "<form><p>Head</p><p>Story</p></form>",
                 '<article><header class="entry-header"><h1>Head</h1></header><p>Story</p></article>',
                 '<article><div class="article-header"><h1>Head</h1></div><p>Story</p></article>',
                 '<article><div class="header"><h1>Head</h1></div><p>Story</p></article>',
                 f'<div class="popup"><h1>Subscribe</h1></div>{story}',
                 f'<div class="banner"><h1>Site</h1></div>{story}<div class="related"><article>Teaser</article></div>'
                 '<div class="cookie-notice">We use</div><section class="comments"><p>c</p></section><form>go</form>'):
        assert wrapper.extract(page, None) == "Head\nStory", page


def test_formulas_and_object_texts_stay():
    page = "<p>So <math><mi>a</mi><mo>=</mo><mn>1</mn></math> holds</p><object data=x><p>instead</p></object>"
    assert wrapper.extract(page, None) == "So a=1 holds\ninstead"


NAMED = ("nav-primary", "cookie-bar", "site-footer", "adsbygoogle-box ad", "related-posts", "user-comments", "comment-list", "disqus_thread")


def test_parts_with_one_listed_word_in_a_name_go():
    story = "<h1>Head</h1>" + "<p>A long enough paragraph of the story.</p>" * 9
    for name in NAMED:
        page = f'<body><div class="{name}"><p>Other words</p></div><div class="content-with-sidebar">{story}</div></body>'
        assert wrapper.extract(page, None).split("\n") == ["Head"] + ["A long enough paragraph of the story."] * 9, name


def site(i, extra=""):
    """Nothing named: a menu of links, an advert and comments that vary, a story in plain divisions, per-page ids and classes."""
    links = "".join(f'<li><a href="/{k}">Link {k * i}</a></li>' for k in range(6))
    story = "".join(f"<p>Paragraph {k} of story {i} has a good many words in it, as stories have.</p>" for k in range(8 + i % 5))
    return (f'<body class="postid-{i} b"><div id="m{i}"><ul>{links}</ul></div><div><h1>Title {i}</h1><div class="post-{i} x" id="post-{i}">'
            f"<h2>Ingredients</h2>{story}</div></div><div>Buy {i} now</div><div><p>Reader {i} says hm</p></div>{extra}</body>")


def test_the_template_decides_where_nothing_is_named(spark, monkeypatch):
    for name in ("OTHER_TAGS", "OTHER_NAMES", "OTHER_ROLES", "HEADERS"):
        monkeypatch.setattr(wrapper, name, frozenset())
    for i, text in enumerate(extracted(spark, [site(i) for i in range(8)])):
        lines = text.split("\n")
        assert lines[0] == f"Title {i}" and len(lines) in (9 + i % 5, 10 + i % 5) and all("story" in x for x in lines[-(8 + i % 5):])


def test_headings_of_articles_stay_though_they_are_the_same_on_all_pages(spark):
    pages = [f"<body><nav>m</nav><article><h1>Dish {i}</h1><h2>Ingredients</h2><p>Take {i} eggs</p><h2>Steps</h2><p>Boil {i} min</p>"
             f"</article><div><h2>Contact</h2></div></body>" for i in range(6)]
    assert extracted(spark, pages) == [f"Dish {i}\nIngredients\nTake {i} eggs\nSteps\nBoil {i} min" for i in range(6)]


def test_templates_stay_small_and_the_time_linear():
    import time

    def build(n, slugs):
        held, start = None, time.process_time()
        for i in range(n):
            extra = "".join(f'<div id="{"abcdefghij"[k]}{"".join("ghijklmnop"[int(c)] for c in str(i))}">t</div>' for k in range(3)) if slugs else ""
            new = wrapper.template(wrapper.Shape([wrapper.parse(site(i, extra))]), i)
            held = wrapper.bounded(wrapper.merge(held, new) if held else new)
        return len(wrapper.json.dumps(held)), time.process_time() - start

    (small, _), (large, took) = build(300, False), build(10_000, False)
    assert large < 1.5 * small and took < 120
    size, _ = build(1_500, True)  # ids without a digit, all different: pruned by support
    assert size < 150 * wrapper.NODES
