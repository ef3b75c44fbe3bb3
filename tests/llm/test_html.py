import re

from graphloom.llm import html, queries


def page(body):
    return f"<!DOCTYPE html><html><head><title>T &amp; t</title><script>var a='</p><p>no';</script></head><body>{body}</body></html>"


def test_parts_that_are_no_article_go():
    text = html.main_text(page(
        '<nav><ul><li><a href="/x">Menu</a></li></ul></nav><header>Site</header><div class="ad">Buy</div><article><h1>Head &amp; line</h1>'
        '<p><b>One <i>two</i>.<br><p>Three&nbsp;\n four<p class="notice">cookies</p><aside>side</aside><ul><li>a<li>b</ul><form>f<input></form>'
        '<style>p{}</style><!-- <p>gone</p> --><p>1 < 2 &lt;b&gt;</p></article><section id="comments"><p>' + "first! " * 50 + "</p></section><footer>&copy;</footer>"
    ))
    assert text == "Head & line\nOne two.\nThree four\na\nb\n1 < 2 <b>"


def test_pages_without_marked_article_keep_what_lies_between_surge_and_dive():
    body = "".join(f"<p>{'word ' * 30}{k}</p>" for k in range(5))
    text = html.main_text(page(f'<div><a href="/">Home</a> <a href="/b">About us</a></div><div>{body}<p>short</p></div><div class="sidebar">{"link " * 40}</div><div>c</div>'))
    assert text.split("\n") == [f"{'word ' * 30}{k}" for k in range(5)] + ["short"]


def test_odd_pages():
    assert html.main_text("") == "" and html.main_text("plain") == "plain" and html.main_text("<p") == "<p"
    assert html.main_text("<article>" * 2000 + "deep" + "<p>x") == "deep\nx"
    assert html.main_text("<article><p>" + "a " * 200_000 + "</article>") == ("a " * 200_000).strip()


def test_query_equals_a_plain_reading_of_the_pages(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    import html as std

    for r in queries.op10_html_extraction(spark, sf).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r.page_id], re.S)[1]
        blocks = [" ".join(std.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        assert r.text == "\n".join(x for x in blocks if x) and r.n_chars == len(r.text)


def test_null_html_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "<p>x", "a")], "page_id long, html string, text string")
    assert sorted((str(r.page_id), r.text) for r in html.extracted(df, ["page_id"]).collect()) == [("1", ""), ("1", ""), ("None", "x")]
    assert html.extracted(df.limit(0), ["page_id"]).count() == 0


def test_teasers_in_articles_do_not_replace_an_unmarked_story():
    teaser = '<article><h2>Card</h2><p>A teaser of some words.</p></article>'
    story = [f"{'word ' * 30}{k}" for k in range(5)]
    text = html.main_text(page(f"{teaser * 3}<div>{''.join(f'<p>{x}</p>' for x in story)}</div>{teaser * 3}"))
    assert text.split("\n") == story
    own = "".join(f"<p>{x}</p>" for x in story)
    text = html.main_text(page(f"<article>{own}<aside>no</aside><p>end</p></article><div>{'site ' * 30}</div>"))
    assert text.split("\n") == [*story, "end"]


def test_long_odd_pages_take_linear_time():
    import time

    began = time.perf_counter()
    assert html.main_text("<p>x" + "<a " * 100_000).startswith("x<a <a")
    assert html.main_text("<i>y</b>" * 50_000).count("y") == 50_000
    assert html.main_text("<span>x" * 100_000 + "<p>y" * 100_000).count("y") == 100_000
    assert html.main_text("<i>x" * 100_000 + "<hr>y" * 100_000).count("y") == 100_000
    assert html.main_text("<p>" + "<b>x" * 50_000 + "<div><i>y" * 50_000).count("y") == 50_000
    assert time.perf_counter() - began < 20
    assert html.main_text("<p>a<!-- <p>b") == "a" and html.main_text("<p>a<script>b <!-- c") == "a" and html.main_text("<p>1 <2 &amp<") == "1 <2 &<"


def test_sums_alone_find_the_article_of_pages_without_marks(sf):
    import pyarrow.parquet as pq

    pages = pq.read_table(f"{sf}/pages.parquet", columns=["html"]).column("html").to_pylist()
    assert pages
    for marked in pages:
        bare = re.sub(r"<(/?)(?:article|main)\b", r"<\1div", marked)
        assert html.main_text(bare) == html.main_text(marked)


def test_stretches_equal_brute_force_windows():
    """Unmarked pages: a line is kept if it lies in a run of windows with text, one of which is over the threshold."""
    import random

    rng = random.Random(5)
    for _ in range(200):
        lines = [rng.choice(["", "", "", "x" * rng.randint(1, 20), "y" * rng.randint(30, 60)]) for _ in range(rng.randint(1, 40))]
        body = "".join(f"<p>{x}</p>" if x else "<nav>menu</nav>" for x in lines)
        flat = [y for x in lines for y in ([x] if x else [""] * html.WINDOW)] + [""] * html.WINDOW
        groups, run = [], []
        for k in range(len(flat)):
            if any(flat[k : k + html.WINDOW]):
                run.append(k)
            elif run:
                groups, run = [*groups, run], []
        groups += [run] * bool(run)
        most = [max(sum(map(len, flat[k : k + html.WINDOW])) for k in g) for g in groups]
        strong = [g for g, m in zip(groups, most, strict=True) if m > html.SURGE] or [g for g, m in zip(groups, most, strict=True) if m == max(most)][:1]
        want = [flat[k] for g in strong for k in range(g[0], g[-1] + html.WINDOW) if k < len(flat) and flat[k]]
        assert html.main_text(page(body)) == "\n".join(want)
