from tidewatch.llm import html_extract as H

BODY = "<p>One  two &amp; three, and then some more words follow here.</p><p>Second block of text, which is long enough to count.</p>"
WANT = "Title One two & three, and then some more words follow here. Second block of text, which is long enough to count."
AROUND = '<div class="page-header">Page head</div><nav><a href="/">Home</a></nav><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div>'
AFTER = '<div class="comments"><p>A reader says a lot of things here and there.</p></div><aside>side</aside><form><input>go</form><footer>foot</footer>'


def page(inner):
    return f"<html><head><title>t</title><script>var x='</p>'</script><style>p{{}}</style></head><body>{AROUND}{inner}{AFTER}</body></html>"


def test_layouts():
    for inner in (
        f"<article><h1>Title</h1>{BODY}</article>",
        f"<main><h1>Title</h1>{BODY}</main>",
        f'<div id="wrap"><div class="post-17 content"><h1>Title</h1>{BODY}{AFTER}</div></div>',
        f"<article><header><h1>Title</h1></header><section>{BODY.split('</p>')[0]}</p></section><section>{BODY.split('</p>')[1]}</p></section></article>",
        f"<article><h1>Title</h1><!-- ad --><div class='ad'>Buy</div>{BODY}<script>no()</script></article>",
    ):
        p = H.Page(page(inner))
        assert p.extract(p.best(1)[0][0]) == WANT, inner


def test_broken_markup():
    for html in ("", "<", "<p", "<div><p>a<b>b<div>c", "</div></p>x", "<!-- open", "<script>never ends", "plain text", "<a<b>c</a>"):
        p = H.Page(html)
        p.extract(None)
    assert H.Page("plain &lt;text&gt;").extract(None) == "plain <text>"


def test_hosts_agree(spark):
    good = page(f"<article><h1>Title</h1>{BODY}</article>")
    odd = page("<article><h1>Title</h1><p>short</p></article><div><p>" + "Long boilerplate of the site without a class, repeated. " * 8 + "</p></div>")
    rows = [(i, f"http://a.example/{i}", good) for i in range(5)] + [(9, "http://a.example/9", odd), (10, None, good), (11, "http://b.example/", None), (12, "nourl", ""), (9, "http://a.example/9", odd)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in H.extract(pages).collect()]
    assert sorted(t for i, t in got if i == 9) == ["Title short"] * 2  # the host's path, not the page's own best
    assert all(t == WANT for i, t in got if i < 5 or i == 10) and [t for i, t in got if i in (11, 12)] == ["", ""]
    assert H.extract(pages.limit(0)).count() == 0


def test_hostile_markup_takes_linear_time():
    import time

    for part in ("<a", "<div>", "<p class=x ", "<a b='", "<!--", "<x><h1></h1>", "<x>", "</p>", "<div></p>", "<li>", "<tr><td>", "<script>", '<p a="', "&#", "<a b='<a b=\"", "<div class=a1>x", "<!", "a </"):
        html = part * (1_000_000 // len(part))
        start = time.perf_counter()
        p = H.Page(html)
        p.extract(p.best()[0][0] if p.best() else None)
        took = time.perf_counter() - start
        assert took < 5, (part, took)
        print(part, round(took, 2))
    assert H.Page("<p>a&#" + "1" * 9000 + ";b</p>").extract(None) == "a�b"


def test_words_that_articles_use_too():
    said = "Findings are discussed at some length here, as they deserve it."
    for inner in (f'<section id="discussion"><h2>Discussion</h2><p>{said}</p></section>', f'<div class="alert-level"><h2>Discussion</h2><p>{said}</p></div>', f'<div id="related"><h2>Discussion</h2><p>{said}</p></div>'):
        assert H.Page(page(f"<article><h1>Title</h1>{BODY}{inner}</article>")).extract(None) == f"{WANT} Discussion {said}"
    formula = "<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p>"
    assert H.Page(page(f"<article><h1>Title</h1>{BODY}{formula}</article>")).extract(None) == f"{WANT} So x=2 holds."
    for gone in ('<div class="alert">Mind this</div>', '<div class="alert-box">Mind this</div>', '<section class="reader-comments"><p>I say so.</p></section>', '<article class="comment"><p>I say so.</p></article>', '<div class="responses"><p>I say so.</p></div>', '<ul class="share-links"><li>tell</li></ul>'):
        assert H.Page(page(f"<article><h1>Title</h1>{BODY}{gone}</article>")).extract(None) == WANT, gone


def test_heading_stays_on_long_pages():
    for n in (1, 100):
        text = " ".join(["A sentence of running text."] * n)
        p = H.Page(page(f'<article><h1>Title</h1><div class="content"><p>{text}</p></div></article>'))
        assert p.extract(p.best()[0][0]) == f"Title {text}"


def test_inner_names_of_their_own(spark):
    """Every page names its inner container otherwise: the outer one, which they share, wins the host."""
    inner = lambda i: f'<div class="story"><h1>Title</h1><div class="{"abcdefghij"[i]}x">{BODY}</div></div>'
    rows = [(i, f"http://c.example/{i}", page(inner(i)), "mine") for i in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _host string")
    assert {(r.text, r._host) for r in H.extract(pages).collect()} == {(WANT, "mine")}
