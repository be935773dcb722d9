import html
import random
import re
import tracemalloc
from collections import defaultdict
from html.parser import HTMLParser

from lodestone.llm import html_text as ht


def brute(source):
    """For the pages at hand: what stands in the article, block by block."""
    body = re.search(r"<article>(.*?)</article>", source, re.DOTALL)[1]
    blocks = re.split(r"</?(?:h1|p)>", body)
    blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in blocks]
    return "\n".join(x for x in blocks if x)


def test_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    got = ht.op2_html_text(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == brute(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def text(source):
    return ht.Page(source).main_text(None)


def test_layouts():
    long = "Words of a paragraph that goes on for a while, so that it counts as running text. " * 3
    p = " ".join(long.split())
    menus = '<nav><a href="/">Home</a></nav><div id="cookie-notice">We use cookies</div><div class="sidebar"><p>' + long + long + "</p></div>"
    end = '<div class="comments"><p>' + long * 5 + '</p></div><form><p>Join us</p><input value="x"></form><footer>Foot</footer>'
    assert text(f"<html><head><title>T</title></head><body>{menus}<div class='post-12'><h1>T</h1><p>{long}<p>{long}</div>{end}") == f"T\n{p}\n{p}"
    assert text(f"<body>{menus}<main><article><header><h1>T &lt;b&gt;</h1></header><section><p>{long}</section><section>{long}<br>x</section><ul><li>a<li>b</ul></article></main>{end}</body>") == f"T <b>\n{p}\n{p} x\na\nb"
    assert text(f"<table><tr><td><a href=x>{long}</a><td>A<b>B</b> &amp;amp; &copy\n{long}</table>").endswith(p)
    assert text(f"<div>{long}<script>if (a < b) '</div>'</script><style>x</style><!-- <p>no --><span class='ad'>Buy</span></div>") == p
    assert text("") == "" and text("<p") == "" and text("a < b & c") == "a < b & c" and text("<nav>only</nav>") == ""
    assert text("<p>&am" + "p;lt; &#x41;&nbsp;&nbsp;x</p>") == "&lt; A x"


def test_host_vote(spark):
    long = "<p>" + "Words of a paragraph that goes on for a while. " * 4 + "</p>"
    short = "<div class='body'><p>One line.</p></div><div class='more-7'>" + long + "</div>"
    rows = [(i, f"http://a.example.com/{i}", f"<div class='body'>{long * 3}</div><div class='more-{i}'>{long}</div>", 1) for i in range(8)]
    rows += [(100, "http://a.example.com/x", short, 1), (101, None, None, 1), (102, "http://b.example.com/", short, 1), (100, "http://a.example.com/x", short, 2), (103, "nohost", "<p>" + "x" * 100_000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, path int")
    got = ht.main_text(df).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[100] == "One line." and by[101] == "" and by[102].startswith(("Words", "One line.\nWords"))
    assert by[103] == "x" * 100_000
    assert ht.main_text(df.limit(0)).count() == 0


LONG = " ".join(("Some running text of the article that is long enough to count, with several clauses in it. " * 3).split())
ARTICLE = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
NAV, FOOT = "<nav><a href=x>One</a><a>Two</a></nav>", "<footer>Copyright someone 2020 and all that</footer>"
TRUE = f"Title\n{LONG}\n{LONG}"


def test_articles_in_marked_elements():
    assert text(f'<body><form id="aspnetForm">{NAV}<article>{ARTICLE}</article>{FOOT}</form>') == TRUE
    assert text(f'<body><form id="aspnetForm">{NAV}<div>{ARTICLE}</div><input><button>Go</button>{FOOT}</form>') == TRUE
    assert text(f'{NAV}<article><p>Standfirst</p><div class="share-price-story"><p>{LONG}</p><p>{LONG}</p></div></article>{FOOT}') == f"Standfirst\n{LONG}\n{LONG}"
    assert text(f'<body>{NAV}<main class="related-work">{ARTICLE}</main>{FOOT}') == TRUE
    assert text(f'<div class="layout has-sidebar">{NAV}<div class=x>{ARTICLE}</div><div class="sidebar"><p>{LONG}</p></div></div>{FOOT}') == TRUE
    assert text(f'<div class="post with-comments">{ARTICLE}<div class="comments"><p>{LONG * 9}</p></div></div>{FOOT}') == TRUE
    assert text(f"<body><nav><a href=x>aa</a><div class=x>{ARTICLE}</div>") == TRUE  # never closed
    assert text(f'<div class="widget-text"><p>{LONG}</p><p>{LONG}</p></div><div class="widget"><p>{LONG}</p></div>') == f"{LONG}\n{LONG}"
    # without an article there is no text, and an article is not displaced by longer furniture or comments
    assert text(f"<body>{NAV}{FOOT}<div class=cookie>{LONG}</div>") == ""
    assert text(f'<article><p>short one</p></article><div class="comments"><article class="comment"><p>{LONG * 5}</p></article></div>') == "short one"
    page = ht.Page(f"<article class=part-1><p>{LONG}</p></article>x<article class=part-2><p>{LONG}</p></article>")
    assert page.main_text(page.paths[1]) == f"{LONG}\n{LONG}"  # both are on the host's path


def test_memory_does_not_grow_with_nesting():
    for source in ("<div>" * 50_000 + LONG, "<div>" * 50_000 + "</p>" * 50_000 + LONG, "<p>" + "<div>" * 50_000 + "</b>" * 50_000 + LONG, "<form>" * 50_000 + "<h1>x</h1>" + LONG):
        tracemalloc.start()
        page = ht.Page(source)
        page.votes()
        assert page.main_text(None).endswith(LONG)
        assert tracemalloc.get_traced_memory()[1] < 100 << 20
        tracemalloc.stop()


def test_vote_equals_plain_version(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        host = f"h{i % 4}.example.com"
        body = f"<div class=story-{i}><p>{LONG * rng.randrange(1, 4)}</div><div class=box><p>{LONG * rng.randrange(0, 4)}</div><center>{LONG * rng.randrange(3)}</center>"
        rows.append((i, f"https://{host}/{i}", f"<body><div id=wrap{i % 2}>{body}</div>" if i % 5 else body))
    votes = defaultdict(lambda: defaultdict(float))
    for _, url, source in rows:
        for path, depth, v in ht.Page(source).votes():
            votes[url.split("/")[2]][depth, path] += v
    winners = {h: max((round(v, 6), *k) for k, v in some.items())[2] for h, some in votes.items()}
    got = ht.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)).collect()
    assert {r.page_id: r.text for r in got} == {i: ht.Page(s).main_text(winners[u.split("/")[2]]) for i, u, s in rows}


def test_many_hosts_are_shuffled(spark, monkeypatch):
    monkeypatch.setattr(ht, "BROADCAST_HOSTS", 1)
    rows = [(i, f"https://{'hot' if i % 3 else i}.example.com/", f"<article>{ARTICLE}</article>") for i in range(3_000)]
    got = ht.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 3_000 and {r.text for r in got} == {TRUE}


def test_marked_words_within_sentences_stay():
    def body(x):
        return text(f"<body>{NAV}<article><h1>Title</h1><p>{LONG}</p>{x}</article>{FOOT}").removeprefix(f"Title\n{LONG}\n")

    assert body('<pre><code>x = 1 <span class="hljs-comment"># keep this</span>\ny = 2</code></pre>') == "x = 1 # keep this y = 2"
    assert body('<pre><span class="token comment"># First</span>\nImport</pre>') == "# First Import"
    assert body('<p>This is <strong class="notice">not</strong> valid.</p>') == "This is not valid."
    assert body('<p>See <a class="related" href="/x">the study</a>, which</p>') == "See the study, which"
    assert body('<p>It costs a lot. <span class="promo-price">$5</span> is too much.</p>') == "It costs a lot. $5 is too much."
    assert body("<p>Let <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>x+1</annotation></math> be even.</p>") == "Let x+1 be even."
    assert body('<div class="share-quote"><p>A quotation of the article.</p></div><p>End.</p>') == "A quotation of the article.\nEnd."
    assert body('<p>It is <span hidden>never</span><i aria-hidden="true">*</i> seen.</p>') == "It is seen."
    # what is a sentence of its own goes, and so do blocks of links, adverts and replies
    assert body('<p>All is said. <span class="ad">Buy now</span></p>') == "All is said."
    assert body('<p>All is said. <a class="related">Read on</a> The end.</p>') == "All is said. The end."
    assert body('<p><em class="promo">Buy now</em></p><p>End.</p>') == "End."
    assert body('<div class="share-links">Twitter</div><div class="advert">Buy. It is cheap.</div><span class="ad"><div>Buy</div></span><p>End.</p>') == "End."
    assert text(f'<body>{NAV}<article>{ARTICLE}</article><div class="discussion"><p>{LONG}</p></div><section id="user-responses"><p>{LONG}</p></section>{FOOT}') == TRUE


class Reader(HTMLParser):
    """What stands in <article> but for elements of the class ``out``, block by block."""

    BLOCKS = frozenset("article h1 h2 p div li ul blockquote pre".split())

    def __init__(self):
        super().__init__()
        self.open, self.blocks, self.text = [], [], []

    def close_block(self):
        words = " ".join("".join(self.text).split())
        self.blocks += [words] if words else []
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.close_block()
        if tag == "br":
            self.text.append(" ")
        else:
            self.open.append((tag, "data-out" in dict(attrs)))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.close_block()
        while self.open and self.open.pop()[0] != tag:
            pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.open) and not any(gone for _, gone in self.open):
            self.text.append(data)


def test_equals_an_independent_parser():
    rng = random.Random(9)
    words = ["stone", "river &amp; sea", "caf&eacute;", "a&lt;b", "It", "&#8220;so&#8221;", "x", "Not", "&copy;"]
    inline = ["b", "em", 'a href="/x"', 'span class="notice"', 'a class="related share"', 'code class="comment"', "sup", "math"]

    def sentence():
        out = ["Then"]
        for _ in range(rng.randint(4, 25)):
            w = rng.choice(words)
            if rng.random() < 0.3:
                tag = rng.choice(inline)
                w = f"<{tag}>{w}</{tag.split()[0]}>"
            out.append(w + rng.choice(["", ",", "<br>", "\n\t"]))
        return " ".join([*out, "and on."])

    def block():
        kind = rng.random()
        if kind < 0.6:
            return f"<p>{' '.join(sentence() for _ in range(rng.randint(1, 4)))}</p>"
        if kind < 0.7:
            return f"<h2>{sentence()}</h2>"
        if kind < 0.8:
            return "<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(3)) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{sentence()}</blockquote>"
        return rng.choice(['<div class="share-buttons" data-out="1">Tweet this. Now</div>', '<div class="advert" data-out="1"><p>Buy it. It is cheap.</p></div>', '<aside data-out="1"><p>Beside the point.</p></aside>', '<div class="newsletter" data-out="1">Sign up</div>'])

    for k in range(150):
        source = f"<html><body>{NAV}<div class=wrap{k}><article><h1>A title</h1>{''.join(block() for _ in range(rng.randint(3, 12)))}</article></div><div class='{rng.choice(['comments', 'discussion', 'reactions'])}'><p>{sentence()}</p></div>{FOOT}</body></html>"
        reader = Reader()
        reader.feed(source)
        assert text(source) == "\n".join(reader.blocks)
