import random
import time

import pytest

from lakejobs.llm import pages
from lakejobs.llm.pages import Page

SCHEMA = "page_id long, url string, html string, host string, paths string, text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x") for i, u, h in rows], SCHEMA)


def page(body, extra=""):
    return (
        "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t=\"</p>\";</script></head><body>"
        "<header><h2>Site</h2></header><nav><ul><li><a href='/a'>A</a></ul></nav><!-- ad --><div class=\"ad\">Buy now.</div>"
        f"<div id=cookie-notice>We use cookies.</div><article>{body}</article><aside>Side</aside>{extra}"
        "<section class='comments'><p>First! A very long reader comment that is longer than everything else on the whole page, by far.</p></section>"
        "<form><label>Name</label><input></form><footer>&copy; x</footer></body></html>"
    )


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<h1>Title</h1><p>One <b>two</b> three.<p>Four<br>five", "Title One two three. Four five"),
        ("<p>a&amp;b &lt;c&gt; &#233; &#x1F600; &nbsp; d &am</p>", "a&b <c> é \U0001f600 d &am"),
        ("<p>in<i>si</i>de\n\t  white</p><ul><li>x<li>y</ul>", "inside white x y"),
        ("<p><b>bold<br><p>next</p><script>bad()</script><div class='share-bar'>Share</div><p>end", "bold next end"),
        ("<p title='a > b'>text</p><!-- <p>gone</p> --><table><tr><td>1<td>2<tr><td>3</table>", "text 1 2 3"),
        ("", ""),
    ],
)
def test_main_text(spark, body, want):
    rows = [(k, f"https://h.example/{k}", page(f"<h1>T{k}</h1><p>{'word ' * 30}</p>")) for k in range(5)] + [(9, "https://h.example/9", page(body))]
    got = {r.page_id: r for r in pages.op7_consensus_html(frame(spark, rows)).collect()}
    assert got[9].text == want and got[9].n_chars == len(want)
    assert got[0].text == "T0 " + "word " * 29 + "word"


def test_hosts_agree_on_their_own_paths(spark):
    rows = []
    for k in range(8):
        rows.append((k, f"http://a.example/{k}", f"<body><div class='story{k}'><p>{'a ' * 40}{k}</p></div><div class=box><p>{'b ' * 15}</p></div>"))
        rows.append((100 + k, f"http://B.example:80/{k}", f"<body><div class=story><p>{'c ' * 9}</p></div><div class=box><p>{'d ' * 30}{k}</p></div>"))
    rows.append((50, "http://a.example/odd", f"<body><div class=story><p>short</p></div><div class=box><p>{'b ' * 90}</p></div>"))
    rows.append((51, "http://a.example/other", "<body><main><p>Another layout.</p></main>"))
    got = {r.page_id: r.text for r in pages.op7_consensus_html(frame(spark, rows)).collect()}
    assert got[3] == "a " * 40 + "3" and got[103] == "d " * 30 + "3"
    assert got[50] == "short" and got[51] == "Another layout."


def test_a_large_host_is_cut_and_gives_the_same_texts(spark, monkeypatch):
    rows = [(k % 7, f"http://{'big' if k % 3 else 'small' + str(k)}.example/", page(f"<h1>T{k % 5}</h1><p>{'word ' * 9}</p>")) for k in range(60)]
    rows += [(50, "http://big.example/", page("<p>copy</p>"))] * 40
    whole = sorted(pages.op7_consensus_html(frame(spark, rows)).collect())
    monkeypatch.setattr(pages, "PAGES_TOGETHER", 10)
    read = pages.hosts(frame(spark, rows))
    assert [tuple(r) for r in pages.large_hosts(read).collect()] == [("big.example", 8)]
    # Copies are told apart by their places.
    assert read.where("page_id = 50").select("place").distinct().count() == 40
    assert sorted(pages.op7_consensus_html(frame(spark, rows)).collect()) == whole and len(whole) == 100


def test_paths_beyond_the_best_of_a_host_win_too(spark, monkeypatch):
    def nested(name, text, box=""):
        deep = "".join(f"<div class={name}-{'abcdefg'[k]}>" for k in range(7))
        return f"<body>{deep}<article class={name}><p>{text}</p></article>{box}{'</div>' * 7}</body>"

    names = [a + b for a in "pqrst" for b in "uvwxy"]
    rows = [(10 * i + k, "http://h.example/", nested(n, f"{'word ' * 30}{n}{k}")) for i, n in enumerate(names) for k in range(4 if i < 20 else 3)]
    # Its own best container is the box, which no other page has.
    rows += [(900 + i, "http://h.example/", nested(n, f"short {n}", f"<section class=box{n}><p>{'noise ' * 60}</p></section>")) for i, n in enumerate(names)]
    for together in (256, 10):
        monkeypatch.setattr(pages, "PAGES_TOGETHER", together)
        got = {r.page_id: r.text for r in pages.op7_consensus_html(frame(spark, rows)).collect()}
        assert [got[900 + i] for i in range(len(names))] == [f"short {n}" for n in names]
        assert got[241] == "word " * 30 + "ty1"


def article(rng, words, depth=0):
    """Random markup of an article and the words that must come back, in order; marked parts hold other words."""
    out, want = [], []

    def text(n):
        own = [next(words) for _ in range(rng.randrange(1, n))]
        want.extend(own)
        return " ".join(own)

    for _ in range(rng.randrange(1, 6)):
        kind = rng.randrange(11 if depth < 4 else 6)
        if kind == 0:
            out.append(f"<h{rng.randrange(1, 4)}>{text(6)}</h2>".replace("</h2>", ""))
        elif kind == 1:
            out.append(f"<p>{text(30)}" + rng.choice(["</p>", ""]))
        elif kind == 2:
            out.append(f"<ul><li>{text(5)}<li>{text(9)}</ul>")
        elif kind == 3:
            rows = "".join(f"<tr><td>{text(4)}<td>{text(40)}" for _ in range(rng.randrange(1, 5)))
            out.append(f"<table>{rows}</table>")
        elif kind == 4:
            out.append(f"<blockquote>{text(20)}</blockquote><br>{text(5)}")
        elif kind == 5:
            out.append(rng.choice(["<div class=share-bar>gone {0}</div>", "<aside>gone {0}</aside>", "<div id='cookie-box'><p>gone {0}</p></div>", "<form>gone {0}</form>", "<script>gone('{0}')</script>"]).format("gone " * rng.randrange(200)))
        else:
            inner, own = article(rng, words, depth + 1)
            tag = rng.choice(["div", "section", "div class=lead", "div class=body", "figure", "header", "center"])
            out.append(f"<{tag}>{inner}</{tag.split()[0]}>")
            want.extend(own)
    return "".join(out), want


def test_the_whole_article_comes_back(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for k in range(400):
        host, tag = k % 20, rng.choice(["article", "main"])
        if host < 10:  # pages of a host that are all alike in outline
            rng_of_host = random.Random(host)
            body, own = article(rng_of_host, (f"w{k}x{i}" for i in range(10**6)))
        else:
            body, own = article(rng, (f"w{k}x{i}" for i in range(10**6)))
        if own:
            want[k] = " ".join(own)
        rows.append((k, f"http://h{host}.example/{k}", page(body).replace("article>", f"{tag}>")))
    got = {r.page_id: r.text for r in pages.op7_consensus_html(frame(spark, rows)).collect()}
    assert {k: got[k] for k in want} == want


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><h1>T</h1><p>Intro</p><section>{0}</section><section>{0}</section></article>", "T Intro {0} {0}"),
        ("<article><h1>T</h1><p>Intro</p><table><tr><td>{0}<td>{0}</table><p>Outro</article>", "T Intro {0} {0} Outro"),
        ("<main><div class=lead>Lead</div><div class=body>{0}</div></main>", "Lead {0}"),
        ("<main><h1>T</h1><article><p>{0}</p></article></main>", "T {0}"),
        ("<div class=content><h1>T</h1><div class=text><p>{0}</p></div></div><div class=other>Other</div>", "T {0}"),
        ("<div class=text><p>{0}</p></div><div class=other><p>Other</p></div>", "{0}"),
        ("<article><h1>T</h1><div class=c>{0}</div></article>", "T {0}"),
    ],
)
def test_titles_leads_and_tables(spark, body, want):
    filled = [(k, "http://h.example/", body.format(f"{'word ' * 30}{k}")) for k in range(6)]
    got = {r.page_id: r.text for r in pages.op7_consensus_html(frame(spark, filled)).collect()}
    assert got == {k: want.format(f"{'word ' * 30}{k}") for k in range(6)}


def test_deep_pages_take_linear_time():
    for begin, end in (("<div>", "</div>"), ("<b>", "</b>"), ("<span><p>", ""), ("<ul><li>", ""), ("</x>", "</y>")):
        start = time.process_time()
        assert Page(begin * 20_000 + "deep" + end * 20_000).main_text([]) == "deep"
        assert time.process_time() - start < 5


def test_odd_pages(spark):
    long = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, None, None), (2, "", ""), (3, "x", "plain text & more"), (4, "http://h/", "<<<>>> < b"), (None, "http://h/", "<p>null id"), (5, "http://h/", long), (6, "http://h/", "<p>twice"), (6, "http://h/", "<p>twice"), (7, "http://h/", "<a href='x" * 2000)]
    got = pages.op7_consensus_html(frame(spark, rows)).collect()
    texts = sorted((str(r.page_id), r.text) for r in got if r.page_id != 7 and r.page_id != 4)
    assert texts == [("1", ""), ("2", ""), ("3", "plain text & more"), ("5", "deep"), ("6", "twice"), ("6", "twice"), ("None", "null id")]
    assert len(got) == len(rows) and pages.op7_consensus_html(frame(spark, [])).collect() == []


def test_blocks_keep_page_order_and_no_word_is_lost():
    rng = random.Random(1)
    for _ in range(200):
        words = [f"w{k}" for k in range(rng.randrange(1, 40))]
        html = "<body><article>" + "".join(rng.choice(["<p>", "<div>", "</div>", "<b>", "</b> ", " ", "<br>", "<li>", "</p>"]) + " " + w for w in words)
        assert Page(html).main_text([]).split() == words or Page(html).main_text(["body/article"]).split() == words
