import re

import pytest

from regionspark.llm import html_text as m


def page(i, body, links=4, footer=True):
    nav = "".join(f"<li><a href='/{k}'>Link {k} {i}</a></li>" for k in range(links))
    return (
        f"<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><header>Site</header><nav><ul>{nav}</ul></nav><!-- x -->"
        f"<div class='cookie-notice'>We use cookies {i}</div>{body}<aside>Side {i}</aside>" + ("<footer>&copy; 2020</footer></body></html>" if footer else "")
    )


def test_blocks_references_and_white_space():
    src = "<article><h1>A &amp;&lt; B&nbsp;&nbsp;C</h1><p>one\n two<b>three</b> &eacute;&#233;&#xe9; &am x</p><ul><li>i<li>j</ul>tail<br>end<table><tr><td>c1<td>c2</table></article>"
    assert m.main_text(src, None) == "A &< B C\none twothree ééé &am x\ni\nj\ntail end\nc1 c2"
    assert m.main_text(None, None) == m.main_text("", None) == ""
    assert m.main_text("a < b & c <i>d</i> <3", None) == "a < b & c d <3"
    assert m.main_text("<article><p>x<script>if (a<b) {}</script>y<style>.a{}</style></p><!-- c --><p title='a>b'>z</article>", None) == "xy\nz"


def test_left_out_parts():
    out = ["<nav>n</nav>", "<aside>n</aside>", "<form><label>n</label><input></form>", "<div class='comments'><p>n</p></div>", "<section id=comments>n</section>", "<div class='ad'>n</div>", "<div class='post-share'>n</div>", "<button>n</button>", "<footer>n</footer>", "<div hidden>n</div>", "<div class=\"newsletter box\">n</div>", "<noscript>n</noscript>"]
    for x in out:
        assert m.main_text(f"<body><article><p>a</p>{x}<p>b</p></article></body>", None) == "a\nb", x
    assert m.main_text("<article><header><h1>T</h1></header><p class='lead'>a</p><div class='header'>h</div><div class='readmore shadow'>b</div></article>", None) == "T\na\nh\nb"


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><article>{}</article></main>", "<div id='content'><div class='post-body'>{}</div></div>", "<section class='text'>{}"])
def test_pages_of_a_host(spark, wrap):
    rows, want = [], {}
    for i in range(12):
        paras = [f"Paragraph {j} of page {i} has words {'x' * j}y & more." for j in range(3 + i % 4)] + ["The same line everywhere."]
        body = wrap.format("<h1>Title</h1>".replace("Title", f"Title {i}") + "".join(f"<p>{p.replace('&', '&amp;')}" + ("</p>" if i % 2 else "<br>") for p in paras))
        rows.append((i, f"https://User@Host{i // 6}.example.com:80/p{i}?q", page(i, "<div class='crumb-line'>You are here</div>" + body, 3 + i % 3, i % 5 != 0), i))
        want[i] = "\n".join([f"Title {i}", *paras])
    rows += [(50, None, None, 1), (51, "no url", "", 1), (3, rows[3][1], rows[3][2], 3), (52, "http://one.example.org/", "<article><p>single</p></article>", 1)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, text int").repartition(3)
    got = m.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = want.get(r.page_id, {52: "single"}.get(r.page_id, ""))
        assert r.text == text and r.n_chars == len(text), r.page_id
    assert m.extract(df.limit(0)).collect() == []


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    import html

    source = {r.page_id: r.html for r in pages.collect()}
    for r in m.extract(pages).collect():
        inner = source[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"<p>|</p>|</h1>", inner)]
        assert r.text == "\n".join(b for b in blocks if b)
