from regionspark.llm import html_text as m


def site(body, i, extra=""):
    return f"<html><body><div class='tools'>Menu of things {i}</div>{body}{extra}</body></html>"


def layout(i, name):
    return f"<div id='{name}'><h1>Title {i}</h1>" + "".join(f"<p>Paragraph {j} of page {i} with some more words in it to read.</p>" for j in range(4 + i % 3)) + "</div>"


def text(i):
    return "\n".join([f"Title {i}", *(f"Paragraph {j} of page {i} with some more words in it to read." for j in range(4 + i % 3))])


def texts(spark, pages):
    rows = [(i, "https://h.example.com/", x) for i, x in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").repartition(3)
    return {r.page_id: r.text for r in m.extract(df).collect()}


def test_empty_and_error_pages_leave_the_frame(spark):
    pages = [site(layout(i, "story"), i) for i in range(30)]
    got = texts(spark, [*pages, None, "", "", " ", "<html><head><title>Moved</title></head></html>"])
    assert [got[i] for i in range(30)] == [text(i) for i in range(30)]


def test_variant_layouts_of_a_host(spark):
    got = texts(spark, [site(layout(i, "old-story" if i % 2 else "story"), i) for i in range(30)])
    assert [got[i] for i in range(30)] == [text(i) for i in range(30)]


def test_doubled_table(spark):
    pages = [site(layout(i, "story"), i) for i in range(12)]
    got = texts(spark, pages * 2)
    assert [got[i] for i in range(24)] == [text(i) for i in range(12)] * 2


def test_doubled_table_of_variant_layouts(spark):
    pages = [site(layout(i, "old-story" if i % 2 else "story"), i) for i in range(12)]
    got = texts(spark, pages * 2)
    assert [got[i] for i in range(24)] == [text(i) for i in range(12)] * 2


def menu_page(i, n=4):
    body = "".join(f"<p>Sentence {j} of {i}, {'w' * (i + j)}.</p>" for j in range(n + i % 2))
    return f"<html><body><div class='crumbz'>Home About Contact</div><div class='bodyz'>{body}<p>The same line everywhere.</p></div><div class='lowline'>All rights reserved</div></body></html>"


def menu_text(i, n=4):
    return "\n".join([*(f"Sentence {j} of {i}, {'w' * (i + j)}." for j in range(n + i % 2)), "The same line everywhere."])


def test_constant_blocks_of_unknown_names_go(spark):
    pages = [menu_page(i) for i in range(10)]
    assert [t for _, t in sorted(texts(spark, pages).items())] == [menu_text(i) for i in range(10)]
    # the template does it: without one the menu stays
    assert m.main_text(pages[0], None) != menu_text(0)


def test_constant_blocks_go_where_the_body_is_the_main_slot(spark):
    pages = [f"<body><div class='crumbz'>Home About Contact Imprint Help</div><div class='bodyz'>Short {i}</div><div class='lowline'>All rights reserved</div></body>" for i in range(10)]
    assert texts(spark, pages) == {i: f"Short {i}" for i in range(10)}


def test_labels_of_repeated_records_go(spark):
    def page(i):
        items = "".join(f"<div class='rec'><div class='lbl'>Reported by</div><p>Entry {j} of {i} with words</p></div>" for j in range(2 + i % 4))
        return f"<body><div class='list'>{items}</div></body>"

    got = texts(spark, [page(i) for i in range(12)])
    assert got == {i: "\n".join(f"Entry {j} of {i} with words" for j in range(2 + i % 4)) for i in range(12)}


def test_copies_of_a_page_are_no_support(spark):
    # one page a hundred times: its own sentences are no template
    got = texts(spark, [*[menu_page(0)] * 100, *(menu_page(i) for i in range(1, 8))])
    assert got[0] == menu_text(0) and got[106] == menu_text(7)


def template(spark, pages):
    df = spark.createDataFrame([("https://h.example.com/", x) for x in pages], "url string, html string").repartition(3)
    return {k: sorted(v) if isinstance(v, list) else v for k, v in m.page_templates(df).filter("host <> '*'").first().asDict().items()}


def test_doubled_pages_give_the_same_template(spark):
    pages = [menu_page(i) for i in range(5)]
    assert template(spark, pages * 2) == template(spark, pages)
    assert template(spark, [pages[0], *pages]) == template(spark, pages)


def test_deduce_against_whole_occurrence_vectors(spark):
    """Classes, frame and template texts from explicit vectors over the pages, one number a page."""
    pages = [menu_page(i) for i in range(7)] + [site(layout(i, "story"), i) for i in range(9)] + ["<p>other</p>"]
    vectors, at = {}, {}
    for k, page in enumerate(pages):
        for token, role, kind, depth, n, _, _ in m.page_tokens(page)[0].tolist():
            vectors.setdefault((token, kind), [0] * len(pages))[k] = n
            at[token, kind] = role
    frame = {t for (t, kind), v in vectors.items() if kind in (m.TAG, m.ARTICLE) and max(v) == 1 and sum(v) >= 0.9 * len(pages)}
    classes = {}
    for (t, kind), v in vectors.items():
        if kind in (m.TAG, m.ARTICLE, m.TEXT) and sum(x > 0 for x in v) >= 0.1 * len(pages):
            classes.setdefault(tuple(v), set()).add(t)
    nested = {frozenset(c) for v, c in classes.items() if len(c) > 1 and not (max(v) == 1 and sum(v) >= 0.9 * len(pages))}
    texts_ = set()
    for (role, kind), v in vectors.items():
        if kind == m.BLOCKS and sum(x > 0 for x in v) >= 3:
            own = [(t, vectors[t, m.TEXT]) for t, k in vectors if k == m.TEXT and at[t, k] == role]
            own = [(t, w) for t, w in own if sum(x > 0 for x in w) >= 0.9 * sum(x > 0 for x in v)]
            if sum(sum(w) for _, w in own) >= 0.9 * sum(v):
                texts_ |= {t for t, _ in own}
    got = template(spark, pages)
    unsigned = lambda xs: {x % 2**64 for x in xs}
    assert unsigned(got["frame"]) == frame and got["pages"] == len(pages)
    assert {frozenset(unsigned(r.tokens)) for r in got["nested"]} == nested
    assert unsigned(got["template_texts"]) == texts_ and len(texts_) == 2
