"""Tree scores of pages by brute force, what an article keeps of its own, and edges of the extraction."""

import html

BODY = "A long paragraph of the article, with commas, and so on, that tells what there is to tell about the matter at hand."


def page(inner):
    return f"<html><body><nav><a href=x>home</a></nav><article><h1>Title</h1><p>{BODY} {BODY}</p>{inner}<p>{BODY} {BODY}</p></article><aside>a side bar whose text is long enough to be found</aside></body></html>"


def test_points_match_a_walk_over_all_paragraphs():
    """Each paragraph adds to its parent and, halved at every step, to all further ancestors; link density discounts at the end."""
    from cellweave.llm import html_text as H

    root = H.parse(page(f"<section><div><p>{BODY}</p><p>short, <a href=1>linked words</a></p></div><ul><li>one, two</li></ul></section><div>bare, text<p>{BODY}</p></div>"))
    H.prune(root)
    nodes = H.ordered(root)

    def text_of(n, linked=False):
        own = [(t, linked or n.tag == "a") for c in n.children if isinstance(c, str) for t in [" ".join(html.unescape(c).split())]]
        return own + [x for c in n.children if not isinstance(c, str) for x in text_of(c, linked or n.tag == "a")]

    want = {id(n): 0.0 for n in nodes}
    for n in nodes:
        texts = text_of(n)
        chars, commas = sum(len(t) for t, _ in texts), sum(t.count(",") for t, _ in texts)
        direct = n.tag in ("div", "section", "article", "main", "body") and any(isinstance(c, str) and c.strip() for c in n.children)
        if chars and (direct or n.tag in H.PARAGRAPH):
            own = sum(len(c.strip()) for c in n.children if isinstance(c, str)) if direct else chars
            gain, up = 1 + commas * own / chars + min(own / 100, 3), n if direct else n.parent
            while up is not None:
                want[id(up)] += gain
                gain, up = gain / 2, up.parent
    H.score(root)
    for n in nodes:
        texts = text_of(n)
        chars, linked = sum(len(t) for t, _ in texts), sum(len(t) for t, x in texts if x)
        assert abs(n.points - n.bonus - want[id(n)] * (1 - (linked / chars if chars else 0))) < 1e-9, n.tag


def test_articles_keep_their_own_parts():
    from cellweave.llm.html_text import main_text

    kept = {
        f"<section id='side-effects'><h2>Side</h2><p>{BODY}</p></section>": f"Side\n{BODY}",
        f"<div class='promotion-history'><p>{BODY}</p></div>": BODY,
        f"<div class='notice-board'><p>{BODY}</p></div>": BODY,
        "<figure><img src=a><figcaption>A caption of it</figcaption></figure>": "A caption of it",
        "<p>x <label>lab</label> <math><mi>y</mi></math> z</p>": "x lab y z",
        "<header><p>An inner header of some forty characters or more</p></header>": "An inner header of some forty characters or more",
        "<aside><p>An inner aside that has some forty characters or more</p></aside>": "An inner aside that has some forty characters or more",
        "<p>x &<b>lt;</b> y &lt; z</p>": "x &lt; y < z",
    }
    for inner, text in kept.items():
        assert main_text(page(inner)) == f"Title\n{BODY} {BODY}\n{text}\n{BODY} {BODY}", inner
    for inner in (f"<div class='ad-banner'><p>{BODY}</p></div>", f"<div class='cookie-notice'><p>{BODY}</p></div>", f"<div id=comments><p>{BODY}</p></div>", f"<div class=side><p>{BODY}</p></div>", "<aside class=related><a href=1>one two three</a> <a href=2>four five six seven eight nine</a></aside>", f"<footer><p>{BODY}</p></footer>"):
        assert main_text(page(inner)) == f"Title\n{BODY} {BODY}\n{BODY} {BODY}", inner


def test_edges_of_extraction(spark):
    from cellweave.llm.html_text import extract

    long = page("".join(f"<p>{k} {BODY}</p>" for k in range(20_000)))
    rows = [(1, "u", long, 5), (1, "u", page(""), 6), (1, "u", page(""), 7), (None, None, None, 8), (2, "v", "", 9)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long").withColumnRenamed("n_chars", "text"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    short = f"Title\n{BODY} {BODY}\n{BODY} {BODY}"
    assert sorted((r.page_id or 0, r.n_chars, r.text.count("\n")) for r in got.collect()) == [(0, 0, 0), (1, len(short), 2), (1, len(short), 2), (1, len(short) + sum(len(f"\n{k} {BODY}") for k in range(20_000)), 20_002), (2, 0, 0)]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
