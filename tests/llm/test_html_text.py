import random

from pyspark.sql import functions as F

from paraspark.llm.html_text import extract_text, main_text
from tests.llm.helpers import rows_by, sentence

PAGE = """<!DOCTYPE html><html lang=en><head><title>No</title><style>p{{}}</style><script>if(a<b)"</p>"</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a><li>Two</ul></nav>
<div id="cookie-notice">We use cookies, very long notice text, really, truly, more than the article has.</div><!-- <p>no</p> -->
<div class="ad">Buy this, now.</div>{article}<aside>Side</aside>
<section class="comments"><article><h2>Reader</h2><p>A comment, long, with marks, and more, more, more.</p></article></section>
<form><p>Subscribe</p></form><footer>&copy; me</footer></body></html>"""


def expect(article, want):
    assert main_text(PAGE.format(article=article)) == want


def test_article_without_its_surroundings():
    expect("<article><h1>A &amp; B</h1><p>One,\n two&lt;3 &eacute; &#x41;<p><b>Bold.<br><p>Next <a href='x>y'>link</a>.</article>",
           ["A & B", "One, two<3 é A", "Bold.", "Next link."])
    expect("<article></article>", [])
    expect("<article><p>x</p></article>", ["x"])
    expect("<main><div><p>In main <span class=ad>Buy!</span>text</p></div><ul><li>1<li>2</ul><pre>a\n  b</pre></main>",
           ["In main text", "1", "2", "a b"])
    expect("<article><header><h1>Kept</h1></header><footer>Gone</footer><aside>Gone</aside><table><tr><td>1<td>2</table></article>", ["Kept", "1", "2"])
    expect("<article><p>a &amp b &am c &quo; d &amp;quot; e</p></article>", ["a & b &am c &quo; d &quot; e"])


def test_pages_without_article_go_by_path_scores():
    rng = random.Random(1)
    long = [" ".join(sentence(rng, 40)) + ", and. So, on." for _ in range(5)]
    links = "".join(f"<a href={k}>link {k}</a> " for k in range(9))
    html = f"<body><div>{links}</div><div><div>" + "".join(f"<p>{t}</p>" for t in long) + f"</div></div><div>{links}</div></body>"
    assert main_text(html) == long


def test_graphics_formulas_and_classes_that_only_mention_a_thing():
    expect('<article><svg class="i"/><p>Kept text.</p></article>', ["Kept text."])
    expect('<article><p>a<svg viewBox="0 > 1"/>b <svg><title>t</title><path d="M"/></svg>c</p></article>', ["ab c"])
    expect("<article><p>So <math><msup><mi>x</mi><mn>2</mn></msup><mo>+</mo><mi>y</mi></math> holds.</p></article>", ["So x2+y holds."])
    expect('<article><section id="notice-of-meeting"><p>One.</p></section><p class="copyright-law">Two.</p><p class="adage">Three.</p></article>',
           ["One.", "Two.", "Three."])
    for name in ("ad", "ad-slot-3", "cookie-notice", "commentList", "share-buttons", "related posts", "site_nav", "x newsletter-box"):
        expect(f'<article><p>One.</p><div class="{name}"><p>No.</p></div><p id="{name}">No.</p></article>', ["One."])


def test_headings_that_lead_up_to_the_main_element():
    long = "Words and words, with marks. " * 9
    page = "<body><div class=top><h1>Site</h1></div><p>Welcome<ul><li><a href=/>Menu</a></ul>{}<div><h1>Title</h1><h2>Under</h2><p>By me</p><div><p>{}</p><p>{}</p></div></div>"
    assert main_text(page.format("", long, long)) == ["Title", "Under", "By me", long.strip(), long.strip()]
    assert main_text(page.format("<h3>Other</h3><p>Tail</p>", long, long))[0] == "Title"


def test_deep_and_unclosed_pages_take_linear_memory():
    import tracemalloc
    peaks = []
    for n in (2000, 8000):
        html = "<div>" * n + "text" + "<div><b>more" * n
        tracemalloc.start()
        assert len(main_text(html)) == n + 1
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 6 * peaks[0] and peaks[1] < 40_000_000


def test_templates_of_random_pages_match_their_blocks():
    rng = random.Random(2)
    for _ in range(200):
        blocks = [" ".join(sentence(rng, rng.randint(1, 60))) for _ in range(rng.randint(0, 9))]
        marked = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<p><b>{}<br>", "<blockquote><p>{}</p></blockquote>"]).format(b) for b in blocks)
        expect(f"<article>{marked}</article>", blocks)


def test_broken_and_odd_input():
    for html in ("", "<", "<p", "a<b", "</p>", "<p><i><b></p></b>", "<!--", "<script>", "<article><p>cut off here <a hre", "<a title=\"", "&#x110000;&#0;"):
        assert isinstance(main_text(html), list)
    assert main_text("<article><p>cut off here <a hre") == ["cut off here"]
    assert main_text("plain text only") == ["plain text only"]
    big = "<article>" + "<p>word, word.</p>" * 30_000 + "</article>"
    assert len(main_text(big)) == 30_000
    deep = "<article>" + "<div>" * 3000 + "text" + "</div>" * 3000 + "</article>"
    assert main_text(deep) == ["text"]


def test_on_spark_with_nulls_repeats_and_extra_columns(spark):
    rows = [(1, "u", PAGE.format(article="<article><p>é 😀</p></article>"))] * 2 + [(2, None, None), (None, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("id", F.lit("x"))
    got = extract_text(pages).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == [
        (0, "v", "", 0), (1, "u", "é 😀", 3), (1, "u", "é 😀", 3), (2, "", "", 0)]
    assert extract_text(pages.limit(0)).count() == 0
    assert rows_by(extract_text(pages), "page_id")[1]["n_blocks"] == 1
