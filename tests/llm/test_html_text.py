import re

import pytest
from pyspark.sql import functions as F

from slateworks.llm import html_text

LONG = "A sentence that is long enough to surge above the threshold of the line blocks, as an article has. "
MENU = "".join(f"<li><a href=/{i}>entry {i}</a></li>" for i in range(12))
PARAGRAPHS = "".join(f"<p>{i}. {LONG}</p>" for i in range(4))
TEXT = "\n\n".join(f"{i}. {LONG.strip()}" for i in range(4))
CASES = [
    (None, ""),
    ("", ""),
    ("<html><body><nav>Home</nav></body></html>", ""),
    ("just text", "just text"),
    ("<p>a &amp;&lt;b&gt; &eacute;&#233;&#x41;&nbsp; c</p>", "a &<b> ééA c"),
    (f"<nav><ul><li><a href=x>menu one</a></ul></nav><div class='ad'>Buy</div><article><h1>T</h1><p><b>One.<br><p>Two\n  words.</p></article><footer>&copy;</footer>", "T\n\nOne.\n\nTwo words."),
    (f"<div id=header>Site</div><div><h2>Title</h2><p>{LONG}</p><p>Short.</p></div><div class='sidebar'>{LONG}</div><section id=comments><p>{LONG}</p></section>", f"Title\n\n{LONG.strip()}\n\nShort."),
    (f"<script>if (a < b) document.write('<p>no</p>')</script><style>p{{}}</style><main><p>yes</p><form><input value='x'>no</form><aside>no</aside><div class=\"cookie-notice\">no</div><ul><li>i<li>j</ul></main>", "yes\n\ni\n\nj"),
    ("<article><header><h1>Head</h1></header><p>x <i>y</i>z<!-- > no --></p><pre>a\n b</pre><div class=comments><p>no</div></article>", "Head\n\nx yz\n\na b"),
    (f"<table><tr><td>{LONG}<td>cell</table><div><a href=1>{LONG}</a></div>", f"{LONG.strip()}\n\ncell"),
    # A menu before the text, in one list and without a name; a list of links inside the text; a link of its own stays.
    (f"<div><ul>{MENU}</ul><h2>T</h2>{PARAGRAPHS}<p><a href=x>Source</a></p><p>{LONG}</p><ul>{MENU}</ul></div>", f"T\n\n{TEXT}\n\nSource\n\n{LONG.strip()}"),
    (f"<article><ul>{MENU}</ul><h1><a href=/>T</a></h1>{PARAGRAPHS}<ul>{MENU}</ul><p>The end.</p></article>", f"T\n\n{TEXT}\n\nThe end."),
    # Names that hold one of the words, but do not head it; wrappers named after what they have.
    (f"<div class='comment-free story-related-topic'><article><h1>T</h1>{PARAGRAPHS}</article></div>", f"T\n\n{TEXT}"),
    (f"<article><h1>T</h1><div class='search-engine-review'>{PARAGRAPHS}</div></article>", f"T\n\n{TEXT}"),
    (f"<body class='has-sidebar'><div class='content-sidebar'>{PARAGRAPHS * 4}</div></body>", "\n\n".join([TEXT] * 4)),
    # A teaser beside the text, and an article beside a note; comments longer than the article.
    (f"<article><p>{LONG}</p></article><div><h1>T</h1>{PARAGRAPHS * 2}</div>", f"T\n\n{TEXT}\n\n{TEXT}"),
    (f"<article><h1>T</h1>{PARAGRAPHS}</article><p>{LONG}</p>", f"T\n\n{TEXT}"),
    (f"<article><h1>T</h1><p>{LONG}</p></article><div class='post-comments'>{PARAGRAPHS * 5}</div>", f"T\n\n{LONG.strip()}"),
    (f"<div><h1>T</h1><p>{LONG}</p><div class=ad>Buy</div><p>The end.</p></div><div id='site-footer'>{LONG}</div>", f"T\n\n{LONG.strip()}\n\nThe end."),
    ("<article><p>Short.</p></article><div class='ad'>An advert that is longer than the article</div>", "Short."),
    ("<article><p><a href=x>All of it a link</a></p></article>", "All of it a link"),
    (f"<div><p>{LONG}</p><pre><span class=comment># kept</span> x = 1</pre></div>", f"{LONG.strip()}\n\n# kept x = 1"),
    ("<article>unclosed <b>bold <script>x", "unclosed bold"),
    ("<p>1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
]


@pytest.mark.parametrize("page,text", CASES)
def test_cases(page, text):
    assert html_text.main_text(page) == text


def test_surges():
    assert html_text.surges([3, 0, 0, 0, 1, 90, 2, 0, 5, 5, 0, 0, 0, 0, 70], 80) == [(0, 1, False), (4, 10, True), (14, 15, False)]
    assert html_text.surges([0, 0], 80) == html_text.surges([], 80) == []


def test_every_page_of_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html_text.extracted(rows.withColumn("text", F.lit("clash"))).collect()}
    import html

    for r in rows.collect():
        # On these pages the article is all between its tags; blocks are parted by tags that begin or end one.
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1|br)>", inner)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_table(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "u", None), (None, None, "<p>" + "x " * 500_000), (2, "v", "<div>" * 3000 + "deep")], "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.n_chars) for r in html_text.extracted(df).collect())
    assert got == [(0, 999_999), (1, 0), (1, 0), (2, 4)]
    assert html_text.extracted(df.limit(0)).count() == 0
