"""Layouts of pages: blocks that are named K are the article's, in order; blocks that are named N are not."""

import re

import pytest

from socspark.llm import html_text

WORDS = " and words of the story go on and on"
LAYOUTS = {
    "title and lead before a long body": "<main><h1>K1</h1><p>K2</p><div class=body><p>K3*</p><p>K4*</p></div></main>",
    "sections of unlike size": "<article><section><p>K1*</p><p>K2*</p></section><section><p>K3</p></section></article>",
    "a long list": "<main><h1>K1</h1><p>K2</p><ul><li>K3*</li><li>K4*</li></ul></main>",
    "a long table": "<main><h1>K1</h1><p>K2</p><table><tr><td>K3*</td><td>K4*</td></tr></table></main>",
    "headline outside the article": "<h1>K1</h1><article><p>K2*</p></article>",
    "long comments after a short post": "<div class=post><p>K1</p></div><div id=comments><p>N1*</p><p>N2*</p><p>N3*</p></div>",
    "comments as articles": "<div class=post><p>K1</p></div><section id=comments><article class=comment><p>N1*</p></article><article class=comment><p>N2*</p></article></section>",
    "comments inside the article": "<article><p>K1</p><div class=comments><p>N1*</p><p>N2*</p></div><p>K2</p></article>",
    "only comments beside a menu": "<nav><a>N1</a></nav><article><p>K1</p></article><ol class=commentlist><li>N2*</li><li>N3*</li></ol>",
    "headline in a block of its own": "<header><p>N1</p></header><div class=title><h1>K1</h1></div><p>K2</p><article><p>K3*</p></article>",
    "two divisions": "<div class=a><p>K1</p></div><div class=b><p>K2*</p><p>K3*</p></div>",
    "three levels of wrappers": "<div id=page><div class=wrap><div class=inner><h2>K1</h2><p>K2*</p></div><div class=inner><p>K3</p></div></div></div>",
    "figure and caption": "<article><figure><img src=x><figcaption>K1</figcaption></figure><p>K2*</p></article>",
    "quote and code": "<article><blockquote>K1</blockquote><pre>K2*</pre><p>K3</p></article>",
    "definition list": "<article><p>K1</p><dl><dt>K2<dd>K3*<dt>K4<dd>K5</dl></article>",
    "several articles": "<main><article><p>K1*</p></article><article><p>K2</p></article></main>",
    "articles without main": "<div><article><p>K1*</p></article><article><p>K2</p></article></div>",
    "header and footer of the article": "<article><header><h1>K1</h1></header><p>K2*</p><footer><p>N1</p></footer></article>",
    "form around the page": "<form><div><p>K1*</p><p>K2</p></div></form>",
    "noise of every kind": "<header><p>N1</p></header><nav><ul><li><a>N2</a></ul></nav><div class=cookie-notice><p>N3</p></div><article><h1>K1</h1><p>K2</p><div class=ad-box><p>N4*</p></div><aside><p>N5</p></aside><script>N6</script><style>N7</style><form><p>N8</p></form><p>K3</p></article><div class=sidebar><p>N9*</p></div><footer><p>N0</p></footer>",
    "unclosed paragraphs": "<article><p>K1<p>K2*<p>K3</article>",
    "line breaks and inline tags": "<article><p><b>K1</b></p><div>K2 <i>with</i> <u>marks</u></div><p>K3*</article>",
    "links in running text": "<article><p><a href=x>K1</a></p><p>K2* <a href=y>with a link</a></p></article>",
    "menu of links beside a division": "<ul><li><a>N1</a><li><a>N2</a></ul><div><h2>K1</h2><p>K2*</p></div>",
    "linked headline beside the body": "<div><h2><a href=x>K1</a></h2><div class=body><p>K2*</p></div></div>",
    "article in a box named as noise": "<div class=sponsored><article><p>K1*</p></article></div>",
    "nothing but comments": "<div id=comments><p>N1*</p></div>",
    "hidden blocks": "<article><p>K1</p><div hidden><p>N1*</p></div><p aria-hidden=true>N2</p><p>K2</p></article>",
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
@pytest.mark.parametrize("frame", ["{}", "<!doctype html><html><head><title>T</title></head><body>{}</body></html>"])
def test_layout(name, frame):
    page = re.sub(r"\b([KN]\d)(\*?)", lambda m: m[1] + WORDS * (8 if m[2] else 1), frame.format(LAYOUTS[name]))
    text = html_text.extract(page, [])
    lines = text.split("\n") if text else []
    wanted = sorted(set(re.findall(r"\bK\d", LAYOUTS[name])))
    assert [x[:2] for x in lines] == wanted
    assert all(len(x) >= len(WORDS) for x in lines)


def test_the_path_of_a_host_leaves_out_what_stands_beside_it(spark):
    body = lambda i: f"<div class='story-{i}'><h2>Head {i}</h2><p>{WORDS * 5}</p></div>"
    rows = [(i, "http://h.example/", f"<body>{body(i)}</body>") for i in range(9)] + [(9, "http://h.example/", f"<body>{body(9)}<div class=x><p>Unmarked box</p></div></body>")]
    rows += [(10, "http://other.example/", rows[9][2])]
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i].startswith(f"Head {i}\n") and "Unmarked" not in got[i] for i in range(10))
    assert got[10].endswith("Unmarked box")  # alone on its host: nothing is dropped
