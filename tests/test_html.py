"""HTML blocks: nesting, ends that are left out, stray ends, entities."""

import pytest

from docloom.operators import blocks

CASES = {
    "<table><tr><td><p>a</p></td><td>b</td></tr></table>": [("table", [["a", "b"]])],
    "<ul><li><p>x</p></li></ul>": [("li", 1, 0, "x")],
    "<blockquote><p>q1</p><p>q2</p></blockquote>": [("p", "q1q2")],
    "<div>t<p>u</p>v</div>": [("p", "u")],
    "<ol><li>a<ul><li>b<li>c</ul>tail<li>d</ol>": [("li", 1, 0, "atail"), ("li", 1, 1, "b"), ("li", 2, 1, "c"), ("li", 2, 0, "d")],
    "<ul><li></li><li> </li><li>x</li></ul><ul><li>y</ul>": [("li", 1, 0, "x"), ("li", 1, 0, "y")],
    "<ul>lost<li>x</li>lost</ul>lost": [("li", 1, 0, "x")],
    "<ul><li>a<table><tr><td>in</td></tr></table></li></ul>": [("li", 1, 0, "ain")],
    "<table><tr><th>k<td>v<tr><tr><td>x<br>y</table>": [("table", [["k", "v"], [], ["x y"]])],
    "<table><td>no row</table><table></table>": [("table", [["no row"]])],
    "<table><tr><td><ul><li>i</li></ul></td></tr></table>": [("table", [["i"]])],
    "<p>x <img src='q.png'> a &lt; b &#169;&#x2014;&amp;lt;</p>": [("img", "q.png"), ("p", "x  a < b ©—&lt;")],
    "<h2>A <i>b</i><img src=no.png></h2><img src=\"y.png\"><hr>": [("h", "A b"), ("img", "y.png"), ("hr",)],
    "<pre>\n x &amp; <b>y</b>\n</pre>": [("code", " x & y")],
    "<dl><dt>T<dd>D</dl><figure><figcaption>F</figcaption></figure>": [("p", "T"), ("p", "D"), ("p", "F")],
    "<section><a href='#'>leaf</a> lost <b>too</b></section>": [("p", "leaf"), ("p", "too")],
    "</div></ul></b><p>ok</p></table>": [("p", "ok")],
    "<P CLASS='a>b'>up<!-- <p>no</p> --><SCRIPT>var p='<p>'</SCRIPT>per": [("p", "upper")],
    "<head><title>no</title><body>just\r\n\r\ntext &amp; more": [("p", "just"), ("p", "text & more")],
    "<p>a < b</p><p></p><p> </p>": [("p", "a < b")],
    "<a " + "x" * 5000: [("p", "<a " + "x" * 5000)],
    "": [],
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, html, "t") for i, html in enumerate(CASES)] + [(1000, None, "t"), (1001, "<p><b>x</p><p>y</b> z<i>w</i></p>", "t"), (1002, "<p>word " * 20_000, "t")]
    out = {}
    for r in blocks.html_blocks(spark.createDataFrame(rows, "page_id long, html string, type string").repartition(3)).orderBy("doc_id", "ord").collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_cases(found):
    for i, (html, want) in enumerate(CASES.items()):
        got = []
        for r in found.get(i, []):
            text = "".join(x["text"] for x in r["runs"] or [])
            got.append(
                {"table": lambda: ("table", r["rows"]), "li": lambda: ("li", r["idx"], r["depth"], text), "img": lambda: ("img", r["src"]), "hr": lambda: ("hr",), "code": lambda: ("code", r["text"])}.get(
                    r["type"], lambda: (r["type"], text)
                )()
            )
        assert got == want, html
        assert [r["ord"] for r in found.get(i, [])] == list(range(len(want)))
    assert 1000 not in found


def test_styles_and_length(found):
    assert [[tuple(x) for x in r["runs"]] for r in found[1001]] == [[("x", True, False)], [("y", True, False), (" z", False, False), ("w", False, True)]]
    assert len(found[1002]) == 20_000 and found[1002][-1]["ord"] == 19_999
