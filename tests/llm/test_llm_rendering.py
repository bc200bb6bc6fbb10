import random

import odd
import pytest
from mediawatch.llm.rendering import Node, render, rendered, rules_by_element, sheet_of

CASES = {
    "a<p>b<p>c": "a\n\nb\n\nc",
    "<ul><li>x<li>y<ol start=3><li>a<li value=7>b<li>c</ol></ul>z": "- x\n- y\n  3. a\n  7. b\n  8. c\n\nz",
    "<dl><dt>t<dd>d<dd>e</dl>": "t\n  d\n  e",
    "<table><tr><th>Name<th align=right>N<tr><td>alpha<td align=right>1<tr><td>be<td align=right>200</table>": "Name     N\nalpha    1\nbe     200",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>long cell</table>": "a  b\n   c\nlong cell",
    "<table><caption>Cap</caption><td>x<table><tr><td>1<td>2</table></table>": "Cap\nx\n\n1  2",
    "<pre>\n a\n   b</pre>c": " a\n   b\n\nc",
    "x<br><br>y<br/>z": "x\n\ny\nz",
    "<style>.ad, p#n, i{display:none}</style><p class='b ad'>1</p><p id=n>2</p><div id=n>3</div><i>4</i>5": "3\n5",
    "<div style='color:red; DISPLAY : none'>1</div><b hidden>2</b><span style='visibility:hidden'>3</span>4": "4",
    "<head><title>t</title><script>if (a<b) '</p>'</script></head>v<!-- c --><template>w</template>": "v",
    "<details><summary>s</summary>d</details><details open><summary>t</summary>e</details>": "s\nt\ne",
    "a &amp; b&nbsp;&nbsp;c &lt;d&gt; &copy &bogus;": "a & b  c <d> © &bogus;",
    "<b>1 <i>2</b> 3</i>  4\n 5": "1 2 3 4 5",
    "a <3 b < c": "a <3 b < c",
    "<p title='a>b' x=\"q\">t</p></div></td>u": "t\n\nu",
    "<select><option>a<option>b</select><input value=no><input type=submit value=Go>": "a\nb\nGo",
    "<blockquote>q<p>r</blockquote>s": "  q\n\n  r\n\ns",
    "<li>one": "- one",
    "<td>x</td>y": "xy",
    "<![CDATA[a<b]]><?php x ?>c": "a<bc",
    "</p>a</br>b": "a\nb",
}


@pytest.mark.parametrize("page", CASES)
def test_layout(page):
    assert render(page) == CASES[page]


SHEETS = {
    "<style>@media print{nav,.ad{display:none}} .x{display:none}</style><nav>1</nav><p class=ad>2</p><p class=x>3</p>": "1\n\n2",
    "<style>@media print{article{display:none}} @import 'a{b'; i{display:none}</style><article>1<i>2</i></article>": "1",
    "<style>@media (max-width:600px){.a{display:none}}@media screen and (min-width: 40em){.b{display:none}}</style><b class=a>1</b><b class=b>2</b>": "1",
    "<style>@media not print{.a{display:none}}@media print, screen{.b{display:none}}</style><b class=a>1</b><b class=b>2</b>3": "3",
    "<style>@media screen{@media print{.a{display:none}}.b{display:none}}.c{display:none}</style><b class=a>1</b><b class=b>2</b><b class=c>3</b>": "1",
    "<style>@keyframes k{from{visibility:hidden}to{x:y}}@font-face{a:b}.c{display:none}</style><b class=c>1</b>2": "2",
    "<style media=print>p{display:none}</style><style>q::before{content:'}'} .a{display:none}</style><p>1</p><b class=a>2</b>": "1",
    "<style>.a{display:none}.a{display:block}</style><b class=a>1</b>": "1",
    "<style>p.a{display:none}.a{display:block}</style><p class=a>1</p>2": "2",
    "<style>.a{display:none !important}.a{display:block}</style><b class=a style='display:block'>1</b>2": "2",
    "<style>.a{color:red;.b{display:none}@media print{display:none}}.c{.d{x:y} display:none}</style><b class=a>1</b><b class=c>2</b>": "1",
    "<style>.a{display:none}</style><b class=a style='display:block'>1</b><i hidden style='display:inline'>2</i>": "12",
    "<div style='visibility:hidden'>1<b style='visibility:visible'>2</b>3</div>": "2",
    "<style>.h{visibility:hidden}.v{visibility:visible}</style><div class=h>1<p class=v>2<i class=h>3</i></p></div>4": "2\n\n4",
    "<style>@media print{.a{display:none}": "",
}


SELECTORS = {
    ".a .b{display:none}": ("<p class=b>1</p><div class=a>2<i><b class=b>3</b></i></div>", "1\n\n2"),
    "div>b{display:none}": ("<div><b>1</b><i><b>2</b></i></div>", "2"),
    "html > body div > .x, h9{display:none}": ("<body><div><b class=x>1</b>2</div>", "2"),
    "i+b{display:none} u ~ s{display:none}": ("<i>1</i><b>2</b><b>3</b><u>4</u><b>5</b><s>6</s>", "1345"),
    "[aria-hidden]{display:none}": ("<b aria-hidden=true>1</b><b>2</b>", "2"),
    "[aria-hidden='true'], [data-x^=\"a,b{\"], [lang|=es]{display:none}": (
        "<b aria-hidden=true>1</b><b aria-hidden=false>2</b><b data-x='a,b{c'>3</b><b lang=es-MX>4</b><b lang=est>5</b>", "25"),
    "[type=AD i]{display:none} [class~=x]{display:none} a[href$='.zip']{display:none} [id*=mid]{display:none}": (
        "<b type=ad>1</b><b class='y x'>2</b><a href=f.zip>3</a><a href=f.zi>4</a><b id=amidst>5</b>", "4"),
    "p.a.b{display:none}": ("<p class='b c a'>1</p><p class=a>2</p>", "2"),
    "*{display:none}": ("<p>1", ""),
    "div *{visibility:hidden} .v{visibility:visible}": ("<div>1<b>2</b><b class=v>3</b></div>", "13"),
    "p:not(.keep, #k){display:none}": ("<p>1</p><p class=keep>2</p><p id=k>3</p>", "2\n\n3"),
    ":is(b,i).x{display:none} :where(#q) u{display:none}": ("<b class=x>1</b><u class=x>2</u><p id=q><u>3</u>4</p>", "2\n\n4"),
    "li:nth-child(2n+1){display:none}": ("<ul><li>1<li>2<li>3<li>4</ul>", "- 2\n- 4"),
    "b:first-child{display:none} b:last-child{display:none}": ("<p><b>1</b><b>2</b><b>3</b></p>", "2"),
    "a:hover{display:none} b::before{display:none} i:nosuch(x){display:none}": ("<a>1</a><b>2</b><i>3</i>", "123"),
    ".md\\:hidden{display:none}": ("<b class=md:hidden>1</b><b class=md>2</b>", "2"),
    "#n .a{display:block} .a.a.a{display:none} div .a{display:none}": ("<div id=n><b class=a>1</b></div><b class=a>2</b>", "1"),
    "div div div div b{display:none}": ("<div>" * 3 + "<b>1</b></div></div><div><div><div><b>2</b>3", "1\n3"),
    ">b{display:none} b>{display:none} b,,i{display:none}": ("<b>1</b><i>2</i>", ""),
    "b[{display:none} u:not({display:none}": ("<b>1</b><u>2</u>", "12"),
}


@pytest.mark.parametrize("sheet", SELECTORS)
def test_selectors(sheet):
    page, text = SELECTORS[sheet]
    assert render(f"<style>{sheet}</style>{page}") == text


def plain_match(selector, node, parents):
    """Backwards and by recursion: does a selector of tags, classes and joins hold for a node?"""
    *left, last = selector
    join, names = last
    if not all(n == node.tag if n[0] != "." else n[1:] in node.attrs.get("class", "").split() for n in names):
        return False
    if not left:
        return True
    parent = parents.get(id(node))
    others = [c for c in parent.children if not isinstance(c, str)] if parent else []
    at = next((i for i, c in enumerate(others) if c is node), 0)
    if join == ">":
        near = [parent] if parent else []
    elif join == " ":
        near = []
        while parent:
            near.append(parent)
            parent = parents.get(id(parent))
    else:
        near = others[:at] if join == "~" else others[max(at - 1, 0) : at]
    return any(plain_match(left, n, parents) for n in near)


def test_joined_selectors_equal_a_backward_search():
    draw = random.Random(3)
    for _ in range(150):
        root = Node("html", {})
        nodes, parents = [root], {}
        for _ in range(40):
            parent = draw.choice(nodes[-8:])
            node = Node(draw.choice("bi"), {"class": draw.choice(["", "x", "y", "x y"])})
            parent.children.append(node)
            parents[id(node)] = parent
            nodes.append(node)
        selectors = [
            [(draw.choice(" >+~"), draw.sample(["b", ".x", ".y"], draw.randint(1, 2))) for _ in range(draw.randint(1, 4))] for _ in range(4)
        ]
        texts = ["".join((j if i else "") + "".join(sorted(names, key=lambda n: n[0] == ".")) for i, (j, names) in enumerate(s)) for s in selectors]
        root.children.insert(0, Node("style", {}, ["".join(f"{t}{{display:none}}" for t in texts)]))
        ruled = rules_by_element(root, sheet_of(root))
        for node in nodes:
            want = sorted(i + 1 for i, s in enumerate(selectors) if plain_match(s, node, parents))
            assert sorted(r[2][3] for r in ruled.get(id(node), ())) == want


@pytest.mark.parametrize("page", SHEETS)
def test_rules_apply_as_on_a_screen(page):
    assert render(page) == SHEETS[page]


@pytest.mark.parametrize(
    "page",
    [None, "", "<", "<" * 20_000, "<p " * 20_000, "<b>" * 20_000 + "x", "<div>" * 20_000 + "y", "<table>" * 300 + "<td>z",
     "<ul><li>" * 500 + "w", '"' * 1000 + '<a b="' * 500, "<!--", "<script>", "<style>i i i b+b{display:none}</style>" + "<i><b>" * 20_000, "<style>" + "a " * 5000 + "{display:none}</style><a>" * 2, "<table><tr><td rowspan=99999 colspan=99999>a<td>b<tr><td>c"],
)
def test_broken_pages_end(page):
    assert isinstance(render(page), str)


def test_pages_keep_their_columns(spark):
    rows = [(1, "<p>a", "x", "old"), (1, "<p>a", "x", "old"), (2, None, None, None), (None, "", "", ""), (3, "<p>" + odd.LONG, "", "")]
    df = spark.createDataFrame(rows, "page_id long, html string, _ string, text string")
    got = rendered(df).collect()
    assert sorted((r["page_id"] or 0, r["text"][:10], r["_"] or "") for r in got) == sorted(
        [(1, "a", "x"), (1, "a", "x"), (2, "", ""), (0, "", ""), (3, odd.LONG[:10], "")]
    )
    assert rendered(df.limit(0)).count() == 0
