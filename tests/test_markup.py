import html as stdlib
import random

import pytest

from lexloom.functions import text as T
from lexloom.operators import markup
from lexloom.sources import readers

PAGE = """<?xml version="1.0"?><!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "http://www.w3.org/TR/xhtml1/DTD/xhtml1-transitional.dtd">
<html xmlns="http://www.w3.org/1999/xhtml"><head><title>a & b</title></head><body><doc>
<page width="600.0" height="800.0"><flow>
<block xMin="310.0" yMin="60.0" xMax="590.0" yMax="70.0"><line xMin="310"><word xMin="310">right</word></line></block>
<block xMin="10.0" yMin="90.0" xMax="290.0" yMax="99.0"><line><word>left</word><word>two</word></line><line><word>R&D;</word><word>&amp;lt;</word></line></block>
</flow><flow>
<block xMin="10.0" yMin="50.0" xMax="290.0" yMax="60.0"><line><word>left</word><word>one</word></line></block>
<block xMin="10.0" yMin="10.0" xMax="590.0" yMax="20.0"><line><word>head</word></line><line><word>Página</word><word>1</word></line></block>
<block xMin="10.0" yMin="700.0" xMax="590.0" yMax="720.0"><line><word>foot</word></line><line><word>www.pciconcursos.com.br</word></line></block>
<block xMin="310.0" yMin="60.0" xMax="400.0" yMax="70.0"><line><word>same place</word></line></block>
</flow></page>
<page width="600.0" height="800.0"></page>
<page width="600.0" height="800.0"><flow><block xMin="1.0" yMin="1.0" xMax="599.0" yMax="2.0"><line><word>last</word></line></block></flow></page>
</doc></body></html>"""


def test_positioned_pages_become_ordered_text(spark):
    df = spark.createDataFrame([("a", PAGE), ("b", "no page"), ("c", None)], "exam string, xhtml string")
    blocks = readers.xhtml_blocks(df, "exam", "xhtml")
    assert blocks.count() == 7
    texts = {r.exam: r.text for r in readers.layout_texts(blocks, "exam").collect()}
    assert texts == {"a": "head\nleft one\nleft two\nR&D; <\nright\nsame place\nfoot\n\f\nlast"}


def test_references_are_decoded_as_in_the_standard_library(spark):
    rng = random.Random(1)
    some = ["&amp;", "&lt;", "&#39;", "&#x1F600;", "&eacute;", "&nbsp;", "&copy;", "&apos;", "&unknown;", "&", ";", "&&amp;lt;", "a", "é", " ", "&#0;", "&#xD800;", "&#9999999;", "&lt", "&middot;"]
    texts = ["".join(rng.choice(some) for _ in range(rng.randint(0, 8))) for _ in range(300)]
    texts = [t for t in texts if not any(x in t.replace("&amp;", "").replace("&lt;", "") for x in ("&lt", "&amp"))]  # a semicolon is asked for here
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.unescape("t")).collect()]
    assert got == [stdlib.unescape(t) for t in texts]


def tree(pieces):
    """Blocks with their open containers by a stack."""
    stack, out, text = [], [], ""

    def end():
        nonlocal text
        if text.split():
            out.append((len(stack), "/".join(stack), " ".join(text.split())))
        text = ""

    for p in pieces:
        name = p.strip("</> ").split(" ")[0].lower()
        if not p.startswith("<"):
            text += p
        elif name in markup.BREAKS:
            end()
        elif name in markup.CONTAINERS:
            end()
            if p.startswith("</"):
                stack[-1:] = []
            else:
                stack.append(name)
    end()
    return out


def test_block_tree_matches_a_stack(spark):
    rng = random.Random(3)
    pages = []
    for i in range(120):
        pieces = []
        for _ in range(rng.randint(0, 40)):
            tag = rng.choice(["div", "ul", "li", "P", "br", "b", "nav", "article", "Footer", "span"])
            pieces.append(rng.choice([f"<{tag}>", f"</{tag}>", "some text", " ", f'<{tag} class="x">', "more"]))
        pages.append((i, pieces))
    df = spark.createDataFrame([(i, "".join(p)) for i, p in pages] + [(900, None), (901, "")], "page_id long, html string")
    got = {}
    for r in markup.block_tree(df, "page_id", "html").orderBy("page_id", "block").collect():
        got.setdefault(r.page_id, []).append((r.depth, r.path, r.text))
    assert got == {i: t for i, p in pages if (t := tree(p))}


@pytest.mark.parametrize("page,want", [
    ("<script>if (a < b) '</p>'</script>x<!-- <div> -->y", [("", "xy")]),
    ("<div>a<style>p{}</style>b</div></div></div><ul>c", [("div", "ab"), ("ul", "c")]),
    ("2 < 3 &lt; 4", [("", "2 < 3 < 4")]),
    ("<div/>" + "<div>" * 60 + "deep", [("/".join(["div"] * 60), "deep")]),
])
def test_block_tree_cases(spark, page, want):
    rows = markup.block_tree(spark.createDataFrame([(1, page)], "k long, html string"), "k", "html").orderBy("block").collect()
    assert [(r.path, r.text) for r in rows] == want


def test_reading_order_of_a_page(spark):
    page = "<nav>menu</nav><div>side</div><article><h1>main</h1><p>text</article><footer>end</footer>"
    blocks = markup.placed(markup.block_tree(spark.createDataFrame([(1, page)], "k long, html string"), "k", "html"))
    assert markup.reading_text(blocks, "k").first()["text"] == "menu\nmain\ntext\nside\nend"
