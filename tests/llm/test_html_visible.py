"""What is visible of a page, against an independent walker, and the grid of tables."""

import random
import re
from html.parser import HTMLParser

import pytest

from paneltide.llm import html_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p style='backface-visibility:hidden'>a</p>", "a"), ("<p style='--x-display:none'>a</p>", "a"),
        ("<p style='display:none;display:block'>a</p>", "a"), ("<p style='display:none !important;display:block'>a</p>b", "b"),
        ("<p style='display:/* x */none'>a</p>b", "b"), ("<p style=\"content:'display:none;'\">a</p>", "a"), ("<p style='display:none bad;;'>a</p>", "a"),
        ("<div style='visibility:hidden'>a <b style='visibility:visible'>b</b> c</div>", "b"),
        ("<div style='visibility:hidden'><p>a</p><p style='visibility:visible'>b<i style='visibility:inherit'>c</i></p></div>", "bc"),
        ("<div style='display:none'><p style='visibility:visible;display:block'>a</p></div>b", "b"), ("<p hidden style='display:block'>a</p>", "a"),
        ("<p hidden=until-found>a</p>b", "b"), ("<div style='visibility:hidden'><input value=a><img alt=b><select><option>c</select></div>d", "d"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a | b\n  | c"),
        ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f<td>g</table>", "a | b | c\nd     | e\nf     | g"),
        ("<table><tr><td colspan=2>ab<td>c<tr><td>d<td>e<td>f</table>", "ab     | c\nd  | e | f"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tr><td>d</table>", "a | b\n  | c\n  | d"),
        ("<input type=checkbox value=agree>x", "x"), ("<input type=password value=secret>x", "x"), ("<input type=submit value=Send>", "Send"),
        ("<input value=typed>", "typed"), ("<input type=image alt=go value=no>", "go"), ("<input type=radio value=r><input type=range value=5>y", "y"),
        ("<details><summary>a</summary>b<summary>c</summary></details>", "a"), ("<details open><summary>a</summary>b</details>", "a\nb"),
        ("<details>b</details>c", "c"),
    ],
)
def test_visibility(page, text):
    assert html_text.visible_text(page) == text


def test_long_cells_stay_aligned():
    page = f"<table><tr><td>{'x' * 300}<td>a<tr><td>y<td>b</table>"
    first, second = html_text.visible_text(page).split("\n")
    assert first.index(" | ") == second.index(" | ") == 300
    assert html_text.visible_text(page, width=50).split("\n")[1].index(" | ") == 50


def test_deep_tables_keep_their_text():
    for depth in (10, 31, 40, 5000):
        page = "".join(f"<table><tr><td>t{i}<td>" for i in range(depth)) + "core"
        words = re.findall(r"t\d+|core", html_text.visible_text(page))
        assert words == [f"t{i}" for i in range(depth)] + ["core"]
    page = "<table><tr><td>" * 10 + "a<tr><td>b"
    assert html_text.visible_text(page) == "a\nb"


def test_wide_spans_are_cheap():
    row = "<tr>" + "<td colspan=1000 rowspan=60000>a" * 40
    page = "<table>" + row * 200 + "</table>"
    assert html_text.visible_text(page).count("a") == 8000


class Walker(HTMLParser):
    """Texts that well-formed pages show, by a rule of its own: a stack of display and visibility."""

    def __init__(self):
        super().__init__()
        self.stack, self.seen = [(True, True)], []

    def handle_starttag(self, tag, attrs):
        style = dict(attrs).get("style") or ""
        shown, visible = self.stack[-1]
        shown = shown and tag not in ("script", "style") and "hidden" not in dict(attrs) and "display:none" not in style
        if "visibility:" in style:
            visible = "visibility:visible" in style
        self.stack.append((shown, visible))

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if all(self.stack[-1]):
            self.seen += re.findall(r"w\d+", data)


def test_every_visible_text_once_and_in_order():
    rng = random.Random(21)
    for _ in range(300):
        count = [0]

        def word():
            count[0] += 1
            return f"w{count[0]}"

        def style():
            return rng.choice([""] * 8 + [" hidden", " style='display:none'", " style='color:red;visibility:hidden'", " style='visibility:visible'"])

        def inline(depth):
            parts = [word()]
            for _ in range(rng.randrange(3)):
                if depth and rng.random() < 0.4:
                    t = rng.choice(["b", "i", "span", "a", "script" if rng.random() < 0.1 else "em"])
                    parts.append(f"<{t}{style()}>{word() if t == 'script' else inline(depth - 1)}</{t}>")
                parts.append(" " + word() + rng.choice([" ", "", "\n"]))
            return " ".join(parts)

        def block(depth):
            kind = rng.choice(["p", "div", "ul", "ol", "table", "blockquote", "h2", "pre", "section", "dl"])
            if kind in ("p", "h2", "pre") or depth == 0:
                t = kind if kind in ("p", "h2", "pre") else "p"
                return f"<{t}{style()}>{inline(2).replace(chr(10), ' ') if t == 'pre' else inline(2)}</{t}>"
            if kind in ("ul", "ol"):
                return f"<{kind}{style()}>" + "".join(f"<li{style()}>{inline(1)}{block(depth - 1) if rng.random() < 0.3 else ''}</li>" for _ in range(rng.randrange(1, 4))) + f"</{kind}>"
            if kind == "dl":
                return "<dl>" + "".join(f"<dt>{inline(1)}</dt><dd{style()}>{inline(1)}</dd>" for _ in range(2)) + "</dl>"
            if kind == "table":
                cell = lambda: f"<td{rng.choice(['', '', ' colspan=2', ' rowspan=2'])}{style()}>{inline(1)}</td>"
                return f"<table{style()}>" + "".join(f"<tr{style()}>" + "".join(cell() for _ in range(rng.randrange(1, 4))) + "</tr>" for _ in range(3)) + "</table>"
            return f"<{kind}{style()}>" + "".join(block(depth - 1) for _ in range(rng.randrange(1, 4))) + f"</{kind}>"

        page = "".join(block(3) for _ in range(3))
        walker = Walker()
        walker.feed(page)
        assert re.findall(r"w\d+", html_text.visible_text(page)) == walker.seen, page
