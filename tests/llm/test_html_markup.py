"""Visible text of broken markup and of embedded vocabularies."""

import pytest

from paneltide.llm import html_text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<a href="x"">text one</a> middle <p>more', "text one middle\n\nmore"),
        ("<p class=don't>Hello world</p> rest of page", "Hello world\n\nrest of page"),
        ('<p "x>a</p> b', "a\n\nb"), ("<p a='1'b>c", "c"), ('<p a = "x>y" b>c', "c"), ('<p a=>b"', 'b"'), ('<p ="x>y">z', 'y">z'),
        ('<p a="1"b="2>3">t', "t"), ("<a href=/x/>k</a> z", "k z"), ('<p title="open>lost', ""), ("a<!-->b<!-- c --!>d", "abd"),
        ('<script>a</script b="x>y">after', "after"),
    ],
)
def test_stray_quotes(page, text):
    assert html_text.visible_text(page) == text


def test_attributes_of_stray_quotes():
    assert html_text._attributes(" a=\"x\"\" b=don't c = 'y' d") == {"a": "x", '"': "", "b": "don't", "c": "y", "d": ""}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a <span aria-hidden=true>b</span> c", "a b c"), ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be", "Let x=2 be"),
        ("<math><semantics><mi>x</mi><annotation>no</annotation></semantics><mphantom><mi>n</mi></mphantom></math>y", "xy"),
        ("<svg>no<title>no</title><text x=1>Axis <tspan>one</tspan></text><text>two</text><defs><text>no</text></defs></svg>", "Axis one two"),
        ("<svg><title/><style/><rect/><text>a</text><path d=M0/></svg> b", "a b"), ("<svg><path><p>left</p> on", "left\n\non"),
        ("<svg><text><![CDATA[a<b>c]]></text></svg>d", "a<b>c d"),
        ("<svg><switch><foreignObject><div>one</div></foreignObject><text>two</text></switch></svg>", "one"),
        ("<svg display=none><text>n</text></svg>v", "v"), ("<svg><text hidden>n</text><text style='display:none'>m</text></svg>v", "n v"),
        ("in <select><option>a<option selected>b<option>c</select> now", "in b now"),
        ("<select><option disabled>a<optgroup label=g><option label=L>b</optgroup></select>", "L"),
        ("<select><option hidden selected>Choose<option>a</select>", "Choose"), ("<select><option disabled>a</select>b", "b"),
        ("x<select multiple><option>a<optgroup label=g><option>b<option hidden>n</select>y", "x\na\ng\nb\ny"),
        ("<select><option>a<input value=v> t", "a v t"),
    ],
)
def test_embedded_text(page, text):
    assert html_text.visible_text(page) == text
