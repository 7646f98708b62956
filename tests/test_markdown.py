"""Parsing and normal form."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.markdown.blocks import parse
from quillstone.markdown.nodes import content_size, from_units, plain_text, units, walk
from quillstone.markdown.serialise import serialise


def normal(text):
    return serialise(parse(text)).rstrip("\n")


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("- a\n- b", "* a\n* b"),
        ("* a\n\n- b\n\n+ c", "* a\n\n- b\n\n* c"),
        ("__b__ _i_ ___x___", "**b** *i* ***x***"),
        ("Title\n=====\n\nSub\n---", "# Title\n\n## Sub"),
        ("    code\n\n    more", "```\ncode\n\nmore\n```"),
        ("---", "***"),
        ("| a | b |\n|:--|--:|\n| 1 | 2 |", "| a | b |\n| :- | -: |\n| 1 | 2 |"),
        ("<https://x.org> https://y.org a@b.org", "[https://x.org](https://x.org) [https://y.org](https://y.org) [a@b.org](mailto:a@b.org)"),
        ("&copy; &amp; &lt;", "© & <"),
        ("[x]", "\\[x]"),
        ("\\[Not a link\\](not-a-url)", "\\[Not a link]\\(not-a-url)"),
        ("\\* \\_ a", "\\* \\_ a"),
        ("know....", "know\\...."),
        ("a\\\nb", "a\\\nb"),
        ("- [x] done\n- [ ] open", "* [x] done\n* [ ] open"),
        ("note[^1]\n\n[^1]: text", "note[^1]\n\n[^1]: text"),
        ("<div>\nx\n</div>", "<div>\nx\n</div>"),
        ("``a`b``", "``a`b``"),
        ("a     b\nc", "a     b\nc"),
        ("1. a\n   - b\n2. c", "1. a\n   * b\n2. c"),
        ('[a](b "t") ![c](d)', '[a](b "t") ![c](d)'),
        ("> a\nb\n>\n> - c", "> a\n> b\n>\n> * c"),
        ("3. x\n4. y", "3. x\n4. y"),
        ("```js run\nx\n```", "```js run\nx\n```"),
        ("#hash\n# ", "\\#hash\n\n#"),
    ],
)
def test_normal_form(source, expected):
    assert normal(source) == expected
    assert normal(expected) == expected


@pytest.mark.parametrize(
    ("source", "plain"),
    [
        ("# Title\n\n[Link](x) and `code`", "TitleLink and code"),
        ("**bold** text", "bold text"),
        ("![alt](u)", "alt"),
        ("a  \nb", "ab"),
        ("***\n\n[x]: /u", ""),
        ("| a | b |\n|-|-|\n| 1 | 2 |", "ab12"),
    ],
)
def test_plain_text(source, plain):
    assert plain_text(parse(source)) == plain


def test_positions_are_those_of_the_source():
    text = "> some **bold** and `code`\n> more [link](url)\n"
    for node in walk(parse(text)):
        if node.type in ("strong", "inlineCode", "link"):
            assert text[node.start : node.end] in ("**bold**", "`code`", "[link](url)")


def test_tight_and_loose_lists():
    tight, loose = parse("- a\n- b").children[0], parse("- a\n\n- b").children[0]
    assert not tight.spread and loose.spread
    inner = parse("- a\n\n  b\n- c").children[0]
    assert not inner.spread and inner.children[0].spread


def test_characters_beyond_the_basic_plane_count_twice():
    assert len(units("a😀")) == 3 and from_units(units("a😀")) == "a😀"
    assert content_size(parse(units("😀"))) == 2


_MARKDOWN = st.text(alphabet="ab*_`[]()#>-1. \n~|!<&\\:", max_size=60)


@settings(max_examples=300, deadline=None)
@given(_MARKDOWN)
def test_any_text_parses_and_serialises(text):
    made = serialise(parse(text))
    assert isinstance(made, str)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["word", "two words", "*soft*", "**bold**", "`code`", "[a](b)", "x, y.", "1 2"]), min_size=1, max_size=8), st.sampled_from(["# ", "", "- ", "> ", "1. "]))
def test_normal_form_is_stable(parts, lead):
    once = normal(lead + " ".join(parts))
    assert normal(once) == once
    assert plain_text(parse(once)) == plain_text(parse(lead + " ".join(parts)))


@pytest.mark.parametrize(
    "text",
    ["> " * 2000 + "a", "- " * 1500 + "x", "*" * 4000 + "a" + "*" * 4000, "*a **b " * 800 + "** *" * 800, "[" * 5000, "`" * 5000 + "a", "[*a " * 200 + "*](b)" * 200,
     "\n".join(" " * 2 * i + "- x" for i in range(300)), "\n".join(">" * i + " x" for i in range(300)), "<" * 5000, "_a_" * 3000],
)
def test_hostile_nesting_is_survived(text):
    made = serialise(parse(text))
    assert "a" in made or "x" in made or "\\[" in made or "<" in made
