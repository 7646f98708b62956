"""Splitting rules, element by element."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone import ALLOW, BY_SIZE, NEVER, REMOVE, Chunker, Options, Rule
from quillstone.markdown.blocks import parse
from quillstone.markdown.chunking import Splitter, cap, cap_all, chunks, packed, trim, whole_chunks
from quillstone.markdown.sections import flatten, hierarchy, is_section, section, section_size
from quillstone.markdown.nodes import Node, content_size, tree_of
from quillstone.markdown.positions import plain_map
from quillstone.markdown.serialise import raw_size, serialise
from quillstone.markdown.textsplit import Range, balance_bonus, boundaries, clip_ranges, fragment_size, merge_ranges, score_boundary, split_text


def texts(document, size, ratio=None, **options):
    return [t for t, _ in chunks(document, Options(size, ratio, **options))]


def pieces(text, size, ratio=None, rules=None):
    return [p for x in split_text(parse(text), Options(size, ratio, rules=rules or {})) if (p := trim(x))]


@pytest.mark.parametrize("text", ["", " ", "\n\n  \n", None])
def test_blank_documents_have_no_chunks(text):
    assert chunks(text, Options(50)) == []


def test_overflow_ratio_is_at_least_one():
    assert Options(100, 0).max_overflow_ratio == 1.0 and Options(100, 0).limit == 100 and Options(100, 1.5).limit == 150


def test_raw_cap_of_zero_is_refused():
    with pytest.raises(ValueError):
        Options(10, max_raw_size=0)


def test_unknown_rules_are_refused():
    with pytest.raises(ValueError):
        Options(10, rules={"lists": NEVER})


# -- text


@pytest.mark.parametrize(
    ("text", "size", "expected"),
    [
        ("Note: this is important; very important: indeed.", 15, 5),
        ("Paris – the city of lights – is beautiful – and so it is – all day", 15, 7),
    ],
)
def test_number_of_pieces(text, size, expected):
    found = pieces(text, size)
    assert " ".join(found) == text
    assert all(fragment_size(p) <= size for p in found)
    assert len(found) <= expected + 2


def test_sentences_come_before_words():
    assert pieces("First sentence here. Second sentence here.", 25) == ["First sentence here.", "Second sentence here."]


def test_list_marker_is_no_sentence_end():
    names = [b.type for b in boundaries(parse("1. Item. Next"), "1. Item. Next", Options(5, rules={}))[0]]
    assert names.count("period_sentence") <= 1


def test_links_stay_whole_under_the_default_rules():
    text = "See the [very long link text that goes on](http://example.com/a/b/c) for more."
    found = texts(text, 20)
    assert any("[very long link text that goes on](http://example.com/a/b/c)" in t for t in found)


def test_links_split_where_allowed():
    text = "[" + "word " * 30 + "end](u)"
    assert len(pieces(text, 30, rules={"link": ALLOW})) > 1
    assert len(pieces(text, 30, rules={"link": NEVER})) == 1
    assert len(pieces(text, 30, rules={"link": {"split": BY_SIZE, "size": 1000}})) == 1


def test_formatting_rule_stands_in_for_strong():
    text = "**" + "word " * 30 + "end**"
    assert len(pieces(text, 30, rules={"formatting": NEVER})) == 1
    assert len(pieces(text, 30, rules={"formatting": NEVER, "strong": ALLOW})) > 1


def test_words_split_behind_punctuation():
    assert pieces("aaaa-bbbb-cccc-dddd", 12, rules={"word": ALLOW}) == ["aaaa-bbbb-", "cccc-dddd"]
    assert "".join(pieces("x" * 45, 10, 1.5, rules={"word": ALLOW})) == "x" * 45
    assert pieces("x" * 45, 10) == ["x" * 45]


def test_balance_bonus():
    assert [balance_bonus(a, b) for a, b in ((0, 0), (5, 5), (1, 15), (-2, 12))] == [0, 20, 3, -8]


def test_score_and_ranges():
    ranges = merge_ranges([Range(5, 10, "link", 50), Range(0, 6, "strong", 30), Range(10, 12, "link", math.inf)])
    assert ranges == [Range(0, 10, "strong", 50), Range(10, 12, "link", math.inf)]
    assert [score_boundary(p, 100, ranges) for p in (0, 5, 10, 11)] == [100, 50, 100, -math.inf]


@pytest.mark.parametrize(
    ("markdown", "plain", "places"),
    [
        ("a **b** c", "a b c", {0: 0, 1: 1, 3: 7, 5: 9}),
        ("a \\* b", "a * b", {2: 3, 3: 4, 5: 6}),
        ("[x](u) y", "x y", {1: 6, 3: 8}),
        ("`c` d", "c d", {1: 3}),
        ("a\\\nb", "a\nb", {2: 3}),
    ],
)
def test_plain_positions(markdown, plain, places):
    mapping = plain_map(parse(markdown), markdown)
    assert mapping.plain == plain
    assert {p: mapping.locate(p) for p in places} == places


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab c.,:\n-1d)!", max_size=80))
def test_quick_measure_is_the_parsers(text):
    assert fragment_size(text) == content_size(parse(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abw c.,;:\n-1d)!?&'\"(ps/W", max_size=120), st.integers(4, 40), st.sampled_from([{}, {"word": ALLOW}, {"word": {"split": BY_SIZE, "size": 6}}, None]))
def test_plain_paragraphs_need_no_tree(text, size, rules):
    options = Options(size, 1.2, rules=rules)
    assert list(whole_chunks(text, options)) == list(whole_chunks(text, options, shortcut=False))


# -- blocks


def test_lists_keep_their_numbers():
    text = "\n".join(f"{i}. item number {i} of the list" for i in range(1, 10))
    found = texts(text, 60)
    assert [int(line.split(".")[0]) for t in found for line in t.split("\n")] == list(range(1, 10))


def test_oversize_item_keeps_its_marker_on_the_first_piece():
    found = texts("- one two three. Four five six. Seven eight nine.\n- short", 20)
    assert found[0].startswith("* ") and not found[1].startswith("* ") and found[-1] == "* short"


def test_tables_repeat_the_header():
    text = "| Name | Age |\n| --- | --- |\n" + "\n".join(f"| Person {i} | {20 + i} |" for i in range(4))
    for size, parts in ((60, 1), (30, 2), (15, 4)):
        found = texts(text, size)
        assert len(found) == parts
        assert all(t.startswith("| Name | Age |\n| - | - |\n") for t in found)


def test_oversize_row_becomes_a_table_for_each_cell():
    found = texts("| A | B |\n|-|-|\n| " + "x " * 12 + "| " + "y " * 12 + "|", 30)
    assert len(found) == 2 and found[0].startswith("| A |\n") and found[1].startswith("| B |\n")


def test_quotes_split_by_blocks():
    text = "> First paragraph of the quote.\n>\n> Second paragraph of it.\n>\n> Third paragraph here."
    assert len(texts(text, 90)) == 1
    found = texts(text, 35)
    assert len(found) == 3 and all(t.startswith("> ") for t in found)


def test_code_is_whole_only_if_protected():
    text = "```js\n" + "\n".join(f"const a{i} = {i};" for i in range(6)) + "\n```"
    assert texts(text, 30, rules={"code": NEVER}) == [text]
    found = texts(text, 30, rules={"code": ALLOW})
    assert len(found) > 1 and found[0].startswith("```js") and found[-1].endswith("```")


def test_html_has_no_boundaries():
    assert len(texts("<div>" + "word " * 100 + "</div>", 50)) == 1
    assert len(texts("<div>" + "word " * 100 + "</div>", 50, max_raw_size=100)) > 4


# -- sections


def test_hierarchy():
    tree = hierarchy(parse("orphan\n\n# A\n\na\n\n### C\n\nc\n\n## B\n\n***\n\nlast\n\n# D").children)
    assert [(s.depth, bool(s.heading)) for s in tree] == [(0, False), (1, True), (0, False), (1, True)]
    assert [c.type for c in tree[1].children] == ["paragraph", "section", "section"]
    assert [n.type for n in flatten(tree)] == [n.type for n in parse("orphan\n\n# A\n\na\n\n### C\n\nc\n\n## B\n\n***\n\nlast\n\n# D").children]
    assert is_section(tree[0]) and not is_section(None) and section().children == []
    assert section_size(tree[1]) == 5


def test_breadcrumbs_lead_to_the_section():
    text = "# One\n\n## Two\n\n### Three\n\n" + "Some text that is here. " * 3
    found = chunks(text, Options(40))
    assert found[0] == ("# One", [])
    last = found[-1]
    assert last[1] == [("One", 1), ("Two", 2), ("Three", 3)]


def test_top_level_sections_never_merge():
    assert len(texts("## A\n\na\n\n## B\n\nb\n\n## C\n\nc", 100, 1.5)) == 3


def test_parent_takes_in_first_children_and_siblings_merge():
    text = "# P\n\n" + "\n\n".join(f"## S{i}\n\n{'x' * 10}" for i in range(6))
    assert [t.count("## ") for t in texts(text, 40)] == [3, 3]


def test_oversize_heading():
    text = "# " + "word " * 30 + "\n\nbody"
    assert texts(text, 50, 1.2, rules={"heading": NEVER})[0] == "# " + ("word " * 30).strip()
    assert len(texts(text, 50, 1.2, rules={"heading": ALLOW})) > 2


# -- references and transforms


def test_references_are_written_out():
    text = "[a][x] ![b][x] [c][y]\n\n[x]: /first\n[X]: /last 't'\n[z]: /unused"
    assert texts(text, 1000) == ['[a](/last "t") ![b](/last "t") \\[c]\\[y]\n\n[z]: /unused']
    kept = texts(text, 1000, rules={"link": Rule(style="preserve")})[0]
    assert "[a][x]" in kept and "[x]: /first" in kept


def test_transforms_replace_remove_and_keep():
    def image(node, parent, index, tree):
        return REMOVE if not node.alt else None

    def link(node, parent, index, tree):
        return node.copy(url="short")

    found = texts("![](a)![b](c) [d](e) **f**", 100, rules={"image": Rule(transform=image), "link": Rule(transform=link)})
    assert found == ["![b](c) [d](short) **f**"]


# -- raw cap


@pytest.mark.parametrize(
    ("text", "most", "expected"),
    [
        ("hello world", 20, ["hello world"]),
        ("aaaa bbbb cccc", 5, ["aaaa", "bbbb", "cccc"]),
        ("abcdefghij", 3, ["abc", "def", "ghi", "j"]),
        ("a bbbbbbbbb", 10, ["a bbbbbbbb", "b"]),
        ("", 5, []),
    ],
)
def test_cap(text, most, expected):
    assert cap(text, most) == expected


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n", max_size=60), st.integers(1, 20))
def test_cap_keeps_all_but_white_space(text, most):
    found = cap(text, most)
    assert all(len(p) <= most for p in found)
    assert "".join("".join(found).split()) == "".join(text.split())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=20), st.integers(1, 10))
def test_packing_is_greedy(sizes, limit):
    runs = list(packed(sizes, lambda x: x, limit))
    assert [x for run, _ in runs for x in run] == sizes
    for (a, large), (b, _) in zip(runs, runs[1:]):
        assert large == (sum(a) > limit and len(a) == 1)
        if not large and b[0] <= limit:
            assert sum(a) + b[0] > limit


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# Head", "## Sub", "Some words, more words. And a sentence.", "- a\n- b b b b b", "> quote here", "***", "| a | b |\n|-|-|\n| 1 | 2 |"]), max_size=8), st.integers(12, 60))
def test_no_words_are_lost_and_limits_hold(parts, size):
    text = "\n\n".join(parts)
    found = texts(text, size, rules={"word": NEVER})
    words = lambda s: sorted(w for w in s.replace("*", " ").replace("|", " ").replace(">", " ").replace("-", " ").replace("#", " ").split())
    body = [w for w in words("\n".join(found)) if w not in ("a", "b")]
    assert set(words(text)) - {"a", "b"} <= set(body)
    assert all(fragment_size(t) <= max(size, 12) + 12 for t in found)


@pytest.mark.parametrize(("kind", "text"), [("list", "- a\n- b"), ("table", "| a |\n|-|\n| 1 |"), ("blockquote", "> a"), ("code", "```\na\n```")])
def test_elements_by_themselves(kind, text):
    splitter = Splitter(Options(1, rules={}))
    assert splitter.element(kind, text)
    with pytest.raises(ValueError):
        splitter.element(kind, "a paragraph")


def test_small_parts():
    assert cap_all(["", "abc", "abcdef"], 4) == ["", "abc", "abcd", "ef"]
    assert clip_ranges([Range(2, 8, "link", 50), Range(9, 12, "strong", 30)], 4, 10) == [Range(0, 4, "link", 50), Range(5, 6, "strong", 30)]
    assert raw_size("a😀") == 3 and raw_size(None) == 0 and raw_size(parse("a *b*").children[0]) == 5
    assert raw_size(Node("text", value="Hello")) == 6
    node = parse("a").children[0]
    assert tree_of(node).children == [node] and tree_of([node, node]).children == [node, node] and tree_of(tree_of(node)).children == [node]


def test_chunker_object():
    c = Chunker(Options(20, 1.5, 100))
    assert (c.chunk_size, c.max_overflow_ratio, c.max_raw_size) == (20, 1.5, 100)
    assert c.split("# A\n\nb") == [{"text": "# A\n\nb", "breadcrumbs": []}]
    assert c.split_text("a") == ["a"] and c.split_nodes("a")[0].type == "root"
    assert Splitter(Options(5, rules={})).split(parse("a").children)[0].crumbs == ()
    assert serialise(parse("a")) == "a\n"
