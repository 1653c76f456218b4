import random

import pytest

from millrace.functions.markdown import md_spans, md_structure


def blocks(text):
    return [(b[1], b[2], b[3], b[4]) for b in md_structure(text)]


def inlines(text):
    return [(s[2], s[11], *s[3:7]) for s in md_spans(text)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("````md\n```\nx\n```\n````\n```\na\n```", [("fence", 1, 5, None), ("fence", 6, 8, None)]),
        ("- a `x`\n  - b\n    - c\n- d\n", [("item", 1, 3, None), ("item", 2, 3, 0), ("item", 3, 3, 1), ("item", 4, 4, None)]),
        ("> a\nlazy\n\nb", [("quote", 1, 2, None), ("para", 1, 2, 0), ("para", 4, 4, None)]),
        ("> a\n- b", [("quote", 1, 1, None), ("para", 1, 1, 0), ("item", 2, 2, None)]),
        ("> ```\n> x\nout", [("quote", 1, 2, None), ("fence", 1, 2, 0), ("para", 3, 3, None)]),
        ("a\n1. b\n", [("para", 1, 1, None), ("item", 2, 2, None)]),
        ("a\n2. b\n", [("para", 1, 2, None)]),
        ("- a\n\n\tb\n\nc", [("item", 1, 3, None), ("para", 3, 3, 0), ("para", 5, 5, None)]),
        ("<div>\nx\n\ny", [("html", 1, 2, None), ("para", 4, 4, None)]),
        ("text\n<x-y>\nmore", [("para", 1, 3, None)]),
        ("a | b\n--|--\n1 | 2\nend\n\nx", [("table_row", 1, 1, None), ("table_delim", 2, 2, None), ("table_row", 3, 3, None), ("table_row", 4, 4, None), ("para", 6, 6, None)]),
        ("a\n--|--", [("para", 1, 2, None)]),
        ("[x]: y\ntext", [("refdef", 1, 1, None), ("para", 2, 2, None)]),
        ("", []),
        (None, []),
        ("\n \n", []),
    ],
)
def test_blocks(text, want):
    assert blocks(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Use `` a`b `` and `open", [("code", "a`b", 1, 7, 1, 10)]),
        ("\\`no` [a\\](b)", []),
        ("[a [b](c)](d)", [("link", "c", 1, 7, 1, 8)]),
        ("[![CI][i]][c]\n\n[i]: b.svg\n[C]: https://c", [("reflink", "https://c", 1, 11, 1, 12), ("refimage", "b.svg", 1, 7, 1, 8), ("refdef", "b.svg", 3, 5, 3, 10), ("refdef", "https://c", 4, 5, 4, 14)]),
        ("<me@x.io> <b> `<c>`", [("autolink", "mailto:me@x.io", 1, 1, 1, 8), ("code", "<c>", 1, 15, 1, 18)]),
        ("[a](b(c)d 'e') [f]( <g h> )", [("link", "b(c)d", 1, 4, 1, 9), ("link", "g h", 1, 21, 1, 24)]),
        ("> a `b\n> c` d", [("code", "b c", 1, 5, 2, 3)]),
        ("```\n`x`\n```\n    `y`", []),
    ],
)
def test_spans(text, want):
    assert inlines(text) == want


def test_carriage_returns_change_nothing():
    text = "> - a `b`\n\n| c | d |\n|---|---|\n| `e` | f |\n"
    assert list(md_structure(text.replace("\n", "\r\n"))) == list(md_structure(text)) and list(md_spans(text.replace("\n", "\r\n"))) == list(md_spans(text))


def test_any_text_is_read_and_spans_lie_in_it():
    r = random.Random(5)
    pieces = ["- ", "> ", "```", "~~~", "`", "``", "# ", "1. ", "[", "](", ")", "]: ", "<!--", "-->", "<a@b.c>", "|", "\n|-|-|\n", "\n", "\n\n", "    ", "\t", "word ", "*", "---\n", "==\n", "![", "\\", "<div>", "]["]
    for _ in range(3000):
        text = "".join(r.choice(pieces) for _ in range(r.randrange(40)))
        lines = text.split("\n")
        found = list(md_structure(text))
        assert [b[0] for b in found] == list(range(len(found)))
        for idx, _, l0, l1, parent, *_ in found:
            assert 1 <= l0 <= l1 <= len(lines) and (parent is None or (parent < idx or found[parent][1] == "item") and found[parent][2] <= l0 and l1 <= found[parent][3])
        for _, _, kind, l0, c0, l1, c1, o_l0, o_c0, o_l1, o_c1, body, _ in md_spans(text):
            assert (o_l0, o_c0) <= (l0, c0) <= (l1, c1) <= (o_l1, o_c1) and o_c1 <= len(lines[o_l1 - 1]) + 1
            if kind == "code" and l0 == l1 and "|" not in body and "\t" not in lines[l0 - 1]:
                assert lines[l0 - 1][c0:c1] == body


def test_a_long_text_takes_its_length():
    assert len(list(md_spans("`a` [b](c) " * 40_000))) == 80_000
    assert list(md_spans("".join("`" * k + " " for k in range(1, 700)))) == []
    assert len(list(md_structure("> " * 300 + "a\n"))) == 301
