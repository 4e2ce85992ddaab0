from weaveline.operators import chunking as K
from weaveline.operators import markdown as M


def _found(text):
    return [(r.kind, text[r.start : r.end], r.text) for r in M.regions(text)]


def test_regions_by_hand():
    text = (
        "---\ntitle: Queues\n---\n\n# Queues\n\nSome *prose* with [[a/b|a link]]\nand `x_y` code.\n\n***\n\n## Next ##\n\n"
        "```py title\nn = 1\n```\n\n$$x$$\n\n$$\na\n\nb\n$$\n\n> quoted\n> - twice\n\n| h | i |\n|---|:--:|\n| 1 | [two](t.md) |\n\n- one\n  more\n\n- two\n\nlast _words_ here\n"
    )
    assert _found(text) == [
        ("metadata", "---\ntitle: Queues\n---\n", "title: Queues"),
        ("boilerplate", "# Queues", "Queues"),
        ("prose", "Some *prose* with [[a/b|a link]]\nand `x_y` code.", "Some prose with a link\nand `x_y` code."),
        ("heading", "## Next ##", "Next"),
        ("code", "```py title\nn = 1\n```", "n = 1"),
        ("equation", "$$x$$", "x"),
        ("equation", "$$\na\n\nb\n$$", "a\nb"),
        ("quote", "> quoted\n> - twice", "quoted\n- twice"),
        ("table", "| h | i |\n|---|:--:|\n| 1 | [two](t.md) |", "h | i\n1 | two"),
        ("list", "- one\n  more\n\n- two", "one\n  more\ntwo"),
        ("prose", "last _words_ here", "last words here"),
    ]
    assert [r.level for r in M.regions(text) if r.level] == [1, 2]
    assert [r.language for r in M.regions(text) if r.kind == "code"] == ["py title"]


def test_regions_at_the_edges():
    assert _found("    - far in\n") == [("prose", "    - far in", "    - far in")]  # markers stand after up to three blanks
    assert _found("a | b\n-|-\n")[0][0] == "prose"  # a separator needs two dashes a cell
    assert [k for k, _, _ in _found("$$$$\nx\n$$\ny")] == ["equation", "prose"]  # four characters open a block
    assert _found("```\nopen\n~~~\nend") == [("code", "```\nopen\n~~~\nend", "open\n~~~\nend")]
    assert _found("- a\n\nplain") == [("list", "- a", "a"), ("prose", "plain", "plain")]
    assert _found("# T\n\ntext")[0][0] == "heading"  # no front matter, no boilerplate
    assert _found("") == [] and _found("\n \n***\n") == []
    assert _found("#tag") == [("prose", "#tag", "#tag")]
    assert M.clean_inline("a_b_ _c_, __d__ **e** x_y_z") == "a_b_ c, d e x_y_z"
    assert M.front_matter("---\na: 1\n...\nx") == ({"a": 1}, "a: 1", 13) and M.front_matter("---\na: 1\n") == ({}, "", 0)
    astral = "\U0001d4d0 x\n\n- y\n"
    assert [astral[r.start : r.end] for r in M.regions(astral)] == ["\U0001d4d0 x", "- y"]


def test_section_chunks_by_hand():
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    one, two = {"kind": "prose", "text": words(0, 12)}, {"kind": "list", "text": words(20, 24)}
    whole = K.section_chunks("T", ["H"], [one, two], 10, 19, 3)  # 3 tokens of context, 16 of text
    assert whole == [(f"T > H\n\n{one['text']}\n\n{two['text']}", [one, two])]
    # 16 fit, so the first region is a piece; both together are over the target
    assert [t for t, _ in K.section_chunks("T", ["H"], [one, two], 10, 18, 3)] == [f"T > H\n\n{one['text']}", f"T > H\n\n{two['text']}"]
    # a paragraph of 12 words in runs of min(10, 13 - 3) - 3 = 7, the second behind 3 words of the first
    long = {"kind": "prose", "text": f"p q\n\n{words(0, 5)}  {words(5, 12)}"}
    got = K.section_chunks("T", ["H"], [long], 10, 13, 3)
    assert [t.removeprefix("T > H\n\n") for t, _ in got] == ["p q", f"{words(0, 5)}  w5 w6", "w4  w5 w6 w7 w8 w9 w10 w11"]
    assert K.section_chunks("", [], [{"kind": "list", "text": "a b c d"}], 2, 3, 1) == [("a b", [{"kind": "list", "text": "a b c d"}]), ("c d", [{"kind": "list", "text": "a b c d"}])]
