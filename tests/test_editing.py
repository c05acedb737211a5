import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.operators import editing as E

LINES = st.lists(st.sampled_from(["a", "b", "c", "", "long line of text"]), max_size=12)


def test_chunks_cover_lines_within_bounds():
    lines = [f"line {i} " + "x" * (i % 90) for i in range(300)]
    chunks = E.chunk_lines(lines)
    assert [n for a, b, *_ in chunks for n in range(a, b + 1)] == list(range(1, 301))
    assert all(E.MIN_CHARS <= len(t) <= E.MAX_CHARS * E.TOLERANCE for *_, t in chunks)


def test_chunk_rest_is_balanced():
    lines = ["y" * 99] * 11 + ["z" * 60]
    sizes = [len(t) for *_, t in E.chunk_lines(lines)]
    assert len(sizes) == 2 and sizes[1] >= E.MIN_REST


def test_long_lines_are_cut():
    got = E.chunk_lines(["short" * 12, "x" * 2500, "tail" * 20])
    assert [(a, at, len(t)) for a, _, at, t in got] == [(1, -1, 60), (2, 0, 1000), (2, 1000, 1000), (2, 2000, 500), (3, -1, 80)]


def test_small_texts_give_no_chunk():
    assert E.chunk_lines([""]) == [] and E.chunk_lines(["x" * 49]) == [] and len(E.chunk_lines(["x" * 50])) == 1


@settings(max_examples=150, deadline=None)
@given(LINES, LINES)
def test_edit_script_is_shortest_and_rebuilds(a, b):
    script = E.edit_script(a, b)
    assert [b[j] if op == "+" else a[i] for op, i, j in script if op != "-"] == b
    assert [a[i] for op, i, j in script if op != "+"] == a
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert sum(op == "=" for op, *_ in script) == table[-1][-1]


@settings(max_examples=100, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_distance_and_subsequence(a, b):
    import functools

    @functools.cache
    def d(i, j):
        return max(i, j) if not i or not j else min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    assert E.distance(a, b) == d(len(a), len(b))
    lcs = E.common_subsequence(a, b)
    it, other = iter(a), iter(b)
    assert all(c in it for c in lcs) and all(c in other for c in lcs)


def test_line_diff_merges_moved_lines():
    assert E.line_diff("a\nb\nc", "a\n  b\nc") == [("same", "a"), ("same", "b"), ("same", "c")]
    assert E.line_diff("a\nb", "a\nx") == [("same", "a"), ("old", "b"), ("new", "x")]


def test_char_diff():
    assert E.char_diff("abc", "axc") == [("same", "a", 0, 0), ("old", "b", 1, -1), ("new", "x", -1, 1), ("same", "c", 2, 2)]


@settings(max_examples=100, deadline=None)
@given(LINES, LINES)
def test_stream_diff_rebuilds_the_new_text(a, b):
    out = E.stream_diff(a, b)
    assert [x for k, x in out if k != "new"] == a
    assert [x.strip() for k, x in out if k != "old"] == [x.strip() for x in b]


def test_stream_diff_by_gap():
    far = [f"line number {i} of this text" for i in range(6)]
    assert E.stream_diff([*far, "}"], ["}"])[0] == ("new", "}")  # too far for a line that only closes
    assert E.stream_diff([*far[:4], "}"], ["}"]) == [*[("old", x) for x in far[:4]], ("same", "}")]
    assert E.stream_diff([*far, ")"], [")"]) == [*[("old", x) for x in far], ("same", ")")]
    assert E.stream_diff(["abcdefghij"], ["abcdeXXXXj"])[0][0] == "old" and E.stream_diff(["abcdefghij"], ["abcdXXXXXj"])[0][0] == "new"
    assert E.stream_diff(["q", "q", "abcdefghij"], ["abcdefXXXj"])[2:] == [("old", "abcdefghij"), ("new", "abcdefXXXj")]  # 0.48 - 2 * 0.06
    assert E.stream_diff(["    some longer line"], ["some longer line"]) == [("same", "    some longer line")]
    assert E.stream_diff(["  x = 1"], ["x = 1"]) == [("old", "  x = 1"), ("new", "x = 1")]


def test_stream_diff_fuzzy():
    assert E.stream_diff(["const x = 1", "return x"], ["const x = 2", "return x"]) == [("old", "const x = 1"), ("new", "const x = 2"), ("same", "return x")]


def test_edits():
    text = "def f():\n    a = 1\n    return a\n"
    diff = "<<<<<<< SEARCH\n:start_line:2\n-------\na = 1\n=======\na = 2\nb = 3\n>>>>>>> REPLACE\n<<<<<<< SEARCH\n:start_line:3\n-------\n    return a\n=======\n    return a + b\n>>>>>>> REPLACE\n"
    assert E.apply_edits(text, diff) == "def f():\n    a = 2\n    b = 3\n    return a + b\n"
    assert E.apply_edits(text, diff.replace("a = 1", "zzz")) is None


def test_best_window_prefers_the_middle():
    lines = ["x", "hit", "y", "hit", "z"]
    assert E.best_window(lines, "hit", 0, 5) == (1.0, 3)
    assert E.best_window(lines, "hit", 0, 3) == (1.0, 1)
    assert E.best_window([], "hit", 0, 0)[1] == -1


def test_seek():
    lines = ["a  ", " b", "“c”", "a"]
    assert E.seek(lines, ["a"]) == 3 and E.seek(lines, ["a", "b"]) == 0 and E.seek(lines, ['"c"']) == 2 and E.seek(lines, ["q"]) is None and E.seek(lines, []) == 0
    assert E.seek(["k", "a", "k"], ["k"], at_end=True) == 2


def test_extreme_repetition():
    assert E.extreme_repetition("\n".join(["print('hello')"] * 10))
    assert not E.extreme_repetition("\n".join(["a", "b"]))
    assert not E.extreme_repetition("\n".join(["alpha", "12345", "zzz", "qq", "rr", "uu"]))


@pytest.mark.parametrize(("raw", "want"), [("abc\rX", "Xbc"), ("10%\r50%\r100%", "100%"), ("a\r\nb", "a\nb"), ("plain", "plain"), ("", "")])
def test_carriage_returns(raw, want):
    assert E.carriage_returns(raw) == want


def test_backspaces():
    assert E.backspaces("ab\bc") == "ac" and E.backspaces("\b\bx") == "x"


def test_split_commands():
    assert E.split_commands("git add . && git commit -m 'a && b'; ls | wc") == ["git add .", "git commit -m 'a && b'", "ls", "wc"]
    assert E.split_commands("echo 'open") == ["echo 'open"] and E.split_commands("") == []
    assert E.split_commands("a\nb & c") == ["a", "b", "c"]


def test_deep_merge():
    assert E.deep_merge({"a": [1], "b": {"c": 1}}, {"a": [2], "b": {"d": 2}}) == {"a": [1, 2], "b": {"c": 1, "d": 2}}
    assert E.deep_merge({"a": [1]}, {"a": [2]}, overwrite=True) == {"a": [2]}
    assert E.deep_merge({"m": [{"n": 1, "v": 1}]}, {"m": [{"n": 1, "v": 2}]}, keys={"m": "n"}) == {"m": [{"n": 1, "v": 2}]}
    assert E.merge_json("{", "{}") is None


def test_tags():
    assert E.tag_chunks("a<t>b<t>c</t></t>d", "t") == [(False, "a"), (True, "b<t>c</t>"), (False, "d")]
    assert E.tag_chunks("a<t>b", "t") == [(False, "a<t>b")]


def test_prune_tokens():
    encode, decode = str.split, " ".join
    assert E.prune_tokens("a b c", 2, encode, decode) == "a b" and E.prune_tokens("a b c", 2, encode, decode, "last") == "b c"


def test_cache_points():
    u = ["user"] * 9
    assert E.cache_points([50, 60], u, 100, 3) == [1] and E.cache_points([10], u, 5, 2) == [] and E.cache_points([10, 10], u, 100, 2) == []
    assert E.cache_points([50, 60, 70], ["user", "user", "assistant"], 100, 3) == [1] and E.cache_points([50, 60], ["assistant"] * 2, 100, 3) == []
    assert E.cache_points([100, 100, 100, 100], u, 100, 3, [0]) == [0, 3]
    assert E.cache_points([100, 100, 100], u, 100, 3, [0, 1]) == [0, 1]  # a range of one message has no room for a point
    assert E.cache_points([100, 100, 100, 300, 300], u, 100, 3, [0, 1, 2]) == [1, 2, 4]
    assert E.cache_points([100, 100, 100, 50, 60], u, 100, 3, [0, 1, 2]) == [0, 1, 2]


@pytest.mark.parametrize(("current", "made", "want"), [("", "foo()", "insert"), (")", "x)", "repeat"), ("abc", "xyz", "replace")])
def test_completion_kind(current, made, want):
    assert E.completion_kind(current, made) == want


@pytest.mark.parametrize(("path", "patterns", "want"), [
    ("a/b.log", ["*.log"], True), ("a/b.log", ["*.log", "!b.log"], False), ("node_modules/x/y", ["node_modules/"], True), ("src/x", ["/x"], False), ("x", ["/x"], True),
    ("a/q/b", ["a/**/b"], True), ("a/b", ["a/**/b"], True), ("f1", ["f[0-9]"], True), ("keep", ["# keep", ""], False),
])
def test_ignored(path, patterns, want):
    assert E.ignored(path, patterns) is want


def test_line_diff_is_no_longer_than_difflib():
    a, b = list("abcabba"), list("cbabac")
    ours = sum(op != "=" for op, *_ in E.edit_script(a, b))
    theirs = sum(x[0] in "+-" for x in difflib.ndiff(a, b))
    assert ours <= theirs
