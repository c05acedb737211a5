"""Secrets whose literals, names and alignment are wider than any bound."""

import random
import string
import time

import pytest

from loomline.llm import secrets

LONG = "".join(random.Random(1).choices(string.ascii_letters + string.digits, k=5000))


@pytest.mark.parametrize("size", [511, 512, 513, 5000])
@pytest.mark.parametrize("form", [
    'private_key = "{}"', "access_key: '{}'", "credential={}", "<bearer>{}</bearer>", 'signature := "{}" # end', 'x{0}_pwd = "{1}"',
])
def test_long_literals_and_names(form, size):
    value = LONG[:size]
    text = form.format("y" * 100, value) if "{1}" in form else form.format(value)
    assert [text[a:b] for a, _, b in secrets.assigned_spans(text)] == [value]


@pytest.mark.parametrize("blanks", [8, 9, 60])
def test_wide_alignment(blanks):
    gap = " " * blanks
    for text in (f'access_key{gap}= "{LONG[:40]}"', f"access_key ={gap}{LONG[:40]}", f"access_key{gap}:={gap}'{LONG[:40]}'", f'access_key\t{gap}: "{LONG[:40]}"'):
        assert [text[a:b] for a, _, b in secrets.assigned_spans(text)] == [LONG[:40]]
    joined = f'auth = "{LONG[:9]}"{gap}+{gap}"{LONG[9:700]}"'
    assert [joined[a:b] for a, _, b in secrets.assigned_spans(joined)] == [joined[8:-1]]


def test_pairs_inside_a_long_string_are_kept():
    inner = f"access_key = {LONG[:40]}"
    text = 'config: "' + "word " * 300 + inner + ' end"'
    assert [text[a:b] for a, _, b in secrets.assigned_spans(text)] == [LONG[:40]]


@pytest.mark.parametrize("part", ["a", " ", "a = '", 'a="x"+', "<a>", "1-", "a:\"b='c=d'\""])
def test_time_grows_with_the_text(part):
    began = time.time()
    secrets.assigned_spans("key=" + part * 200_000 + "=")
    assert time.time() - began < 20
