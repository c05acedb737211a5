"""What the lexer takes for a name, a value and a constant."""

import time

import pytest

from loomline.llm import secrets

KEY = "Xk29fLq0Zt81MnP4"


def found(text):
    return [text[a:b] for a, _, b in sorted(secrets.assigned_spans(text))]


@pytest.mark.parametrize(("text", "literals"), [
    ('auth_credential = "' + KEY * 40 + '"', [KEY * 40]),
    ("auth_credential = " + KEY * 40 + "\n", [KEY * 40]),
    ('db_pwd = "Xk29\\"fLq0Zt81MnP4"', ['Xk29\\"fLq0Zt81MnP4']),
    (f'private_key = """{KEY}"""', [KEY]),
    (f"private_key = r'''{KEY}'''", [KEY]),
    (f'A = "Zx81Qw92Er73Ty64"\nauth_key = A + "{KEY}"', ["Zx81Qw92Er73Ty64", KEY]),
    (f'A = "Zx81Qw92Er73Ty64"\nauth_key = A+"{KEY}"', ["Zx81Qw92Er73Ty64", KEY]),
    (f'auth = "Zx81Qw92"\nauth += "{KEY}"', ["Zx81Qw92", KEY]),
    (f'client_secret = (\n    "Zx81Qw92"\n    "{KEY}"\n)', [f'Zx81Qw92"\n    "{KEY}']),
    (f'PART = "Zx81Qw92Er73"\nbearer = f"{{PART}}{KEY}"', ["Zx81Qw92Er73", KEY]),
    (f"bearer = `{KEY}`", [KEY]),
    (f"# access_key: '{KEY}'", [KEY]),
    (f"/* signature = '{KEY}abcd' */ int signature_bits = 5;", [KEY + "abcd"]),
    (f'connect(host="db", pwd="{KEY}")', [KEY]),
    (f'os.environ["DB_PWD"] = "{KEY}"', [KEY]),
    (f'pwd: str = "{KEY}"', [KEY]),
    (f'if pwd == "{KEY}":', [KEY]),
    (f"export DB_PWD={KEY}; run", [KEY]),
    (f"DB_PWD=<<EOF\n{KEY}\nEOF\nnext", [KEY]),
    (f"private_key: |\n  {KEY}\n  {KEY}\nother: x", [f"  {KEY}\n  {KEY}\n"]),
    (f"env:\n  - name: DB_PWD\n    value: {KEY}\n", [KEY]),
    (f"<credential type='x'> {KEY} </credential>", [KEY]),
    (f'pwd = os.getenv("DB_PWD_LOOKED_UP_99")', []),
    (f'pwd = os.getenv("DB_PWD", "{KEY}")', [KEY]),
    (f'pwd = b64decode("{KEY}")', [KEY]),
    (f"note: pwd={KEY}", [KEY]),
    (f"they don't say pwd: '{KEY}' and don't care", [KEY]),
    ("pwd = other_name_entirely()", []),
    ("The pwd: see the manual", []),
])
def test_values(text, literals):
    assert found(text) == literals


@pytest.mark.parametrize("text", ["paſsword=abcdefghijkl1234", "toKen=abcdefghijkl1234"])
def test_letters_beyond_ascii_are_no_letters_of_a_keyword(text):
    assert secrets.base_spans(text) == []


@pytest.mark.parametrize("part", ["a=", "a:b:", 'a="', "a='''", "a=<<E\n", "a: |\n", "pwd=", "pwd = x + ", "a=f(", "-", "a=\\\n", '{"a":', "a += "])
def test_time_of_unclosed_forms_grows_with_the_text(part):
    began = time.time()
    secrets.assigned_spans("key=" + part * 50_000 + "=")
    assert time.time() - began < 20
