"""Scalar functions over text, numbers and JSON, as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and their plain forms.
SMART = {"\u201c": '"', "\u201d": '"', "\u2018": "'", "\u2019": "'", "\u2013": "-", "\u2014": "-", "\u00a0": " "}
ELLIPSIS = "\u2026"
#: What scripts call white space, beyond what trim() knows.
SPACE = r"[\s\u00A0\uFEFF\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: The same, character by character, but for the space and what SMART turns into one.
BLANKS = "\t\n\x0b\f\r\ufeff\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
# HTML entities and their characters; the ampersand's comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&#91;", "["), ("&#93;", "]"), ("&lsqb;", "["), ("&rsqb;", "]"), ("&amp;", "&"))
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def replaced(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def trimmed(text: Column) -> Column:
    """Without white space at either end, no-break spaces included."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalized(text: Column) -> Column:
    """SF1: plain quotes, dashes and dots, runs of white space as one space, trimmed."""
    plain = F.replace(F.translate(text, "".join(SMART) + BLANKS, "".join(SMART.values()) + " " * len(BLANKS)), F.lit(ELLIPSIS), F.lit("..."))
    # Every blank is a plain space by now, and only runs of them are left to be replaced; after that one is all that can stand at either end.
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def unescaped_html(text: Column) -> Column:
    """SF2."""
    return replaced(text, ENTITIES)


def escaped_html(text: Column) -> Column:
    """SF3."""
    return replaced(text, ESCAPES)


def highlighted(text: Column, positions: Column, opening: str = "<span>", closing: str = "</span>") -> Column:
    """SF4: characters at the given 0-based positions in spans, runs of them in one; all text escaped."""
    hit = lambda i: F.coalesce(F.array_contains(positions, i), F.lit(False))

    def one(i: Column) -> Column:
        start = F.when(hit(i) & ~hit(i - 1), opening).otherwise("")
        end = F.when(hit(i) & ~hit(i + 1), closing).otherwise("")
        return F.concat(start, escaped_html(F.substring(text, i + 1, F.lit(1))), end)

    return F.when(F.length(text) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0))), one), ""))


def numbered_lines(text: Column, start: int = 1) -> Column:
    """SF5: each line with its right-aligned number and a bar; a trailing newline is kept and not numbered."""
    whole = F.endswith(text, F.lit("\n"))
    body = F.when(whole, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    lines = F.split(body, "\n")
    width = F.length((F.size(lines) + (start - 1)).cast("string"))
    made = F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + start).cast("string"), width, F.lit(" ")), F.lit(" | "), x)), "\n")
    return F.when(text == "", F.lit("" if start == 1 else f"{start} | \n")).otherwise(F.concat(made, F.lit("\n")))


def all_numbered(text: Column) -> Column:
    """SF5: every line has a number."""
    return F.forall(F.split(text, r"\r?\n"), lambda x: x.rlike(r"^\s*\d+\s+\|(?!\|)")) & (text != "")


def without_numbers(text: Column) -> Column:
    """SF5."""
    return F.array_join(F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s*\d+\s+\|(?!\|)\s?", "")), "\n")


def line_count(text: Column) -> Column:
    """SF8: lines; a trailing newline starts none, the empty text has none."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "\n")) - F.endswith(text, F.lit("\n")).cast("int"))


def first_line_if_only(suggestion: Column, prefix: Column) -> Column:
    """SF9: the first line of a suggestion where the text before it on its line is not blank; else all of it."""
    line = F.element_at(F.split(prefix, "\n"), -1)
    return F.when(trimmed(line) != "", F.split_part(suggestion, F.lit("\n"), F.lit(1))).otherwise(suggestion)


def token_count(n: Column) -> Column:
    """SF10: whole k, M and B with one decimal; where rounding reaches 1000, the next unit."""
    k, m = F.floor(n / 1e3 + 0.5), F.floor(n / 1e5 + 0.5) / 10
    short = F.when(k >= 1000, "1.0M").otherwise(F.concat(k.cast("string"), F.lit("k")))
    middle = F.when(m >= 1000, "1.0B").otherwise(F.format_string("%.1fM", m))
    return F.when(n < 1000, n.cast("string")).when(n < 1000000, short).when(n < 1000000000, middle).otherwise(F.format_string("%.1fB", n / 1e9))


def large_number(n: Column) -> Column:
    """SF10: k, m and b with one decimal, without rollover."""
    one = lambda d, unit: F.format_string(f"%.1f{unit}", n / d)
    return F.when(n >= 1e9, one(1e9, "b")).when(n >= 1e6, one(1e6, "m")).when(n >= 1e3, one(1e3, "k")).otherwise(n.cast("string"))


def duration(ms: Column) -> Column:
    """SF11: H:MM:SS of milliseconds."""
    s = F.floor(ms / 1000)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def success_rate(attempts: Column, failures: Column) -> Column:
    """SF12: percent of attempts that did not fail; none: 0%."""
    return F.when(attempts == 0, "0%").otherwise(F.concat(F.format_string("%.0f", F.round((attempts - failures) * 100.0 / F.nullif(attempts, F.lit(0)))), F.lit("%")))


def currency(value: Column) -> Column:
    """SF13: dollars with thousands separators and two decimals."""
    return F.concat(F.when(value < 0, "-$").otherwise("$"), F.format_number(F.abs(value), 2))


def cost(value: Column) -> Column:
    """SF13: two decimals, four at or below 0.05 unless zero."""
    return F.when((value == 0) | (value > 0.05), F.format_string("%.2f", value)).otherwise(F.format_string("%.4f", value))


def relative_time(ts_ms: Column, now_ms: int) -> Column:
    """SF14: how long ago: years of 365 days, months of 30, weeks, days, hours, minutes, or seconds beyond 30."""
    seconds = F.floor((F.lit(now_ms) - ts_ms) / 1000)
    units = [("year", 365 * 86400), ("month", 30 * 86400), ("week", 7 * 86400), ("day", 86400), ("hour", 3600), ("minute", 60)]
    out = F.when(seconds > 30, F.concat(seconds.cast("string"), F.lit(" seconds ago"))).otherwise("just now")
    for unit, size in reversed(units):
        n = F.floor(seconds / size)
        out = F.when(n == 1, f"1 {unit} ago").when(n > 1, F.concat(n.cast("string"), F.lit(f" {unit}s ago"))).otherwise(out)
    return out


def initials(name: Column) -> Column:
    """SF15: the first letters of the parts of a snake_case name, upper case."""
    return F.array_join(F.transform(F.split(name, "_"), lambda x: F.upper(F.left(x, F.lit(1)))), "")


def api_price(text: Column) -> Column:
    """SF16: a price per token as one per million; empty, zero or bad: NULL."""
    return F.nullif(F.expr("1") * text.try_cast("double") * 1e6, F.lit(0.0))


def semver(version: Column) -> Column:
    """SF17: a version as an array of numbers, which compares in order; pre-release suffixes are dropped, missing parts are 0."""
    parts = F.split(F.split_part(F.regexp_replace(version, "^v", ""), F.lit("-"), F.lit(1)), r"\.")
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.get(parts, i).try_cast("int"), F.lit(0)))


def line_hash(line: Column) -> Column:
    """SF19: sha1 of a line without white space at its ends."""
    return F.sha1(F.encode(trimmed(line), "UTF-8"))


def file_hash(text: Column) -> Column:
    """SF20."""
    return F.sha2(text, 256)


def text_range(text: Column, start_line: Column, start_char: Column, end_line: Column, end_char: Column) -> Column:
    """SF21: the text from (line, character) to (line, character), both 0-based, the end exclusive."""
    lines = F.split(text, "\n")
    single = F.substring(F.get(lines, start_line), start_char + 1, end_char - start_char)
    first = F.substring(F.get(lines, start_line), start_char + 1, F.length(text))
    last = F.substring(F.get(lines, end_line), F.lit(1), end_char)
    middle = F.slice(lines, start_line + 2, F.greatest(end_line - start_line - 1, F.lit(0)))
    return F.when(start_line == end_line, single).otherwise(F.array_join(F.concat(F.array(first), middle, F.array(last)), "\n"))


def json_field(text: Column, field: str, kind: str, default=None) -> Column:
    """SF23: a field of a JSON text, or a default for bad JSON and missing fields."""
    return F.coalesce(F.get_json_object(text, f"$.{field}").try_cast(kind), F.lit(default).cast(kind))


def tag_contents(text: Column, tag: str) -> Column:
    """SF24: contents of a tag's elements that do not nest."""
    return F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), 1)


def clean_git_url(url: Column) -> Column:
    """SF25: https, without credentials, query and .git."""
    out = F.regexp_replace(url, r"^git@([^:/]+):", "https://$1/")
    out = F.regexp_replace(out, r"^ssh://(?:[^@/]+@)?", "https://")
    out = F.regexp_replace(out, r"^(https?://)[^@/]+@", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"[?#].*$", ""), r"(?:\.git)?/*$", "")


def repository_name(url: Column) -> Column:
    """SF25: the last part of the path."""
    return F.nullif(F.regexp_extract(clean_git_url(url), r"[/:]([^/:]+)$", 1), F.lit(""))


def symbols(text: Column) -> Column:
    """SF26: distinct tokens between white space and punctuation."""
    return F.array_distinct(F.array_remove(F.split(text, r"[\s.,/#!$%^&*;:{}=\-_`~()\[\]]"), ""))


def content_length(text: Column, reasoning: Column, images: Column, summary: Column) -> Column:
    """SF27: characters, 100 for an image, at least 1."""
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    return F.greatest(F.lit(1), n(text) + n(reasoning) + F.coalesce(F.when(images.isNotNull(), F.size(images)), F.lit(0)) * 100 + n(summary))


def canonical_map(params: Column) -> Column:
    """SF28: a map as JSON with sorted keys."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def suggestion_key(prefix: Column, suffix: Column, text: Column) -> Column:
    """TX18."""
    return F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (prefix, suffix, text)))


def path_segments(path: Column) -> Column:
    """VS15: the parts of a path by index, as a map."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.map_from_entries(F.transform(parts, lambda x, i: F.struct(i.cast("string"), x)))


def without_overlap(prefix: Column, completion: Column) -> Column:
    """XS18: a completion less what it repeats of the prefix: its last line, its last word, or either of these trimmed."""
    tail = F.element_at(F.split(prefix, "\n"), -1)
    word = F.element_at(F.split(prefix, r"\s+"), -1)
    out = completion
    cases = [(F.startswith(completion, tail) & (tail != ""), tail), (F.startswith(completion, word) & (word != ""), word), (F.startswith(completion, trimmed(tail)) & (trimmed(tail) != ""), trimmed(tail))]
    for condition, part in reversed(cases):
        out = F.when(condition, F.substring(completion, F.length(part) + 1, F.length(completion))).otherwise(out)
    return out


def cut_at_stops(text: Column, stops: Iterable[str]) -> Column:
    """WN15: the text before its first stop token.

    A stream is looked at in windows as long as the longest token, so tokens that begin in the last characters, fewer than that, are not stops:
    the first of each is left out of the rest (Q16).
    """
    stops = list(stops)
    most = max(map(len, stops), default=0)
    if not most:
        return text
    full = F.length(text) - (most - 1)
    places = [F.when((F.instr(text, s) > 0) & (F.instr(text, s) <= full), F.instr(text, s)) for s in stops]
    first = F.least(*places) if len(places) > 1 else places[0]
    rest = F.substring(text, F.greatest(full, F.lit(0)) + 1, F.length(text))
    for s in stops:
        at = F.instr(rest, s)
        rest = F.when(at > 0, F.concat(F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + len(s), F.length(rest)))).otherwise(rest)
    return F.when(first.isNotNull(), F.substring(text, F.lit(1), first - 1)).otherwise(F.concat(F.substring(text, F.lit(1), F.greatest(full, F.lit(0))), rest))


def cut_at_suffix(text: Column, suffix: Column, size: int = 20, blank: str = SPACE) -> Column:
    """WN15: the text, read character by character, before the place where its last `size` characters, and one more once there are more, are part of the
    first size * 1.5 characters of what follows it; all of it where the suffix is shorter than `size`. What follows begins after its blanks."""
    target = F.substring(F.regexp_replace(suffix, f"^{blank}+", ""), 1, size * 3 // 2)
    windows = F.transform(F.filter(F.sequence(F.lit(1), F.lit(size * 3 // 2 - size)), lambda i: i + size <= F.length(target)), lambda i: F.substring(target, i, F.lit(size + 1)))
    places = F.filter(F.transform(windows, lambda w: F.instr(text, w)), lambda p: p > 0)
    head = (F.length(text) >= size) & (F.instr(target, F.substring(text, 1, size)) > 0)
    at = F.when(head, F.lit(1)).otherwise(F.array_min(places))
    return F.when((F.length(suffix) < size) | at.isNull(), text).otherwise(F.substring(text, F.lit(1), at - 1))


def path_sort_key(path: Column) -> Column:
    """XS6: orders paths with directories first at each level, then by lower-cased segments with numbers by value. Directories end in /."""
    parts = F.split(F.regexp_replace(path, "/$", ""), "/")
    last = F.size(parts) - 1
    pad = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), r"(\d+)", "00000000000000$1"), r"0+(\d{14})(?!\d)", "$1")
    return F.transform(parts, lambda x, i: F.concat(F.when((i < last) | F.endswith(path, F.lit("/")), "0").otherwise("1"), pad(x)))
