"""Chunking, diffs, edits and terminal text: algorithms that are sequential inside one text. Pure functions, and operators that map them over Arrow batches."""

from __future__ import annotations

import hashlib
import json
import re
import shlex
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MAX_CHARS, TOLERANCE, MIN_CHARS, MIN_REST = 1000, 1.15, 50, 200


def mapped(f: Callable, kind) -> Callable[..., Column]:
    """A function of plain values as an Arrow-batched column function."""
    return F.udf(f, kind, useArrow=True)


# VS7, VS9: line chunks


def chunk_lines(lines: list[str], first_line: int = 1) -> list[tuple[int, int, int, str]]:
    """VS7: (first line, last line, first character or -1, text) of chunks of up to 1150 characters and at least 50; a longer line is cut at 1000.

    Where less than 200 characters would be left over, the last full chunk ends earlier, as long as it keeps its least length.
    Suffix sums give what is left after each line, so each line is looked at a bounded number of times.
    """
    n, most = len(lines), MAX_CHARS * TOLERANCE
    size = [len(x) + (i < n - 1) for i, x in enumerate(lines)]
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        rest[i] = rest[i + 1] + size[i]
    out: list[tuple[int, int, int, str]] = []

    def close(start: int, end: int, held: int) -> None:
        if held >= MIN_CHARS and end >= start:
            out.append((first_line + start, first_line + end, -1, "\n".join(lines[start : end + 1])))

    start = i = held = 0
    while i < n:
        if size[i] > most:
            close(start, i - 1, held)
            out.extend((first_line + i, first_line + i, at, lines[i][at : at + MAX_CHARS]) for at in range(0, len(lines[i]), MAX_CHARS))
            start, i, held = i + 1, i + 1, 0
        elif held and held + size[i] > most:
            cut = i - 1
            if held >= MIN_CHARS and rest[i] < MIN_REST and cut > start:
                # The text after line k is rest[k + 1] long, its own last newline included.
                cut = next((k for k in range(i - 2, start - 1, -1) if rest[start] - rest[k + 1] >= MIN_CHARS and rest[k + 1] + 1 >= MIN_REST), cut)
            close(start, cut, held)
            start = i = cut + 1
            held = 0
            # The line that did not fit begins the next chunk, whatever its length.
            held, i = size[i], i + 1
        else:
            held, i = held + size[i], i + 1
    if start < n:
        close(start, n - 1, held)
    return out


CHUNKS = "file_path string, identifier string, type string, start_line int, end_line int, content string, segmentHash string, fileHash string"


def chunked(files: DataFrame, path: str, text: str, kind: str = "fallback_chunk") -> DataFrame:
    """VS7, VS8 (where no grammar is at hand), VS10: chunks of each file; a segment's hash occurs once per file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole, seen = hashlib.sha256((content or "").encode()).hexdigest(), set()
                for a, b, at, part in chunk_lines((content or "").split("\n")):
                    place = "" if at < 0 else f"{at}-"
                    digest = hashlib.sha256(f"{file}-{a}-{b}-{place}{len(part)}-{part[:100]}".encode()).hexdigest()
                    if digest not in seen:
                        seen.add(digest)
                        rows.append((file, None, kind + ("_segment" if at >= 0 else ""), a, b, part, digest, whole))
            columns = [*zip(*rows, strict=True)] or [()] * 8
            kinds = [pa.string()] * 3 + [pa.int32()] * 2 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in CHUNKS.split(", ")])

    return files.select(F.col(path).cast("string"), text).mapInArrow(run, CHUNKS)


def chunked_sections(lines: DataFrame, sections: DataFrame, key: str, kind: str = "markdown_header") -> DataFrame:
    """VS9: the chunks of each markdown section of at least 50 trimmed characters, with its title. Lines before the first header are a section without one."""
    first = sections.groupBy(key).agg(F.min("start").alias("_f"))
    head = lines.join(first, key, "left").filter(F.col("_f").isNull() | (F.col("pos") < F.col("_f"))).select(key, F.lit(None).cast("string").alias("title"), F.lit(0).alias("start"), "pos", "line")
    body = lines.join(sections.withColumnRenamed("end", "_e"), key).filter((F.col("pos") >= F.col("start")) & (F.col("pos") <= F.col("_e"))).select(key, "title", "start", "pos", "line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    whole = head.unionByName(body).groupBy(key, "start", "title").agg(text.alias("text")).filter(F.length(F.trim("text")) >= MIN_CHARS)
    parts = mapped(lambda t, start: [{"a": a, "b": b, "text": p} for a, b, _, p in chunk_lines(t.split("\n"), start + 1)] if len(t) > MAX_CHARS * TOLERANCE else [{"a": start + 1, "b": start + 1 + t.count("\n"), "text": t}], "array<struct<a:int,b:int,text:string>>")
    return whole.select(key, F.col("title").alias("identifier"), F.lit(kind).alias("type"), F.explode(parts("text", "start")).alias("c")).select(key, "identifier", "type", F.col("c.a").alias("start_line"), F.col("c.b").alias("end_line"), F.col("c.text").alias("content"))


# TX6..TX8, TX10, TX11: matching and editing


def distance(a: str, b: str) -> int:
    """Levenshtein distance, row by row."""
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


_PLAIN = str.maketrans({"“": '"', "”": '"', "‘": "'", "’": "'", "–": "-", "—": "-", " ": " ", "…": "..."})


def similarity(a: str, b: str) -> float:
    if b == "":
        return 0.0
    x, y = (re.sub(r"\s+", " ", t.translate(_PLAIN)).strip() for t in (a, b))
    return 1.0 if x == y else 1 - distance(x, y) / max(len(x), len(y))


def best_window(lines: list[str], chunk: str, low: int, high: int) -> tuple[float, int]:
    """TX6: (score, first line) of the window most like the chunk; of equal scores the one nearest the middle, the left before the right."""
    size = len(re.split(r"\r?\n", chunk))
    middle = (low + high) // 2
    places = {p for p in range(low, middle + 1)} | {p for p in range(middle + 1, high - size + 1)}
    order = sorted(places, key=lambda p: (middle - p) * 2 if p <= middle else (p - middle - 1) * 2 + 1)
    best = (0.0, -1)
    for p in order:
        s = similarity("\n".join(lines[p : p + size]), chunk)
        if s > best[0]:
            best = (s, p)
    return best


_BLOCK = re.compile(r"^<<<<<<< SEARCH[^\n]*\n(?::start_line:[ \t]*(\d+)[^\n]*\n)?(?:-------\n)?(.*?)^=======\n(.*?)^>>>>>>> REPLACE", re.S | re.M)


def apply_edits(content: str, diff: str, threshold: float = 1.0, buffer: int = 40) -> str | None:
    """TX7, XS22: search/replace blocks applied in the order of their lines; later line numbers move with what earlier blocks add.

    A replacement keeps the file's indentation relative to the block's. None if a block is not found.
    """
    lines, delta = content.split("\n"), 0
    blocks = sorted(((int(m[1] or 0), m[2].removesuffix("\n"), m[3].removesuffix("\n")) for m in _BLOCK.finditer(diff)), key=lambda b: b[0])
    if not blocks:
        return None
    for start, search, replace in blocks:
        want, new = search.split("\n") if search else [], replace.split("\n") if replace else []
        if not want:
            return None
        at = start + delta - 1 if start else -1
        if not (0 <= at and lines[at : at + len(want)] and similarity("\n".join(lines[at : at + len(want)]), search) >= threshold):
            low, high = (max(0, at - buffer), min(len(lines), at + len(want) + buffer)) if start else (0, len(lines))
            score, at = best_window(lines, search, low, high)
            if at < 0 or score < threshold:
                return None
        found = lines[at : at + len(want)]
        indent = lambda x: re.match(r"[ \t]*", x)[0]
        base, own = indent(want[0]), indent(found[0])
        made = [own + x[len(base) :] if x.startswith(base) else own[: max(0, len(own) - (len(base) - len(indent(x))))] + x.lstrip(" \t") for x in new]
        lines[at : at + len(want)] = made
        delta += len(made) - len(want)
    return "\n".join(lines)


_LOOK = str.maketrans({**dict.fromkeys("‐‑‒–—―−", "-"), **dict.fromkeys("‘’‚‛", "'"), **dict.fromkeys("“”„‟", '"'), **dict.fromkeys("            　", " ")})


def seek(lines: list[str], pattern: list[str], start: int = 0, at_end: bool = False) -> int | None:
    """TX8: where a sequence of lines stands: exactly, else without trailing space, else trimmed, else with plain punctuation. At the end of the file first, if asked."""
    if not pattern:
        return start
    if len(pattern) > len(lines):
        return None
    last = len(lines) - len(pattern)
    places = [last] if at_end and last >= start else range(start, last + 1)
    for form in (str, str.rstrip, str.strip, lambda x: x.strip().translate(_LOOK)):
        want = [form(x) for x in pattern]
        for p in places:
            if [form(x) for x in lines[p : p + len(pattern)]] == want:
                return p
    return None


def common_subsequence(a: str, b: str) -> str:
    """TX10: a longest common subsequence, the one that the walk back from both ends finds by leaving out characters of `a` first, then of `b`.

    A row of the table of lengths is one integer, whose zero bits tell where the length grows, so long lines cost a few machine words a character.
    """
    every, at = (1 << len(b)) - 1, {}
    for j, y in enumerate(b):
        at[y] = at.get(y, 0) | 1 << j
    rows = [every]
    for x in a:
        row = rows[-1]
        both = row & at.get(x, 0)
        rows.append((row + both | row - both) & every)
    length = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
    out, i, j = [], len(a), len(b)
    left = length(i, j)
    while left:
        if length(i - 1, j) == left:
            i -= 1
        elif rows[i] >> j - 1 & 1:
            j -= 1
        else:
            i, j, left = i - 1, j - 1, left - 1
            out.append(a[i])
    return "".join(reversed(out))


def extreme_repetition(text: str) -> bool:
    """TX11: every line, or every second one, holds what the first shares with its neighbour."""
    lines = text.split("\n")
    if len(lines) < 6:
        return False
    for step in (1, 2):
        shared = common_subsequence(lines[0], lines[step])
        if len(shared) > 5 or len(shared) > len(lines[0]) * 0.5:
            hits = step * sum(shared in x for x in lines[::step])
            if hits > 8 or hits / len(lines) > 0.8:
                return True
    return False


# TX15..TX17: diffs


def edit_script(a: list, b: list, same: Callable = lambda x, y: x == y) -> list[tuple[str, int, int]]:
    """A shortest edit script as (op, index in a, index in b), op one of "=", "-", "+": greedy furthest-reaching paths."""
    n, m = len(a), len(b)
    reach, trace = {1: 0}, []
    for d in range(n + m + 1):
        trace.append(dict(reach))
        for k in range(-d, d + 1, 2):
            x = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            y = x - k
            while x < n and y < m and same(a[x], b[y]):
                x, y = x + 1, y + 1
            reach[k] = x
            if x >= n and y >= m:
                return _path(trace, n, m)
    return []


def _path(trace: list[dict], x: int, y: int) -> list[tuple[str, int, int]]:
    out = []
    for d in range(len(trace) - 1, -1, -1):
        reach, k = trace[d], x - y
        before = k + 1 if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else k - 1
        px = reach[before]
        py = px - before
        while x > max(px, 0) and y > max(py, 0):
            x, y = x - 1, y - 1
            out.append(("=", x, y))
        if d:
            out.append(("+", x, py) if px == x else ("-", px, y))
            x, y = px, py
    return out[::-1]


def line_diff(old: str, new: str) -> list[tuple[str, str]]:
    """TX15: (same | old | new, line); a removed line and an added one that differ in outer white space are one unchanged line; empty lines at the end go."""
    a, b = old.split("\n"), new.split("\n")
    out: list[tuple[str, str]] = []
    kinds = {"=": "same", "-": "old", "+": "new"}
    for op, i, j in edit_script(a, b):
        out.append((kinds[op], b[j] if op == "+" else a[i]))
    merged: list[tuple[str, str]] = []
    for kind, line in out:
        if merged and kind == "new" and merged[-1][0] == "old" and merged[-1][1].strip() == line.strip():
            merged[-1] = ("same", merged[-1][1])
        else:
            merged.append((kind, line))
    while merged and merged[-1] == ("old", ""):
        merged.pop()
    return merged


def char_diff(old: str, new: str) -> list[tuple[str, str, int, int]]:
    """TX16: (same | old | new, characters, place in old, place in new), neighbours of one kind joined; a place is -1 on the other side."""
    out: list[list] = []
    kinds = {"=": "same", "-": "old", "+": "new"}
    for op, i, j in edit_script(list(old), list(new)):
        kind, char = kinds[op], new[j] if op == "+" else old[i]
        if out and out[-1][0] == kind:
            out[-1][1] += char
        else:
            out.append([kind, char, -1 if op == "+" else i, -1 if op == "-" else j])
    return [tuple(x) for x in out]


# Lines that only close something, and how alike lines must be: less so the more old lines lie between them.
CLOSING = ("}", "});", "})")
LIKE, DECAY, CLOSING_GAP = 0.48, 0.06, 4


class _OldLines:
    """Old lines that are still to be matched: where each stands by its trimmed text, and how the nearest ones resemble a new line."""

    def __init__(self, lines: list[str]):
        self.lines = [x.rstrip() for x in lines]
        self.places: dict[str, list[int]] = {}
        for i, x in enumerate(lines):
            self.places.setdefault(x.strip(), []).append(i)

    def equal_from(self, text: str, at: int) -> int | None:
        found = self.places.get(text, [])
        i = bisect_left(found, at)
        return found[i] if i < len(found) else None

    def like_from(self, line: str, at: int, most: int) -> int | None:
        """The nearest line with few enough edits among the `most` next ones."""
        for gap, old in enumerate(self.lines[at : at + most]):
            size = max(len(line), len(old), 1)
            allowed = (LIKE - DECAY * gap) * size
            if abs(len(line) - len(old)) <= allowed and distance(line, old) <= allowed:
                return at + gap
        return None

    def nearest(self, line: str, at: int) -> int | None:
        """Where a new line is matched: blank ones by a blank line that is next; others by the nearest equal or like line."""
        text = line.strip()
        if not text:
            return at if at < len(self.lines) and not self.lines[at].strip() else None
        equal = self.equal_from(text, at)
        if text in CLOSING:
            return equal if equal is not None and equal - at <= CLOSING_GAP else None
        if text == "*":
            return equal
        within = -(-LIKE // DECAY) if equal is None else equal - at
        like = self.like_from(line.rstrip(), at, int(min(within, -(-LIKE // DECAY))))
        return equal if like is None else like


def stream_diff(old: list[str], new: Iterable[str]) -> list[tuple[str, str]]:
    """TX17: (same | old | new, line): each new line is matched with the nearest old one that it equals or resembles; old lines before that are gone.

    A line that was only indented anew keeps its old indentation if it is longer than eight characters, or once such a line was met.
    """
    rest, out, at, kept_indent = _OldLines(list(old)), [], 0, False
    raw = list(old)
    for line in new:
        hit = rest.nearest(line, at)
        if hit is None:
            out.append(("new", line))
            continue
        out += [("old", x) for x in raw[at:hit]]
        was, at = raw[hit], hit + 1
        blank, alike = not line.strip(), rest.lines[hit] == line.rstrip()
        moved = not blank and not alike and was.strip() == line.strip() and (kept_indent or len(line.strip()) > 8)
        kept_indent = kept_indent or (moved and was != line) or (blank and line != "")
        out += [("same", was)] if blank or alike or moved else [("old", was), ("new", line)]
    return out + [("old", x) for x in raw[at:]]


# SF6, SF7, SF18, SF22, SF24: terminal text, commands, JSON, tags


def carriage_returns(text: str) -> str:
    """SF6: each line as a terminal shows it, later parts written over earlier ones; a return before a newline is part of it."""
    out = []
    for line in text.split("\n"):
        ending = "\r" if line.endswith("\r") else ""
        shown = ""
        for part in line.removesuffix("\r").split("\r"):
            shown = part + shown[len(part) :]
        out.append(shown + ("" if ending and shown else ""))
    return "\n".join(out)


def backspaces(text: str) -> str:
    """SF7: a backspace takes the character before it."""
    out: list[str] = []
    for c in text:
        if c != "\b":
            out.append(c)
        elif out:
            out.pop()
    return "".join(out)


def split_commands(line: str) -> list[str]:
    """SF18: the commands of a shell line: parted by &&, ||, ;, | and & and newlines outside quotes."""
    out: list[str] = []
    for part in line.splitlines():
        lexer = shlex.shlex(part, posix=False, punctuation_chars=";|&")
        lexer.whitespace_split, lexer.commenters = True, ""
        own: list[str] = []
        try:
            for token in lexer:
                if set(token) <= set(";|&"):
                    out.append(" ".join(own))
                    own = []
                else:
                    own.append(token)
        except ValueError:  # an open quote: the line is one command
            own = [part.strip()]
        out.append(" ".join(own))
    return [x for x in out if x]


def deep_merge(a, b, overwrite: bool = False, keys: dict[str, str] | None = None):
    """SF22: objects merged key by key, arrays joined (elements of equal `keys` field replaced), other values the second's."""
    if isinstance(a, dict) and isinstance(b, dict):
        return {**a, **{k: deep_merge(a[k], v, overwrite, {"": keys[k]} if keys and k in keys else None) if k in a else v for k, v in b.items()}}
    if isinstance(a, list) and isinstance(b, list) and not overwrite:
        field = (keys or {}).get("")
        kept = [x for x in a if not (field and any(isinstance(x, dict) and isinstance(y, dict) and x.get(field) == y.get(field) for y in b))]
        return kept + b
    return b


def merge_json(a: str, b: str, overwrite: bool = False) -> str | None:
    try:
        return json.dumps(deep_merge(json.loads(a), json.loads(b), overwrite), separators=(",", ":"))
    except ValueError:
        return None


def tag_chunks(text: str, tag: str) -> list[tuple[bool, str]]:
    """SF24: (inside, text) pieces of a text by the outermost elements of a tag; an element that stays open is text."""
    out: list[tuple[bool, str]] = []
    depth = begin = at = 0
    for m in re.finditer(rf"<(/?){re.escape(tag)}>", text):
        if not m[1]:
            if not depth:
                begin = m.start()
            depth += 1
        elif depth:
            depth -= 1
            if not depth:
                if begin > at:
                    out.append((False, text[at:begin]))
                out.append((True, text[begin + len(tag) + 2 : m.start()]))
                at = m.end()
    return out + ([(False, text[at:])] if at < len(text) else [])


def prune_tokens(text: str, most: int, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], keep: str = "first") -> str:
    """BG6: the first or last tokens of a text, by a tokenizer that is given."""
    ids = encode(text)
    return text if len(ids) <= most else decode(ids[:most] if keep == "first" else ids[len(ids) - most :])


def cache_points(tokens: list[int], roles: list[str], least: int, slots: int, before: list[int] = ()) -> list[int]:
    """XS12: user messages after which to set cache points, each covering at least `least` tokens since the one before its range.

    Old points stay. New messages of at least `least` tokens get one after their last user message if a slot is free; else the two neighbours that
    cover least are joined, if what is new is worth a fifth more than they cover, which may free a slot.
    """
    n = len(tokens)
    if n <= 1:
        return []
    upto = [0, *accumulate(tokens)]
    users = [i for i, role in enumerate(roles) if role == "user"]

    def placed(low: int, high: int) -> list[int]:
        at = bisect_right(users, high) - 1
        if low >= high or at < 0 or users[at] < low:
            return []
        since = max((p + 1 for p in before if p < low), default=0)
        return [users[at]] if upto[users[at] + 1] - upto[since] >= least else []

    if not before:
        out: list[int] = []
        while len(out) < slots and (more := placed(out[-1] + 1 if out else 0, n - 1)):
            out += more
        return out
    valid, new = [p for p in before if p < n], upto[n] - upto[min(n, before[-1] + 1)]
    if new < least:
        return valid
    latest = placed(before[-1] + 1, n - 1)
    if slots > len(before):
        return valid + latest
    # What each point and the next one cover together.
    edges = [0, *(min(n, p + 1) for p in before)]
    covered = [upto[edges[k + 2]] - upto[edges[k]] for k in range(len(before) - 1)]
    if not covered or new < min(covered) * 1.2:
        return valid
    k = covered.index(min(covered))
    joined = [p for p in before[:k] if p < n] + placed(edges[k], before[k + 1]) + [p for p in before[k + 2 :] if p < n]
    return joined + (latest if len(joined) < slots else [])


def completion_kind(current: str, completion: str) -> str:
    """XS20: how a one-line completion relates to the rest of the line: insert, repeat (it holds the rest, which is replaced), replace, or part."""
    split = lambda t: re.findall(r"\w+|\s+|[^\w\s]", t)
    pattern = "".join(op for op, *_ in edit_script(split(current), split(completion)))
    pattern = re.sub(r"(.)\1+", r"\1", pattern)
    if pattern in ("+", ""):
        return "insert"
    if pattern in ("+=", "+=+"):
        return "repeat"
    if pattern in ("+-", "-+"):
        return "replace"
    return "part" if pattern[0] == "+" else "insert"


def ignored(path: str, patterns: Iterable[str]) -> bool:
    """FL11: whether gitignore patterns ignore a path: the last one that matches decides."""
    out = False
    for p in patterns:
        p = p.rstrip("\n").strip()
        if not p or p.startswith("#"):
            continue
        negated = p.startswith("!")
        p = p[negated:]
        only_dir = p.endswith("/")
        body = p.strip("/")
        rooted = "/" in p.rstrip("/")
        made = "".join({"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t) or (t if t.startswith("[") and len(t) > 1 else re.escape(t)) for t in re.findall(r"/\*\*/|\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]+\]|.", body))
        if re.match(("" if rooted else "(?:.*/)?") + made + ("/.*" if only_dir else "(?:/.*)?") + r"\Z", path.lstrip("/")):
            out = not negated
    return out


_LINES = lambda t: t.split("\n")
_PIECE = "array<struct<kind:string,line:string>>"


def line_diffs(old: Column, new: Column) -> Column:
    """TX15 as a column: (kind, line) of each line of two texts."""
    return mapped(lambda a, b: [{"kind": k, "line": x} for k, x in line_diff(a or "", b or "")], _PIECE)(old, new)


def stream_diffs(old: Column, new: Column) -> Column:
    """TX17 as a column: (kind, line) of each line of two texts."""
    return mapped(lambda a, b: [{"kind": k, "line": x} for k, x in stream_diff(_LINES(a or ""), _LINES(b or ""))], _PIECE)(old, new)


def char_diffs(old: Column, new: Column) -> Column:
    """TX16 as a column: (kind, characters, place in the old text, place in the new one)."""
    kind = "array<struct<kind:string,chars:string,old:int,new:int>>"
    return mapped(lambda a, b: [dict(zip(("kind", "chars", "old", "new"), x, strict=True)) for x in char_diff(a or "", b or "")], kind)(old, new)


def subsequences(a: Column, b: Column) -> Column:
    """TX10 as a column."""
    return mapped(lambda x, y: common_subsequence(x or "", y or ""), "string")(a, b)


def extreme_repetitions(text: Column) -> Column:
    """TX11 as a column."""
    return mapped(lambda t: extreme_repetition(t or ""), "boolean")(text)


def windows(text: Column, chunk: Column, low: Column | None = None, high: Column | None = None) -> Column:
    """TX6 as a column: (score, first line) of the window most like the chunk, -1 where there is none."""
    n = F.size(F.split(text, "\n"))
    run = mapped(lambda t, c, a, b: dict(zip(("score", "line"), best_window(_LINES(t or ""), c or "", a, b), strict=True)), "struct<score:double,line:int>")
    return run(text, chunk, F.lit(0) if low is None else low, n if high is None else high)


def edited(text: Column, diff: Column, threshold: float = 1.0, buffer: int = 40) -> Column:
    """TX7, XS22 as a column: the text with the blocks of a diff applied, NULL where one is not found. For many files, group diffs by file first."""
    return mapped(lambda t, d: None if t is None or d is None else apply_edits(t, d, threshold, buffer), "string")(text, diff)


def edited_files(files: DataFrame, diffs: DataFrame, path: str, text: str, order: str, diff: str = "diff") -> DataFrame:
    """XS22: each file with its diffs' blocks, in order, applied; files without diffs stay as they are, those whose blocks are not found are NULL."""
    per = diffs.groupBy(path).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, diff))), lambda x: x[diff]), "\n").alias("_diff"))
    joined = files.join(per, path, "left")
    return joined.withColumn(text, F.when(F.col("_diff").isNull(), F.col(text)).otherwise(edited(F.col(text), F.col("_diff")))).drop("_diff")


def sought(text: Column, pattern: Column, start: int = 0, at_end: bool = False) -> Column:
    """TX8 as a column: the line where a sequence of lines stands, NULL if nowhere."""
    return mapped(lambda t, p: seek(_LINES(t or ""), _LINES(p) if p else [], start, at_end), "int")(text, pattern)


def commands(line: Column) -> Column:
    """SF18 as a column."""
    return mapped(lambda x: split_commands(x or ""), "array<string>")(line)


def merged_json(a: Column, b: Column, overwrite: bool = False) -> Column:
    """SF22 as a column: NULL where either is no JSON."""
    return mapped(lambda x, y: None if x is None or y is None else merge_json(x, y, overwrite), "string")(a, b)


def token_count(text: Column, tokenizer: str) -> Column:
    """BG15 as a column: tokens by a tokenizer file, for prompts with the caller's margin of a half, rounded up."""

    def count(t: str | None) -> int:
        from tokenizers import Tokenizer

        kept = vars(sys.modules["tokenizers"]).setdefault("_kept", {})
        if tokenizer not in kept:
            kept[tokenizer] = Tokenizer.from_file(tokenizer)
        return -(-len(kept[tokenizer].encode(t or "", add_special_tokens=False).ids) * 3 // 2)

    return mapped(count, "long")(text)


def pruned_tokens(text: Column, most: int, tokenizer: str, keep: str = "first") -> Column:
    """BG6 as a column: the first or last tokens of a text, by a tokenizer file."""

    def prune(t: str | None) -> str | None:
        from tokenizers import Tokenizer

        kept = vars(sys.modules["tokenizers"]).setdefault("_kept", {})
        if tokenizer not in kept:
            kept[tokenizer] = Tokenizer.from_file(tokenizer)
        own = kept[tokenizer]
        return None if t is None else prune_tokens(t, most, lambda x: own.encode(x, add_special_tokens=False).ids, own.decode, keep)

    return mapped(prune, "string")(text)


def cache_points_of(messages: DataFrame, by: str, order: str, tokens: str, role: str, least: int, slots: int) -> DataFrame:
    """XS12 over a log: per conversation the indexes of the messages after which to set cache points."""
    packed = messages.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).cast("long").alias("n"), F.col(role).alias("r")))).alias("_m"))
    points = mapped(lambda m: cache_points([x["n"] or 0 for x in m], [x["r"] for x in m], least, slots), "array<int>")
    return packed.select(by, points("_m").alias("points"))


def completion_kinds(current: Column, completion: Column) -> Column:
    """XS20 as a column."""
    return mapped(lambda a, b: completion_kind(a or "", b or ""), "string")(current, completion)


def seen_files(files: DataFrame, path: str, patterns: list[str]) -> DataFrame:
    """FL11, SC9, SC10: files that the patterns don't ignore."""
    hidden = mapped(lambda p: ignored(p, patterns), "boolean")
    return files.filter(~hidden(path))


def terminal_text(text: Column) -> Column:
    """SF6, SF7 as a column: what a terminal shows."""
    return mapped(lambda t: None if t is None else backspaces(carriage_returns(t)), StringType())(text)
