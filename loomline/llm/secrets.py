"""Secret scans by assignment-aware lexing.

Source and configuration text is parsed into (name, literal) pairs. A pair begins where a name meets a sign of assignment or comparison
(`name = `, `name: `, `"name": `, `env["name"] = `, `name: type = `, `name := `, `name += `, `-Dname=`, `name == `), wherever that is: in code, in a
comment, or inside a string, as a string may hold a whole configuration. What follows is lexed as a value: strings with escapes, prefixed, raw,
triple or back-quoted; heredocs; indented blocks after `name: |`; bare words; names of constants; calls, whose last text is the literal unless
they look something up; and any of these joined by operators or standing side by side. Beside these stand `<name>literal</name>` and
`name: KEY` followed by `value: literal`. Text outside of values is not tokenized, so an apostrophe in prose opens no string.

Constants are propagated: a name's last value before its use stands for it, alone or as a part of a joined value or of a template string. A
pair's score adds how sensitive its target's name is to how random its literal looks; literals at `threshold` or above are secrets, kind
`name`. Parts that stand side by side make one span; a constant's span is where its literal is. Names have no scopes: the last value
counts, and a literal that stands in a value several times counts once. Beside these stand the spans of three plain patterns (assign, access, hex), which are always kept.

Scale: one map over Arrow batches, no shuffle. Texts without a sign are passed over by substring searches in C. Nothing has a greatest
length, and what is read is not given back, so time grows with the text.

Defined results: null text counts as empty and has no spans; rows that repeat are scanned each; other columns are ignored; letters are
taken in either case within ASCII only.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.shared import blank_null, documents

# The three base patterns and the least length of what they find.
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_LONG = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "name")

#: How telling a part of a target's name is.
NAME_SCORES = {
    "password": 3.0, "passwd": 3.0, "pwd": 2.5, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "api_key": 3.0,
    "credential": 2.5, "private_key": 3.0, "access_key": 3.0, "auth": 1.5, "bearer": 2.0, "signature": 1.5, "salt": 1.0, "key": 1.0,
}
THRESHOLD = 3.5

_WORDS = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_NAME = r"(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)"
#: Where a pair begins: a name, tried only where its run of characters begins, and a sign. A type may stand between colon and sign.
_SIGN = r"(?P<sign>:=|=>|\+=|={1,3}(?!=)|!={1,2}|:(?!:)(?P<type>[ \t]*+(?:str|string|String|bytes|Final|const|Optional|Text|char|var|auto)(?:\[[^\[\]\n]*+\])?+\??[ \t]*+=(?![=>]))?)"
_HEAD = re.compile(rf"(?<![A-Za-z0-9_.\-])[0-9.\-]*+{_NAME}[\"'`]?\]?[ \t]*+{_SIGN}[ \t]*+")
_STRING = re.compile(
    r"(?:(?P<form>[fF$])|[rRbBuUfF@$]{1,2})?+(?:"
    r'"""(?P<triple>(?:[^"\\]|\\.|"(?!""))*+)"""|' r"'''(?P<thrice>(?:[^'\\]|\\.|'(?!''))*+)'''|"
    r'"(?P<double>(?:[^"\\\n]|\\.)*+)"|' r"'(?P<single>(?:[^'\\\n]|\\.)*+)'|`(?P<back>[^`\n]*+)`)",
    re.S,
)
_BARE = re.compile(r"[^\s\"'`,;<>(){}\[\]]++")
_HEREDOC = re.compile(r"<<[-~]?[ \t]*+[\"']?(?P<tag>[A-Za-z_][A-Za-z0-9_]*+)[\"']?[^\n]*+\n")
_BLOCK = re.compile(r"[|>][+\-0-9]*+[ \t]*+(?:#[^\n]*+)?+\n")
_TAG = re.compile(rf"<{_NAME}(?:\s[^<>]*+)?+>\s*+(?:<!\[CDATA\[)?+(?P<bare>[^<>\s]+?)\s*+(?:\]\]>)?+\s*+</(?P=name)>")
_OPERATOR = re.compile(r"(?:[ \t]|\\?\r?\n)*+(?:\+|\.\.|\.|&|\|\|)(?:[ \t]|\\?\r?\n)*+")
_ASIDE = re.compile(r"[ \t]*+(?:\\\r?\n[ \t]*+)?+(?=[rRbBuUfF@$]{0,2}[\"'`])")
_PARTED = re.compile(r"\s*+(?=[rRbBuUfF@$]{0,2}[\"'`])")
_BETWEEN = re.compile(r"[\s,]*+")
_USED = re.compile(r"\$?\{([A-Za-z_][A-Za-z0-9_.]*+)\}")
_PLAIN_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+\Z")
#: Calls whose text names what they look up.
_LOOKUP = re.compile(r"env|get|config|lookup|input|read|open|load|param|vault|fetch|prompt", re.I | re.A)


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the three patterns: leftmost, non-overlapping per kind, failing matches dropped after they are made."""
    found: list[tuple[int, str, int]] = []
    if _WORDS.search(text):
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    # A run is matched whole, so asking for its length at once finds the same runs.
    found += [(m.start(), "hex", m.end()) for m in HEX_LONG.finditer(text)]
    return found


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def name_score(name: str) -> float:
    """The most telling part of a name; camelCase and dashes are read as underscores."""
    plain = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name).replace("-", "_").replace(".", "_").lower()
    return max((v for k, v in NAME_SCORES.items() if k in plain), default=0.0)


def literal_score(literal: str) -> float:
    """0 to 2: long literals of many different characters look random; prose, paths and placeholders do not."""
    if len(literal) < 8 or re.search(r"\s|\$\{|%\(|^(?:https?|file)://|^[./~]|^(?:null|none|true|false|changeme|example|placeholder)\b|^\*+$|^x+$", literal, re.I):
        return 0.0
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]"))
    return min(1.0, _entropy(literal) / 4.0) + (0.5 if kinds >= 2 else 0.0) + (0.5 if len(literal) >= 16 else 0.0)


#: A literal where it stands: begin and end of its span, and those of its parts' texts.
Segment = tuple[int, int, tuple[tuple[int, int], ...]]
#: A part of a value: the begin and end of a literal's text, or the name of a constant.
Part = tuple[int, int] | str


class _Text:
    """The pairs of a text, in the order in which they begin: start, name, sign, parts of the value."""

    def __init__(self, text: str):
        self.text = text
        self.pairs: list[tuple[int, str, str, list[Part]]] = []
        self.unclosed: set[str] = set()
        self.run = (0, 0)
        todo = [(0, len(text))]
        while todo:
            todo += self._pairs(*todo.pop())
        for m in _TAG.finditer(text):
            self.pairs.append((m.start(), m["name"], "=", [m.span("bare")]))
        self.pairs.sort(key=lambda p: p[0])

    def _pairs(self, at: int, end: int) -> list[tuple[int, int]]:
        """Adds the pairs of a range; returns the ranges of strings that may hold pairs of their own."""
        inner = []
        while m := _HEAD.search(self.text, at, end):
            # A name that is told apart by nothing else takes a bare word whole only if it is sensitive: the word may hold pairs.
            parts, to, bare = self._value(m, end)
            at = m.end() if bare and not name_score(m["name"]) else max(to, m.end())
            for part in parts:
                if not isinstance(part, str) and not bare and any(self.text.find(c, *part) >= 0 for c in ":="):
                    inner.append(part)
            if parts:
                self.pairs.append((m.start(), m["name"], m["sign"], parts))
        return inner

    def _value(self, head: re.Match, end: int) -> tuple[list[Part], int, bool]:
        """The parts of the value after a head, where it ends, and whether it is one bare word."""
        text, at = self.text, head.end()
        if head["sign"] == ":" and (m := _BLOCK.match(text, at, end)):
            return self._block(head.start(), m.end(), end)
        if (m := _HEREDOC.match(text, at, end)) and m["tag"] not in self.unclosed:
            if closed := re.compile(rf"^[ \t]*{m['tag']}\b", re.M).search(text, m.end(), end):
                return [(m.end(), max(m.end(), closed.start() - 1))], closed.end(), False
            self.unclosed.add(m["tag"])
        parted = text.startswith("(", at) and at < end
        if parted:
            at = _PARTED.match(text, at + 1, end).end() if _PARTED.match(text, at + 1, end) else at
        parts: list[Part] = []
        while True:
            if m := _STRING.match(text, at, end):
                parts += self._template(m) if m["form"] or m["back"] is not None else [m.span(next(k for k in ("triple", "thrice", "double", "single") if m[k] is not None))]
                at = m.end()
            elif not parts or not _HEAD.match(text, at, end):
                word = self._word(at, end)
                if word is None:
                    return parts, at, False
                low, high = word
                if text.startswith("(", high) and high < end and _PLAIN_NAME.match(text, low, high):
                    found, to = self._call(low, high, end)
                    return parts + found, to, False
                if high < end and text[high] in "\"'`" and text[high - 1] in "+." and high - 1 > low and _PLAIN_NAME.match(text, low, high - 1):
                    high -= 1
                named = _PLAIN_NAME.match(text, low, high) is not None
                if parts and not named:
                    return parts, at, False
                if not named:
                    return [(low, high)], high, True
                more = _OPERATOR.match(text, high, end)
                if not parts and not (more and (_STRING.match(text, more.end(), end) or _PLAIN_NAME.match(text, more.end(), min(end, more.end() + 1)))):
                    return [text[low:high], (low, high)], high, True
                parts.append(text[low:high])
                at = high
            else:
                return parts, at, False
            more = _OPERATOR.match(text, at, end) or (_PARTED if parted else _ASIDE).match(text, at, end)
            if not more:
                return parts, at, False
            at = more.end()

    def _word(self, at: int, end: int) -> tuple[int, int] | None:
        """A bare word; the end of the run that it is part of is found once."""
        if self.run[0] <= at < self.run[1]:
            return at, min(end, self.run[1])
        m = _BARE.match(self.text, at, end)
        if m and m.end() < end:
            self.run = m.span()
        return m.span() if m else None

    def _block(self, head: int, at: int, end: int) -> tuple[list[Part], int, bool]:
        """The lines after `name: |` that are indented more than its own line."""
        line = self.text.rfind("\n", 0, head) + 1
        indent = re.compile(r"[ \t]*(?:-[ \t]+)?").match(self.text, line).end() - line
        m = re.compile(rf"(?:[ \t]{{{indent + 1},}}[^\n]*+(?:\n|\Z)|[ \t]*\n)*+").match(self.text, at, end)
        return ([(at, m.end())] if m.end() > at else []), m.end(), False

    def _call(self, low: int, high: int, end: int) -> tuple[list[Part], int]:
        """The last text among a call's arguments; that of one that looks something up only if there are several."""
        at, found = _BETWEEN.match(self.text, high + 1, end).end(), []
        while m := _STRING.match(self.text, at, end):
            found.append(m.span(next(k for k in ("triple", "thrice", "double", "single", "back") if m[k] is not None)))
            at = _BETWEEN.match(self.text, m.end(), end).end()
        least = 2 if _LOOKUP.search(self.text, low, high) else 1
        return found[-1:] if len(found) >= least else [], at

    def _template(self, m: re.Match) -> list[Part]:
        """The literals and constants of a template string."""
        kind = next(k for k in ("triple", "thrice", "double", "single", "back") if m[k] is not None)
        parts: list[Part] = []
        at, end = m.span(kind)
        for used in _USED.finditer(self.text, at, end):
            parts += [(at, used.start())] if used.start() > at else []
            parts.append(used[1])
            at = used.end()
        return parts + ([(at, end)] if end > at else [])

    def literal(self, segments: Iterable[Segment]) -> str:
        """What the segments spell; the lines of a block joined, without those that only frame a key."""
        made = re.sub(r"\\(.)", r"\1", "".join(self.text[a:b] for s in segments for a, b in s[2]), flags=re.S)
        if "\n" in made:
            made = "".join(x for line in made.split("\n") if not (x := line.strip()).startswith("-----"))
        return made.strip()


def assigned_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, str, int]]:
    """Spans of literals whose targets, directly or by propagation, make them likely secrets."""
    if not ("=" in text or ":" in text or "</" in text):
        return []
    lexed = _Text(text)
    bound: dict[str, dict[tuple[int, int], Segment]] = {}  # a name's last value: its segments by their spans, each once
    grown: dict[str, float] = {}  # names whose value still grows, and how telling they are
    best: dict[tuple[int, int], float] = {}
    label = 0.0  # how telling the last `name: KEY` was

    def weigh(segments: dict[tuple[int, int], Segment], named: float) -> None:
        if named and segments and (random := literal_score(lexed.literal(segments.values()))):
            for span in segments:
                best[span] = max(best.get(span, 0.0), named + random)

    for _, name, sign, parts in lexed.pairs:
        if len(parts) == 2 and isinstance(parts[0], str) and text[slice(*parts[1])] == parts[0]:
            # One word: a constant's name if there is such a constant, else a literal.
            parts = parts[:1] if _bound(bound, parts[0]) is not None else parts[1:]
        grows = sign == "+=" and name in bound
        if not grows and name in grown:
            weigh(bound[name], grown.pop(name))
        segments = bound[name] if grows else {}
        beside: tuple[int, int] | None = None
        for part in parts:
            if isinstance(part, str):
                segments.update(() if (known := _bound(bound, part)) is segments or known is None else known)
                beside = None
            elif beside:
                low, _, own = segments.pop(beside)
                beside = (low, part[1])
                segments[beside] = (*beside, (*own, part))
            else:
                beside = part
                segments[beside] = (*part, (part,))
        bound[name] = segments
        plain, named = name.lower(), name_score(name)
        if plain in ("name", "key") and segments:
            told = lexed.literal(segments.values())
            label = name_score(told) if _PLAIN_NAME.match(told) else 0.0
        if plain == "value":
            named = max(named, label)
        if grows:
            grown[name] = named
        else:
            weigh(segments, named)
    for name, named in grown.items():
        weigh(bound[name], named)
    return [(a, "name", b) for (a, b), score in best.items() if score >= threshold]


def _bound(bound: dict[str, dict[tuple[int, int], Segment]], name: str) -> dict[tuple[int, int], Segment] | None:
    """The value of a constant, by its whole name or the last part of it."""
    return bound[name] if name in bound else bound.get(name.rsplit(".", 1)[-1])


def ordered(spans: list[tuple[int, str, int]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for a, k, b in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]), s[2]))]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) in code points, end exclusive."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            base, every = [], []
            for text in batch.column(1).to_pylist():
                found = base_spans(text)
                base.append(ordered(found))
                every.append(ordered(found + assigned_spans(text, threshold)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(span)), pa.array(every, pa.list_(span))], names=["doc_id", "base", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), blank_null(text_col).alias("text"))
    kind = "array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(scan, f"doc_id long, base {kind}, spans {kind}")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(documents(spark, sf_dir))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
