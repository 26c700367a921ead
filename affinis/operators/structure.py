"""Calls of sources as a table: a lexer for each family of languages, and rules as conditions on what it found.

Sources are lexed batch by batch in Arrow; strings, comments and nested brackets are known, so calls may go over several
lines, stand side by side, or within each other, and nothing in a comment or a text counts. Matching is columns only.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of an argument's text, and arguments, that a row keeps; a path is never longer.
LONGEST, ARGUMENTS = 300, 16
_QUOTED = {'"': r'"(?:\\.|[^"\\\n])*"', "'": r"'(?:\\.|[^'\\\n])*'", "`": r"`(?:\\.|[^`\\])*`", '"""': r'"""(?:\\.|[^\\])*?"""', "'''": r"'''(?:\\.|[^\\])*?'''", "char": r"'(?:\\.|[^'\\\n])'"}
_COMMENTS = {"c": r"//[^\n]*|/\*.*?\*/", "#": r"#[^\n]*", "--": r"--[^\n]*"}
#: How each family writes comments and texts, and whether a bare word with arguments behind it is a call.
FAMILIES = {
    "script": (("c",), ('"', "'", "`"), ""), "python": (("#",), ('"""', "'''", '"', "'"), "[rRbBuUfF]{0,3}"), "go": (("c",), ('"', "`", "char"), ""), "jvm": (("c",), ('"""', '"', "'"), "[a-z]?"),
    "c": (("c",), ('"', "char"), ""), "ruby": (("#",), ('"', "'"), ""), "elixir": (("#",), ('"""', '"', "'"), ""), "php": (("c", "#"), ('"', "'"), ""), "dash": (("--",), ('"', "'"), ""), "shell": (("#",), ('"', "'"), ""),
}
LANGUAGES = {"TypeScript": "script", "Tsx": "script", "JavaScript": "script", "Python": "python", "Go": "go", "Java": "jvm", "Kotlin": "jvm", "Scala": "jvm", "Swift": "jvm", "Rust": "c", "C": "c", "C++": "c", "Ruby": "ruby", "Elixir": "elixir", "Php": "php", "Lua": "dash", "Haskell": "dash", "Bash": "shell"}
MACROS = ("Ruby", "Elixir")
#: Words before a name that make it a definition, words that are no callee, and words after which a value may stand.
DEFINES = {"def", "defp", "defmodule", "func", "function", "fn", "fun", "class", "interface", "struct", "enum", "trait", "macro"}
NO_CALLEE = {"if", "for", "while", "switch", "return", "catch", "function", "func", "fn", "fun", "typeof", "sizeof", "match", "when", "with", "await", "elif", "assert", "and", "or", "not", "in", "is", "lambda", "async", "def", "unless", "until", "case", "foreach"}
BEFORE_VALUES = {"return", "await", "yield", "throw", "case", "else", "in", "new", "not", "and", "or", "do", "then", "go", "defer", "raise", "assert", "elif", "if", "while", "unless", "when", "is", "typeof", "void", "delete", "from", "print", "echo", "default", "try", "mut", "ref", "const", "use"}
JOINS = (".", "?.", "::", "->")
_PAIRS = {")": "(", "]": "[", "}": "{"}
FOUND = "file string, lang string, line int, place int, callee string, form string, receiver string, decorated boolean, block boolean, args array<struct<text:string,content:string>>"
ARGS = pa.list_(pa.struct([("text", pa.string()), ("content", pa.string())]))


def lexer(family: str) -> re.Pattern:
    comments, quotes, prefix = FAMILIES[family]
    return re.compile(f"(?P<skip>{'|'.join(_COMMENTS[c] for c in comments)})|(?P<text>(?:{prefix})(?:{'|'.join(_QUOTED[q] for q in quotes)}))|(?P<word>[^\\W\\d][\\w$]*[?!]?(?=\\()|[^\\W\\d][\\w$]*|\\$[\\w$]*)|(?P<number>\\d[\\w.]*)|(?P<mark>\\?\\.|::|->|=>|\\S)", re.S)


_lexers: dict[str, re.Pattern] = {}
_BREAK = re.compile("\n")


class Source:
    """The tokens of one text, and the calls among them."""

    def __init__(self, text: str, lang: str, line: int = 1):
        family = LANGUAGES[lang]
        if family not in _lexers:
            _lexers[family] = lexer(family)
        self.text, self.lang, self.first = text, lang, line
        self.tokens = [(m.lastgroup, m.start(), m.end()) for m in _lexers[family].finditer(text) if m.lastgroup != "skip"]
        self.breaks = [m.start() for m in _BREAK.finditer(text)]
        self.opened: dict[int, int] = {}
        self.begun: dict[int, int] = {}

    def said(self, k: int) -> str:
        return self.text[self.tokens[k][1] : self.tokens[k][2]] if 0 <= k < len(self.tokens) else ""

    def kind(self, k: int) -> str | None:
        return self.tokens[k][0] if 0 <= k < len(self.tokens) else None

    def line(self, k: int) -> int:
        return self.first + bisect_right(self.breaks, self.tokens[k][1] - 1)

    def begin(self, k: int) -> int:
        """The token at which the value that ends with token k begins: names, calls and indices joined by dots."""
        start = k
        while True:
            if start in self.begun:
                return self.begun[start]
            if self.said(start) in (")", "]") and start in self.opened:
                start = self.opened[start]
                if self.kind(start - 1) == "word" and (self.said(start - 1) not in BEFORE_VALUES or self.said(start - 2) in JOINS) or self.said(start - 1) in (")", "]"):
                    start -= 1
                    continue
            if self.said(start - 1) in JOINS and start >= 2:
                start -= 2
                continue
            return start

    def defines(self, k: int) -> bool:
        """Whether the name at token k is being defined: after a word that says so, a type, or a Go receiver."""
        before = self.said(k - 1)
        if before in DEFINES:
            return True
        if before == ")" and k - 1 in self.opened and self.said(self.opened[k - 1] - 1) == "func":
            return True
        return self.kind(k - 1) == "word" and before not in BEFORE_VALUES and self.line(k - 1) == self.line(k) and self.lang not in MACROS

    def argument(self, a: int, b: int) -> tuple[str, str | None]:
        """(text, content) of tokens a to b; content is what a single quoted text holds."""
        raw = self.text[self.tokens[a][1] : self.tokens[b - 1][2]]
        if b - a > 1 or self.kind(a) != "text":
            return raw[:LONGEST], None
        inner = raw.lstrip("rRbBuUfFs")
        quote = 3 if inner[:3] in ('"""', "'''") else 1
        return raw[:LONGEST], inner[quote:-quote][:LONGEST]

    def row(self, name: int, form: str, args: list[tuple[int, int]], block: bool) -> tuple:
        joined = self.said(name - 1) in JOINS
        start = self.begin(name - 2) if joined and name >= 2 else name
        decorated = self.said(start - 1) == "@"
        if form == "call":
            self.begun[name] = start
        receiver = self.text[self.tokens[start][1] : self.tokens[name - 1][1]].strip()[:LONGEST] if joined and name >= 2 else None
        at = start - 1 if decorated else start
        told = [self.argument(a, b) for a, b in args[:ARGUMENTS] if b > a]
        return self.line(at), at, self.said(name), form, receiver, decorated, block, [{"text": t, "content": c} for t, c in told]

    def calls(self) -> Iterator[tuple]:
        """Rows of FOUND but file and lang, in the order in which calls end."""
        stack: list[list] = []
        for k, (kind, start, end) in enumerate(self.tokens):
            if kind == "word" and self.lang in MACROS and self.kind(k + 1) == "text" and self.line(k) == self.line(k + 1) and (k == 0 or self.line(k - 1) != self.line(k) or self.said(k - 1) in ("do", ";", "{")) and not self.defines(k):
                yield self.row(k, "macro", self.macro(k + 1), False)
            if kind != "mark":
                continue
            c = self.text[start:end]
            if c in ("(", "[", "{"):
                call = c == "(" and self.kind(k - 1) == "word" and self.said(k - 1) not in NO_CALLEE and not self.defines(k - 1) and k > 0
                stack.append([c, k, call, k + 1, []])
            elif c == "," and stack:
                stack[-1][4].append((stack[-1][3], k))
                stack[-1][3] = k + 1
            elif c in _PAIRS:
                while stack and stack[-1][0] != _PAIRS[c]:
                    stack.pop()
                if not stack:
                    continue
                _, at, call, from_, args = stack.pop()
                self.opened[k] = at
                if call:
                    yield self.row(at - 1, "call", [*args, (from_, k)], self.said(k + 1) == "{")

    def macro(self, k: int) -> list[tuple[int, int]]:
        """The arguments from token k to the end of the line, which a comma or an open bracket carries on."""
        args, depth, start = [], 0, k
        while k < len(self.tokens):
            c = self.said(k)
            if depth == 0 and k > start and (self.line(k) != self.line(k - 1) and self.said(k - 1) != "," or c in ("do", "{", ";")):
                break
            depth += (c in ("(", "[", "{")) - (c in (")", "]", "}"))
            if depth < 0:
                break
            if c == "," and depth == 0:
                args.append((start, k))
                start = k + 1
            k += 1
        return [*args, (start, k)] if k > start else args


#: Rows of calls that a batch has about, so that neither a row nor a whole partition makes one.
CALLS_A_BATCH = 8192
_KINDS = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_(), ARGS)
_NAMES = ["file", "lang", "line", "place", "callee", "form", "receiver", "decorated", "block", "args"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), _KINDS, strict=True)], _NAMES)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for batch in batches:
        for file, lang, text, line in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            rows += [(file, lang, *row) for row in Source(text, lang, line).calls()]
            if len(rows) >= CALLS_A_BATCH:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def calls(files: DataFrame) -> DataFrame:
    """The calls in files (file, lang, text, and line, the number of a text's first line, if they have it), as FOUND.

    A row is a call with its arguments in order: form is call, or macro for a bare word with a quoted text behind it where
    the language has such; receiver is what stands before the last dot; decorated follows an @; block precedes a {.
    Languages without a lexer, null texts and empty tables give no rows.
    """
    line = F.col("line").cast("int") if "line" in files.columns else F.lit(1)
    rows = files.where(F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull()).select("file", "lang", "text", line.alias("line"))
    return rows.mapInArrow(_batches, FOUND)


_PATTERN = re.compile(r"^(?P<at>@)?(?:(?P<receiver>\$?\w[\w.]*)\.)?(?P<callee>\$?\w+)(?:\((?P<args>.*)\)(?P<block>\s*\{.*\})?|\s+(?P<macro>\S.*))$", re.S)
_SLOT = re.compile(r"\$\$\$\w*|\$\w+|\"[^\"]*\"|'[^']*'|`[^`]*`|[\w.]+")


@dataclass(frozen=True)
class Pattern:
    """A call as it is written, with holes: $X for one argument or name, "$X" for a quoted text's content, $$$X for any rest.

    Forms are ``callee(...)``, ``receiver.callee(...)``, either with an @ before it or a block behind it, and
    ``callee ...`` without brackets.
    """

    text: str

    def parts(self) -> tuple[re.Match, list[str]]:
        m = _PATTERN.match(self.text.strip())
        if not m:
            raise ValueError(f"no pattern of a call: {self.text}")
        listed = m["macro"] if m["args"] is None else m["args"]
        slots = [x.strip() for x in listed.split(",")] if listed.strip() else []
        if any(not _SLOT.fullmatch(x) for x in slots) or any(x.startswith("$$$") for x in slots[:-1]):
            raise ValueError(f"no pattern of a call: {self.text}")
        return m, slots

    def matched(self) -> Column:
        """Whether a row of ``calls`` is written so."""
        m, slots = self.parts()
        rest = bool(slots) and slots[-1].startswith("$$$")
        n = len(slots) - rest
        found = (F.col("form") == ("call" if m["args"] is not None else "macro")) & ((F.size("args") >= n) if rest else (F.size("args") == n))
        found = found & (F.col("receiver").isNull() if m["receiver"] is None else F.col("receiver").isNotNull() if m["receiver"].startswith("$") else F.col("receiver") == m["receiver"])
        if m["at"]:
            found = found & F.col("decorated")
        if m["block"]:
            found = found & F.col("block")
        if not m["callee"].startswith("$"):
            found = found & (F.col("callee") == m["callee"])
        for k, slot in enumerate(slots[:n]):
            arg = F.get("args", F.lit(k))
            if slot[0] in "\"'`":
                found = found & (arg["content"].isNotNull() if slot[1:2] == "$" else F.coalesce(arg["content"] == slot[1:-1], F.lit(False)))
            elif not slot.startswith("$"):
                found = found & F.coalesce(arg["text"] == slot, F.lit(False))
        return found

    def hole(self, name: str) -> Column:
        """What stands in a hole: an argument, a quoted text's content, the callee or the receiver; null without it."""
        m, slots = self.parts()
        if m["receiver"] == f"${name}":
            return F.col("receiver")
        if m["callee"] == f"${name}":
            return F.col("callee")
        for k, slot in enumerate(slots):
            if slot == f"${name}":
                return F.get("args", F.lit(k))["text"]
            if slot[0] in "\"'`" and slot[1:-1] == f"${name}":
                return F.get("args", F.lit(k))["content"]
        return F.lit(None).cast("string")
