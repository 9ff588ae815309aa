"""What the parsers share: tokens with matched brackets, comments, and the rows of a file."""

from __future__ import annotations

import bisect
import re
from typing import NamedTuple

MAX_SIGNATURE = 200
OPEN = {"(": ")", "[": "]", "{": "}"}
CLOSE = {v: k for k, v in OPEN.items()}


class Token(NamedTuple):
    kind: str
    text: str
    a: int
    b: int


class Source:
    """Tokens of a text without comments; match gives each bracket's partner. Unbalanced brackets set has_errors."""

    def __init__(self, text, scan):
        self.text = text
        self.lines = [0, *(m.end() for m in re.finditer("\n", text))]
        self.tokens, self.comments, self.has_errors = [], [], False
        for t in scan(text):
            (self.comments if t.kind == "comment" else self.tokens).append(t)
        self.match, stack = {}, []
        for i, t in enumerate(self.tokens):
            if t.kind != "op":
                continue
            if t.text in OPEN:
                stack.append(i)
            elif t.text in CLOSE:
                while stack and self.tokens[stack[-1]].text != CLOSE[t.text]:
                    stack.pop()
                    self.has_errors = True
                if stack:
                    self.match[stack[-1]] = i
                    self.match[i] = stack.pop()
                else:
                    self.has_errors = True
        self.has_errors |= bool(stack)
        self.by_end = {self.line(c.b - 1): c for c in self.comments if not text[self.lines[self.line(c.a) - 1] : c.a].strip()}

    def line(self, at):
        return bisect.bisect_right(self.lines, at)

    def place(self, at):
        line = self.line(at)
        return line, at - self.lines[line - 1] + 1

    def is_(self, i, *texts):
        return 0 <= i < len(self.tokens) and self.tokens[i].text in texts and self.tokens[i].kind != "str"

    def word(self, i):
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "id"

    def close(self, i):
        """The partner of the bracket at i, or the last token."""
        return self.match.get(i, len(self.tokens) - 1)

    def split(self, a, b, *seps):
        """Token ranges of [a, b) between separators outside brackets; empty ones are left out."""
        out, start, i = [], a, a
        while i < b:
            t = self.tokens[i]
            if t.kind == "op" and t.text in OPEN:
                i = min(self.close(i), b - 1)
            elif t.text in seps and t.kind != "str":
                if start < i:
                    out.append((start, i))
                start = i + 1
            i += 1
        if start < b:
            out.append((start, b))
        return out

    def find(self, a, b, *texts):
        """The first of texts in [a, b) outside brackets, or b."""
        i = a
        while i < b:
            if self.is_(i, *texts):
                return i
            if self.tokens[i].kind == "op" and self.tokens[i].text in OPEN:
                i = self.close(i)
            i += 1
        return b

    def raw(self, i, j):
        """Text from token i up to token j (not included)."""
        if i >= j or i >= len(self.tokens):
            return ""
        return self.text[self.tokens[i].a : self.tokens[j - 1].b]

    def signature(self, i, j):
        sig = " ".join(self.raw(i, j).split())
        return sig if len(sig) <= MAX_SIGNATURE else sig[:MAX_SIGNATURE] + "…"

    def doc(self, i, block_only=False):
        """Comments in the lines right above token i."""
        line, out = self.line(self.tokens[i].a), []
        while (c := self.by_end.get(line - 1)) is not None:
            out.insert(0, c.text)
            line = self.line(c.a)
            if block_only:
                break
        if block_only:
            return out[0] if out and out[0].startswith("/**") else ""
        return "\n".join(out)


class Rows:
    """Symbols, imports and edges of one file; equal edges count once, by their first line."""

    def __init__(self, source, shallow, kept):
        self.s, self.shallow, self.kept = source, shallow, kept
        self.symbols, self.imports, self.edges, self.seen = [], [], [], set()

    def symbol(self, kind, name, fqn, i, j, container="", signature="", doc=""):
        s = self.s
        j = min(max(j, i), len(s.tokens) - 1)
        (l1, c1), (l2, c2) = s.place(s.tokens[i].a), s.place(s.tokens[j].b)
        self.symbols.append({"kind": kind, "name": name, "fqn": fqn, "container": container, "start_line": l1, "start_col": c1, "end_line": l2, "end_col": c2, "signature": signature, "doc": doc})

    def edge(self, source, kind, target, resolved, i, always=False):
        if self.shallow and kind not in self.kept:
            return
        key = (source, kind, target, resolved)
        if not always and (not target or target == source or key in self.seen):
            return
        self.seen.add(key)
        self.edges.append({"from_fqn": source, "kind": kind, "to_fqn": target, "resolved": resolved, "line": self.s.line(self.s.tokens[i].a)})


def scanner(pattern):
    """A tokenizer from a regular expression with named groups; what none matches is skipped."""
    compiled = re.compile(pattern, re.S | re.X)

    def scan(text, at=0):
        for m in compiled.finditer(text, at):
            if m.lastgroup:
                yield Token(m.lastgroup, m[0], m.start(), m.end())

    return scan
