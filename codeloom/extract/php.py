"""PHP: declarations, and edges by the language's name resolution."""

from __future__ import annotations

from .source import Rows, Source, Token, scanner

#: Type words that are no classes; fixed values.
TYPES = set("int float string bool array callable iterable object mixed void null never false true static self parent resource integer boolean double numeric".split()) - {"self", "static", "parent"}
KEPT = ("extends", "implements", "uses_trait")
CLASSES = {"class": "class", "interface": "interface", "trait": "trait", "enum": "enum"}
MODIFIERS = set("abstract final readonly public protected private static var const".split())
WORDS = set("if else elseif while for foreach switch match return echo print new instanceof function fn use namespace class interface trait enum catch try throw isset unset empty list array exit die include include_once require require_once and or xor as do case default break continue global static yield clone const declare goto".split())

_scan = scanner(
    r"""(?P<comment>/\*.*?\*/|//[^\n]*|\#(?!\[)[^\n]*)|(?P<str><<<\s*(?P<q>['"]?)(?P<tag>\w+)(?P=q)\n.*?\n\s*(?P=tag)\b|'(?:\\.|[^'\\])*'|"(?:\\.|\{\$[^{}]*\}|[^"\\])*"|`[^`]*`|\?>.*?(?:<\?(?:php|=)|\Z)|\A.*?<\?(?:php|=))
    |(?P<var>\$[^\W\d]\w*)|(?P<id>\\?[^\W\d]\w*(?:\\[^\W\d]\w*)*)|(?P<num>\d[\w.]*)|(?P<op>\?->|->|::|=>|\#\[|\.\.\.|\?\?=?|&&|\|\||[=!<>]=+|[{}()\[\];,:=?&|.<>!+*/%@^~-])"""
)


def scan(text):
    for t in _scan(text):
        quoted = t.text.startswith('"') or t.text.startswith("<<<") and "'" not in t.text.split("\n", 1)[0]
        if t.kind == "str" and quoted and "{$" in t.text:
            yield from interpolated(t)
        else:
            yield t


def interpolated(t):
    """A string with expressions in braces: pieces of string, with the tokens of each expression between brackets."""
    start = at = 0
    while (at := t.text.find("{$", at)) >= 0:
        if t.text[at - 1] == "\\":
            at += 1
            continue
        depth, end, inner = 0, None, []
        for u in _scan(t.text[at + 1 :]):
            if u.text == "}" and not depth:
                end = at + 1 + u.a
                break
            depth += (u.text == "{") - (u.text == "}")
            inner.append(u._replace(a=t.a + at + 1 + u.a, b=t.a + at + 1 + u.b))
        if end is None:
            break
        yield t._replace(text=t.text[start:at], b=t.a + at, a=t.a + start)
        yield Token("op", "(", t.a + at, t.a + at + 1)
        yield from inner
        yield Token("op", ")", t.a + end, t.a + end + 1)
        start = at = end + 1
    yield t._replace(text=t.text[start:], a=t.a + start)


def _join(ns, name):
    return f"{ns}\\{name}" if ns else name


class Class:
    def __init__(self, fqn):
        self.fqn, self.parent, self.properties = fqn, "", {}


class Parser:
    def __init__(self, path, text, shallow):
        tokens = []
        for t in scan(text):
            kind = t.kind if t.kind not in ("q", "tag") else "str"
            tokens.append(t._replace(kind=kind, text="[" if t.text == "#[" else t.text))
        self.attributes = {t.a for t, raw in zip(tokens, scan(text), strict=True) if raw.text == "#["}
        self.s = Source(text, lambda _: tokens)
        self.t = self.s.tokens
        self.rows = Rows(self.s, shallow, KEPT)
        self.scope("")
        self.block(0, len(self.t))

    def scope(self, ns):
        self.ns, self.uses, self.functions = ns, {}, {}

    def name(self, i):
        return self.t[i].text if self.s.word(i) else ""

    def resolve(self, name, cls):
        """(fqn, exact) of a class name."""
        if name.startswith("\\"):
            return name[1:], True
        low = name.lower()
        if low in ("self", "static"):
            return (cls.fqn, True) if cls else ("", False)
        if low == "parent":
            return (cls.parent, False) if cls else ("", False)
        if not name or low in TYPES:
            return "", False
        first, cut, rest = name.partition("\\")
        if first.lower() in self.uses:
            return self.uses[first.lower()] + cut + rest, True
        return _join(self.ns, name), True

    def resolve_function(self, name):
        if name.startswith("\\"):
            return name[1:], True
        first, cut, rest = name.partition("\\")
        if not cut:
            if first.lower() in self.functions:
                return self.functions[first.lower()], True
            return name, not self.ns
        if first.lower() in self.uses:
            return self.uses[first.lower()] + cut + rest, True
        return _join(self.ns, name), True

    # declarations

    def start(self, i):
        """The first token of a declaration whose word is at i: its modifiers."""
        while i and self.s.word(i - 1) and self.t[i - 1].text.lower() in MODIFIERS:
            i -= 1
        return i

    def doc(self, i):
        """The doc comment above a declaration or above its attributes."""
        while self.s.is_(i - 1, "]") and self.t[self.s.close(i - 1)].a in self.attributes:
            i = self.s.close(i - 1)
        return self.s.doc(i, block_only=True)

    def block(self, a, b):
        """Statements of a file or a namespace."""
        i = a
        while i < b:
            word = self.t[i].text.lower() if self.s.word(i) else ""
            if word == "namespace" and not self.s.is_(i + 1, "\\"):
                ns = self.name(i + 1)
                self.scope(ns)
                brace = i + 1 + bool(ns)
                if self.s.is_(brace, "{"):
                    end = self.s.close(brace)
                    self.block(brace + 1, end)
                    self.scope("")
                    i = end
            elif word == "use":
                end = self.s.find(i, b, ";")
                self.used(i + 1, end)
                i = end
            elif word in CLASSES and self.s.word(i + 1) and not self.s.is_(i - 1, "::", "->", "new"):
                i = self.class_like(i)
            elif word == "function" and (self.s.word(i + 1) or self.s.is_(i + 1, "&")):
                i = self.function(i, None)
            elif word == "const":
                end = self.s.find(i, b, ";")
                self.constants(i, end, None)
                i = end
            elif self.s.is_(i, "{"):
                pass  # a plain block: its statements are looked at as these
            i += 1

    def used(self, a, b):
        kind = ""
        if self.name(a).lower() in ("function", "const"):
            kind, a = self.t[a].text.lower(), a + 1
        for x, y in self.s.split(a, b, ","):
            brace = self.s.find(x, y, "{")
            if brace < y or self.s.is_(y - 1, "}"):
                brace = next((k for k in range(x, y) if self.s.is_(k, "{")), y)
                prefix = self.s.raw(x, brace).rstrip("\\ ")
                for p, q in self.s.split(brace + 1, self.s.close(brace), ","):
                    own = kind
                    if self.name(p).lower() in ("function", "const"):
                        own, p = self.t[p].text.lower(), p + 1
                    self.use(prefix + "\\" + self.t[p].text, self.t[q - 1].text if q - p > 1 else "", own)
            else:
                self.use(self.t[x].text, self.t[y - 1].text if y - x > 1 else "", kind)

    def use(self, fqn, alias, kind):
        fqn = fqn.lstrip("\\")
        alias = alias or fqn.rsplit("\\", 1)[-1]
        self.rows.imports.append({"alias": alias, "fqn": fqn, "kind": kind})
        if kind != "const":
            (self.functions if kind else self.uses)[alias.lower()] = fqn

    def class_like(self, i):
        kind, name = CLASSES[self.t[i].text.lower()], self.t[i + 1].text
        body = self.s.find(i + 2, len(self.t), "{", ";")
        end, first = self.s.close(body), self.start(i)
        cls = Class(_join(self.ns, name))
        self.rows.symbol(kind, name, cls.fqn, first, end, signature=self.s.signature(first, body), doc=self.doc(first))
        mode = ""
        for k in range(i + 2, body):
            low = self.t[k].text.lower()
            if low in ("extends", "implements"):
                mode = low
            elif mode and self.s.word(k):
                fqn, exact = self.resolve(self.t[k].text, None)
                if fqn:
                    if mode == "extends" and kind == "class" and not cls.parent:
                        cls.parent = fqn
                    self.rows.edge(cls.fqn, mode, fqn, exact, first)
        members = self.members(body + 1, end)
        for m in members:
            self.member_types(cls, *m)
        for m in members:
            self.member(cls, *m)
        return end

    def members(self, a, b):
        """(first, word, end) of the members of a class body; word is the token that tells what it is."""
        out, i = [], a
        while i < b:
            if self.t[i].a in self.attributes:
                i = self.s.close(i) + 1
                continue
            first = i
            while self.s.word(i) and self.t[i].text.lower() in MODIFIERS - {"const"}:
                i += 1
            word = self.t[i].text.lower() if self.s.word(i) else ""
            end = self.s.find(i, b, ";", "{") if word in ("function", "use", "case", "const") else self.s.find(i, b, ";")
            if self.s.is_(end, "{"):
                end = self.s.close(end)
            out.append((first, i, min(end, b - 1)))
            i = end + 1
        return out

    def single(self, a, b, cls):
        """The class of a type that is one name, nullable or not."""
        a += self.s.is_(a, "?")
        return self.resolve(self.t[a].text, cls)[0] if b - a == 1 and self.s.word(a) else ""

    def type_edges(self, a, b, owner, cls):
        for k in range(a, b):
            if self.s.word(k):
                fqn, exact = self.resolve(self.t[k].text, cls)
                if fqn:
                    self.rows.edge(owner, "references_type", fqn, exact, k)

    def parameters(self, i):
        """(first, type begin, type end, variable, promoted) of a parameter list."""
        for a, b in self.s.split(i + 1, self.s.close(i), ","):
            first = a
            while self.t[a].a in self.attributes:
                a = self.s.close(a) + 1
            start, promoted = a, False
            while self.s.word(a) and self.t[a].text.lower() in MODIFIERS:
                promoted, a = True, a + 1
            var = next((k for k in range(a, b) if self.t[k].kind == "var"), None)
            if var is not None:
                yield start if promoted else first, a, self.s.find(a, var, "&", "..."), var, promoted, b

    def member_types(self, cls, first, word, end):
        if self.t[word].text.lower() == "function":
            for _, a, b, var, promoted, _ in self.parameters(self.s.find(word, end + 1, "(")):
                if promoted:
                    cls.properties[self.t[var].text[1:]] = self.single(a, b, cls)
        else:
            var = next((k for k in range(word, end) if self.t[k].kind == "var"), None)
            if var is not None and var > word:
                fqn = self.single(word, var, cls)
                for x, _ in self.s.split(var, end, ","):
                    cls.properties[self.t[x].text[1:]] = fqn

    def member(self, cls, first, word, end):
        kind = self.t[word].text.lower() if self.s.word(word) else ""
        if kind == "function":
            self.function(word, cls)
        elif kind == "use":
            for k in range(word + 1, end):
                if self.s.is_(k, "{"):
                    break
                if self.s.word(k):
                    fqn, exact = self.resolve(self.t[k].text, cls)
                    self.rows.edge(cls.fqn, "uses_trait", fqn, exact, k)
        elif kind == "case":
            name = self.name(word + 1)
            self.rows.symbol("enum_case", name, f"{cls.fqn}::{name}", word, end, cls.fqn, self.s.signature(word, end), self.doc(first))
        elif kind == "const":
            self.constants(word, end, cls, first)
        else:
            var = next((k for k in range(word, end) if self.t[k].kind == "var"), None)
            if var is None:
                return
            self.type_edges(word, var, cls.fqn, cls)
            for x, _ in self.s.split(var, end, ","):
                name = self.t[x].text[1:]
                self.rows.symbol("property", name, f"{cls.fqn}::${name}", first, end, cls.fqn, self.s.signature(first, end), self.doc(first))
                self.body(x, self.s.split(x, end, ",")[0][1], cls.fqn, cls, {})

    def constants(self, word, end, cls, first=None):
        first = word if first is None else first
        for a, b in self.s.split(word + 1, end, ","):
            equals = self.s.find(a, b, "=")
            name = self.t[equals - 1].text
            fqn = f"{cls.fqn}::{name}" if cls else _join(self.ns, name)
            self.rows.symbol("constant", name, fqn, first, end, cls.fqn if cls else "", self.s.signature(first, end), self.doc(first))

    def function(self, i, cls):
        at = i + 1 + self.s.is_(i + 1, "&")
        name, first = self.t[at].text, self.start(i)
        params = self.s.find(at, len(self.t), "(")
        body = self.s.find(self.s.close(params) + 1, len(self.t), "{", ";")
        end = self.s.close(body) if self.s.is_(body, "{") else body
        fqn = f"{cls.fqn}::{name}()" if cls else _join(self.ns, name) + "()"
        self.rows.symbol("method" if cls else "function", name, fqn, first, end, cls.fqn if cls else "", self.s.signature(first, body), self.doc(first))
        types = {}
        for x, a, b, var, promoted, y in self.parameters(params):
            self.type_edges(a, b, fqn, cls)
            types[self.t[var].text] = self.single(a, b, cls)
            if promoted and cls:
                own = self.t[var].text[1:]
                self.rows.symbol("property", own, f"{cls.fqn}::${own}", x, y - 1, cls.fqn, self.s.signature(x, y), "")
        self.type_edges(self.s.close(params) + 1, body, fqn, cls)
        self.body(params, end, fqn, cls, types)
        return end

    # what bodies use

    def body(self, a, b, owner, cls, types):
        edge = self.rows.edge
        for i in range(a, b):
            t = self.t[i]
            low = t.text.lower() if t.kind == "id" else ""
            if t.a in self.attributes and self.s.word(i + 1):
                for x, _ in self.s.split(i + 1, self.s.close(i), ","):
                    self.named(x, owner, "references_type", cls)
            elif low == "new" and self.s.word(i + 1) and self.name(i + 1).lower() != "class":
                self.named(i + 1, owner, "instantiates", cls, i)
            elif low == "instanceof" and self.s.word(i + 1):
                self.named(i + 1, owner, "references_type", cls, i)
            elif low == "catch" and self.s.is_(i + 1, "("):
                self.type_edges(i + 2, self.s.close(i + 1), owner, cls)
            elif t.text == "::" and self.s.word(i - 1):
                fqn, exact = self.resolve(self.t[i - 1].text, cls)
                if not fqn:
                    continue
                if self.t[i + 1].kind == "var":
                    if not self.s.is_(i + 2, "("):
                        edge(owner, "references", f"{fqn}::{self.t[i + 1].text}", exact, i - 1)
                elif self.s.word(i + 1):
                    name = self.t[i + 1].text
                    if self.s.is_(i + 2, "("):
                        edge(owner, "calls", f"{fqn}::{name}()", exact, i - 1)
                    elif name.lower() == "class":
                        edge(owner, "references_type", fqn, exact, i - 1)
                    else:
                        edge(owner, "references", f"{fqn}::{name}", exact, i - 1)
            elif t.text == "->" and self.s.word(i + 1) and self.s.is_(i + 2, "("):
                fqn = self.receiver(i - 1, cls, types)
                if fqn:
                    edge(owner, "calls", f"{fqn}::{self.t[i + 1].text}()", False, i)
            elif t.kind == "id" and self.s.is_(i + 1, "(") and low not in WORDS and not self.s.is_(i - 1, "->", "?->", "::", "function", "new", "&") and not (self.s.is_(i - 1, "[", ",") and self.in_attribute(i)):
                fqn, exact = self.resolve_function(t.text)
                edge(owner, "calls", fqn + "()", exact, i)

    def in_attribute(self, i):
        return any(self.t[k].a in self.attributes and self.s.close(k) > i for k in range(max(0, i - 40), i) if self.s.is_(k, "["))

    def named(self, i, owner, kind, cls, at=None):
        fqn, exact = self.resolve(self.t[i].text, cls)
        if fqn:
            self.rows.edge(owner, kind, fqn, exact, i if at is None else at)

    def receiver(self, i, cls, types):
        """The class of what a member call at -> is made on, if this file tells."""
        if self.t[i].kind == "var" and not self.s.is_(i - 1, "->", "::"):
            return (cls.fqn if cls else "") if self.t[i].text == "$this" else types.get(self.t[i].text, "")
        if self.s.word(i) and self.s.is_(i - 1, "->") and self.s.is_(i - 2, "$this") and cls:
            return cls.properties.get(self.t[i].text, "")
        return ""


def extract(path, text, shallow=False, modules=None):
    p = Parser(path, text, shallow)
    return p.rows, p.s.has_errors
