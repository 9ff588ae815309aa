"""TypeScript and JavaScript, with JSX: declarations, and edges that imports and local names can tell."""

from __future__ import annotations

import posixpath
import re

from .source import Rows, Source, Token, scanner

KEPT = ("extends", "implements")
MODIFIERS = set("public private protected readonly static abstract async override declare export default get set accessor".split())
ACCESS = {"public", "private", "protected", "readonly"}
WORDS = set("if for while switch catch function return typeof new await yield delete void in of instanceof case do else throw super import class extends this as satisfies const let var".split())

_scan = scanner(
    r"""(?P<comment>/\*.*?\*/|//[^\n]*)|(?P<str>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`|(?<=[=(,:;!&|?{}\[\n])[ ]*/(?![/*>])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*)
    |(?P<id>[#$]?[^\W\d][\w$]*|\$[\w$]*)|(?P<num>\d[\w.]*)|(?P<op>=>|\.\.\.|\?\.|\?\?=?|&&|\|\||[=!<>]=+|\+\+|--|[{}()\[\];,:=?&|.<>!+*/%@^~-])"""
)


def scan(text, at=0, inside=False):
    """Tokens from a place on; inside a template's braces up to their end. Gives the place after the last token."""
    depth = 0
    while True:
        for t in _scan(text, at):
            at = t.b
            if t.text == "`":
                at = yield from template(text, t.a)
                break
            if inside and t.kind == "op" and t.text in "{}":
                if t.text == "}" and not depth:
                    return t.a
                depth += 1 if t.text == "{" else -1
            yield t
        else:
            return len(text)


def template(text, first):
    """A template literal from its first backtick: pieces of string, with the tokens of its expressions between brackets."""
    start, at = first, first + 1
    while at < len(text) and text[at] != "`":
        if text.startswith("${", at):
            yield Token("str", text[start:at], start, at)
            yield Token("op", "(", at, at + 2)
            at = yield from scan(text, at + 2, True)
            yield Token("op", ")", at, at + 1)
            start = at = at + 1
        else:
            at += 2 if text[at] == "\\" else 1
    yield Token("str", text[start : at + 1], start, min(at + 1, len(text)))
    return at + 1


def module_path(path):
    return re.sub(r"/index$", "", re.sub(r"(\.d\.ts|\.ts|\.tsx|\.js|\.jsx|\.mjs|\.cjs)$", "", path))


class Class:
    def __init__(self, fqn):
        self.fqn, self.properties = fqn, {}


class Parser:
    def __init__(self, path, text, shallow, packages):
        self.s = Source(text, scan)
        self.t = self.s.tokens
        self.rows = Rows(self.s, shallow, KEPT)
        self.folder, self.packages = posixpath.dirname(path), packages
        self.module = module_path(path)
        self.names, self.locals = {}, set()
        spans = self.statements(0, len(self.t))
        for a, b in spans:
            self.look(a, b)
        for a, b in spans:
            self.statement(a, b)

    def qual(self, name):
        return f"{self.module}#{name}"

    # names

    def resolve_module(self, spec):
        if spec.startswith(("./", "../")):
            return module_path(posixpath.normpath(posixpath.join(self.folder, spec)))
        own = [p for p in self.packages if spec == p or spec.startswith(p + "/")]
        if own:
            best = max(own, key=len)
            rest = spec[len(best) :].strip("/")
            return module_path(f"{self.packages[best]}/{rest}") if rest else self.packages[best]
        return spec

    def resolve(self, name):
        if name in self.names:
            module, target = self.names[name]
            return f"{module}#{name if target in ('', 'default') else target}", False
        return (self.qual(name), True) if name in self.locals else ("", False)

    def resolve_member(self, i):
        """Of ns.Name with Name at i, where ns is a namespace import."""
        if self.s.is_(i - 1, ".") and self.s.word(i - 2) and not self.s.is_(i - 3, "."):
            module, target = self.names.get(self.t[i - 2].text, ("", None))
            if target == "":
                return f"{module}#{self.t[i].text}", False
        return "", False

    # statements

    def newline(self, i):
        return i > 0 and "\n" in self.s.text[self.t[i - 1].b : self.t[i].a]

    def statements(self, a, b):
        """Ranges of [a, b) that semicolons, closing braces or new lines end."""
        out, start, i = [], a, a
        while i < b:
            if i > start and self.newline(i) and not self.s.is_(i - 1, ",", "=", "=>", ".", "(", "|", "&", "?", ":", "&&", "||", "+", "extends", "implements", "from", "async", "return") and not self.s.is_(i, ".", "|", "&", "?", ":", "&&", "||", "=", "{", "+", "extends", "implements", "=>", "?."):
                out.append((start, i))
                start = i
            if self.s.is_(i, ";"):
                if start < i:
                    out.append((start, i))
                start = i + 1
            elif self.t[i].kind == "op" and self.t[i].text in "([{":
                i = min(self.s.close(i), b - 1)
            i += 1
        if start < b:
            out.append((start, b))
        return out

    def head(self, a, b):
        """The token that says what a statement declares."""
        while a < b and self.s.is_(a, "export", "default", "declare", "abstract", "async", "@"):
            if self.s.is_(a, "@"):
                a += 2
                while self.s.is_(a, "."):
                    a += 2
                if self.s.is_(a, "("):
                    a = self.s.close(a) + 1
            else:
                a += 1
        return a

    def look(self, a, b):
        """First pass: imports and top-level names."""
        i = self.head(a, b)
        if i >= b:
            return
        word = self.t[i].text
        if word == "import" and self.t[b - 1].kind == "str":
            self.imported(i + 1, b)
        elif word in ("class", "interface", "enum", "type", "function", "namespace") or word == "const" and self.s.is_(i + 1, "enum"):
            at = i + 1 + self.s.is_(i + 1, "enum", "*")
            if self.s.word(at) and not self.unnamed(at):
                self.locals.add(self.t[at].text)
        elif word in ("const", "let", "var"):
            self.locals |= {self.t[x].text for x, _ in self.s.split(i + 1, b, ",") if self.s.word(x)}

    def imported(self, a, b):
        spec = self.t[b - 1].text.strip("'\"`")
        module = self.resolve_module(spec)
        a += self.s.is_(a, "type") and not self.s.is_(a + 1, "from", ",")

        def add(alias, name):
            self.names[alias] = (module, name)
            self.rows.imports.append({"alias": alias, "fqn": f"{module}#{name}" if name else module, "kind": ""})

        for x, y in self.s.split(a, self.s.find(a, b, "from"), ","):
            if self.s.is_(x, "*"):
                add(self.t[y - 1].text, "")
            elif self.s.is_(x, "{"):
                for p, q in self.s.split(x + 1, self.s.close(x), ","):
                    p += self.s.is_(p, "type") and q - p > 1 and not self.s.is_(p + 1, "as")
                    add(self.t[q - 1].text, self.t[p].text)
            elif self.s.word(x):
                add(self.t[x].text, "default")

    def statement(self, a, b):
        i = self.head(a, b)
        if i >= b:
            return
        word, first = self.t[i].text, a
        while self.s.is_(first, "export", "default", "@"):
            first = self.head(a, b) if self.s.is_(first, "@") else first + 1
        if self.s.is_(i - 1, "abstract", "async", "declare"):
            first = i - 1
        if word == "class":
            self.class_(first, i, b, a)
        elif word == "interface":
            self.interface(first, i, b, a)
        elif word == "enum" or word == "const" and self.s.is_(i + 1, "enum"):
            self.enum(first, i + (word == "const"), b, a)
        elif word == "type" and self.s.word(i + 1):
            fqn = self.qual(self.t[i + 1].text)
            self.rows.symbol("type_alias", self.t[i + 1].text, fqn, first, b - 1, signature=self.signature(first, b), doc=self.s.doc(a))
            self.type_edges(self.s.find(i, b, "=") + 1, b, fqn)
        elif word == "function":
            self.function(first, i, b, a)
        elif word in ("const", "let", "var"):
            self.variables(i, b, a)
        elif word != "import":
            if self.s.is_(i, "export"):
                return
            self.body(i, b, "", None, {})

    def signature(self, i, j):
        raw = " ".join(self.s.raw(i, j).split())
        raw = raw.removesuffix("=>").strip().removesuffix("=").strip()
        return raw if len(raw) <= 200 else raw[:200] + "…"

    def heritage(self, a, b, owner, first):
        kind, i = "extends", a
        while i < b:
            if self.s.is_(i, "extends", "implements"):
                kind = self.t[i].text
            elif self.s.is_(i, "<", "("):
                i = self.angle(i) if self.s.is_(i, "<") else self.s.close(i)
            elif self.s.word(i):
                if self.s.is_(i + 1, "."):
                    i += 2
                    to, exact = self.resolve_member(i)
                else:
                    to, exact = self.resolve(self.t[i].text)
                if to:
                    self.rows.edge(owner, kind, to, exact, first)
            i += 1

    def angle(self, i):
        """The > that closes a < of type arguments."""
        depth = 0
        for k in range(i, min(len(self.t), i + 400)):
            depth += self.s.is_(k, "<") - self.s.is_(k, ">")
            if not depth:
                return k
        return i

    def unnamed(self, i):
        """Whether a default export that has no name goes on at i."""
        return self.s.is_(i, "extends", "implements", "{", "(", "<")

    def class_(self, first, i, b, a):
        name, at = ("default", i + 1) if self.unnamed(i + 1) else (self.t[i + 1].text, i + 2)
        at = self.angle(at) + 1 if self.s.is_(at, "<") else at
        body = self.s.find(at, b, "{")
        cls = Class(self.qual(name))
        self.rows.symbol("class", name, cls.fqn, first, self.s.close(body), signature=self.signature(first, body), doc=self.s.doc(a))
        self.heritage(at, body, cls.fqn, first)
        parts = [p for p in (self.member_at(*m) for m in self.members(body + 1, self.s.close(body))) if p]
        for m in parts:
            self.member_types(cls, *m)
        for m in parts:
            self.member(cls, *m)

    def members(self, a, b):
        """Member ranges of a class or interface body; a method's body ends it."""
        out = []
        for x, y in self.statements(a, b):
            start = x
            for k in range(x, y):
                if self.s.is_(k, "}") and self.s.match.get(k, 0) >= start and k + 1 < y and self.s.is_(self.s.match[k] - 1, ")") or self.s.is_(k, ","):
                    depth_ok = not any(p < k < self.s.close(p) for p in range(start, k) if self.t[p].kind == "op" and self.t[p].text in "([{")
                    if depth_ok:
                        out.append((start, k + (not self.s.is_(k, ","))))
                        start = k + 1
            if start < y:
                out.append((start, y))
        return out

    def member_at(self, a, b):
        """(first, name token, end) of a member, past decorators and modifiers."""
        i = self.head(a, b) if self.s.is_(a, "@") else a
        first = i
        while i + 1 < b and self.s.word(i) and self.t[i].text in MODIFIERS and not self.s.is_(i + 1, "(", ":", "=", "?", ";", "!"):
            i += 1
        i += self.s.is_(i, "*")
        return (first, i, b) if i < b and (self.s.word(i) or self.t[i].kind == "str") else None

    def after_name(self, i, b):
        i += 1
        i += self.s.is_(i, "?", "!")
        return self.angle(i) + 1 if i < b and self.s.is_(i, "<") else i

    def parameters(self, i):
        """(first, name, type begin, end) of a parameter list."""
        for a, b in self.s.split(i + 1, self.s.close(i), ","):
            first, a = a, self.head(a, b) if self.s.is_(a, "@") else a
            while self.s.word(a) and self.t[a].text in MODIFIERS and self.s.word(a + 1):
                a += 1
            a += self.s.is_(a, "...")
            colon = self.s.find(a, b, ":")
            yield first, a, min(colon + 1, b), self.s.find(colon, b, "="), b

    def single(self, a, b):
        """The symbol of a type that is one name, with type arguments or not."""
        plain = a < b and self.s.word(a) and (b - a == 1 or self.s.is_(a + 1, "<") and self.angle(a + 1) == b - 1)
        return self.resolve(self.t[a].text)[0] if plain else ""

    def type_edges(self, a, b, owner):
        for k in range(a, b):
            if self.s.word(k) and not self.s.is_(k - 1, ".") and not self.s.is_(k + 1, ".", ":") and not (self.s.is_(k + 1, "?") and self.s.is_(k + 2, ":")):
                to, exact = self.resolve(self.t[k].text)
                if to:
                    self.rows.edge(owner, "references_type", to, exact, k)

    def signature_types(self, params, body, owner):
        """Type edges of parameters and result; {parameter: type}."""
        out = {}
        for _, name, a, b, _ in self.parameters(params):
            self.type_edges(a, b, owner)
            to = self.single(a, b)
            if to and self.s.word(name):
                out[self.t[name].text] = to
        end = self.s.close(params)
        if self.s.is_(end + 1, ":"):
            self.type_edges(end + 2, body, owner)
        return out

    def arrow(self, i, b):
        """(parameters or None, body begin) if a function value starts at i."""
        i += self.s.is_(i, "async")
        if self.s.is_(i, "function"):
            params = self.s.find(i, b, "(")
            return params, self.s.find(self.s.close(params) + 1, b, "{")
        if self.s.is_(i, "<"):
            i = self.angle(i) + 1
        if self.s.is_(i, "("):
            end = self.s.close(i)
            to = end + 1
            if self.s.is_(to, ":"):
                to = self.s.find(to, b, "=>")
            return (i, to + 1) if self.s.is_(to, "=>") else None
        if self.s.word(i) and self.s.is_(i + 1, "=>"):
            return None if i + 1 >= b else (-1, i + 2)
        return None

    def member_types(self, cls, first, i, b):
        at = self.after_name(i, b)
        if self.s.is_(at, "("):
            if self.t[i].text == "constructor":
                for x, name, a, e, _ in self.parameters(at):
                    if any(self.t[k].text in ACCESS for k in range(x, name)):
                        cls.properties[self.t[name].text] = self.single(a, e)
        elif self.s.is_(at, ":"):
            cls.properties[self.t[i].text] = self.single(at + 1, self.s.find(at, b, "="))

    def member(self, cls, first, i, b):
        name, at = self.t[i].text.strip("'\""), self.after_name(i, b)
        doc = self.s.doc(first)
        if self.s.is_(at, "("):
            body = self.s.find(self.s.close(at) + 1, b, "{")
            if body < b and self.s.close(body) + 1 < b and self.s.is_(self.s.close(at) + 1, ":"):
                body = self.s.find(self.s.close(body) + 1, b, "{")
            fqn = f"{cls.fqn}.{name}()"
            self.rows.symbol("method", name, fqn, first, b - 1, cls.fqn, self.signature(first, body), doc)
            types = self.signature_types(at, body, fqn)
            if name == "constructor":
                for x, own, _, _, y in self.parameters(at):
                    if any(self.t[k].text in ACCESS for k in range(x, own)) and self.s.word(own):
                        self.rows.symbol("property", self.t[own].text, f"{cls.fqn}.{self.t[own].text}", x, y - 1, cls.fqn, self.signature(x, y))
            if body < b:
                self.body(body + 1, b, fqn, cls, types)
            return
        equals = self.s.find(at, b, "=")
        value = self.arrow(equals + 1, b) if equals < b else None
        if value:
            fqn = f"{cls.fqn}.{name}()"
            self.rows.symbol("method", name, fqn, first, b - 1, cls.fqn, self.signature(first, value[1]), doc)
            types = self.signature_types(value[0], value[1] - 1, fqn) if value[0] >= 0 else {}
            self.body(value[1], b, fqn, cls, types)
            return
        if self.s.is_(at, ":"):
            self.type_edges(at + 1, equals, cls.fqn)
        self.rows.symbol("property", name, f"{cls.fqn}.{name}", first, b - 1, cls.fqn, self.signature(first, b), doc)
        if equals < b:
            self.body(equals + 1, b, cls.fqn, cls, {})

    def interface(self, first, i, b, a):
        name, at = self.t[i + 1].text, i + 2
        at = self.angle(at) + 1 if self.s.is_(at, "<") else at
        body = self.s.find(at, b, "{")
        cls = Class(self.qual(name))
        self.rows.symbol("interface", name, cls.fqn, first, self.s.close(body), signature=self.signature(first, body), doc=self.s.doc(a))
        self.heritage(at, body, cls.fqn, first)
        for m in self.members(body + 1, self.s.close(body)):
            part = self.member_at(*m)
            if part:
                self.member(cls, *part)

    def enum(self, first, i, b, a):
        name = self.t[i + 1].text
        fqn, body = self.qual(name), self.s.find(i, b, "{")
        self.rows.symbol("enum", name, fqn, first, self.s.close(body), signature=self.signature(first, body), doc=self.s.doc(a))
        for x, y in self.s.split(body + 1, self.s.close(body), ","):
            own = self.t[x].text.strip("'\"")
            self.rows.symbol("enum_case", own, f"{fqn}.{own}", x, y - 1, fqn, self.signature(x, y), self.s.doc(x))

    def function(self, first, i, b, a):
        at = i + 1 + self.s.is_(i + 1, "*")
        name = "default" if self.unnamed(at) else self.t[at].text
        fqn = self.qual(name) + "()"
        params = self.s.find(at, b, "(")
        body = self.s.find(self.s.close(params) + 1, b, "{")
        self.rows.symbol("function", name, fqn, first, b - 1, signature=self.signature(first, body), doc=self.s.doc(a))
        self.body(body + 1, b, fqn, None, self.signature_types(params, body, fqn))

    def variables(self, i, b, a):
        constant = self.s.is_(i, "const")
        for x, y in self.s.split(i + 1, b, ","):
            if not self.s.word(x):
                continue
            name = self.t[x].text
            equals = self.s.find(x, y, "=")
            value = self.arrow(equals + 1, y) if equals < y else None
            doc = self.s.doc(a)
            if value:
                fqn = self.qual(name) + "()"
                self.rows.symbol("function", name, fqn, x, y - 1, signature=self.signature(x, value[1]), doc=doc)
                types = self.signature_types(value[0], value[1] - 1, fqn) if value[0] >= 0 else {}
                self.body(value[1], y, fqn, None, types)
                continue
            fqn = self.qual(name)
            if self.s.is_(x + 1, ":"):
                self.type_edges(x + 2, equals, fqn)
            self.rows.symbol("constant" if constant else "property", name, fqn, x, y - 1, signature=self.signature(x, y), doc=doc)
            if equals < y:
                self.body(equals + 1, y, fqn, None, {})

    # what bodies use

    def body(self, a, b, owner, cls, types):
        edge, i = self.rows.edge, a
        types = dict(types)
        while i < b:
            t = self.t[i]
            if self.s.is_(i, "(") and (fn := self.arrow(i, b)) and not self.s.word(i - 1):
                types |= self.signature_types(fn[0], fn[1] - 1, owner)
            elif t.kind == "id":
                if t.text == "new" and self.s.word(i + 1):
                    k = i + 1
                    to, exact = self.resolve(self.t[k].text)
                    if self.s.is_(k + 1, "."):
                        to, exact = self.resolve_member(k + 2)
                    if to:
                        edge(owner, "instantiates", to, exact, i)
                    i = k + 2 * self.s.is_(k + 1, ".")
                elif t.text in ("as", "satisfies") and self.s.word(i + 1):
                    self.type_edges(i + 1, i + 2, owner)
                elif t.text in ("const", "let", "var") and self.s.word(i + 1) and self.s.is_(i + 2, ":"):
                    self.type_edges(i + 3, self.s.find(i + 3, b, "=", ";"), owner)
                elif self.s.is_(i - 1, "<") and (t.text[0].isupper() or self.s.is_(i + 1, ".")) and not self.s.word(i - 2) and not self.s.is_(i - 2, ")", "]"):
                    to, _ = self.resolve(t.text)
                    if self.s.is_(i + 1, "."):
                        to, _ = self.resolve_member(i + 2)
                    if to:
                        edge(owner, "calls", to + "()", False, i)
                else:
                    k = i + 1
                    if self.s.is_(k, "<") and self.s.is_(self.angle(k) + 1, "(") and self.angle(k) > k:
                        k = self.angle(k) + 1
                    if self.s.is_(k, "(") and t.text not in WORDS and not self.s.is_(i - 1, "function"):
                        self.call(i, owner, cls, types)
            i += 1

    def call(self, i, owner, cls, types):
        name, edge = self.t[i].text, self.rows.edge
        if not self.s.is_(i - 1, ".", "?."):
            to, exact = self.resolve(name)
            if to:
                edge(owner, "calls", to + "()", exact, i)
            return
        left = i - 2
        if self.s.is_(left, "this"):
            if cls:
                edge(owner, "calls", f"{cls.fqn}.{name}()", False, i)
        elif self.s.word(left) and not self.s.is_(left - 1, ".", "?."):
            to, _ = self.resolve_member(i)
            own = self.t[left].text
            if to:
                edge(owner, "calls", to + "()", False, i)
            elif own in types:
                edge(owner, "calls", f"{types[own]}.{name}()", False, i)
        elif self.s.word(left) and self.s.is_(left - 2, "this") and cls:
            to = cls.properties.get(self.t[left].text)
            if to:
                edge(owner, "calls", f"{to}.{name}()", False, i)


def extract(path, text, shallow=False, modules=None):
    p = Parser(path, text, shallow, modules or {})
    return p.rows, p.s.has_errors
