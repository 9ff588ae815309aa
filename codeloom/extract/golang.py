"""Go: declarations, and edges that a file alone can tell."""

from __future__ import annotations

from .source import Rows, Source, scanner

#: Names the language declares; fixed values.
TYPES = set("bool string int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr byte rune float32 float64 complex64 complex128 error any comparable".split())
FUNCTIONS = set("append cap clear close complex copy delete imag len make max min new panic print println real recover".split()) | TYPES
KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
KEPT = ("extends",)

scan = scanner(r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<str>`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<id>[^\W\d]\w*)|(?P<num>\d[\w.]*)|(?P<op>\.\.\.|:=|<-|&&|\|\||[-+*/%&|^<>=!:]=|[{}()\[\].,;:=*&+\-/<>!%|^~])|(?P<nl>\n)""")


def package_path(folder, modules):
    """The import path of a folder by the longest module root around it."""
    best = None
    for root in modules:
        r = root.strip("./")
        if (not r or folder == r or folder.startswith(r + "/")) and (best is None or len(r) > len(best.strip("./"))):
            best = root
    if best is None:
        return folder
    rest = folder[len(best.strip("./")) :].strip("/")
    return modules[best] + ("/" + rest if rest else "")


class Parser:
    def __init__(self, path, text, shallow, modules):
        self.s = Source(text, scan)
        # new lines end statements only where no bracket but a brace is open; the parser asks for lines instead
        self.lines_at = {}
        tokens = []
        for t in self.s.tokens:
            if t.kind == "nl":
                self.lines_at[len(tokens)] = True
            else:
                tokens.append(t)
        self.s = Source(text, lambda _: [*tokens, *self.s.comments])
        self.t = self.s.tokens
        self.rows = Rows(self.s, shallow, KEPT)
        folder = path.rpartition("/")[0]
        self.package = package_path(folder, modules)
        self.aliases, self.fields = {}, {}
        later = []
        for a, b in self.statements(0, len(self.t)):
            head = self.t[a].text
            if head == "func":
                later.append((a, b))
            elif head in ("import", "type", "const", "var"):
                if self.s.is_(a + 1, "("):
                    specs = self.statements(a + 2, self.s.close(a + 1))
                else:
                    specs = [(a + 1, b)]
                for x, y in specs:
                    {"import": self.imported, "type": self.typed}.get(head, self.valued)(a, x, y)
        for a, b in later:
            self.function(a, b)

    def qual(self, name):
        return f"{self.package}.{name}" if self.package else name

    def statements(self, a, b):
        """Ranges of [a, b) between new lines or semicolons outside brackets."""
        out, start, i = [], a, a
        while i < b:
            if i > start and self.lines_at.get(i) and not self.s.is_(i - 1, ",", ".", "=", ":=", "+", "&&", "||", "("):
                out.append((start, i))
                start = i
            if self.s.is_(i, ";"):
                if start < i:
                    out.append((start, i))
                start = i + 1
            elif self.t[i].text in "([{" and self.t[i].kind == "op":
                i = min(self.s.close(i), b - 1)
            i += 1
        if start < b:
            out.append((start, b))
        return out

    def doc(self, spec, decl):
        return self.s.doc(spec) or self.s.doc(decl)

    def imported(self, decl, a, b):
        path = self.t[b - 1].text.strip('"`')
        alias = self.t[a].text if b - a > 1 else path.rsplit("/", 1)[-1]
        self.rows.imports.append({"alias": alias, "fqn": path, "kind": ""})
        if alias not in ("_", "."):
            self.aliases[alias] = path

    def resolve(self, a, b):
        """(name, exact) of a type expression that is one named type."""
        while a < b and self.s.is_(a, "*", "("):
            b -= self.s.is_(a, "(")
            a += 1
        if not self.s.word(a) or a >= b or self.t[a].text in KEYWORDS:
            return "", False
        name = self.t[a].text
        if self.s.is_(a + 1, ".") and a + 2 < b:
            member = self.t[a + 2].text
            return (f"{self.aliases[name]}.{member}", True) if name in self.aliases else (f"{name}.{member}", False)
        if a + 1 < b and not self.s.is_(a + 1, "["):
            return "", False
        return ("", False) if name in TYPES else (self.qual(name), True)

    def type_edges(self, a, b, owner):
        """references_type edges of every name in a type expression."""
        i = a
        while i < b:
            if self.s.is_(i, "func") and self.s.is_(i + 1, "("):
                self.parameters(i + 1, owner)
                i = self.s.close(i + 1)
            elif self.s.word(i) and self.t[i].text not in KEYWORDS:
                end = i + 3 if self.s.is_(i + 1, ".") else i + 1
                to, exact = self.resolve(i, min(end, b))
                if to:
                    self.rows.edge(owner, "references_type", to, exact, i)
                i = end - 1
            i += 1

    def parameters(self, i, owner):
        """Type edges of a bracketed parameter list; {name: type}."""
        parts = self.s.split(i + 1, self.s.close(i), ",")

        def has_name(a, b):
            if b - a < 2 or not self.s.word(a) or self.t[a].text in KEYWORDS or self.s.is_(a + 1, "."):
                return False
            return not (self.s.is_(a + 1, "[") and self.s.close(a + 1) == b - 1 and not self.s.is_(a + 2, "]"))

        named, out, waiting = any(has_name(*p) for p in parts), {}, []
        for a, b in parts:
            if named and b - a == 1:
                waiting.append(self.t[a].text)
                continue
            start = a + 1 if named else a
            start += self.s.is_(start, "...")
            self.type_edges(start, b, owner)
            to, _ = self.resolve(start, b)
            if named and to:
                out |= dict.fromkeys([*waiting, self.t[a].text], to)
            waiting = []
        return out

    def typed(self, decl, a, b):
        if not self.s.word(a):
            return
        name, fqn, i = self.t[a].text, self.qual(self.t[a].text), a + 1
        if self.s.is_(i, "[") and not self.s.is_(i + 1, "]") and self.s.close(i) + 1 < b and self.t[i + 1].kind == "id" and self.s.close(i) > i + 2:
            i = self.s.close(i) + 1  # type parameters
        i += self.s.is_(i, "=")
        kind = {"struct": "class", "interface": "interface"}.get(self.t[i].text if i < b else "", "type_alias")
        body = self.s.find(i, b, "{") if kind != "type_alias" else b
        self.rows.symbol(kind, name, fqn, a, b - 1, signature="type " + self.s.signature(a, body), doc=self.doc(a, decl))
        if kind == "type_alias":
            self.type_edges(i, b, fqn)
            return
        for x, y in self.statements(body + 1, self.s.close(body)):
            (self.field if kind == "class" else self.element)(fqn, x, y)

    def field(self, owner, a, b):
        end = b - (self.t[b - 1].kind == "str")  # a tag
        names, i = [], a
        while self.s.word(i) and self.s.is_(i + 1, ","):
            names.append(self.t[i].text)
            i += 2
        if self.s.word(i) and i + 1 < end and not self.s.is_(i + 1, "."):
            generic = self.s.is_(i + 1, "[") and self.s.close(i + 1) == end - 1 and not self.s.is_(i + 2, "]")
            if names or not generic:
                names.append(self.t[i].text)
                i += 1
        if not names:
            to, exact = self.resolve(a, end)
            if to:
                self.rows.edge(owner, "extends", to, exact, a, always=True)
            return
        self.type_edges(i, end, owner)
        to, _ = self.resolve(i, end)
        for n in names:
            if to:
                self.fields.setdefault(owner, {})[n] = to
            self.rows.symbol("property", n, f"{owner}.{n}", a, b - 1, owner, self.s.signature(a, b), self.s.doc(a))

    def element(self, owner, a, b):
        if self.s.word(a) and self.s.is_(a + 1, "("):
            name = self.t[a].text
            self.rows.symbol("method", name, f"{owner}.{name}()", a, b - 1, owner, self.s.signature(a, b), self.s.doc(a))
            return
        for x, y in self.s.split(a, b, "|"):
            to, exact = self.resolve(x + self.s.is_(x, "~"), y)
            if to:
                self.rows.edge(owner, "extends", to, exact, a, always=True)

    def valued(self, decl, a, b):
        word = self.t[decl].text
        for x, y in self.s.split(a, self.s.find(a, b, "="), ","):
            name = self.t[x].text
            if self.s.word(x) and name != "_":
                self.rows.symbol("constant" if word == "const" else "property", name, self.qual(name), a, b - 1, signature=f"{word} {self.s.signature(a, b)}", doc=self.doc(a, decl))

    def function(self, a, b):
        i, owner, own = a + 1, "", {}
        if self.s.is_(i, "("):
            end = self.s.close(i)
            at = i + 1 + (self.s.word(i + 1) and not self.s.is_(i + 2, ")", "["))
            base = at + self.s.is_(at, "*")
            if not self.s.word(base):
                return
            owner = self.qual(self.t[base].text)
            own = {self.t[i + 1].text: owner} if at > i + 1 else {}
            i = end + 1
        if not self.s.word(i):
            return
        name = self.t[i].text
        fqn = f"{owner}.{name}()" if owner else self.qual(name) + "()"
        i += 1
        if self.s.is_(i, "["):
            i = self.s.close(i) + 1
        close = self.s.close(i)
        body = self.s.find(close + 1, b, "{")
        while body < b and self.s.is_(body - 1, "interface", "struct"):
            body = self.s.find(self.s.close(body) + 1, b, "{")
        self.rows.symbol("method" if owner else "function", name, fqn, a, b - 1, owner, self.s.signature(a, body), self.s.doc(a))
        names = self.parameters(i, fqn) | own
        if self.s.is_(close + 1, "("):
            self.parameters(close + 1, fqn)
        else:
            self.type_edges(close + 1, body, fqn)
        if body < b:
            self.body(body + 1, self.s.close(body), fqn, names)

    def body(self, a, b, owner, names):
        blocks = set()
        for i in range(a, b):
            t = self.t[i]
            if t.kind != "id":
                continue
            if t.text in ("if", "for", "switch", "select"):
                blocks.add(self.s.find(i + 1, b, "{"))
            elif t.text == "func" and self.s.is_(i + 1, "("):
                blocks.add(self.s.find(self.s.close(i + 1) + 1, b, "{"))
            elif t.text in KEYWORDS:
                continue
            elif self.s.is_(i + 1, "("):
                self.call(i, owner, names)
            elif self.s.is_(i + 1, "{") and i + 1 not in blocks:
                start = i - 2 if self.s.is_(i - 1, ".") and self.s.word(i - 2) else i
                if not self.s.is_(start - 1, "]", "."):
                    to, exact = self.resolve(start, i + 1)
                    if to:
                        self.rows.edge(owner, "instantiates", to, exact, start)

    def call(self, i, owner, names):
        name = self.t[i].text
        if not self.s.is_(i - 1, "."):
            if name not in FUNCTIONS and not self.s.is_(i - 1, "func"):
                self.rows.edge(owner, "calls", self.qual(name) + "()", False, i)
            return
        if not self.s.word(i - 2):
            return
        left = self.t[i - 2].text
        if not self.s.is_(i - 3, "."):
            if left in self.aliases:
                self.rows.edge(owner, "calls", f"{self.aliases[left]}.{name}()", True, i)
            elif left in names:
                self.rows.edge(owner, "calls", f"{names[left]}.{name}()", False, i)
        elif self.s.word(i - 4) and not self.s.is_(i - 5, "."):
            to = self.fields.get(names.get(self.t[i - 4].text, ""), {}).get(left)
            if to:
                self.rows.edge(owner, "calls", f"{to}.{name}()", False, i)


def extract(path, text, shallow=False, modules=None):
    p = Parser(path, text, shallow, modules or {})
    return p.rows, p.s.has_errors
