"""A tokenizer and item parser for Rust, enough to list items, types and calls.

Bodies are token streams; braces are matched, so what macros and attributes
hold is skipped as a unit.  Lines are those of the tokens themselves.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<doc>///(?!/)[^\n]*|/\*\*(?![*/])(?:.|\n)*?\*/)
    |(?P<line>//[^\n]*)
    |(?P<open>/\*)
    |(?P<raw>b?c?r(?P<h>\#*)"(?:.|\n)*?"(?P=h))
    |(?P<str>[bc]?"(?:\\(?:.|\n)|[^"\\])*")
    |(?P<char>b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^'\\\n])')
    |(?P<life>'[A-Za-z_]\w*)
    |(?P<word>r\#[A-Za-z_]\w*|[A-Za-z_]\w*)
    |(?P<num>\d[\w]*(?:\.\d[\w]*)?)
    |(?P<op>::|->|=>|\.\.=|\.\.\.|\.\.|.)""",
    re.X,
)
_PAIR = {"(": ")", "[": "]", "{": "}"}
_ITEM = {"fn", "struct", "enum", "trait", "impl", "use", "mod", "type", "const", "static", "macro_rules", "extern", "union"}
_PRIMITIVE_WORDS = {"dyn", "impl", "mut", "const", "for", "as", "where", "fn", "unsafe", "extern"}


@dataclass
class Token:
    kind: str
    text: str
    line: int


class ParseError(ValueError):
    pass


def tokens(source: str) -> list[Token]:
    """Words, numbers, literals, marks and documentation; other comments are dropped."""
    out, at, line = [], 0, 1
    while at < len(source):
        m = _TOKEN.match(source, at)
        kind, text = m.lastgroup if m.lastgroup != "h" else "raw", m[0]
        if kind == "open":
            # block comments nest
            depth, end = 1, at + 2
            while depth:
                n = re.compile(r"/\*|\*/").search(source, end)
                if not n:
                    raise ParseError(f"line {line}: a comment does not end")
                depth += 1 if n[0] == "/*" else -1
                end = n.end()
            text = source[at:end]
        elif kind not in ("space", "line"):
            out.append(Token(kind, text, line))
        line += text.count("\n")
        at += len(text)
    return out


class Items:
    """Reads the items of a file into nodes, edges and pending edges, by a sink's methods."""

    def __init__(self, source: str, sink: FileSink) -> None:
        self.t, self.sink = tokens(source), sink
        self.close = self._match()

    def _match(self) -> dict[int, int]:
        stack, close = [], {}
        for i, t in enumerate(self.t):
            if t.kind == "op" and t.text in _PAIR:
                stack.append(i)
            elif t.kind == "op" and t.text in (")", "]", "}"):
                if not stack or _PAIR[self.t[stack[-1]].text] != t.text:
                    raise ParseError(f"line {t.line}: `{t.text}` closes nothing")
                close[stack.pop()] = i
        if stack:
            raise ParseError(f"line {self.t[stack[-1]].line}: `{self.t[stack[-1]].text}` is not closed")
        return close

    def text(self, a: int, z: int) -> str:
        return " ".join(t.text for t in self.t[a:z] if t.kind != "doc")

    def at(self, i: int) -> str:
        return self.t[i].text if i < len(self.t) else ""

    def until(self, i: int, z: int, *stops: str) -> int:
        """Place of the first of some marks outside brackets, or ``z``."""
        while i < z:
            if self.t[i].kind == "op" and self.t[i].text in stops:
                return i
            i = self.close.get(i, i) + 1
        return z

    def split(self, a: int, z: int) -> list[tuple[int, int]]:
        """Ranges between the commas outside all brackets, angle ones too."""
        out, start, angle, i = [], a, 0, a
        while i < z:
            t = self.t[i]
            if t.kind == "op":
                if t.text == "<":
                    angle += 1
                elif t.text == ">":
                    angle -= 1
                elif t.text == "," and angle <= 0:
                    out.append((start, i))
                    start = i + 1
            i = self.close.get(i, i) + 1
        return [(x, y) for x, y in [*out, (start, z)] if x < y]

    def generics(self, i: int) -> int:
        """Place after ``<...>`` if one stands here."""
        if self.at(i) != "<":
            return i
        depth = 0
        while i < len(self.t):
            if self.t[i].kind == "op":
                depth += (self.t[i].text == "<") - (self.t[i].text == ">")
            i += 1
            if not depth:
                break
        return i

    def head(self, i: int, z: int) -> tuple[int, str | None, str | None, bool]:
        """Skips attributes, docs and visibility: (place, docs, visibility, whether a test attribute was there)."""
        docs, seen = [], False
        while i < z:
            t = self.t[i]
            if t.kind == "doc":
                text = t.text[3:] if t.text.startswith("///") else t.text[3:-2]
                docs += [x.strip().lstrip("*").strip() for x in text.split("\n")]
                i += 1
            elif t.text == "#":
                i += 1 + (self.at(i + 1) == "!")
                inner = self.text(i + 1, self.close[i])
                m = re.fullmatch(r'doc = "(.*)"', inner, re.S)
                docs += [m[1].strip()] if m else []
                i = self.close[i] + 1
            else:
                break
        visible = None
        if self.at(i) == "pub":
            visible = "pub"
            if self.at(i + 1) == "(":
                visible = "pub (" + self.text(i + 2, self.close[i + 1]) + ")"
                i = self.close[i + 1]
            i += 1
        return i, "\n".join(d for d in docs if d) or None, visible, seen

    def types(self, a: int, z: int) -> list[str]:
        """Paths of the types that a range names, generic arguments included."""
        out, i = [], a
        while i < z:
            t = self.t[i]
            if t.kind == "word" and t.text not in _PRIMITIVE_WORDS:
                path = [t.text]
                while self.at(i + 1) == "::" and i + 2 < z and self.t[i + 2].kind == "word":
                    i += 2
                    path.append(self.t[i].text)
                if i + 1 >= z or self.at(i + 1) != "=":
                    out.append("::".join(path))
            i += 1
        return out

    def calls(self, a: int, z: int) -> list[tuple[str, str, int]]:
        """(target, style, line) of calls; what a macro's brackets hold is not looked into."""
        out, i = [], a
        while i < z:
            t = self.t[i]
            if t.kind == "word":
                start = i
                path = [t.text]
                while self.at(i + 1) == "::":
                    j = i + 2
                    if self.at(j) == "<":
                        j = self.generics(j)
                        i = j - 1
                        break
                    if j >= z or self.t[j].kind != "word":
                        break
                    path.append(self.t[j].text)
                    i = j
                follows = self.at(i + 1)
                if follows == "!" and self.at(i + 2) in _PAIR:
                    out.append(("::".join(path), "macro", t.line))
                    i = self.close.get(i + 2, i)
                elif follows == "(" and path[0] not in ("if", "while", "match", "for", "return", "in", "fn", "let", "else", "loop", "move", "as"):
                    method = start > a and self.at(start - 1) == "."
                    out.append(("::".join(path), "method" if method else "direct", t.line))
            elif t.text == "#" and self.at(i + 1) == "[":
                i = self.close[i + 1]
            i += 1
        return out

    def function(self, i: int, z: int) -> tuple[str, int, int, int, int]:
        """From ``fn``: (name, place of its parameters, of the end of the signature, of the body, after the item)."""
        name = self.t[i + 1].text
        params = self.generics(i + 2)
        end = self.until(self.close[params] + 1, z, "{", ";")
        after = self.close[end] + 1 if self.at(end) == "{" else end + 1
        return name, params, end, end, after

    def signature_edges(self, owner: int, params: int, end: int, returns: bool = True) -> None:
        for a, z in self.split(params + 1, self.close[params]):
            i = self.head(a, z)[0]
            colon = self.until(i, z, ":")
            if colon < z and self.text(i, colon) not in ("self", "mut self"):
                self.sink.uses(owner, self.types(colon + 1, z), "uses_type", self.t[i].line)
        i = self.close[params] + 1
        if returns and self.at(i) == "->":
            where = next((k for k in range(i, end) if self.t[k].text == "where"), end)
            self.sink.uses(owner, self.types(i + 1, where), "returns", self.t[i].line)

    def fn(self, owner: int, i: int, z: int, kind: str, scope: str, edge: str, start: int, docs, visible, body: bool = True) -> int:
        name, params, end, _, after = self.function(i, z)
        me = self.sink.symbol(kind, name, f"{scope}::{name}", self.t[i].line, self.t[after - 1].line, visible, self.text(start, end), docs)
        self.sink.edge(owner, me, edge, self.t[i].line)
        self.signature_edges(me, params, end, body)
        if body and self.at(end) == "{":
            for target, style, line in self.calls(end + 1, self.close[end]):
                self.sink.call(me, target, style, line)
        return after

    def items(self, a: int, z: int, owner: int, scope: str) -> None:
        i = a
        while i < z:
            i, docs, visible, _ = self.head(i, z)
            if i >= z:
                break
            start = i
            # words before the item's own
            while self.at(i) in ("unsafe", "async", "default", "auto") or (self.at(i) == "const" and self.at(i + 1) in ("fn", "unsafe", "async", "extern")) or (self.at(i) == "extern" and i + 2 < z and (self.at(i + 1) == "fn" or self.at(i + 2) in ("fn", "{"))):
                if self.at(i) == "extern" and self.at(i + 2) == "{":
                    break
                i += 2 if self.at(i) == "extern" and self.t[i + 1].kind in ("str", "raw") else 1
            word = self.at(i)
            line = self.t[i].line
            if word == "fn":
                i = self.fn(owner, i, z, "function", scope, "declares", start, docs, visible)
            elif word in ("struct", "union") and i + 1 < z and self.t[i + 1].kind == "word":
                i = self.struct(owner, i, z, scope, start, docs, visible)
            elif word == "enum":
                i = self.enum(owner, i, z, scope, docs, visible)
            elif word == "trait":
                name = self.at(i + 1)
                body = self.until(self.generics(i + 2), z, "{", ";")
                end = self.close.get(body, body)
                me = self.sink.symbol("trait", name, f"{scope}::{name}", line, self.t[end].line, visible, f"trait {name}", docs)
                self.sink.edge(owner, me, "declares", line)
                self.methods(me, body + 1, end, f"{scope}::{name}", False)
                i = end + 1
            elif word == "impl":
                i = self.impl(i, z, scope)
            elif word == "use":
                end = self.until(i, z, ";")
                for path in self.use_tree(i + 1, end, ()):
                    self.sink.imports(owner, path, line)
                i = end + 1
            elif word == "mod":
                name, end = self.at(i + 1), i + 2
                inline = self.at(end) == "{"
                me = self.sink.symbol("module", name, f"{scope}::{name}", line, self.t[self.close[end]].line if inline else line, visible, f"mod {name}", docs)
                self.sink.edge(owner, me, "declares", line)
                if inline:
                    self.items(end + 1, self.close[end], me, f"{scope}::{name}")
                i = self.close.get(end, end) + 1
            elif word in ("type", "const", "static"):
                n = i + 1 + (self.at(i + 1) == "mut")
                name, end = self.at(n), self.until(i, z, ";")
                me = self.sink.symbol({"type": "type_alias"}.get(word, word), name, f"{scope}::{name}", line, self.t[min(end, z - 1)].line, visible, self.text(start, end + 1), docs)
                self.sink.edge(owner, me, "declares", line)
                equals = self.until(n + 1, end, "=")
                span = (equals + 1, end) if word == "type" else (n + 2, equals)
                self.sink.uses(me, self.types(*span), "uses_type", line)
                i = end + 1
            elif word == "macro_rules" and self.at(i + 1) == "!":
                name, body = self.at(i + 2), i + 3
                me = self.sink.symbol("macro", name, f"{scope}::{name}", line, self.t[self.close[body]].line, visible, f"macro {name}", docs)
                self.sink.edge(owner, me, "declares", line)
                i = self.close[body] + 1
            else:
                # a macro call, an extern block, or a mark between items
                end = self.until(i, z, ";", "{")
                i = self.close.get(end, end) + 1

    def struct(self, owner: int, i: int, z: int, scope: str, start: int, docs, visible) -> int:
        name, line = self.at(i + 1), self.t[i].line
        body = self.until(self.generics(i + 2), z, "{", "(", ";")
        end = self.close.get(body, body)
        if self.at(body) == "(":
            end = self.until(end, z, ";")
        me = self.sink.symbol("struct", name, f"{scope}::{name}", line, self.t[min(end, z - 1)].line, visible, self.text(start, end + 1), docs)
        self.sink.edge(owner, me, "declares", line)
        if body in self.close:
            for a, b in self.split(body + 1, self.close[body]):
                k, field_docs, field_visible, _ = self.head(a, b)
                if self.at(body) == "{":
                    if k + 1 >= b:
                        continue
                    field = self.at(k)
                    f = self.sink.symbol("field", field, f"{scope}::{name}::{field}", self.t[k].line, self.t[k].line, field_visible, self.text(k + 2, b), field_docs)
                    self.sink.edge(me, f, "declares", self.t[k].line)
                    self.sink.uses(f, self.types(k + 2, b), "uses_type", self.t[k].line)
                elif k < b:
                    self.sink.uses(me, self.types(k, b), "uses_type", self.t[k].line)
        return end + 1

    def enum(self, owner: int, i: int, z: int, scope: str, docs, visible) -> int:
        name, line = self.at(i + 1), self.t[i].line
        body = self.until(self.generics(i + 2), z, "{")
        end = self.close[body]
        me = self.sink.symbol("enum", name, f"{scope}::{name}", line, self.t[end].line, visible, f"enum {name}", docs)
        self.sink.edge(owner, me, "declares", line)
        for a, b in self.split(body + 1, end):
            k, member_docs, _, _ = self.head(a, b)
            if k >= b:
                continue
            member = self.at(k)
            m = self.sink.symbol("enum_member", member, f"{scope}::{name}::{member}", self.t[k].line, self.t[b - 1].line, None, self.text(k, b), member_docs)
            self.sink.edge(me, m, "declares", self.t[k].line)
            if k + 1 in self.close:
                for x, y in self.split(k + 2, self.close[k + 1]):
                    s = self.head(x, y)[0]
                    if self.at(k + 1) == "{":
                        s = self.until(s, y, ":") + 1
                    self.sink.uses(m, self.types(s, y), "uses_type", self.t[k].line)
        return end + 1

    def methods(self, owner: int, a: int, z: int, scope: str, body: bool) -> None:
        i = a
        while i < z:
            i, docs, visible, _ = self.head(i, z)
            start = i
            while i < z and self.at(i) in ("unsafe", "async", "const", "default", "extern") and (self.at(i) != "const" or self.at(i + 1) in ("fn", "unsafe", "async", "extern")):
                i += 2 if self.at(i) == "extern" and self.t[i + 1].kind == "str" else 1
            if self.at(i) == "fn":
                i = self.fn(owner, i, z, "method", scope, "has_method", start, docs, visible if body else None, body)
            else:
                end = self.until(i, z, ";", "{")
                i = self.close.get(end, end) + 1

    def impl(self, i: int, z: int, scope: str) -> int:
        line, k = self.t[i].line, self.generics(i + 1)
        body = self.until(k, z, "{")
        where = next((x for x in range(k, body) if self.t[x].text == "where"), body)
        depth, split = 0, None
        for x in range(k, where):
            depth += (self.at(x) == "<") - (self.at(x) == ">")
            if self.at(x) == "for" and not depth and self.at(x + 1) != "<":
                split = x
        path = lambda a, b: (self.types(a, b) or [self.text(a, b)])[0]
        target = path(split + 1 if split else k, where)
        trait = path(k, split) if split else None
        name = f"impl {trait} for {target}" if trait else f"impl {target}"
        me = self.sink.symbol("impl", name, f"{scope}::{name}", line, self.t[self.close[body]].line, None, self.text(i, body), None)
        self.sink.edge(self.sink.file, me, "declares", line)
        self.sink.uses(me, [target], "uses_type", line)
        if trait:
            self.sink.pend(me, trait, "implements", "any", None, line)
        self.methods(me, body + 1, self.close[body], f"{scope}::{target}", True)
        return self.close[body] + 1

    def use_tree(self, a: int, z: int, path: tuple[str, ...]) -> list[str]:
        """Imported paths: groups expand, ``as`` keeps the original, ``*`` is its prefix."""
        i = a + (self.at(a) == "::")
        parts = list(path)
        while i < z:
            if self.at(i) == "{":
                return [p for x, y in self.split(i + 1, self.close[i]) for p in self.use_tree(x, y, tuple(parts))]
            if self.at(i) in ("*", "as"):
                break
            if self.at(i) == "self" and parts:
                break
            if self.at(i) != "::":
                parts.append(self.at(i))
            i += 1
        return ["::".join(parts)] if parts else []


class FileSink:
    """Collects what a file yields; ``file`` and ``module`` are numbers of its first two nodes."""

    def __init__(self, path: str, module: str, source: str) -> None:
        self.path, self.nodes, self.edges, self.pending = path, [], [], []
        lines = source.splitlines()
        self.file = self.symbol("file", path, path, 1, max(1, len(lines)), None, None, None)
        self.nodes[0] |= {"lines": len(lines), "non_empty_lines": sum(bool(x.strip()) for x in lines), "comment_lines": sum(x.strip().startswith("//") for x in lines)}
        self.module = self.symbol("module", module, module, None, None, None, None, None)
        self.edge(self.file, self.module, "module_file", None)

    def symbol(self, kind, name, qualified_name, start, end, visibility, signature, docs) -> int:
        self.nodes.append({"number": len(self.nodes), "kind": kind, "name": name, "qualified_name": qualified_name, "file": self.path, "start_line": start, "end_line": end, "visibility": visibility, "signature": " ".join(signature.split()) if signature else None, "docs": docs})
        return len(self.nodes) - 1

    def edge(self, src: int, dst: int, kind: str, line) -> None:
        self.edges.append({"src_number": src, "dst_number": dst, "kind": kind, "line": line})

    def pend(self, src: int, target: str, kind: str, strategy: str, style, line) -> None:
        target = target.removeprefix("crate::").removeprefix("self::").removeprefix("super::")
        self.pending.append({"src_number": src, "target": target, "kind": kind, "strategy": strategy, "call_style": style, "line": line})

    def uses(self, owner: int, names: list[str], kind: str, line) -> None:
        for n in names:
            self.pend(owner, n, kind, "any", None, line)

    def imports(self, owner: int, path: str, line) -> None:
        self.pend(owner, path, "imports", "any", None, line)

    def call(self, owner: int, target: str, style: str, line) -> None:
        self.pend(owner, target, "calls", {"direct": "callable", "method": "method", "macro": "macro"}[style], style, line)


def module_name(crate: str, root: str, path: str) -> str:
    """Module of a file: the crate, then the parts of its path below the target's folder."""
    relative = path[len(root) :].lstrip("/") if root and path.startswith(root) else path
    parts = [crate.replace("-", "_")]
    parts += [re.sub(r"(\.rs)+$", "", p) for p in relative.split("/") if p not in ("src", "lib.rs", "main.rs", "mod.rs")]
    return "::".join(parts)


def scan(path: str, crate: str, root: str, source: str) -> FileSink:
    sink = FileSink(path, module_name(crate, root, path), source)
    items = Items(source, sink)
    items.items(0, len(items.t), sink.module, sink.nodes[1]["qualified_name"])
    return sink
