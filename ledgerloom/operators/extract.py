"""Source files to symbols, imports, relationships and diagnostics.

Python goes through `ast`.  TypeScript and JavaScript go through a tolerant
tokenizer and a small statement reader; what it cannot place becomes a
diagnostic, never a guess.  Spans are in bytes.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from ledgerloom.functions.canonical import canonical_json, sha256
from ledgerloom.functions.text import detect_language


@dataclass(frozen=True)
class Span:
    content_hash: str
    start: int
    end: int
    start_line: int
    start_column: int
    end_line: int
    end_column: int


@dataclass
class Symbol:
    key: str
    kind: str
    name: str
    qualified: str
    parent: str | None
    exported: bool
    span: Span
    signature: str | None = None
    discriminator: str = ""


@dataclass
class Import:
    key: str
    module: str
    bindings: tuple[tuple[str, str], ...]  # imported, local
    style: str
    scope: str
    span: Span
    type_only: tuple[str, ...] = ()  # local names


@dataclass
class Relationship:
    source: str
    target: str
    kind: str
    receiver: str | None
    scope: str
    unsafe: bool
    span: Span


@dataclass
class Diagnostic:
    code: str
    message: str
    path: str
    severity: str
    span: Span | None = None


@dataclass
class Extracted:
    """What one file says."""

    path: str
    language: str
    content_hash: str
    symbols: list[Symbol] = field(default_factory=list)
    imports: list[Import] = field(default_factory=list)
    relationships: list[Relationship] = field(default_factory=list)
    diagnostics: list[Diagnostic] = field(default_factory=list)
    #: exported name, local name, and whether only as a type
    aliases: list[tuple[str, str, bool]] = field(default_factory=list)
    unsafe_names: list[str] = field(default_factory=list)

    def as_json(self) -> dict[str, Any]:
        return _plain(asdict(self))


def _plain(v: Any) -> Any:
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def from_json(v: dict[str, Any]) -> Extracted:
    """The counterpart of Extracted.as_json."""

    def span(x: dict[str, Any] | None) -> Span | None:
        return None if x is None else Span(**x)

    return Extracted(
        v["path"], v["language"], v["content_hash"],
        [Symbol(**{**x, "span": span(x["span"])}) for x in v["symbols"]],
        [Import(**{**x, "span": span(x["span"]), "bindings": tuple(map(tuple, x["bindings"])), "type_only": tuple(x["type_only"])}) for x in v["imports"]],
        [Relationship(**{**x, "span": span(x["span"])}) for x in v["relationships"]],
        [Diagnostic(**{**x, "span": span(x["span"])}) for x in v["diagnostics"]],
        [tuple(a) for a in v["aliases"]], list(v["unsafe_names"]),
    )


class Builder:
    """Collects what a reader finds; numbers keys, checks spans, and poisons scopes."""

    def __init__(self, content: bytes, path: str, language: str) -> None:
        self.content, self.hash = content, sha256(content)
        self.out = Extracted(path, language, self.hash)
        self.lines = [0, *(m.end() for m in re.finditer(rb"\n", content))]
        self.poisoned: set[str] = set()
        whole = self.span(0, len(content))
        self.out.symbols.append(Symbol("$file", "file", path, path, None, False, whole))
        self.out.symbols.append(Symbol("$module", "module", path.rsplit("/", 1)[-1], path, "$file", True, whole))
        self.by_key = {s.key: s for s in self.out.symbols}

    def span(self, start: int, end: int) -> Span:
        def place(at: int) -> tuple[int, int]:
            low, high = 0, len(self.lines)
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if self.lines[mid] <= at else (low, mid)
            return low + 1, at - self.lines[low]

        if not 0 <= start <= end <= len(self.content):
            raise ValueError("a span leaves its file")
        return Span(self.hash, start, end, *place(start), *place(end))

    def symbol(self, kind: str, name: str, parent: str, span: Span, exported: bool = False, signature: str | None = None) -> Symbol:
        above = self.by_key[parent]
        qualified = name if above.kind in ("file", "module") else f"{above.qualified}.{name}"
        key = f"{kind}:{qualified}:{len(self.out.symbols)}"
        s = Symbol(key, kind, name, qualified, parent, exported, span, None if signature is None else " ".join(signature.split()))
        self.out.symbols.append(s)
        self.by_key[key] = s
        return s

    def relate(self, kind: str, source: str, target: str, span: Span, receiver: str | None = None, unsafe: bool = False) -> None:
        self.out.relationships.append(Relationship(source, target, kind, receiver, source, unsafe, span))

    def diagnose(self, code: str, message: str, span: Span | None, severity: str = "warning") -> None:
        self.out.diagnostics.append(Diagnostic(code, message, self.out.path, severity, span))

    def poison(self, scope: str, span: Span) -> None:
        """A binding scope that is not followed: nothing in the enclosing declaration resolves."""
        if scope not in self.poisoned:
            self.poisoned.add(scope)
            self.diagnose("UNSUPPORTED_SCOPE", "a binding scope is kept but not resolved", span)

    def finish(self) -> Extracted:
        unsafe = set(self.out.unsafe_names)
        for r in self.out.relationships:
            if r.scope in self.poisoned or r.target in unsafe or (r.receiver or "").split(".")[0] in unsafe:
                r.unsafe = True
        groups: dict[tuple[str, str], list[Symbol]] = {}
        for s in self.out.symbols:
            groups.setdefault((s.kind, s.qualified), []).append(s)
        for same in groups.values():
            if len(same) > 1:  # overloads: told apart by signature and order
                seen: dict[str, int] = {}
                for s in same:
                    digest = sha256(s.signature or "")[:12]
                    s.discriminator = f"{digest}:{seen.get(digest, 0)}"
                    seen[digest] = seen.get(digest, 0) + 1
        self.out.unsafe_names = sorted(unsafe)
        return self.out


# ---------------------------------------------------------------- Python


class _Python(ast.NodeVisitor):
    def __init__(self, b: Builder) -> None:
        self.b, self.scopes = b, ["$module"]

    @property
    def scope(self) -> str:
        return self.scopes[-1]

    def at(self, node: ast.AST) -> Span:
        def byte(line: int, column: int) -> int:
            return self.b.lines[line - 1] + column

        return self.b.span(byte(node.lineno, node.col_offset), byte(node.end_lineno, node.end_col_offset))

    def _inside(self, key: str, nodes: list[ast.AST]) -> None:
        self.scopes.append(key)
        for n in nodes:
            self.visit(n)
        self.scopes.pop()

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        top = self.b.by_key[self.scope]
        kind = "method" if top.kind == "class" else "function"
        s = self.b.symbol(kind, node.name, self.scope, self.at(node), self.scope == "$module", f"{node.name}({ast.unparse(node.args)})")
        for a in (*node.args.posonlyargs, *node.args.args, *filter(None, [node.args.vararg]), *node.args.kwonlyargs, *filter(None, [node.args.kwarg])):
            self.b.symbol("parameter", a.arg, s.key, self.at(a))
        for x in (*node.decorator_list, *node.args.defaults, *filter(None, node.args.kw_defaults)):
            self.visit(x)
        self._inside(s.key, node.body)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        s = self.b.symbol("class", node.name, self.scope, self.at(node), self.scope == "$module")
        for base in node.bases:
            receiver, name = _attribute(base)
            if name:
                self.b.out.relationships.append(Relationship(s.key, name, "EXTENDS", receiver, self.scope, False, self.at(base)))
        for x in node.decorator_list:
            self.visit(x)
        self._inside(s.key, node.body)

    def visit_Import(self, node: ast.Import) -> None:
        for a in node.names:
            local = a.asname or a.name.split(".")[0]
            self.b.out.imports.append(Import(f"import:{len(self.b.out.imports)}", a.name, (("*", local),), "python_module", self.scope, self.at(node)))

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        bindings = tuple((a.name, a.asname or a.name) for a in node.names if a.name != "*")
        if any(a.name == "*" for a in node.names):
            self.b.diagnose("UNSUPPORTED_IMPORT", "a star import is not followed", self.at(node))
        self.b.out.imports.append(Import(f"import:{len(self.b.out.imports)}", module, bindings, "named", self.scope, self.at(node)))

    def _assign(self, target: ast.AST, value: ast.AST | None) -> None:
        if isinstance(target, (ast.Tuple, ast.List)):
            for x in target.elts:
                self._assign(x, None)
        elif isinstance(target, ast.Starred):
            self._assign(target.value, None)
        elif isinstance(target, ast.Name):
            known = [s for s in self.b.out.symbols if s.parent == self.scope and s.name == target.id]
            imported = any(local == target.id for i in self.b.out.imports for _, local in i.bindings)
            if known or imported:
                self.b.out.unsafe_names.append(target.id)
                self.b.diagnose("REBINDING", f"assignment to {target.id} makes calls of it unsafe", self.at(target))
                self.b.relate("REFERENCES", self.scope, target.id, self.at(target), unsafe=True)
            elif isinstance(value, ast.Lambda):
                self.b.symbol("function", target.id, self.scope, self.at(target), self.scope == "$module")
            else:
                self.b.symbol("constant" if target.id.isupper() else "variable", target.id, self.scope, self.at(target), self.scope == "$module")
        else:
            self.visit(target)

    def visit_Assign(self, node: ast.Assign) -> None:
        for t in node.targets:
            self._assign(t, node.value)
        self.visit(node.value)

    def visit_AnnAssign(self, node: ast.AnnAssign) -> None:
        self._assign(node.target, node.value)
        if node.value:
            self.visit(node.value)

    def visit_AugAssign(self, node: ast.AugAssign) -> None:
        self._assign(node.target, None)
        self.visit(node.value)

    def visit_NamedExpr(self, node: ast.NamedExpr) -> None:
        self._assign(node.target, node.value)
        self.visit(node.value)

    def visit_Global(self, node: ast.Global | ast.Nonlocal) -> None:
        self.b.out.unsafe_names += node.names

    visit_Nonlocal = visit_Global

    def visit_Call(self, node: ast.Call) -> None:
        receiver, name = _attribute(node.func)
        if name:
            self.b.relate("CALLS", self.scope, name, self.at(node), receiver)
        else:
            self.visit(node.func)
        for x in (*node.args, *(k.value for k in node.keywords)):
            self.visit(x)

    def visit_Attribute(self, node: ast.Attribute) -> None:
        receiver, name = _attribute(node)
        if name:
            self.b.relate("REFERENCES", self.scope, name, self.at(node), receiver)
        else:
            self.visit(node.value)

    def visit_Name(self, node: ast.Name) -> None:
        if isinstance(node.ctx, ast.Load):
            self.b.relate("REFERENCES", self.scope, node.id, self.at(node))
        else:
            self._assign(node, None)

    def _scoped(self, node: ast.AST) -> None:
        self.b.poison(self.scope, self.at(node))
        self.generic_visit(node)

    visit_Lambda = visit_ListComp = visit_SetComp = visit_DictComp = visit_GeneratorExp = visit_With = visit_AsyncWith = visit_For = visit_AsyncFor = _scoped

    def visit_ExceptHandler(self, node: ast.ExceptHandler) -> None:
        if node.name:
            self.b.poison(self.scope, self.at(node))
        self.generic_visit(node)


def _attribute(node: ast.AST) -> tuple[str | None, str | None]:
    """(receiver, name) of `name` or `a.b.name`; no name where it is anything else."""
    if isinstance(node, ast.Name):
        return None, node.id
    if isinstance(node, ast.Attribute):
        parts, x = [], node.value
        while isinstance(x, ast.Attribute):
            parts.append(x.attr)
            x = x.value
        if isinstance(x, ast.Name):
            return ".".join([x.id, *reversed(parts)]), node.attr
    return None, None


def extract_python(content: bytes, path: str) -> Extracted:
    b = Builder(content, path, "python")
    try:
        tree = ast.parse(content.decode("utf-8"))
    except (SyntaxError, ValueError) as e:
        b.diagnose("SYNTAX_ERROR", str(e), None, "error")
        return b.finish()
    skip = 3 if content.startswith(b"\xef\xbb\xbf") else 0
    if skip:  # offsets of the first line count from behind the mark
        b.lines[0] = 0
    _Python(b).visit(tree)
    return b.finish()


# ---------------------------------------------------------------- TypeScript and JavaScript

TOKEN = re.compile(r"(?P<space>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<name>[A-Za-z_$\u0080-￿][\w$]*)|(?P<number>\d[\w.]*)|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)|(?P<mark>=>|\?\.|\.\.\.|===|!==|==|!=|<=|>=|&&|\|\||\?\?|[+\-*/%&|^]=|\+\+|--|.)", re.S)
CONTROL = frozenset("if for while switch catch with return typeof instanceof in of new delete void throw await yield case do else try finally break continue default async function class const let var import export extends enum this super null undefined true false as satisfies keyof debugger".split())
DECLARES = frozenset("const let var function class".split())
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass(frozen=True)
class Tok:
    kind: str
    text: str
    start: int
    end: int


class _Script:
    def __init__(self, b: Builder, text: str) -> None:
        self.b = b
        self.byte: Callable[[int], int] = (lambda i: i) if text.isascii() else self._offsets(text)
        self.toks = [Tok(m.lastgroup or "mark", m.group(), m.start(), m.end()) for m in TOKEN.finditer(text) if m.lastgroup != "space"]
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.toks):
            if t.kind == "mark" and t.text in OPEN:
                stack.append(i)
            elif t.kind == "mark" and t.text in CLOSE:
                if stack and OPEN[self.toks[stack[-1]].text] == t.text:
                    self.match[stack.pop()] = i
                else:
                    self.b.diagnose("SYNTAX_ERROR", f"unexpected {t.text}", self.span(i, i), "error")
        for i in stack:
            self.b.diagnose("SYNTAX_ERROR", f"{self.toks[i].text} is not closed", self.span(i, i), "error")
        self.text = text

    @staticmethod
    def _offsets(text: str) -> Callable[[int], int]:
        at = [0]
        for c in text:
            at.append(at[-1] + len(c.encode("utf-8", "surrogatepass")))
        return at.__getitem__

    def span(self, first: int, last: int) -> Span:
        last = min(max(first, last), len(self.toks) - 1)
        return self.b.span(self.byte(self.toks[first].start), self.byte(self.toks[last].end))

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].kind != "string" and self.toks[i].text in texts

    def name_at(self, i: int) -> bool:
        return 0 <= i < len(self.toks) and self.toks[i].kind == "name"

    def past(self, i: int) -> int:
        """The token behind the bracket that token i opens, or behind i."""
        return self.match.get(i, i) + 1

    def generics(self, i: int) -> int:
        """Behind a type parameter list, if one begins at i."""
        if not self.is_(i, "<"):
            return i
        depth = 0
        while i < len(self.toks):
            if self.is_(i, "<"):
                depth += 1
            elif self.is_(i, ">"):
                depth -= 1
                if not depth:
                    return i + 1
            elif self.is_(i, *OPEN):
                i = self.past(i) - 1
            i += 1
        return i

    def type_end(self, i: int, *stops: str) -> int:
        """Behind a type annotation: the next of stops outside brackets."""
        while i < len(self.toks) and not self.is_(i, *stops):
            i = self.past(i) if self.is_(i, *OPEN) else i + 1
        return i

    def parameters(self, i: int, scope: str) -> int:
        """Declare the parameters of the list that opens at i."""
        end = self.match.get(i, len(self.toks) - 1)
        k = i + 1
        while k < end:
            while self.is_(k, "...", "public", "private", "protected", "readonly") or self.is_(k, "@"):
                k += 2 if self.is_(k, "@") else 1
            if self.name_at(k):
                self.b.symbol("parameter", self.toks[k].text, scope, self.span(k, k))
            elif self.is_(k, "{", "["):
                for n in range(k + 1, self.match.get(k, k)):
                    if self.name_at(n) and not self.is_(n + 1, ":"):
                        self.b.symbol("parameter", self.toks[n].text, scope, self.span(n, n))
            while k < end and not self.is_(k, ","):
                if self.is_(k, "=") and not self.is_(k, "=>"):
                    stop = k + 1
                    while stop < end and not self.is_(stop, ","):
                        stop = self.past(stop) if self.is_(stop, *OPEN) else stop + 1
                    self.expression(k + 1, stop, scope)
                    k = stop
                    break
                k = self.past(k) if self.is_(k, *OPEN) else k + 1
            k += 1
        return end + 1

    def function(self, i: int, scope: str, kind: str, name: str, first: int, exported: bool) -> int:
        """A function whose type parameters or parameters begin at i; returns behind its body or signature."""
        k = self.generics(i)
        close = self.match.get(k, k)
        after = close + 1
        if self.is_(after, ":"):
            after = self.type_end_of_return(after + 1)
        has_body = self.is_(after, "{")
        last = self.match.get(after, after) if has_body else max(close, after - 1)
        s = self.b.symbol(kind, name, scope, self.span(first, last), exported, self.text[self.toks[k].start : self.toks[min(after, len(self.toks) - 1)].start] if after < len(self.toks) else self.text[self.toks[k].start :])
        if self.is_(k, "("):
            self.parameters(k, s.key)
        if has_body:
            self.block(after + 1, last, s.key)
        return last + 1

    def type_end_of_return(self, i: int) -> int:
        """Behind a return type: its body's brace, or the end of an overload."""
        depth_start = True
        while i < len(self.toks):
            if self.is_(i, ";", "=>", ",", "="):
                return i
            if self.is_(i, "{"):
                if not depth_start:
                    return i
                i = self.past(i)
                depth_start = False
                continue
            depth_start = self.is_(i, "|", "&", ":")
            i = self.past(i) if self.is_(i, "(", "[") else i + 1
        return i

    def statement_end(self, i: int, end: int) -> int:
        """Behind the expression statement that begins at i."""
        k = i
        while k < end:
            if self.is_(k, ";"):
                return k + 1
            if k > i and self.toks[k].kind == "name" and self.toks[k].text in ("const", "let", "var", "function", "class", "export", "import", "interface", "return", "if", "for", "while") and "\n" in self.text[self.toks[k - 1].end : self.toks[k].start]:
                return k
            k = self.past(k) if self.is_(k, *OPEN) else k + 1
        return end

    def block(self, i: int, end: int, scope: str, nested: bool = False) -> None:
        """The statements from i to end; in a nested block declarations poison the scope."""
        while i < end:
            i = max(i + 1, self.statement(i, end, scope, nested, False))

    def statement(self, i: int, end: int, scope: str, nested: bool, exported: bool) -> int:
        t = self.toks[i]
        if t.kind != "name":
            if self.is_(i, "{"):
                self.block(i + 1, self.match.get(i, end), scope, True)
                return self.past(i)
            stop = self.statement_end(i, end)
            self.expression(i, stop, scope)
            return stop
        word = t.text
        if word in ("declare", "abstract", "async", "default") and self.name_at(i + 1) and word != "default":
            return self.statement(i + 1, end, scope, nested, exported)
        if word == "import" and not self.is_(i + 1, "(", "."):
            return self.imports(i, end, scope)
        if word == "export" and scope == "$module":
            return self.exports(i, end)
        if word == "function":
            k = i + 2 if self.is_(i + 1, "*") else i + 1
            if self.name_at(k):
                if nested:
                    self.b.poison(scope, self.span(i, k))
                return self.function(k + 1, scope, "function", self.toks[k].text, i, exported)
        if word == "class" and self.name_at(i + 1):
            if nested:
                self.b.poison(scope, self.span(i, i + 1))
            return self.class_(i, end, scope, exported)
        if word in ("interface", "type", "enum") and self.name_at(i + 1) and not self.is_(i + 1, "="):
            return self.shape(i, end, scope, word, exported)
        if word in ("const", "let", "var") and not self.is_(i + 1, "enum"):
            if nested:
                self.b.poison(scope, self.span(i, i))
            return self.variables(i, end, scope, exported, word)
        if word in ("for", "catch", "with"):
            k = i + 2 if self.is_(i + 1, "await") else i + 1
            if self.is_(k, "("):
                if word != "for" or any(self.is_(n, "const", "let", "var") for n in range(k, self.match.get(k, k))):
                    self.b.poison(scope, self.span(i, k))
                self.expression(k + 1, self.match.get(k, end), scope)
                return self.past(k)
            return i + 1
        if word in ("if", "while", "switch") and self.is_(i + 1, "("):
            self.expression(i + 2, self.match.get(i + 1, end), scope)
            return self.past(i + 1)
        if word in ("else", "try", "finally", "do", "return", "throw", "case"):
            return i + 1
        if word in ("namespace", "module") and self.name_at(i + 1) and self.is_(i + 2, "{"):
            self.b.diagnose("UNSUPPORTED_NAMESPACE", "a namespace is not followed", self.span(i, i + 1))
            return self.past(i + 2)
        stop = self.statement_end(i, end)
        self.expression(i, stop, scope)
        return stop

    def imports(self, i: int, end: int, scope: str) -> int:
        k, types_only = i + 1, False
        if self.is_(k, "type") and not self.is_(k + 1, "from", ","):
            types_only, k = True, k + 1
        bindings: list[tuple[str, str]] = []
        types: list[str] = []
        style = "side_effect"
        while k < end and self.toks[k].kind != "string":
            if self.is_(k, "*") and self.is_(k + 1, "as") and self.name_at(k + 2):
                bindings.append(("*", self.toks[k + 2].text))
                style, k = "namespace", k + 3
            elif self.is_(k, "{"):
                style, close = "named", self.match.get(k, end)
                for imported, local, only in self.specifiers(k, close):
                    bindings.append((imported, local))
                    if only:
                        types.append(local)
                k = close + 1
            elif self.name_at(k) and not self.is_(k, "from"):
                bindings.append(("default", self.toks[k].text))
                style, k = "default", k + 1
            elif self.is_(k, ",", "from"):
                k += 1
            else:
                self.b.diagnose("UNSUPPORTED_IMPORT", "this import form is not followed", self.span(i, k))
                return self.statement_end(i + 1, end)
        if k < end:
            module = self.toks[k].text.strip("\"'`")
            self.b.out.imports.append(Import(f"import:{len(self.b.out.imports)}", module, tuple(bindings), style, scope, self.span(i, k), tuple(local for _, local in bindings) if types_only else tuple(types)))
        stop = k + 1
        return stop + 1 if self.is_(stop, ";") else stop

    def specifiers(self, open_: int, close: int) -> Iterator[tuple[str, str, bool]]:
        """(name, other name, type only) of `{ a, b as c, type d }`."""
        k = open_ + 1
        while k < close:
            only = False
            if self.is_(k, "type") and self.name_at(k + 1) and not self.is_(k + 1, "as"):
                only, k = True, k + 1
            if self.toks[k].kind in ("name", "string"):
                first = self.toks[k].text.strip("\"'")
                second = first
                if self.is_(k + 1, "as") and k + 2 < close:
                    second, k = self.toks[k + 2].text.strip("\"'"), k + 2
                yield first, second, only
            k += 1

    def exports(self, i: int, end: int) -> int:
        k = i + 1
        if self.is_(k, "default"):
            if self.is_(k + 1, "function", "class") and self.name_at(k + 2):
                self.b.out.aliases.append(("default", self.toks[k + 2].text, False))
                return self.statement(k + 1, end, "$module", False, True)
            stop = self.statement_end(k + 1, end)
            self.b.diagnose("UNRESOLVED_EXPORT", "a default expression needs the semantics of modules", self.span(i, k))
            self.expression(k + 1, stop, "$module")
            return stop
        types_only = self.is_(k, "type") and self.is_(k + 1, "{")
        if types_only:
            k += 1
        if self.is_(k, "{"):
            close = self.match.get(k, end)
            if self.is_(close + 1, "from"):
                self.b.diagnose("UNRESOLVED_EXPORT", "a re-export needs the semantics of modules", self.span(i, close))
                return self.statement_end(close + 1, end)
            for local, exported, only in self.specifiers(k, close):
                self.b.out.aliases.append((exported, local, only or types_only))
                if not (only or types_only):
                    self.b.relate("EXPORTS", "$module", local, self.span(k, close))
            return close + 2 if self.is_(close + 1, ";") else close + 1
        if self.is_(k, "*", "="):
            self.b.diagnose("UNRESOLVED_EXPORT", "a re-export needs the semantics of modules", self.span(i, k))
            return self.statement_end(k, end)
        return self.statement(k, end, "$module", False, True)

    def class_(self, i: int, end: int, scope: str, exported: bool) -> int:
        k = self.generics(i + 2)
        body = k
        while body < end and not self.is_(body, "{"):
            body = self.generics(body) if self.is_(body, "<") else body + 1
        close = self.match.get(body, end)
        s = self.b.symbol("class", self.toks[i + 1].text, scope, self.span(i, close), exported)
        kind = None
        while k < body:
            if self.is_(k, "extends", "implements"):
                kind = "EXTENDS" if self.is_(k, "extends") else "IMPLEMENTS"
            elif self.name_at(k) and kind:
                receiver = None
                first = k
                while self.is_(k + 1, ".") and self.name_at(k + 2):
                    receiver = self.toks[k].text if receiver is None else f"{receiver}.{self.toks[k].text}"
                    k += 2
                self.b.out.relationships.append(Relationship(s.key, self.toks[k].text, kind, receiver, scope, False, self.span(first, k)))
            elif self.is_(k, "<"):
                k = self.generics(k) - 1
            k += 1
        self.members(body + 1, close, s.key)
        return close + 1

    def members(self, i: int, end: int, scope: str) -> None:
        while i < end:
            first = i
            while self.is_(i, "static", "public", "private", "protected", "readonly", "abstract", "async", "get", "set", "override", "declare", "*") and not self.is_(i + 1, "(", "=", ";", ":"):
                i += 1
            if self.is_(i, "@"):
                i = self.past(i + 2) if self.is_(i + 2, "(") else i + 2
                continue
            if self.toks[i].kind in ("name", "string") or self.is_(i, "#"):
                if self.is_(i, "#"):
                    i += 1
                name = self.toks[i].text.strip("\"'")
                k = i + 1
                if self.is_(k, "?", "!"):
                    k += 1
                if self.is_(self.generics(k), "("):
                    i = self.function(k, scope, "method", name, first, False)
                    continue
                stop = self.type_end(k, ";", "=")
                if stop > end:
                    stop = end
                self.b.symbol("variable", name, scope, self.span(first, max(i, stop - 1)))
                if self.is_(stop, "="):
                    last = self.type_end(stop + 1, ";")
                    self.expression(stop + 1, min(last, end), scope)
                    stop = min(last, end)
                i = stop + 1
                continue
            i = self.past(i) if self.is_(i, *OPEN) else i + 1

    def shape(self, i: int, end: int, scope: str, word: str, exported: bool) -> int:
        k = self.generics(i + 2)
        while word == "interface" and k < end and not self.is_(k, "{"):
            k += 1
        if word != "type" and self.is_(k, "{"):
            last = self.match.get(k, end)
        else:
            last = min(self.statement_end(k, end), end) - 1
        self.b.symbol("interface" if word == "interface" else "type", self.toks[i + 1].text, scope, self.span(i, last), exported)
        return last + 1

    def variables(self, i: int, end: int, scope: str, exported: bool, word: str) -> int:
        k = i + 1
        while k < end:
            if self.is_(k, "{", "["):
                close = self.match.get(k, end)
                for n in range(k + 1, close):
                    if self.name_at(n) and not self.is_(n + 1, ":"):
                        self.b.symbol("variable", self.toks[n].text, scope, self.span(n, n), exported)
                name, first, k = None, k, close + 1
            elif self.name_at(k):
                name, first, k = self.toks[k].text, k, k + 1
            else:
                return self.statement_end(k, end)
            if self.is_(k, "!"):
                k += 1
            if self.is_(k, ":"):
                k = self.type_end(k + 1, "=", ";", ",") if not self.is_(k + 1, "(") else self.type_end(self.past(k + 1), "=", ";", ",")
            if self.is_(k, "="):
                v = k + 1
                stop = v
                while stop < end and not self.is_(stop, ",", ";"):
                    if stop > v and self.name_at(stop) and self.toks[stop].text in DECLARES | {"export", "import", "interface"} and "\n" in self.text[self.toks[stop - 1].end : self.toks[stop].start]:
                        break
                    stop = self.past(stop) if self.is_(stop, *OPEN) else stop + 1
                k = self.value(v, stop, scope, name, first, exported, word)
            elif name:
                self.b.symbol("variable", name, scope, self.span(first, first), exported)
            if not self.is_(k, ","):
                return k + 1 if self.is_(k, ";") else k
            k += 1
        return k

    def value(self, v: int, stop: int, scope: str, name: str | None, first: int, exported: bool, word: str) -> int:
        """The initializer of a variable; a function there makes the variable a function."""
        k = v + 1 if self.is_(v, "async") else v
        if name and self.is_(k, "function"):
            p = k + 2 if self.name_at(k + 1) else k + 1
            self.function(p, scope, "function", name, first, exported)
            return stop
        arrow = self.arrow(k)
        if name and arrow:
            s = self.b.symbol("function", name, scope, self.span(first, stop - 1), exported, self.text[self.toks[k].start : self.toks[arrow].start])
            p = self.generics(k)
            if self.is_(p, "("):
                self.parameters(p, s.key)
            elif self.name_at(p):
                self.b.symbol("parameter", self.toks[p].text, s.key, self.span(p, p))
            if self.is_(arrow + 1, "{"):
                self.block(arrow + 2, self.match.get(arrow + 1, stop), s.key)
            else:
                self.expression(arrow + 1, stop, s.key)
            return stop
        if name:
            self.b.symbol("constant" if word == "const" else "variable", name, scope, self.span(first, stop - 1), exported)
        self.expression(v, stop, scope)
        return stop

    def arrow(self, k: int) -> int:
        """The `=>` of an arrow function that begins at k, or 0."""
        k = self.generics(k)
        if self.name_at(k) and self.is_(k + 1, "=>"):
            return k + 1
        if self.is_(k, "("):
            after = self.past(k)
            if self.is_(after, ":"):
                after = self.type_end(after + 1, "=>", ";", "{", ",", ")")
            return after if self.is_(after, "=>") else 0
        return 0

    def expression(self, i: int, end: int, scope: str) -> None:
        """Calls, references and assignments among the tokens from i to end."""
        while i < end:
            t = self.toks[i]
            if self.is_(i, "(") and self.arrow(i) and not (self.name_at(i - 1) and self.toks[i - 1].text not in CONTROL):
                if not self.is_(i + 1, ")"):
                    self.b.poison(scope, self.span(i, i))  # a lambda binds names
                i = self.arrow(i) + 1
                continue
            if t.kind != "name" or self.is_(i - 1, ".", "?."):
                if self.is_(i, "{"):
                    self.block(i + 1, self.match.get(i, end), scope, True) if self._is_block(i) else self.expression(i + 1, self.match.get(i, end), scope)
                    i = self.past(i)
                    continue
                i += 1
                continue
            word = t.text
            if word in ("function", "class"):
                self.b.poison(scope, self.span(i, i))
                while i < end and not self.is_(i, "{"):
                    i = self.past(i) if self.is_(i, "(") else i + 1
                continue
            if word in ("catch",):
                self.b.poison(scope, self.span(i, i))
            if word in CONTROL and word not in ("this", "super"):
                if word in DECLARES:
                    self.b.poison(scope, self.span(i, i))
                i += 1
                continue
            if self.is_(i + 1, "=>"):
                self.b.poison(scope, self.span(i, i))
                i += 2
                continue
            chain, k = [word], i
            while self.is_(k + 1, ".", "?.") and self.name_at(k + 2):
                chain.append(self.toks[k + 2].text)
                k += 2
            after = k + 1
            if self.is_(after, "<") and self.is_(self.generics(after), "(") and not self.is_(after + 1, "="):
                after = self.generics(after)
            receiver = ".".join(chain[:-1]) or None
            if self.is_(after, "(") and not self.is_(i - 1, "new"):
                self.b.relate("CALLS", scope, chain[-1], self.span(i, self.match.get(after, after)), receiver)
                i = after
                continue
            if len(chain) == 1 and (self.is_(after, "=", "++", "--") or (self.toks[after].kind == "mark" and len(self.toks[after].text) == 2 and self.toks[after].text[1] == "=" and self.toks[after].text[0] in "+-*/%&|^") if after < len(self.toks) else False):
                self.b.out.unsafe_names.append(word)
                self.b.diagnose("REBINDING", f"assignment to {word} makes calls of it unsafe", self.span(i, i))
                self.b.relate("REFERENCES", scope, word, self.span(i, i), unsafe=True)
            elif not self.is_(after, ":") and word not in ("this", "super"):
                self.b.relate("REFERENCES", scope, chain[-1], self.span(i, k), receiver)
            i = k + 1

    def _is_block(self, i: int) -> bool:
        return self.is_(i - 1, ")", "=>", "else", "try", "finally", "do", ";", "{", "}") and not self.is_(i - 1, "(")


def extract_script(content: bytes, path: str, language: str) -> Extracted:
    b = Builder(content, path, language)
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError as e:
        b.diagnose("SYNTAX_ERROR", str(e), None, "error")
        return b.finish()
    if text:
        s = _Script(b, text)
        s.block(0, len(s.toks), "$module")
    return b.finish()


@dataclass(frozen=True)
class Parser:
    """An adapter: what files of a language go through."""

    id: str
    version: str
    parse: Callable[[bytes, str], Extracted]


PARSERS: dict[str, Parser] = {"python": Parser("python-ast", "1", extract_python)} | {
    name: Parser("script-reader", "1", lambda content, path, name=name: extract_script(content, path, name)) for name in ("typescript", "tsx", "javascript", "jsx")
}


def parser_of(language: str, parser_id: str | None = None, version: str | None = None) -> Parser:
    """The parser of a language; a recorded one that is not at hand is an error."""
    p = PARSERS[language]
    if (parser_id or p.id, version or p.version) != (p.id, p.version):
        raise LookupError(f"parser {parser_id} {version} is not available")
    return p


def extract(content: bytes, path: str) -> Extracted:
    language = detect_language(path)
    if language is None:
        raise ValueError(f"{path} is in no known language")
    return PARSERS[language].parse(content, path)


def extract_files(files: DataFrame) -> DataFrame:
    """(project_id, path, ir) of the rows (project_id, path, content) whose language is known; ir is canonical JSON."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, f, canonical_json(extract(bytes(c), f).as_json())) for p, f, c in zip(pdf["project_id"], pdf["path"], pdf["content"], strict=True) if c is not None and detect_language(f)]
            yield pd.DataFrame(rows, columns=["project_id", "path", "ir"])

    return files.select("project_id", "path", "content").mapInPandas(run, "project_id string, path string, ir string")
