"""From extracted files to a code graph: ids, module and symbol resolution, and the audit of what is open.

A relationship becomes an edge only where exactly one target is possible; every
other one becomes a diagnostic.
"""

from __future__ import annotations

import json
import posixpath
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.canonical import canonical_json, tagged_id
from ledgerloom.operators.extract import Diagnostic, Extracted, Import, Relationship, Span, Symbol, from_json

# Endings that a module path may stand for.
SCRIPT_ENDINGS = (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs")
WRITTEN_ENDINGS = (".js", ".jsx", ".mjs", ".cjs")
# Categories of the audit.
CATEGORIES = ("parser_limitation", "re_export_resolution", "unsupported_syntax_pattern", "aliasing", "external_package", "missing_local_module", "dynamic_call", "ambiguous_local_symbol", "namespace_member_ambiguity")
DECLARATIONS = frozenset(["class", "interface", "type", "function", "method", "variable", "constant"])
SELF = ("this", "self", "cls")
DEEPEST = 64


@dataclass(frozen=True)
class CodeSymbol:
    id: str
    version_id: str
    path: str
    key: str
    kind: str
    name: str
    qualified: str
    signature: str | None
    exported: bool
    span: Span


@dataclass(frozen=True)
class CodeEdge:
    id: str
    source: str
    target: str
    kind: str
    resolution: str
    classification: str
    path: str
    start: int
    end: int


@dataclass
class CodeGraph:
    files: list[Extracted] = field(default_factory=list)
    symbols: list[CodeSymbol] = field(default_factory=list)
    edges: list[CodeEdge] = field(default_factory=list)
    imports: list[tuple[str, Import, str | None]] = field(default_factory=list)  # path, import, resolved path
    diagnostics: list[Diagnostic] = field(default_factory=list)

    def named(self, name: str) -> list[CodeSymbol]:
        """Symbols of an id, version, name or qualified name; several mean that it is ambiguous."""
        return [s for s in self.symbols if name in (s.id, s.version_id, s.name, s.qualified) and s.kind not in ("file", "module")]

    def outgoing(self, id_: str, kind: str | None = None) -> list[CodeEdge]:
        return [e for e in self.edges if e.source == id_ and kind in (None, e.kind)]

    def incoming(self, id_: str, kind: str | None = None) -> list[CodeEdge]:
        return [e for e in self.edges if e.target == id_ and kind in (None, e.kind)]

    def callers(self, id_: str) -> list[CodeEdge]:
        return self.incoming(id_, "CALLS")

    def callees(self, id_: str) -> list[CodeEdge]:
        return self.outgoing(id_, "CALLS")

    def imports_of(self, path: str) -> list[Import]:
        return [i for p, i, _ in self.imports if p == path]

    def definitions(self, path: str) -> list[CodeSymbol]:
        defined = {e.target for e in self.edges if e.kind == "DEFINES" and e.path == path}
        return [s for s in self.symbols if s.id in defined]

    def stats(self) -> dict[str, object]:
        return {
            "files": len(self.files), "symbols": len(self.symbols), "edges": len(self.edges), "languages": dict(sorted(Counter(f.language for f in self.files).items())),
            "unresolved_references": sum(d.code.startswith("UNRESOLVED_") for d in self.diagnostics),
        }


def module_candidates(path: str, language: str, module: str) -> list[str]:
    """Files that an import may mean, most direct first; none where it leaves the repository or is no local path."""
    here = posixpath.dirname(path)
    if language == "python":
        level = len(module) - len(module.lstrip("."))
        parts = [p for p in module[level:].split(".") if p]
        base = [p for p in here.split("/") if p] if level else []
        if level - 1 > len(base):
            return []
        base = base[: len(base) - (level - 1)] if level > 1 else base
        target = "/".join(base + parts)
        return [f"{target}.py", f"{target}/__init__.py"] if parts else [f"{target}/__init__.py" if target else "__init__.py"]
    if not module.startswith((".", "./", "../")):
        return []
    target = posixpath.normpath(posixpath.join(here, module))
    if target.startswith("..") or target.startswith("/"):
        return []
    target = "" if target == "." else target
    stem = next((target[: -len(e)] for e in WRITTEN_ENDINGS if target.endswith(e)), target)
    return [target, *(f"{stem}{e}" for e in SCRIPT_ENDINGS), *(posixpath.join(stem, f"index{e}") for e in SCRIPT_ENDINGS)]


def resolve_module(path: str, language: str, module: str, files: Iterable[str]) -> str | None:
    """The one file that an import means."""
    candidates = module_candidates(path, language, module)
    if candidates and language != "python" and candidates[0] in files:
        return candidates[0]
    found = [c for c in dict.fromkeys(candidates) if c in files]
    return found[0] if len(found) == 1 else None


class _Resolver:
    def __init__(self, files: list[Extracted]) -> None:
        self.files = {f.path: f for f in files}
        self.children: dict[tuple[str, str | None], list[Symbol]] = {}
        self.keys: dict[tuple[str, str], Symbol] = {}
        for f in files:
            for s in f.symbols:
                self.keys[f.path, s.key] = s
                self.children.setdefault((f.path, s.parent), []).append(s)
        self.modules = {(f.path, i.key): resolve_module(f.path, f.language, i.module, self.files) for f in files for i in f.imports}

    def bindings(self, path: str, local: str) -> list[tuple[Import, str]]:
        return [(i, imported) for i in self.files[path].imports for imported, name in i.bindings if name == local]

    def exported(self, path: str, name: str, seen: frozenset[tuple[str, str]] = frozenset()) -> tuple[str, Symbol] | None:
        """The one runtime symbol that a file exports under a name, through local names and imports."""
        f = self.files[path]
        if (path, name) in seen or len(seen) >= DEEPEST or name in f.unsafe_names:
            return None
        seen |= {(path, name)}
        direct = [s for s in self.children.get((path, "$module"), []) if s.exported and s.name == name and s.kind in DECLARATIONS]
        aliases = [a for a in f.aliases if a[0] == name]
        if len(direct) + len(aliases) != 1:
            return None
        if direct:
            return path, direct[0]
        _, local, types_only = aliases[0]
        if types_only or local in f.unsafe_names:
            return None
        here = [s for s in self.children.get((path, "$module"), []) if s.name == local and s.kind in DECLARATIONS]
        bound = self.bindings(path, local)
        if len(here) + len(bound) != 1:
            return None
        return (path, here[0]) if here else self.through(path, bound[0], seen)

    def through(self, path: str, binding: tuple[Import, str], seen: frozenset[tuple[str, str]] = frozenset(), member: str | None = None) -> tuple[str, Symbol] | None:
        i, imported = binding
        target = self.modules[path, i.key]
        local = next(name for n, name in i.bindings if n == imported)
        if i.scope != "$module" or target is None or local in i.type_only or (imported == "*") != (member is not None):
            return None
        return self.exported(target, member or imported, seen)

    def enclosing(self, path: str, key: str | None) -> Iterator[Symbol]:
        while key is not None:
            s = self.keys[path, key]
            yield s
            key = s.parent

    def resolve(self, path: str, r: Relationship) -> tuple[str, Symbol, str] | None:
        if r.unsafe:
            return None
        if r.receiver is not None and "." in r.receiver:
            return None
        first = next((s for s in self.children.get((path, r.source), []) if s.kind == "parameter"), None)
        own = r.receiver in SELF and (self.files[path].language != "python" or (first is not None and first.name == r.receiver))
        if own:
            source = self.keys[path, r.source]
            owner = self.keys[path, source.parent] if source.parent else None
            if source.kind != "method" or owner is None or owner.kind != "class":
                return None
            methods = [s for s in self.children.get((path, owner.key), []) if s.kind == "method" and s.name == r.target]
            return (path, methods[0], "RECEIVER") if len(methods) == 1 else None
        name = r.receiver or r.target
        for scope in self.enclosing(path, r.scope):
            if scope.kind == "file":
                break
            if scope.key != "$module" and any(i.scope == scope.key for i, _ in self.bindings(path, name)):
                return None
            if scope.kind in ("class", "interface"):
                continue
            held = [s for s in self.children.get((path, scope.key), []) if s.name == name and s.kind not in ("import", "export")]
            if held:
                if scope.key == "$module" and self.bindings(path, name):
                    return None
                return (path, held[0], "LEXICAL") if len(held) == 1 and r.receiver is None else None
        bound = self.bindings(path, name)
        if len(bound) != 1:
            return None
        found = self.through(path, bound[0], member=r.target if r.receiver else None)
        return (*found, "LOCAL_IMPORT") if found else None


#: Kinds that a relationship may point to.
FITS = {"CALLS": ("function", "method"), "EXTENDS": ("class", "interface"), "IMPLEMENTS": ("class", "interface")}


def assemble(project_id: str, files: Iterable[Extracted]) -> CodeGraph:
    """The graph of a project's files, the same in any order of them."""
    files = sorted(files, key=lambda f: f.path)
    g = CodeGraph(files)
    r = _Resolver(files)
    ids: dict[tuple[str, str], str] = {}
    for f in files:
        for s in f.symbols:
            ids[f.path, s.key] = tagged_id("symbol:v1", project_id, f.path, f.language, s.kind, s.qualified, s.discriminator)
            version = tagged_id("symbol-version:v1", ids[f.path, s.key], f.content_hash, s.span.start, s.span.end)
            g.symbols.append(CodeSymbol(ids[f.path, s.key], version, f.path, s.key, s.kind, s.name, s.qualified, s.signature, s.exported, s.span))
    edges: dict[str, CodeEdge] = {}

    def edge(source: str, target: str, kind: str, resolution: str, path: str, span: Span) -> None:
        classification = "EXTRACTED" if resolution == "SYNTACTIC" else "RESOLVED"
        id_ = tagged_id("edge:v1", project_id, source, target, kind, resolution, classification, path, span.content_hash, span.start, span.end)
        edges[id_] = CodeEdge(id_, source, target, kind, resolution, classification, path, span.start, span.end)

    for f in files:
        file_id, module_id = ids[f.path, "$file"], ids[f.path, "$module"]
        for s in f.symbols:
            if s.parent is not None:
                edge(ids[f.path, s.parent], ids[f.path, s.key], "CONTAINS", "SYNTACTIC", f.path, s.span)
            if s.kind in DECLARATIONS:
                edge(file_id, ids[f.path, s.key], "DEFINES", "SYNTACTIC", f.path, s.span)
                if s.exported:
                    edge(module_id, ids[f.path, s.key], "EXPORTS", "SYNTACTIC", f.path, s.span)
        for i in f.imports:
            target = r.modules[f.path, i.key]
            g.imports.append((f.path, i, target))
            if target is None:
                g.diagnostics.append(Diagnostic("UNRESOLVED_IMPORT", f"external, missing or ambiguous import {i.module}", f.path, "warning", i.span))
            else:
                edge(file_id, ids[target, "$file"], "IMPORTS", "LOCAL_IMPORT", f.path, i.span)
        for x in f.relationships:
            found = r.resolve(f.path, x)
            if found and (x.kind not in FITS or found[1].kind in FITS[x.kind]):
                edge(ids[f.path, x.source], ids[found[0], found[1].key], x.kind, found[2], f.path, x.span)
            else:
                g.diagnostics.append(Diagnostic(f"UNRESOLVED_{x.kind}", f"unresolved or ambiguous {x.receiver + '.' if x.receiver else ''}{x.target}", f.path, "warning", x.span))
        g.diagnostics += f.diagnostics
    g.symbols.sort(key=lambda s: s.id)
    g.edges = [edges[k] for k in sorted(edges)]
    g.imports.sort(key=lambda x: (x[0], x[1].key))
    g.diagnostics.sort(key=lambda d: (d.path, d.span.start if d.span else -1, d.code, d.message))
    return g


def audit(g: CodeGraph) -> dict[str, object]:
    """Why each open diagnostic is open: total, counts of all categories, and the category of each."""
    files = {f.path: f for f in g.files}
    resolved = {(p, i.key): target for p, i, target in g.imports}

    def category(d: Diagnostic) -> str:
        f = files.get(d.path)
        if f is None:
            return "parser_limitation"
        if d.code == "UNRESOLVED_EXPORT":
            return "re_export_resolution"
        if d.code.startswith("UNSUPPORTED_"):
            return "unsupported_syntax_pattern"
        r = next((x for x in f.relationships if x.span == d.span and d.code == f"UNRESOLVED_{x.kind}"), None)
        name = None if r is None else r.receiver or r.target
        involved = [i for i in f.imports if (i.span == d.span if r is None else any(local == name for _, local in i.bindings))]
        if any(i.module.startswith("#") for i in involved):
            return "aliasing"
        if f.language != "python" and any(not i.module.startswith(".") for i in involved):
            return "external_package"
        if d.code == "UNRESOLVED_IMPORT":
            return "missing_local_module"
        if r is None:
            return "parser_limitation"
        if r.unsafe:
            return "dynamic_call"
        for i in involved:
            target = resolved.get((f.path, i.key))
            imported = next(a for a, local in i.bindings if local == name)
            wanted = r.target if imported == "*" else imported
            if target and sum(s.exported and s.name == wanted and s.parent == "$module" for s in files[target].symbols) > 1:
                return "ambiguous_local_symbol"
        if any(resolved.get((f.path, i.key)) for i in involved):
            return "namespace_member_ambiguity" if r.receiver else "re_export_resolution"
        if r.receiver:
            return "namespace_member_ambiguity"
        if sum(s.name == r.target and s.kind in DECLARATIONS for s in f.symbols) > 1:
            return "ambiguous_local_symbol"
        return "dynamic_call" if r.kind == "CALLS" else "parser_limitation"

    open_ = [d for d in g.diagnostics if d.code.startswith(("UNRESOLVED_", "UNSUPPORTED_", "SYNTAX_ERROR"))]
    kinds = [category(d) for d in open_]
    counts = Counter(kinds)
    return {"total": len(open_), "counts": {c: counts.get(c, 0) for c in CATEGORIES}, "diagnostics": list(zip(open_, kinds, strict=True))}


def overloads(symbols: DataFrame, identity: list[str], order: str) -> DataFrame:
    """Symbols with n_same (symbols of the same identity) and ordinal (the place among them, from 0)."""
    same = Window.partitionBy(*identity)
    return symbols.withColumn("n_same", F.count("*").over(same)).withColumn("ordinal", (F.row_number().over(same.orderBy(order)) - 1).cast("long"))


SYMBOLS = "project_id string, id string, version_id string, path string, kind string, name string, qualified string, exported boolean, start long, end long"
EDGES = "project_id string, id string, source string, target string, kind string, resolution string, path string, start long, end long"


def assembled(irs: DataFrame, what: str) -> DataFrame:
    """Symbols or edges of all projects from (project_id, path, ir); one project's graph is assembled in one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        project = pdf["project_id"].iloc[0]
        g = assemble(project, [from_json(json.loads(x)) for x in pdf["ir"]])
        if what == "symbols":
            rows = [(project, s.id, s.version_id, s.path, s.kind, s.name, s.qualified, s.exported, s.span.start, s.span.end) for s in g.symbols]
        else:
            rows = [(project, e.id, e.source, e.target, e.kind, e.resolution, e.path, e.start, e.end) for e in g.edges]
        names = [c.strip().split(" ")[0] for c in (SYMBOLS if what == "symbols" else EDGES).split(",")]
        return pd.DataFrame(rows, columns=names)

    return irs.groupBy("project_id").applyInPandas(run, SYMBOLS if what == "symbols" else EDGES)


def graph_digest(g: CodeGraph) -> str:
    """One hash for a graph, to compare a rebuilt one with the one at hand."""
    from ledgerloom.functions.canonical import sha256

    return sha256(canonical_json([[s.version_id for s in g.symbols], [e.id for e in g.edges], [[d.code, d.path, d.message] for d in g.diagnostics]]))
