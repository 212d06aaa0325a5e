"""Command line: python -m ledgerloom.cli COMMAND ...; exit code 2 where a budget does not suffice."""

from __future__ import annotations

import argparse
import json
import os
import sys
from pathlib import Path
from typing import Any

from ledgerloom.operators.codegraph import audit
from ledgerloom.plans.engine import Engine
from ledgerloom.sources import archive
from ledgerloom.sources.store import Store

FOLDER = ".ledgerloom"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ledgerloom")
    p.add_argument("--root", default=".", help="project root")
    c = p.add_subparsers(dest="command", required=True)
    c.add_parser("init").add_argument("--name")
    for name in ("status", "handoff", "doctor", "repair"):
        c.add_parser(name)
    c.add_parser("checkpoint").add_argument("--name", default="checkpoint")
    c.add_parser("resume").add_argument("--checkpoint")
    for name in ("export", "import"):
        x = c.add_parser(name)
        x.add_argument("path")
        x.add_argument("--passphrase-env")
    c.add_parser("index").add_argument("--rebuild", action="store_true")
    s = c.add_parser("session").add_subparsers(dest="action", required=True).add_parser("start")
    for o in ("provider", "agent-name", "model-name", "external-session-id", "client-name"):
        s.add_argument(f"--{o}")
    for name in ("retrieve", "context"):
        x = c.add_parser(name)
        x.add_argument("text")
        x.add_argument("--mode", default="auto")
        x.add_argument("--limit", type=int)
        x.add_argument("--tokens", type=int, default=2000)
        x.add_argument("--file", action="append", default=[])
        x.add_argument("--symbol", action="append", default=[])
    m = c.add_parser("memory").add_subparsers(dest="action", required=True)
    a = m.add_parser("add")
    a.add_argument("--type", required=True)
    a.add_argument("--content", required=True)
    a.add_argument("--source-event", action="append", required=True)
    a = m.add_parser("list")
    a.add_argument("--type")
    a.add_argument("--status")
    a = m.add_parser("supersede")
    a.add_argument("id")
    a.add_argument("--content")
    a.add_argument("--with", dest="replacement")
    a.add_argument("--source-event", action="append", required=True)
    a = m.add_parser("resolve")
    a.add_argument("id")
    a.add_argument("--source-event", action="append", required=True)
    a = m.add_parser("link")
    a.add_argument("id")
    a.add_argument("--symbol", required=True)
    code = c.add_parser("code").add_subparsers(dest="action", required=True)
    code.add_parser("stats")
    code.add_parser("audit")
    for name in ("symbol", "callers", "callees", "imports", "source"):
        code.add_parser(name).add_argument("name")
    return p


def run(argv: list[str]) -> tuple[int, Any]:
    a = parser().parse_args(argv)
    root = Path(a.root).resolve()
    if a.command == "import":
        archive.import_project(a.path, root / FOLDER, os.environ.get(a.passphrase_env) if a.passphrase_env else None)
        return 0, {"imported": str(root)}
    store = Store(root / FOLDER)
    if a.command == "init":
        return 0, dict(zip(("project_id", "session_id"), store.initialize_project(str(root), a.name or root.name), strict=True))
    projects = store.list_projects()
    project = store.find_project(root) or (projects[0] if len(projects) == 1 else None)
    if project is None:
        return 1, {"error": "there is no project here; run init"}
    e = Engine(store, project["id"], store.state(project["id"]).active_session_id)
    return _dispatch(a, e, root)


def _dispatch(a: argparse.Namespace, e: Engine, root: Path) -> tuple[int, Any]:
    store, id_ = e.store, e.project_id
    match (a.command, getattr(a, "action", None)):
        case "status", _:
            return 0, e.status()
        case "handoff", _:
            return 0, e.handoff()
        case "doctor", _:
            out = e.doctor()
            return int(not out["healthy"]), out
        case "repair", _:
            return 0, e.repair()
        case "checkpoint", _:
            return 0, store.checkpoint(id_, a.name)
        case "resume", _:
            return 0, {"session_id": store.resume(id_, a.checkpoint)}
        case "export", _:
            archive.export_project(store, id_, a.path, os.environ.get(a.passphrase_env) if a.passphrase_env else None)
            return 0, {"exported": a.path}
        case "index", _:
            r = e.index(root, a.rebuild)
            return int(r.status != "completed"), {"run": r.id, "status": r.status, **r.payload}
        case "session", "start":
            details = {k: v for k in ("provider", "agent_name", "model_name", "external_session_id", "client_name") if (v := getattr(a, k))}
            return 0, {"session_id": store.start_session(id_, **details)}
        case "retrieve", _:
            found = e.retrieve(a.text, a.limit, mode=a.mode, budget=a.tokens, files=tuple(a.file), symbol_ids=tuple(a.symbol))
            return 0, [{"id": c.id, "name": c.name, "priority": c.priority, "relevance": c.relevance} for c in found.candidates]
        case "context", _:
            packet, _ = e.compile(a.text, limit=a.limit, mode=a.mode, budget=a.tokens, files=tuple(a.file), symbol_ids=tuple(a.symbol))
            return 2 if packet["budget_insufficient"] else 0, packet
        case "memory", "add":
            return 0, {"id": e.promote(a.type, a.content, a.source_event)}
        case "memory", "list":
            return 0, [x.__dict__ for x in e.memory().listed(a.type, a.status)]
        case "memory", "supersede":
            return 0, {"id": e.supersede(a.id, a.source_event, a.content, a.replacement)}
        case "memory", "resolve":
            e.resolve(a.id, a.source_event)
            return 0, {"id": a.id}
        case "memory", "link":
            return 0, {"id": e.link_symbol(a.id, a.symbol)}
        case "code", "stats":
            return 0, e.graph().stats()
        case "code", "audit":
            out = audit(e.graph())
            return 0, {"total": out["total"], "counts": out["counts"]}
        case "code", "source":
            return 0, {"source": e.source(a.name)[1]}
        case "code", "imports":
            return 0, [i.module for i in e.graph().imports_of(a.name)]
    g = e.graph()
    found = g.named(a.name)
    if a.action == "symbol":
        return 0, {"ambiguous": len(found) > 1, "symbols": [s.__dict__ for s in found]}
    if len(found) != 1:
        return 1, {"error": f"{a.name} names {len(found)} symbols"}
    return 0, [x.__dict__ for x in (g.callers if a.action == "callers" else g.callees)(found[0].id)]


def main() -> None:
    code, out = run(sys.argv[1:])
    print(json.dumps(out, default=lambda v: getattr(v, "__dict__", None) or list(v), indent=2))
    sys.exit(code)


if __name__ == "__main__":
    main()
