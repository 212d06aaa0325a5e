"""The tool interface of a project: named calls with closed arguments, and resources; no transport."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from ledgerloom.operators.events import ENTITY_TYPES, RELATIONS, EventError
from ledgerloom.plans.engine import Engine

QUERY = {"text": str, "mode?": str, "budget?": int, "symbol_ids?": list, "memory_ids?": list, "files?": list, "historical?": bool}
#: Arguments of each tool; a question mark ends the name of an optional one.
TOOLS: dict[str, dict[str, type]] = {
    "status": {}, "handoff": {}, "context": QUERY, "retrieve": {**QUERY, "limit?": int}, "find_symbol": {"query": str}, "get_source": {"symbol_id": str}, "callers": {"symbol_id": str}, "callees": {"symbol_id": str},
    "impact": {"symbol_id": str, "query?": str, "limit?": int}, "checkpoint": {"name?": str}, "record_event": {"event_type": str, "payload": dict},
    "add_memory": {"entity_type": str, "content": str, "source_event_ids": list}, "link_memory": {"from_memory_id": str, "to_memory_id": str, "relation_type": str, "source_event_ids": list},
}
WRITES = frozenset(["checkpoint", "record_event", "add_memory", "link_memory"])
RESOURCES = ("project/status", "project/handoff", "memory/current")


class Tools:
    def __init__(self, engine: Engine) -> None:
        self.engine = engine

    def call(self, name: str, **arguments: Any) -> Any:
        fields = TOOLS.get(name)
        if fields is None:
            raise EventError(f"there is no tool {name}")
        names = {n.rstrip("?"): t for n, t in fields.items()}
        missing = [n for n in fields if not n.endswith("?") and n not in arguments]
        wrong = [n for n, v in arguments.items() if n not in names or not isinstance(v, names[n])]
        if missing or wrong:
            raise EventError(f"{name}: {sorted(missing + wrong)}")
        return getattr(self, f"_{name}")(**arguments)

    def resource(self, uri: str) -> Any:
        reads: dict[str, Callable[[], Any]] = {"project/status": self.engine.status, "project/handoff": self.engine.handoff, "memory/current": lambda: [e.__dict__ for e in self.engine.memory().entities.values() if e.valid_to is None]}
        if uri not in reads:
            raise EventError(f"there is no resource {uri}")
        return reads[uri]()

    def _status(self) -> Any:
        return self.engine.status()

    def _handoff(self) -> Any:
        return self.engine.handoff()

    def _context(self, **q: Any) -> Any:
        return self.engine.compile(**_query(q))[0]

    def _retrieve(self, **q: Any) -> Any:
        found = self.engine.retrieve(**_query(q))
        return {"candidates": [{"id": c.id, "kind": c.kind, "name": c.name, "priority": c.priority, "relevance": c.relevance, "rankings": c.rankings} for c in found.candidates], "diagnostics": found.diagnostics}

    def _find_symbol(self, query: str) -> Any:
        found = self.engine.graph().named(query)
        return {"ambiguous": len(found) > 1, "symbols": [s.__dict__ | {"span": s.span.__dict__} for s in found]}

    def _get_source(self, symbol_id: str) -> Any:
        s, text = self.engine.source(symbol_id)
        return {"path": s.path, "qualified": s.qualified, "source": text}

    def _one(self, symbol_id: str) -> str:
        found = self.engine.graph().named(symbol_id)
        if len(found) != 1:
            raise EventError(f"{symbol_id} names {len(found)} symbols")
        return found[0].id

    def _callers(self, symbol_id: str) -> Any:
        return [e.__dict__ for e in self.engine.graph().callers(self._one(symbol_id))]

    def _callees(self, symbol_id: str) -> Any:
        return [e.__dict__ for e in self.engine.graph().callees(self._one(symbol_id))]

    def _impact(self, symbol_id: str, query: str | None = None, limit: int | None = None) -> Any:
        id_ = self._one(symbol_id)
        return self._retrieve(text=query or "impact", mode="impact", symbol_ids=[id_], **({"limit": limit} if limit else {}))

    def _checkpoint(self, name: str = "checkpoint") -> Any:
        return self.engine.store.checkpoint(self.engine.project_id, name)

    def _record_event(self, event_type: str, payload: dict[str, Any]) -> Any:
        return self.engine.record(event_type, payload)

    def _add_memory(self, entity_type: str, content: str, source_event_ids: list[str]) -> Any:
        if entity_type not in ENTITY_TYPES:
            raise EventError(f"unknown type {entity_type}")
        return {"id": self.engine.promote(entity_type, content, source_event_ids)}

    def _link_memory(self, from_memory_id: str, to_memory_id: str, relation_type: str, source_event_ids: list[str]) -> Any:
        if relation_type not in RELATIONS:
            raise EventError(f"unknown relation {relation_type}")
        return {"id": self.engine.link(from_memory_id, to_memory_id, relation_type, source_event_ids)}


def _query(q: dict[str, Any]) -> dict[str, Any]:
    return {k: tuple(v) if isinstance(v, list) else v for k, v in q.items()}
