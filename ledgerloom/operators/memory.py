"""Temporal memory: entities and relations from events, and the handoff of what is current."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.canonical import MAX_SAFE, tagged_id
from ledgerloom.operators.events import EventError, ProjectState
from ledgerloom.operators.history import check_transition

RECENT_RESULTS = 20


@dataclass(frozen=True)
class Entity:
    id: str
    project_id: str
    entity_type: str
    content: str
    status: str
    created_at: str
    source_event_ids: tuple[str, ...]
    session_id: str
    valid_from: int
    valid_to: int | None = None
    superseded_by: str | None = None
    metadata: Mapping[str, Any] = field(default_factory=dict)

    @property
    def current(self) -> bool:
        """Open, and either under way or a result."""
        return self.valid_to is None and (self.status in ("active", "in_progress") or self.entity_type == "result")


@dataclass(frozen=True)
class Relation:
    id: str
    project_id: str
    source: str
    target: str
    kind: str
    source_event_ids: tuple[str, ...]
    created_at: str
    session_id: str
    valid_from: int
    valid_to: int | None = None
    metadata: Mapping[str, Any] = field(default_factory=dict)


@dataclass
class Memory:
    entities: dict[str, Entity] = field(default_factory=dict)  # in order of creation
    relations: dict[str, Relation] = field(default_factory=dict)

    def listed(self, entity_type: str | None = None, status: str | None = None) -> list[Entity]:
        return [e for e in self.entities.values() if entity_type in (None, e.entity_type) and status in (None, e.status)]


def entity_id(project_id: str, entity_type: str, content: str, sources: Iterable[str], metadata: Mapping[str, Any]) -> str:
    return tagged_id("memory-entity:v1", project_id, entity_type, content, sorted(set(sources)), dict(metadata))


def relation_id(project_id: str, source: str, target: str, kind: str, sources: Iterable[str], metadata: Mapping[str, Any]) -> str:
    return tagged_id("memory-relation:v1", project_id, source, target, kind, sorted(set(sources)), dict(metadata))


def _merged(*ids: Iterable[str]) -> tuple[str, ...]:
    return tuple(sorted({i for some in ids for i in some}))


def replay(events: Iterable[Mapping[str, Any]], through: int = MAX_SAFE) -> Memory:
    """Memory after the events up to a sequence; an event that breaks a rule is an EventError."""
    m = Memory()
    seen: set[str] = set()

    def entity(id_: str) -> Entity:
        if id_ not in m.entities:
            raise EventError(f"entity {id_} does not exist")
        return m.entities[id_]

    def supersede(old_id: str, new_id: str, e: Mapping[str, Any], given: Iterable[str]) -> None:
        old, new = entity(old_id), entity(new_id)
        if old.id == new.id or old.valid_to is not None or new.status != "active" or old.entity_type != new.entity_type:
            raise EventError("this entity cannot be superseded by that one")
        m.entities[old.id] = replace(old, status="superseded", valid_to=e["sequence"], superseded_by=new.id, source_event_ids=_merged(old.source_event_ids, given, [e["id"]]))
        m.entities[new.id] = replace(new, source_event_ids=_merged(new.source_event_ids, given, [e["id"]]))

    for e in events:
        if e["sequence"] > through:
            break
        p, kind = e["payload"], e["event_type"]
        if kind.startswith("memory."):
            given = p["source_event_ids"]
            if any(s not in seen for s in given):
                raise EventError("a source is not an earlier event of the project")
            sources = _merged(given, [e["id"]])
            if kind == "memory.entity.created":
                if p["entity_id"] != entity_id(e["project_id"], p["entity_type"], p["content"], given, p["metadata"]) or p["entity_id"] in m.entities:
                    raise EventError("the entity's id is wrong or taken")
                m.entities[p["entity_id"]] = Entity(p["entity_id"], e["project_id"], p["entity_type"], p["content"], "active", e["created_at"], sources, e["session_id"], e["sequence"], metadata=p["metadata"])
            elif kind == "memory.entity.status_changed":
                old = entity(p["entity_id"])
                if not check_transition(old.entity_type, old.status, p["status"]):
                    raise EventError(f"{old.entity_type} does not go from {old.status} to {p['status']}")
                m.entities[old.id] = replace(old, status=p["status"], valid_to=e["sequence"] if p["status"] == "cancelled" else None, source_event_ids=_merged(old.source_event_ids, sources))
            elif kind == "memory.entity.superseded":
                supersede(p["entity_id"], p["replacement_id"], e, given)
                derived = tagged_id("supersedes:v1", e["id"])
                m.relations[derived] = Relation(derived, e["project_id"], p["replacement_id"], p["entity_id"], "SUPERSEDES", sources, e["created_at"], e["session_id"], e["sequence"])
            elif kind == "memory.entity.linked":
                a, b = entity(p["from_entity_id"]), entity(p["to_entity_id"])
                wanted = relation_id(e["project_id"], a.id, b.id, p["relation_type"], given, p["metadata"])
                if a.id == b.id or p["relation_id"] != wanted or wanted in m.relations:
                    raise EventError("the relation is a loop, or its id is wrong or taken")
                if p["relation_type"] == "SUPERSEDES":
                    supersede(b.id, a.id, e, given)
                m.relations[wanted] = Relation(wanted, e["project_id"], a.id, b.id, p["relation_type"], sources, e["created_at"], e["session_id"], e["sequence"], metadata=p["metadata"])
        seen.add(e["id"])
    return m


def resolution_status(entity_type: str) -> str:
    if entity_type in ("goal", "task", "action"):
        return "completed"
    if entity_type in ("blocker", "question"):
        return "resolved"
    raise EventError(f"{entity_type} is never resolved")


def _shown(x: Entity | Relation) -> dict[str, Any]:
    out = {k: list(v) if isinstance(v, tuple) else dict(v) if isinstance(v, Mapping) else v for k, v in x.__dict__.items()}
    return out


def handoff(state: ProjectState, memory: Memory, events: list[Mapping[str, Any]]) -> dict[str, Any]:
    """What the next session needs: current memory by group, history, and all evidence it rests on."""
    open_ = [e for e in memory.entities.values() if e.valid_to is None]

    def of(kind: str, *statuses: str) -> list[Entity]:
        return [e for e in open_ if e.entity_type == kind and (not statuses or e.status in statuses)]

    groups = {
        "goals": of("goal"), "active_tasks": of("task", "active", "in_progress"), "completed_tasks": of("task", "completed"), "decisions": of("decision", "active"), "constraints": of("constraint", "active"),
        "blockers": of("blocker", "active"), "open_questions": of("question", "active"), "actions": of("action"), "recent_results": of("result")[-RECENT_RESULTS:][::-1], "artifacts": of("artifact"),
    }
    included = {e.id for group in groups.values() for e in group}
    by_id = {e["id"]: e for e in events}
    starts = {e["session_id"]: e["id"] for e in events if e["event_type"] in ("session.started", "session.resumed")}
    todo = [i for x in (*memory.entities.values(), *memory.relations.values()) for i in x.source_event_ids]
    todo += [e["id"] for e in events if e["event_type"] == "project.created"] + [starts[state.active_session_id]] * (state.active_session_id in starts)
    closed: set[str] = set()
    while todo:
        id_ = todo.pop()
        if id_ in closed:
            continue
        closed.add(id_)
        e = by_id[id_]
        if e["event_type"].startswith("memory."):
            todo += e["payload"]["source_event_ids"]
        if e["session_id"] in starts:
            todo.append(starts[e["session_id"]])
    return {
        "project": state.project, "session_id": state.active_session_id, "generated_at": events[-1]["created_at"] if events else None,
        **{name: [_shown(e) for e in group] for name, group in groups.items()},
        "history": [_shown(e) for e in memory.entities.values() if e.id not in included], "relations": [_shown(r) for r in memory.relations.values()],
        "evidence": [dict(e) for e in sorted((by_id[i] for i in closed), key=lambda e: e["sequence"])],
        "source_range": {"first": events[0]["sequence"], "last": events[-1]["sequence"]} if events else None,
    }


def handoff_group(kind: Column, status: Column, open_: Column) -> Column:
    """The group of a handoff that a memory goes to; what is closed, or of no group, is history."""
    groups = {
        "goals": kind == "goal", "active_tasks": (kind == "task") & status.isin("active", "in_progress"), "completed_tasks": (kind == "task") & (status == "completed"), "decisions": (kind == "decision") & (status == "active"),
        "constraints": (kind == "constraint") & (status == "active"), "blockers": (kind == "blocker") & (status == "active"), "open_questions": (kind == "question") & (status == "active"), "actions": kind == "action", "recent_results": kind == "result", "artifacts": kind == "artifact",
    }
    found = F.when(~open_, "history")
    for name, fits in groups.items():
        found = found.when(fits, name)
    return found.otherwise("history")


ENTITIES = "project_id string, id string, entity_type string, content string, status string, valid_from long, valid_to long, superseded_by string, source_event_ids array<string>"


def memory_of(events: DataFrame, through: int = MAX_SAFE) -> DataFrame:
    """Entities of all projects, validated: one project's memory events are folded in order, in one task."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = ({**r, "payload": json.loads(r["payload"])} for r in pdf.sort_values("sequence").to_dict("records"))
        m = replay(rows, through)
        out = [(e.project_id, e.id, e.entity_type, e.content, e.status, e.valid_from, e.valid_to, e.superseded_by, list(e.source_event_ids)) for e in m.entities.values()]
        return pd.DataFrame(out, columns=[c.split(" ")[0] for c in ENTITIES.split(", ")]).astype({"valid_to": "Int64"})

    return events.where(F.col("sequence") <= through).groupBy("project_id").applyInPandas(fold, ENTITIES)


def current_memory(events: DataFrame, through: int = MAX_SAFE) -> DataFrame:
    """(project_id, id, entity_type, content, status, valid_from, valid_to), without a fold, for valid histories.

    The last status by sequence wins; cancelled and superseded ones are closed
    where that happened.
    """
    schema = "entity_id string, entity_type string, content string, status string, replacement_id string, from_entity_id string, to_entity_id string, relation_type string"
    parsed = events.where((F.col("sequence") <= through) & F.col("event_type").startswith("memory.entity.")).select("project_id", "sequence", "event_type", F.from_json("payload", schema).alias("p"))
    kind = F.col("event_type")
    superseding = (kind == "memory.entity.linked") & (F.col("p.relation_type") == "SUPERSEDES")
    target = F.when(superseding, F.col("p.to_entity_id")).otherwise(F.col("p.entity_id"))
    status = F.when(kind == "memory.entity.created", "active").when(kind == "memory.entity.status_changed", F.col("p.status")).when(superseding | (kind == "memory.entity.superseded"), "superseded")
    steps = parsed.select("project_id", "sequence", target.alias("id"), status.alias("status"), "p.entity_type", "p.content").where("status is not null")
    made = F.col("entity_type").isNotNull()
    out = steps.groupBy("project_id", "id").agg(
        F.first(F.when(made, F.col("entity_type")), ignorenulls=True).alias("entity_type"), F.first(F.when(made, F.col("content")), ignorenulls=True).alias("content"),
        F.max_by("status", "sequence").alias("status"), F.min(F.when(made, F.col("sequence"))).alias("valid_from"), F.min(F.when(F.col("status").isin("cancelled", "superseded"), F.col("sequence"))).alias("valid_to"),
    )
    return out


def latest_results(entities: DataFrame, n: int = RECENT_RESULTS) -> DataFrame:
    newest = Window.partitionBy("project_id").orderBy(F.col("valid_from").desc(), "id")
    return entities.where("entity_type = 'result' and valid_to is null").withColumn("place", F.row_number().over(newest)).where(F.col("place") <= n)


def iterate(events: DataFrame, project_id: str) -> Iterator[dict[str, Any]]:
    """The events of one project in order, payloads parsed."""
    for r in events.where(F.col("project_id") == project_id).orderBy("sequence").toLocalIterator():
        yield {**r.asDict(), "payload": json.loads(r["payload"])}
