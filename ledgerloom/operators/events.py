"""Event envelopes: payload schemas, identity, and the fold of a history into project state."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.canonical import MAX_SAFE, canonical_json, canonical_text, content_hash, event_id, event_id_column

EVENT = T.StructType([T.StructField(n, T.LongType() if n == "sequence" else T.StringType(), False) for n in ("id", "project_id", "session_id", "sequence", "event_type", "payload", "created_at", "content_hash")])
UNSIGNED = ("created_at", "event_type", "payload", "project_id", "sequence", "session_id")
HASH, UUID = re.compile(r"[0-9a-f]{64}"), re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")


class EventError(ValueError):
    """An event that is malformed, forged or out of place."""


Check = Callable[[Any], bool]


def is_text(v: Any) -> bool:
    return isinstance(v, str)


def is_filled(v: Any) -> bool:
    return isinstance(v, str) and bool(v.strip())


def is_map(v: Any) -> bool:
    return isinstance(v, dict)


def is_hash(v: Any) -> bool:
    return isinstance(v, str) and HASH.fullmatch(v) is not None


def is_uuid(v: Any) -> bool:
    return isinstance(v, str) and UUID.fullmatch(v) is not None


def is_count(v: Any) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and 0 <= v <= MAX_SAFE


def is_integer(v: Any) -> bool:
    return isinstance(v, int) and not isinstance(v, bool) and abs(v) <= MAX_SAFE


def is_any(v: Any) -> bool:
    canonical_json(v)
    return True


def is_hashes(v: Any) -> bool:
    return isinstance(v, list) and bool(v) and all(map(is_hash, v)) and len(set(v)) == len(v)


def is_time(v: Any) -> bool:
    """ISO 8601 in UTC with milliseconds, which is its own round trip."""
    try:
        return isinstance(v, str) and iso(datetime.strptime(v, "%Y-%m-%dT%H:%M:%S.%fZ").replace(tzinfo=UTC)) == v
    except ValueError:
        return False


def iso(t: datetime) -> str:
    return t.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


def one_of(*values: str) -> Check:
    return lambda v: v in values


# Entity types, statuses and relations of memory.
ENTITY_TYPES = ("goal", "task", "decision", "constraint", "blocker", "question", "action", "result", "artifact")
STATUSES = ("active", "in_progress", "completed", "resolved", "cancelled", "superseded")
RELATIONS = ("PART_OF", "DEPENDS_ON", "BLOCKS", "RESOLVES", "PRODUCED", "VERIFIED_BY", "SUPERSEDES", "RELATED_TO")
# Languages of source files.
SOURCE_LANGUAGES = ("typescript", "tsx", "javascript", "jsx", "python")

_SESSION = {"provider?": is_text, "agent_name?": is_text, "model_name?": is_text, "external_session_id?": is_text, "client_name?": is_text}
_FINISHED = {"index_run_id": is_uuid, "completed_at": is_time, "files_seen": is_count, "files_changed": is_count, "files_unchanged": is_count, "files_deleted": is_count, "parse_errors": is_count, "errors": lambda v: isinstance(v, list), "metrics": is_map}
#: Fields of the payload of each event type; a question mark ends the name of an optional one.
PAYLOADS: dict[str, dict[str, Check]] = {
    "project.created": {"name": lambda v: is_text(v) and v == v.strip() and 1 <= len(v) <= 200, "root_path": is_filled},
    "session.started": _SESSION,
    "session.resumed": {**_SESSION, "checkpoint_id": is_hash},
    "checkpoint.created": {"name": is_filled, "through_sequence": is_count, "state_hash": is_hash},
    "conversation.user_message": {"content": is_text, "metadata?": is_map},
    "conversation.assistant_message": {"content": is_text, "metadata?": is_map},
    "tool.call": {"call_id": is_filled, "tool_name": is_filled, "input": is_any},
    "tool.result": {"call_id": is_filled, "output": is_any, "is_error?": lambda v: isinstance(v, bool)},
    "command.executed": {"command_id": is_filled, "command": is_filled, "cwd?": is_text},
    "command.result": {"command_id": is_filled, "exit_code": is_integer, "stdout": is_text, "stderr": is_text},
    "file.changed": {"path": is_filled, "change_type": one_of("added", "modified", "deleted"), "before_hash?": is_hash, "after_hash?": is_hash, "diff?": is_text},
    "test.result": {"status": one_of("passed", "failed", "skipped"), "summary": is_text, "command?": is_text, "metadata?": is_map},
    "memory.entity.created": {"entity_id": is_hash, "entity_type": one_of(*ENTITY_TYPES), "content": is_filled, "source_event_ids": is_hashes, "metadata": is_map},
    "memory.entity.status_changed": {"entity_id": is_hash, "status": one_of(*STATUSES[:5]), "source_event_ids": is_hashes},
    "memory.entity.superseded": {"entity_id": is_hash, "replacement_id": is_hash, "source_event_ids": is_hashes},
    "memory.entity.linked": {"relation_id": is_hash, "from_entity_id": is_hash, "to_entity_id": is_hash, "relation_type": one_of(*RELATIONS), "source_event_ids": is_hashes, "metadata": is_map},
    "code.index.started": {"index_run_id": is_uuid, "root_path": is_filled, "started_at": is_time},
    "code.file.observed": {"index_run_id": is_uuid, "path": is_filled, "language": one_of(*SOURCE_LANGUAGES), "content_hash": is_hash, "byte_length": is_count, "parser_id": is_filled, "parser_version": is_filled, "observed_at": is_time, "git?": is_map},
    "code.file.deleted": {"index_run_id": is_uuid, "path": is_filled, "previous_content_hash": is_hash, "observed_at": is_time},
    "code.index.completed": _FINISHED,
    "code.index.failed": _FINISHED,
}
SOURCE_TYPES = tuple(t for t in PAYLOADS if t.split(".")[0] in ("conversation", "tool", "command", "file", "test"))
_EXTENSIONS: dict[str, dict[str, Check]] = {}


def register_payload(event_type: str, fields: dict[str, Check]) -> None:
    """Add an event type; a type that exists must have the very same fields."""
    known = PAYLOADS.get(event_type) or _EXTENSIONS.get(event_type)
    if known is not None and known is not fields:
        raise EventError(f"{event_type} is registered otherwise")
    _EXTENSIONS[event_type] = fields


def check_payload(event_type: str, payload: Any) -> None:
    """Raise EventError unless the payload has exactly the fields of its type."""
    fields = PAYLOADS.get(event_type) or _EXTENSIONS.get(event_type)
    if fields is None:
        raise EventError(f"unknown event type {event_type}")
    if not isinstance(payload, dict):
        raise EventError("payload is not an object")
    names = {n.rstrip("?") for n in fields}
    missing = [n for n in fields if not n.endswith("?") and n not in payload]
    if missing or set(payload) - names:
        raise EventError(f"{event_type}: fields {sorted(missing + list(set(payload) - names))}")
    for n, check in fields.items():
        if n.rstrip("?") in payload and not check(payload[n.rstrip("?")]):
            raise EventError(f"{event_type}: {n} has the value {payload[n.rstrip('?')]!r}")


def create_event(project_id: str, session_id: str, sequence: int, event_type: str, payload: Any, created_at: str) -> dict[str, Any]:
    """An event with its hash and id; the payload is an object here and canonical text at rest."""
    unsigned = {"project_id": project_id, "session_id": session_id, "sequence": sequence, "event_type": event_type, "payload": payload, "created_at": created_at}
    if not is_uuid(project_id) or not is_uuid(session_id):
        raise EventError("project and session are UUIDs")
    if not is_count(sequence) or sequence < 1:
        raise EventError("a sequence is at least 1")
    if not is_time(created_at):
        raise EventError("created_at is not an ISO time in milliseconds")
    check_payload(event_type, payload)
    hash_ = content_hash(unsigned)
    return {**unsigned, "content_hash": hash_, "id": event_id(hash_)}


def verify_event(event: Mapping[str, Any]) -> None:
    again = create_event(*(event[k] for k in ("project_id", "session_id", "sequence", "event_type", "payload", "created_at")))
    if set(event) != set(again) or again["id"] != event["id"] or again["content_hash"] != event["content_hash"]:
        raise EventError("identity does not match the content")


@dataclass
class ProjectState:
    """What a history says about its project."""

    project: dict[str, Any] | None = None
    sessions: tuple[dict[str, Any], ...] = ()
    checkpoints: tuple[dict[str, Any], ...] = ()
    active_session_id: str | None = None
    last_sequence: int = 0

    def as_json(self) -> dict[str, Any]:
        return {"project": self.project, "sessions": list(self.sessions), "checkpoints": list(self.checkpoints), "active_session_id": self.active_session_id, "last_sequence": self.last_sequence}

    @property
    def hash(self) -> str:
        return content_hash(self.as_json())


def apply_event(state: ProjectState, event: Mapping[str, Any]) -> ProjectState:
    """The state after one more event, which must be the next one and in place."""
    verify_event(event)
    kind, payload, session = event["event_type"], event["payload"], event["session_id"]
    if event["sequence"] != state.last_sequence + 1:
        raise EventError("the sequence has a gap")
    if (state.project is None) != (kind == "project.created"):
        raise EventError("a history begins with its project, once")
    if state.project is not None and event["project_id"] != state.project["id"]:
        raise EventError("the event is of another project")
    out = ProjectState(state.project, state.sessions, state.checkpoints, state.active_session_id, event["sequence"])
    if kind == "project.created":
        out.project = {"id": event["project_id"], "name": payload["name"], "root_path": payload["root_path"], "created_at": event["created_at"]}
    elif kind in ("session.started", "session.resumed"):
        if any(s["id"] == session for s in state.sessions):
            raise EventError("the session exists")
        if kind == "session.resumed" and not any(c["id"] == payload["checkpoint_id"] for c in state.checkpoints):
            raise EventError("the checkpoint does not exist")
        out.sessions = (*state.sessions, {"id": session, "started_at": event["created_at"], "sequence": event["sequence"], "details": payload})
        out.active_session_id = session
    else:
        if session != state.active_session_id:
            raise EventError("the session is not active")
        if kind == "checkpoint.created":
            if payload["through_sequence"] != state.last_sequence or payload["state_hash"] != state.hash:
                raise EventError("the checkpoint is not of this state")
            out.checkpoints = (*state.checkpoints, {"id": event["id"], "name": payload["name"], "through_sequence": payload["through_sequence"], "state_hash": payload["state_hash"], "created_at": event["created_at"]})
    return out


def reconstruct(events: Iterable[Mapping[str, Any]]) -> ProjectState:
    state = ProjectState()
    for e in events:
        state = apply_event(state, e)
    return state


def verified(events: DataFrame) -> DataFrame:
    """Events with `valid`: the stored payload is canonical, and hash and id follow from the content.

    The text of an envelope is put together in the JVM; only the payload, whose
    canonical form needs a parser, goes through an Arrow batch.
    """
    canonical = canonical_text("payload")

    def text(name: str):
        return F.concat(F.lit(f'"{name}":"'), F.col(name), F.lit('"'))

    envelope = F.concat(F.lit("{"), text("created_at"), F.lit(","), text("event_type"), F.lit(',"payload":'), F.col("payload"), F.lit(","), text("project_id"), F.lit(',"sequence":'), F.col("sequence").cast("string"), F.lit(","), text("session_id"), F.lit("}"))
    hash_ = F.sha2(envelope, 256)
    plain = F.concat("created_at", "event_type", "project_id", "session_id").rlike(r"^[A-Za-z0-9.:_-]*$")
    return events.withColumn("valid", F.coalesce(plain & (canonical == F.col("payload")) & (hash_ == F.col("content_hash")) & (event_id_column(F.col("content_hash")) == F.col("id")), F.lit(False)))


STATE = "project_id string, last_sequence long, active_session_id string, n_sessions long, n_checkpoints long, state_hash string, error string"


def fold_projects(events: DataFrame) -> DataFrame:
    """The state of each project, by an ordered fold: a checkpoint hashes the whole state before it.

    One history goes to one task; the state is small beside it.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        state, error = ProjectState(), None
        for r in pdf.sort_values("sequence").to_dict("records"):
            try:
                state = apply_event(state, {**r, "sequence": int(r["sequence"]), "payload": json.loads(r["payload"])})
            except EventError as e:
                error = f"{int(r['sequence'])}: {e}"
                break
        row = (pdf["project_id"].iloc[0], state.last_sequence, state.active_session_id, len(state.sessions), len(state.checkpoints), state.hash, error)
        return pd.DataFrame([row], columns=[c.split(" ")[0] for c in STATE.split(", ")])

    return events.groupBy("project_id").applyInPandas(fold, STATE)
