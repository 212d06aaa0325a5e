import json

import pytest

from ledgerloom.functions.canonical import canonical_json
from ledgerloom.operators import history
from ledgerloom.operators.events import EVENT, PAYLOADS, EventError, apply_event, check_payload, create_event, fold_projects, reconstruct, register_payload, verified, verify_event
from pyspark.sql import functions as F

P, S = "11111111-1111-4111-8111-111111111111", "22222222-2222-4222-8222-222222222222"
T = "2024-01-02T03:04:05.006Z"


def history_of(n=0):
    out = [create_event(P, S, 1, "project.created", {"name": "Demo", "root_path": "/r"}, T), create_event(P, S, 2, "session.started", {}, T)]
    for k in range(n):
        out.append(create_event(P, S, 3 + k, "conversation.user_message", {"content": f"m{k}"}, T))
    return out


def test_fold_and_checkpoint():
    h = history_of(2)
    s = reconstruct(h)
    assert (s.last_sequence, s.active_session_id, s.project["name"]) == (4, S, "Demo")
    c = create_event(P, S, 5, "checkpoint.created", {"name": "c", "through_sequence": 4, "state_hash": s.hash}, T)
    s = apply_event(s, c)
    assert s.checkpoints[0]["id"] == c["id"]
    with pytest.raises(EventError):
        apply_event(s, create_event(P, S, 6, "checkpoint.created", {"name": "c", "through_sequence": 4, "state_hash": s.hash}, T))


@pytest.mark.parametrize("bad", [
    dict(sequence=0), dict(sequence=1.5), dict(sequence=2**53), dict(event_type="nope"), dict(payload={}), dict(payload={"name": "x", "root_path": "/r", "more": 1}), dict(payload=None), dict(payload={"name": "", "root_path": "/r"}),
    dict(payload={"name": 3, "root_path": "/r"}), dict(project_id="x"), dict(session_id="x"), dict(created_at="2024-01-02"), dict(created_at="2024-13-02T03:04:05.006Z"),
])
def test_malformed(bad):
    good = dict(project_id=P, session_id=S, sequence=1, event_type="project.created", payload={"name": "x", "root_path": "/r"}, created_at=T)
    with pytest.raises(EventError):
        create_event(**(good | bad))


def test_tampering_and_order():
    h = history_of(1)
    with pytest.raises(EventError):
        verify_event({**h[2], "payload": {"content": "other"}})
    for wrong in ([h[1]], [h[0], h[0]], [h[0], h[2]], [h[0], h[1], create_event(P, P, 3, "test.result", {"status": "passed", "summary": "s"}, T)]):
        with pytest.raises(EventError):
            reconstruct(wrong)


def test_every_type_refuses_an_empty_or_open_payload():
    for t in PAYLOADS:
        if t != "session.started":
            with pytest.raises(EventError):
                check_payload(t, {})
        with pytest.raises(EventError):
            check_payload(t, {"nobody": 1})
    fields = {"x": lambda v: v == 1}
    register_payload("ext.test", fields)
    register_payload("ext.test", fields)
    check_payload("ext.test", {"x": 1})
    with pytest.raises(EventError):
        register_payload("ext.test", {"y": lambda v: True})


def table(spark, events):
    return spark.createDataFrame([{**e, "payload": canonical_json(e["payload"])} for e in events], EVENT)


def test_verified_and_folded(spark):
    h = history_of(3)
    df = table(spark, h)
    assert df.transform(verified).where("valid").count() == 5
    forged = df.withColumn("payload", F.when(F.col("sequence") == 4, F.lit('{"content":"x"}')).otherwise(F.col("payload")))
    assert [r.sequence for r in forged.transform(verified).where("not valid").collect()] == [4]
    row = fold_projects(df).first()
    assert (row.last_sequence, row.error, row.state_hash) == (5, None, reconstruct(h).hash)
    assert fold_projects(forged).first().error.startswith("4:")
    assert json.loads(df.orderBy("sequence").first().payload)["name"] == "Demo"


def test_history_operators(spark):
    log = spark.createDataFrame([(1, 1, "s", 5), (1, 2, "v", 6), (1, 4, "v", 7), (2, 1, "v", 8)], "p int, seq long, t string, id long")
    audit = {r.p: r for r in history.sequence_audit(log, "p", "seq").collect()}
    assert audit[1].n_broken == 1 and not audit[1].contiguous and audit[2].contiguous
    held = {(r.p, r.seq): r.active_session for r in history.active_session(log, "p", "seq", F.col("id"), F.col("t") == "s").collect()}
    assert held == {(1, 1): None, (1, 2): 5, (1, 4): 5, (2, 1): None}
    assert history.as_of(log, "seq", 1).count() == 2
    assert {r.id for r in history.latest_per(log, ["p", "t"], "seq", F.col("t") == "s").collect()} == {7, 8}
    assert {(r.id, r.valid_to, r.superseded_by) for r in history.validity(log, "p", "seq", "id").collect()} == {(5, 2, 6), (6, 4, 7), (7, None, None), (8, None, None)}
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    assert {(r.node, r.hops) for r in history.closure(edges, spark.createDataFrame([("a",)], "node string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    old, new = spark.createDataFrame([("x", 1), ("y", 1), ("z", None)], "k string, h int"), spark.createDataFrame([("x", 1), ("y", 2), ("w", 1), ("z", None)], "k string, h int")
    assert {(r.k, r.state) for r in history.diff_snapshots(old, new, "k", ["h"]).collect()} == {("x", "reused"), ("y", "changed"), ("w", "added"), ("z", "reused")}
    assert {(r.t, r.n) for r in history.histogram(log, "t", ["s", "v", "q"]).collect()} == {("s", 1), ("v", 3), ("q", 0)}


def test_transitions(spark):
    assert history.check_transition("task", "active", "completed") and not history.check_transition("task", "completed", "active") and not history.check_transition("decision", "active", "completed")
    rows = [(k, b, a) for k in history.TRANSITIONS for b in ("active", "in_progress", "completed") for a in ("active", "in_progress", "completed", "resolved", "cancelled")]
    df = spark.createDataFrame(rows, "k string, b string, a string")
    for r in df.select("*", history.transition_allowed(F.col("k"), F.col("b"), F.col("a")).alias("ok")).collect():
        assert r.ok == history.check_transition(r.k, r.b, r.a)
