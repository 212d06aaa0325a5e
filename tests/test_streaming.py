import pytest

from ledgerloom.functions.canonical import canonical_json

from ledgerloom.operators.events import EVENT, EventError, create_event
from ledgerloom.streaming import views

T = "2024-01-02T03:04:05.006Z"


def uuid(k):
    return f"{k:08d}-0000-4000-8000-000000000000"


def history(p, n):
    out = [create_event(uuid(p), uuid(100 + p), 1, "project.created", {"name": "n", "root_path": "/"}, T), create_event(uuid(p), uuid(100 + p), 2, "session.started", {}, T)]
    return out + [create_event(uuid(p), uuid(100 + p), 3 + k, "conversation.user_message", {"content": str(k)}, T) for k in range(n)]


def rows(df):
    return sorted((r.project_id, r.n_events, r.last_sequence, r.active_session_id, r.n_sessions) for r in df.collect())


def test_every_prefix_equals_the_batch_view_and_late_events_wait(spark, tmp_path):
    log, view = str(tmp_path / "log"), views.ProjectView(spark, str(tmp_path / "view"))
    a, b = history(1, 4), history(2, 2)
    batches = [[a[0], a[1], b[1]], [a[3], b[0]], [a[2], b[2]], [a[4], a[5], b[3]]]
    seen = []
    for k, batch in enumerate(batches):
        df = spark.createDataFrame([{**e, "payload": canonical_json(e["payload"])} for e in batch], EVENT)
        df.coalesce(1).write.mode("append").parquet(log)
        views.follow(views.read_events(spark, log), view.apply, str(tmp_path / "checkpoint")).awaitTermination()
        seen += batch
        place = [e for e in seen if {x["sequence"] for x in seen if x["project_id"] == e["project_id"]} >= set(range(1, e["sequence"] + 1))]
        want = views.summarize(spark.createDataFrame([{**e, "payload": canonical_json(e["payload"])} for e in place], EVENT))
        assert rows(view.view()) == rows(want), k
        assert view.parked().count() == len(seen) - len(place)
        view.apply(df, 0)  # a batch that ran before changes nothing
        assert rows(view.view()) == rows(want)


def table(spark, events):
    return spark.createDataFrame([{**e, "payload": canonical_json(e["payload"])} for e in events], EVENT)


def test_a_crash_keeps_the_version_before_and_untouched_parts_stay(spark, tmp_path, monkeypatch):
    view = views.ProjectView(spark, str(tmp_path / "view"), parts=4)
    logs = {p: history(p, 3) for p in range(1, 9)}
    view.apply(table(spark, [e for p in logs for e in logs[p][:3]]), 0)
    before, folders = rows(view.view()), view._newest()["view"]
    real = views.ProjectView._write

    def dies(self, df, what, batch_id):
        real(self, df, what, batch_id)
        raise RuntimeError("lost")

    monkeypatch.setattr(views.ProjectView, "_write", dies)
    with pytest.raises(RuntimeError):
        view.apply(table(spark, logs[1][3:]), 1)
    assert rows(view.view()) == before
    monkeypatch.undo()
    view.apply(table(spark, logs[1][3:]), 1)
    after = view._newest()["view"]
    assert sum(after[p] != folders[p] for p in folders) == 1 and max(r[1] for r in rows(view.view())) == 5
    with pytest.raises(EventError):
        other = create_event(uuid(2), uuid(102), 4, "conversation.user_message", {"content": "another"}, T)
        view.apply(table(spark, [logs[2][3], other]), 2)
    assert view._newest()["batch"] == 1
