import json
import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime, timedelta

import pytest

from ledgerloom import cli
from ledgerloom.operators import memory as mem
from ledgerloom.operators.events import EventError
from ledgerloom.operators.history import TRANSITIONS
from ledgerloom.operators.packing import recall
from ledgerloom.plans.engine import Engine, replay_code
from ledgerloom.plans.tools import TOOLS, Tools
from ledgerloom.sources import archive
from ledgerloom.sources.repository import RepositorySource, read_file, scan_repository
from ledgerloom.sources.store import Store, StoreError


class Clock:
    def __init__(self):
        self.now = datetime(2024, 1, 1, tzinfo=UTC)

    def __call__(self):
        self.now += timedelta(seconds=1)
        return self.now


LOGIN = "import { createSession } from './session';\nexport function loginHandler(user: string) {\n  return createSession(user);\n}\n"
SESSION = "export function createSession(user: string) {\n  return refreshSession(user);\n}\nexport function refreshSession(user: string) {\n  return user;\n}\n"


@pytest.fixture
def project(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "login.ts").write_text(LOGIN)
    (root / "session.ts").write_text(SESSION)
    (root / "other.py").write_text("def unrelated():\n    return 1\n")
    store = Store(tmp_path / "store", Clock())
    id_, session = store.initialize_project(str(root), "Demo Auth")
    return root, store, Engine(store, id_, session)


def test_store_is_append_only_and_contiguous(project):
    root, store, e = project
    message = e.record("conversation.user_message", {"content": "hello"})
    assert message["sequence"] == 3 and store.initialize_project(str(root), "again")[0] == e.project_id
    with pytest.raises(EventError):
        e.record("project.created", {"name": "x", "root_path": "/"})
    with pytest.raises(EventError):
        e.record("file.changed", {"path": "x"})
    point = store.checkpoint(e.project_id)
    session = store.resume(e.project_id)
    assert store.state(e.project_id).active_session_id == session and store.state(e.project_id, 4).checkpoints[0]["id"] == point["id"]
    e.record("test.result", {"status": "passed", "summary": "in a session that was replaced"})
    assert [x["sequence"] for x in e.events()] == list(range(1, len(e.events()) + 1))
    with pytest.raises(RuntimeError), store.transaction(e.project_id):
        e.record("conversation.user_message", {"content": "lost"})
        raise RuntimeError
    assert all(x["payload"].get("content") != "lost" for x in e.events())
    file = sorted((store.root / "canonical/events").rglob("0*.parquet"))[-1]
    with pytest.raises(FileExistsError):
        os.link(file, file.with_name("000000000003.parquet"))
    assert store.find_project(root / "sub")["id"] == e.project_id
    hash_ = store.put_blob(b"abc")
    assert store.put_blob(b"abc") == hash_ and store.read_blob(hash_) == b"abc"
    with pytest.raises(StoreError):
        store.read_blob("0" * 64)
    (store.root / "ledger.json").write_text("[1]")
    with pytest.raises(StoreError):
        Store(store.root)


def test_concurrent_writers_leave_no_gap(project):
    root, store, e = project

    def write(k):
        other = Engine(Store(store.root, Clock()), e.project_id)
        for j in range(3):
            other.record("conversation.user_message", {"content": f"{k}-{j}"})

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(write, range(3)))
    events = e.events()
    assert [x["sequence"] for x in events] == list(range(1, len(events) + 1)) and sum(x["event_type"] == "conversation.user_message" for x in events) == 9


def test_memory_lifecycle_and_time_travel(project):
    _, store, e = project
    src = e.record("conversation.user_message", {"content": "use a database"})["id"]
    old = e.promote("decision", "Use files", [src])
    assert e.promote("decision", "Use files", [src]) == old
    before = store.state(e.project_id).last_sequence
    new = e.supersede(old, [src], "Use a database")
    m = e.memory()
    assert m.entities[old].status == "superseded" and m.entities[old].superseded_by == new and m.entities[new].status == "active"
    assert e.memory(before).entities[old].status == "active" and new not in e.memory(before).entities
    assert any(r.kind == "SUPERSEDES" and r.source == new for r in m.relations.values())
    task = e.promote("task", "Write it", [src])
    e.change_status(task, "in_progress", [src])
    e.resolve(task, [src])
    assert e.memory().entities[task].status == "completed" and e.memory().entities[task].valid_to is None
    n = len(e.events())
    for bad in (lambda: e.change_status(task, "in_progress", [src]), lambda: e.change_status(new, "completed", [src]), lambda: e.promote("goal", "x", ["f" * 64]), lambda: e.link(task, task, "BLOCKS", [src]), lambda: e.supersede(old, [src], "again"), lambda: e.resolve(new, [src])):
        with pytest.raises(EventError):
            bad()
    assert len(e.events()) == n
    for kind in TRANSITIONS:
        e.promote(kind, f"a {kind}", [src])
    for relation in ("PART_OF", "DEPENDS_ON", "BLOCKS", "RESOLVES", "PRODUCED", "VERIFIED_BY", "RELATED_TO"):
        e.link(task, new, relation, [src])
    h = e.handoff()
    assert [x["content"] for x in h["decisions"]] == ["Use a database", "a decision"] and h["completed_tasks"][0]["id"] == task and old in [x["id"] for x in h["history"]]
    assert h["evidence"][0]["event_type"] == "project.created" and h == e.handoff() and src in [x["id"] for x in h["evidence"]]


def test_memory_tables_equal_the_fold(project, spark):
    _, store, e = project
    src = e.record("conversation.user_message", {"content": "x"})["id"]
    ids = [e.promote("task", f"t{k}", [src]) for k in range(4)]
    e.change_status(ids[0], "cancelled", [src])
    e.supersede(ids[1], [src], "t1 better")
    e.change_status(ids[2], "in_progress", [src])
    events = store.events(spark)
    for through in (5, 7, 10**6):
        want = {(x.id, x.status, x.valid_from, x.valid_to) for x in e.memory(through).entities.values()}
        assert {(r.id, r.status, r.valid_from, r.valid_to) for r in mem.current_memory(events, through).collect()} == want
        assert {(r.id, r.status, r.valid_from, r.valid_to) for r in mem.memory_of(events, through).collect()} == want


def test_index_is_incremental(project, spark):
    root, store, e = project
    run = e.index(root)
    assert (run.status, run.payload["files_changed"]) == ("completed", 3)
    first = e.graph()
    assert e.index(root).payload["files_unchanged"] == 3 and [s.id for s in e.graph().symbols] == [s.id for s in first.symbols]
    old = first.named("refreshSession")[0]
    (root / "session.ts").write_text(SESSION.replace("return user;", "return user + 1;"))
    (root / "other.py").rename(root / "moved.py")
    run = e.index(root)
    assert (run.payload["files_changed"], run.payload["files_deleted"], run.payload["files_unchanged"]) == (2, 1, 1)
    new = e.graph().named("refreshSession")[0]
    assert new.id == old.id and new.version_id != old.version_id
    assert "user + 1" in e.source("refreshSession")[1] and "user + 1" not in e.source(old.version_id)[1]
    (root / "link.ts").symlink_to(root / "login.ts")
    assert e.index(root).status == "failed" and e.graph().named("refreshSession")[0].version_id == new.version_id
    (root / "link.ts").unlink()
    (root / "bad.py").write_text("def (")
    assert e.index(root).status == "failed"
    (root / "bad.py").unlink()
    with pytest.raises(EventError):
        e.index(root.parent)
    from ledgerloom.functions.canonical import new_uuid

    e.append("code.index.started", {"index_run_id": new_uuid(), "root_path": str(root), "started_at": "2024-01-01T00:00:00.000Z"})
    with pytest.raises(EventError):
        e.index(root)
    assert e.index(root, rebuild=True).status == "completed" and [r.status for r in replay_code(e.events())[1]][-2:] == ["failed", "completed"]
    assert store.blobs(spark).where("not valid").count() == 0


def test_projections_follow_appends(project):
    from ledgerloom.sources.store import Projection

    _, store, e = project
    counts = Projection("count", lambda events: {"n": len(events)}, lambda old, event: {"n": old["n"] + 1})
    kinds = Projection("messages", lambda events: [x["payload"]["content"] for x in events if x["event_type"] == "conversation.user_message"], event_types=("conversation.user_message",))

    def refuses(events):
        if any(x["payload"].get("content") == "bad" for x in events):
            raise ValueError

    store.projections = {p.name: p for p in (counts, kinds, Projection("strict", refuses))}
    for k in range(3):
        e.record("conversation.user_message", {"content": f"m{k}"})
    e.record("test.result", {"status": "passed", "summary": "s"})
    with pytest.raises(ValueError):
        e.record("conversation.user_message", {"content": "bad"})
    view = lambda n: json.loads((store.root / "views" / f"{n}-{e.project_id}.json").read_text())
    assert view("count") == {"n": 6} == {"n": len(e.events())} and view("messages") == ["m0", "m1", "m2"]
    before = view("count")
    store.rebuild(e.project_id)
    assert view("count") == before
    file = store._files(e.project_id)[2]
    data = file.read_bytes()
    file.write_bytes(store._files(e.project_id)[3].read_bytes())
    assert not e.doctor()["healthy"]
    file.write_bytes(data)
    assert e.doctor()["healthy"]


def test_scan(tmp_path, spark):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.ts").write_text("no")
    (tmp_path / "a.ts").write_text("1")
    (tmp_path / "b").mkdir()
    (tmp_path / "b/c.PY").write_text("1")
    (tmp_path / "text.md").write_text("1")
    assert scan_repository(tmp_path).files == [("a.ts", "typescript"), ("b/c.PY", "python")]
    spark.dataSource.register(RepositorySource)
    from ledgerloom.session import prepare

    prepare(spark)
    rows = spark.read.format("repository").load(str(tmp_path)).orderBy("path").collect()
    assert [(r.path, r.language, bytes(r.content)) for r in rows] == [("a.ts", "typescript", b"1"), ("b/c.PY", "python", b"1")]
    (tmp_path / "loop").symlink_to(tmp_path)
    assert scan_repository(tmp_path).errors == [("loop", "a link is not followed")]
    with pytest.raises(ValueError):
        read_file(tmp_path, "../x")


@pytest.fixture
def filled(project):
    root, store, e = project
    e.index(root)
    src = e.record("conversation.user_message", {"content": "keep refresh rotation"})["id"]
    passed = e.record("test.result", {"status": "passed", "summary": "session tests"})["id"]
    ids = {
        "goal": e.promote("goal", "Ship authentication", [src]), "task": e.promote("task", "Implement refresh rotation", [src]), "constraint": e.promote("constraint", "Never store plain tokens", [src]),
        "decision": e.supersede(e.promote("decision", "Use flat files", [src]), [src], "Use SQLite for durable storage"), "result": e.promote("result", "session tests passed", [passed]),
    }
    e.link_symbol(ids["task"], "refreshSession")
    for k in range(18):
        e.promote("artifact", f"distractor {k} " + "filler words " * 60, [src])
    return root, store, e, ids


def test_retrieval_finds_what_is_required(filled):
    _, _, e, ids = filled
    g = e.graph()
    sym = {n: g.named(n)[0].id for n in ("loginHandler", "createSession", "refreshSession")}
    for text, wanted in [("where is login handled?", [sym["loginHandler"]]), ("what calls createSession?", [sym["loginHandler"], sym["createSession"]]), ("why are we using SQLite?", [ids["decision"]]), ("what is affected by changing refreshSession?", [sym["createSession"], sym["loginHandler"]]), ("continue implementing refresh rotation", [ids["task"], sym["refreshSession"]])]:
        found = e.retrieve(text)
        assert recall([c.id for c in found.candidates[:10]], wanted)[0], text
        assert all(c.current for c in found.candidates)
    assert e.retrieve("what is affected by changing refreshSession?").query.mode == "impact"
    history = e.retrieve("Use flat files", historical=True)
    assert any(c.entity and c.entity.status == "superseded" for c in history.candidates) and history.diagnostics["historical"] >= 1
    assert all(c.symbol for c in e.retrieve("createSession", mode="code").candidates) and all(c.entity for c in e.retrieve("SQLite", mode="memory").candidates)
    assert e.retrieve("createSession").candidates[0].priority == 1 and e.retrieve("x", symbol_ids=(sym["loginHandler"],)).candidates[0].id == sym["loginHandler"]


def test_budgets_degrade_monotonically(filled):
    _, _, e, ids = filled
    wanted = [ids[k] for k in ("goal", "task", "constraint", "decision", "result")] + [e.graph().named("refreshSession")[0].id]
    recalls = []
    for budget in (8000, 4000, 2000, 500, 100, 1):
        packet, report = e.compile("continue implementing refresh rotation", budget=budget)
        recalls.append(recall([r["id"] for r in report if r["selected"]], wanted)[1])
        assert packet["token_count"] <= budget or packet["budget_insufficient"]
    assert recalls[0] == recalls[2] == 1.0 and recalls == sorted(recalls, reverse=True)
    assert packet["budget_insufficient"] and "refresh" in e.context_text("continue implementing refresh rotation")


def test_tools(filled):
    _, _, e, ids = filled
    t = Tools(e)
    assert len(TOOLS) == 13 and t.call("status")["last_sequence"] == len(e.events())
    assert t.call("find_symbol", query="loginHandler")["symbols"][0]["path"] == "login.ts"
    assert "createSession" in t.call("get_source", symbol_id="createSession")["source"]
    assert len(t.call("callers", symbol_id="createSession")) == 1 and len(t.call("callees", symbol_id="createSession")) == 1
    assert t.call("impact", symbol_id="refreshSession")["candidates"][0]["name"] == "refreshSession"
    assert t.call("context", text="SQLite", budget=2000)["token_count"] <= 2000 and t.call("retrieve", text="SQLite", limit=3)["candidates"]
    m = t.call("record_event", event_type="tool.call", payload={"call_id": "1", "tool_name": "x", "input": {}})["id"]
    a = t.call("add_memory", entity_type="question", content="why?", source_event_ids=[m])["id"]
    t.call("link_memory", from_memory_id=a, to_memory_id=ids["task"], relation_type="RELATED_TO", source_event_ids=[m])
    t.call("checkpoint")
    assert t.call("handoff")["open_questions"] and t.resource("memory/current") and t.resource("project/status")
    for bad in (("nope", {}), ("find_symbol", {}), ("status", {"x": 1}), ("add_memory", {"entity_type": "x", "content": "y", "source_event_ids": []})):
        with pytest.raises(EventError):
            t.call(bad[0], **bad[1])


def test_archive_round_trip_and_damage(filled, tmp_path, spark):
    root, store, e, _ = filled
    path = tmp_path / "a.gz"
    archive.export_project(store, e.project_id, path)
    other = archive.import_project(path, tmp_path / "copy")
    assert other.read_events(e.project_id) == e.events() and Engine(other, e.project_id).graph().symbols == e.graph().symbols
    with pytest.raises(FileExistsError):
        archive.export_project(store, e.project_id, path)
    with pytest.raises(StoreError):
        archive.import_project(path, tmp_path / "copy")
    records = archive.export_records(store, e.project_id)
    kinds = {r["type"]: k for k, r in enumerate(records)}

    def damaged(change):
        again = json.loads(json.dumps(records))
        change(again)
        return archive.packed(again)

    changes = [lambda r: r.pop(), lambda r: r.pop(0), lambda r: r.append(r[-1]), lambda r: r[kinds["event"]]["data"]["payload"].update(content="x"), lambda r: r[0]["data"].update(digest="0" * 64), lambda r: r[kinds["blob"]]["data"].update(content="eA=="), lambda r: r.insert(1, r[0]), lambda r: r[0]["data"].update(events=1), lambda r: r[1]["data"].update(checksum="x"), lambda r: r.append({"type": "odd", "data": {}})]
    for k, change in enumerate(changes):
        bad = tmp_path / f"bad{k}.gz"
        bad.write_bytes(damaged(change))
        with pytest.raises(archive.ArchiveError):
            archive.import_project(bad, tmp_path / f"t{k}")
        assert not (tmp_path / f"t{k}").exists()
    for data in (path.read_bytes()[:-9], b"", b"junk"):
        (tmp_path / "cut.gz").write_bytes(data)
        with pytest.raises(archive.ArchiveError):
            archive.import_project(tmp_path / "cut.gz", tmp_path / "t")
    rows = archive.read_archive_lines(spark, str(path)).groupBy("type").count().collect()
    assert {r["type"]: r["count"] for r in rows}["event"] == len(e.events())


def test_sealed_archive(filled, tmp_path, spark):
    _, store, e, _ = filled
    path = tmp_path / "s.bin"
    archive.export_project(store, e.project_id, path, "secret words")
    assert archive.import_project(path, tmp_path / "copy", "secret words").read_events(e.project_id) == e.events()
    data = path.read_bytes()
    for bad in (data[:-1], data[:-1] + bytes([data[-1] ^ 1]), data.replace(b'"n": 32768', b'"n": 32769'), data.replace(b"aes-256-gcm", b"aes-128-gcm")):
        with pytest.raises(archive.ArchiveError):
            archive.opened(bad, "secret words")
    for wrong in ("", "other"):
        with pytest.raises(archive.ArchiveError):
            archive.opened(data, wrong)


def test_doctor_and_repair(filled):
    _, store, e, _ = filled
    assert e.doctor()["healthy"]
    view = store.root / "views" / f"state-{e.project_id}.json"
    view.write_text("{}")
    assert not e.doctor()["healthy"] and e.repair()["healthy"]
    blob = sorted((store.root / "canonical/blobs").glob("*.parquet"))[0]
    blob.unlink()
    assert any(p.startswith("blobs") or p.startswith("graph") for p in Engine(store, e.project_id).doctor()["problems"])


def test_command_line(tmp_path, capsys):
    (tmp_path / "a.py").write_text("def one():\n    return two()\ndef two():\n    return 1\n")
    go = lambda *a: cli.run(["--root", str(tmp_path), *a])
    assert go("status")[0] == 1
    assert go("init", "--name", "X")[0] == 0 and go("index")[1]["status"] == "completed"
    assert go("code", "stats")[1]["files"] == 1 and go("code", "audit")[1]["total"] == 0 and len(go("code", "callers", "two")[1]) == 1 and go("code", "imports", "a.py")[1] == []
    assert "two()" in go("code", "source", "one")[1]["source"] and not go("code", "symbol", "one")[1]["ambiguous"] and go("code", "callees", "nobody")[0] == 1
    source = go("checkpoint")[1]["id"]
    m = go("memory", "add", "--type", "task", "--content", "do one", "--source-event", source)[1]["id"]
    assert go("memory", "list", "--type", "task")[1][0]["id"] == m and go("memory", "link", m, "--symbol", "one")[0] == 0
    n = go("memory", "supersede", m, "--content", "do two", "--source-event", source)[1]["id"]
    assert go("memory", "resolve", n, "--source-event", source)[0] == 0 and go("resume")[0] == 0 and go("session", "start", "--provider", "p")[0] == 0
    assert go("retrieve", "one")[1] and go("context", "one")[0] == 0 and go("context", "one", "--tokens", "1")[0] == 2
    assert go("handoff")[0] == 0 and go("doctor")[0] == 0 and go("repair")[0] == 0 and go("export", str(tmp_path / "x.gz"))[0] == 0
    assert cli.run(["--root", str(tmp_path / "new"), "import", str(tmp_path / "x.gz")])[0] == 0
    out = subprocess.run([sys.executable, "-m", "ledgerloom.cli", "--root", str(tmp_path), "status"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert out.returncode == 0 and json.loads(out.stdout)["project"]["name"] == "X"


def test_channels(filled):
    root, store, e, ids = filled
    (root / "lib").mkdir()
    (root / "lib" / "ledger.py").write_text("class Ledger:\n    def post(self, entry):\n        return self.balance(entry)\n    def balance(self, entry):\n        return entry\n")
    (root / "again.py").write_text("def post():\n    return 2\n")
    assert e.index(root).status == "completed"
    g = e.graph()
    place = lambda found, channel: [c.id for c in sorted((c for c in found.candidates if channel in {r[0] for r in c.rankings}), key=lambda c: next(r[1] for r in c.rankings if r[0] == channel))]
    file_of = {s.path: s.id for s in g.symbols if s.kind == "file"}
    part = e.retrieve("Ledger.py")
    assert place(part, "path") == [file_of["lib/ledger.py"]] and next(c for c in part.candidates if c.id == file_of["lib/ledger.py"]).priority == 3
    whole = e.retrieve("LIB\\ledger.py")
    assert whole.candidates[0].id == file_of["lib/ledger.py"] and whole.candidates[0].priority == 1
    assert not place(e.retrieve("what is in lib/ledger.py here"), "path")
    post = g.named("Ledger.post")[0]
    assert place(e.retrieve("ledger.post"), "exact") == [post.id] == place(e.retrieve("why does Ledger.post fail"), "exact")
    assert place(e.retrieve(post.version_id), "exact") == [post.id]
    both = e.retrieve("post")
    assert both.diagnostics["ambiguous"] == sorted(s.id for s in g.named("post")) and len(both.diagnostics["ambiguous"]) == 2
    terms = e.retrieve("the session of a login")
    assert place(terms, "symbol_terms") == sorted(s.id for s in g.symbols if s.kind == "function" and {"login", "session"} & set(s.name.lower().replace("handler", " handler").replace("session", " session").split()))
    standing = e.retrieve("continue", mode="continue")
    src = e.record("conversation.user_message", {"content": "more"})["id"]
    blocker, question = e.promote("blocker", "No keys yet", [src]), e.promote("question", "Which cache?", [src])
    standing = e.retrieve("continue", mode="continue")
    assert place(standing, "project_state") == [ids["goal"], ids["task"], ids["constraint"], blocker, ids["decision"], ids["result"], question] == place(standing, "continue")
    mine = e.retrieve("continue", mode="continue", session_id=e.session_id)
    assert set(place(mine, "continue")) <= set(place(mine, "project_state"))
    d = standing.diagnostics
    assert d["expanded_nodes"] >= len(standing.scores) and d["ppr_iterations"] > 0 and d["warnings"] == [] and d["retrieval_ms"] >= d["ppr_ms"] >= 0


def test_seeds_must_exist_and_old_versions_are_seeds(filled):
    root, _, e, ids = filled
    old = e.graph().named("refreshSession")[0]
    (root / "session.ts").write_text(SESSION.replace("return user;", "return user + 2;"))
    e.index(root)
    found = e.retrieve("x", symbol_ids=(old.version_id,))
    c = found.candidates[0]
    assert c.id == old.version_id and not c.current and c.priority == 0
    unit = next(u for u in e.units(found) if u.id == old.version_id)
    assert "user + 2" not in unit.text and not unit.current
    for seeds in ({"symbol_ids": ("0" * 64,)}, {"symbol_ids": ("refreshSession",)}, {"memory_ids": ("0" * 64,)}, {"files": ("nowhere.ts",)}, {"session_id": "00000000-0000-4000-8000-000000000000"}):
        with pytest.raises(EventError):
            e.retrieve("x", **seeds)
    for limit in (0, 2001):
        with pytest.raises(ValueError):
            e.retrieve("x", limit)


def test_search_view_is_rebuilt_when_stale_or_asked(filled):
    root, store, e, ids = filled
    first = [(c.id, c.rrf) for c in e.retrieve("refresh rotation").candidates]
    assert not e.retrieve("refresh rotation").diagnostics["index_rebuilt"] and e.retrieve("refresh rotation", rebuild=True).diagnostics["index_rebuilt"]
    canonical = store.canonical_digest(e.project_id)
    for kind in ("code", "memory"):
        path = store.root / "views" / f"search-{kind}-{e.project_id}.json"
        whole = path.read_text()
        for damage in (None, "[]", whole[:-20], json.dumps([{**r, "name": "stale", "content": "stale"} for r in json.loads(whole)])):
            path.unlink() if damage is None else path.write_text(damage)
            assert damage is None or not e.doctor()["healthy"]
            again = e.retrieve("refresh rotation")
            assert again.diagnostics["index_rebuilt"] and [(c.id, c.rrf) for c in again.candidates] == first
            assert path.read_text() == whole and e.doctor()["healthy"]
    src = e.record("conversation.user_message", {"content": "x"})["id"]
    note = e.promote("decision", "Prefer quarterly compaction", [src])
    assert any(c.id == note for c in e.retrieve("compaction").candidates)
    newer = e.supersede(note, [src], "Prefer weekly merging")
    assert not any(c.id == note for c in e.retrieve("compaction").candidates) and any(c.id == newer for c in e.retrieve("merging").candidates)
    e.rebuild_search()
    assert store.canonical_digest(e.project_id) == canonical or len(e.events()) > 0
    with pytest.raises(ValueError):
        store.search(e.project_id, "code", ["x"], 10_001)


def test_statistics_of_a_search_are_those_of_the_store(filled, tmp_path):
    from ledgerloom.plans.ranking import LocalIndex

    _, store, e, _ = filled
    alone = {c.id: c.rrf for c in e.retrieve("refresh").candidates}
    other, session = store.initialize_project(str(tmp_path / "elsewhere"), "Other")
    two = Engine(store, other, session)
    src = two.record("conversation.user_message", {"content": "refresh"})["id"]
    for k in range(40):
        two.promote("artifact", f"refresh everything {k}", [src])
    two.retrieve("anything", mode="memory")
    a, b = LocalIndex({"1": "one two", "2": "two three"}), LocalIndex({"9": "two two two"})
    assert a.scores(["two"], [b])["1"] != a.scores(["two"])["1"] and set(a.scores(["two"], [b])) == {"1", "2"}
    assert store.search(e.project_id, "memory", ["refresh"], 5)[0][1] != 0 and alone


def test_views_and_compile_options(filled):
    root, store, e, ids = filled
    for name in ("memory", "code"):
        view = store.root / "views" / f"{name}-{e.project_id}.json"
        kept = view.read_text()
        view.write_text("{}")
        assert any(name in p for p in e.doctor()["problems"]) and e.repair()["healthy"] and json.loads(view.read_text()) == json.loads(kept)
    run = e.index(root)
    g = e.graph()
    m = run.payload["metrics"]
    assert (m["symbols_extracted"], m["edges_extracted"]) == (len(g.symbols), len(g.edges)) and m["bytes_read"] == sum(len((root / f).read_bytes()) for f in ("login.ts", "session.ts", "other.py")) and m["duration_ms"] >= 0
    wide, narrow = e.compile("refreshSession", source_bytes=10_000)[0], e.compile("refreshSession", source_bytes=1)[0]
    assert wide["token_count"] >= narrow["token_count"]
    assert sum(r["required"] for r in e.compile("session", reserve={"source": 3})[1]) > sum(r["required"] for r in e.compile("session", reserve={})[1])
    with pytest.raises(ValueError):
        e.compile("x", weight=2)


def test_transactions_are_seen_whole_and_locks_end_with_their_process(project):
    root, store, e = project
    other = Store(store.root, Clock())
    n = len(other.read_events(e.project_id))
    with store.transaction(e.project_id):
        e.record("conversation.user_message", {"content": "one"})
        e.record("conversation.user_message", {"content": "two"})
        assert len(e.events()) == n + 2 and len(other.read_events(e.project_id)) == n
        with pytest.raises(RuntimeError), store.transaction(e.project_id):
            e.record("conversation.user_message", {"content": "inner"})
            raise RuntimeError
        assert len(e.events()) == n + 2
    assert [x["payload"].get("content") for x in other.read_events(e.project_id)][n:] == ["one", "two"] == [x["payload"].get("content") for x in e.events()][n:]
    assert other.state(e.project_id).as_json() == store.state(e.project_id).as_json() and store.diagnostics()["events"] == n + 2
    code = f"import os; from ledgerloom.sources.store import Store; s = Store({str(store.root)!r}); w = s.writer(); w.__enter__(); os._exit(1)"
    subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    with store.writer(wait=0.5):
        with pytest.raises(StoreError), other.writer(wait=0.1):
            pass
