import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recallforge.functions import detectors, vectors
from recallforge.operators import agents, diff, graph, memory, rack, sessions, units, vault
from recallforge.sources import exports, readers
from recallforge.streaming import events, trackers
from recallforge.streaming import sessions as live


def test_upsert_hides_older_entries_of_a_key(spark):
    old = memory.build_entries(spark.createDataFrame([(1, "old", "k"), (2, "other", "o")], "entry_id bigint, content string, key string"))
    new = memory.build_entries(spark.createDataFrame([(3, "new", "K!")], "entry_id bigint, content string, key string"))
    assert sorted(r.content for r in memory.live(memory.upsert(old, new)).collect()) == ["new", "other"]


def test_semantic_tier_fills_after_the_exact_hit(spark):
    e = memory.build_entries(spark.createDataFrame([(1, "alpha"), (2, "omega"), (3, "beta")], "entry_id bigint, content string"))
    vec = {1: [1.0, 0.1, 0.0], 2: [1.0, 0.0, 0.1], 3: [-1.0, 0.0, 0.0]}
    emb = spark.createDataFrame([(i, v, v) for i, v in vec.items()], "entry_id bigint, key_embedding array<float>, content_embedding array<float>")
    e = memory.with_semantic(e, emb, 3)
    sign = vectors.simhash(3)
    q = spark.createDataFrame([(0, "alpha")], "query_id bigint, query string")
    embed = lambda c: sign(F.array(F.lit(1.0), F.lit(0.1), F.lit(0.0)).cast("array<float>"))
    got = [(r.entry_id, r.mode) for r in memory.search(q, e, top_k=3, embed=embed).orderBy("rank").collect()]
    assert got == [(1, "exact"), (2, "semantic")]


def test_scopes(spark):
    rows = spark.createDataFrame([("a",), ("a__2",), ("a-x",), ("ab",)], "n string")
    assert [r.n for r in rows.filter(rack.in_scope(F.col("n"), "a")).collect()] == ["a", "a__2", "a-x"]
    headers = spark.createDataFrame([("v", "vault"), ("m", "memory")], "name string, cartridge_type string")
    e = spark.createDataFrame([("v",), ("m",)], "cartridge string")
    assert [r.cartridge for r in rack.select_cartridges(e, headers=headers).collect()] == ["m"]


def test_demotion(spark):
    meta = lambda x: {"session": "s", "exchange": str(x)}
    rows = [(1, "[turns 0-1] Q: a A: b", 4, meta(1)), (2, "[turns 0-1] Q: a A: b", 4, meta(1)), (3, "[turns 2-3] Q", 4, meta(2))]
    e = spark.createDataFrame(rows, "entry_id bigint, content string, kind int, meta map<string,string>")
    gone = spark.createDataFrame([("s", 1)], "session string, xid bigint")
    assert {r.entry_id: (r.kind, r.content) for r in sessions.sparsify(e, gone).collect()} == {1: (1, "Q: a A: b"), 2: (1, "Q: a A: b"), 3: (4, "[turns 2-3] Q")}
    assert {r.entry_id: r.kind for r in sessions.sparsify(e, gone, every_key=False).collect()} == {1: 4, 2: 1, 3: 4}


def test_agents(spark):
    now = datetime(2024, 1, 1)
    row = lambda seq, section, key, content: ("a", section, key, content, 1, "open", [], now, seq)
    state = agents.put(spark.createDataFrame([], agents.STATE), spark.createDataFrame([row(1, "identity", None, "old"), row(2, "identity", None, "new"), row(3, "goal", "g", "ship"), row(4, "goal", None, "ship twice")], agents.STATE))
    assert sorted(r.content for r in state.collect()) == ["new", "ship", "ship twice"]
    assert [r.status for r in agents.complete(state, "a", "g").filter("key = 'g'").collect()] == ["done"]
    hits = lambda *c: spark.createDataFrame([(x,) for x in c], "content string")
    assert agents.complete_by_search(state, "a", hits("ship")).filter("status = 'done'").count() == 1
    assert agents.complete_by_search(state, "a", hits("ship", "ship twice")).filter("status = 'done'").count() == 0


def test_projects_and_checkpoints(spark):
    t = datetime(2024, 1, 1)
    schema = "project string, host string, model string, goal string, summary string, last_activity timestamp"
    p = agents.touch_project(spark.createDataFrame([("p", "h", "m", "g", None, t)], schema), spark.createDataFrame([("p", None, "m2", None, "s", t + timedelta(days=1))], schema))
    r = p.first()
    assert (r.host, r.model, r.goal, r.summary) == ("h", "m2", "g", "s")
    c = spark.createDataFrame([("p", t + timedelta(hours=i), f"n{i}") for i in range(15)], "project string, ts timestamp, note string")
    assert agents.trail(c).count() == 10
    text = agents.packet(p, c).first().packet
    assert "goal: g" in text and text.count("- ") == 3 and "n14" in text
    e = spark.createDataFrame([(1, "x", False), (2, "y", True)], "entry_id bigint, content string, deleted boolean")
    x = spark.createDataFrame([(i, "q", "a") for i in range(12)], "xid bigint, q string, a string")
    s = agents.snapshot(e, x, "label", F.lit(t)).first()
    assert s.entries == 1 and [r.xid for r in s.recent] == list(range(2, 12))
    many = spark.createDataFrame([(str(i), t + timedelta(seconds=i // 2)) for i in range(60)], "checkpoint_id string, created_at timestamp")
    kept = {int(r.checkpoint_id) for r in agents.prune(many).collect()}
    assert len(kept) == 50 and min(kept) >= 10


def test_sync_rules_and_plan(spark, tmp_path):
    ok = lambda p, **o: spark.createDataFrame([(p,)], "p string").select(diff.syncable(F.col("p"), **o).alias("x")).first().x
    assert ok("facts/a") and not ok("secrets/a") and not ok("facts/a.tmp") and not ok("other/a") and not ok("continuity.json") and ok("continuity.json", continuity=True) and not ok("facts/vault-audit.jsonl")
    store = exports.LocalStore(str(tmp_path))
    tag = store.put("k2", b"old").etag
    plan = spark.createDataFrame([("k1", "local_ahead"), ("k2", "conflict"), ("k3", "in_sync")], "remote_key string, status string")
    assert exports.push(plan, {"k1": b"1", "k2": b"2"}, store, {}, dry_run=True) == [("k1", "would push"), ("k2", "conflict")]
    assert exports.push(plan, {"k1": b"1", "k2": b"2"}, store, {"k2": tag}, force=True) == [("k1", "pushed"), ("k2", "pushed")]
    assert store.get("k2") == b"2"


def test_graph_as_json(spark, tmp_path):
    s, e = graph.build(spark.createDataFrame([("a.py", "python", "def f():\n    return g()\n\ndef g():\n    return 1\n")], "path string, language string, content string"))
    graph.dump(s, e, str(tmp_path / "g"))
    s2, e2 = graph.load(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, s2.collect())) and sorted(map(tuple, e.collect())) == sorted(map(tuple, e2.collect()))


def test_small_things(spark):
    one = lambda f: spark.createDataFrame([("the token abc is secret",)], "x string").select(f(F.col("x")).alias("y")).first().y
    assert one(lambda c: detectors.redact(c, ["abc", ""])) == "the token [REDACTED] is secret"
    assert len(vault.new_salt()) == 16 and vault.derive_key("p", b"s" * 16) == vault.derive_key("p", b"s" * 16)
    files = spark.createDataFrame([("test_a.py",), ("src/x_test.py",), ("src/main.py",), ("a.spec.ts",)], "path string")
    assert units.test_files(files).first().tests == 3


def test_events_reach_subscribers_and_the_log(spark, tmp_path):
    spark.createDataFrame([("write", datetime(2024, 1, 1), 1), ("read", datetime(2024, 1, 1, 0, 7), 2)], "event string, ts timestamp, seq bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event string, ts timestamp, seq bigint").parquet(str(tmp_path / "in"))
    seen = []
    q = events.subscribe(stream, lambda b, n: seen.extend(r.event for r in b.collect()), str(tmp_path / "c1"), ["write"])
    q.processAllAvailable()
    q.stop()
    assert seen == ["write"]
    bad = events.subscribe(stream, lambda b, n: 1 / 0, str(tmp_path / "c2"))
    bad.processAllAvailable()
    assert bad.exception() is None
    bad.stop()
    log = events.publish(stream, str(tmp_path / "log"), str(tmp_path / "c3"))
    log.processAllAvailable()
    log.stop()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    w = events.windowed(stream).writeStream.format("memory").queryName("windowed_events").outputMode("complete").option("checkpointLocation", str(tmp_path / "c4")).start()
    w.processAllAvailable()
    w.stop()
    assert spark.table("windowed_events").count() == 2


def test_recall_counts_stream(spark, tmp_path):
    spark.createDataFrame([(1,), (1,), (2,)], "xid bigint").write.parquet(str(tmp_path / "in"))
    q = live.access_counts(spark.readStream.schema("xid bigint").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("accesses").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.xid: r.accesses for r in spark.table("accesses").collect()} == {1: 2, 2: 1}


def test_tracker(spark, tmp_path):
    root, snap = tmp_path / "p", str(tmp_path / "snap")
    root.mkdir()
    (root / "a.md").write_text("# One\ntext\n")
    status = lambda df: {(r.source, r.status) for r in df.collect()}
    assert status(trackers.track_once(spark, str(root), snap)) == {("a.md#one", "added")}
    assert status(trackers.track_once(spark, str(root), snap)) == set()
    (root / "a.md").write_text("# One\nother\n# Two\nmore\n")
    assert status(trackers.track_once(spark, str(root), snap)) == {("a.md#one", "changed"), ("a.md#two", "added")}
    found = []
    q = trackers.watch(spark, str(root), str(tmp_path / "snap2"), str(tmp_path / "c"), lambda c: found.extend(status(c)), seconds=1)
    for _ in range(60):
        if found:
            break
        time.sleep(0.5)
    q.stop()
    assert {s for s, _ in found} == {"a.md#one", "a.md#two"}
    assert {r.path for r in readers.project_files(spark, str(root)).collect()} == {"a.md"}


def test_recovery_finds_the_checkpoint_and_the_last_exchanges(spark):
    c = spark.createDataFrame([("a", "release work", 3), ("b", "garden plans", 1)], "checkpoint_id string, label string, entries int")
    turns = [(i, f"exchange {i}", f"exchange number {i}", 4, "s", {"exchange": str(i)}) for i in range(1, 13)]
    turns.append((99, "exchange", "exchange 5 again", 4, "s", {"exchange": "5"}))
    rows = agents.checkpoint_entries(c).unionByName(spark.createDataFrame(turns, "entry_id bigint, content string, key string, kind int, source string, meta map<string,string>"))
    entries = memory.build_entries(rows)
    asked = spark.createDataFrame([(1, "checkpoint release work"), (2, "zzzzz")], "query_id bigint, query string")
    found = {r.query_id: r for r in agents.recover(asked, entries, least=0.6).collect()}
    assert found[1].recovered and '"checkpoint_id":"a"' in found[1].checkpoint
    assert [x.exchange for x in found[1].recent] == [12, 11, 10, 9, 8]
    assert not found[2].recovered and found[2].recent is None


def test_pulls_follow_policies(spark, tmp_path):
    store = exports.LocalStore(str(tmp_path))
    for k in "abcde":
        store.put(k, k.encode())
    plan = spark.createDataFrame(
        [("a", "remote_ahead", None, "write_through"), ("b", "conflict", "write_through", "write_through"), ("c", "remote_ahead", "never", "write_through"), ("d", "remote_only", None, None), ("e", "in_sync", None, "write_through")],
        "remote_key string, status string, local_policy string, remote_policy string",
    )
    local = {}
    assert exports.pull(plan, store, local, dry_run=True) == [("a", "would pull"), ("b", "conflict"), ("c", "denied"), ("d", "denied")] and not local
    assert exports.pull(plan, store, local, force=True) == [("a", "pulled"), ("b", "pulled"), ("c", "denied"), ("d", "denied")]
    assert local == {"a": b"a", "b": b"b"}


def test_graph_tracker_builds_when_files_change(spark, tmp_path):
    root, out = tmp_path / "p", str(tmp_path / "out")
    root.mkdir()
    (root / "a.py").write_text("def one():\n    two()\n\ndef two():\n    pass\n")
    (root / "note.xyz").write_text("no source")
    assert [tuple(r) for r in trackers.track_graph_once(spark, str(root), out).collect()] == [("a.py", "added")]
    assert trackers.track_graph_once(spark, str(root), out) is None
    (root / "a.py").write_text("def one():\n    pass\n")
    assert [tuple(r) for r in trackers.track_graph_once(spark, str(root), out).collect()] == [("a.py", "changed")]
    symbols, _ = graph.load(spark, f"{out}/graph")
    assert [(r.file_path, r.n, r.symbols[0].id) for r in graph.file_info(symbols).collect()] == [("a.py", 1, "a.py::one")]


def test_personal_data_is_warned_of(spark):
    rows = spark.createDataFrame([("write to a@b.org",), ("none",)], "content string")
    with pytest.warns(UserWarning, match="email"):
        assert detectors.warn_if_pii(rows) == ["email"]
    assert detectors.warn_if_pii(rows.filter("content = 'none'")) == []
