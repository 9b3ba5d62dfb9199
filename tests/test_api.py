import pytest

from recallforge import cli
from recallforge.api import Rack, remember


@pytest.fixture
def store(spark, tmp_path):
    r = Rack(spark, str(tmp_path / "rack"), routes={"skill": "skills"})
    assert r.add(spark.createDataFrame([("The auth middleware checks tokens", "auth middleware"), ("Deploy on ARM64", "arm64 deploy rule")], "content string, key string"), kind="fact") == 2
    assert r.teach("Sort with merges", "sorting lists", kind="skill") == 1
    return r


def test_life_of_a_rack(spark, store, tmp_path):
    assert {h.cartridge for h in store.search(["sorting lists"]).collect()} == {"skills"}
    assert store.search(["auth midleware"]).first()["mode"] == "fuzzy"
    assert store.teach("New rules for tokens", "auth middleware") == 1
    assert store.search(["auth middleware"], top_k=1).first()["content"] == "New rules for tokens"
    newest = store.search(["auth middleware"], top_k=1).first()["entry_id"]
    store.delete([newest])
    assert store.search(["auth middleware"], top_k=1).first()["content"] == "The auth middleware checks tokens"
    store.compact()
    assert store.entries().count() == 3 and {r.cartridge: r.entries for r in store.stats().collect()} == {"main": 2, "skills": 1}
    store.export(str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    assert store.diff(Rack(spark, str(tmp_path / "none"))).filter("status = 'removed'").count() == 3


def test_a_failed_compaction_loses_nothing(store, monkeypatch):
    from recallforge import api

    def fail(*_):
        raise RuntimeError

    for _ in range(2):
        with monkeypatch.context() as m:
            m.setattr(api.rack, "compact_shards", fail)
            with pytest.raises(RuntimeError):
                store.compact()
        assert store.entries().count() == 3
    store.spark.range(1).write.parquet(f"{store.path}/v1/entries/half")  # what a lost driver leaves behind
    assert store.entries().count() == 3
    store.compact()
    store.compact()
    assert store.entries().count() == 3 and store._version() == 2 and store.teach("more", "k") == 1


def test_full_cartridges_are_split_as_they_are_written(spark, tmp_path):
    r = Rack(spark, str(tmp_path / "rack"), max_entries=3)
    rows = lambda *c: spark.createDataFrame([(x,) for x in c], "content string").coalesce(1)
    counts = lambda: {x.cartridge: x.entries for x in r.stats().collect()}
    assert r.add(rows("one", "two")) == 2 and counts() == {"main": 2}
    assert r.add(rows("three", "four")) == 2 and counts() == {"main": 1, "main__2": 3}
    assert {x.content for x in r.entries().filter("cartridge = 'main__2'").collect()} == {"one", "two", "three"}
    assert r.add(rows(*[f"number {i}" for i in range(7)])) == 7 and counts() == {"main": 2, "main__2": 3, "main__3": 3, "main__4": 3}
    assert r.search(["one"], top_k=1, cartridges=["main"]).first()["cartridge"] == "main__2"
    r.compact()
    assert counts() == {"main": 11}


def test_cartridges_are_created_registered_unloaded_and_dropped(spark, store, tmp_path):
    names = lambda: {x.cartridge for x in store.entries().select("cartridge").distinct().collect()}
    assert store.create("main").entries().count() == 3  # what exists stays
    assert store.unload("skills") and not store.unload("skills") and names() == {"main"}
    store.compact()  # what is hidden is compacted, not lost
    assert store.create("skills") is store and names() == {"main", "skills"}
    assert not store.drop("none") and store.drop("skills", files=True) and names() == {"main"}
    assert store.create("skills").entries().count() == 2
    with pytest.raises(FileNotFoundError):
        store.register("old", str(tmp_path / "none"))
    store.create("main", overwrite=True)
    assert store.entries().count() == 0


def test_sessions_are_swapped(spark, store):
    store.teach("What was said", "first talk", cartridge="session")
    store.teach("What was unsaid", "other talk", cartridge="session")
    store.delete([store.search(["other talk"], top_k=1).first()["entry_id"]])
    path = store.swap()
    assert store.entries().count() == 3 and store.search(["first talk"], top_k=1, cartridges=["session"]).isEmpty()
    store.register("talks", path)
    assert [h.content for h in store.search(["first talk"], top_k=1).collect()] == ["What was said"]
    assert store.search(["other talk"], top_k=1).filter("mode = 'exact'").isEmpty()  # what was deleted stays so
    assert store.drop("talks", files=True) and store.register("talks", path).entries().count() == 4  # a registered folder stays


def test_memory_goes_into_the_system_message(store):
    said = [{"role": "user", "content": "auth middleware"}]
    assert "checks tokens" in remember(said, store)[0]["content"] and remember(said, store)[1:] == said
    with_system = [{"role": "system", "content": "be kind"}, *said]
    assert remember(with_system, store)[0]["content"].startswith("be kind\n\nRelevant memory")
    assert remember([{"role": "user", "content": "zzzz qqqq"}], store) == [{"role": "user", "content": "zzzz qqqq"}]


def test_command_line(spark, tmp_path, capsys):
    rack = ["--rack", str(tmp_path / "r")]
    f = tmp_path / "facts.txt"
    f.write_text("# note\nred widgets are cheap\nblue gadgets are rare\n")
    assert cli.main([*rack, "ingest", str(f)]) == 0 and cli.main([*rack, "search", "red widgets are cheap"]) == 0
    assert "red widgets are cheap" in capsys.readouterr().out
