from recallforge.operators import sessions
from recallforge.streaming import sessions as live


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", i, "user" if i % 3 else "assistant", f"a{i}") for i in range(17)] + [("b", i, "user", f"b{i}") for i in range(20)]
    spark.createDataFrame(rows, "session string, turn bigint, role string, text string").write.parquet(str(tmp_path / "in"))
    turns = spark.readStream.schema("session string, turn bigint, role string, text string").parquet(str(tmp_path / "in"))
    q = live.offload(turns, forced=True).writeStream.format("memory").queryName("exchanges_live").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.session, r.xid, r.turn_lo, r.turn_hi, r.q, r.a) for r in spark.table("exchanges_live").collect()}
    batch = sessions.exchanges(spark.createDataFrame(rows, "session string, turn bigint, role string, text string"))
    assert got == {(r.session, r.xid, r.turn_lo, r.turn_hi, r.q, r.a) for r in batch.collect()}


def test_debounce():
    assert not live.due(0, 999) and not live.due(3, 5) and live.due(10, 0) and live.due(1, 60)
