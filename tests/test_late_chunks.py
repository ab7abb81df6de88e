import time

from palimpsest.streaming.rehydrate_stream import reframe

SCHEMA = "response_id string, leaf_path string, seq bigint, text string, eos boolean"


def test_a_chunk_after_idle_is_late(spark, tmp_path):
    source = str(tmp_path / "in")
    put = lambda *rows: spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(source)
    put(("r", "c", 0, "one ⟦S", False), ("r", "c", 1, "", False))
    chunks = spark.readStream.schema(SCHEMA).parquet(source)
    query = (
        reframe(chunks, idle_seconds=1).writeStream.format("memory").queryName("late_chunks").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    )

    def rows(n):
        end = time.monotonic() + 60
        while time.monotonic() < end:
            got = spark.table("late_chunks").collect()
            if len(got) >= n:
                return [(r.seq, r.text, r.verbatim, r.late) for r in got]
            time.sleep(0.3)
        return got

    try:
        assert rows(2) == [(0, "one ", False, False), (1, "⟦S", True, False)]
        put(("r", "c", 1, "again", False), ("r", "c", 2, "after", False), ("q", "c", 0, "new", True))
        got = rows(5)[2:]
        assert sorted(got) == [(0, "new", False, False), (1, "again", True, True), (2, "after", True, True)]
    finally:
        query.stop()
