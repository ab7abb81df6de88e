import pytest
from pyspark.sql import functions as F

from palimpsest.operators.ruleset import Rule, Ruleset, Term
from palimpsest.sources import vault_store
from palimpsest.sources.vault_store import commit_batch, compact, live_batches, read_vault, unsealable
from palimpsest.streaming.mask_stream import VaultMasker, mask_session_stream

VAULT = "scope_key string, id bigint, original string, ty string, first_seen bigint, uses bigint"
SECRET = "5a" * 32


def entries(spark, *rows):
    return spark.createDataFrame([(s, i, o, "T", 0, 1) for s, i, o in rows], VAULT)


def seen(df):
    return {(r.scope_key, r.id, r.original) for r in df.collect()}


def test_compaction_keeps_the_newest_entries(spark, tmp_path):
    path = str(tmp_path / "v")
    commit_batch(entries(spark, ("s", 0, "a"), ("t", 0, "b")), path, 0, "pw")
    commit_batch(entries(spark, ("s", 0, "a2"), ("s", 1, "c")), path, 1, "pw")
    commit_batch(entries(spark, ("u", 0, "d")), path, 2, "pw")
    want = {("s", 0, "a2"), ("t", 0, "b"), ("s", 1, "c"), ("u", 0, "d")}
    assert seen(read_vault(spark, path, "pw")) == want
    compact(spark, path, 1)
    assert {r.batch_id for r in live_batches(spark, path).collect()} == {1, 2}
    assert seen(read_vault(spark, path, "pw")) == want and unsealable(spark, path, "pw").count() == 0
    commit_batch(entries(spark, ("u", 0, "e")), path, 2, "pw")
    commit_batch(entries(spark, ("u", 1, "f")), path, 3, "pw")
    assert seen(read_vault(spark, path, "pw")) == want - {("u", 0, "d")} | {("u", 0, "e"), ("u", 1, "f")}
    assert seen(read_vault(spark, path, "pw", before_batch=2)) == {w for w in want if w[0] != "u"}


def test_a_batch_without_its_line_is_not_read(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "v")
    commit_batch(entries(spark, ("s", 0, "a")), path, 0)

    def cut_off(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(vault_store, "_exists", cut_off)
        with pytest.raises(RuntimeError):
            commit_batch(entries(spark, ("s", 0, "half")), path, 1)
    assert seen(read_vault(spark, path)) == {("s", 0, "a")}
    commit_batch(entries(spark, ("s", 0, "whole")), path, 1)
    assert seen(read_vault(spark, path)) == {("s", 0, "whole")}


def test_only_buckets_of_the_scopes_are_read(spark, tmp_path):
    path = str(tmp_path / "v")
    commit_batch(entries(spark, *[(f"s{i}", 0, f"o{i}") for i in range(300)]), path, 0)
    some = read_vault(spark, path, scopes=spark.createDataFrame([("s7",), ("s8",)], "s string"))
    assert seen(some) == {("s7", 0, "o7"), ("s8", 0, "o8")}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    files = read_vault(spark, path, scopes=["s7"]).inputFiles()
    assert 0 < len({f.split("bucket=")[1].split("/")[0] for f in files if "bucket=" in f}) < 64 or not files


def test_a_stream_without_sessions_goes_on(spark, tmp_path):
    source, out, vault = (str(tmp_path / n) for n in ("in", "out", "vault"))
    schema = "row_id string, s string, turn bigint, text string"
    rows = [("r1", None, 0, "a@b.co term3x"), ("r2", None, 1, "a@b.co"), ("r3", "s", 0, "a@b.co"), ("r4", "s", 1, None)]
    spark.createDataFrame(rows, schema).write.parquet(source)
    rules = Ruleset((Rule("email", "EMAIL", r"[\w.]+@[\w.]+", 50),))
    stream = spark.readStream.schema(schema).parquet(source)
    masked = mask_session_stream(stream, rules, SECRET, "row_id", "s", "turn", ttl_seconds=None)
    query = masked.writeStream.format("memory").queryName("no_session").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("no_session").collect()
    assert len(got) == 4 and all("@" not in (r.masked or "") for r in got)
    assert len({r.masked.split(" ")[0] for r in got if r.row_id != "r4"}) == 3
    many = Ruleset(rules.rules, tuple(Term(f"term{i}x", "T", 5) for i in range(600)))
    glossary = spark.createDataFrame([(0, "nothing", "N", 1, None)], "term_ord long, term string, ty string, priority int, tenant string")
    step = VaultMasker(many, SECRET, vault, out, ["row_id"], "s", ["turn"], glossary=glossary)
    batch = spark.createDataFrame(rows, schema)
    for _ in range(2):
        step(batch, 0)
    step(batch.withColumn("row_id", F.concat("row_id", F.lit("x"))), 1)
    kept = {r.row_id: r.masked for r in spark.read.parquet(out).collect()}
    assert len(kept) == 8 and all("@" not in (m or "") and "term" not in (m or "") for m in kept.values())
    assert kept["r3"] == kept["r3x"]
