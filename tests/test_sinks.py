"""The sink that holds every key once: broken off runs, repeats, the gate."""

import pytest
from pyspark.sql import functions as F

from lodestone.sources import sinks

SCHEMA = "id long, text string"


def deliver(spark, home, rows):
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.mode("append").parquet(f"{home}/in")


def run(spark, home, gate=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{home}/in")
    sinks.sink_once(stream, f"{home}/out", f"{home}/state", "id", gate).awaitTermination()


def held(spark, home):
    return sorted((r.id, r.text) for r in sinks.committed(spark, f"{home}/out", SCHEMA).collect())


def test_a_broken_off_run_leaves_every_key_once(spark, tmp_path, monkeypatch):
    home, rows = str(tmp_path), [(i, f"t{i}") for i in range(40)]
    deliver(spark, home, [*rows, (3, "t3"), (None, "x")])
    real, calls = sinks.exists, []

    def breaks(spark_, path):
        calls.append(path)
        if len(calls) == 2:  # after the first batch, while the second looks for what is there
            raise RuntimeError("lost")
        return real(spark_, path)

    monkeypatch.setattr(sinks, "exists", breaks)
    with pytest.raises(Exception, match="lost"):
        for _ in range(3):
            run(spark, home)
    some = held(spark, home)
    assert 0 < len(some) < 40
    monkeypatch.undo()
    # files of a try that was broken off after its rows were written, before its commit
    spark.createDataFrame([(100, "never"), (1, "t1")], SCHEMA).withColumn("batch", F.lit(50).cast("long")).write.mode("append").partitionBy("batch").parquet(f"{home}/out/rows")
    run(spark, home)
    run(spark, home)
    assert held(spark, home) == rows
    deliver(spark, home, [(39, "again"), (40, "t40")])
    run(spark, home)
    assert held(spark, home) == [*rows, (40, "t40")]


def test_the_same_batch_twice(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA)
    assert [sinks.put_once(df, 0, str(tmp_path), "id") for _ in range(2)] == [2, 2]
    assert sinks.put_once(df, 1, str(tmp_path), "id") == 0
    assert sorted((r.id, r.batch) for r in sinks.committed(spark, str(tmp_path), SCHEMA).collect()) == [(1, 0), (2, 0)]


def test_nothing_counts_that_does_not_pass_the_gate(spark, tmp_path):
    gate = F.col("text") == F.concat(F.lit("t"), F.col("id").cast("string"))
    put = lambda rows, batch: sinks.put_once(spark.createDataFrame(rows, SCHEMA), batch, str(tmp_path), "id", gate)
    assert put([(1, "t1")], 0) == 1
    for bad in ("t3", None):
        with pytest.raises(ValueError, match="1 of 2 rows"):
            put([(2, "t2"), (9, bad)], 1)
    assert [r.id for r in sinks.committed(spark, str(tmp_path), SCHEMA).collect()] == [1]
    assert put([(2, "t2"), (9, "t9")], 1) == 2
    assert sorted(r.id for r in sinks.committed(spark, str(tmp_path), SCHEMA).collect()) == [1, 2, 9]
