import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from rawharbor.streaming.landed import load_landed, read_accepted, read_verdicts
from rawharbor.streaming.rate import WINDOWS_PER_BLOCK, rate_audit, rolling_rate, rolling_rate_stream

SCHEMA = "id bigint, note string, x double, y double, z double, w double"


def land(path, name, rows):
    with open(os.path.join(path, name), "w") as out:
        out.write("id,note,x,y,z,w\n" + "".join(rows))


def run(spark, source, table, progress):
    query = load_landed(spark, source, spark.createDataFrame([], SCHEMA).schema, table, progress, files_per_batch=1)
    query.awaitTermination()


def test_incremental_load(spark, tmp_path):
    source, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    os.mkdir(source)
    land(source, "1.csv", ["1,a,1,1,1,1\n", '2,"two\nlines",1,,,\n'])
    land(source, "2.csv", [",,,,,\n"] * 9 + ["3,c,1,1,1,1\n"])
    run(spark, source, table, progress)
    assert {r["status"]: r["rows"] for r in read_verdicts(spark, table).collect()} == {"passed": 2, "rejected": 10}
    assert {r["note"] for r in read_accepted(spark, table).collect()} == {"a", "two\nlines"}
    assert spark.read.parquet(f"{table}/rows").count() == 12

    land(source, "3.csv", ["4,d,1,1,1,1\n"])
    run(spark, source, table, progress)
    assert {r["id"] for r in read_accepted(spark, table).collect()} == {1, 2, 4}


def test_batch_delivered_again_replaces_itself(spark, tmp_path):
    source, table, progress = (str(tmp_path / n) for n in ("in", "table", "progress"))
    os.mkdir(source)
    for i in range(3):
        land(source, f"{i}.csv", [f"{i},n,1,1,1,1\n"])
    run(spark, source, table, progress)
    # Lose the note that the last batch was finished, as a failed driver would.
    for commit in glob.glob(f"{progress}/commits/*2*") + glob.glob(f"{progress}/commits/.2*"):
        os.remove(commit)
    run(spark, source, table, progress)
    assert sorted(r["id"] for r in read_accepted(spark, table).collect()) == [0, 1, 2]
    assert read_verdicts(spark, table).count() == 3


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_rate_audit_on_table_and_stream(spark, tmp_path, kind):
    base = F.lit("2024-01-01 00:00:00").cast(kind)
    rows = spark.range(40).select(
        (base + F.make_dt_interval(secs=F.when(F.col("id") < 12, 0.5).otherwise(F.col("id") / 2))).alias("ts"),
        F.when(F.col("id") < 11, "a").otherwise("b").alias("agent"),
    )
    flagged = rate_audit(rows, "ts", 10).collect()
    assert [r["requests"] for r in flagged] == [12]
    assert [tuple(r)[1:] for r in rate_audit(rows, "ts", 10, by=["agent"]).collect()] == [("a", 11)]

    path = str(tmp_path / "requests")
    rows.write.parquet(path)
    # A later row moves the watermark past the flagged window.
    rows.limit(1).select((F.col("ts") + F.expr("interval 1 hour")).alias("ts"), "agent").write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    with pytest.raises(ValueError, match="how late"):
        rate_audit(stream, "ts", 10)
    query = (
        rate_audit(stream, "ts", 10, by=["agent"], late="2 hours").writeStream.outputMode("update").format("memory").queryName(f"rates_{kind}")
        .option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    counts = {(r["agent"], r["window_start"]): r["requests"] for r in spark.table(f"rates_{kind}").orderBy("requests").collect()}
    assert dict(spark.table(f"rates_{kind}").dtypes)["window_start"] == kind
    assert [(agent, n) for (agent, _), n in counts.items()] == [("a", 11)]


def bursts(spark, kind, within):
    """Requests in bursts, many of them over borders of seconds and of blocks."""
    rng, width = random.Random(4), within * WINDOWS_PER_BLOCK
    rows = []
    for block in range(1, 5):
        for _ in range(6):
            middle = block * width + rng.choice([0, rng.randrange(width)])
            rows += [(middle + rng.randrange(-within, within), rng.choice("ab")) for _ in range(rng.randrange(2, 14))]
    df = spark.createDataFrame(rows, "at bigint, agent string")
    return rows, df.select(F.timestamp_micros("at").cast(kind).alias("ts"), "agent")


def brute_rolling(rows, limit, within, by):
    out = set()
    for at, agent in rows:
        n = sum(at - within < other <= at and (not by or agent == a) for other, a in rows)
        if n > limit:
            out.add((at, agent if by else None, n))
    return out


@pytest.mark.parametrize("by", [[], ["agent"]])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_rolling_rate(spark, kind, by):
    rows, df = bursts(spark, kind, 1_000_000)
    found = rolling_rate(df, "ts", 5, by=by)
    assert dict(found.dtypes)["ts"] == kind
    got = {(r["at"], r["agent"] if by else None, r["requests"]) for r in found.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp"))).collect()}
    assert got == brute_rolling(rows, 5, 1_000_000, by) and got
    assert rolling_rate(df.limit(0), "ts", 5, by=by).collect() == []


def test_rolling_rate_of_a_stream_equals_the_table_after_a_restart(spark, tmp_path):
    rows, df = bursts(spark, "timestamp", 1_000_000)
    path, out, progress = (str(tmp_path / n) for n in ("requests", "out", "progress"))
    df.repartition(3).write.parquet(path)
    end = df.limit(1).select(F.timestamp_micros(F.lit(10**12)).alias("ts"), F.lit("z").alias("agent"))
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run():
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
        found = rolling_rate_stream(stream, "ts", 5, "2 hours", by=["agent"])
        found.writeStream.format("parquet").option("checkpointLocation", progress).trigger(availableNow=True).start(out).awaitTermination()

    try:
        run()  # half of the state waits for its timers
        end.coalesce(1).write.mode("append").parquet(path)
        run()
    finally:
        spark.conf.set(provider, before) if before else spark.conf.unset(provider)
    got = {(r["at"], r["agent"], r["requests"]) for r in spark.read.parquet(out).withColumn("at", F.unix_micros("ts")).collect()}
    assert got == brute_rolling(rows, 5, 1_000_000, ["agent"])
