from __future__ import annotations

from pyspark.sql import functions as F

from affinis.streaming import state, sync

DATA = "/root/testdata/sf0.001"
COLUMNS = "session", "step", "hours", "node", "mass", "structural"


def warmed(spark):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    day = F.date_trunc("day", F.col("ts").cast("timestamp"))
    hours = F.unix_micros(day) / 3600000000
    return e.select(F.col("event_type").alias("session"), (day + F.expr("interval 1 day")).alias("ends"), (hours / 24).cast("long").alias("step"), hours.alias("hours"), (F.col("user_id") % 20).cast("string").alias("node"), (F.col("value") / 997).alias("mass"), (F.col("user_id") % 97 == 0).alias("structural"), "event_id")


def told(df):
    return sorted((r.session, r.step, round(r.surprise, 9), r.red, r.armed, r.remembered) for r in df.collect())


def test_stream_equals_batch_over_a_restart(spark, tmp_path):
    rows = warmed(spark).cache()
    bounds = [r[0] for r in rows.select(F.percentile_approx("ends", [0.4, 0.7]).alias("b")).select(F.explode("b")).collect()]
    source, out, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    last = rows.agg((F.max("ends") + F.expr("interval 9 days")).alias("ends")).select(F.lit("~").alias("session"), "ends", F.lit(10**6).cast("long").alias("step"), F.lit(0.0).alias("hours"), F.lit("x").alias("node"), F.lit(0.0).alias("mass"), F.lit(False).alias("structural"), F.lit(-1).cast("long").alias("event_id"))
    parts = [rows.where(F.col("ends") <= bounds[0]), rows.where((F.col("ends") > bounds[0]) & (F.col("ends") <= bounds[1])), rows.where(F.col("ends") > bounds[1]), last]
    conf = {"spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        q = state.gate(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None

    try:
        # The rows of each part come out of order, and a day's in two files.
        for k, part in enumerate(parts[:1]):
            for half in range(2):
                part.where(F.col("event_id") % 2 == half).coalesce(1).write.mode("append").parquet(source)
        run()
        early = told(spark.read.parquet(out))
        want = told(sync.gate(rows.select(*COLUMNS)))
        assert 0 < len(early) < len(want) and set(early) <= set(want)
        for part in parts[1:]:
            part.coalesce(1).write.mode("append").parquet(source)
        run()
        assert [x for x in told(spark.read.parquet(out)) if x[0] != "~"] == want
        assert any(x[3] for x in want) and any(not x[4] for x in want)
    finally:
        for k, v in conf.items():
            spark.conf.set(k, v)
