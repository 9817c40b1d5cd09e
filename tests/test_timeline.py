"""Timelines: worked by hand, and streams in several batches against tables."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbago.plans import registry
from plumbago.streaming import timeline as T

SF = "/root/testdata/sf0.001"
FRAMES = "source string, at timestamp, signal double, sharp boolean, text string"


def plain(v):
    return None if v is None or (isinstance(v, float) and math.isnan(v)) else v


def rows_of(df):
    return sorted(tuple(map(plain, r)) for r in df.orderBy("source", "end_s", "number").collect())


def frames(spark, rows):
    made = spark.createDataFrame(rows, "source string, s double, signal double, sharp boolean, text string")
    return made.withColumn("at", F.timestamp_micros((F.col("s") * 1e6).cast("long"))).drop("s")


HAND = [("a", t, 0.5, True, "one") for t in (0.0, 1.0, 6.0)] + [("a", 7.0 + k, 0.9, True, "two") for k in range(4)] + [("a", 11.0, 0.9, True, "three"), ("a", 20.0, 0.1, True, "one"), ("a", 21.0, 0.1, True, "one"), ("a", 22.0, 0.1, True, "one")]
HAND += [("a", 30.0, 0.2, True, None), ("a", 31.0, 0.2, False, None), ("a", 32.0, 0.2, True, None), ("a", 33.0, 0.21, True, None), ("a", 34.0, 0.2, True, None), ("a", 900.0, 0.2, True, "one"), ("b", 5.0, 0.3, False, None), (None, 5.0, 0.3, True, None), ("b", None, 0.3, True, None), ("b", 6.0, None, True, None)]
WANT = [
    ("a", "slide", 0, 0.0, 0.0, 0.5), ("a", "slide", 1, 0.0, 7.0, 0.9),  # at 7, 8, 9
    ("a", "slide", 2, 7.0, 32.0, 0.2),  # a text seen before is none, a blurred frame begins anew
    ("a", "end", 3, None, 34.0, None), ("a", "slide", 0, 900.0, 900.0, 0.2), ("a", "end", 1, None, 900.0, None),  # a pause
    ("b", "end", 0, None, 6.0, None),
]


def key(r):
    return tuple((x is None, str(x)) for x in r)


def test_by_hand(spark):
    out = T.timeline(frames(spark, HAND).repartition(3))
    assert sorted((tuple(map(plain, r)) for r in out.collect()), key=key) == sorted(WANT, key=key)
    assert T.timeline(frames(spark, HAND[:0])).count() == 0
    every = T.timeline(frames(spark, [("a", float(t), 0.5 if t < 6 else 0.9, True, None) for t in range(12)]), T.Rules(every=2.0)).where("kind = 'slide' and number = 1").collect()
    assert [(r["start_s"], r["end_s"]) for r in every] == [(0.0, 6.0)]  # at 6, 8, 10


def test_every_timeline_of_the_events_ends(spark):
    got = registry.QUERIES["slide_timeline"](spark, SF)
    ends = sorted((r["source"], round(r["end_s"], 3)) for r in got.where("kind = 'end'").collect())
    want = duckdb.sql(f"""WITH e AS (SELECT user_id::VARCHAR AS source, epoch_us(ts::TIMESTAMP) / 1e6 AS s FROM '{SF}/events.parquet'), g AS (SELECT *, lead(s) OVER (PARTITION BY source ORDER BY s) AS later FROM e)
    SELECT source, round(s, 3) FROM g WHERE later IS NULL OR later - s > 86400.0 ORDER BY 1, 2""").fetchall()
    assert ends == sorted(want)


@pytest.mark.parametrize("batches", [4])
def test_a_stream_gives_the_rows_of_the_table(spark, tmp_path, batches):
    from plumbago.plans.registry import _frames

    rules = T.Rules(gap=60.0, stable=2, tolerance=25.0, idle=86400.0)
    table = _frames(spark, SF).select("source", "at", "signal", "sharp", "text")
    last = table.agg(F.max("at").alias("at")).select(F.lit("later").alias("source"), (F.col("at") + F.expr("interval 30 days")).alias("at"), F.lit(1.0).alias("signal"), F.lit(True).alias("sharp"), F.lit(None).cast("string").alias("text"))
    whole = table.unionByName(last)
    rows = whole.orderBy("at").collect()
    size = -(-len(rows) // batches)
    for k in range(batches):
        spark.createDataFrame(rows[k * size : (k + 1) * size], whole.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = T.timeline(stream, rules).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((tuple(map(plain, r)) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=key)
    want = sorted((tuple(map(plain, r)) for r in T.timeline(whole, rules).collect() if r["source"] != "later" or r["kind"] == "slide"), key=key)
    assert got == want and sum(r[1] == "end" for r in got) >= table.select("source").distinct().count()
