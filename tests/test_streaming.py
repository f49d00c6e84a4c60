"""The same rows as a stream and as a batch give the same tables."""

from pyspark.sql import functions as F

from lexforge.operators import dedup, rollup
from lexforge.streaming import feed


def test_append(spark, tmp_path):
    rows = [(i, f"u{i % 7}", f"h{i % 5}") for i in range(20)]
    d = spark.createDataFrame(rows, "seq int, canonical_url string, text_sha256 string").coalesce(1)
    for k in range(4):
        d.where(f"seq div 5 = {k}").write.mode("append").parquet(f"{tmp_path}/in")
    s = feed.source(spark, f"{tmp_path}/in", d.schema)
    feed.append_archive(s, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    want = {r["seq"] for r in dedup.append(d).where("stored").collect()}
    got = {r["seq"] for r in spark.read.schema(d.schema).parquet(*[str(p) for p in (tmp_path / "out").iterdir()]).collect()}
    assert got == want
    feed.append_archive(s, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()  # nothing new: nothing changes
    assert spark.read.schema(d.schema).parquet(*[str(p) for p in (tmp_path / "out").iterdir()]).count() == len(want)


def test_rollup_ring_and_job(spark, tmp_path):
    rows = [(i, f"s{i % 3}", ("stored", "duplicate", "fetch_failed", "blocked")[i % 4], i if i % 8 != 3 else None) for i in range(40)]
    d = spark.createDataFrame(rows, "seq long, site string, status string, source_bytes long").withColumn("text_bytes", F.col("source_bytes")).withColumn("compressed_bytes", F.lit(1).cast("long"))
    d.write.parquet(f"{tmp_path}/e")
    job = feed.Job()
    assert job.state() == "idle"
    job.start(lambda: feed.live_rollup(feed.source(spark, f"{tmp_path}/e", d.schema), "sites"))
    job.query.awaitTermination()
    assert job.state() == "done"
    assert sorted(map(tuple, spark.table("sites").collect())) == sorted(map(tuple, rollup.site_rollup(d).collect()))
    d.createOrReplaceTempView("feed_log")
    assert [r["seq"] for r in feed.ring(spark, "feed_log", 3).collect()] == [39, 38, 37]


def test_windows(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    d.write.parquet(f"{tmp_path}/ev")
    q = feed.windowed(feed.source(spark, f"{tmp_path}/ev", d.schema)).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("w").count() >= 0
