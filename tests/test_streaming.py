import datetime as dt

from pyspark.sql import functions as F

from adledger.streaming import tracker as stream

T0 = dt.datetime(2024, 1, 1)


def feed(spark, tmp_path):
    """A folder that grows by one file a micro-batch, as a stream of sightings."""
    schema = "url string, ts timestamp, is_read boolean"
    folder = tmp_path / "in"
    folder.mkdir()

    def add(*rows):
        df = spark.createDataFrame([(u, T0 + dt.timedelta(days=d), r) for u, d, r in rows], schema)
        df.coalesce(1).write.mode("append").parquet(str(folder))
    return add, lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_held_state_leaves_after_release(spark, tmp_path):
    add, source = feed(spark, tmp_path)
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    seen = []

    def run():
        held = stream.hold_release(source())
        query = (held.writeStream.trigger(availableNow=True).option("checkpointLocation", mark)
                 .format("parquet").option("path", out).start())
        query.awaitTermination()
        seen.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])

    def released():
        return {(r.url, r.how) for r in spark.read.parquet(out).collect()}

    add(("read", 0, False), ("late", 0, False), ("read", 1, True))
    run()
    assert released() == {("read", "read")} and seen[-1] > 0
    add(("tick", 12, True))
    run()
    assert ("late", "overdue") in released()
    add(("tock", 60, True))
    run()
    add(("tack", 120, True))
    run()
    # all that was released long ago is forgotten; only the newest key is still remembered
    assert released() == {("read", "read"), ("late", "overdue"), ("tick", "read"), ("tock", "read"), ("tack", "read")}
    left = (spark.read.format("statestore").option("path", mark).option("stateVarName", "held").load())
    assert {r.key.url for r in left.select("key").collect()} == {"tack"}


def test_a_key_forgotten_by_the_state_is_held_back_by_the_sink(spark, tmp_path):
    add, source = feed(spark, tmp_path)
    out, mark = str(tmp_path / "once"), str(tmp_path / "mark")
    for day in (0, 1, 200):
        add(("a", day, True), (f"b{day}", day, True))
        stream.append_unreported(stream.report_once(source().select("url", "ts")), out, mark, buckets=8)
    assert sorted(r.url for r in spark.read.parquet(out).collect()) == ["a", "b0", "b1", "b200"]


def test_a_batch_reads_the_history_of_its_buckets_alone(spark, tmp_path):
    add, source = feed(spark, tmp_path)
    out, mark = str(tmp_path / "once"), str(tmp_path / "mark")
    add(*[(f"u{i}", 0, True) for i in range(60)])
    stream.append_unreported(source().select("url", "ts"), out, mark, buckets=8)
    first = {p.name for p in (tmp_path / "once").iterdir() if p.name.startswith("bucket=")}
    assert len(first) == 8
    # history outside the batch's bucket can be unreadable and is never opened
    bucket = spark.range(1).select(stream.bucket_of(F.lit("u7"), 8).alias("b")).first().b
    for folder in (tmp_path / "once").iterdir():
        if folder.name.startswith("bucket=") and folder.name != f"bucket={bucket}":
            for file in folder.rglob("*.parquet"):
                file.write_bytes(b"torn")
    add(("u7", 1, True), ("u7", 2, True))
    stream.append_unreported(source().select("url", "ts"), out, mark, buckets=8)
    assert [r.url for r in spark.read.parquet(f"{out}/bucket={bucket}").where("url = 'u7'").collect()] == ["u7"]
