import datetime as dt

from lexiweave.streaming import frequencies
from lexiweave.streaming.counts import windowed_counts


def test_windows_close_behind_the_watermark(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=m), k) for m, k in ((0, "ADT"), (5, "adt "), (70, "x"), (400, "y"), (401, " "))]
    spark.createDataFrame(rows, "ts timestamp, kw_raw string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kw_raw string").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window_start.hour, r.term): r.freq for r in spark.table("counts").collect()}
    assert got == {(0, "adt"): 2, (1, "x"): 1}


def test_arriving_records_agree_with_the_whole(spark, tmp_path):
    """Re-exported records, repeated batches, late files and nulls: the frequencies of all records at once."""
    folder, files = str(tmp_path / "kept"), [[("1", "ADT"), ("1", "adt"), ("2", "x")], [("2", "x"), ("2", "y"), (None, "z"), ("3", None)], [("1", "ADT"), ("4", " "), ("3", "X")], []]
    frames = [spark.createDataFrame(f, "doc_id string, kw_raw string") for f in files]
    assert frequencies.kept_frequency(spark, folder).count() == 0
    for n, f in enumerate(frames):
        frequencies.take_batch(f, n, folder)
    frequencies.take_batch(frames[1], 1, folder)  # the second batch comes again
    want = {"adt": 2, "x": 2, "y": 1}
    assert {r.term: r.freq for r in frequencies.kept_frequency(spark, folder).collect()} == want
    assert {r.term: r.freq for r in frequencies.kept_frequency(spark, folder, ignore_case=True).collect()} == want | {"adt": 1}
    schema = frames[0].schema
    for n, f in enumerate(frames[:2]):
        f.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    follow = lambda: frequencies.follow(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    follow()
    frames[2].coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    follow()
    follow()
    assert {r.term: r.freq for r in frequencies.kept_frequency(spark, str(tmp_path / "s")).collect()} == want
