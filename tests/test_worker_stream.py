"""Workers as a stream: delays by streaks, leases that run out, the same from a replay."""

from pyspark.sql import functions as F

from loomwork.streaming import attempts, worker

EVENT = "worker_id string, content_uid string, s long, event string, retry_after double"


def played(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).select("worker_id", "content_uid", F.timestamp_seconds("s").alias("ts"), "event", "retry_after").coalesce(1).write.mode("append").json(str(folder / f"in/{i:03d}"))
    stream = spark.readStream.schema("worker_id string, content_uid string, ts timestamp, event string, retry_after double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(folder / "in"))
    return sorted(tuple(r) for r in attempts.drain(worker.run(stream, lease_seconds=100), "update").collect())


def test_worker_stream(spark, tmp_path):
    t = 1_700_000_000
    claim = lambda uid, s, w="w1": (w, uid, t + s, "claimed", None)
    first = [claim("a", 0), ("w1", "a", t + 1, "failed-retryable", None), claim("b", 2), ("w1", "b", t + 3, "failed-retryable", 500.0), claim("c", 4), ("w1", "c", t + 5, "failed-retryable", None), claim("x", 0, "w2"), ("w2", "y", t + 1, "succeeded", None)]
    second = [claim("d", 6), ("w1", "d", t + 7, "succeeded", None), claim("e", 8), ("w1", "e", t + 9, "failed-retryable", -3.0), claim("f", 10), ("w1", "f", t + 11, "failed-final", None)]
    third = [claim("z", 1000, "w3")]  # time goes on: the lease of x runs out
    fourth = [("w2", "x", t + 1001, "succeeded", None), claim("g", 1100), claim("u", 1000, "w4")]
    fifth = [claim("k", 2000)]  # that of g and u too, by their timers
    sixth = [claim("l", 2001)]
    got = played(spark, tmp_path / "one", [first, second, third, fourth, fifth, sixth])
    ms = lambda s: (t + s) * 1000
    want = [
        ("w1", "a", "failed-retryable", 1, 2.0, ms(1)),
        ("w1", "b", "failed-retryable", 2, 60.0, ms(3)),
        ("w1", "c", "failed-retryable", 3, 8.0, ms(5)),
        ("w1", "d", "succeeded", 0, 0.0, ms(7)),
        ("w1", "e", "failed-retryable", 1, 0.0, ms(9)),
        ("w1", "f", "failed-final", 0, 0.0, ms(11)),
        ("w2", "x", "lease-expired", 0, 0.0, ms(100)),
        ("w2", "x", "refused", 0, 0.0, ms(1001)),
        ("w2", "y", "refused", 0, 0.0, ms(1)),
        ("w1", "g", "lease-expired", 0, 0.0, ms(1200)),
        ("w3", "z", "lease-expired", 0, 0.0, ms(1100)),
        ("w4", "u", "lease-expired", 0, 0.0, ms(1100)),
    ]
    assert got == sorted(want)
    assert played(spark, tmp_path / "two", [first, second, third, fourth, fifth, sixth]) == got
