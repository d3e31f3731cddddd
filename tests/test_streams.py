"""Streams over several batches: the same as one batch over all, only touched buckets rewritten, no silent restart."""

import pytest
from pyspark.sql import functions as F

from tastegrid.operators.vectors import fuse
from tastegrid.sources.tables import shared_dir
from tastegrid.streaming import jobs as T


def batches(spark, path, rows, kind, run):
    """Each list of rows as a file, the query run to its end after each."""
    for r in rows:
        spark.createDataFrame(r, kind).coalesce(1).write.mode("append").parquet(f"{path}/in")
        run(spark.readStream.schema(kind).parquet(f"{path}/in")).awaitTermination()


KIND = "event_id long, owner long, item_id long, ts timestamp, source string"


def events(n, start=0):
    import datetime

    return [(i, i % 7, i % 5 + i // 40, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i), f"s{i % 3}") for i in range(start, start + n)]


def test_history(spark):
    path = shared_dir(spark, "t")
    batches(spark, path, [events(60), events(30, 50), [(500, 1, 1, *events(1)[0][3:])]], KIND, lambda s: T.stream_history(s, f"{path}/out", f"{path}/cp"))
    got = {(r.owner, r.item_id): (r.episodes_watched, r.source) for r in T.current(spark, f"{path}/out").collect()}
    all_ = {e[0]: e for e in [*events(80), (500, 1, 1, *events(1)[0][3:])]}.values()
    want = {}
    for e in sorted(all_, key=lambda e: (e[3], e[4])):
        n, _ = want.get((e[1], e[2]), (0, ""))
        want[e[1], e[2]] = (n + 1, e[4])
    assert got == want
    touched = spark.range(1).select(T.bucket_of(F.lit(1).cast("long")).alias("b")).first().b
    v = T.versions(spark, f"{path}/out")
    assert v[touched][0] > max(x[0] for b, x in v.items() if b != touched) and all(len(x) <= 2 for x in v.values())


def test_vectors(spark):
    path = shared_dir(spark, "t")
    own = spark.createDataFrame([(i, f"g:{i % 3}", 100.0) for i in range(9)] + [(i, f"k:{i}", 100.0) for i in range(9)], "item_id long, feature string, weight double")
    static = spark.createDataFrame([(o, "g:9", 100.0) for o in range(7)], "owner long, feature string, weight double")
    batches(spark, path, [events(40), events(60, 30)], KIND, lambda s: T.stream_vectors(s, own, static, f"{path}/out", f"{path}/cp"))
    pairs = spark.createDataFrame(events(90), KIND).select("owner", "item_id").distinct()
    active = pairs.join(own, "item_id").groupBy("owner", "feature").agg(F.sum("weight").alias("weight"))
    want = {(r.owner, r.feature): round(r.weight, 6) for r in fuse(static, active, pairs.groupBy("owner").agg(F.count("*").alias("n")), "owner").collect()}
    assert {(r.owner, r.feature): round(r.weight, 6) for r in T.current(spark, f"{path}/out/final").collect()} == want


def test_lost_table(spark):
    path = shared_dir(spark, "t")
    batches(spark, path, [events(10)], KIND, lambda s: T.stream_history(s, f"{path}/out", f"{path}/cp"))
    with pytest.raises(Exception, match="found no table"):
        batches(spark, path, [events(10, 20)], KIND, lambda s: T.stream_history(s, f"{path}/elsewhere", f"{path}/cp"))


def test_days(spark):
    """Days over batches with late and repeated events, before and after 1970, equal those of all events at once."""
    import datetime

    from tastegrid.operators.merging import count_days

    path = shared_dir(spark, "t")
    at = lambda n: datetime.datetime(1969, 11, 1) + datetime.timedelta(hours=7 * n)
    rows = [(k % 3, "c", k % 2, at(k * 5 % 97)) for k in range(200)]
    batches(spark, path, [rows[:90], rows[60:150], rows[150:]], "owner long, catalog_id string, item_id long, ts timestamp", lambda s: T.stream_days(s, f"{path}/out", f"{path}/cp"))
    got = {(r.owner, r.item_id): r.days for r in count_days(T.current(spark, f"{path}/out"), "owner", "catalog_id", "item_id").collect()}
    want = {}
    for o, _, i, t in rows:
        want.setdefault((o, i), set()).add(t.date())
    assert got == {k: len(v) for k, v in want.items()}
