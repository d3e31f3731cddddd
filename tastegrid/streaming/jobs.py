"""Structured Streaming jobs: history, impressions, vectors and audio flags, kept up to date from events.

Keyed tables lie in BUCKETS by a hash of their key, each bucket in versions. A batch rewrites only the
buckets it touches, as the version of its number, so that a batch that is run again writes the same files;
of older versions the newest is kept. What a batch costs follows its own size and that of its buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tastegrid.functions.titles import has_audio
from tastegrid.operators.merging import day_masks, merge_days, upsert_history
from tastegrid.operators.vectors import fuse

BUCKETS = 32


def bucket_of(*keys: str) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def versions(spark: SparkSession, path: str, below: int | None = None) -> dict[int, list[int]]:
    """Bucket to its versions, newest first, from the names of the folders; at most BUCKETS entries."""
    fs, top = _files(spark, path)
    out: dict[int, list[int]] = {}
    for b in fs.listStatus(top) if fs.exists(top) else []:
        if (name := b.getPath().getName()).startswith("bucket="):
            own = sorted((int(v.getPath().getName()[8:]) for v in fs.listStatus(b.getPath()) if v.getPath().getName().startswith("version=")), reverse=True)
            out[int(name[7:])] = [v for v in own if below is None or v < below]
    return {b: v for b, v in out.items() if v}


def current(spark: SparkSession, path: str, buckets: list[int] | None = None, below: int | None = None) -> DataFrame | None:
    """The newest version of each bucket (of those asked for), or None where there is none."""
    found = versions(spark, path, below)
    paths = [f"{path}/bucket={b}/version={v[0]}" for b, v in sorted(found.items()) if buckets is None or b in buckets]
    return spark.read.option("basePath", path).parquet(*paths).drop("bucket", "version") if paths else None


def upsert(path: str, batch: DataFrame, n: int, keys: list[str], merge: Callable[[DataFrame | None, DataFrame], DataFrame]) -> list[int]:
    """Merge a batch's rows into the buckets of their keys and write these as version n; the buckets touched."""
    spark = batch.sparkSession
    touched = sorted(r["bucket"] for r in batch.select(bucket_of(*keys).alias("bucket")).distinct().collect())
    if touched:
        out = merge(current(spark, path, touched, below=n), batch).withColumns({"bucket": bucket_of(*keys), "version": F.lit(n)})
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
        fs, _ = _files(spark, path)
        for b, own in versions(spark, path, below=n).items():
            for v in own[1:] if b in touched else []:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}/version={v}"), True)
    return touched


def known(spark: SparkSession, path: str, n: int) -> None:
    """A batch after the first finds the table, or the state of the query and the table don't belong together."""
    fs, top = _files(spark, path)
    if n > 0 and not fs.exists(top):
        raise RuntimeError(f"batch {n} found no table in {path}: it was lost, or the checkpoint is of another one")


def start(stream: DataFrame, run: Callable[[DataFrame, int], None], path: str, checkpoint: str) -> StreamingQuery:
    def each(batch: DataFrame, n: int) -> None:
        known(batch.sparkSession, path, n)
        batch.persist()
        run(batch, n)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_history(events: DataFrame, path: str, checkpoint: str, delay: str = "2 days") -> StreamingQuery:
    """Watch events (event_id, owner, item_id, ts, source) to history: counts, last times and last sources, an event id once."""
    once = events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])

    def run(batch: DataFrame, n: int) -> None:
        delta = batch.groupBy("owner", "item_id").agg(F.count("*").alias("episodes_watched"), F.max("ts").alias("last_watched_at"), F.max_by("source", F.struct("ts", "source")).alias("source"))
        upsert(path, delta, n, ["owner"], lambda old, b: b if old is None else upsert_history(old, b, "owner", "item_id"))

    return start(once, run, path, checkpoint)


def stream_impressions(shown: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Shown items to distinct days; the day is in the key, so that the watermark lets state go."""
    days = shown.withColumn("day", F.date_trunc("day", "ts")).withWatermark("day", "2 days").dropDuplicates(["owner", "profile_id", "catalog_id", "item_id", "day"])
    out = days.select("owner", "profile_id", "catalog_id", "item_id", F.to_date("day").alias("seen_date"))
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_days(shown: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Shown items (owner, catalog_id, item_id, ts) to the days they were seen on, as masks that a batch is merged into.

    Days are counted from the masks (merging.count_days), not from events, and late or repeated events change nothing.
    """
    keys = ("owner", "catalog_id", "item_id")
    dated = shown.select(*keys, F.to_date("ts").alias("day"))

    def run(batch: DataFrame, n: int) -> None:
        upsert(path, day_masks(batch, "day", *keys), n, ["owner"], lambda old, b: b if old is None else merge_days(old.unionByName(b), *keys))

    return start(dated, run, path, checkpoint)


def stream_vectors(events: DataFrame, item_vectors: DataFrame, static: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Watch events to active vectors (path/active) and fused ones (path/final), for the profiles of a batch only.

    An item adds its vector once a profile: path/seen holds the pairs. static: (owner, feature, weight).
    """

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        pairs = batch.select("owner", "item_id").distinct()
        buckets = sorted(r["b"] for r in pairs.select(bucket_of("owner").alias("b")).distinct().collect())
        before = current(spark, f"{path}/seen", buckets, below=n)
        new = pairs if before is None else pairs.join(before, ["owner", "item_id"], "left_anti")
        delta = new.join(item_vectors, "item_id").groupBy("owner", "feature").agg(F.sum("weight").alias("weight"))
        upsert(f"{path}/active", delta, n, ["owner"], lambda old, b: b if old is None else old.unionByName(b).groupBy("owner", "feature").agg(F.sum("weight").alias("weight")))
        upsert(f"{path}/seen", pairs, n, ["owner"], lambda old, b: b if old is None else old.unionByName(b).distinct())
        owners = pairs.select("owner").distinct()
        own = lambda df: df.join(owners, "owner", "left_semi")
        counts = own(current(spark, f"{path}/seen", buckets)).groupBy("owner").agg(F.count("*").alias("n"))
        active = current(spark, f"{path}/active", buckets)
        final = fuse(own(static), own(active) if active is not None else delta, counts, "owner")
        upsert(f"{path}/final", final, n, ["owner"], lambda old, b: b if old is None else old.join(owners, "owner", "left_anti").unionByName(b))

    return start(events, run, path, checkpoint)


def stream_audio_flags(titles: DataFrame, aliases: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Stream titles (key, title, name, description, ts) to the last flag of each episode key and of the keys it is mapped to.

    aliases: (key, alias).
    """
    flags = titles.select("key", has_audio(F.col("title"), F.col("name"), F.col("description")).alias("has_lang"), "ts")
    last = lambda df: df.groupBy("key").agg(F.max_by("has_lang", F.struct("ts", "has_lang")).alias("has_lang"), F.max("ts").alias("ts"))

    def run(batch: DataFrame, n: int) -> None:
        own = last(batch)
        all_ = last(own.unionByName(own.join(aliases, "key").select(F.col("alias").alias("key"), "has_lang", "ts")))
        upsert(path, all_, n, ["key"], lambda old, b: b if old is None else last(old.unionByName(b)))

    return start(flags, run, path, checkpoint)
