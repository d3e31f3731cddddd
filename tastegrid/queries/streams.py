"""Queries of the streaming jobs, run to the end of the given files, and of readers and writers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.queries import query
from tastegrid.queries.discovery import discovered
from tastegrid.sources import domain as D
from tastegrid.sources import tables as S
from tastegrid.streaming import jobs as T


def events(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of files."""
    kind = D.read(spark, d, "events").schema
    return spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def watched(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).filter(F.col("event_type").isin("click", "purchase")).select("event_id", F.col("user_id").cast("long").alias("owner"), (F.col("event_id") % 50 + 1).alias("item_id"), "ts", F.col("event_type").alias("source"))


def finished(spark: SparkSession, name: str, start) -> str:
    path = S.shared_dir(spark, name)
    q = start(f"{path}/data", f"{path}/checkpoint")
    q.awaitTermination()
    return f"{path}/data"


@query("t01_stream_history", "SELECT CAST(user_id AS BIGINT) AS owner, event_id % 50 + 1 AS item_id, count(*) AS episodes_watched, epoch(max(ts)) AS last_watched, arg_max(event_type, ts) AS source FROM events WHERE event_type IN ('click', 'purchase') GROUP BY ALL")
def t01(spark, d):
    path = finished(spark, "history", lambda p, c: T.stream_history(watched(spark, d), p, c))
    return T.current(spark, path).select("owner", "item_id", "episodes_watched", (F.unix_micros("last_watched_at").cast("double") / 1e6).alias("last_watched"), "source")


@query("t02_stream_impressions", "SELECT owner, profile_id, catalog_id, item_id, CAST(seen_date AS VARCHAR) AS seen_date FROM (SELECT DISTINCT * FROM impressions)", ("impressions",))
def t02(spark, d):
    k = F.get_json_object("props", "$.k").cast("long")
    shown = events(spark, d).select(F.col("user_id").cast("long").alias("owner"), F.lit("global").alias("profile_id"), F.concat(F.lit("c"), (k % 2).cast("string")).alias("catalog_id"), (k % 10 + 1).alias("item_id"), "ts")
    path = finished(spark, "impressions", lambda p, c: T.stream_impressions(shown, p, c))
    return spark.read.parquet(path).withColumn("seen_date", F.col("seen_date").cast("string"))


@query("t02_stream_days", "SELECT owner, catalog_id, item_id, count(DISTINCT seen_date) AS days FROM impressions GROUP BY ALL", ("impressions",))
def t02_days(spark, d):
    from tastegrid.operators.merging import count_days

    k = F.get_json_object("props", "$.k").cast("long")
    shown = events(spark, d).select(F.col("user_id").cast("long").alias("owner"), F.concat(F.lit("c"), (k % 2).cast("string")).alias("catalog_id"), (k % 10 + 1).alias("item_id"), "ts")
    path = finished(spark, "days", lambda p, c: T.stream_days(shown, p, c))
    return count_days(T.current(spark, path), "owner", "catalog_id", "item_id")


@query("t03_stream_vectors", """
WITH p AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS owner, event_id % 50 + 1 AS item_id FROM events WHERE event_type IN ('click', 'purchase')), v AS (SELECT owner, feature, sum(weight) AS weight FROM p JOIN item_vector USING (item_id) GROUP BY ALL), n AS (SELECT owner, count(*) AS n FROM p GROUP BY ALL),
j AS (SELECT owner, feature, v, s FROM (SELECT owner, feature, weight / sum(weight) OVER (PARTITION BY owner) AS v FROM v) FULL JOIN (SELECT owner, feature, weight / sum(weight) OVER (PARTITION BY owner) AS s FROM static_raw WHERE owner IN (SELECT owner FROM n)) USING (owner, feature))
SELECT owner, feature, round(100.0::DOUBLE * (a * coalesce(v, 0) + (1 - a) * coalesce(s, 0)), 6) AS weight FROM j JOIN (SELECT owner, least(n / 50.0::DOUBLE, 1.0::DOUBLE) * 0.85::DOUBLE AS a FROM n) USING (owner)""", ("item_vector", "static_raw"))
def t03(spark, d):
    from tastegrid.operators.vectors import item_vector
    from tastegrid.queries.vectors import a01

    own = item_vector(D.item_features(spark, d))
    path = finished(spark, "vectors", lambda p, c: T.stream_vectors(watched(spark, d), own, a01(spark, d), p, c))
    return T.current(spark, f"{path}/final").withColumn("weight", F.round("weight", 6))


@query("t04_stream_audio_flags", """
WITH f AS (SELECT event_id % 97 AS k, arg_max(event_type IN ('view', 'click'), ts) AS has_lang FROM events GROUP BY 1)
SELECT 'e:' || k AS key, has_lang FROM f UNION ALL SELECT 'alt:' || k, has_lang FROM f WHERE k % 2 = 0 UNION ALL SELECT 'tt' || k, has_lang FROM f WHERE k % 4 = 0""")
def t04(spark, d):
    title = F.when(F.col("event_type").isin("view", "click"), "Film ITA ENG").otherwise("Film SUB ITA")
    k = (F.col("event_id") % 97).cast("string")
    t = events(spark, d).select(F.concat(F.lit("e:"), k).alias("key"), title.alias("title"), F.lit("").alias("name"), F.lit(None).cast("string").alias("description"), "ts")
    names = D.read(spark, d, "events").select((F.col("event_id") % 97).alias("k")).distinct().filter("k % 2 = 0")
    one = lambda p, n: names.filter(f"k % {n} = 0").select(F.concat(F.lit("e:"), F.col("k").cast("string")).alias("key"), F.concat(F.lit(p), F.col("k").cast("string")).alias("alias"))
    path = finished(spark, "flags", lambda p, c: T.stream_audio_flags(t, one("alt:", 2).unionByName(one("tt", 4)), p, c))
    return T.current(spark, path).select("key", "has_lang")


@query("s01_read_items", "SELECT item_id, page, pos FROM (SELECT l_partkey + 1 AS item_id, l_linenumber AS page, l_orderkey AS pos FROM lineitem) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY page, pos) = 1")
def s01(spark, d):
    return S.read_items(D.read(spark, d, "lineitem").select((F.col("l_partkey") + 1).alias("item_id"), F.col("l_linenumber").alias("page"), F.col("l_orderkey").alias("pos")))


@query("s03_upsert_features", "SELECT item_id, media_type, CASE WHEN item_id % 3 = 0 THEN vote_count + 1 ELSE vote_count END AS vote_count FROM item_features", ("item_features",))
def s03(spark, d):
    f = D.item_features(spark, d).select("item_id", "media_type", "vote_count")
    return S.upsert_features(f, f.filter("item_id % 3 = 0").withColumn("vote_count", F.col("vote_count") + 1))


@query("s04_refresh_votes", "SELECT item_id, CASE WHEN item_id % 4 = 0 THEN 7.5::DOUBLE WHEN item_id % 4 = 1 THEN 8.25::DOUBLE ELSE vote_average END AS vote_average, CASE WHEN item_id % 4 = 0 THEN 9 ELSE vote_count END AS vote_count FROM item_features", ("item_features",))
def s04(spark, d):
    f = D.item_features(spark, d).select("item_id", "vote_average", "vote_count")
    i = F.col("item_id")
    n = f.filter("item_id % 4 < 2").select((i).alias("item_id"), F.when(i % 4 == 0, 7.5).alias("vote_average"), F.when(i % 4 == 1, "8.25").alias("rating"), F.when(i % 4 == 0, 9).cast("long").alias("vote_count"))
    return S.refresh_votes(f, n.unionByName(n.withColumn("item_id", -i)))


@query("s05_read_history_feed", "SELECT o_custkey AS owner, coalesce(m, s) AS item_id, CASE WHEN m IS NOT NULL THEN 'movie' ELSE 'tv' END AS media_type, count(*) AS n FROM (SELECT o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS m, CASE WHEN o_orderkey % 3 = 1 THEN o_orderkey END AS s FROM orders) WHERE coalesce(m, s) IS NOT NULL GROUP BY ALL")
def s05(spark, d):
    k = F.col("o_orderkey")
    o = D.read(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.when(k % 3 == 0, k).alias("movie_id"), F.when(k % 3 == 1, k).alias("show_id"), F.col("o_orderdate").alias("watched_at"))
    return S.read_history_feed(o.filter("owner % 2 = 0"), o.filter("owner % 2 = 1").drop("watched_at"), F.lit("2024-01-31").cast("timestamp_ntz")).groupBy("owner", "item_id", "media_type").agg(F.count("*").alias("n"))


@query("s15_write_catalogs", "SELECT catalog_id, owner % 2 = 0 AS kids, count(DISTINCT owner) AS owners, count(*) AS items, CAST(sum(item_id) AS BIGINT) AS total FROM profile_catalogs JOIN discovered USING (catalog_id) WHERE pos <= 20 GROUP BY ALL", ("discovered", "profile_catalogs"))
def s15(spark, d):
    path = S.shared_dir(spark, "catalogs")
    c = discovered(spark, d).filter("pos <= 20").select("catalog_id", "item_id", "pos")
    own = D.profile_catalogs(spark, d).repartition(S.tasks_for(spark, f"{d}/customer.parquet", mb=0.5), "owner").join(F.broadcast(c), "catalog_id").withColumns({"profile_id": F.lit("global"), "kids": F.col("owner") % 2 == 0})
    S.write_catalogs(own, path)
    return spark.read.parquet(path).withColumn("kids", F.col("kids").cast("boolean")).groupBy("catalog_id", "kids").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("items"), F.sum("item_id").alias("total"))


@query("s16_write_impressions", "SELECT owner, profile_id, catalog_id, item_id, '2024-01-31' AS seen_date FROM (SELECT DISTINCT owner, profile_id, catalog_id, item_id FROM impressions)", ("impressions",))
def s16(spark, d):
    path = S.shared_dir(spark, "shown")
    S.write_impressions(D.impressions(spark, d).withColumn("pos", F.lit(1)), path, F.lit("2024-01-31").cast("date"))
    return spark.read.parquet(path).withColumn("seen_date", F.col("seen_date").cast("string"))


@query("s17_write_report", "SELECT media_type, count(*) AS n FROM item_features GROUP BY ALL", ("item_features",))
def s17(spark, d):
    path = S.shared_dir(spark, "report")
    S.write_report(D.item_features(spark, d).groupBy("media_type").agg(F.count("*").alias("n")), path)
    return spark.read.schema("media_type string, n long").json(path)


@query("s18_export_snapshot", "SELECT item_id, media_type, name FROM item_features", ("item_features",))
def s18(spark, d):
    path = S.shared_dir(spark, "snapshot")
    S.export_snapshot(D.item_features(spark, d), path)
    return spark.read.schema("item_id long, media_type string, name string").json(path)
