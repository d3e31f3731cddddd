"""Queries of the episodes."""

from pyspark.sql import functions as F

from tastegrid.operators import episodes as E
from tastegrid.queries import query
from tastegrid.sources import domain as D

def as_of():
    return F.lit("1998-06-30").cast("date")


@query("w07_latest_aired", """
SELECT series_id, season, episode, CAST(released AS VARCHAR) AS released FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY released DESC NULLS LAST, episode DESC, season DESC) AS k FROM episodes
  WHERE released <= DATE '1998-06-30' AND NOT (overview IS NULL AND regexp_full_match(lower(title), '(episod(e|io)\\s+\\d+)?'))) WHERE k = 1""", ("episodes",))
def w07(spark, d):
    return E.latest_aired(D.episodes(spark, d), as_of(), "series_id").select("series_id", "season", "episode", F.col("released").cast("string").alias("released"))


@query("w12_normalize_episodes", """
SELECT series_id, ord, coalesce(season, 1) AS season, CAST(coalesce(episode, sum(CASE WHEN episode IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY ord)) AS INTEGER) AS episode
FROM (SELECT series_id, season * 100 + episode AS ord, CASE WHEN episode % 3 > 0 THEN season END AS season, CASE WHEN episode % 2 = 0 THEN episode END AS episode FROM episodes)""", ("episodes",))
def w12(spark, d):
    e = D.episodes(spark, d)
    e = e.select("series_id", (F.col("season") * 100 + F.col("episode")).alias("ord"), F.when(F.col("episode") % 3 > 0, F.col("season")).alias("season"), F.when(F.col("episode") % 2 == 0, F.col("episode")).alias("episode"))
    return E.normalize_episodes(e).select("series_id", "ord", "season", "episode")


@query("a13_audio_offset", """
WITH l AS (SELECT series_id, season, max(episode) AS last_tagged FROM episodes WHERE has_lang GROUP BY ALL),
g AS (SELECT series_id, season, last_tagged, min(episode) AS next_untagged FROM episodes JOIN l USING (series_id, season) WHERE NOT has_lang AND episode > last_tagged GROUP BY ALL)
SELECT *, unnest(['original', 'dubbed']) AS form, unnest([next_untagged, last_tagged]) AS show FROM g""", ("episodes",))
def a13(spark, d):
    return E.audio_offset(E.audio_gap(D.episodes(spark, d), "series_id", "season"))


@query("a14_next_probe", """
WITH l AS (SELECT series_id, season, max(episode) AS last_tagged FROM episodes WHERE has_lang GROUP BY ALL),
g AS (SELECT series_id, season, last_tagged, min(episode) AS next_untagged FROM episodes JOIN l USING (series_id, season) WHERE NOT has_lang AND episode > last_tagged GROUP BY ALL)
SELECT *, CAST((last_tagged + next_untagged) // 2 AS INTEGER) AS probe FROM g WHERE next_untagged - last_tagged > 1""", ("episodes",))
def a14(spark, d):
    return E.next_probe(E.audio_gap(D.episodes(spark, d), "series_id", "season"))


@query("a23_latest_air_date", """
WITH s AS (SELECT CAST(o_custkey AS BIGINT) AS series_id, CAST(max(o_orderdate) AS DATE) AS next_date, CAST(min(o_orderdate) AS DATE) AS last_date FROM orders GROUP BY ALL)
SELECT series_id, CAST(coalesce(CASE WHEN next_date <= DATE '1998-06-30' THEN next_date END, CASE WHEN last_date <= DATE '1998-06-30' THEN last_date END, (SELECT max(released) FROM episodes e WHERE e.series_id = s.series_id AND released <= DATE '1998-06-30')) AS VARCHAR) AS air_date FROM s""", ("episodes",))
def a23(spark, d):
    s = D.read(spark, d, "orders").groupBy(F.col("o_custkey").cast("long").alias("series_id")).agg(F.to_date(F.max("o_orderdate")).alias("next_date"), F.to_date(F.min("o_orderdate")).alias("last_date"))
    return E.latest_air_date(s, D.episodes(spark, d), as_of()).select("series_id", F.col("air_date").cast("string").alias("air_date"))


@query("w10_simulcast_sort", """
WITH s AS (SELECT series_id, max(CASE WHEN released <= DATE '1998-06-30' THEN released END) AS air_date FROM episodes GROUP BY ALL)
SELECT series_id, CAST(row_number() OVER (ORDER BY air_date DESC NULLS LAST, series_id) AS INTEGER) AS pos FROM s QUALIFY pos <= 100""", ("episodes",))
def w10(spark, d):
    from pyspark.sql import Window

    s = D.episodes(spark, d).groupBy("series_id").agg(F.max(F.when(F.col("released") <= as_of(), F.col("released"))).alias("air_date"))
    top = s.orderBy(F.col("air_date").desc_nulls_last(), "series_id").limit(100)
    return top.select("series_id", F.row_number().over(Window.orderBy(F.col("air_date").desc_nulls_last(), "series_id")).alias("pos"))


@query("j11_infer_season", """
WITH n AS (SELECT CAST(o_custkey AS BIGINT) AS series_id, CAST(o_orderdate AS DATE) AS air_date, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS INTEGER) AS season_number FROM orders),
s AS (SELECT CAST(c_custkey AS BIGINT) AS series_id, DATE '1995-01-01' + CAST(c_custkey % 2500 AS INTEGER) AS start FROM customer),
m AS (SELECT series_id, start, season_number, abs(date_diff('day', air_date, start)) AS gap, row_number() OVER (PARTITION BY series_id ORDER BY abs(date_diff('day', air_date, start)), season_number) AS k FROM s JOIN n USING (series_id) WHERE season_number <> 0)
SELECT s.series_id, CAST(s.start AS VARCHAR) AS start, CASE WHEN gap <= 365 THEN season_number ELSE 1 END AS season FROM s LEFT JOIN m ON m.series_id = s.series_id AND k = 1""")
def j11(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    n = D.read(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("series_id"), F.to_date("o_orderdate").alias("air_date"), (F.row_number().over(w) - 1).alias("season_number"))
    s = D.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("series_id"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("c_custkey") % 2500).cast("int")).alias("start"))
    return E.infer_season(s, n, F.lit(1)).withColumn("start", F.col("start").cast("string"))


_LEFT = "SELECT series_id, season, episode AS ep, released + CAST(episode % 2 AS INTEGER) AS released, CAST(series_id % 3 AS INTEGER) AS shift FROM episodes WHERE series_id % 2 = 0"
_RIGHT = "SELECT series_id, season, episode, released, CAST(row_number() OVER (PARTITION BY series_id ORDER BY season, episode) AS INTEGER) AS absolute FROM episodes WHERE season < 12"


_STARTS = "SELECT series_id, CAST(series_id % 6 + 1 AS INTEGER) AS season, min(released) AS start FROM episodes WHERE series_id % 2 = 0 AND season = series_id % 6 + 1 AND episode = CASE WHEN series_id % 4 = 0 THEN 2 ELSE 1 END GROUP BY ALL"


@query("j12_align_episodes", f"""
WITH r AS ({_RIGHT}), s AS ({_STARTS}),
o AS (SELECT s.series_id, s.season, greatest(coalesce((SELECT min(episode) FROM r WHERE r.series_id = s.series_id AND r.season = s.season AND r.released = s.start), 1) - 1, 0) AS shift, EXISTS (SELECT 1 FROM r WHERE r.series_id = s.series_id AND r.season = s.season) OR s.season <= 1 AS safe FROM s),
l AS (SELECT l.series_id, l.season, ep, released, o.shift FROM ({_LEFT}) l JOIN o ON o.series_id = l.series_id AND o.season = l.season WHERE safe),
a AS (SELECT series_id, season, released, min(season * 1000 + episode) AS x FROM r GROUP BY ALL), b AS (SELECT series_id, season, episode AS want, min(season * 1000 + episode) AS x FROM r GROUP BY ALL),
c AS (SELECT series_id, absolute AS want, min(season * 1000 + episode) AS x FROM r GROUP BY ALL), e AS (SELECT series_id, episode AS ep, min(season * 1000 + episode) AS x FROM r WHERE season = 1 GROUP BY ALL)
SELECT series_id, season, ep, CASE WHEN a.x IS NOT NULL THEN 'date' WHEN b.x IS NOT NULL THEN 'number' WHEN c.x IS NOT NULL THEN 'absolute' WHEN e.x IS NOT NULL THEN 'first' END AS how,
  coalesce(a.x, b.x, c.x, e.x) // 1000 AS to_season, coalesce(a.x, b.x, c.x, e.x) % 1000 AS to_episode
FROM (SELECT *, ep + shift AS want FROM l) LEFT JOIN a USING (series_id, season, released) LEFT JOIN b USING (series_id, season, want) LEFT JOIN c USING (series_id, want) LEFT JOIN e USING (series_id, ep)""", ("episodes",))
def j12(spark, d):
    from pyspark.sql import Window

    e = D.episodes(spark, d)
    w = Window.partitionBy("series_id").orderBy("season", "episode")
    right = e.filter("season < 12").select("series_id", "season", "episode", "released", F.row_number().over(w).alias("absolute"))
    starts = e.filter("series_id % 2 = 0 AND season = series_id % 6 + 1 AND episode = CASE WHEN series_id % 4 = 0 THEN 2 ELSE 1 END").groupBy("series_id", "season").agg(F.min("released").alias("start"))
    offsets = E.episode_offset(starts, right).filter("safe").drop("safe")
    left = e.filter("series_id % 2 = 0").select("series_id", "season", F.col("episode").alias("ep"), F.date_add("released", F.col("episode") % 2).alias("released"))
    return E.align_episodes(left.join(offsets, ["series_id", "season"]), right)


@query("j13_append_unmatched", """
WITH m AS (SELECT DISTINCT series_id, episode FROM episodes WHERE season = 1), t AS (SELECT DISTINCT series_id, CAST(series_id % 3 + 1 AS INTEGER) AS t FROM episodes),
x AS (SELECT DISTINCT series_id, episode + season AS episode FROM episodes JOIN t USING (series_id) WHERE t <= 1 OR season = t)
SELECT series_id, x.episode AS was, CAST(coalesce(top, 0) + row_number() OVER (PARTITION BY series_id ORDER BY x.episode) AS INTEGER) AS episode
FROM (SELECT * FROM x ANTI JOIN m USING (series_id, episode)) x LEFT JOIN (SELECT series_id, max(episode) AS top FROM m GROUP BY ALL) USING (series_id)""", ("episodes",))
def j13(spark, d):
    e = D.episodes(spark, d)
    targets = e.select("series_id").distinct().select("series_id", (F.col("series_id") % 3 + 1).cast("int").alias("season"))
    extra = E.of_season(e.select("series_id", "season", "episode"), targets)
    return E.append_unmatched(e.filter("season = 1").select("series_id", "episode").distinct(), extra.select("series_id", (F.col("episode") + F.col("season")).alias("episode")).distinct())


@query("j23_localized_overview", """
SELECT series_id, season, episode, coalesce(nullif(trim(overview), ''), CASE WHEN episode % 2 = 0 THEN 'english' END, CASE WHEN season % 2 = 0 THEN 'original' END) AS overview FROM episodes""", ("episodes",))
def j23(spark, d):
    e = D.episodes(spark, d)
    return E.localized_overview(e, e.filter("episode % 2 = 0").withColumn("overview", F.lit("english")), e.filter("season % 2 = 0").withColumn("overview", F.lit("original")))


@query("j25_probe_targets", """
WITH ends AS (SELECT series_id, season, min(episode) AS lo, max(episode) AS hi FROM episodes GROUP BY ALL), w AS (SELECT series_id, season, lo AS episode FROM ends UNION SELECT series_id, season, hi FROM ends)
SELECT * FROM w ANTI JOIN (SELECT series_id, season, episode FROM episodes WHERE has_lang) USING (series_id, season, episode)""", ("episodes",))
def j25(spark, d):
    e = D.episodes(spark, d)
    return E.probe_targets(e, e.filter("has_lang"), "series_id", "season")


@query("j28_choose_source", "SELECT series_id, source, count(*) AS n FROM (SELECT series_id, 'alt' AS source FROM episodes WHERE season = 2 UNION ALL SELECT series_id, 'main' FROM episodes WHERE series_id NOT IN (SELECT series_id FROM episodes WHERE season = 2)) GROUP BY ALL", ("episodes",))
def j28(spark, d):
    e = D.episodes(spark, d)
    return E.choose_source(e.filter("season = 2"), e).groupBy("series_id", "source").agg(F.count("*").alias("n"))


@query("j20_join_badges", """
WITH i AS (SELECT series_id, CASE series_id % 3 WHEN 0 THEN 'kitsu:' || series_id WHEN 1 THEN 'tmdb:tv:' || series_id ELSE 'tt' || series_id END AS base FROM (SELECT DISTINCT series_id FROM episodes)),
f AS (SELECT series_id, episode, has_lang FROM episodes WHERE season < 4), t AS (SELECT series_id, max(episode) AS last_tagged FROM f WHERE has_lang GROUP BY ALL), n AS (SELECT series_id, min(episode) AS next_untagged FROM f JOIN t USING (series_id) WHERE NOT has_lang AND episode > last_tagged GROUP BY ALL)
SELECT base || CASE WHEN series_id % 3 = 0 THEN ':5' ELSE ':1:5' END AS id, last_tagged, next_untagged, last_tagged IS NOT NULL AS badge FROM i LEFT JOIN t USING (series_id) LEFT JOIN n USING (series_id)""", ("episodes",))
def j20(spark, d):
    e = D.episodes(spark, d)
    k = F.col("series_id")
    base = F.concat(F.when(k % 3 == 0, "kitsu:").when(k % 3 == 1, "tmdb:tv:").otherwise("tt"), k.cast("string"))
    items = e.select("series_id").distinct().select(F.concat(base, F.when(k % 3 == 0, ":5").otherwise(":1:5")).alias("id"))
    flags = e.filter("season < 4").select(F.concat_ws(":", base, F.when(k % 3 > 0, F.col("season").cast("string")), F.col("episode").cast("string")).alias("stream_id"), "has_lang")
    return E.join_badges(items, flags)


@query("r07_air_date_range", "SELECT DISTINCT series_id FROM episodes WHERE released BETWEEN DATE '1997-01-01' AND DATE '1997-03-31'", ("episodes",))
def r07(spark, d):
    e = D.episodes(spark, d)
    return e.select("series_id").distinct().join(e.filter(F.col("released").between(F.lit("1997-01-01").cast("date"), F.lit("1997-03-31").cast("date"))), "series_id", "left_semi")
