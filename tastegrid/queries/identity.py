"""Queries of identifiers and crosswalks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.functions import ids as I
from tastegrid.operators import xref as X
from tastegrid.queries import query
from tastegrid.sources import domain as D
from tastegrid.sources.domain import BASE_SQL

BASE_SQL["ids"] = ((), """
  SELECT p_partkey, p_size, ['tmdb:' || p_partkey, 'kitsu:' || p_partkey || ':' || (p_size % 12), 'tt' || (1000 + p_partkey) || ':' || (p_size % 4) || ':' || (p_size % 9), 'kitsu:' || p_partkey || ':2:' || (p_size % 12),
    CAST(p_partkey AS VARCHAR), 'tmdb:tv:' || p_partkey, ' 0', '0', 'tmdb:' || p_partkey || ':1:5'][p_partkey % 9 + 1] AS id FROM part""")


def ids(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    n = lambda m: (s % m).cast("string")
    forms = F.array(F.concat(F.lit("tmdb:"), k), F.concat(F.lit("kitsu:"), k, F.lit(":"), n(12)), F.concat(F.lit("tt"), (F.col("p_partkey") + 1000).cast("string"), F.lit(":"), n(4), F.lit(":"), n(9)), F.concat(F.lit("kitsu:"), k, F.lit(":2:"), n(12)), k, F.concat(F.lit("tmdb:tv:"), k), F.lit(" 0"), F.lit("0"), F.concat(F.lit("tmdb:"), k, F.lit(":1:5")))
    return D.read(spark, d, "part").select("p_partkey", "p_size", F.element_at(forms, (F.col("p_partkey") % 9 + 1).cast("int")).alias("id"))


@query("p01_content_id", "SELECT p_partkey, CASE WHEN id = '0' THEN '' ELSE trim(string_split(id, ':')[-1]) END AS key FROM ids", ("ids",))
def p01(spark, d):
    return ids(spark, d).select("p_partkey", I.content_id(F.col("id")).alias("key"))


@query("p02_base_id", """
SELECT p_partkey, CASE WHEN split_part(id, ':', 1) IN ('tmdb', 'kitsu', 'anilist') THEN split_part(id, ':', 1) || ':' || split_part(id, ':', 2) ELSE split_part(id, ':', 1) END AS base,
  CASE WHEN id LIKE 'tmdb:tv:%' THEN 'tmdb:tv:' || split_part(id, ':', 3) WHEN split_part(id, ':', 1) IN ('tmdb', 'kitsu', 'anilist') THEN split_part(id, ':', 1) || ':' || split_part(id, ':', 2) ELSE split_part(id, ':', 1) END AS series FROM ids""", ("ids",))
def p02(spark, d):
    return ids(spark, d).select("p_partkey", I.base_id(F.col("id")).alias("base"), I.series_base_id(F.col("id")).alias("series"))


@query("p03_rewrite_episode_id", """
SELECT p_partkey, CASE WHEN starts_with(id, 'tt') THEN array_to_string(['new:1'] || string_split(id, ':')[2:], ':') WHEN starts_with(id, 'tmdb:') THEN array_to_string(['new:1'] || string_split(id, ':')[3:], ':')
  WHEN starts_with(id, 'kitsu:') THEN CASE len(string_split(id, ':')) WHEN 4 THEN 'new:1:' || split_part(id, ':', 3) || ':' || split_part(id, ':', 4) WHEN 3 THEN 'new:1:1:' || split_part(id, ':', 3) END END AS id FROM ids""", ("ids",))
def p03(spark, d):
    return ids(spark, d).select("p_partkey", I.rewrite_episode_id(F.col("id"), F.lit("new:1")).alias("id"))


@query("p04_typed_id", """
SELECT p_partkey, CASE WHEN regexp_full_match(id, '(tmdb:)?[0-9]+') THEN 'tmdb:' || CASE WHEN p_size % 4 = 0 THEN 'tv' ELSE 'movie' END || ':' || split_part(id, ':', -1) ELSE id END AS id FROM ids""", ("ids",))
def p04(spark, d):
    return ids(spark, d).select("p_partkey", I.typed_id(F.col("id"), F.when(F.col("p_size") % 4 == 0, "series").otherwise("movie")).alias("id"))


@query("p16_vote_score", "SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN CAST(value AS VARCHAR) END AS DOUBLE), TRY_CAST(CASE WHEN event_id % 3 = 1 THEN event_type END AS DOUBLE), TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0::DOUBLE) AS vote FROM events")
def p16(spark, d):
    e = F.col("event_id") % 3
    return D.read(spark, d, "events").select("event_id", I.vote_score(F.when(e == 0, F.col("value").cast("string")), F.when(e == 1, F.col("event_type")), F.get_json_object("props", "$.k")).alias("vote"))


@query("p17_sanitize_text", "SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[<>\"''&]', '', 'g')) AS digest FROM pages")
def p17(spark, d):
    return D.read(spark, d, "pages").select("page_id", F.md5(I.sanitize_text(F.col("html")).cast("binary")).alias("digest"))


def bridge(spark: SparkSession, d: str) -> DataFrame:
    return D.item_features(spark, d).select("item_id", F.floor((F.col("item_id") - 1) / 2).cast("long").alias("tvdb_id"))


BASE_SQL["anime_items"] = (("item_features",), "SELECT item_id, name, list_contains(genre_ids, 16) OR origin_country = 'JP' AS anime, CAST((item_id - 1) // 2 AS BIGINT) AS tvdb_id, 'tt' || (5000 + item_id) AS imdb_id, media_type FROM item_features")


def anime_items(spark: SparkSession, d: str) -> DataFrame:
    return D.item_features(spark, d).select("item_id", "name", (F.array_contains("genre_ids", 16) | (F.col("origin_country") == "JP")).alias("anime"), "media_type", F.concat(F.lit("tt"), (F.col("item_id") + 5000).cast("string")).alias("imdb_id"))


@query("j05_to_alt_ids", """
SELECT item_id, CASE WHEN anime THEN dst_id END AS alt_id FROM anime_items LEFT JOIN (SELECT src_id, arg_min(dst_id, priority * 1000000 + dst_id) AS dst_id FROM crosswalk GROUP BY src_id) ON tvdb_id = src_id""", ("anime_items", "crosswalk"))
def j05(spark, d):
    return X.to_alt_ids(anime_items(spark, d), bridge(spark, d), D.crosswalk(spark, d)).select("item_id", "alt_id")


@query("j06_to_imdb_ids", """
SELECT a.alt_id, coalesce(CASE WHEN c.src_id % 3 <> 0 THEN 'tt' || (5000 + c.src_id) END, 'tmdb:' || c.src_id, 'alt:' || a.alt_id) AS id FROM (SELECT CAST(p_partkey + 50001 AS BIGINT) AS alt_id FROM part) a LEFT JOIN crosswalk c ON c.dst_id = a.alt_id""", ("crosswalk",))
def j06(spark, d):
    alt = D.read(spark, d, "part").select((F.col("p_partkey") + 50001).cast("long").alias("alt_id"))
    imdb = anime_items(spark, d).filter("item_id % 3 <> 0").select("item_id", "imdb_id")
    return X.to_imdb_ids(alt, D.crosswalk(spark, d), imdb)


@query("j07_alt_from_third", "SELECT o_orderkey, alt_id FROM (SELECT o_orderkey, CAST(o_orderkey % 1500 AS BIGINT) AS src_id FROM orders) JOIN (SELECT src_id, min(dst_id) AS alt_id FROM crosswalk GROUP BY src_id) USING (src_id)", ("crosswalk",))
def j07(spark, d):
    return X.alt_from_third(D.read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 1500).cast("long").alias("src_id")), D.crosswalk(spark, d)).select("o_orderkey", "alt_id")


@query("j08_imdb_to_item", """
WITH k AS (SELECT 'tt' || (5000 + item_id // 3) AS imdb_id, item_id, media_type FROM item_features), m AS (SELECT imdb_id, arg_min(item_id, CASE WHEN media_type = 'movie' THEN 0 ELSE 1000000 END + item_id) AS item_id FROM k GROUP BY imdb_id)
SELECT a.imdb_id, m.item_id, i.media_type FROM (SELECT DISTINCT CASE WHEN l_orderkey % 5 = 0 THEN 'nm' ELSE 'tt' END || (5000 + l_partkey) AS imdb_id FROM lineitem) a JOIN m USING (imdb_id) JOIN item_features i ON i.item_id = m.item_id WHERE starts_with(imdb_id, 'tt')""", ("item_features",))
def j08(spark, d):
    known = D.item_features(spark, d).select(F.concat(F.lit("tt"), (F.floor(F.col("item_id") / 3) + 5000).cast("string")).alias("imdb_id"), "item_id", "media_type")
    asked = D.read(spark, d, "lineitem").select(F.concat(F.when(F.col("l_orderkey") % 5 == 0, "nm").otherwise("tt"), (F.col("l_partkey") + 5000).cast("string")).alias("imdb_id")).distinct()
    return X.imdb_to_item(asked, known)


@query("j09_resolve_names", """
WITH k AS (SELECT item_id AS id, name AS label FROM item_features), asked AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE split_part(p_name, ' ', 2) END AS asked FROM part)
SELECT asked, coalesce((SELECT min(id) FROM k WHERE lower(label) = lower(asked)), (SELECT min(id) FROM k WHERE list_contains(string_split(lower(label), ' '), lower(asked)))) AS id FROM asked""", ("item_features",))
def j09(spark, d):
    asked = D.read(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.split("p_name", " ")[1]).alias("asked")).distinct()
    return X.resolve_names(asked, D.item_features(spark, d).select(F.col("item_id").alias("id"), F.col("name").alias("label")))


@query("j14_franchise_parent", """
WITH e AS (SELECT src_id AS src, dst_id AS dst, position AS ord FROM similar_items WHERE position <= 3),
h1 AS (SELECT src AS node, dst AS here, [src, dst] AS seen, [ord] AS path FROM e WHERE dst <> src),
h2 AS (SELECT node, e.dst AS here, seen || [e.dst] AS seen, path || [e.ord] AS path FROM h1 JOIN e ON h1.here = e.src WHERE NOT list_contains(seen, e.dst)),
h3 AS (SELECT node, e.dst AS here, seen || [e.dst] AS seen, path || [e.ord] AS path FROM h2 JOIN e ON h2.here = e.src WHERE NOT list_contains(seen, e.dst)),
f AS (SELECT node, here, path FROM h1 UNION ALL SELECT node, here, path FROM h2 UNION ALL SELECT node, here, path FROM h3),
r AS (SELECT node, here AS target, CAST(len(path) AS INTEGER) AS hops, row_number() OVER (PARTITION BY node ORDER BY path, here) AS k FROM f WHERE here % 7 = 0)
SELECT node, target, hops FROM r WHERE k = 1""", ("similar_items",))
def j14(spark, d):
    s = D.similar(spark, d).filter("position <= 3")
    nodes = s.select(F.col("src_id").alias("node")).distinct()
    return X.franchise_parent(nodes, s.select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst"), F.col("position").alias("ord")), D.item_features(spark, d).filter("item_id % 7 = 0").select(F.col("item_id").alias("node")), D.tasks(spark, d))


BASE_SQL["mapped_titles"] = (("item_features",), """
SELECT item_id, name, coalesce(list_bool_or([contains(x, lower(name)) OR contains(lower(name), x) FOR x IN titles]), false) AS ok FROM (SELECT item_id, name, item_id % 211 AS alt_id FROM item_features)
LEFT JOIN (SELECT s_suppkey AS alt_id, list(DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'red bolt two' ELSE 'bolt' END) AS titles FROM supplier GROUP BY s_suppkey) USING (alt_id)""")


def verified(spark: SparkSession, d: str) -> DataFrame:
    """Items, with dubbed twins for some, against the titles of their counterparts."""
    k = F.col("item_id")
    one = D.item_features(spark, d).select(k.cast("string").alias("id"), "name")
    twins = one.filter("CAST(id AS INT) % 3 = 0").select(F.concat("id", F.lit("_ita_offset")).alias("id"), "name")
    pairs = X.without_clones(one.unionByName(twins)).select(F.col("id").cast("long").alias("item_id"), "name", (F.col("id").cast("long") % 211).alias("alt_id"))
    titles = D.read(spark, d, "supplier").select(F.col("s_suppkey").alias("alt_id"), F.when(F.col("s_suppkey") % 2 == 0, "Red Bolt Two").otherwise("Bolt").alias("title"))
    return X.verify_mapping_titles(pairs, titles)


@query("j24_verify_mapping_titles", "SELECT item_id, ok FROM mapped_titles", ("mapped_titles",))
def j24(spark, d):
    return verified(spark, d)


@query("j24_mapping_report", "SELECT ok, count(*) AS n FROM mapped_titles GROUP BY ok", ("mapped_titles",))
def j24_report(spark, d):
    return X.mapping_report(verified(spark, d))
