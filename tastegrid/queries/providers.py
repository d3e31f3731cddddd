"""Queries of the other providers, over items derived from parts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.functions.titles import search_title
from tastegrid.operators import episodes as E
from tastegrid.operators import providers as P
from tastegrid.queries import query
from tastegrid.sources import domain as D
from tastegrid.sources import tables as S
from tastegrid.sources.domain import BASE_SQL

YEAR = 1998
BASE_SQL["alt_items"] = (("item_features",), """
  SELECT item_id + 50000 AS alt_id, item_id, name AS title, release_date AS start_date, CAST(round(vote_average * 10) AS INTEGER) AS rating, ['TV', 'movie', 'OVA', 'ONA', 'special'][item_id % 5 + 1] AS subtype, ['current', 'finished', 'upcoming'][item_id % 3 + 1] AS status,
    ['G', 'PG', 'R', 'R18'][item_id % 4 + 1] AS age, ['slice-of-life', 'sports', 'mecha'][1:CAST(item_id % 3 + 1 AS INTEGER)] AS categories, item_id * 7919 % 10007 AS popularity_rank FROM item_features""")
BASE_SQL["third_items"] = (("item_features",), """
  SELECT item_id + 90000 AS third_id, item_id % 1500 AS mal_id, CASE WHEN item_id % 3 > 0 THEN name END AS romaji, CASE WHEN item_id % 2 = 0 THEN upper(name) END AS english, 'native ' || item_id AS native, ['MOVIE', 'SPECIAL', 'OVA', 'TV', 'ONA', 'TV_SHORT'][item_id % 6 + 1] AS format,
    CASE WHEN item_id % 7 = 0 THEN item_id % 12 + 1 END AS next_episode, CASE WHEN item_id % 4 > 0 THEN 'about ' || item_id END AS description, CAST(round(vote_average * 10) AS INTEGER) AS score, year(release_date) * 10000 + month(release_date) * 100 + day(release_date) AS start_number,
    ['Action', 'Drama', 'Horror'][CAST(item_id % 3 + 1 AS INTEGER):] AS genres, ['Space', 'School'][1:CAST(item_id % 2 + 1 AS INTEGER)] AS tags, popularity, item_id * 31 % 997 AS trending, name AS title FROM item_features""")


@D.shared
def alt_items(spark: SparkSession, d: str) -> DataFrame:
    i, k = D.item_features(spark, d), F.col("item_id")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (k % n + 1).cast("int"))
    return i.select((k + 50000).alias("alt_id"), "item_id", F.col("name").alias("title"), F.col("release_date").alias("start_date"), F.round(F.col("vote_average") * 10).cast("int").alias("rating"), pick(5, "TV", "movie", "OVA", "ONA", "special").alias("subtype"), pick(3, "current", "finished", "upcoming").alias("status"), pick(4, "G", "PG", "R", "R18").alias("age"), F.slice(F.array(*map(F.lit, ("slice-of-life", "sports", "mecha"))), F.lit(1), (k % 3 + 1).cast("int")).alias("categories"), (k * 7919 % 10007).alias("popularity_rank"))


@D.shared
def third_items(spark: SparkSession, d: str) -> DataFrame:
    i, k = D.item_features(spark, d), F.col("item_id")
    kinds = F.array(*map(F.lit, ("MOVIE", "SPECIAL", "OVA", "TV", "ONA", "TV_SHORT")))
    number = F.year("release_date") * 10000 + F.month("release_date") * 100 + F.day("release_date")
    return i.select((k + 90000).alias("third_id"), (k % 1500).alias("mal_id"), F.when(k % 3 > 0, F.col("name")).alias("romaji"), F.when(k % 2 == 0, F.upper("name")).alias("english"), F.concat(F.lit("native "), k.cast("string")).alias("native"), F.element_at(kinds, (k % 6 + 1).cast("int")).alias("format"),
                    F.when(k % 7 == 0, k % 12 + 1).alias("next_episode"), F.when(k % 4 > 0, F.concat(F.lit("about "), k.cast("string"))).alias("description"), F.round(F.col("vote_average") * 10).cast("int").alias("score"), number.alias("start_number"),
                    F.slice(F.array(*map(F.lit, ("Action", "Drama", "Horror"))), (k % 3 + 1).cast("int"), F.lit(3)).alias("genres"), F.slice(F.array(*map(F.lit, ("Space", "School"))), F.lit(1), (k % 2 + 1).cast("int")).alias("tags"), "popularity", (k * 31 % 997).alias("trending"), F.col("name").alias("title"))


@query("s11_read_alt_catalog", "SELECT alt_id AS id, coalesce(CASE WHEN alt_id % 4 = 0 THEN 'it ' || title END, CASE WHEN alt_id % 3 = 0 THEN 'en ' || title END, CASE WHEN alt_id % 2 = 0 THEN 'jp ' || title END, title) AS name, CAST(year(start_date) AS INTEGER) AS year, printf('%.1f', rating / 10.0::DOUBLE) AS rating, subtype FROM alt_items", ("alt_items",))
def s11(spark, d):
    k = F.col("alt_id")
    title = lambda n, p: F.when(k % n == 0, F.concat(F.lit(p), "title"))
    return S.alt_catalog(alt_items(spark, d).select(k.alias("id"), title(4, "it ").alias("title_it"), title(3, "en ").alias("title_en"), title(2, "jp ").alias("title_en_jp"), F.col("title").alias("canonical"), "start_date", "rating", "subtype"))


@query("s12_read_third_catalog", """
SELECT third_id, mal_id, CASE WHEN format IN ('MOVIE', 'SPECIAL', 'OVA') THEN 'movie' ELSE 'series' END AS type, coalesce(romaji, english, native) AS name,
  CASE WHEN next_episode IS NOT NULL THEN '[Airing Ep ' || next_episode || ']' || chr(10) || chr(10) || coalesce(description, '') ELSE coalesce(description, '') END AS description, CASE WHEN score <> 0 THEN printf('%.1f', score / 10.0::DOUBLE) END AS rating FROM third_items""", ("third_items",))
def s12(spark, d):
    return P.read_third_catalog(third_items(spark, d))


ALT = [("films", P.AltFilter(media_type="movie", vote_min=4.5)), ("series", P.AltFilter(media_type="tv", date_gte="1996-01-01", date_lte="1998-12-31", sort_by="vote_average.desc")), ("sport", P.AltFilter(keyword_names="slice of life|sports", certification_lte="PG-13", status="finished", sort_by="release_date.desc")), ("red", P.AltFilter(text_search="red", vote_max=5.2, sort_by="popularity.asc"))]
_ALT = {"films": "subtype IN ('movie', 'special') AND rating BETWEEN 45 AND 100 AND year(start_date) BETWEEN 1900 AND 1998", "series": "subtype IN ('TV', 'ONA', 'OVA') AND year(start_date) BETWEEN 1996 AND 1998", "sport": "list_has_all(categories, ['slice-of-life', 'sports']) AND age IN ('G', 'PG', 'R') AND status = 'finished' AND year(start_date) BETWEEN 1900 AND 1998", "red": "contains(lower(title), 'red') AND rating BETWEEN 0 AND 52 AND year(start_date) BETWEEN 1900 AND 1998"}
_ALT_ORDER = {"films": "popularity_rank", "series": "rating DESC", "sport": "start_date DESC", "red": "popularity_rank DESC"}
_ALT_SQL = " UNION ALL ".join(f"(SELECT '{n}' AS catalog_id, alt_id, CAST(row_number() OVER (ORDER BY {_ALT_ORDER[n]}, alt_id) AS INTEGER) AS pos FROM alt_items WHERE {w} QUALIFY pos <= {{n}})" for n, w in _ALT.items())


@query("r23_alt_filters", _ALT_SQL.replace("{n}", "1000000"), ("alt_items",))
def r23(spark, d):
    return P.listed(alt_items(spark, d), ALT, YEAR, 1_000_000).select("catalog_id", "alt_id", "pos")


@query("c13_alt_catalog", f"SELECT c.*, coalesce(n, 0) AS episodes FROM ({_ALT_SQL.replace('{n}', '20')}) c LEFT JOIN (SELECT series_id + 50000 AS alt_id, count(*) AS n FROM episodes GROUP BY ALL) USING (alt_id)", ("alt_items", "episodes"))
def c13(spark, d):
    e = D.episodes(spark, d).select((F.col("series_id") + 50000).alias("alt_id"))
    return P.alt_catalogs(alt_items(spark, d), ALT, e, YEAR).select("catalog_id", "alt_id", "pos", "episodes")


THIRD = [("films", P.ThirdFilter(media_type="movie", vote_min=4.5)), ("series", P.ThirdFilter(media_type="tv", date_gte="1992-02-01", date_lte="1993-06-30", sort_by="release_date.asc")), ("mixed", P.ThirdFilter(keyword_names="Horror|School", vote_max=5.2, sort_by="vote_average.desc")), ("blue", P.ThirdFilter(text_search="blue", sort_by="popularity.asc"))]
_THIRD = {"films": ("format IN ('MOVIE', 'SPECIAL') AND start_number < 19990000 AND score > 45", "popularity DESC"), "series": ("format IN ('TV', 'TV_SHORT', 'OVA', 'ONA') AND start_number > 19920201 AND start_number < 19930630", "start_number"), "mixed": ("list_contains(genres, 'Horror') AND list_contains(tags, 'School') AND start_number < 19990000 AND score < 52", "score DESC"), "blue": ("contains(lower(title), 'blue')", "popularity")}


@query("r24_third_filters", " UNION ALL ".join(f"(SELECT '{n}' AS catalog_id, third_id, CAST(row_number() OVER (ORDER BY {o}, third_id) AS INTEGER) AS pos FROM third_items WHERE {w})" for n, (w, o) in _THIRD.items()), ("third_items",))
def r24(spark, d):
    return P.listed(third_items(spark, d), THIRD, YEAR, 1_000_000).select("catalog_id", "third_id", "pos")


@query("r25_subtype_catalogs", """
WITH r AS (SELECT 'alt-' || lower(subtype) AS catalog_id, alt_id AS item, CAST(popularity_rank AS DOUBLE) AS rank FROM alt_items WHERE subtype IN ('OVA', 'ONA', 'special')
  UNION ALL SELECT 'third-popular', third_id, -popularity FROM third_items UNION ALL SELECT 'third-simulcast', third_id, -popularity FROM third_items WHERE next_episode IS NOT NULL
  UNION ALL SELECT CASE format WHEN 'MOVIE' THEN 'third-movies' WHEN 'OVA' THEN 'third-ova' WHEN 'ONA' THEN 'third-ona' ELSE 'third-specials' END, third_id, -popularity FROM third_items WHERE format IN ('MOVIE', 'OVA', 'ONA', 'SPECIAL')
  UNION ALL SELECT 'third-genre-' || unnest(genres), third_id, -popularity FROM third_items UNION ALL SELECT 'third-trending', third_id, -trending FROM third_items)
SELECT catalog_id, item, CAST(row_number() OVER (PARTITION BY catalog_id ORDER BY rank, item) AS INTEGER) AS pos FROM r QUALIFY pos <= 20""", ("alt_items", "third_items"))
def r25(spark, d):
    return P.subtype_catalogs(alt_items(spark, d), third_items(spark, d))


@query("c14_simulcast", """
WITH t AS (SELECT mal_id, popularity FROM third_items WHERE next_episode IS NOT NULL), x AS (SELECT src_id AS mal_id, min(dst_id) AS alt_id FROM crosswalk GROUP BY ALL),
a AS (SELECT alt_id, max(popularity) AS popularity FROM t JOIN x USING (mal_id) GROUP BY ALL), e AS (SELECT series_id + 50000 AS alt_id, max(released) AS air_date FROM episodes WHERE released <= DATE '1998-06-30' GROUP BY ALL)
SELECT alt_id, CAST(air_date AS VARCHAR) AS air_date, CAST(row_number() OVER (ORDER BY air_date DESC NULLS LAST, popularity DESC, alt_id) AS INTEGER) AS pos FROM a LEFT JOIN e USING (alt_id) QUALIFY pos <= 100""", ("third_items", "crosswalk", "episodes"))
def c14(spark, d):
    as_of = F.lit("1998-06-30").cast("date")
    t = third_items(spark, d).filter("next_episode IS NOT NULL").select("mal_id", "popularity")
    none = F.lit(None).cast("date")
    shows = D.crosswalk(spark, d).select(F.col("dst_id").alias("series_id")).distinct().select((F.col("series_id") - 50000).alias("series_id"), none.alias("next_date"), none.alias("last_date"))
    dates = E.latest_air_date(shows, D.episodes(spark, d), as_of).select((F.col("series_id") + 50000).alias("alt_id"), "air_date")
    x = D.crosswalk(spark, d).select(F.col("src_id").alias("mal_id"), F.col("dst_id").alias("alt_id"))
    return P.simulcast(t, x, dates).withColumn("air_date", F.col("air_date").cast("string"))


@query("j10_resolve_alt_to_item", """
WITH a AS (SELECT alt_id, item_id, item_id % 4 AS lane, CASE WHEN subtype = 'movie' THEN 'movie' ELSE 'tv' END AS media_type, title FROM alt_items),
own AS (SELECT alt_id, item_id FROM a WHERE lane = 0), two AS (SELECT alt_id, (SELECT arg_min(i.item_id, CASE WHEN i.media_type = 'tv' THEN 0 ELSE 1000000 END + i.item_id) FROM item_features i WHERE i.item_id // 3 = a.item_id // 2) AS item_id FROM a WHERE lane = 1),
m AS (SELECT alt_id, item_id, 'direct' AS how FROM own UNION ALL SELECT alt_id, item_id, 'tvdb' FROM two WHERE item_id IS NOT NULL),
up AS (SELECT a.alt_id, m.item_id FROM a JOIN m ON m.alt_id = a.alt_id - 1 WHERE a.lane IN (1, 2) AND a.alt_id NOT IN (SELECT alt_id FROM m)),
s AS (SELECT name AS search, media_type, arg_max(item_id, struct_pack(p := popularity, i := -item_id)) AS item_id FROM item_features GROUP BY ALL),
t AS (SELECT a.alt_id, s.item_id FROM a JOIN s ON s.search = a.title AND s.media_type = a.media_type WHERE a.alt_id NOT IN (SELECT alt_id FROM m) AND a.alt_id NOT IN (SELECT alt_id FROM up))
SELECT * FROM m UNION ALL SELECT alt_id, item_id, 'relation' FROM up UNION ALL SELECT alt_id, item_id, 'title' FROM t""", ("alt_items", "item_features"))
def j10(spark, d):
    f, k = D.item_features(spark, d), F.col("item_id")
    a = alt_items(spark, d).withColumn("lane", k % 4)
    alt = a.select("alt_id", F.array(F.concat("title", F.lit(" (unknown)")), search_title(F.concat("title", F.lit(" Season 2")))).alias("titles"), F.when(F.col("subtype") == "movie", "movie").otherwise("tv").alias("media_type"))
    direct = a.filter("lane = 0").select("alt_id", "item_id", F.lit(1).alias("priority")).unionByName(a.filter("lane = 0").select("alt_id", (k + 1).alias("item_id"), F.lit(2).alias("priority")))
    tvdb = a.filter("lane = 1").select("alt_id", F.floor(k / 2).alias("tvdb_id"), F.lit(1).alias("priority"))
    bridge = f.select(F.floor(k / 3).alias("tvdb_id"), "item_id", "media_type")
    parents = a.filter("lane IN (1, 2)").select("alt_id", (F.col("alt_id") - 1).alias("parent_id"), F.lit(1).alias("hops"))
    items = f.select("item_id", search_title(F.col("name")).alias("search"), "media_type", "popularity")
    return P.resolve_alt_to_item(alt, direct, tvdb, bridge, parents, items)


@query("s13_user_lists", """
WITH l AS (SELECT owner, 'favourites' AS list_type, item_id, pos FROM loved UNION ALL SELECT owner, 'watchlist', item_id, pos FROM liked UNION ALL SELECT owner, 'recommendations', item_id, pos FROM community),
m AS (SELECT l.*, media_type FROM l JOIN item_features USING (item_id)), p AS (SELECT *, row_number() OVER (PARTITION BY owner, list_type, media_type ORDER BY pos) AS place FROM m)
SELECT owner, list_type, media_type, item_id, CAST(place - 20 AS INTEGER) AS pos FROM p WHERE place BETWEEN 21 AND 40""", ("loved", "liked", "community", "item_features"))
def s13(spark, d):
    lists = None
    for name, rows in (("favourites", D.feed(spark, d, "R")), ("watchlist", D.feed(spark, d, "A")), ("recommendations", D.community(spark, d))):
        rows = rows.select("owner", F.lit(name).alias("list_type"), "item_id", "pos")
        lists = rows if lists is None else lists.unionByName(rows)
    lists = lists.join(D.item_features(spark, d).select("item_id", "media_type"), "item_id")
    return S.read_user_lists(lists, page=2).select("owner", "list_type", "media_type", "item_id", "pos")
