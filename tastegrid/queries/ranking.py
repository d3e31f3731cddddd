"""Queries of ranking and merging."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastegrid.operators import merging as M
from tastegrid.operators import ranking as R
from tastegrid.queries import query
from tastegrid.queries.discovery import discovered
from tastegrid.queries.scoring import candidates
from tastegrid.queries.vectors import manual_dna
from tastegrid.sources import domain as D
from tastegrid.sources.domain import BASE_SQL

BASE_SQL["lists"] = (("discovered",), "SELECT catalog_id, query_idx AS list_idx, pos, item_id, popularity FROM discovered WHERE pos <= 60")


def lists(spark: SparkSession, d: str) -> DataFrame:
    return discovered(spark, d).filter("pos <= 60").select("catalog_id", F.col("query_idx").alias("list_idx"), "pos", "item_id", "popularity")


@query("w03_first_seen", "SELECT catalog_id, item_id, list_idx, CAST(pos AS INTEGER) AS pos FROM lists QUALIFY row_number() OVER (PARTITION BY catalog_id, item_id ORDER BY list_idx, pos) = 1", ("lists",))
def w03(spark, d):
    return R.first_seen(lists(spark, d), "item_id", ["list_idx", "pos"], "catalog_id").select("catalog_id", "item_id", "list_idx", "pos")


@query("w04_last_write", "SELECT owner, item_id, arg_max(episodes_watched, pos) AS episodes_watched, min(pos) AS pos FROM (SELECT owner, item_id, episodes_watched * 1000 + ascii(context[2]) AS episodes_watched, ascii(context[2]) AS pos FROM watch_history) GROUP BY ALL", ("watch_history",))
def w04(spark, d):
    code = F.ascii(F.substring("context", 2, 1))
    h = D.watch_history(spark, d).select("owner", "item_id", (F.col("episodes_watched") * 1000 + code).alias("episodes_watched"), code.alias("pos"))
    return R.last_write(h, "item_id", "episodes_watched", "pos", "owner")


@query("w05_interleave", """
WITH o AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY catalog_id, item_id ORDER BY pos, list_idx) = 1)
SELECT catalog_id, item_id, CAST(row_number() OVER (PARTITION BY catalog_id ORDER BY pos, list_idx) AS INTEGER) AS place FROM o QUALIFY place BETWEEN 3 AND 42""", ("lists",))
def w05(spark, d):
    return R.interleave(lists(spark, d), "catalog_id", limit=40, skip=2).select("catalog_id", "item_id", "place")


@query("a15_consensus", "SELECT catalog_id, item_id, count(*) AS n, CASE WHEN count(*) > 1 THEN count(*) * count(*) - 1 ELSE 0 END AS bonus FROM lists GROUP BY ALL", ("lists",))
def a15(spark, d):
    return R.consensus(lists(spark, d), "catalog_id").select("catalog_id", "item_id", "n", "bonus")


@query("w06_popularity_presentation", """
WITH c AS (SELECT catalog_id, item_id, CASE WHEN count(*) > 1 THEN count(*) * count(*) - 1 ELSE 0 END AS bonus, max(popularity) AS popularity FROM lists GROUP BY ALL)
SELECT catalog_id, item_id, CAST(row_number() OVER (PARTITION BY catalog_id ORDER BY bonus DESC, popularity DESC, item_id) AS INTEGER) AS place FROM c QUALIFY place <= 20""", ("lists",))
def w06(spark, d):
    c = lists(spark, d)
    c = R.consensus(c, "catalog_id").join(c.groupBy("catalog_id", "item_id").agg(F.max("popularity").alias("popularity")), ["catalog_id", "item_id"])
    return R.paginate(c, [F.desc("bonus"), F.desc("popularity"), "item_id"], "catalog_id").select("catalog_id", "item_id", "place")


@query("w08_paginate", "SELECT catalog_id, item_id, CAST(row_number() OVER (PARTITION BY catalog_id ORDER BY list_idx, pos) AS INTEGER) AS place FROM lists QUALIFY place BETWEEN 26 AND 45", ("lists",))
def w08(spark, d):
    return R.paginate(lists(spark, d), ["list_idx", "pos"], "catalog_id", skip=25).select("catalog_id", "item_id", "place")


_FULL = lambda own, taken, most: f"len([x FOR x IN {own} IF len([y FOR y IN {taken} IF y = x]) >= {most}]) > 0"


@query("w09_diversity_caps", f"""
WITH RECURSIVE l AS (SELECT catalog_id, CAST(pos AS INTEGER) AS pos, item_id, genre_ids AS g, director_ids AS d FROM discovered WHERE query_idx = 0 AND pos <= 100),
walk AS (SELECT catalog_id, 0 AS pos, CAST([] AS BIGINT[]) AS gs, CAST([] AS BIGINT[]) AS ds, CAST(NULL AS BIGINT) AS item_id, false AS kept FROM l WHERE pos = 1
  UNION ALL SELECT catalog_id, pos, CASE WHEN full_ THEN gs ELSE gs || g END, CASE WHEN full_ THEN ds ELSE ds || d END, item_id, NOT full_ FROM (
    SELECT w.catalog_id, l.pos, gs, ds, g, d, l.item_id, {_FULL('g', 'gs', 10)} OR {_FULL('d', 'ds', 3)} AS full_ FROM walk w JOIN l ON l.catalog_id = w.catalog_id AND l.pos = w.pos + 1))
SELECT catalog_id, item_id, pos FROM walk WHERE kept""", ("discovered",))
def w09(spark, d):
    rows = discovered(spark, d).filter("query_idx = 0 AND pos <= 100").select("catalog_id", "item_id", F.col("pos").cast("int").alias("pos"), "genre_ids", "director_ids")
    return R.diversity_caps(rows, "catalog_id").select("catalog_id", "item_id", "pos")


@query("w11_custom_order", "SELECT owner, catalog_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY CASE catalog_id WHEN 'stars' THEN 1 WHEN 'action' THEN 2 WHEN 'gems' THEN 3 END NULLS LAST, catalog_id) AS INTEGER) AS place FROM profile_catalogs", ("profile_catalogs",))
def w11(spark, d):
    order = spark.createDataFrame([("stars", 1), ("action", 2), ("gems", 3)], "catalog_id string, ord int")
    j = D.profile_catalogs(spark, d).join(F.broadcast(order), "catalog_id", "left")
    return j.select("owner", "catalog_id", F.row_number().over(Window.partitionBy("owner").orderBy(F.col("ord").asc_nulls_last(), "catalog_id")).alias("place"))


@query("w13_recent_history", "SELECT owner, item_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY last_watched_at DESC, item_id) AS INTEGER) AS place FROM watch_history WHERE context = 'global' QUALIFY place <= 10", ("watch_history",))
def w13(spark, d):
    return R.paginate(D.watch_history(spark, d).filter("context = 'global'"), [F.desc("last_watched_at"), "item_id"], "owner", size=10).select("owner", "item_id", "place")


@query("w14_top_catalog", "SELECT catalog_id, item_id, CAST(row_number() OVER (PARTITION BY catalog_id ORDER BY round(popularity, 9) DESC, item_id) AS INTEGER) AS pos FROM (SELECT DISTINCT catalog_id, item_id, popularity FROM lists) QUALIFY pos <= 10", ("lists",))
def w14(spark, d):
    return R.top_catalog(lists(spark, d).select("catalog_id", "item_id", "popularity").distinct(), 10, "catalog_id", score="popularity").select("catalog_id", "item_id", "pos")


@query("a10_similar_counts", "SELECT dst_id AS item_id, count(*) AS n FROM similar_items GROUP BY ALL", ("similar_items",))
def a10(spark, d):
    return R.similar_counts(D.similar(spark, d), D.tasks(spark, d))


BASE_SQL["seeds"] = (("loved", "liked", "community", "dna_seeds"), """SELECT owner, item_id, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT owner, item_id, 2 AS weight FROM loved WHERE pos <= 20 UNION ALL SELECT owner, item_id, 1 FROM liked WHERE pos <= 15
  UNION ALL SELECT owner, item_id, 3 FROM community WHERE pos <= 10 UNION ALL SELECT owner, item_id, 4 FROM dna_seeds) GROUP BY ALL""")
BASE_SQL["neighbours"] = (("seeds", "similar_items"), "SELECT owner, dst_id AS item_id, CAST(sum(weight) AS BIGINT) AS weight, min(position) AS place FROM seeds JOIN similar_items ON item_id = src_id GROUP BY ALL")


def seeds(spark: SparkSession, d: str) -> DataFrame:
    from tastegrid.queries.tastes import dna_seeds

    take = lambda df, n, w: df.filter(F.col("pos") <= n).select("owner", "item_id", F.lit(w).alias("weight"))
    feeds = take(D.feed(spark, d, "R"), 20, 2).unionByName(take(D.feed(spark, d, "A"), 15, 1)).unionByName(take(D.community(spark, d), 10, 3))
    return R.seed_weights(feeds.unionByName(take(dna_seeds(spark, d), 5, 4)), "owner", tasks=D.tasks(spark, d))


@query("a11_seed_weights", "SELECT * FROM seeds", ("seeds",))
def a11(spark, d):
    return seeds(spark, d)


@query("a12_weighted_neighbours", "SELECT * FROM neighbours", ("neighbours",))
def a12(spark, d, *features):
    from tastegrid.queries.scoring import edges

    return R.weighted_neighbours(seeds(spark, d), edges(spark, d, *features), "owner", tasks=D.tasks(spark, d))


@query("j15_expand_seeds", "SELECT * FROM candidates", ("candidates",))
def j15(spark, d):
    return candidates(spark, d)


@query("j04_hide_watched", "SELECT owner, item_id FROM candidates ANTI JOIN (SELECT owner, item_id FROM watch_history WHERE context = 'global') USING (owner, item_id)", ("candidates", "watch_history"))
def j04(spark, d):
    return R.without_seen(candidates(spark, d), D.watch_history(spark, d).filter("context = 'global'")).select("owner", "item_id")


@query("j01_hydrate_features", """
WITH c AS (SELECT item_id AS key, media_type, CASE WHEN item_id % 2 = 0 THEN item_id END AS item_id, CASE WHEN item_id % 2 = 1 THEN 'tt' || item_id END AS imdb_id, item_id % 3 = 0 AS known, row_number() OVER (PARTITION BY media_type ORDER BY item_id) AS k FROM item_features)
SELECT key, CASE WHEN known THEN '7' WHEN k <= 60 THEN array_to_string(coalesce(a.keyword_ids, b.keyword_ids), ',') END AS keywords FROM c LEFT JOIN item_features a ON a.item_id = c.item_id LEFT JOIN item_features b ON 'tt' || b.item_id = c.imdb_id""", ("item_features",))
def j01(spark, d):
    f = D.item_features(spark, d)
    i = F.col("item_id")
    named = F.concat(F.lit("tt"), i.cast("string"))
    c = f.select(i.alias("key"), "media_type", F.when(i % 2 == 0, i).alias("item_id"), F.when(i % 2 == 1, named).alias("imdb_id"), F.when(i % 3 == 0, F.array(F.lit(7).cast("long"))).alias("keyword_ids"), F.lit(None).cast("array<bigint>").alias("cast_ids"))
    return R.hydrate_features(c, f.select("item_id", named.alias("imdb_id"), "keyword_ids", "cast_ids"), ["key"], "media_type").select("key", F.array_join("keyword_ids", ",").alias("keywords"))


@query("j03_attach_profile", "SELECT c.owner, c.context, (SELECT count(*) FROM fused f WHERE f.owner = c.owner AND f.context = c.context AND feature LIKE 'g:%') AS active, CASE WHEN c.context <> 'global' THEN (SELECT count(*) FROM fused f WHERE f.owner = c.owner AND f.context = 'global' AND feature LIKE 'g:%') END AS overall FROM contexts c", ("contexts", "fused"))
def j03(spark, d):
    from tastegrid.operators.vectors import as_maps
    from tastegrid.queries.vectors import counts, fused

    j = R.attach_profile(counts(spark, d).select("owner", "context"), as_maps(fused(spark, d), "owner", "context"))
    return j.select("owner", "context", F.size("active.g").cast("long").alias("active"), F.when(F.col("overall").isNotNull(), F.size("overall.g")).cast("long").alias("overall"))


@query("s07_upsert_history", """
SELECT owner, item_id, CAST(sum(episodes_watched) AS BIGINT) AS episodes_watched, max(last_watched_at) AS last_watched_at, arg_max(media_type, last_watched_at) AS media_type, arg_max(source, last_watched_at) AS source FROM (SELECT owner, item_id, episodes_watched, last_watched_at, 'movie' AS media_type, 'feed' AS source FROM watch_history WHERE context = 'global'
  UNION ALL SELECT CAST(user_id AS BIGINT), event_id % 50 + 1, 1, ts, 'tv', 'event' || event_id % 3 FROM events WHERE event_type = 'purchase') GROUP BY ALL""", ("watch_history",))
def s07(spark, d):
    e = D.read(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").cast("long").alias("owner"), (F.col("event_id") % 50 + 1).alias("item_id"), F.lit(1).cast("long").alias("episodes_watched"), F.col("ts").alias("last_watched_at"), F.lit("tv").alias("media_type"), F.concat(F.lit("event"), (F.col("event_id") % 3).cast("string")).alias("source"))
    h = D.watch_history(spark, d).filter("context = 'global'").withColumns({"media_type": F.lit("movie"), "source": F.lit("feed")})
    return M.upsert_history(h.select(*e.columns), e, "owner", "item_id")


@query("u01_dna_filters", """
SELECT owner, array_to_string([type || ':' || id] || CASE WHEN type <> 'genre' OR id <> '28' THEN ['genre:28'] ELSE [] END, ',') AS filters FROM manual_dna""", ("manual_dna",))
def u01(spark, d):
    m = manual_dna(spark, d)
    suggested = F.array(F.struct(F.lit("genre").alias("type"), F.lit("28").alias("id")), F.struct(F.lit(None).cast("string").alias("type"), F.lit("9").alias("id")), F.struct(F.col("type"), F.col("id")))
    f = M.dna_filters(F.array(F.struct("type", "id")), suggested)
    return m.select("owner", F.array_join(F.transform(f, lambda x: F.concat(x["type"], F.lit(":"), x["id"])), ",").alias("filters"))


@query("u06_ratings_export", """
WITH l AS (SELECT owner, media_type, CASE WHEN item_id % 5 > 0 THEN 'tt' || item_id ELSE 'tmdb:' || item_id END AS id FROM loved JOIN item_features USING (item_id)), k AS (SELECT owner, media_type, CASE WHEN item_id % 5 > 0 THEN 'tt' || item_id ELSE 'tmdb:' || item_id END AS id FROM liked JOIN item_features USING (item_id))
SELECT owner, media_type, id, 10 AS rating FROM l WHERE starts_with(id, 'tt') UNION ALL SELECT owner, media_type, id, 8 FROM k ANTI JOIN l USING (owner, media_type, id) WHERE starts_with(id, 'tt')""", ("loved", "liked", "item_features"))
def u06(spark, d):
    i = F.col("item_id")
    named = D.item_features(spark, d).select("item_id", "media_type", F.concat(F.when(i % 5 > 0, "tt").otherwise("tmdb:"), i.cast("string")).alias("id"))
    return M.ratings_export(D.feed(spark, d, "R").join(named, "item_id"), D.feed(spark, d, "A").join(named, "item_id"))


@query("u07_smart_merge", """
WITH r AS (SELECT owner, catalog_id, query_idx, media_type, with_genres, with_keywords, sort_by, row_number() OVER (PARTITION BY owner ORDER BY catalog_id, query_idx) AS k FROM profile_catalogs JOIN definitions USING (catalog_id)),
p AS (SELECT a.owner, a.k, a.with_genres AS ga, b.with_genres AS gb, a.with_keywords AS ka, b.with_keywords AS kb, coalesce(a.sort_by, b.sort_by, 'popularity.desc') AS sort_by, coalesce(a.media_type, b.media_type) AS kind FROM (SELECT * REPLACE (CASE WHEN owner % 3 > 0 THEN sort_by END AS sort_by, CASE WHEN owner % 2 = 0 THEN media_type END AS media_type) FROM r) a JOIN r b ON a.owner = b.owner AND b.k = a.k + 1)
SELECT owner, k, sort_by, kind, (SELECT string_agg(x, '|' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT trim(unnest(string_split_regex(concat_ws('|', ga, gb), '[,|]'))) AS x, unnest(range(100)) AS i) WHERE x <> '' GROUP BY x)) AS genres,
  (SELECT string_agg(x, '|' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT trim(unnest(string_split_regex(concat_ws('|', ka, kb), '[,|]'))) AS x, unnest(range(100)) AS i) WHERE x <> '' GROUP BY x)) AS keywords FROM p""", ("profile_catalogs", "definitions"))
def u07(spark, d):
    """Each profile's neighbouring queries, merged."""
    q = D.profile_catalogs(spark, d).join(F.broadcast(D.definitions(spark)), "catalog_id")
    q = q.withColumn("k", F.row_number().over(Window.partitionBy("owner").orderBy("catalog_id", "query_idx")))
    own = {"with_genres": F.col("with_genres"), "with_keywords": F.col("with_keywords")}
    side = lambda name, fields: F.create_map(*(x for n, c in {**own, **fields}.items() for x in (F.lit(n), c))).alias(name)
    a = q.select("owner", "k", side("a", {"sort_by": F.when(F.col("owner") % 3 > 0, F.col("sort_by")), "type": F.when(F.col("owner") % 2 == 0, F.col("media_type"))}))
    b = q.select("owner", (F.col("k") - 1).alias("k"), side("b", {"sort_by": F.col("sort_by"), "type": F.col("media_type")}))
    m = a.join(b, ["owner", "k"]).select("owner", "k", M.smart_merge(F.col("a"), F.col("b")).alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k))
    return m.select("owner", "k", get("sort_by").alias("sort_by"), get("type").alias("kind"), get("with_genres").alias("genres"), get("with_keywords").alias("keywords"))


@query("u04_dedupe_profile_catalogs", """
WITH c AS (SELECT owner, catalog_id, row_number() OVER (PARTITION BY owner, catalog_id ORDER BY 1) AS k FROM (SELECT * FROM profile_catalogs UNION ALL SELECT owner, catalog_id FROM profile_catalogs WHERE owner % 2 = 0))
SELECT owner, count(*) FILTER (k = 1) AS kept, count(*) FILTER (k > 1) AS removed FROM c GROUP BY owner""", ("profile_catalogs",))
def u04(spark, d):
    p = D.profile_catalogs(spark, d)
    c = p.withColumn("pos", F.lit(0)).unionByName(p.filter("owner % 2 = 0").withColumn("pos", F.lit(1)))
    kept = R.first_seen(c, "catalog_id", ["pos"], "owner").groupBy("owner").agg(F.count("*").alias("kept"))
    return c.groupBy("owner").agg(F.count("*").alias("n")).join(kept, "owner").select("owner", "kept", (F.col("n") - F.col("kept")).alias("removed"))


@query("u05_blend_popular", """
WITH l AS (SELECT item_id, 0 AS list_idx, row_number() OVER (ORDER BY popularity DESC, item_id) AS pos FROM item_features WHERE media_type = 'movie' QUALIFY pos <= 30),
r AS (SELECT item_id, 1 AS list_idx, row_number() OVER (ORDER BY vote_count DESC, item_id) AS pos FROM item_features WHERE media_type = 'movie' QUALIFY pos <= 30),
u AS (SELECT * FROM (SELECT * FROM l UNION ALL SELECT * FROM r) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY list_idx, pos) = 1),
o AS (SELECT CAST(c_custkey AS BIGINT) AS owner, u.* FROM customer, u)
SELECT owner, item_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY list_idx, pos) AS INTEGER) AS place FROM o ANTI JOIN (SELECT owner, item_id FROM watch_history WHERE context = 'global') h USING (owner, item_id) QUALIFY place <= 40""", ("item_features", "watch_history"))
def u05(spark, d):
    m = D.item_features(spark, d).filter("media_type = 'movie'")
    top = lambda c, i: m.orderBy(F.desc(c), "item_id").limit(30).select("item_id", F.lit(i).alias("list_idx"), F.row_number().over(Window.orderBy(F.desc(c), "item_id")).alias("pos"))
    owners = D.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("owner"))
    seen = D.watch_history(spark, d).filter("context = 'global'").select("owner", "item_id")
    return R.blend_lists(top("popularity", 0).unionByName(top("vote_count", 1)), owners, seen).select("owner", "item_id", "place")


@query("p25_dna_params", "SELECT owner, array_to_string(genres, '|') AS with_genres, array_to_string(keywords, '|') AS with_keywords, array_to_string(countries, '|') AS with_origin_country FROM dna", ("dna",))
def p25(spark, d):
    from tastegrid.queries.tastes import dna

    p = dna(spark, d).select("owner", M.dna_params(F.col("genres"), F.col("keywords"), F.col("countries")).alias("m"))
    return p.select("owner", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("with_genres", "with_keywords", "with_origin_country")))
