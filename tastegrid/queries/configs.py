"""Queries of configurations: nested profiles, catalogs and queries derived from customers and the definitions."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastegrid.operators import configs as G
from tastegrid.queries import query
from tastegrid.queries.vectors import manual_dna
from tastegrid.sources import domain as D
from tastegrid.sources.domain import BASE_SQL

_KEYS = ["with_genres", "without_genres", "with_keywords", "with_cast", "with_crew", "sort_by"]
BASE_SQL["profile_rows"] = (("profile_catalogs", "definitions"), """
  SELECT owner, dense_rank() OVER (PARTITION BY owner ORDER BY catalog_id) - 1 AS catalog_pos, catalog_id, media_type, query_idx AS query_pos, with_genres, with_keywords, sort_by FROM profile_catalogs JOIN definitions USING (catalog_id)""")


def as_query(*keys: str):
    """The named columns as a query map, without empty ones."""
    return F.map_filter(F.create_map(*(x for k in keys for x in (F.lit(k), F.col(k)))), lambda _, v: v.isNotNull())


def catalog(id_, type_, queries=None, filters=None, source=None, strategy=None, sources=None, source_filters=None):
    none = {"filters": G.QUERY, "queries": f"array<{G.QUERY}>", "sources": "array<string>", "source_filters": f"array<{G.QUERY}>"}
    given = {"filters": filters, "queries": queries, "sources": sources, "source_filters": source_filters}
    c = {k: F.lit(None).cast(kind) if given[k] is None else given[k] for k, kind in none.items()}
    text = lambda x: F.lit(x).cast("string") if x is None or isinstance(x, str) else x
    return F.struct(id_.alias("id"), F.concat(F.lit("Catalog "), id_).alias("name"), type_.alias("type"), text(source).alias("source"), text(strategy).alias("strategy"), *(c[k].alias(k) for k in ("filters", "queries", "sources", "source_filters")))


def preset_rows(spark: SparkSession) -> DataFrame:
    """preset, catalog: the definitions as catalogs with their queries in order."""
    q = D.definitions(spark).groupBy("catalog_id", "media_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("query_idx", F.to_json(as_query(*_KEYS)).alias("q")))), lambda s: F.from_json(s["q"], G.QUERY)).alias("queries"))
    return q.select(F.col("catalog_id").alias("preset"), catalog(F.col("catalog_id"), F.col("media_type"), F.col("queries")).alias("catalog"))


@D.shared
def configs(spark: SparkSession, d: str) -> DataFrame:
    """uuid, profiles: one profile a customer, with its catalogs in order of id."""
    own = D.profile_catalogs(spark, d).join(F.broadcast(preset_rows(spark)), F.col("catalog_id") == F.col("preset"))
    own = own.groupBy("owner").agg(F.array_sort(F.collect_list("catalog.id")).alias("_ids"), F.collect_list("catalog").alias("_c"))
    catalogs = F.transform("_ids", lambda i: F.element_at(F.filter("_c", lambda c: c["id"] == i), 1))
    c = D.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("owner"))
    profile = F.struct(F.lit("global").alias("id"), F.coalesce(catalogs, F.expr(f"CAST(array() AS array<{G.CATALOG}>)")).alias("catalogs"))
    return c.join(own, "owner", "left").select(F.concat(F.lit("u"), F.col("owner").cast("string")).alias("uuid"), "owner", F.array(profile).alias("profiles"))


@query("s09_explode_catalogs", "SELECT 'u' || owner AS uuid, CAST(0 AS INTEGER) AS profile_pos, CAST(catalog_pos AS INTEGER) AS catalog_pos, CAST(query_pos AS INTEGER) AS query_pos, catalog_id, media_type AS type, with_genres, sort_by FROM profile_rows", ("profile_rows",))
def s09(spark, d):
    e = G.explode_catalogs(configs(spark, d))
    return e.select("uuid", "profile_pos", "catalog_pos", "query_pos", "catalog_id", "type", F.try_element_at("query", F.lit("with_genres")).alias("with_genres"), F.try_element_at("query", F.lit("sort_by")).alias("sort_by"))


@query("s08_resolve_config", """
SELECT handle, CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 'u' || c_custkey END AS uuid, CASE WHEN c_custkey % 3 <> 2 AND c_custkey % 5 > 0 THEN 'user' || c_custkey END AS user_id, CASE WHEN c_custkey % 3 <> 2 THEN CASE WHEN c_custkey % 2 = 0 THEN 'p' ELSE 'q' END || c_custkey END AS profile_id
FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'u' || c_custkey WHEN 1 THEN CASE WHEN c_custkey % 5 > 0 THEN 'user' || c_custkey ELSE 'u' || c_custkey END ELSE 'none' || c_custkey END AS handle FROM customer)""")
def s08(spark, d):
    k = F.col("c_custkey")
    named = lambda p: F.concat(F.lit(p), k.cast("string"))
    c = D.read(spark, d, "customer")
    accounts = c.filter("c_custkey % 5 > 0").select(named("user").alias("user_id"), named("u").alias("addon_uuid"))
    conf = c.select(named("u").alias("uuid"), F.when(k % 2 == 0, named("p")).otherwise("").alias("id"), named("q").alias("_id"))
    handles = c.select(F.when(k % 3 == 0, named("u")).when(k % 3 == 1, F.when(k % 5 > 0, named("user")).otherwise(named("u"))).otherwise(named("none")).alias("handle"))
    return G.resolve_config(accounts, conf, handles)


@query("u03_upsert_catalogs", """
WITH s AS (SELECT owner, ['action', 'gems', 'missing'] AS selected FROM (SELECT CAST(c_custkey AS BIGINT) AS owner FROM customer)),
o AS (SELECT DISTINCT owner, catalog_pos AS pos, catalog_id AS id, 'old' AS kind FROM profile_rows UNION ALL SELECT owner, 1000, 'preset_action', 'stale' FROM s WHERE owner % 2 = 0),
n AS (SELECT owner, 2000 + i AS pos, 'preset_' || x AS id, 'new' AS kind FROM (SELECT owner, unnest(selected) AS x, unnest(range(3)) AS i FROM s) WHERE x IN (SELECT catalog_id FROM definitions)),
a AS (SELECT * FROM o UNION ALL SELECT * FROM n), m AS (SELECT owner, id, min(pos) AS pos, arg_max(kind, pos) AS kind FROM a GROUP BY ALL)
SELECT owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY pos) - 1 AS INTEGER) AS pos, id, kind = 'new' AS fresh FROM m""", ("profile_rows", "definitions"))
def u03(spark, d):
    p = configs(spark, d).select("owner", F.col("profiles")[0]["catalogs"].alias("catalogs"))
    stale = F.array(catalog(F.lit("preset_action"), F.lit("stale")))
    p = p.withColumn("catalogs", F.when(F.col("owner") % 2 == 0, F.concat("catalogs", stale)).otherwise(F.col("catalogs"))).withColumn("selected", F.array(F.lit("action"), F.lit("gems"), F.lit("missing")))
    kept, _ = G.upsert_catalogs(p, preset_rows(spark))
    return kept.select("owner", F.posexplode("catalogs").alias("pos", "c")).select("owner", "pos", F.col("c.id").alias("id"), F.col("c.id").startswith("preset_").alias("fresh"))


@query("u03_unknown_presets", "SELECT CAST(c_custkey AS BIGINT) AS owner, 'missing' AS preset FROM customer")
def u03_unknown(spark, d):
    p = configs(spark, d).select("owner", F.col("profiles")[0]["catalogs"].alias("catalogs"), F.array(F.lit("action"), F.lit("gems"), F.lit("missing")).alias("selected"))
    return G.upsert_catalogs(p, preset_rows(spark))[1]


@query("u09_merge_profiles", """
SELECT owner, CASE WHEN owner % 4 = 3 THEN 'new' WHEN owner % 2 = 0 THEN 'mine' ELSE 'stored' END AS theme, CASE WHEN owner % 4 = 3 THEN NULL ELSE 'it' END AS region, CASE WHEN owner % 4 = 3 THEN NULL WHEN owner % 3 = 0 THEN 'b' ELSE 'a' END AS manual,
  CASE WHEN owner % 4 = 3 THEN 'x,y,x' ELSE 'x,y' END AS selected, CASE WHEN owner % 4 = 3 THEN 'c1,c2,c1' ELSE 'c1:in,c2:in' END AS catalogs, CASE WHEN owner % 4 = 3 THEN 9.0::DOUBLE ELSE 1.0::DOUBLE END AS score
FROM (SELECT CAST(c_custkey AS BIGINT) AS owner FROM customer)""".replace("'c1,c2,c1' ELSE 'c1:in,c2:in'", "'c1:first,c2:in,c1:in' ELSE 'c1:in,c2:in'"))
def u09(spark, d):
    k = F.col("owner")
    c = D.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("owner")).withColumns({"uuid": F.concat(F.lit("u"), k.cast("string")), "profile_id": F.lit("global")})
    text = lambda *v: F.array(*map(F.lit, v))
    cat = lambda i, n: F.struct(F.lit(i).alias("id"), F.lit(n).alias("name"))
    none = F.lit(None)
    stored = c.filter("owner % 4 < 3").select("uuid", "profile_id", F.create_map(F.lit("theme"), F.lit("stored"), F.lit("region"), F.lit("it")).alias("settings"), text("a").alias("manual_dna"), text("s").alias("suggested_dna"), F.array(cat("c0", "stored")).alias("catalogs"), text("z").alias("selected"), text("z").alias("catalog_order"), F.create_map(F.lit("g:1"), F.lit(1.0)).alias("dna"))
    theme = F.when(k % 4 == 3, F.create_map(F.lit("theme"), F.lit("new"))).when(k % 2 == 0, F.create_map(F.lit("theme"), F.lit("mine")))
    incoming = c.select("uuid", "profile_id", F.coalesce(theme, F.expr("CAST(map() AS map<string,string>)")).alias("settings"), F.when((k % 3 == 0) & (k % 4 < 3), text("b")).otherwise(none.cast("array<string>")).alias("manual_dna"), none.cast("array<string>").alias("suggested_dna"), F.array(cat("c1", "first"), cat("c2", "in"), cat("c1", "in")).alias("catalogs"), text("x", "y", "x").alias("selected"), text("x").alias("catalog_order"), F.create_map(F.lit("g:1"), F.lit(9.0)).alias("dna"))
    m = G.merge_profiles(stored, incoming)
    get = lambda c, key: F.try_element_at(c, F.lit(key))
    return m.select(F.substring("uuid", 2, 20).cast("long").alias("owner"), get("settings", "theme").alias("theme"), get("settings", "region").alias("region"), F.array_join("manual_dna", ",").alias("manual"), F.array_join("selected", ",").alias("selected"), F.array_join(F.transform("catalogs", lambda x: F.concat_ws(":", x["id"], x["name"])), ",").alias("catalogs"), get("dna", "g:1").alias("score"))


def forms(spark: SparkSession, d: str) -> DataFrame:
    """owner and a catalog of each form: queries, filters, merged by source, merged mixed, or nothing."""
    k = F.col("owner")
    c = D.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("owner"), F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("id"))
    q = F.create_map(F.lit("with_genres"), F.lit("28"))
    return c.select("owner", "id", F.lit(None).cast("string").alias("name"), F.lit("movie").alias("type"), F.when(k % 5 == 2, "merged").alias("source"), F.when(k % 5 == 3, "mixed").when(k % 10 == 0, "interleave").alias("strategy"),
                    F.when((k % 5).isin(1, 2), q).alias("filters"), F.when(k % 5 == 0, F.array(q, F.create_map(F.lit("with_genres"), F.lit("12")))).alias("queries"),
                    F.when((k % 5).isin(2, 3), F.array(F.lit("action"), F.concat(F.lit("own"), (k % 7).cast("string")), F.lit("nowhere"))).alias("sources"), F.when((k % 5).isin(2, 3), F.array(F.create_map(F.lit("with_genres"), F.lit("1")), q, F.create_map(F.lit("with_genres"), F.lit("99")))).alias("source_filters"))


@query("u10_unify_catalog", """
SELECT owner, CASE owner % 5 WHEN 0 THEN 2 WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 1 END AS n, CASE WHEN owner % 5 = 3 OR owner % 10 = 0 THEN 'interleave' ELSE 'popularity' END AS presentation, owner % 5 IN (2, 3) AS is_merge, CASE WHEN owner % 5 = 1 THEN 'discovery' END AS strategy
FROM (SELECT CAST(c_custkey AS BIGINT) AS owner FROM customer)""")
def u10(spark, d):
    u = G.unify_catalog(forms(spark, d))
    return u.select("owner", F.when(F.col("queries").isNotNull(), F.size("queries")).alias("n"), "presentation", "is_merge", F.try_element_at(F.get("queries", F.lit(0)), F.lit("strategy")).alias("strategy"))


def merged_queries(spark: SparkSession, d: str) -> DataFrame:
    m = G.unify_catalog(forms(spark, d)).filter("is_merge").select("owner", F.col("id").alias("catalog_id"), "sources", "source_filters")
    k = F.col("owner")
    own = D.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("owner")).filter("owner % 2 = 0").select("owner", F.concat(F.lit("own"), (k % 7).cast("string")).alias("id"), F.create_map(F.lit("with_genres"), F.lit("16")).alias("filters"), F.lit(None).cast(f"array<{G.QUERY}>").alias("queries"))
    presets = preset_rows(spark).select(F.col("preset").alias("id"), F.lit(None).cast(G.QUERY).alias("filters"), "catalog.queries")
    return G.resolve_merge_sources(m, own, presets)


BASE_SQL["merged_rows"] = (("definitions",), """
  SELECT owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY src, query_idx) - 1 AS INTEGER) AS query_pos, genres FROM (
    SELECT owner, 0 AS src, query_idx, with_genres AS genres FROM m, (SELECT * FROM definitions WHERE catalog_id = 'action') UNION ALL SELECT owner, 1, 0, CASE WHEN owner % 2 = 0 THEN '16' ELSE '28' END FROM m UNION ALL SELECT owner, 2, 0, '99' FROM m)""".replace("FROM m", "FROM (SELECT CAST(c_custkey AS BIGINT) AS owner FROM customer WHERE c_custkey % 5 IN (2, 3)) m"))


@query("j22_resolve_merge_sources", "SELECT * FROM merged_rows", ("merged_rows",))
def j22(spark, d):
    m = merged_queries(spark, d).select("owner", F.posexplode("queries").alias("query_pos", "q"))
    return m.select("owner", "query_pos", F.try_element_at("q", F.lit("with_genres")).alias("genres"))


@query("c17_merged_catalog", """
WITH k AS (SELECT genres, item_id, row_number() OVER (PARTITION BY genres ORDER BY popularity DESC, item_id) AS pos FROM (SELECT unnest(['16', '28', '99']) AS genres) JOIN item_features ON media_type = 'movie' AND list_contains(genre_ids, CAST(genres AS BIGINT)) QUALIFY pos <= 60),
l AS (SELECT owner, query_pos AS list_idx, pos, item_id FROM merged_rows JOIN discovered ON catalog_id = 'action' AND query_idx = query_pos WHERE query_pos < 2 AND pos <= 60 UNION ALL SELECT owner, query_pos, pos, item_id FROM merged_rows JOIN k USING (genres) WHERE query_pos >= 2),
o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY owner, item_id ORDER BY pos, list_idx) = 1)
SELECT owner, item_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY pos, list_idx) AS INTEGER) AS pos FROM o QUALIFY row_number() OVER (PARTITION BY owner ORDER BY pos, list_idx) <= 20""", ("merged_rows", "discovered", "item_features"))
def c17(spark, d):
    """A page of each merged catalog: all queries of its sources, with all their filters, in turn."""
    from tastegrid.operators.matching import from_maps, match
    from tastegrid.operators.ranking import interleave

    q = merged_queries(spark, d).select("owner", F.posexplode("queries").alias("list_idx", "q"))
    rows = match(D.item_features(spark, d), from_maps(q, "q", F.lit("movie")), 60, "owner")
    return interleave(rows.select("owner", "list_idx", "pos", "item_id"), "owner", limit=20).select("owner", "item_id", F.col("place").alias("pos"))


@query("u02_confirm_dna", "SELECT owner, type, id FROM manual_dna UNION SELECT owner, 'genre', '28' FROM manual_dna", ("manual_dna",))
def u02(spark, d):
    m = manual_dna(spark, d).select("owner", "type", "id")
    return G.confirm_dna(m, m.select("owner", F.lit("genre").alias("type"), F.lit("28").alias("id")).union(m.filter("owner % 2 = 0")).distinct())


@query("u11_merge_template", "SELECT owner, array_to_string(own || [x FOR x IN ['gems', 'stars', 'family'] IF NOT list_contains(own, x)], ',') AS presets FROM (SELECT owner, list(catalog_id ORDER BY catalog_id) AS own FROM profile_catalogs GROUP BY owner)", ("profile_catalogs",))
def u11(spark, d):
    own = D.profile_catalogs(spark, d).groupBy("owner").agg(F.array_sort(F.collect_list("catalog_id")).alias("own"))
    return own.select("owner", F.array_join(G.merge_template(F.col("own"), F.array(*map(F.lit, ["gems", "stars", "family"]))), ",").alias("presets"))


@query("c19_profile_sync", "SELECT owner, item_id, media_type, 'liked' AS source, count(*) AS episodes_watched FROM profile_catalogs JOIN merged_page USING (catalog_id) JOIN item_features USING (item_id) WHERE k <= 20 GROUP BY ALL", ("profile_catalogs", "merged_page", "item_features"))
def c19(spark, d):
    """What a profile's catalogs show on their first pages, as liked items of its history."""
    from tastegrid.plans.catalogs import preset_catalog, sync_profiles
    from tastegrid.queries.discovery import discovered

    return sync_profiles(D.profile_catalogs(spark, d), preset_catalog(discovered(spark, d)), D.item_features(spark, d))
