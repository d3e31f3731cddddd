"""Queries of model answers, presets, audits, bounds of items and combined search."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastegrid.operators import audits as A
from tastegrid.operators import discovery as X
from tastegrid.operators import ranking as R
from tastegrid.operators import requests as Q
from tastegrid.operators import scoring as S
from tastegrid.queries import query
from tastegrid.queries import tastes as T
from tastegrid.queries.discovery import discovered
from tastegrid.operators.vectors import rounded
from tastegrid.queries.scoring import _BASE, _LIGHT, by_units
from tastegrid.queries.tastes import _DNA, scored_sql
from tastegrid.sources import domain as D
from tastegrid.sources.domain import BASE_SQL

B = X.Discovery


def bounded(name: str, block: X.Discovery, where: str) -> None:
    @query(name, f"SELECT item_id FROM item_features JOIN item_traits USING (item_id) WHERE {where}", ("item_features", "item_traits"))
    def run(spark, d):
        return D.item_features(spark, d).join(D.item_traits(spark, d), "item_id").filter(block.predicate()).select("item_id")


bounded("r08_runtime_range", B(media_type="movie", runtime_gte=60, runtime_lte=100), "media_type = 'movie' AND runtime BETWEEN 60 AND 100")
bounded("r08_runtime_series", B(media_type="tv", runtime_gte=60), "media_type = 'tv'")
bounded("r12_people_all", B(with_people="3,7"), "list_has_all(cast_ids || director_ids, [3, 7])")
bounded("r13_company", B(with_companies="3|11"), "list_has_any(company_ids, [3, 11])")
bounded("r13_network", B(with_networks="201,302"), "list_has_all(network_ids, [201, 302])")
bounded("r14_watch_provider", B(watch_provider="Prime"), "list_contains(offers_it, 119)")
bounded("r14_provider_region", B(watch_provider="netflix", watch_region="US"), "(item_id IN (SELECT p_partkey + 1 FROM part WHERE p_size % 3 = 1))")
bounded("r10_certification_block", B(certification_lte="PG"), "certificate IN ('G', 'PG')")


@query("r17_sort_labels", "SELECT item_id, CAST(row_number() OVER (PARTITION BY media_type ORDER BY t.revenue DESC, item_id) AS INTEGER) AS by_revenue, CAST(row_number() OVER (PARTITION BY media_type ORDER BY vote_average DESC, item_id) AS INTEGER) AS by_vote FROM item_features JOIN item_traits t USING (item_id)", ("item_features", "item_traits"))
def r17(spark, d):
    i = D.item_features(spark, d).join(D.item_traits(spark, d).select("item_id", "revenue"), "item_id")
    by = lambda label: F.row_number().over(Window.partitionBy("media_type").orderBy(B(sort_by=label).sort_key().desc_nulls_last(), "item_id"))
    return i.select("item_id", by("revenue").alias("by_revenue"), by("vote").alias("by_vote"))


DOCS = [({"catalog_id": "found", "query_idx": 0}, B(media_type="movie", with_genres="99", with_keywords="1005|1025")), ({"catalog_id": "empty", "query_idx": 0}, B(media_type="movie", with_genres="99", with_keywords="1003")), ({"catalog_id": "action", "query_idx": 0}, B(media_type="movie", with_genres="28", with_keywords="1004"))]


@query("r22_relax_documentary", """
WITH a AS (SELECT 'found' AS catalog_id, 0 AS relaxed, item_id FROM item_features WHERE media_type = 'movie' AND list_contains(genre_ids, 99) AND list_has_any(keyword_ids, [1005, 1025]) UNION ALL SELECT 'empty', 0, item_id FROM item_features WHERE media_type = 'movie' AND list_contains(genre_ids, 99) AND list_contains(keyword_ids, 1003)
  UNION ALL SELECT 'action', 0, item_id FROM item_features WHERE media_type = 'movie' AND list_contains(genre_ids, 28) AND list_contains(keyword_ids, 1004))
SELECT * FROM a UNION ALL SELECT c, 1, item_id FROM (SELECT unnest(['found', 'empty']) AS c), item_features WHERE media_type = 'movie' AND list_contains(genre_ids, 99) AND c NOT IN (SELECT catalog_id FROM a)""", ("item_features",))
def r22(spark, d):
    return X.discover_relaxed(D.item_features(spark, d), DOCS).select("catalog_id", "relaxed", "item_id")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """event_id, content: what a model might answer, in seven forms."""
    k = F.col("event_id")
    s = k.cast("string")
    forms = F.array(
        F.concat(F.lit('```json\n[{"vibe":"v'), s, F.lit('","genre_ids":['), (k % 90).cast("string"), F.lit('],"keyword":"kw'), s, F.lit('","evil":1}]\n```')),
        F.concat(F.lit('Sure: {"queries":[{"genre_ids":["x"],"vibe":"w'), s, F.lit('"},{"keyword":5},{"evil":1},7]} done')),
        F.concat(F.lit('[{"vibe":"c","genre_ids":[1,'), (k % 90).cast("string"), F.lit(',],}, // note\n /* more */ ]')),
        F.lit("no json at all"), F.lit('{"a":1}'), F.concat(F.lit('[{"keyword":"k'), s, F.lit('"},{"genre_ids":[]},{"genre_ids":[1.5]}]')), F.lit(None).cast("string"))
    return D.read(spark, d, "events").select("event_id", F.element_at(forms, (k % 7 + 1).cast("int")).alias("content"))


@query("p19_parse_model_queries", """
SELECT event_id, 0 AS pos, 'v' || event_id AS vibe, CAST(event_id % 90 AS VARCHAR) AS genres, 'kw' || event_id AS keyword FROM events WHERE event_id % 7 = 0 UNION ALL SELECT event_id, 0, 'w' || event_id, NULL, NULL FROM events WHERE event_id % 7 = 1
UNION ALL SELECT event_id, 0, 'c', '1,' || (event_id % 90), NULL FROM events WHERE event_id % 7 = 2 UNION ALL SELECT event_id, 0, NULL, NULL, 'k' || event_id FROM events WHERE event_id % 7 = 5 UNION ALL SELECT event_id, 1, NULL, '', NULL FROM events WHERE event_id % 7 = 5""")
def p19(spark, d):
    return Q.parse_model_queries(answers(spark, d), "event_id").select("event_id", "pos", "vibe", F.array_join("genre_ids", ",").alias("genres"), "keyword")


_PROMPTS = ["red", "lue bol", "ring", "nothing like it"]
VISITOR = 1_000_000  # owners beyond have no profile


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """owner, prompt, content: a search of each customer and a model's plan for it."""
    k = F.col("owner")
    c = D.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("owner"))
    c = c.union(c.filter("owner % 6 = 1").select(F.col("owner") + VISITOR)).withColumn("prompt", F.element_at(F.array(*map(F.lit, _PROMPTS)), (k % 4 + 1).cast("int")))
    plan = F.array(
        F.concat(F.lit('Plan: {"queries":[{"strategy":"discovery","genre_ids":[28,'), (k % 20 + 10).cast("string"), F.lit('],"target":"tmdb"},{"strategy":"multi_search","target":"elsewhere"},{"strategy":"odd","text_search":"widget","genre_ids":["a"],"people_list":["X"]}]}')),
        F.lit("[]"), F.lit("sorry, no"), F.concat(F.lit('[{"strategy":"similar","target":"trakt","similar_to":"hot ring"},{"strategy":"similar","similar_to":"Red Plate"},{"strategy":"discovery","genre_ids":['), (k % 20 + 10).cast("string"), F.lit(']}]')), F.lit('{"strategy":"static_list","static_items":["red bolt","Blue Widget","Zzz"]}'))
    return c.withColumn("content", F.element_at(plan, (k % 5 + 1).cast("int")))


BASE_SQL["prompts"] = ((), f"SELECT owner, {_PROMPTS!r}[owner % 4 + 1] AS prompt FROM (SELECT CAST(c_custkey AS BIGINT) AS owner FROM customer UNION ALL SELECT CAST(c_custkey AS BIGINT) + {VISITOR} FROM customer WHERE c_custkey % 6 = 1)")
BASE_SQL["plans"] = (("prompts",), """
  SELECT owner, 0 AS pos, 'discovery' AS strategy, 'tmdb' AS target, NULL AS text_search, [28, owner % 20 + 10] AS genres, NULL AS people, NULL AS titles, NULL AS like_ FROM prompts WHERE owner % 5 = 0 UNION ALL SELECT owner, 1, 'multi_search', 'tmdb', prompt, NULL, NULL, NULL, NULL FROM prompts WHERE owner % 5 = 0
  UNION ALL SELECT owner, 2, 'multi_search', 'tmdb', 'widget', NULL, 'X', NULL, NULL FROM prompts WHERE owner % 5 = 0 UNION ALL SELECT owner, 0, 'multi_search', 'tmdb', prompt, NULL, NULL, NULL, NULL FROM prompts WHERE owner % 5 IN (1, 2)
  UNION ALL SELECT owner, 0, 'similar', 'trakt', NULL, NULL, NULL, NULL, 'hot ring' FROM prompts WHERE owner % 5 = 3 UNION ALL SELECT owner, 1, 'similar', 'tmdb', NULL, NULL, NULL, NULL, 'Red Plate' FROM prompts WHERE owner % 5 = 3 UNION ALL SELECT owner, 2, 'discovery', 'tmdb', NULL, [owner % 20 + 10], NULL, NULL, NULL FROM prompts WHERE owner % 5 = 3 UNION ALL SELECT owner, 0, 'static_list', NULL, NULL, NULL, NULL, 'red bolt,Blue Widget,Zzz', NULL FROM prompts WHERE owner % 5 = 4""")


@query("p20_sanitize_query_rows", "SELECT owner, pos, strategy, target, text_search, array_to_string(genres, ',') AS genres, people, titles FROM plans", ("plans",))
def p20(spark, d):
    q = Q.sanitize_query_rows(prompts(spark, d), "owner")
    return q.select("owner", "pos", "strategy", "target", "text_search", F.array_join("genre_ids", ",").alias("genres"), F.array_join("people", ",").alias("people"), F.array_join("static_items", ",").alias("titles"))


_TOPS = lambda p, n: f"(SELECT owner, list(CAST(split_part(feature, ':', 2) AS BIGINT)) AS top FROM (SELECT * FROM fused WHERE context = 'global' AND feature LIKE '{p}:%' QUALIFY row_number() OVER (PARTITION BY owner ORDER BY round(weight, 9) DESC, CAST(split_part(feature, ':', 2) AS BIGINT)) <= {n}) GROUP BY owner)"
BASE_SQL["names"] = (("item_features",), "SELECT asked, coalesce((SELECT min(item_id) FROM item_features WHERE lower(name) = lower(asked)), (SELECT min(item_id) FROM item_features WHERE list_contains(string_split(lower(name), ' '), lower(asked)))) AS id FROM (SELECT unnest(['red bolt', 'Blue Widget', 'Zzz', 'Red Plate']) AS asked)")
BASE_SQL["search_lists"] = (("plans", "prompts", "fused", "names", "similar_items", "item_features"), f"""
  SELECT owner, list_idx, pos, item_id FROM (
    SELECT owner, list_idx, item_id, row_number() OVER (PARTITION BY owner, list_idx ORDER BY CASE WHEN lower(name) = lower(text) THEN 0 WHEN starts_with(lower(name), lower(text)) THEN 1 ELSE 2 END, popularity DESC, item_id) AS pos
      FROM (SELECT owner, pos AS list_idx, text_search AS text FROM plans WHERE strategy = 'multi_search' AND target = 'tmdb' UNION ALL SELECT owner, 0, prompt FROM prompts WHERE owner NOT IN (SELECT owner FROM plans WHERE coalesce(target, 'tmdb') = 'tmdb')) p JOIN item_features ON contains(lower(name), lower(text))
    UNION ALL SELECT owner, p.pos, dst_id, s.position FROM plans p JOIN names ON asked = like_ JOIN similar_items s ON src_id = id WHERE strategy = 'similar' AND target = 'tmdb'
    UNION ALL SELECT owner, list_idx, item_id, row_number() OVER (PARTITION BY owner, list_idx ORDER BY popularity DESC, item_id) FROM (
      SELECT p.owner, p.pos AS list_idx, p.genres || coalesce(g.top, []) AS want, coalesce(k.top, []) AS words FROM plans p LEFT JOIN {_TOPS('g', 2)} g USING (owner) LEFT JOIN {_TOPS('k', 3)} k USING (owner) WHERE strategy = 'discovery' AND target = 'tmdb') q
      JOIN item_features ON list_has_any(genre_ids, want) AND (len(words) = 0 OR list_has_any(keyword_ids, words))) WHERE pos <= 20""")
BASE_SQL["search_pool"] = (("search_lists",), "SELECT owner, item_id, count(*) AS n FROM search_lists WHERE owner NOT IN (SELECT owner FROM plans WHERE strategy = 'static_list') GROUP BY ALL")
BASE_SQL["search_parts"] = (("search_pool", "item_features", "fused"), scored_sql("search_pool"))


def tastes(spark: SparkSession, d: str) -> DataFrame:
    """owner, genres, keywords: a profile's best two and three, in order."""
    return T.tastes(spark, d).select("owner", F.slice("own_genres", 1, 2).alias("genres"), F.slice("own_keywords", 1, 3).alias("keywords"))


@query("c10_combined_search", f"""
WITH s AS (SELECT owner, item_id, vote_average + CASE WHEN n > 1 THEN n * n - 1 ELSE 0 END + CASE WHEN owner IN (SELECT owner FROM fused WHERE context = 'global') THEN greatest(0.0::DOUBLE, least(10.0::DOUBLE, {_BASE} * {_DNA})) ELSE 0 END AS score, popularity, n FROM search_parts LEFT JOIN dna USING (owner))
SELECT owner, item_id, {by_units('score')} AS score, CAST(row_number() OVER (PARTITION BY owner ORDER BY round(score, 9) DESC, popularity DESC, n DESC, item_id) AS INTEGER) AS pos FROM s QUALIFY pos <= 20
UNION ALL SELECT owner, id, NULL, CAST(row_number() OVER (PARTITION BY owner ORDER BY at_) AS INTEGER) FROM (SELECT owner, unnest(string_split(titles, ',')) AS asked, generate_subscripts(string_split(titles, ','), 1) AS at_ FROM plans WHERE strategy = 'static_list') JOIN names USING (asked) WHERE id IS NOT NULL""", ("search_parts", "dna", "fused", "plans", "names"))
def c10(spark, d):
    """Searches as their plans have them: texts, similar titles, discoveries and lists of titles, with or without a profile."""
    from tastegrid.plans.catalogs import combined_search, named_lists, planned_lists
    from tastegrid.sources.tables import written

    items, asked = D.item_features(spark, d), prompts(spark, d)
    plan = written(Q.sanitize_query_rows(asked, "owner"), "plans")
    named = named_lists(plan, items)
    lists = planned_lists(plan.join(named.select("owner").distinct(), "owner", "left_anti"), asked.select("owner", "prompt").join(plan.filter("strategy = 'static_list'").select("owner"), "owner", "left_anti"), items, D.similar(spark, d), tastes(spark, d))
    return combined_search(lists, named, items, T.item_match(spark, d)).withColumn("score", rounded(F.col("score"), 6))


BASE_SQL["affinity_pool"] = (("profile_catalogs", "discovered"), "SELECT DISTINCT owner, item_id FROM profile_catalogs JOIN discovered USING (catalog_id) WHERE query_idx = 0 AND pos <= 20")
BASE_SQL["affinity_parts"] = (("affinity_pool", "item_features", "fused"), scored_sql("affinity_pool"))


@query("a21_affinity_report", f"""
WITH c AS (SELECT owner, catalog_id, item_id, pos FROM profile_catalogs JOIN discovered USING (catalog_id) WHERE query_idx = 0 AND pos <= 20)
SELECT owner, catalog_id, item_id, CAST(pos AS INTEGER) AS pos, {by_units(_LIGHT)} AS light, {by_units(f'greatest(0.0::DOUBLE, least(10.0::DOUBLE, {_BASE} * {_DNA}))')} AS match FROM c JOIN affinity_parts USING (owner, item_id) LEFT JOIN dna USING (owner) WHERE owner IN (SELECT owner FROM fused WHERE context = 'global')""", ("profile_catalogs", "discovered", "affinity_parts", "dna", "fused"))
def a21(spark, d):
    c = D.profile_catalogs(spark, d).join(discovered(spark, d).filter("query_idx = 0 AND pos <= 20").select("catalog_id", "item_id", "pos"), "catalog_id")
    light = T.light(spark, d, c.select("owner", "item_id").distinct(), S.light_score)
    return A.affinity_report(c, T.item_match(spark, d)(light)).select("owner", "catalog_id", "item_id", "pos", rounded(F.col("light"), 6).alias("light"), rounded(F.col("full"), 6).alias("match"))



BASE_SQL["lint_presets"] = ((), """
  SELECT 'p' || p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'series' ELSE 'movie' END AS type, CASE p_size % 4 WHEN 0 THEN 'Top ' WHEN 1 THEN 'Popular ' WHEN 2 THEN 'Trend ' ELSE '' END || p_name AS name, CASE WHEN p_size % 5 > 0 THEN ['28', '10759', '16|35', '18,80'][p_size % 4 + 1] END AS with_genres,
    CASE WHEN p_size % 7 = 0 THEN '1001' END AS with_keywords, CASE WHEN p_size % 11 = 0 THEN '210024' END AS without_keywords, CASE WHEN p_size % 13 = 0 THEN '7' END AS with_cast, CASE WHEN p_size % 6 = 0 THEN 'it' END AS with_original_language, CASE WHEN p_size % 3 = 1 THEN 8.0::DOUBLE END AS vote_average_gte,
    CASE WHEN p_size % 4 > 0 THEN p_size * 30 END AS vote_count_gte, ['popularity.desc', 'vote_average.desc', NULL][p_size % 3 + 1] AS sort_by, CASE p_size % 3 WHEN 0 THEN 'today' WHEN 1 THEN 'today-2m' ELSE 'today-14d' END AS since FROM part""")


def preset_json(spark: SparkSession, d: str) -> DataFrame:
    """id, json: preset definitions derived from parts, with dates relative to a day."""
    s = F.col("p_size")
    pick = lambda n, *v: F.element_at(F.array(*map(F.lit, v)), (s % n + 1).cast("int"))
    q = F.create_map(*(x for k, v in {
        "with_genres": F.when(s % 5 > 0, pick(4, "28", "10759", "16|35", "18,80")), "with_keywords": F.when(s % 7 == 0, "1001"), "without_keywords": F.when(s % 11 == 0, "210024"), "with_cast": F.when(s % 13 == 0, "7"), "with_original_language": F.when(s % 6 == 0, "it"),
        "vote_average.gte": F.when(s % 3 == 1, "8.0"), "vote_count.gte": F.when(s % 4 > 0, (s * 30).cast("string")), "sort_by": pick(3, "popularity.desc", "vote_average.desc", None), "primary_release_date.lte": pick(3, "today", "today-2m", "today-14d")}.items() for x in (F.lit(k), v)))
    q = F.map_filter(q, lambda _, v: v.isNotNull())
    body = F.struct(F.concat(pick(4, "Top ", "Popular ", "Trend ", ""), "p_name").alias("name"), F.when(s % 3 == 0, "series").otherwise("movie").alias("type"), F.col("p_type").alias("category"), F.array(q).alias("queries"), F.array(F.concat(F.lit("p"), (F.col("p_partkey") + 1).cast("string")), F.lit("p0")).alias("presets"))
    return D.read(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.to_json(body).alias("json"))


def presets(spark: SparkSession, d: str) -> DataFrame:
    return Q.load_presets(preset_json(spark, d), F.lit("1998-05-31").cast("date"))


@query("s10_load_presets", "SELECT id, name, type, with_genres, sort_by, CASE since WHEN 'today' THEN '1998-05-31' WHEN 'today-2m' THEN '1998-03-31' ELSE '1998-05-17' END AS until FROM lint_presets", ("lint_presets",))
def s10(spark, d):
    get = lambda k: F.try_element_at(F.col("queries")[0], F.lit(k))
    return presets(spark, d).select("id", "name", "type", get("with_genres").alias("with_genres"), get("sort_by").alias("sort_by"), get("primary_release_date.lte").alias("until"))


@query("a19_preset_lint", """
WITH g AS (SELECT *, [CAST(x AS BIGINT) FOR x IN string_split_regex(coalesce(with_genres, ''), '[|,]') IF x <> ''] AS ids FROM lint_presets),
f AS (SELECT id, unnest([
  CASE WHEN type = 'movie' AND len([x FOR x IN ids IF x IN (10759, 10762, 10763, 10764, 10765, 10766, 10767, 10768)]) > 0 THEN 'series genre' WHEN type = 'series' AND len([x FOR x IN ids IF x IN (28, 12, 14, 36, 27, 10402, 10749, 878, 10770, 53, 10752)]) > 0 THEN 'film genre' END,
  CASE WHEN type = 'series' AND NOT contains(id, 'anime') AND NOT coalesce(contains(with_keywords, '210024'), false) AND coalesce(with_genres, '') <> '16' AND NOT coalesce(contains(without_keywords, '210024'), false) THEN 'anime not excluded' END,
  CASE WHEN CAST(with_genres IS NOT NULL AS INTEGER) + CAST(with_keywords IS NOT NULL AS INTEGER) + CAST(with_cast IS NOT NULL AS INTEGER) + CAST(coalesce(vote_average_gte >= 8, false) AS INTEGER) + CAST(coalesce(vote_count_gte > 1000, false) AS INTEGER) + CAST(with_original_language IS NOT NULL AS INTEGER) >= 4 THEN 'too narrow' END,
  CASE WHEN sort_by = 'vote_average.desc' AND coalesce(vote_count_gte, 0) < 50 THEN 'few votes' END, CASE WHEN sort_by = 'popularity.desc' AND coalesce(vote_count_gte, 0) < 5 AND NOT contains(id, 'new') AND NOT contains(id, 'recent') THEN 'no votes' END,
  CASE WHEN regexp_matches(lower(name), 'best|top|cult') AND sort_by <> 'vote_average.desc' THEN 'not by vote' END, CASE WHEN regexp_matches(lower(name), 'popular|trend') AND sort_by <> 'popularity.desc' THEN 'not by popularity' END, CASE WHEN sort_by IS NULL THEN 'no order' END]) AS finding FROM g)
SELECT id, finding FROM f WHERE finding IS NOT NULL""", ("lint_presets",))
def a19(spark, d):
    return A.preset_lint(presets(spark, d))


@query("a19_similar_presets", "SELECT type, coalesce(with_genres, '') AS genres, coalesce(with_keywords, '') AS keywords, coalesce(with_cast, '') AS cast_list, count(DISTINCT name) AS names, count(*) AS n FROM lint_presets GROUP BY ALL HAVING count(DISTINCT name) > 1", ("lint_presets",))
def a19_similar(spark, d):
    return A.similar_presets(presets(spark, d)).select("type", "genres", "keywords", "cast_list", "names", "n")


@query("a24_preset_categories", "SELECT p_type AS category, CAST(row_number() OVER (ORDER BY min(p_partkey)) AS INTEGER) AS pos FROM part GROUP BY p_type")
def a24(spark, d):
    p = presets(spark, d).withColumn("pos", F.substring("id", 2, 20).cast("long"))
    return A.preset_categories(p)


# Fixed values of the fixture: what some catalogs ask for besides their definitions.
_MORE_RULES = {
    "with_original_language": "CASE WHEN catalog_id IN ('action', 'recent') THEN 'en|it' END", "without_original_language": "CASE WHEN catalog_id IN ('family', 'stars') THEN 'ko' END", "with_companies": "CASE WHEN catalog_id IN ('gems', 'makers') THEN '11|12|13|21' END",
    "with_watch_providers": "CASE WHEN catalog_id IN ('adventure', 'comedy') THEN '350|351|8' END", "watch_region": "'IT'", "without_keywords": "CASE WHEN catalog_id IN ('drama_pair', 'action') THEN '1004|1010' END",
}
_BREAKS = {
    "missing genres": "with_genres IS NOT NULL AND NOT list_has_any(genre_ids, {with_genres})", "missing keywords": "with_keywords IS NOT NULL AND NOT list_has_any(keyword_ids, {with_keywords})", "missing cast": "with_cast IS NOT NULL AND NOT list_has_any(cast_ids, {with_cast})",
    "missing crew": "with_crew IS NOT NULL AND NOT list_has_any(director_ids, {with_crew})", "missing companies": "with_companies IS NOT NULL AND NOT list_has_any(company_ids, {with_companies})", "missing provider": "with_watch_providers IS NOT NULL AND NOT list_has_any(offers_it, {with_watch_providers})",
    "excluded keywords": "without_keywords IS NOT NULL AND list_has_any(keyword_ids, {without_keywords})", "other language": "with_original_language IS NOT NULL AND NOT list_contains(string_split(with_original_language, '|'), original_language)", "excluded language": "original_language = without_original_language",
}
_NUMBERS = {c: f"[CAST(x AS BIGINT) FOR x IN string_split_regex({c}, '[,|]')]" for c in ("with_genres", "with_keywords", "with_cast", "with_crew", "with_companies", "with_watch_providers", "without_keywords")}


@query("a18_relevance_audit", f"""
WITH e AS (SELECT catalog_id, with_genres, with_keywords, with_cast, with_crew, {", ".join(f"{v} AS {k}" for k, v in _MORE_RULES.items())} FROM definitions WHERE query_idx = 0),
own AS (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN [] ELSE genre_ids END AS genre_ids, CASE WHEN item_id % 5 = 0 THEN [] ELSE keyword_ids END AS keyword_ids, CASE WHEN item_id % 3 = 0 THEN [] ELSE director_ids END AS director_ids, cast_ids, original_language, company_ids, offers_it FROM item_features JOIN item_traits USING (item_id) WHERE item_id % 9 > 0),
r AS (SELECT t.catalog_id, t.item_id, [x FOR x IN [CASE WHEN o.item_id IS NULL THEN 'missing details' END, {", ".join(f"CASE WHEN o.item_id IS NOT NULL AND {v.format(**_NUMBERS)} THEN '{k}' END" for k, v in _BREAKS.items())}] IF x IS NOT NULL] AS found
  FROM (SELECT catalog_id, item_id FROM discovered WHERE query_idx = 0 AND pos <= 20) t JOIN e USING (catalog_id) LEFT JOIN own o ON o.item_id = t.item_id)
SELECT catalog_id, message, count(*) AS n, round(any_value(success), 6) AS success FROM (SELECT catalog_id, unnest(found) AS message FROM r) JOIN (SELECT catalog_id, count(*) FILTER (len(found) = 0) / count(*) AS success FROM r GROUP BY ALL) USING (catalog_id) GROUP BY catalog_id, message""", ("discovered", "definitions", "item_features", "item_traits"))
def a18(spark, d):
    """Items of the catalogs against details that lack genres, keywords or crew for some."""
    k = F.col("item_id")
    none = F.expr("CAST(array() AS array<bigint>)")
    top = discovered(spark, d).filter("query_idx = 0 AND pos <= 20").select("catalog_id", "item_id")
    own = D.item_features(spark, d).join(D.item_traits(spark, d), "item_id").filter("item_id % 9 > 0").withColumns({"genre_ids": F.when(k % 4 == 0, none).otherwise(F.col("genre_ids")), "keyword_ids": F.when(k % 5 == 0, none).otherwise(F.col("keyword_ids")), "director_ids": F.when(k % 3 == 0, none).otherwise(F.col("director_ids"))})
    rules = D.definitions(spark).filter("query_idx = 0").select("catalog_id", "with_genres", "with_keywords", "with_cast", "with_crew", *(F.expr(v).alias(c) for c, v in _MORE_RULES.items()))
    return A.relevance_audit(top, own, rules).withColumn("success", F.round("success", 6))


@query("p27_block_to_query", """
SELECT id, coalesce(sort_by, 'popularity.desc') AS sort_by, replace(with_genres, '|', ',') AS with_genres, CASE WHEN vote_average_gte > 0 THEN '8.0' END AS vote_min, CASE WHEN type = 'series' THEN 'first_air_date.lte' ELSE 'primary_release_date.lte' END AS date_key, '1998-12-31' AS date_value, CASE WHEN vote_count_gte IS NOT NULL THEN CAST(vote_count_gte AS VARCHAR) END AS votes FROM lint_presets""", ("lint_presets",))
def p27(spark, d):
    """Stored queries to editor blocks and back: years for dates, unknown fields carried through."""
    p = presets(spark, d).select("id", F.when(F.col("type") == "series", "tv").otherwise("movie").alias("media_type"), Q.query_to_block(F.col("queries")[0]).alias("block"))
    q = p.select("id", "media_type", Q.block_to_query(F.col("block"), F.col("media_type")).alias("q"))
    key = F.when(F.col("media_type") == "tv", "first_air_date.lte").otherwise("primary_release_date.lte")
    get = lambda k: F.try_element_at("q", F.lit(k))
    return q.select("id", get("sort_by").alias("sort_by"), get("with_genres").alias("with_genres"), get("vote_average.gte").alias("vote_min"), key.alias("date_key"), F.try_element_at("q", key).alias("date_value"), get("vote_count.gte").alias("votes"))
