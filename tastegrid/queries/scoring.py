"""Queries of the scores, over candidates from similar items of a profile's first loved items."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.operators import scoring as S
from tastegrid.operators import vectors as V
from tastegrid.operators.merging import count_days, day_masks
from tastegrid.operators.ranking import neighbours
from tastegrid.queries import query
from tastegrid.queries.vectors import fused, overall
from tastegrid.sources import domain as D
from tastegrid.sources.domain import BASE_SQL

BASE_SQL["candidates"] = (("loved", "similar_items"), "SELECT owner, dst_id AS item_id, count(*) AS n, min(position) AS place FROM loved JOIN similar_items ON item_id = src_id WHERE pos <= 5 GROUP BY ALL")
_SUM = lambda p, c: f"(SELECT coalesce(sum(f.weight), 0) FROM (SELECT unnest(i.{c}) AS x) t JOIN fused f ON f.owner = c.owner AND f.context = 'global' AND f.feature = '{p}:' || x)"
_WEIGHTS = "\n".join(f", w{p} AS (SELECT c.owner, c.item_id, CAST(sum(CAST(floor(f.weight * 1073741824.0::DOUBLE + 0.5) AS BIGINT)) AS DOUBLE) / 1073741824.0::DOUBLE AS w FROM (SELECT c.owner, c.item_id, unnest(i.{col}) AS x FROM candidates c JOIN item_features i USING (item_id)) c JOIN fused f ON f.owner = c.owner AND f.context = 'global' AND f.feature = '{p}:' || c.x GROUP BY ALL)" for p, col in (("g", "genre_ids"), ("k", "keyword_ids"), ("d", "director_ids"), ("a", "cast_ids[1:5]")))
BASE_SQL["scored_parts"] = (("candidates", "item_features", "fused"), "SELECT * FROM (WITH c0 AS (SELECT 1)" + _WEIGHTS + """
  SELECT c.owner, c.item_id, c.n, c.place, coalesce(wg.w, 0) AS genre, coalesce(wk.w, 0) AS keyword, coalesce(wd.w, 0) AS director, coalesce(wa.w, 0) AS actor,
    i.genre_ids, i.keyword_ids, i.vote_count, i.vote_average, i.popularity, i.media_type,
    vote_count / (vote_count + 300.0::DOUBLE) * vote_average + 300.0::DOUBLE / (vote_count + 300.0::DOUBLE) * 6.5::DOUBLE AS bayes
  FROM candidates c JOIN item_features i USING (item_id) LEFT JOIN wg USING (owner, item_id) LEFT JOIN wk USING (owner, item_id) LEFT JOIN wd USING (owner, item_id) LEFT JOIN wa USING (owner, item_id))""")
by_units = lambda x: f"floor((floor(({x}) * 1e9 + 0.5) + 500) / 1000) / 1e6"  # noqa: E731  as vectors.rounded
_BASE = "greatest(0.0::DOUBLE, least(10.0::DOUBLE, ((0.98::DOUBLE * (genre + keyword) + 0.02::DOUBLE * (director + actor)) + bayes) / 2))"
_LIGHT = "greatest(0.0::DOUBLE, least(10.0::DOUBLE, 0.7::DOUBLE * genre + 0.3::DOUBLE * bayes))"
_BONUS = "CASE WHEN vote_count < 20 THEN 0.0::DOUBLE WHEN vote_count <= 500 THEN 1.0::DOUBLE + (500 - vote_count) / 480.0::DOUBLE * 1.5::DOUBLE WHEN vote_count <= 2000 THEN greatest(0.0::DOUBLE, 1.0::DOUBLE - (vote_count - 500) / 1500.0::DOUBLE) ELSE 0.0::DOUBLE END"
_NICHE = f"greatest(0.0::DOUBLE, least(10.0::DOUBLE, (0.8::DOUBLE * (genre + 0.35::DOUBLE * keyword + 0.75::DOUBLE * len([x FOR x IN genre_ids IF x IN (99, 10402, 36, 37, 10770)])) + 0.2::DOUBLE * ({_BONUS})) * CASE WHEN vote_count > 0 AND vote_count < 20 THEN 0.15::DOUBLE ELSE 1 END))"


def edges(spark: SparkSession, d: str, *features: str) -> DataFrame:
    """Similar items with those features of the neighbour, each side dealt to as many tasks as the purchases."""
    e, n = D.similar(spark, d), D.tasks(spark, d)
    if features:
        e = e.repartition(n, "dst_id").join(D.item_features(spark, d).select(F.col("item_id").alias("dst_id"), *features).repartition(n, "dst_id"), "dst_id")
    return e


def candidates(spark: SparkSession, d: str, *features: str) -> DataFrame:
    """owner, item_id, n seeds and best place, and those features of the item; a seed goes to its owner's task with the list of its similar items.

    Features are joined to the edges, of which there are 20 an item, not to the candidates, of which there are 100 an owner.
    """
    seeds = D.feed(spark, d, "R").filter("pos <= 5").select("owner", F.col("item_id").alias("src_id"))
    return neighbours(seeds, edges(spark, d, *features), D.tasks(spark, d), "owner").groupBy("owner", "item_id", *features).agg(F.count("*").alias("n"), F.min("position").alias("place"))


def profiles(spark: SparkSession, d: str, context: str = "global") -> DataFrame:
    return V.as_maps(overall(spark, d) if context == "global" else fused(spark, d).filter(F.col("context") == context), "owner")


def both_profiles(spark: SparkSession, d: str, context: str) -> DataFrame:
    """owner, active and overall: a profile's vector in a context and the global one, from one pass over the vectors."""
    maps = V.as_maps(fused(spark, d).filter(F.col("context").isin(context, "global")), "owner", "context")
    of = lambda c: F.first(F.when(F.col("context") == c, F.col("vector")), ignorenulls=True)
    return maps.groupBy("owner").agg(of(context).alias("active"), of("global").alias("overall")).filter("active IS NOT NULL")


MATCH = ("genre_ids", "keyword_ids", "director_ids", "cast_ids", "vote_count", "vote_average")


def pool(spark: SparkSession, d: str, *features: str) -> DataFrame:
    """Candidates with features of the items, by default those of the match, and the profile's vector; one row of vector a profile, joined once."""
    return candidates(spark, d, *(features or MATCH)).join(profiles(spark, d), "owner")


def light_pool(spark: SparkSession, d: str, prefixes: tuple[str, ...] = ("g",)) -> DataFrame:
    """Candidates with what the light score needs: of the vector the genres only, or those of the prefixes."""
    own = profiles(spark, d).select("owner", F.struct(*(f"vector.{p}" for p in prefixes)).alias("vector"))
    return candidates(spark, d, "genre_ids", "vote_count", "vote_average").join(own, "owner")


def with_match(spark: SparkSession, d: str, kept: DataFrame) -> DataFrame:
    """kept (owner, item_id, ...) with the full score, whose features and vectors are joined to these rows only."""
    own = D.item_features(spark, d).select("item_id", *(c for c in ("genre_ids", "keyword_ids", "director_ids", "cast_ids", "vote_count", "vote_average") if c not in kept.columns))
    return kept.join(own, "item_id").join(profiles(spark, d), "owner").withColumn("full", S.base_match(F.col("vector"))).drop("vector")


def by_nine(df: DataFrame, **scores) -> DataFrame:
    return df.select("owner", "item_id", *(V.rounded(c, 6).alias(k) for k, c in scores.items()))


def cut(df: DataFrame, **scores) -> DataFrame:
    return df.select("owner", "item_id", *(F.round(c, 6).alias(k) for k, c in scores.items()))


@query("x01_bayes", "SELECT item_id, round(vote_count / (vote_count + 300.0::DOUBLE) * vote_average + 300.0::DOUBLE / (vote_count + 300.0::DOUBLE) * 6.5::DOUBLE, 6) AS score FROM item_features", ("item_features",))
def x01(spark, d):
    return D.item_features(spark, d).select("item_id", F.round(S.bayes(F.col("vote_count"), F.col("vote_average")), 6).alias("score"))


@query("x02_thematic", "SELECT owner, item_id, round(genre + keyword, 6) AS score FROM scored_parts", ("scored_parts",))
def x02(spark, d):
    return cut(pool(spark, d, "genre_ids", "keyword_ids"), score=S.thematic(F.col("vector")))


@query("x03_authorial", "SELECT owner, item_id, round(director + actor, 6) AS score FROM scored_parts", ("scored_parts",))
@D.in_shares
def x03(spark, d):
    return cut(pool(spark, d, "director_ids", "cast_ids"), score=S.authorial(F.col("vector")))


@query("x04_base_match", f"SELECT owner, item_id, round({_BASE}, 6) AS score, round(CASE WHEN owner % 2 = 0 AND (list_has_any(genre_ids, [27, 53, 80])) THEN -9999 ELSE {_BASE} END, 6) AS kids_score FROM scored_parts", ("scored_parts",))
def x04(spark, d):
    v = F.col("vector")
    return cut(pool(spark, d), score=S.base_match(v), kids_score=S.base_match(v, kids=F.col("owner") % 2 == 0))


@query("x05_dna_multiplier", "SELECT owner, item_id, CASE WHEN owner % 3 = 2 OR list_contains(genre_ids, CASE WHEN owner % 3 = 0 THEN 28 ELSE -1 END) OR list_contains(keyword_ids, CASE WHEN owner % 3 = 1 THEN 1010 ELSE -1 END) THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END AS score FROM scored_parts", ("scored_parts",))
def x05(spark, d):
    none = F.expr("CAST(array() AS array<bigint>)")
    genres, words = F.when(F.col("owner") % 3 == 0, S.ids([28])).otherwise(none), F.when(F.col("owner") % 3 == 1, S.ids([1010])).otherwise(none)
    return cut(pool(spark, d, "genre_ids", "keyword_ids"), score=S.dna_multiplier(genres, words))


BASE_SQL["wt1"] = (("candidates", "item_features", "fused"), """
  SELECT c.owner, c.item_id, 0.98::DOUBLE * (CAST(coalesce(sum(CAST(floor(f.weight * 1073741824.0::DOUBLE + 0.5) AS BIGINT)) FILTER (f.feature[1] = 'g'), 0) AS DOUBLE) / 1073741824.0::DOUBLE + CAST(coalesce(sum(CAST(floor(f.weight * 1073741824.0::DOUBLE + 0.5) AS BIGINT)) FILTER (f.feature[1] = 'k'), 0) AS DOUBLE) / 1073741824.0::DOUBLE) + 0.02::DOUBLE * (CAST(coalesce(sum(CAST(floor(f.weight * 1073741824.0::DOUBLE + 0.5) AS BIGINT)) FILTER (f.feature[1] = 'd'), 0) AS DOUBLE) / 1073741824.0::DOUBLE + CAST(coalesce(sum(CAST(floor(f.weight * 1073741824.0::DOUBLE + 0.5) AS BIGINT)) FILTER (f.feature[1] = 'a'), 0) AS DOUBLE) / 1073741824.0::DOUBLE) AS taste FROM (
    SELECT c.owner, c.item_id, unnest(['g:' || x FOR x IN genre_ids] || ['k:' || x FOR x IN keyword_ids] || ['d:' || x FOR x IN director_ids] || ['a:' || x FOR x IN cast_ids[1:5]]) AS feature FROM candidates c JOIN item_features USING (item_id)) c
    JOIN fused f ON f.owner = c.owner AND f.context = 'p1' AND f.feature = c.feature GROUP BY ALL""")


_BOTH = f"""
WITH a AS (SELECT s.owner, s.item_id, genre_ids, keyword_ids, greatest(0.0::DOUBLE, least(10.0::DOUBLE, (coalesce(taste, 0) + bayes) / 2)) AS active, {_BASE} AS overall
  FROM scored_parts s LEFT JOIN wt1 USING (owner, item_id) WHERE s.owner IN (SELECT owner FROM fused WHERE context = 'p1'))"""


@query("x06_item_match", _BOTH + """
SELECT owner, item_id, {round} AS score FROM (SELECT owner, item_id, greatest(0.0::DOUBLE, least(10.0::DOUBLE, (0.8::DOUBLE * active + 0.2::DOUBLE * overall) * CASE WHEN owner % 3 = 2 OR list_contains(genre_ids, CASE WHEN owner % 3 = 0 THEN 28 ELSE -1 END) OR list_contains(keyword_ids, CASE WHEN owner % 3 = 1 THEN 1010 ELSE -1 END) THEN 1.0::DOUBLE ELSE 0.1::DOUBLE END)) AS x FROM a)""".replace("{round}", by_units("x")), ("scored_parts", "wt1"))
def x06(spark, d):
    p = candidates(spark, d, *MATCH).join(both_profiles(spark, d, "p1"), "owner").filter("overall IS NOT NULL")
    none = F.expr("CAST(array() AS array<bigint>)")
    genres, words = F.when(F.col("owner") % 3 == 0, S.ids([28])).otherwise(none), F.when(F.col("owner") % 3 == 1, S.ids([1010])).otherwise(none)
    score = S.item_match(S.base_match(F.col("active")), S.base_match(F.col("overall")), S.dna_multiplier(genres, words))
    return p.select("owner", "item_id", V.rounded(score, 6).alias("score"))


@query("j26_blend_profile_scores", _BOTH + " SELECT owner, item_id, round(CASE WHEN owner % 2 = 0 THEN 0.8::DOUBLE * active + 0.2::DOUBLE * overall ELSE active END, 6) AS score FROM a", ("scored_parts", "wt1"))
@D.in_shares
def j26(spark, d):
    from tastegrid.operators.ranking import blended_score

    c = candidates(spark, d, *MATCH).join(both_profiles(spark, d, "p1"), "owner")
    overall = F.when((F.col("owner") % 2 == 0) & F.col("overall").isNotNull(), S.base_match(F.col("overall")))
    return c.select("owner", "item_id", F.round(blended_score(S.base_match(F.col("active")), overall), 6).alias("score"))


@query("x07_niche_bonus", f"SELECT item_id, round({_BONUS}, 6) AS score FROM item_features", ("item_features",))
def x07(spark, d):
    return D.item_features(spark, d).select("item_id", F.round(S.niche_bonus(F.col("vote_count")), 6).alias("score"))


@query("x08_light_score", f"SELECT owner, item_id, {by_units(_LIGHT)} AS score FROM scored_parts", ("scored_parts",))
def x08(spark, d):
    return by_nine(pool(spark, d, "genre_ids", "vote_count", "vote_average"), score=S.light_score(F.col("vector")))


@query("x09_niche_light_score", f"SELECT owner, item_id, {by_units(_NICHE)} AS score FROM scored_parts", ("scored_parts",))
def x09(spark, d):
    return by_nine(pool(spark, d, "genre_ids", "keyword_ids", "vote_count"), score=S.niche_light_score(F.col("vector")))


BASE_SQL["top_genres"] = (("fused",), "SELECT owner, list(CAST(id AS BIGINT) ORDER BY pos) AS top FROM (SELECT owner, split_part(feature, ':', 2) AS id, row_number() OVER (PARTITION BY owner ORDER BY round(weight, 9) DESC, CAST(split_part(feature, ':', 2) AS BIGINT)) AS pos FROM fused WHERE context = 'global' AND feature LIKE 'g:%') WHERE pos <= 3 GROUP BY owner")


def top_genres(spark: SparkSession, d: str) -> DataFrame:
    t = V.top_features(overall(spark, d), "g", 3, "owner")
    return t.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "feature"))), lambda s: F.substring_index(s["feature"], ":", -1).cast("long")).alias("top"))


_HYBRID = "greatest(0, 50 - place) + floor(100 / pow(2.0::DOUBLE, n - 1)) + CASE WHEN list_contains(genre_ids, top[1]) THEN 30 ELSE 0 END + CASE WHEN list_contains(genre_ids, top[2]) THEN 15 ELSE 0 END + CASE WHEN list_contains(genre_ids, top[3]) THEN 5 ELSE 0 END"


@query("x10_hybrid_score", f"SELECT owner, item_id, CAST({_HYBRID} AS DOUBLE) AS score FROM scored_parts JOIN top_genres USING (owner)", ("scored_parts", "top_genres"))
def x10(spark, d):
    p = candidates(spark, d, "genre_ids").join(top_genres(spark, d), "owner")
    return cut(p, score=S.hybrid_score(F.col("place"), F.col("n"), F.col("top"), F.col("genre_ids")).cast("double"))


_DAYS = "SELECT owner, catalog_id, item_id, count(DISTINCT seen_date) AS days FROM impressions GROUP BY ALL"


@query("a16_impression_days", _DAYS, ("impressions",))
def a16(spark, d):
    keys = ("owner", "catalog_id", "item_id")
    return count_days(day_masks(D.impressions(spark, d), "seen_date", *keys), *keys)


@query("x11_impression_penalty", f"SELECT owner, catalog_id, item_id, round(CASE WHEN days >= 3 THEN greatest(0.2::DOUBLE, 1 - 0.2::DOUBLE * (days - 2)) ELSE 1 END, 6) AS penalty FROM ({_DAYS})", ("impressions",))
def x11(spark, d):
    return a16(spark, d).select("owner", "catalog_id", "item_id", F.round(S.impression_penalty(F.col("days")), 6).alias("penalty"))


@query("j02_join_impressions", """
SELECT c.owner, c.profile_id, c.catalog_id, c.item_id, coalesce(days, 0) AS days FROM (SELECT owner, CASE WHEN n > 1 THEN 'other' ELSE 'global' END AS profile_id, 'c' || item_id % 2 AS catalog_id, item_id FROM candidates) c
LEFT JOIN (SELECT owner, profile_id, catalog_id, item_id, count(DISTINCT seen_date) AS days FROM impressions GROUP BY ALL) i ON i.owner = c.owner AND i.item_id = c.item_id AND i.catalog_id = c.catalog_id AND i.profile_id = c.profile_id""", ("candidates", "impressions"))
def j02(spark, d):
    from tastegrid.operators.ranking import join_impressions

    c = candidates(spark, d).select("owner", F.when(F.col("n") > 1, "other").otherwise("global").alias("profile_id"), F.concat(F.lit("c"), (F.col("item_id") % 2).cast("string")).alias("catalog_id"), "item_id")
    days = D.impressions(spark, d).groupBy("owner", "profile_id", "catalog_id", "item_id").agg(F.countDistinct("seen_date").alias("days"))
    return join_impressions(c, days)


@query("x13_genre_saturation", f"""
WITH r AS (SELECT owner, item_id, genre_ids, row_number() OVER (PARTITION BY owner ORDER BY round({_LIGHT}, 9) DESC, item_id) AS rank FROM scored_parts),
g AS (SELECT owner, item_id, rank, unnest(genre_ids) AS genre, unnest(range(len(genre_ids))) AS at FROM r),
s AS (SELECT *, row_number() OVER (PARTITION BY owner, genre ORDER BY rank, at) - 1 AS seen FROM g)
SELECT owner, item_id, CAST(rank AS INTEGER) AS rank, round(sum(CASE WHEN seen > 5 THEN 0.15::DOUBLE * (seen - 5) ELSE 0 END), 6) AS penalty FROM s GROUP BY ALL""".replace(" AS at", " AS k").replace("rank, at)", "rank, k)"), ("scored_parts",))
@D.in_shares
def x13(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("owner").orderBy(F.desc(F.round("light", 9)), "item_id")
    r = light_pool(spark, d).select("owner", "item_id", "genre_ids", S.light_score(F.col("vector")).alias("light")).withColumn("rank", F.row_number().over(w))
    return S.genre_saturation(r.select("owner", "item_id", "rank", "genre_ids"), "owner").select("owner", "item_id", "rank", F.round("penalty", 6).alias("penalty"))


@query("w02_two_tier", f"""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY round({_LIGHT}, 9) DESC, item_id) AS k, count(*) OVER (PARTITION BY owner) AS total FROM scored_parts),
f AS (SELECT l.owner, l.item_id, {_BASE} * CASE WHEN coalesce(days, 0) >= 3 THEN greatest(0.2::DOUBLE, 1 - 0.2::DOUBLE * (days - 2)) ELSE 1 END AS score
  FROM l LEFT JOIN (SELECT owner, item_id, count(DISTINCT seen_date) AS days FROM impressions WHERE catalog_id = 'c1' GROUP BY ALL) i USING (owner, item_id) WHERE k <= least(80, ceil(total / 2.0)))
SELECT owner, item_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY owner ORDER BY round(score, 9) DESC, item_id) AS INTEGER) AS pos FROM f""", ("scored_parts", "impressions"))
@D.in_shares
def w02(spark, d):
    from tastegrid.operators.ranking import two_tier

    p = light_pool(spark, d).select("owner", "item_id", S.light_score(F.col("vector")).alias("light"))
    days = a16(spark, d).filter("catalog_id = 'c1'").drop("catalog_id")
    return two_tier(p, days, "owner", full=lambda kept: with_match(spark, d, kept)).select("owner", "item_id", F.round("score", 6).alias("score"), "pos")


@query("q01_top_items", f"""
SELECT owner, item_id, round(score, 6) AS score, CAST(pos AS INTEGER) AS pos FROM (
  SELECT owner, item_id, score, row_number() OVER (PARTITION BY owner ORDER BY round(score, 9) DESC, item_id) AS pos FROM (
    SELECT owner, item_id, {_BASE} AS score FROM scored_parts ANTI JOIN (SELECT owner, item_id FROM watch_history WHERE context = 'global') USING (owner, item_id))) WHERE pos <= 10""", ("scored_parts", "watch_history"))
@D.in_shares
def q01(spark, d):
    """The flagship: each profile's ten best unseen candidates."""
    from tastegrid.operators.ranking import top_catalog, without_seen

    p = without_seen(pool(spark, d), D.watch_history(spark, d).filter("context = 'global'"))
    return top_catalog(p.select("owner", "item_id", S.base_match(F.col("vector")).alias("score")), 10, "owner").select("owner", "item_id", F.round("score", 6).alias("score"), "pos")
