"""Audits of catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.operators.discovery import offers

# Genres that only films, or only series, have, and the keyword of anime.
ANIME = "210024"
SERIES_ONLY = ("10759", "10762", "10763", "10764", "10765", "10766", "10767", "10768")
FILM_ONLY = tuple(str(g) for g in (28, 12, 14, 36, 27, 10402, 10749, 878, 10770, 53, 10752))


def catalog_overlap(members: DataFrame, share: float = 0.1) -> DataFrame:
    """Pairs of catalogs (catalog_id, media_type, item_id) that share more than `share` of the smaller one, without pairs on any item.

    With items in order of the number of catalogs that hold them, the first item that two such catalogs share is among
    the first size - floor(share * size) of the smaller one, and has as many after it in the larger one. So pairs come
    from rare items; what most catalogs hold is last in all of them and makes none. Shared items are counted for
    those pairs only.
    """
    k = members.select("catalog_id", F.concat_ws(":", "media_type", "item_id").alias("item")).distinct()
    held = k.groupBy("item").agg(F.count("*").alias("held"))
    size = k.groupBy("catalog_id").agg(F.count("*").alias("size"))
    w = Window.partitionBy("catalog_id").orderBy("held", "item")
    ranked = k.join(held, "item").join(size, "catalog_id").withColumn("at", F.row_number().over(w))
    least = lambda c: F.floor(F.col(c) * share)  # noqa: E731  fewer than these items after the first shared one are too few
    a = ranked.filter(F.col("at") <= F.col("size") - least("size")).select(F.col("catalog_id").alias("small"), "item", F.col("size").alias("s"))
    b = ranked.select(F.col("catalog_id").alias("large"), "item", F.col("size").alias("l"), F.col("at").alias("place"))
    larger = (F.col("s") < F.col("l")) | ((F.col("s") == F.col("l")) & (F.col("small") < F.col("large")))
    pairs = a.join(b, "item").filter(larger & (F.col("place") <= F.col("l") - least("s"))).select("small", "large", "s", "l").distinct()
    both = pairs.join(k.select(F.col("catalog_id").alias("small"), "item"), "small").join(k.select(F.col("catalog_id").alias("large"), "item"), ["large", "item"])
    both = both.groupBy("small", "large", "s", "l").agg(F.count("*").alias("shared")).filter(F.col("shared") > F.lit(share) * F.col("s"))
    turn = F.col("small") < F.col("large")
    return both.select(F.least("small", "large").alias("left_id"), F.greatest("small", "large").alias("right_id"), "shared", F.when(turn, F.col("s")).otherwise(F.col("l")).alias("left_size"), F.when(turn, F.col("l")).otherwise(F.col("s")).alias("right_size"))


def relevance_audit(top: DataFrame, details: DataFrame, rules: DataFrame) -> DataFrame:
    """(catalog_id, message, n, success): how often the items of a catalog (at most its first 20) break its filters.

    rules: (catalog_id, filters as lists of ids or codes), of which any may be missing: with_genres, with_keywords,
    without_keywords, with_cast, with_crew, with_companies, with_original_language, without_original_language, and
    with_watch_providers in watch_region. An item without details is one finding of its own. success is the share of
    items without any.
    """
    known = ("with_genres", "with_keywords", "without_keywords", "with_cast", "with_crew", "with_companies", "with_original_language", "without_original_language", "with_watch_providers", "watch_region")
    lists = {"company_ids": "array<bigint>", "original_language": "string", "providers": "map<string,struct<flatrate:array<bigint>,rent:array<bigint>,buy:array<bigint>,ads:array<bigint>>>"}
    rules = rules.withColumns({c: F.lit(None).cast("string") for c in known if c not in rules.columns})
    details = details.withColumns({c: F.lit(None).cast(k) for c, k in lists.items() if c not in details.columns})
    j = top.join(rules, "catalog_id").join(details.withColumn("_known", F.lit(True)), "item_id", "left")
    text = lambda c: F.transform(F.split(F.col(c), "[,|]"), lambda x: F.trim(x))
    ids = lambda c: text(c).cast("array<bigint>")
    none = F.expr("CAST(array() AS array<bigint>)")
    asked = lambda c: F.col("_known").isNotNull() & F.col(c).isNotNull()
    lacks = lambda c, own, word: F.when(asked(c) & ~F.arrays_overlap(ids(c), F.coalesce(own, none)), f"missing {word}")
    pairs = (("with_genres", "genre_ids", "genres"), ("with_keywords", "keyword_ids", "keywords"), ("with_cast", "cast_ids", "cast"), ("with_crew", "director_ids", "crew"), ("with_companies", "company_ids", "companies"))
    found = F.array(
        F.when(F.col("_known").isNull(), "missing details"), *(lacks(c, F.col(own), word) for c, own, word in pairs), lacks("with_watch_providers", offers(F.col("providers"), F.col("watch_region")), "provider"),
        F.when(asked("without_keywords") & F.arrays_overlap(ids("without_keywords"), F.coalesce("keyword_ids", none)), "excluded keywords"),
        F.when(asked("with_original_language") & ~F.coalesce(F.array_contains(text("with_original_language"), F.col("original_language")), F.lit(False)), "other language"),
        F.when(asked("without_original_language") & F.coalesce(F.array_contains(text("without_original_language"), F.col("original_language")), F.lit(False)), "excluded language"),
    )
    j = j.select("catalog_id", "item_id", F.array_compact(found).alias("found"))
    rate = j.groupBy("catalog_id").agg((F.count(F.when(F.size("found") == 0, 1)) / F.count("*")).alias("success"))
    return j.select("catalog_id", F.explode("found").alias("message")).groupBy("catalog_id", "message").agg(F.count("*").alias("n")).join(rate, "catalog_id")


def preset_lint(presets: DataFrame) -> DataFrame:
    """(id, finding) of presets (id, name, type, queries): what is odd about the first query."""
    q = F.get("queries", F.lit(0))
    get = lambda k: F.nullif(F.try_element_at(q, F.lit(k)), F.lit(""))
    has = lambda k: get(k).isNotNull()
    holds = lambda k, x: F.coalesce(get(k).contains(x), F.lit(False))
    number = lambda k: F.coalesce(get(k).try_cast("double"), F.lit(0.0))
    genres = F.split(F.coalesce(get("with_genres"), F.lit("")), "[|,]")
    any_of = lambda values: F.arrays_overlap(genres, F.array(*map(F.lit, values)))
    series, name, sort = F.col("type") == "series", F.lower("name"), get("sort_by")
    narrow = sum((c.cast("int") for c in (has("with_genres"), has("with_keywords"), has("with_companies") | has("with_cast") | has("with_crew"), number("vote_average.gte") >= 8, number("vote_count.gte") > 1000, has("with_original_language"))), F.lit(0))
    findings = F.array(
        F.when(~series & any_of(SERIES_ONLY), "series genre").when(series & any_of(FILM_ONLY), "film genre"),
        F.when(series & ~F.col("id").contains("anime") & ~holds("with_keywords", ANIME) & (F.coalesce(get("with_genres"), F.lit("")) != "16") & ~holds("without_keywords", ANIME), "anime not excluded"),
        F.when(narrow >= 4, "too narrow"), F.when((sort == "vote_average.desc") & (number("vote_count.gte") < 50), "few votes"),
        F.when((sort == "popularity.desc") & (number("vote_count.gte") < 5) & ~F.col("id").rlike("new|recent"), "no votes"),
        F.when(name.rlike("best|top|cult") & (sort != "vote_average.desc"), "not by vote"), F.when(name.rlike("popular|trend") & (sort != "popularity.desc"), "not by popularity"), F.when(sort.isNull(), "no order"),
    )
    return presets.select("id", F.explode(F.array_compact(findings)).alias("finding"))


def similar_presets(presets: DataFrame) -> DataFrame:
    """Groups of presets of one type that ask for the same genres, keywords and people under several names; one row a group, not a pair."""
    q = F.get("queries", F.lit(0))
    get = lambda k: F.coalesce(F.try_element_at(q, F.lit(k)), F.lit(""))
    keys = {"genres": "with_genres", "keywords": "with_keywords", "cast_list": "with_cast", "crew": "with_crew", "companies": "with_companies"}
    g = presets.select("id", "name", "type", *(get(k).alias(c) for c, k in keys.items())).groupBy("type", *keys).agg(F.countDistinct("name").alias("names"), F.count("*").alias("n"), F.collect_list("id").alias("ids"))
    return g.filter("names > 1")


def preset_categories(presets: DataFrame) -> DataFrame:
    """(category, pos): the categories in order of their first preset; they are few."""
    c = presets.groupBy("category").agg(F.min("pos").alias("first"))
    return c.select("category", F.row_number().over(Window.orderBy("first")).alias("pos"))


def affinity_report(rows: DataFrame, scored: DataFrame) -> DataFrame:
    """Catalog rows (owner, catalog_id, item_id, pos) beside the light and the full score (owner, item_id, light, full)."""
    return rows.join(scored.select("owner", "item_id", "light", "full"), ["owner", "item_id"])
