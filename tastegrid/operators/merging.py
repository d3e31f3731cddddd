"""Merging of lists, filters and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.operators.vectors import list_keys


def suggest_dna(queries: DataFrame, manual: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(owner, prefix, id, n, pos): the ids that a profile's queries name most, without its manual ones."""
    limits = {"g": 8, "k": 8} if limits is None else limits
    none = F.expr("CAST(array() AS array<string>)")
    alt = F.when(F.col("provider") == "kitsu", F.array(F.lit("g:16"), F.lit("k:210024"))).otherwise(none) if "provider" in queries.columns else none
    lists = {"g": "with_genres", "k": "with_keywords", "n": "with_networks", "c": "with_companies", "a": "with_cast", "d": "with_crew", "o": "with_origin_country"}
    all_ = F.concat(*(list_keys(p, c) for p, c in lists.items() if c in queries.columns), alt)
    n = queries.select("owner", F.explode(all_).alias("feature")).groupBy("owner", "feature").agg(F.count("*").alias("n"))
    n = n.select("owner", F.substring_index("feature", ":", 1).alias("prefix"), F.substring_index("feature", ":", -1).alias("id"), "n")
    w = Window.partitionBy("owner", "prefix").orderBy(F.desc("n"), "id")
    most = F.lit(3)
    for prefix, k in limits.items():
        most = F.when(F.col("prefix") == prefix, k).otherwise(most)
    top = n.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= most)
    own = manual.select("owner", F.when(F.col("type") == "genre", "g").when(F.col("type") == "keyword", "k").otherwise("o").alias("prefix"), "id")
    return top.join(own, ["owner", "prefix", "id"], "left_anti")


# The filters a definition may hold.
FILTER_KEYS = (
    "provider _keywordNames strategy presentation_strategy similar_to text_search sort_by with_genres with_keywords with_cast with_crew with_companies with_original_language vote_average.gte vote_average.lte vote_count.gte "
    "primary_release_date.gte primary_release_date.lte first_air_date.gte first_air_date.lte air_date.gte air_date.lte without_genres without_keywords with_runtime.gte with_runtime.lte certification.lte queries items"
).split()


def fingerprint(filters: Column, secret: tuple[str, ...] = ("api_key",)) -> Column:
    """SHA-256 of the filters as JSON in order of key, without empty values and secrets."""
    kept = F.map_filter(filters, lambda k, v: v.isNotNull() & (v != "") & ~k.isin(*secret))
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))), 256)


def clamp_filters(filters: Column) -> Column:
    """Known filters only; averages within 0 to 10, counts whole and not negative."""
    known = F.map_filter(filters, lambda k, _: k.isin(*FILTER_KEYS))

    def own(k: Column, v: Column) -> Column:
        n = v.try_cast("double")
        average = F.greatest(F.lit(0.0), F.least(F.lit(10.0), n)).cast("string")
        return F.when(k.startswith("vote_average"), average).when(k.startswith("vote_count"), F.greatest(F.lit(0), F.floor(n)).cast("string")).otherwise(v)

    return F.transform_values(known, own)


def parts(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,|]"), lambda x: F.trim(x)), lambda x: x != "")


def smart_merge(a: Column, b: Column, mode: str = "or") -> Column:
    """Two filter maps as one: genres and keywords united, A's other fields first, then B's."""
    sep = "," if mode == "and" else "|"
    lists = {k: F.array_join(F.array_distinct(F.concat(parts(F.try_element_at(a, F.lit(k))), parts(F.try_element_at(b, F.lit(k))))), sep) for k in ("with_genres", "with_keywords")}
    some = lambda m, k: F.nullif(F.try_element_at(m, F.lit(k)), F.lit(""))
    fixed = F.map_filter(F.create_map(*(x for k, v in lists.items() for x in (F.lit(k), v)), F.lit("sort_by"), F.coalesce(some(a, "sort_by"), some(b, "sort_by"), F.lit("popularity.desc"))), lambda _, v: v != "")
    own = F.map_filter(a, lambda k, v: v.isNotNull() & (v != "") & ~k.isin("with_genres", "with_keywords", "sort_by"))
    rest = F.map_filter(b, lambda k, v: v.isNotNull() & ~k.isin("with_genres", "with_keywords", "sort_by") & ~F.array_contains(F.map_keys(own), k))
    return F.map_concat(fixed, own, rest)


def dna_filters(manual: Column, suggested: Column) -> Column:
    """manual, then suggested; the first of each type and id, without those that lack either."""
    whole = F.filter(F.concat(manual, suggested), lambda x: x["type"].isNotNull() & x["id"].isNotNull())
    key = lambda x: F.concat(x["type"], F.lit(":"), x["id"])
    return F.aggregate(whole, F.slice(whole, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: key(y) == key(x)), acc).otherwise(F.concat(acc, F.array(x))))


def ratings_export(loved: DataFrame, liked: DataFrame) -> DataFrame:
    """Loved items (owner, media_type, id) rate 10, liked ones 8 unless they are there already; IMDb ids only."""
    key = ["owner", "media_type", "id"]
    own = lambda df: df.select(*key).filter(F.col("id").startswith("tt"))
    return own(loved).withColumn("rating", F.lit(10)).unionByName(own(liked).distinct().join(own(loved), key, "left_anti").withColumn("rating", F.lit(8)))


def upsert_history(history: DataFrame, events: DataFrame, *keys: str) -> DataFrame:
    """History with new events: counts add up, the last time stays, and with it its type and source."""
    both = history.unionByName(events, allowMissingColumns=True)
    last = [F.max_by(c, F.struct("last_watched_at", c)).alias(c) for c in ("media_type", "source") if c in both.columns]
    return both.groupBy(*keys).agg(F.sum("episodes_watched").alias("episodes_watched"), F.max("last_watched_at").alias("last_watched_at"), *last)


def describe_taste(vector: DataFrame, manual: DataFrame, names: DataFrame, n: int = 5) -> DataFrame:
    """(owner, summary): a profile's manual genres and keywords, then its n top ones, by name."""
    from tastegrid.operators.ranking import lookup_names
    from tastegrid.operators.vectors import top_features

    m = manual.filter(F.col("type").isin("genre", "keyword")).select("owner", F.concat(F.substring("type", 1, 1), F.lit(":"), "id").alias("feature"))
    m = lookup_names(m, names).select("owner", F.when(F.col("feature").startswith("g:"), 1).otherwise(2).alias("k"), F.col("label").alias("at"), "label")
    t = None
    for k, prefix in ((3, "g"), (4, "k")):
        own = lookup_names(top_features(vector, prefix, n, "owner"), names).select("owner", F.lit(k).alias("k"), F.lpad(F.col("pos").cast("string"), 9, "0").alias("at"), "label")
        t = own if t is None else t.unionByName(own)
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda s: s["label"]), ", ")
    head = F.element_at(F.array(*map(F.lit, ("Manual genres: ", "Manual keywords: ", "Genres: ", "Keywords: "))), F.col("k"))
    p = m.unionByName(t).groupBy("owner", "k").agg(part.alias("s")).select("owner", F.struct("k", F.concat(head, "s").alias("s")).alias("p"))
    return p.groupBy("owner").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["s"]), ". ").alias("summary"))


def inject_preferences(query: Column, genres: Column, keywords: Column) -> Column:
    """A query map with a profile's two top genres and three top keywords added to its own, each once."""
    one = lambda k, more, n: F.nullif(F.array_join(F.array_union(parts(F.try_element_at(query, F.lit(k))), F.coalesce(F.slice(more.cast("array<string>"), 1, n), F.expr("CAST(array() AS array<string>)"))), "|"), F.lit(""))
    new = F.map_filter(F.create_map(F.lit("with_genres"), one("with_genres", genres, 2), F.lit("with_keywords"), one("with_keywords", keywords, 3)), lambda _, v: v.isNotNull())
    return F.map_concat(F.map_filter(query, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def dna_params(genres: Column, keywords: Column, countries: Column) -> Column:
    """A profile's DNA filters as a query map: the ids of each kind joined by a pipe."""
    m = F.create_map(F.lit("with_genres"), F.array_join(genres.cast("array<string>"), "|"), F.lit("with_keywords"), F.array_join(keywords.cast("array<string>"), "|"), F.lit("with_origin_country"), F.array_join(countries, "|"))
    return F.map_filter(m, lambda _, v: F.coalesce(v, F.lit("")) != "")


def day_masks(shown: DataFrame, day: str, *keys: str) -> DataFrame:
    """(keys, word, mask): the distinct days of each key, 64 to a word, a bit each. Masks of the same key and word merge by OR."""
    n = F.unix_date(F.col(day))
    one = shown.filter(F.col(day).isNotNull()).select(*keys, F.floor(n / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, int(pmod(unix_date({day}), 64)))").alias("mask"))
    return merge_days(one, *keys)


def merge_days(masks: DataFrame, *keys: str) -> DataFrame:
    """Masks from several sources as one of each key and word."""
    return masks.groupBy(*keys, "word").agg(F.bit_or("mask").alias("mask"))


def count_days(masks: DataFrame, *keys: str) -> DataFrame:
    """(keys, days) of merged masks."""
    return masks.groupBy(*keys).agg(F.sum(F.bit_count("mask")).alias("days"))
