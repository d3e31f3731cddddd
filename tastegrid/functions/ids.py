"""Identifiers with name spaces, and text clean-up, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPED = ("tmdb", "kitsu", "anilist")


def content_id(c: Column, namespaced: bool = False) -> Column:
    """The text after the last colon; null and 0 become ''. namespaced keeps the whole id."""
    own = F.trim(c) if namespaced else F.trim(F.element_at(F.split(c, ":"), -1))
    return F.when(c.isNull() | (c == "0"), "").otherwise(own)


def base_id(c: Column) -> Column:
    """"ns:id" for ids of a known name space, else the head."""
    p = F.split(c, ":")
    return F.when(p[0].isin(*TYPED), F.concat_ws(":", p[0], F.try_element_at(p, F.lit(2)))).otherwise(p[0])


def series_base_id(c: Column) -> Column:
    """As base_id, but "tmdb:tv:n" and "tmdb:movie:n" keep three parts."""
    p = F.split(c, ":")
    kind = F.try_element_at(p, F.lit(2))
    return F.when((p[0] == "tmdb") & kind.isin("tv", "movie"), F.concat_ws(":", p[0], kind, F.try_element_at(p, F.lit(3)))).otherwise(base_id(c))


def rewrite_episode_id(c: Column, base: Column) -> Column:
    """The episode's id under another base; an absolute number becomes season 1."""
    p = F.split(c, ":")
    n = F.size(p)
    join = lambda start: F.concat_ws(":", base, F.array_join(F.slice(p, start, F.greatest(n - start + 1, F.lit(0))), ":"))
    tail = lambda start: F.when(n >= start, join(start)).otherwise(base)
    alt = F.when(n == 4, join(3)).when(n == 3, F.concat_ws(":", base, F.lit("1"), p[2]))
    return F.when(base.isNull(), None).when(c.startswith("tt"), tail(2)).when(c.startswith("tmdb:"), tail(3)).when(c.startswith("kitsu:"), alt)


def typed_id(c: Column, media_type: Column) -> Column:
    """The canonical typed id; bare numbers and "tmdb:n" get their kind, other ids pass."""
    s = F.regexp_replace(c, "_ita_offset", "")
    kind = F.when(media_type == "movie", "movie").otherwise("tv")
    number = F.regexp_extract(s, r"^(?:tmdb:)?(\d+)$", 1)
    return F.when(number != "", F.concat(F.lit("tmdb:"), kind, F.lit(":"), number)).otherwise(F.coalesce(s, F.lit("")))


def sanitize_text(c: Column) -> Column:
    """Without tags, then without the characters < > \" ' &."""
    return F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), "[<>\"'&]", "")


def vote_score(detail: Column, listed: Column, rating: Column) -> Column:
    """The first that is there: the detail's vote, the list's, the rating text; no number is 0."""
    return F.coalesce(detail.try_cast("double"), listed.try_cast("double"), rating.try_cast("double"), F.lit(0.0))


def or_default(c: Column, default: str) -> Column:
    """c, or default where it is null or ''."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def light_meta(items: DataFrame, details: DataFrame) -> DataFrame:
    """(item_id, title, release_info, rating): the listing's projection; a detail's title and vote come first where there is one."""
    own = details.select("item_id", F.col("title").alias("_t"), F.col("vote_average").alias("_v"))
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    return items.join(own, "item_id", "left").select("item_id", or_default(F.coalesce(some("_t"), some("title"), some("name")), "Unknown").alias("title"), F.substring(F.col("release_date").cast("string"), 1, 4).alias("release_info"), F.round(F.coalesce("_v", "vote_average"), 1).alias("rating"))


def is_anime(genres: Column, country: Column, language: Column, item_id: Column | None = None) -> Column:
    """Animation from Japan or in Japanese, unless the id already is of the other name space."""
    out = F.array_contains(genres, 16) & ((country == "JP") | (language == "ja"))
    return out if item_id is None else out & ~item_id.startswith("kitsu:")


def is_anime_by_keyword(genres: Column, words: Column) -> Column:
    """Animation with a keyword that holds the word."""
    return F.array_contains(genres, 16) & F.exists(words, lambda w: F.lower(w).contains("anime"))
