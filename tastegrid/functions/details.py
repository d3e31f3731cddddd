"""Nested detail documents as item and detail pages: columns over structs and arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The job names, the order of languages, and how much of each list is kept.
WRITERS = ("Writer", "Screenplay", "Author")
LANGUAGES = ("it", "en")
CAST, PEOPLE, WORDS, IMAGES, FULL_CAST, CREW = 5, 3, 5, 3, 10, 5
THEATRICAL = 3

PERSON = "struct<id:bigint,name:string,job:string,department:string>"
IMAGE = "struct<path:string,lang:string>"


def rank_images(images: Column, most: int | None = None) -> Column:
    """Italian, then English, then without language, then others, each in its order; repeats go."""
    rank = lambda lang: F.when(lang == LANGUAGES[0], 0).when(lang == LANGUAGES[1], 1).when(lang.isNull() | (lang == ""), 2).otherwise(3)
    placed = F.transform(images, lambda x, i: F.struct(rank(x["lang"]).alias("rank"), i.alias("place"), x.alias("image")))
    out = F.array_distinct(F.transform(F.array_sort(placed), lambda s: s["image"]))
    return out if most is None else F.slice(out, 1, most)


def best_poster(images: Column, poster: Column) -> Column:
    """The path of the first ranked image, else the item's own."""
    return F.coalesce(F.get(rank_images(images), F.lit(0))["path"], poster)


def release_info(first: Column, last: Column, status: Column, media_type: Column) -> Column:
    """The year, or "start-end" of an ended series of several years."""
    a, b = F.coalesce(F.substring(first.cast("string"), 1, 4), F.lit("")), F.substring(last.cast("string"), 1, 4)
    return F.when((media_type == "tv") & (status == "Ended") & (b != a), F.concat_ws("-", a, b)).otherwise(a)


def in_theaters(releases: Column, media_type: Column, country: str = "IT") -> Column:
    """Whether a film has a theatrical release there; releases: array of (country, type)."""
    return F.coalesce((media_type == "movie") & F.exists(releases, lambda r: (r["country"] == country) & (r["type"] == THEATRICAL)), F.lit(False))


def names(people: Column) -> Column:
    return F.transform(people, lambda p: p["name"])


def with_job(crew: Column, *jobs: str) -> Column:
    return F.filter(crew, lambda p: p["job"].isin(*jobs))


def trailers(videos: Column) -> Column:
    """Keys of the trailers on YouTube; videos: array of (site, type, key)."""
    return F.transform(F.filter(videos, lambda v: (v["site"] == "YouTube") & (v["type"] == "Trailer")), lambda v: v["key"])


def links(d: DataFrame) -> Column:
    """Rows (category, name): genres, directors or creators, cast, keywords, saga and networks."""
    film = F.col("media_type") == "movie"
    none = F.expr("CAST(array() AS array<struct<category:string,name:string>>)")
    rows = lambda category, values: F.coalesce(F.transform(values, lambda v: F.struct(F.lit(category).alias("category"), v.alias("name"))), none)
    return F.concat(
        rows("genre", F.transform("genres", lambda g: g["name"])),
        F.when(film, rows("director", F.slice(names(with_job(F.col("crew"), "Director")), 1, PEOPLE))).otherwise(rows("creator", F.slice(names(F.col("created_by")), 1, PEOPLE))),
        rows("cast", F.slice(names(F.col("cast")), 1, CAST)), rows("keyword", F.slice(F.transform("keywords", lambda k: k["name"]), 1, WORDS)),
        F.when(F.col("collection").isNotNull(), rows("saga", F.array("collection"))).otherwise(none), F.when(film, none).otherwise(rows("network", F.col("networks"))),
    )


def full_meta(d: DataFrame) -> DataFrame:
    """The item page: name, year or years, rating, poster, people, trailers and links."""
    film = F.col("media_type") == "movie"
    return d.select(
        F.coalesce("imdb_id", F.concat(F.lit("tmdb:"), F.col("item_id").cast("string"))).alias("id"), "item_id", "media_type", F.coalesce(F.nullif("title", F.lit("")), F.lit("Unknown")).alias("name"),
        release_info(F.col("first_date"), F.col("last_date"), F.col("status"), F.col("media_type")).alias("release_info"), in_theaters(F.col("releases"), F.col("media_type")).alias("in_theaters"),
        F.when(F.col("vote_average") != 0, F.format_number("vote_average", 1)).alias("rating"), best_poster(F.col("posters"), F.col("poster_path")).alias("poster"),
        F.slice(names(F.filter("cast", lambda p: p["department"] == "Acting")), 1, CAST).alias("cast"),
        F.when(film, F.slice(names(with_job(F.col("crew"), "Director")), 1, PEOPLE)).otherwise(F.slice(names(F.col("created_by")), 1, PEOPLE)).alias("makers"),
        trailers(F.col("videos")).alias("trailers"), links(d).alias("links"),
    )


def detail_meta(d: DataFrame) -> DataFrame:
    """The detail page: trimmed lists, people by job, runtime as text, keyword names in lower case, and whether it is anime."""
    film = F.col("media_type") == "movie"
    words = F.transform("keywords", lambda k: F.lower(k["name"]))
    anime = F.exists("genres", lambda g: g["id"] == 16) & F.exists(words, lambda w: w.contains("anime"))
    return d.select(
        "item_id", F.slice(names(F.col("cast")), 1, FULL_CAST).alias("cast"), F.slice(names(with_job(F.col("crew"), "Director", *WRITERS)), 1, CREW).alias("crew"),
        F.when(film, names(with_job(F.col("crew"), "Director"))).otherwise(names(F.col("created_by"))).alias("director"), F.when(film, names(with_job(F.col("crew"), *WRITERS))).alias("writer"),
        F.when(film & (F.col("runtime") > 0), F.concat(F.col("runtime").cast("string"), F.lit("m"))).when(~film & (F.col("episode_runtime") > 0), F.concat(F.col("episode_runtime").cast("string"), F.lit("m"))).alias("runtime"),
        words.alias("keywords"), F.coalesce(anime, F.lit(False)).alias("anime"), rank_images(F.col("posters"), IMAGES).alias("posters"), F.slice(trailers(F.col("videos")), 1, IMAGES).alias("trailers"),
    )


def episode_badge(forced_season: Column, forced: Column, next_season: Column, next_: Column, last_season: Column, last: Column, status: Column, aired_season: Column, aired: Column, absolute: Column) -> Column:
    """The forced episode, else the next one, else the last of a series that goes on, else the latest aired."""
    short = lambda e: F.concat(F.lit("Ep "), e.cast("string"))
    long = lambda s, e: F.concat(F.lit("S"), F.coalesce(F.nullif(s, F.lit(0)), F.lit(1)).cast("string"), F.lit(" E"), e.cast("string"))
    some = lambda e: F.coalesce(e, F.lit(0)) != 0
    ended = F.coalesce(status.isin("Ended", "Canceled"), F.lit(False))
    first = absolute | (F.coalesce(F.nullif(forced_season, F.lit(0)), F.lit(1)) <= 1)
    return (
        F.when(some(forced), F.when(first, short(forced)).otherwise(long(forced_season, forced)))
        .when(some(next_), long(next_season, next_))
        .when(some(last) & ~ended, long(last_season, last))
        .when(aired.isNotNull(), F.when(absolute | ((F.coalesce(aired_season, F.lit(0)) != 0) & (aired_season <= 1)), short(F.coalesce(F.nullif(aired, F.lit(0)), F.lit(1)))).otherwise(long(aired_season, F.coalesce(F.nullif(aired, F.lit(0)), F.lit(1)))))
    )
