"""Other item providers: their filters as predicates, their subtype catalogs, and the way back to items."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds, ages, genres and sort keys of the providers.
ALT_KINDS = {"movie": ("movie", "special"), "tv": ("TV", "ONA", "OVA")}
ALT_AGES = {"G": ("G",), "PG": ("G", "PG"), "PG-13": ("G", "PG", "R"), "R": ("G", "PG", "R"), "NC-17": ("G", "PG", "R", "R18")}
ALT_SORTS = {"popularity": ("popularity_rank", True), "vote_average": ("rating", False), "release_date": ("start_date", False), "first_air_date": ("start_date", False)}
THIRD_GENRES = ("action", "adventure", "comedy", "drama", "ecchi", "fantasy", "horror", "mahou shoujo", "mecha", "music", "mystery", "psychological", "romance", "sci-fi", "slice of life", "sports", "supernatural", "thriller")
THIRD_KINDS = {"movie": ("MOVIE", "SPECIAL"), "tv": ("TV", "TV_SHORT", "OVA", "ONA")}
THIRD_FILMS = ("MOVIE", "SPECIAL", "OVA")
THIRD_SORTS = {"popularity": "popularity", "vote_average": "score", "release_date": "start_number", "first_air_date": "start_number"}


@dataclass(frozen=True)
class AltFilter:
    """A block for the second provider: (start_date, rating of 100, subtype, status, title, categories, age, popularity_rank)."""

    media_type: str | None = None
    text_search: str | None = None
    keyword_names: str | None = None
    status: str | None = None
    date_gte: str | None = None
    date_lte: str | None = None
    vote_min: float | None = None
    vote_max: float | None = None
    certification_lte: str | None = None
    sort_by: str = "popularity.desc"

    def predicate(self, this_year: int) -> Column:
        year = F.year("start_date")
        dated = self.date_gte or self.date_lte
        out = year.between(int((self.date_gte or "1900")[:4]), int((self.date_lte or "2030")[:4])) if dated else year.between(1900, this_year)
        if self.media_type:
            out = out & F.col("subtype").isin(*ALT_KINDS[self.media_type])
        if self.text_search:
            out = out & F.lower("title").contains(self.text_search.lower())
        if self.keyword_names:
            slugs = ["-".join(x.split()).lower() for x in self.keyword_names.replace("|", ",").split(",") if x.strip()]
            out = out & (F.size(F.array_except(F.array(*map(F.lit, slugs)), "categories")) == 0)
        if self.status:
            out = out & (F.col("status") == self.status)
        low, high = round((self.vote_min or 0) * 10), round((10 if self.vote_max is None else self.vote_max) * 10)
        if low > 0 or high < 100:
            out = out & F.col("rating").between(low, high)
        if self.certification_lte:
            out = out & F.col("age").isin(*ALT_AGES[self.certification_lte])
        return F.coalesce(out, F.lit(False))

    def order(self) -> list[Column]:
        name, _, way = self.sort_by.partition(".")
        column, up = ALT_SORTS[name]
        c = F.col(column)
        return [c.asc_nulls_last() if up == (way != "asc") else c.desc_nulls_last(), F.col("alt_id").asc()]


@dataclass(frozen=True)
class ThirdFilter:
    """A block for the third provider: (format, start_number as yyyymmdd, score of 100, titles, genres, tags, popularity)."""

    media_type: str | None = None
    text_search: str | None = None
    keyword_names: str | None = None
    date_gte: str | None = None
    date_lte: str | None = None
    vote_min: float | None = None
    vote_max: float | None = None
    sort_by: str = "popularity.desc"

    def predicate(self, this_year: int) -> Column:
        out = F.lit(True)
        if self.media_type:
            out = out & F.col("format").isin(*THIRD_KINDS[self.media_type])
        if self.text_search:
            out = out & F.lower("title").contains(self.text_search.lower())
        words = [x.strip() for x in (self.keyword_names or "").replace("|", ",").split(",") if x.strip()]
        for column, own in (("genres", [w for w in words if w.lower() in THIRD_GENRES]), ("tags", [w for w in words if w.lower() not in THIRD_GENRES])):
            if own:
                out = out & F.arrays_overlap(F.col(column), F.array(*map(F.lit, own)))
        number = lambda d: int(d.replace("-", ""))
        if self.date_gte:
            out = out & (F.col("start_number") > number(self.date_gte))
        if self.date_lte:
            out = out & (F.col("start_number") < number(self.date_lte))
        if not (self.date_gte or self.date_lte or self.text_search):
            out = out & (F.col("start_number") < (this_year + 1) * 10000)
        if self.vote_min is not None:
            out = out & (F.col("score") > round(self.vote_min * 10))
        if self.vote_max is not None:
            out = out & (F.col("score") < round(self.vote_max * 10))
        return F.coalesce(out, F.lit(False))

    def order(self) -> list[Column]:
        name, _, way = self.sort_by.partition(".")
        c = F.col(THIRD_SORTS[name])
        return [c.asc_nulls_last() if way == "asc" else c.desc_nulls_last(), F.col("third_id").asc()]


def listed(items: DataFrame, blocks: list[tuple[str, AltFilter | ThirdFilter]], this_year: int, size: int) -> DataFrame:
    """(catalog_id, pos, ...) of each block's first `size` items, in one scan of the items."""
    hits = F.array(*(F.when(b.predicate(this_year), F.lit(name)) for name, b in blocks))
    rows = items.withColumn("catalog_id", F.explode(F.filter(hits, lambda h: h.isNotNull())))
    pos = F.lit(None).cast("int")
    for name, b in blocks:
        pos = F.when(F.col("catalog_id") == name, F.row_number().over(Window.partitionBy("catalog_id").orderBy(*b.order()))).otherwise(pos)
    return rows.withColumn("pos", pos).filter(F.col("pos") <= size)


def alt_catalogs(items: DataFrame, blocks: list[tuple[str, AltFilter]], episodes: DataFrame, this_year: int, size: int = 20) -> DataFrame:
    """Each block's first items (at most a page) with their episodes (alt_id, ...) counted on."""
    n = episodes.groupBy("alt_id").agg(F.count("*").alias("episodes"))
    return listed(items, blocks, this_year, size).join(n, "alt_id", "left").withColumn("episodes", F.coalesce("episodes", F.lit(0)))


def subtype_catalogs(alt: DataFrame, third: DataFrame, size: int = 20) -> DataFrame:
    """(catalog_id, item, pos): OVA, ONA and special of the second provider; trending, releasing, films and a list a genre of the third."""
    a = alt.select(F.concat(F.lit("alt-"), F.lower("subtype")).alias("catalog_id"), F.col("alt_id").alias("item"), F.col("popularity_rank").alias("rank")).filter(F.col("catalog_id").isin("alt-ova", "alt-ona", "alt-special"))
    popular = -F.col("popularity")
    kinds = F.array(F.lit("third-popular"), F.when(F.col("next_episode").isNotNull(), "third-simulcast"), F.when(F.col("format") == "MOVIE", "third-movies"), F.when(F.col("format") == "OVA", "third-ova"), F.when(F.col("format") == "ONA", "third-ona"), F.when(F.col("format") == "SPECIAL", "third-specials"))
    kinds = F.concat(F.filter(kinds, lambda k: k.isNotNull()), F.transform("genres", lambda g: F.concat(F.lit("third-genre-"), g)))
    t = third.select(F.explode(kinds).alias("catalog_id"), F.col("third_id").alias("item"), popular.alias("rank"))
    trend = third.select(F.lit("third-trending").alias("catalog_id"), F.col("third_id").alias("item"), (-F.col("trending")).alias("rank"))
    w = Window.partitionBy("catalog_id").orderBy("rank", "item")
    return a.unionByName(t).unionByName(trend).withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= size).select("catalog_id", "item", "pos")


def read_third_catalog(df: DataFrame) -> DataFrame:
    """The third provider's rows as items: the first title there is, films by format, the next episode before the description, scores of 100 as of 10."""
    airing = F.concat(F.lit("[Airing Ep "), F.col("next_episode").cast("string"), F.lit("]\n\n"), F.coalesce("description", F.lit("")))
    title = F.coalesce(*(F.nullif(c, F.lit("")) for c in ("romaji", "english", "native")), F.lit("Unknown"))
    return df.select("third_id", "mal_id", F.when(F.col("format").isin(*THIRD_FILMS), "movie").otherwise("series").alias("type"), title.alias("name"), F.when(F.col("next_episode").isNotNull(), airing).otherwise(F.coalesce("description", F.lit(""))).alias("description"), F.when(F.col("score") != 0, F.format_number(F.col("score") / 10, 1)).alias("rating"))


def resolve_alt_to_item(alt: DataFrame, direct: DataFrame, tvdb: DataFrame, bridge: DataFrame, parents: DataFrame, items: DataFrame) -> DataFrame:
    """alt (alt_id, titles, media_type) to (alt_id, item_id, how): the direct mapping, else by way of TVDB, else a relation's mapping, else the most popular item of a cleaned title.

    direct: (alt_id, item_id, priority); tvdb: (alt_id, tvdb_id, priority); bridge: (tvdb_id, item_id, media_type), a series before a film;
    parents: (alt_id, parent_id) in order of nearness `hops`; items: (item_id, search, media_type, popularity). Each stage runs on what is still open.
    """
    first = lambda df, key, *order: df.groupBy(key).agg(F.min(F.struct(*order, "item_id")).alias("_b")).select(key, F.col("_b.item_id").alias("item_id"))
    own = first(direct, "alt_id", "priority")
    two = tvdb.join(first(bridge, "tvdb_id", (F.col("media_type") != "tv").alias("_r")), "tvdb_id")
    two = first(two, "alt_id", "priority")
    mapped = own.unionByName(two.join(own.select("alt_id"), "alt_id", "left_anti"))
    open_ = alt.join(mapped.select("alt_id"), "alt_id", "left_anti")
    up = open_.select("alt_id").join(parents, "alt_id").join(mapped.withColumnRenamed("alt_id", "parent_id"), "parent_id")
    up = first(up, "alt_id", "hops")
    rest = open_.join(up.select("alt_id"), "alt_id", "left_anti").select("alt_id", "media_type", F.posexplode("titles").alias("place", "search")).filter("search <> ''")
    best = items.groupBy("search", "media_type").agg(F.max_by("item_id", F.struct("popularity", -F.col("item_id"))).alias("item_id"))
    by_title = first(rest.join(best, ["search", "media_type"]), "alt_id", "place")
    parts = [(own, "direct"), (two.join(own.select("alt_id"), "alt_id", "left_anti"), "tvdb"), (up, "relation"), (by_title, "title")]
    out = None
    for df, how in parts:
        df = df.join(alt.select("alt_id"), "alt_id", "left_semi").select("alt_id", "item_id", F.lit(how).alias("how"))
        out = df if out is None else out.unionByName(df)
    return out


def simulcast(third: DataFrame, xref: DataFrame, dates: DataFrame, size: int = 100) -> DataFrame:
    """(alt_id, air_date, pos): the third provider's releasing items by their counterpart, newest episode first, undated last.

    third: (mal_id, popularity) of what is on air; xref: (mal_id, alt_id), items without one go; dates: (alt_id, air_date).
    """
    one = xref.groupBy("mal_id").agg(F.min("alt_id").alias("alt_id"))
    j = third.join(one, "mal_id").groupBy("alt_id").agg(F.max("popularity").alias("popularity")).join(dates, "alt_id", "left")
    order = [F.col("air_date").desc_nulls_last(), F.desc("popularity"), F.col("alt_id")]
    top = j.orderBy(*order).limit(size)
    return top.select("alt_id", "air_date", F.row_number().over(Window.orderBy(*order)).alias("pos"))
