"""Discovery filters: a declarative block compiled to predicates and an order, evaluated in one scan."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.operators.scoring import KIDS_GENRES, KIDS_KEYWORDS

# Film genres as series genres, and the ladder of certificates.
TV_GENRES = {28: 10759, 12: 10759, 16: 16, 35: 35, 80: 80, 99: 99, 18: 18, 10751: 10751, 14: 10765, 36: 10768, 27: 9648, 10402: 18, 9648: 9648, 10749: 18, 878: 10765, 53: 80, 10752: 10768, 37: 37}
CERTIFICATES = {"G": 1, "PG": 2, "PG-13": 3, "R": 3, "NC-17": 4}
HORROR = "315058"
PROVIDERS = {"netflix": 8, "amazon": 119, "prime": 119, "disney": 337, "apple": 350}
SORTS = {"popularity": "popularity", "vote_average": "vote_average", "vote_count": "vote_count", "release_date": "release_date", "first_air_date": "release_date", "primary_release_date": "release_date", "revenue": "revenue"}
LABELS = {"popularity": "popularity.desc", "vote": "vote_average.desc", "date": "release_date.desc", "revenue": "revenue.desc"}


@dataclass(frozen=True)
class Discovery:
    """Lists are "a|b" (any) or "a,b" (all); exclusions drop an item with any of theirs."""

    media_type: str | None = None
    with_genres: str | None = None
    without_genres: str | None = None
    with_keywords: str | None = None
    without_keywords: str | None = None
    with_cast: str | None = None
    with_crew: str | None = None
    with_origin_country: str | None = None
    original_language: str | None = None
    without_language: str | None = None
    vote_count_gte: float | None = None
    vote_count_lte: float | None = None
    vote_average_gte: float | None = None
    vote_average_lte: float | None = None
    popularity_lte: float | None = None
    year_from: int | None = None
    year_to: int | None = None
    with_people: str | None = None
    with_companies: str | None = None
    with_networks: str | None = None
    runtime_gte: int | None = None
    runtime_lte: int | None = None
    certification_lte: str | None = None
    watch_provider: str | None = None
    watch_region: str = "IT"
    text_search: str | None = None
    sort_by: str = "popularity.desc"

    def for_series(self) -> Discovery:
        """The horror rule: genre 27 of series comes with the horror keyword, too."""
        has = self.media_type == "tv" and "27" in _parts(self.with_genres or "")
        return replace(self, with_keywords=",".join(filter(None, [self.with_keywords, HORROR]))) if has else self

    def without_topic(self) -> Discovery | None:
        """What a documentary block that found nothing tries next: the same without keywords."""
        return replace(self, with_keywords=None) if self.with_keywords and "99" in _parts(self.with_genres or "") else None

    def for_kids(self) -> Discovery:
        """Adds the blocked genres and keywords; bounds on the average would hide family titles and go."""
        add = lambda a, b: ",".join(filter(None, [a, *map(str, b)]))
        return replace(self, without_genres=add(self.without_genres, KIDS_GENRES), without_keywords=add(self.without_keywords, KIDS_KEYWORDS), vote_average_gte=None, vote_average_lte=None)

    def predicate(self) -> Column:
        tests = [F.lit(True)]
        if self.media_type:
            tests.append(F.col("media_type") == self.media_type)
        for text, column in ((self.with_genres, "genre_ids"), (self.with_keywords, "keyword_ids"), (self.with_cast, "cast_ids"), (self.with_crew, "director_ids"), (self.with_companies, "company_ids"), (self.with_networks, "network_ids")):
            if text:
                tests.append(holds(F.col(column), text))
        for text, column in ((self.without_genres, "genre_ids"), (self.without_keywords, "keyword_ids")):
            if text:
                tests.append(~F.arrays_overlap(F.col(column), _ids(text)))
        for text, column, wanted in ((self.with_origin_country, "origin_country", True), (self.original_language, "original_language", True), (self.without_language, "original_language", False)):
            if text:
                own = F.col(column).isin(_parts(text))
                tests.append(own if wanted else ~own)
        for bound, column, low in ((self.vote_count_gte, "vote_count", True), (self.vote_average_gte, "vote_average", True), (self.vote_count_lte, "vote_count", False), (self.vote_average_lte, "vote_average", False)):
            if bound is not None:
                tests.append(F.col(column) >= bound if low else F.col(column) <= bound)
        if self.popularity_lte is not None:
            tests.append(F.col("popularity").isNull() | (F.col("popularity") <= self.popularity_lte))
        if self.year_from is not None:
            tests.append(F.col("release_date") >= F.make_date(F.lit(self.year_from), F.lit(1), F.lit(1)))
        if self.year_to is not None:
            tests.append(F.col("release_date") <= F.make_date(F.lit(self.year_to), F.lit(12), F.lit(31)))
        if self.with_people:
            tests.append(holds(F.array_union("cast_ids", "director_ids"), self.with_people))
        if self.media_type != "tv":  # only films have a runtime
            tests += [F.col("runtime") >= self.runtime_gte] if self.runtime_gte is not None else []
            tests += [F.col("runtime") <= self.runtime_lte] if self.runtime_lte is not None else []
        if self.certification_lte:
            tests.append(certificate_rank(F.col("certificate")) <= CERTIFICATES[self.certification_lte])
        if self.watch_provider and (pid := PROVIDERS.get(self.watch_provider.lower())):
            tests.append(F.array_contains(offers(F.col("providers"), self.watch_region), pid))
        if self.text_search:
            tests.append(F.lower("name").contains(self.text_search.lower()))
        out = tests[0]
        for t in tests[1:]:
            out = out & F.coalesce(t, F.lit(False))
        return out

    def sort_key(self) -> Column:
        """A number of which larger comes first."""
        name, _, way = LABELS.get(self.sort_by, self.sort_by).partition(".")
        c = F.col(SORTS[name])
        c = F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double") if SORTS[name] == "release_date" else c.cast("double")
        return -c if way == "asc" else c


def series_horror(media_type: Column, genres: Column, keywords: Column) -> Column:
    """The horror rule for queries in rows: keywords of a series with genre 27, with the horror keyword."""
    has = F.array_contains(F.split(F.coalesce(genres, F.lit("")), "[,|]"), "27")
    return F.when((media_type == "tv") & has, F.concat_ws(",", keywords, F.lit(HORROR))).otherwise(keywords)


def certificate_rank(certificate: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in CERTIFICATES.items() for x in kv)), certificate)


def offers(providers: Column, region: str | Column) -> Column:
    """All providers of a region, whether by subscription, rent, sale or with adverts."""
    own = F.try_element_at(providers, F.lit(region) if isinstance(region, str) else region)
    none = F.expr("CAST(array() AS array<bigint>)")
    return F.concat(*(F.coalesce(own[k], none) for k in ("flatrate", "rent", "buy", "ads")))


def _parts(text: str) -> list[str]:
    return [x.strip() for x in text.replace("|", ",").split(",") if x.strip()]


def _ids(text: str) -> Column:
    return F.array(*(F.lit(int(x)) for x in _parts(text))).cast("array<bigint>")


def holds(column: Column, text: str) -> Column:
    """Any of the ids where the list has a pipe, else all of them."""
    return F.arrays_overlap(column, _ids(text)) if "|" in text else F.size(F.array_except(_ids(text), column)) == 0


def discover(items: DataFrame, blocks: list[tuple[dict, Discovery]]) -> DataFrame:
    """A row for each item and block that takes it, with the block's labels and `pos`.

    All predicates are evaluated in one scan, as an array of structs of which the hits are exploded.
    """
    hits = F.array(*(F.when(b.predicate(), F.struct(*(F.lit(v).alias(k) for k, v in labels.items()), b.sort_key().alias("sort"))) for labels, b in blocks))
    out = items.withColumn("hit", F.explode(F.filter(hits, lambda h: h.isNotNull()))).select("*", "hit.*").drop("hit")
    w = Window.partitionBy(*blocks[0][0]).orderBy(F.col("sort").desc_nulls_last(), "item_id")
    return out.withColumn("pos", F.row_number().over(w)).drop("sort")


def discover_relaxed(items: DataFrame, blocks: list[tuple[dict, Discovery]]) -> DataFrame:
    """As discover(); a documentary block without any row gets those it has without keywords, from the same scan."""
    twins = [({**k, "relaxed": 1}, b.without_topic()) for k, b in blocks if b.without_topic()]
    both = discover(items, [({**k, "relaxed": 0}, b) for k, b in blocks] + twins)
    keys = list(blocks[0][0])
    return both.filter("relaxed = 0").unionByName(both.filter("relaxed = 1").join(both.filter("relaxed = 0").select(*keys).distinct(), keys, "left_anti"))


ANY = "*"


def keyed_lists(items: DataFrame, n: int, order: str, *groups: str) -> DataFrame:
    """(groups, key, item_id, order): the first n items of each combination of a genre, a keyword and a country, or any (*)."""
    own = lambda c: F.concat(F.array(F.lit(ANY)), F.coalesce(c.cast("array<string>"), F.expr("CAST(array() AS array<string>)")))
    one = items.select(*groups, "item_id", order, F.explode(own(F.array_distinct("genre_ids"))).alias("_g"), "keyword_ids", "origin_country")
    one = one.select("*", F.explode(own(F.array_distinct("keyword_ids"))).alias("_k"))
    one = one.select("*", F.explode(own(F.array("origin_country"))).alias("_o")).withColumn("key", F.concat_ws("|", "_g", "_k", "_o"))
    w = Window.partitionBy(*groups, "key").orderBy(F.desc(order), "item_id")
    return one.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select(*groups, "key", "item_id", order)


def discover_for(items: DataFrame, wanted: DataFrame, n: int, order: str = "popularity", keys: tuple[str, ...] = ("owner",), groups: tuple[str, ...] = ()) -> DataFrame:
    """(keys, item_id, pos): each profile's first n items by `order` of any wanted genre, any wanted keyword and any wanted country.

    wanted: (keys, groups, genres, keywords, countries), where an empty list means all; groups: columns of both tables
    in which they must agree. The best n of a union are among the best n of its parts, so profiles meet lists of n items, never the items.
    A list is one row, written first: Spark knows their size and, where it is small, moves no profile's rows to them.
    """
    from tastegrid.sources.tables import written

    lists = keyed_lists(items, n, order, *groups).groupBy(*groups, "key").agg(F.collect_list(F.struct(order, "item_id")).alias("_list"))
    lists = written(lists, "lists")
    part = lambda c: F.when(F.size(c) > 0, F.array_distinct(F.col(c).cast("array<string>"))).otherwise(F.array(F.lit(ANY)))
    own = list(dict.fromkeys([*keys, *groups]))
    asked = wanted.select(*own, F.explode(part("genres")).alias("g"), part("keywords").alias("k"), part("countries").alias("o"))
    asked = asked.select(*own, "g", F.explode("k").alias("k"), "o").select(*own, "g", "k", F.explode("o").alias("o")).select(*own, F.concat_ws("|", "g", "k", "o").alias("key"))
    met = asked.join(lists, [*groups, "key"]).select(*keys, F.explode("_list").alias("_e")).select(*keys, "_e.item_id", f"_e.{order}")
    found = met.groupBy(*keys, "item_id").agg(F.max(order).alias(order))
    w = Window.partitionBy(*keys).orderBy(F.desc(order), "item_id")
    return found.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n).select(*keys, "item_id", "pos")


def map_genres(genre_ids: Column) -> Column:
    """Film genres as series genres, once each, in order; ids that already are series genres stay."""
    table = F.create_map(*(F.lit(x).cast("long") for kv in TV_GENRES.items() for x in kv))
    tv = F.array(*(F.lit(x).cast("long") for x in sorted(set(TV_GENRES.values()))))
    return F.array_distinct(F.transform(genre_ids, lambda g: F.when(F.array_contains(tv, g), g).otherwise(F.coalesce(F.try_element_at(table, g), g))))
