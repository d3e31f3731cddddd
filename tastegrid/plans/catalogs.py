"""Catalog jobs: each is one pipeline over all profiles; nothing is collected and users are never crossed with items.

Full scores come as a function that joins what they need, and are taken after the cheap cuts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.functions.details import episode_badge
from tastegrid.functions.titles import clean_title
from tastegrid.operators import ranking as R
from tastegrid.operators import scoring as S
from tastegrid.operators.discovery import Discovery, discover
from tastegrid.operators.episodes import join_badges
from tastegrid.operators.matching import match, search_texts
from tastegrid.operators.requests import TARGETS
from tastegrid.operators.xref import resolve_names

SIZE = 100


def preset_catalog(discovered: DataFrame, pages: int = 3, size: int = 20, keys: tuple[str, ...] = ("catalog_id",)) -> DataFrame:
    """Per catalog: the first pages of each query in order, each item once, at most 100."""
    rows = discovered.filter(F.col("pos") <= pages * size)
    once = R.first_seen(rows, "item_id", ["query_idx", "pos"], *keys)
    return R.paginate(once, ["query_idx", "pos"], *keys, size=SIZE).select(*keys, "item_id", F.col("place").alias("pos"))


def multi_query_catalog(discovered: DataFrame, queries: int = 10, presentation: str = "interleave", keys: tuple[str, ...] = ("catalog_id",)) -> DataFrame:
    """A page of a catalog's first queries: round robin, or by consensus and popularity."""
    if presentation not in ("interleave", "popularity"):
        raise ValueError(f"no presentation {presentation}")
    if presentation == "popularity":
        rows = discovered.filter((F.col("query_idx") < queries) & (F.col("pos") <= 60)).select(*keys, F.col("query_idx").alias("list_idx"), "pos", "item_id", "popularity")
        c = R.consensus(rows, *keys).join(rows.groupBy(*keys, "item_id").agg(F.max("popularity").alias("popularity")), [*keys, "item_id"])
        return R.paginate(c, [F.desc("bonus"), F.desc("popularity"), "item_id"], *keys).select(*keys, "item_id", F.col("place").alias("pos"))
    lists = discovered.filter((F.col("query_idx") < queries) & (F.col("pos") <= 60)).select(*keys, F.col("query_idx").alias("list_idx"), "pos", "item_id")
    return R.interleave(lists, *keys, limit=20).select(*keys, "item_id", F.col("place").alias("pos"))


def matched(rows: DataFrame, score: Callable[[DataFrame], DataFrame], days: DataFrame) -> DataFrame:
    """rows (owner, item_id, ...) with the full score and the impression penalty."""
    return R.with_days(score(rows), days, "owner").withColumn("penalty", S.impression_penalty(F.col("days"))).drop("days")


def seed_network(neighbours: DataFrame, top: DataFrame, dna: DataFrame, score: Callable[[DataFrame], DataFrame], days: DataFrame, most: int | None = None) -> DataFrame:
    """Neighbours (owner, item_id, weight, genre_ids, keyword_ids, ...) of weighted seeds by hybrid score and DNA; the best by its sum with the match, less impressions.

    dna: (owner, genres, keywords, filters); score adds `full`, to all of them, or to the first `most` by hybrid score. Features that
    neighbours bring along stay with them, so that the match joins none.
    """
    p = neighbours.join(top, "owner", "left").join(dna, "owner", "left")
    hybrid = S.hybrid_score(F.lit(None).cast("int"), F.col("weight"), F.col("top"), F.col("genre_ids")).cast("double") * dna_factor()
    p = p.select("owner", *(c for c in neighbours.columns if c not in ("owner", "weight", "place")), hybrid.alias("hybrid"))
    if most is not None:
        p = R.ranked(p.select("owner", "item_id", "hybrid"), "hybrid", "owner", out="k").filter(F.col("k") <= most).drop("k")
    kept = matched(p, score, days)
    return R.top_catalog(kept.withColumn("score", (F.col("hybrid") + F.col("full")) * F.col("penalty")), SIZE, "owner").select("owner", "item_id", "score", "pos")


def dna_factor() -> Column:
    """The DNA multiplier of a row with genres, keywords and filters; profiles without DNA have nulls."""
    none = F.expr("CAST(array() AS array<bigint>)")
    return S.dna_multiplier(F.coalesce("genres", none), F.coalesce("keywords", none), F.coalesce("filters", F.lit(0)))


def true_blend(pool: DataFrame, days: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Two tiers, then the genre saturation penalty; pool: (owner, item_id, light, genre_ids)."""
    t = R.two_tier(pool, days, "owner", full=score)
    s = S.genre_saturation(t.withColumnRenamed("pos", "rank").select("owner", "item_id", "rank", "genre_ids", "score"), "owner")
    return R.top_catalog(s.withColumn("score", F.col("score") - F.col("penalty")), SIZE, "owner").select("owner", "item_id", "score", "pos")


# What makes a hidden gem.
GEMS = {"vote_count_gte": 100, "vote_count_lte": 3000, "vote_average_gte": 7.0, "popularity_lte": 80.0}
GEMS_RUNTIME = 60


def hidden_gems(pool: DataFrame, days: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Two tiers of discovered gems, the light score being the niche one."""
    return R.two_tier(pool, days, "owner", full=score).filter(F.col("pos") <= SIZE).select("owner", "item_id", "score", "pos")


def community_filtered(recommended: DataFrame, days: DataFrame, score: Callable[[DataFrame], DataFrame], most: int = 100) -> DataFrame:
    """A profile's first recommendations of others, by match less impressions."""
    own = matched(recommended.filter(F.col("pos") <= most).select("owner", "item_id"), score, days)
    return R.top_catalog(own.withColumn("score", F.col("full") * F.col("penalty")), SIZE, "owner").select("owner", "item_id", "score", "pos")


def popular_fallback(items: DataFrame, n: int = 60) -> DataFrame:
    return items.filter("vote_count >= 50").orderBy(F.desc("popularity"), "item_id").limit(n)


def gems_fallback(items: DataFrame, n: int = 60, least: float = 7.0) -> DataFrame:
    return items.filter((F.col("vote_count").between(50, 2000)) & (F.col("vote_average") >= least) & (F.coalesce("popularity", F.lit(float("inf"))) <= 80)).orderBy(F.desc("vote_average"), "item_id").limit(n)


def placed(df: DataFrame, *order) -> DataFrame:
    """Places over the few rows of a list that is already cut."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def with_fallback(personal: DataFrame, owners: DataFrame, fallback: DataFrame | None) -> DataFrame:
    """Profiles without a list of their own get the fallback, or nothing where there is none.

    The fallback is a list of some dozens of rows by its own limit; every profile that gets it gets all of it.
    """
    own = personal.select("owner", "item_id", "pos")
    if fallback is None:
        return own
    empty = owners.join(personal.select("owner").distinct(), "owner", "left_anti")
    lane = empty.withColumn("lane", F.lit(0)).join(F.broadcast(fallback.withColumn("lane", F.lit(0))), "lane")
    return own.unionByName(lane.select("owner", "item_id", "pos"))


def planned_lists(plan: DataFrame, prompts: DataFrame, items: DataFrame, similar: DataFrame, tastes: DataFrame, n: int = 20) -> DataFrame:
    """(owner, list_idx, pos, item_id): the first n items of each planned query that is for the first provider.

    plan: (owner, pos, strategy, target, text_search, genre_ids, similar_to); prompts: (owner, prompt), the search of those
    whose plan has no such query; tastes: (owner, genres, keywords), of which a discovery takes two and three more.
    """
    own = plan.filter(F.col("target").isNull() | (F.col("target") == TARGETS[0])).select("owner", F.col("pos").alias("list_idx"), "strategy", F.lower("text_search").alias("text"), "genre_ids", "similar_to")
    rest = prompts.join(own.select("owner").distinct(), "owner", "left_anti").select("owner", F.lit(0).alias("list_idx"), F.lit("multi_search").alias("strategy"), F.lower("prompt").alias("text"), F.lit(None).cast("array<bigint>").alias("genre_ids"), F.lit(None).cast("string").alias("similar_to"))
    own = own.unionByName(rest)
    text = own.filter("strategy = 'multi_search'").select("owner", "list_idx", "text")
    lists = text.join(search_texts(items, text, n), "text").select("owner", "list_idx", "pos", "item_id")
    like = own.filter("strategy = 'similar' AND similar_to IS NOT NULL").select("owner", "list_idx", F.col("similar_to").alias("asked"))
    known = resolve_names(like.select("asked").distinct(), items.select(F.col("item_id").alias("id"), F.col("name").alias("label"))).filter("id IS NOT NULL")
    edges = similar.filter(F.col("position") <= n).select(F.col("src_id").alias("id"), F.col("position").alias("pos"), F.col("dst_id").alias("item_id"))
    lists = lists.unionByName(like.join(known, "asked").join(edges, "id").select("owner", "list_idx", "pos", "item_id"))
    none = F.expr("CAST(array() AS array<bigint>)")
    more = lambda c, k: F.slice(F.coalesce(c, none), 1, k)
    ids = lambda a: F.nullif(F.concat(F.array_join(a.cast("array<string>"), "|"), F.lit("|")), F.lit("|"))  # noqa: E731  with a pipe: any of them
    found = own.filter("strategy = 'discovery'").join(tastes, "owner", "left").select("owner", "list_idx", ids(F.array_union(F.coalesce("genre_ids", none), more("genres", 2))).alias("with_genres"), ids(more("keywords", 3)).alias("with_keywords"))
    return lists.unionByName(match(items, found, n).select("owner", "list_idx", "pos", "item_id"))


def named_lists(plan: DataFrame, items: DataFrame) -> DataFrame:
    """(owner, item_id, pos): the items of plans that are lists of titles, in their order; unknown titles go."""
    asked = plan.filter("strategy = 'static_list'").select("owner", F.posexplode("static_items").alias("at", "asked"))
    known = resolve_names(asked.select("asked").distinct(), items.select(F.col("item_id").alias("id"), F.col("name").alias("label"))).filter("id IS NOT NULL")
    w = Window.partitionBy("owner").orderBy("at")
    return asked.join(known, "asked").select("owner", F.col("id").alias("item_id"), F.row_number().over(w).alias("pos"))


def combined_search(lists: DataFrame, named: DataFrame, items: DataFrame, score: Callable[[DataFrame], DataFrame], n: int = 20) -> DataFrame:
    """(owner, item_id, score, pos): the lists of a search's queries by vote, consensus and match, then popularity and consensus.

    Those without a profile have no match, and go by the rest. Owners of a list of titles (named) get that list, without scores.
    """
    c = R.consensus(lists.join(named.select("owner").distinct(), "owner", "left_anti"), "owner").select("owner", "item_id", "n", "bonus")
    own = score(c).select("owner", "item_id", "full")
    s = c.join(own, ["owner", "item_id"], "left").join(items.select("item_id", F.col("vote_average").alias("_v"), F.col("popularity").alias("_p")), "item_id")
    s = s.withColumn("score", F.col("_v") + F.col("bonus") + F.coalesce("full", F.lit(0.0)))
    w = Window.partitionBy("owner").orderBy(F.desc(F.round("score", 9)), F.desc("_p"), F.desc("n"), "item_id")
    s = s.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= n).select("owner", "item_id", "score", "pos")
    return s.unionByName(named.select("owner", "item_id", F.lit(None).cast("double").alias("score"), "pos"))


def user_lists(items: DataFrame, watched: DataFrame, size: int = 20) -> DataFrame:
    """List items (owner, list_type, item_id, id, pos) of a user, each id once over all lists in order, without watched ones."""
    once = R.first_seen(items, "id", ["list_type", "pos"], "owner").join(watched, ["owner", "item_id"], "left_anti")
    return R.paginate(once, ["list_type", "pos"], "owner", size=size).select("owner", "list_type", "id", F.col("place").alias("pos"))


def global_discover(items: DataFrame, settings: DataFrame, blocks: list[tuple[str, Discovery]], size: int = 20) -> DataFrame:
    """settings (owner, setting) to each profile's first items by its floors and order; a list is made once a setting, not a profile."""
    lists = discover(items, [({"setting": name}, b) for name, b in blocks]).filter(F.col("pos") <= size).select("setting", "item_id", "pos")
    return settings.join(lists, "setting").select("owner", "item_id", "pos")


def post_process(catalogs: DataFrame, lists: DataFrame, kids: DataFrame, watched: DataFrame, alt: DataFrame, dates: DataFrame, flags: DataFrame, latest: DataFrame, by_date: Column, size: int = 20, tasks: int | None = None) -> DataFrame:
    """Lists (catalog_id, wanted, media_type, item_id, name, genre_ids, keyword_ids, pos) as the page that is shown to each owner of catalogs (owner, catalog_id).

    Rows of another media type go, those unfit where the profile is for kids (kids: owner), and watched ones; items get
    their alternative id (alt: item_id, alt_id) where there is one; where by_date holds, the newest episode comes first
    (dates: item_id, air_date); an id is shown once; titles lose their season; series show their latest episode
    (latest: item_id, season, episode), and one that is dubbed up to an earlier episode comes twice (flags: stream_id, has_lang).
    What concerns items alone is joined to the lists, of which there is one a catalog, cut by its own limit (at most some hundred
    rows); they meet their owners last, who are dealt to so many tasks and stay there, with watched ones as one list an owner.
    """
    tasks = tasks or lists.sparkSession.sparkContext.defaultParallelism
    r = lists.filter(F.col("media_type").isNull() | (F.col("media_type") == F.col("wanted")) | (F.col("media_type") == "person"))
    known = join_badges(r.select("item_id").distinct().select("item_id", F.concat(F.lit("tmdb:"), F.col("item_id").cast("string")).alias("id")), flags).drop("id")
    r = r.join(alt.select("item_id", "alt_id"), "item_id", "left").join(dates.select("item_id", "air_date"), "item_id", "left").join(latest, "item_id", "left").join(known, "item_id", "left")
    named = F.when(F.col("alt_id").isNotNull(), F.concat(F.lit("kitsu:"), F.col("alt_id").cast("string"))).otherwise(F.concat(F.lit("tmdb:"), F.col("item_id").cast("string")))
    order = [F.when(by_date, F.col("air_date")).desc_nulls_last(), "pos"]
    r = r.withColumns({"id": named, "_unfit": S.unfit_for_kids()})
    own = catalogs.repartition(tasks, "owner").join(kids.withColumn("_kids", F.lit(True)), "owner", "left").join(F.broadcast(r), "catalog_id")
    own = R.without_seen(own.filter(F.col("_kids").isNull() | ~F.col("_unfit")).drop("_kids", "_unfit", "genre_ids", "keyword_ids"), watched)
    once = R.first_seen(own, "id", order, "owner", "catalog_id")
    page = R.paginate(once, order, "owner", "catalog_id", size=size)
    none = F.lit(None).cast("int")
    own = episode_badge(none, none, none, none, none, none, F.lit(None).cast("string"), F.col("season"), F.col("episode"), F.col("alt_id").isNotNull())
    offset = (F.col("wanted") == "tv") & F.col("next_untagged").isNotNull()
    row = lambda id_, form, badge, tagged: F.struct(id_.alias("id"), F.lit(form).alias("form"), badge.alias("badge"), tagged.alias("audio"))
    text = F.when(F.col("wanted") == "tv", own)
    dubbed = F.concat(F.lit("Ep "), F.col("last_tagged").cast("string"))
    forms = F.when(offset, F.array(row(F.col("id"), "original", text, F.lit(False)), row(F.concat("id", F.lit("_ita_offset")), "dubbed", dubbed, F.lit(True)))).otherwise(F.array(row(F.col("id"), "single", text, F.col("badge"))))
    return page.withColumn("x", F.explode(forms)).select("owner", "catalog_id", F.col("place").alias("pos"), "x.id", "x.form", clean_title(F.col("name")).alias("title"), "x.badge", "x.audio")


def materialise(presets: DataFrame, heroes: dict[str, DataFrame], n: int = SIZE) -> DataFrame:
    """(owner, catalog_id, item_id, pos) of all profiles' catalogs: the presets' (with those columns) and the personal ones."""
    out = presets.select("owner", "catalog_id", "item_id", "pos")
    for name, rows in heroes.items():
        out = out.unionByName(rows.select("owner", F.lit(name).alias("catalog_id"), "item_id", "pos"))
    return out.filter(F.col("pos") <= n)


def sync_profiles(catalogs: DataFrame, pages: DataFrame, items: DataFrame, size: int = 20) -> DataFrame:
    """(owner, item_id, media_type, source, episodes_watched): the first page of each of a profile's catalogs as liked items, counted once a catalog.

    catalogs: (owner, catalog_id), pages: (catalog_id, item_id, pos).
    """
    first = pages.filter(F.col("pos") <= size).join(items.select("item_id", "media_type"), "item_id")
    rows = catalogs.join(first.select("catalog_id", "item_id", "media_type"), "catalog_id").withColumn("source", F.lit("liked"))
    return rows.groupBy("owner", "item_id", "media_type", "source").agg(F.count("*").alias("episodes_watched"))
