"""Configurations: profiles hold catalogs, catalogs hold queries; merging, upserts and unification.

A catalog is a struct (id, name, type, source, strategy, filters MAP, queries ARRAY<MAP>, sources ARRAY,
source_filters ARRAY<MAP>); lists keep their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY = "map<string,string>"
CATALOG = f"struct<id:string,name:string,type:string,source:string,strategy:string,filters:{QUERY},queries:array<{QUERY}>,sources:array<string>,source_filters:array<{QUERY}>>"


def explode_catalogs(configs: DataFrame) -> DataFrame:
    """configs (uuid, profiles ARRAY<STRUCT<id, catalogs>>) to a row for each query, with the places; empty levels keep a row."""
    p = configs.select("uuid", F.posexplode_outer("profiles").alias("profile_pos", "p"))
    c = p.select("uuid", "profile_pos", F.col("p.id").alias("profile_id"), F.posexplode_outer("p.catalogs").alias("catalog_pos", "c"))
    return c.select("uuid", "profile_pos", "profile_id", "catalog_pos", F.col("c.id").alias("catalog_id"), F.col("c.type").alias("type"), F.posexplode_outer("c.queries").alias("query_pos", "query"))


def resolve_config(accounts: DataFrame, configs: DataFrame, handles: DataFrame) -> DataFrame:
    """handles (handle) to (handle, uuid, user_id, profile_id): a configuration of that id first, else that of the user's account.

    A profile's id is id, else _id.
    """
    own = configs.select(F.col("uuid").alias("handle"), F.col("uuid").alias("own"))
    by_user = accounts.select(F.col("user_id").alias("handle"), F.col("addon_uuid").alias("other"))
    j = handles.join(own.distinct(), "handle", "left").join(by_user, "handle", "left").select("handle", F.coalesce("own", "other").alias("uuid"))
    profiles = configs.select("uuid", F.coalesce(F.nullif("id", F.lit("")), "_id").alias("profile_id"))
    users = accounts.select(F.col("addon_uuid").alias("uuid"), "user_id")
    return j.join(profiles, "uuid", "left").join(users, "uuid", "left").select("handle", "uuid", "user_id", "profile_id")


def last_of(items: Column, key) -> Column:
    """Each key once, with its last item, at the place of its first; items without a key go."""
    some = F.filter(items, lambda x: F.coalesce(key(x), F.lit("")) != "")
    first = F.array_distinct(F.transform(some, key))
    return F.transform(first, lambda k: F.element_at(F.filter(some, lambda x: key(x) == k), -1))


def upsert_catalogs(profiles: DataFrame, presets: DataFrame, prefix: str = "preset_") -> tuple[DataFrame, DataFrame]:
    """profiles (owner, catalogs, selected ARRAY) with the selected presets' catalogs put over those of their id, and (owner, preset) unknown.

    presets: (preset, catalog STRUCT). Existing ones keep their place, new ones follow in order of selection.
    """
    asked = profiles.select("owner", F.posexplode("selected").alias("pos", "preset")).join(presets, "preset", "left")
    unknown = asked.filter("catalog IS NULL").select("owner", "preset").distinct()
    named = F.col("catalog").withField("id", F.concat(F.lit(prefix), "preset"))
    new = asked.filter("catalog IS NOT NULL").groupBy("owner").agg(F.map_from_entries(F.collect_list(F.struct("pos", named.alias("c")))).alias("m"))
    new = new.select("owner", F.transform(F.array_sort(F.map_keys("m")), lambda k: F.element_at("m", k)).alias("new"))
    all_ = F.concat("catalogs", F.coalesce("new", F.slice("catalogs", 1, 0)))
    return profiles.join(new, "owner", "left").withColumn("catalogs", last_of(all_, lambda c: c["id"])).drop("new"), unknown


def merge_profiles(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming profiles over the stored ones of the same (uuid, profile_id); only incoming profiles stay.

    Both have settings MAP, manual_dna ARRAY, suggested_dna ARRAY, catalogs ARRAY, selected ARRAY, catalog_order ARRAY
    and dna MAP. Settings are laid over each other, DNA lists and catalogs that are absent stay as stored,
    lists of presets and places lose repeats, catalogs keep the last of each id, and scores are the server's.
    """
    keys = ["uuid", "profile_id"]
    own = ["settings", "manual_dna", "suggested_dna", "catalogs", "selected", "catalog_order", "dna"]
    j = incoming.join(stored.select(*keys, *(F.col(c).alias(f"_{c}") for c in own), F.lit(1).alias("_known")), keys, "left")
    over = F.map_concat(F.map_filter("_settings", lambda k, _: ~F.array_contains(F.map_keys("settings"), k)), "settings")
    known = F.col("_known").isNotNull()
    merged = {
        "settings": F.when(known & F.col("_settings").isNotNull() & F.col("settings").isNotNull(), over).when(known, F.coalesce("settings", "_settings")).otherwise(F.col("settings")),
        "manual_dna": F.when(known, F.coalesce("manual_dna", "_manual_dna")).otherwise(F.col("manual_dna")),
        "suggested_dna": F.when(known, F.coalesce("suggested_dna", "_suggested_dna")).otherwise(F.col("suggested_dna")),
        "catalogs": F.when(known, last_of(F.coalesce("catalogs", "_catalogs"), lambda c: c["id"])).otherwise(F.col("catalogs")),
        "selected": F.when(known, F.array_distinct(F.coalesce("selected", "_selected"))).otherwise(F.col("selected")),
        "catalog_order": F.when(known, F.array_distinct(F.coalesce("catalog_order", "_catalog_order"))).otherwise(F.col("catalog_order")),
        "dna": F.when(known, F.coalesce("_dna", "dna")).otherwise(F.col("dna")),
    }
    return j.select(*keys, *(c.alias(k) for k, c in merged.items()))


def unify_catalog(catalogs: DataFrame) -> DataFrame:
    """Any form of a catalog (columns of CATALOG) as (..., queries, presentation, is_merge): its queries, or its filters as one of them.

    A merged one has no queries yet (resolve_merge_sources); one without anything has a single empty query.
    """
    empty = F.expr(f"CAST(map() AS {QUERY})")
    has = F.coalesce(F.size("queries"), F.lit(0)) > 0
    filters = F.coalesce(F.size(F.map_keys("filters")), F.lit(0)) > 0
    merge = ~has & ((filters & (F.col("source") == "merged")) | (F.coalesce(F.size("sources"), F.lit(0)) > 0))
    one = F.array(F.when(filters, with_default(F.col("filters"), "strategy", "discovery")).otherwise(empty))
    queries = F.when(has, F.col("queries")).when(merge, F.expr(f"CAST(NULL AS array<{QUERY}>)")).otherwise(one)
    presentation = F.when(merge & (F.col("strategy") == "mixed"), "interleave").when(merge, "popularity").otherwise(F.coalesce("strategy", F.lit("popularity")))
    return catalogs.withColumns({"presentation": presentation, "is_merge": F.coalesce(merge, F.lit(False)), "queries": queries})


def with_default(filters: Column, key: str, value: str) -> Column:
    """filters with a key that they may set themselves."""
    return F.map_concat(F.map_filter(F.create_map(F.lit(key), F.lit(value)), lambda k, _: ~F.array_contains(F.map_keys(filters), k)), filters)


def resolve_merge_sources(merged: DataFrame, catalogs: DataFrame, presets: DataFrame) -> DataFrame:
    """merged (owner, catalog_id, sources, source_filters) with `queries`: of each source in order its queries or filters.

    A source is the profile's own catalog of that id, else the preset, else the inline filters of its place;
    catalogs: (owner, id, filters, queries), presets: (id, filters, queries). Without any there is one empty query.
    """
    one = lambda f: F.when(F.coalesce(F.size(F.map_keys(f)), F.lit(0)) > 0, F.array(with_default(f, "strategy", "discovery")))
    of = lambda p: F.when(F.coalesce(F.size(f"{p}_queries"), F.lit(0)) > 0, F.col(f"{p}_queries")).otherwise(one(F.col(f"{p}_filters")))
    s = merged.select("owner", "catalog_id", F.posexplode("sources").alias("pos", "id"), F.col("source_filters"))
    s = s.join(catalogs.select("owner", "id", F.lit(1).alias("mine"), F.col("filters").alias("own_filters"), F.col("queries").alias("own_queries")), ["owner", "id"], "left")
    s = s.join(presets.select("id", F.col("filters").alias("pre_filters"), F.col("queries").alias("pre_queries")), "id", "left")
    inline = one(F.get("source_filters", F.col("pos")))
    s = s.withColumn("q", F.coalesce(F.when(F.col("mine").isNotNull(), of("own")).otherwise(of("pre")), inline))
    flat = s.groupBy("owner", "catalog_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("q").isNotNull(), F.struct("pos", F.to_json("q").alias("q"))))), lambda x: F.from_json(x["q"], f"array<{QUERY}>"))).alias("queries"))
    out = merged.select("owner", "catalog_id").join(flat, ["owner", "catalog_id"], "left")
    empty = F.array(F.expr(f"CAST(map() AS {QUERY})"))
    return out.select("owner", "catalog_id", F.when(F.coalesce(F.size("queries"), F.lit(0)) > 0, F.col("queries")).otherwise(empty).alias("queries"))


def confirm_dna(manual: DataFrame, suggested: DataFrame) -> DataFrame:
    """Manual DNA (owner, type, id), and the suggested rows it lacks; nothing stays suggested."""
    return manual.unionByName(suggested.join(manual.select("owner", "type", "id"), ["owner", "type", "id"], "left_anti"))


def merge_template(selected: Column, template: Column) -> Column:
    """The presets of a profile and of a template, once each, in order."""
    none = F.expr("CAST(array() AS array<string>)")
    return F.array_union(F.coalesce(selected, none), F.coalesce(template, none))
