"""Episodes: alignment across providers, numbering, latest aired, and audio gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.functions.ids import series_base_id


def normalize_episodes(e: DataFrame, key: str = "series_id") -> DataFrame:
    """Season 1 by default; missing numbers get the running count of missing ones, in order of `ord`."""
    w = Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.col("episode").isNull().cast("int")).over(w).cast("int")
    e = e.withColumns({"season": F.coalesce("season", F.lit(1)), "episode": F.coalesce("episode", running)})
    return e.withColumn("id", F.concat_ws(":", key, "season", "episode"))


def latest_aired(e: DataFrame, as_of: Column, *keys: str) -> DataFrame:
    """The newest episode of each key, without future ones and placeholders (generic title, no overview)."""
    generic = F.coalesce(F.col("title"), F.lit("")).rlike(r"(?i)^(episod(e|io)\s+\d+)?$")
    real = ~(F.coalesce("overview", F.lit("")).eqNullSafe(F.lit("")) & generic)
    aired = F.col("released").isNull() | (F.col("released") <= as_of)
    w = Window.partitionBy(*keys).orderBy(F.col("released").desc_nulls_last(), F.desc("episode"), F.desc("season"))
    return e.filter(real & aired).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def latest_air_date(shows: DataFrame, e: DataFrame, as_of: Column) -> DataFrame:
    """shows (series_id, next_date, last_date): the next date if aired, else the last if aired, else the episodes' newest."""
    newest = e.filter(F.col("released") <= as_of).groupBy("series_id").agg(F.max("released").alias("newest"))
    past = lambda c: F.when(F.col(c) <= as_of, F.col(c))
    return shows.join(newest, "series_id", "left").select("series_id", F.coalesce(past("next_date"), past("last_date"), "newest").alias("air_date"))


def infer_season(starts: DataFrame, seasons: DataFrame, fallback: Column, days: int = 365) -> DataFrame:
    """starts (series_id, start): the season of the nearest date within `days`, specials apart, else the fallback."""
    s = seasons.filter((F.col("season_number") != 0) & F.col("air_date").isNotNull())
    gap = F.abs(F.datediff("start", "air_date"))
    j = starts.join(s, "series_id").groupBy("series_id", "start").agg(F.min(F.struct(gap.alias("gap"), "season_number")).alias("m"))
    j = starts.join(j, ["series_id", "start"], "left")
    return j.select("series_id", "start", F.when(F.col("m.gap") <= days, F.col("m.season_number")).otherwise(fallback).alias("season"))


def episode_offset(starts: DataFrame, right: DataFrame) -> DataFrame:
    """starts (series_id, season, start) with the offset of a part that begins inside a season, and whether it is safe to align.

    The offset is the number before the episode aired on the start date; a season after the first that the other
    side lacks is unsafe.
    """
    first = right.groupBy("series_id", "season", F.col("released").alias("start")).agg(F.min("episode").alias("_e"))
    known = right.select("series_id", "season", F.lit(True).alias("_s")).distinct()
    j = starts.join(first, ["series_id", "season", "start"], "left").join(known, ["series_id", "season"], "left")
    return j.select("series_id", "season", F.greatest(F.coalesce("_e", F.lit(1)) - 1, F.lit(0)).alias("offset"), (F.col("_s").isNotNull() | (F.col("season") <= 1)).alias("safe"))


def align_episodes(left: DataFrame, right: DataFrame) -> DataFrame:
    """left (series_id, season, ep, released, offset) to right (series_id, season, episode, released, absolute).

    The first of: the same air date in the season; season and number plus offset; the absolute number; the
    number in season 1. Each step joins a right side of one row a key; a right episode may be used twice.
    """
    one = lambda keys, name: right.groupBy(*keys).agg(F.min(F.struct("season", "episode")).alias(name))
    a = one(["series_id", "season", "released"], "by_date")
    b = one(["series_id", "season", "episode"], "by_number").withColumnRenamed("episode", "want")
    c = one(["series_id", "absolute"], "by_absolute").withColumnRenamed("absolute", "want")
    e = right.filter("season = 1").groupBy("series_id", "episode").agg(F.min(F.struct("season", "episode")).alias("by_first")).withColumnRenamed("episode", "ep")
    j = left.withColumn("want", F.col("ep") + F.col("offset")).join(a, ["series_id", "season", "released"], "left").join(b, ["series_id", "season", "want"], "left").join(c, ["series_id", "want"], "left").join(e, ["series_id", "ep"], "left")
    how = F.when(F.col("by_date").isNotNull(), "date").when(F.col("by_number").isNotNull(), "number").when(F.col("by_absolute").isNotNull(), "absolute").when(F.col("by_first").isNotNull(), "first")
    best = F.coalesce("by_date", "by_number", "by_absolute", "by_first")
    return j.select("series_id", "season", "ep", how.alias("how"), best["season"].alias("to_season"), best["episode"].alias("to_episode"))


def of_season(extra: DataFrame, targets: DataFrame) -> DataFrame:
    """Leftovers (series_id, season, ...) that may be appended: of a season after the first only its own, else all."""
    return extra.join(targets.select("series_id", F.col("season").alias("_t")), "series_id").filter((F.col("_t") <= 1) | (F.col("season") == F.col("_t"))).drop("_t")


def append_unmatched(matched: DataFrame, extra: DataFrame) -> DataFrame:
    """extra (series_id, ord) without a match, numbered on from the largest number matched."""
    top = matched.groupBy("series_id").agg(F.max("episode").alias("top"))
    left = extra.join(matched.select("series_id", "episode"), ["series_id", "episode"], "left_anti").join(top, "series_id", "left")
    w = Window.partitionBy("series_id").orderBy("episode")
    return left.select("series_id", F.col("episode").alias("was"), (F.coalesce("top", F.lit(0)) + F.row_number().over(w)).alias("episode"))


def audio_gap(e: DataFrame, *keys: str) -> DataFrame:
    """The last episode with audio and the first without after it, where there are both."""
    last = e.filter("has_lang").groupBy(*keys).agg(F.max("episode").alias("last_tagged"))
    return e.join(last, list(keys)).filter("NOT has_lang AND episode > last_tagged").groupBy(*keys, "last_tagged").agg(F.min("episode").alias("next_untagged"))


def audio_offset(gap: DataFrame) -> DataFrame:
    """The original at its next episode, and a dubbed twin at the last with audio."""
    rows = F.array(F.struct(F.lit("original").alias("form"), F.col("next_untagged").alias("show")), F.struct(F.lit("dubbed").alias("form"), F.col("last_tagged").alias("show")))
    return gap.withColumn("x", F.explode(rows)).select(*(c for c in gap.columns), "x.form", "x.show")


def next_probe(gap: DataFrame) -> DataFrame:
    """The midpoint to probe next: one step of bisection a batch, where the gap is over one."""
    return gap.filter("next_untagged - last_tagged > 1").withColumn("probe", F.floor((F.col("last_tagged") + F.col("next_untagged")) / 2).cast("int"))


def probe_targets(e: DataFrame, flags: DataFrame, *keys: str) -> DataFrame:
    """First and latest episodes that have no audio flag yet."""
    ends = e.groupBy(*keys).agg(F.min("episode").alias("lo"), F.max("episode").alias("hi"))
    want = ends.select(*keys, F.explode(F.array_distinct(F.array("lo", "hi"))).alias("episode"))
    return want.join(flags.select(*keys, "episode"), [*keys, "episode"], "left_anti")


def localized_overview(e: DataFrame, english: DataFrame, original: DataFrame) -> DataFrame:
    """Missing overviews from the English rows, then the original ones, by episode number."""
    text = lambda df, name: df.select("series_id", "season", "episode", F.col("overview").alias(name))
    k = ["series_id", "season", "episode"]
    j = e.join(text(english, "en"), k, "left").join(text(original, "orig"), k, "left")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return j.select(*k, F.coalesce(blank("overview"), blank("en"), blank("orig")).alias("overview"))


def choose_source(alt: DataFrame, main: DataFrame) -> DataFrame:
    """The alternative provider's episodes where a series has any, else the main one's."""
    a = alt.withColumn("source", F.lit("alt"))
    return a.unionByName(main.join(alt.select("series_id").distinct(), "series_id", "left_anti").withColumn("source", F.lit("main")))


def join_badges(items: DataFrame, flags: DataFrame) -> DataFrame:
    """items (id, ...) with the audio flags of their episodes by base id: whether any has the language, its last such episode and the next without.

    flags: (stream_id, has_lang), whose last part is the episode.
    """
    own = flags.select(series_base_id(F.col("stream_id")).alias("_b"), F.coalesce(F.element_at(F.split("stream_id", ":"), -1).try_cast("int"), F.lit(0)).alias("e"), "has_lang")
    tagged = own.filter("has_lang").groupBy("_b").agg(F.max("e").alias("last_tagged"))
    after = own.filter("NOT has_lang").join(tagged, "_b").filter("e > last_tagged").groupBy("_b").agg(F.min("e").alias("next_untagged"))
    j = items.withColumn("_b", series_base_id(F.col("id"))).join(tagged, "_b", "left").join(after, "_b", "left").drop("_b")
    return j.withColumn("badge", F.col("last_tagged").isNotNull())
