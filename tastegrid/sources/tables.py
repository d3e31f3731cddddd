"""Readers, normalisers and writers of the landed tables."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastegrid.functions.ids import or_default


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder named in spark.checkpoint.dir, or a temporary one where that is unset and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("a cluster needs spark.checkpoint.dir, a folder that all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="tastegrid-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once a session, for clusters on which it isn't installed."""
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", root.parent, root.name))
        _SHIPPED.add(sc.applicationId)


def file_bytes(spark: SparkSession, *paths: str) -> int:
    size, conf = 0, spark._jsparkSession.sessionState().newHadoopConf()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        size += path.getFileSystem(conf).getContentSummary(path).getLength()
    return size


def tasks_for(spark: SparkSession, *paths: str, mb: float = 2.0) -> int:
    """How many tasks the rows of stored tables are dealt to: one for so many MB of their files, at least one a core."""
    return max(spark.sparkContext.defaultParallelism, int(file_bytes(spark, *paths) / (mb * (1 << 20))) + 1)


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df, computed once, in the shared folder; what goes on from it survives lost executors. discard() deletes it."""
    path = shared_dir(df.sparkSession, name)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() when all that reads them is written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read_items(pages: DataFrame) -> DataFrame:
    """Listing pages (page, pos, item_id, ...) as one list, the first row of an item."""
    w = Window.partitionBy("item_id").orderBy("page", "pos")
    return pages.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def features_from_details(details: DataFrame) -> DataFrame:
    """Nested details to flat features: directors, the first five of the cast, keywords of either nesting; no null or zero ids."""
    ids = lambda c: F.filter(F.transform(c, lambda x: x["id"]), lambda i: i.isNotNull() & (i != 0))
    none = F.expr("CAST(array() AS array<bigint>)")
    words = F.coalesce(F.col("keywords.keywords"), F.col("keywords.results"))
    return details.select(
        F.col("id").alias("item_id"), "media_type", F.coalesce(ids(F.col("genres")), none).alias("genre_ids"), F.coalesce(ids(words), none).alias("keyword_ids"),
        F.coalesce(ids(F.filter("credits.crew", lambda x: x["job"] == "Director")), none).alias("director_ids"), F.coalesce(F.slice(ids(F.col("credits.cast")), 1, 5), none).alias("cast_ids"),
        F.coalesce("vote_average", F.lit(0.0)).alias("vote_average"), F.coalesce("vote_count", F.lit(0)).cast("long").alias("vote_count"),
    )


def upsert_features(old: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace by item and media type."""
    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    w = Window.partitionBy("item_id", "media_type").orderBy(F.desc("_v"))
    return both.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k", "_v")


def refresh_votes(old: DataFrame, new: DataFrame) -> DataFrame:
    """New votes for known items only; the rating text stands in for a missing average."""
    n = new.select("item_id", F.coalesce("vote_average", F.col("rating").try_cast("double")).alias("_a"), F.col("vote_count").alias("_c"))
    j = old.join(n, "item_id", "left")
    return j.withColumns({"vote_average": F.coalesce("_a", "vote_average"), "vote_count": F.coalesce("_c", "vote_count")}).drop("_a", "_c")


def read_history_feed(history: DataFrame, ratings: DataFrame, as_of: Column) -> DataFrame:
    """Two feeds of (movie_id, show_id, watched_at): the film's id, else the show's; rows without either go."""
    both = history.unionByName(ratings, allowMissingColumns=True)
    return both.select("owner", F.coalesce("movie_id", "show_id").alias("item_id"), F.when(F.col("movie_id").isNotNull(), "movie").otherwise("tv").alias("media_type"), F.coalesce("watched_at", as_of).alias("watched_at")).filter("item_id IS NOT NULL")


def read_library_feed(loved: DataFrame | None = None, liked: DataFrame | None = None, library: DataFrame | None = None, bare: DataFrame | None = None) -> DataFrame:
    """Lists of (owner, id, type) with their source, a bare list's being manual; ids that are numbers, series as tv, all else as movie."""
    all_ = None
    for source, rows in (("loved", loved), ("liked", liked), ("library", library), ("manual", bare)):
        if rows is not None:
            rows = rows.withColumn("source", F.lit(source))
            all_ = rows if all_ is None else all_.unionByName(rows)
    return all_.filter(F.col("id").rlike("^[0-9]+$")).select("owner", F.col("id").cast("long").alias("item_id"), F.when(F.col("type") == "series", "tv").otherwise("movie").alias("media_type"), "source")


def resolve_config(accounts: DataFrame, configs: DataFrame) -> DataFrame:
    """Accounts and configurations by the configuration's id, each side kept; a profile's id is id, else _id."""
    j = accounts.join(configs, accounts["addon_uuid"] == configs["uuid"], "full")
    return j.select(F.coalesce("uuid", "addon_uuid").alias("uuid"), "user_id", F.coalesce(F.nullif("id", F.lit("")), "_id").alias("profile_id"))


def alt_catalog(df: DataFrame) -> DataFrame:
    """The second provider: the first localised title there is, the start's year, ratings of 100 as of 10."""
    return df.select("id", F.coalesce("title_it", "title_en", "title_en_jp", "canonical").alias("name"), F.year("start_date").alias("year"), F.format_number(F.col("rating") / 10, 1).alias("rating"), "subtype")


def unwrap_list_item(df: DataFrame) -> DataFrame:
    """Rows with the item in movie, in show or in themselves, as (owner, imdb, tmdb, title, description, rating)."""
    of = lambda c: F.coalesce(F.col(f"movie.{c}"), F.col(f"show.{c}"), F.col(c))
    return df.select("owner", *(of(c).alias(c) for c in ("imdb", "tmdb", "title", "description", "rating")))


def normalize_list_item(df: DataFrame) -> DataFrame:
    """User lists: the IMDb id, else "tmdb:<id>"; rows with neither go; ratings to one decimal; titles and descriptions by default."""
    out = df.select("owner", F.coalesce("imdb", F.concat(F.lit("tmdb:"), F.col("tmdb").cast("string"))).alias("id"), or_default(F.col("title"), "Unknown").alias("name"), or_default(F.col("description"), "No description").alias("description"), F.round("rating", 1).alias("rating"))
    return out.filter("id IS NOT NULL")


def read_user_lists(lists: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """A page of each user's lists (owner, list_type, media_type, item_id, pos), films and series apart, with places on the page."""
    w = Window.partitionBy("owner", "list_type", "media_type").orderBy("pos", "item_id")
    place = F.row_number().over(w) - (page - 1) * size
    return lists.withColumn("_p", place).filter(F.col("_p").between(1, size)).drop("pos").withColumnRenamed("_p", "pos")


def write_catalogs(df: DataFrame, path: str) -> None:
    """Ranked ids (owner, profile_id, catalog_id, kids, item_id, pos), a folder for each catalog, with the kids' ones apart."""
    df.write.mode("overwrite").partitionBy("catalog_id", "kids").parquet(path)


def write_impressions(df: DataFrame, path: str, as_of: Column) -> None:
    """First pages only, each item once a day."""
    df.filter("pos <= 20").select("owner", "profile_id", "catalog_id", "item_id", as_of.alias("seen_date")).dropDuplicates().write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def export_snapshot(df: DataFrame, path: str, compact: bool = True) -> None:
    (df.select("item_id", "media_type", "name") if compact else df).write.mode("overwrite").json(path)
