"""Domain tables as deterministic expressions over the supplied star schema.

Each table has a Spark form (a function of the same name) and, for the SQL comparison, the equal
common table expression in SQL. Item ids start at 1, as id 0 counts as no id.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastegrid.sources.tables import discard, file_bytes, tasks_for, written

# Genre ids given to the part types and sizes.
TYPE_GENRE = {"ECONOMY": 35, "SMALL": 16, "STANDARD": 18, "MEDIUM": 28, "LARGE": 12, "PROMO": 878}
SIZE_GENRES = [28, 12, 16, 35, 80, 99, 18, 10751, 14, 27]
LANGUAGES = ["en", "it", "ja", "ko", "fr"]
AS_OF = "2024-01-31"

# Catalog definitions (catalog, type, query, genres, without genres, keywords, cast, crew, country, votes, average, popularity cap, first and last year, sort).
DEFINITION_COLUMNS = ["catalog_id", "media_type", "query_idx", "with_genres", "without_genres", "with_keywords", "with_cast", "with_crew", "with_origin_country", "vote_count_gte", "vote_average_gte", "popularity_lte", "year_from", "year_to", "sort_by"]
DEFINITIONS = [
    ("action", "movie", 0, "28", None, None, None, None, None, 50, None, None, None, None, "popularity.desc"),
    ("action", "movie", 1, "28|12", "27", None, None, None, None, 10, 4.0, None, None, None, "vote_average.desc"),
    ("adventure", "movie", 0, "12", "16", None, None, None, None, None, 5.0, None, None, None, "popularity.desc"),
    ("anime", "tv", 0, "16", None, None, None, None, "JP", None, None, None, None, None, "popularity.desc"),
    ("anime", "tv", 1, "16|14", None, "1004|1008|1012", None, None, None, None, None, None, None, None, "vote_average.desc"),
    ("comedy", "movie", 0, "35", "27,53,80", None, None, None, None, 20, 3.0, None, None, None, "vote_count.desc"),
    ("drama_pair", "movie", 0, "18,35", None, None, None, None, None, None, None, None, None, None, "popularity.desc"),
    ("family", "tv", 0, "10751|16|35", "27", None, None, None, None, None, None, None, None, None, "vote_average.desc"),
    ("gems", "movie", 0, None, "27", None, None, None, None, 30, 5.0, 80.0, None, None, "vote_average.desc"),
    ("keyword_mix", "movie", 0, None, None, "1005|1010|1015|1021", None, None, None, None, None, None, None, None, "popularity.desc"),
    ("makers", "movie", 0, None, None, None, None, "7|11|13", None, None, None, None, None, None, "vote_average.desc"),
    ("recent", "movie", 0, None, None, None, None, None, None, None, None, None, 1999, 2002, "release_date.desc"),
    ("stars", "movie", 0, None, None, None, "3|5", None, None, None, 4.0, None, None, None, "popularity.desc"),
]


SHARE_MB = 128  # owners whose purchases are so much of lineitem are worked on at a time
OWNED = {"customer": "c_custkey", "orders": "o_custkey", "events": "user_id"}


class Share(str):
    """The folder of the tables, seen by one of n shares of the owners: their customers, orders, events and purchases; items are those of the whole."""

    number: int
    of: int
    bought: DataFrame

    def __new__(cls, folder: str, number: int, of: int, bought: DataFrame):
        self = super().__new__(cls, folder)
        self.number, self.of, self.bought = number, of, bought
        return self


_SHARED: dict[tuple[str, str, str, int], DataFrame] = {}


def shared(make: Callable[[SparkSession, str], DataFrame], by_owner: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    """make's table, kept for the session: many jobs read the items' features and the profiles' vectors.

    Only tables of a row for each item, edge or owner are shared, none of the size of the events or of the vectors. They grow
    with the items and may be many times their file, by whose size a join would send them through the driver: hence the hint.
    They are persisted; items' tables that owners' shares go on from are written instead, so that their shuffles needn't stay.
    A share of the owners has tables by owner of its own.
    """

    @functools.wraps(make)
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = by_owner and isinstance(sf_dir, Share)
        key = (spark.sparkContext.applicationId, make.__qualname__, str(sf_dir), sf_dir.number if own else -1)
        if key not in _SHARED:
            rows = make(spark, sf_dir if own else str(sf_dir))
            _SHARED[key] = rows.persist() if by_owner or shares(spark, str(sf_dir)) == 1 else written(rows, make.__name__)
        return _SHARED[key].hint("merge")

    return of


shared_by_owner = functools.partial(shared, by_owner=True)


def _drop(keys: list) -> None:
    for table in map(_SHARED.pop, keys):
        discard(table) if hasattr(table, "_written_to") else table.unpersist()


def release(spark: SparkSession) -> None:
    """Drop the session's shared tables, as after the inputs have changed."""
    _drop([k for k in _SHARED if k[0] == spark.sparkContext.applicationId])


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return in_share(sf_dir, rows, OWNED[name]) if isinstance(sf_dir, Share) and name in OWNED else rows


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the purchases are dealt to, and all that comes from them: their share each stays the same when the tables grow."""
    n = tasks_for(spark, f"{sf_dir}/lineitem.parquet", mb=1.0)
    return max(spark.sparkContext.defaultParallelism, -(-n // sf_dir.of)) if isinstance(sf_dir, Share) else n


def shares(spark: SparkSession, sf_dir: str) -> int:
    """How many shares the owners are worked on in, one for so many MB of lineitem: what a share moves doesn't grow with the tables."""
    return max(1, -(-file_bytes(spark, f"{sf_dir}/lineitem.parquet") // (SHARE_MB << 20)))


def in_share(sf_dir: str, rows: DataFrame, owner: str = "owner") -> DataFrame:
    """rows of the owners of a share, or all where sf_dir is the whole; rows without owner have a share like others."""
    return rows.filter(share_number(owner, sf_dir.of) == sf_dir.number) if isinstance(sf_dir, Share) else rows


def share_number(owner: str, of: int) -> Column:
    return F.pmod(F.xxhash64(F.col(owner).cast("long")), F.lit(of)).cast("int")


def in_shares(make: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """make's rows of all owners, made and written for one share of the owners after another, so that only a share's shuffles are on disk at once.

    For jobs in which owners meet items, not each other. The purchases are dealt into the shares and written once. Where there is
    one share, it is make itself.
    """

    @functools.wraps(make)
    def of(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = 1 if isinstance(sf_dir, Share) else shares(spark, sf_dir)
        if n == 1:
            return make(spark, sf_dir)
        was = spark.conf.get(CLEANUP)
        spark.conf.set(CLEANUP, "true")  # a query that is written needs its shuffles no more
        try:
            dealt = purchases(spark, sf_dir).withColumn("share", share_number("owner", n))
            dealt = written(dealt.repartition(tasks(spark, sf_dir), "share", F.pmod(F.xxhash64("owner", F.lit(0)), F.lit(max(1, tasks(spark, sf_dir) // n)))), "bought", "share")
            out = None
            for k in range(n):
                own = Share(sf_dir, k, n, dealt.filter(F.col("share") == k).drop("share"))
                rows = written(make(spark, own), make.__name__)
                _drop([x for x in _SHARED if x[0] == spark.sparkContext.applicationId and x[2:] == (str(sf_dir), k)])
                spark._jvm.System.gc()  # shuffles of what was persisted go with it
                out = rows if out is None else out.unionByName(rows)
            discard(dealt)
            return out
        finally:
            spark.conf.set(CLEANUP, was)

    return of


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def part_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem").select("l_partkey", "l_discount", "l_quantity", "l_shipdate", "l_suppkey").repartition(tasks(spark, sf_dir), "l_partkey")
    return line.groupBy("l_partkey").agg(
        F.count("*").alias("c"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"),
        F.sum("l_quantity").alias("q"),
        F.min(F.to_date("l_shipdate")).alias("release_date"),
        F.slice(F.array_sort(F.collect_set((F.col("l_suppkey") + 1).cast("long"))), 1, 5).alias("cast_ids"),
    )


@shared
def item_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, media_type, name, language, country, genre/keyword/director/cast ids, votes, popularity, release date."""
    p = read(spark, sf_dir, "part").join(part_numbers(spark, sf_dir), F.col("p_partkey") == F.col("l_partkey"), "left")
    kind = F.create_map(*(F.lit(x) for kv in TYPE_GENRE.items() for x in kv))
    sizes = F.array(*(F.lit(x) for x in SIZE_GENRES))
    key = F.col("p_partkey")
    language = F.element_at(F.array(*map(F.lit, LANGUAGES)), (key % 5 + 1).cast("int"))
    c = F.coalesce("c", F.lit(0))
    average = F.round(F.least(F.lit(10.0), F.greatest(F.lit(0.0), 5.0 + 3.0 * (F.col("d") / F.col("c") - 5.0))), 3)
    return p.select(
        (key + 1).cast("long").alias("item_id"),
        F.when(F.col("p_size") % 4 == 0, "tv").otherwise("movie").alias("media_type"),
        F.col("p_name").alias("name"),
        language.alias("original_language"),
        F.when(language == "ja", "JP").otherwise("US").alias("origin_country"),
        F.array(F.coalesce(F.element_at(kind, F.col("p_type")), F.lit(37)).cast("long"), F.element_at(sizes, F.col("p_size") % 10 + 1).cast("long")).alias("genre_ids"),
        F.array((F.col("p_size") + 1000).cast("long")).alias("keyword_ids"),
        F.array(F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")).alias("director_ids"),
        F.coalesce("cast_ids", F.expr("CAST(array() AS array<bigint>)")).alias("cast_ids"),
        (2 * (c - 12) * (c - 12)).cast("long").alias("vote_count"),
        F.coalesce(average, F.lit(0.0)).alias("vote_average"),
        F.coalesce(F.col("q") / 10.0, F.lit(0.0)).alias("popularity"),
        "release_date",
    )


@shared
def item_traits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, runtime, company_ids, network_ids, certificate, revenue, providers (region to kinds of offers)."""
    # part is a small file of few tasks whose rows become many times as wide: dealt first
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") + 1).cast("long").alias("item_id"), "p_partkey", "p_size", "p_brand", "p_retailprice").repartition(tasks(spark, sf_dir), "item_id")
    size, key = F.col("p_size"), F.col("p_partkey")
    ids = lambda *c: F.array(*(x.cast("long") for x in c))
    offer = F.struct(ids(size % 3 + 7).alias("flatrate"), ids(100 + size % 20).alias("rent"), ids(330 + size % 8).alias("buy"), F.expr("CAST(array() AS array<bigint>)").alias("ads"))
    other = F.struct(ids(size % 5 + 350).alias("flatrate"), ids(size % 2 + 118).alias("rent"), ids(size % 9).alias("buy"), ids(size % 4 + 336).alias("ads"))
    return p.select(
        "item_id", (40 + 2 * size).cast("long").alias("runtime"), ids(F.regexp_extract("p_brand", r"(\d+)", 1)).alias("company_ids"), ids(size % 6 + 200, key % 4 + 300).alias("network_ids"),
        F.element_at(F.array(*map(F.lit, ["G", "PG", "PG-13", "R", "NC-17"])), ((key + 1) % 5 + 1).cast("int")).alias("certificate"), F.col("p_retailprice").alias("revenue"),
        F.create_map(F.lit("US"), offer, F.lit("IT"), other).alias("providers"),
    )


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner, item_id, bought, priority, flag, basket of each line, dealt by basket; those of a share are read as they were written."""
    if isinstance(sf_dir, Share):
        return sf_dir.bought
    n = tasks(spark, sf_dir)
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").repartition(n, "o_orderkey")
    line = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag").repartition(n, "l_orderkey")
    return line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("long").alias("owner"),
        (F.col("l_partkey") + 1).cast("long").alias("item_id"),
        F.col("o_orderdate").alias("bought"),
        F.col("o_orderpriority").alias("priority"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_orderkey").alias("basket"),
    )


def own_context() -> Column:
    return F.concat(F.lit("p"), F.substring("priority", 1, 1))


def watch_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner, context, item_id, episodes_watched, last_watched_at; contexts are global and one per priority.

    Rows are dealt by owner once, before each comes twice; what groups or joins by owner moves none again.
    """
    p = purchases(spark, sf_dir).select("owner", own_context().alias("_own"), "item_id", "bought").repartition(tasks(spark, sf_dir), "owner")
    contexts = F.explode(F.array(F.lit("global"), F.col("_own")))
    return p.select("owner", contexts.alias("context"), "item_id", "bought").groupBy("owner", "context", "item_id").agg(F.count("*").alias("episodes_watched"), F.max("bought").alias("last_watched_at"))


@shared
def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_id, dst_id, position: the 20 items that most often share an order with an item.

    An item goes to its task with the whole basket beside it; pairs exist there only, and are counted and ranked where they are.
    """
    n = tasks(spark, sf_dir)
    baskets = purchases(spark, sf_dir).select("basket", "item_id").groupBy("basket").agg(F.collect_set("item_id").alias("items")).filter(F.size("items") > 1)
    beside = baskets.select(F.explode("items").alias("src_id"), "items").repartition(n, "src_id")
    n = beside.select("src_id", F.explode("items").alias("dst_id")).filter("src_id <> dst_id").groupBy("src_id", "dst_id").count()
    w = Window.partitionBy("src_id").orderBy(F.desc("count"), "dst_id")
    return n.withColumn("position", F.row_number().over(w)).filter("position <= 20").select("src_id", "dst_id", "position")


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner, profile_id, catalog_id, item_id, seen_date, dealt by owner as the purchases are."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = read(spark, sf_dir, "events").select("user_id", "props", "ts").repartition(tasks(spark, sf_dir), F.col("user_id").cast("long"))
    return e.select(
        F.col("user_id").cast("long").alias("owner"), F.lit("global").alias("profile_id"), F.concat(F.lit("c"), (k % 2).cast("string")).alias("catalog_id"), (k % 10 + 1).alias("item_id"), F.to_date("ts").alias("seen_date")
    )


def feed(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    """owner, item_id, pos: the loved (R) or liked (A) items in order of date and id."""
    p = purchases(spark, sf_dir).filter(F.col("flag") == flag).select("owner", "item_id", "bought").repartition(tasks(spark, sf_dir), "owner").groupBy("owner", "item_id").agg(F.min("bought").alias("bought"))
    w = Window.partitionBy("owner").orderBy("bought", "item_id")
    return p.select("owner", "item_id", F.row_number().over(w).alias("pos"))


def community(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner, item_id, pos: the items that others' views recommend, in order of time."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = read(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("user_id").cast("long").alias("owner"), (k * 7 % 150 + 1).alias("item_id"), "event_id")
    e = e.repartition(tasks(spark, sf_dir), "owner").groupBy("owner", "item_id").agg(F.min("event_id").alias("event_id"))
    return e.select("owner", "item_id", F.row_number().over(Window.partitionBy("owner").orderBy("event_id")).alias("pos"))


def definitions(spark: SparkSession) -> DataFrame:
    kinds = "catalog_id string, media_type string, query_idx int, with_genres string, without_genres string, with_keywords string, with_cast string, with_crew string, with_origin_country string, vote_count_gte long, vote_average_gte double, popularity_lte double, year_from int, year_to int, sort_by string"
    return spark.createDataFrame(DEFINITIONS, kinds)


def profile_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """owner, catalog_id: a profile has the catalogs whose number is its key modulo 5."""
    names = sorted({d[0] for d in DEFINITIONS})
    numbered = spark.createDataFrame([(n, i % 5) for i, n in enumerate(names)], "catalog_id string, slot int")
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("owner"), (F.col("c_custkey") % 5).cast("int").alias("slot")).join(F.broadcast(numbered), "slot").drop("slot")


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id, season, episode, released, has_lang, overview, title."""
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.to_date("l_shipdate")).alias("released"), F.max((F.col("l_linestatus") == "F").cast("int")).alias("f"), F.max("l_returnflag").alias("g"))
    return line.select(
        (F.col("l_orderkey") % 997 + 1).cast("long").alias("series_id"), (F.floor(F.col("l_orderkey") / 997) + 1).cast("int").alias("season"), F.col("l_linenumber").cast("int").alias("episode"),
        "released", (F.col("f") == 1).alias("has_lang"), F.when(F.col("g") == "R", "told").alias("overview"), F.when(F.col("g") == "N", F.concat(F.lit("Episode "), F.col("l_linenumber").cast("string"))).otherwise("named").alias("title"),
    )


def crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_ns, src_id, dst_ns, dst_id, priority; no row for every seventh item."""
    p = read(spark, sf_dir, "part").filter("p_partkey % 7 <> 0")
    site = F.element_at(F.array(F.lit("thetvdb"), F.lit("thetvdb/series"), F.lit("thetvdb/season")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return p.select(site.alias("src_ns"), (F.floor(F.col("p_partkey") / 2)).cast("long").alias("src_id"), F.lit("alt").alias("dst_ns"), (F.col("p_partkey") + 50001).cast("long").alias("dst_id"), (F.col("p_partkey") % 3).cast("int").alias("priority"))


def _values() -> str:
    lit = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else repr(x)
    return ", ".join("(" + ", ".join(map(lit, d)) + ")" for d in DEFINITIONS)


_GENRE_CASE = "CASE p_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_GENRE.items()) + " ELSE 37 END"
_NAMES = sorted({d[0] for d in DEFINITIONS})

#: name -> (tables it needs, SQL)
BASE_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "item_features": ((), f"""
  SELECT CAST(p_partkey + 1 AS BIGINT) AS item_id, CASE WHEN p_size % 4 = 0 THEN 'tv' ELSE 'movie' END AS media_type, p_name AS name,
    {LANGUAGES!r}[CAST(p_partkey % 5 + 1 AS INTEGER)] AS original_language, CASE WHEN p_partkey % 5 = 2 THEN 'JP' ELSE 'US' END AS origin_country,
    [CAST({_GENRE_CASE} AS BIGINT), CAST({SIZE_GENRES!r}[p_size % 10 + 1] AS BIGINT)] AS genre_ids,
    [CAST(p_size + 1000 AS BIGINT)] AS keyword_ids, [CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT)] AS director_ids,
    coalesce(cast_ids, CAST([] AS BIGINT[])) AS cast_ids, CAST(2 * (coalesce(c, 0) - 12) * (coalesce(c, 0) - 12) AS BIGINT) AS vote_count,
    coalesce(round(least(10.0::DOUBLE, greatest(0.0::DOUBLE, 5.0::DOUBLE + 3.0::DOUBLE * (CAST(d AS DOUBLE) / c - 5.0::DOUBLE))), 3), 0.0::DOUBLE) AS vote_average,
    coalesce(q / 10.0::DOUBLE, 0.0::DOUBLE) AS popularity, release_date
  FROM part LEFT JOIN (SELECT l_partkey, count(*) AS c, sum(CAST(round(l_discount * 100) AS BIGINT)) AS d, sum(l_quantity) AS q, min(CAST(l_shipdate AS DATE)) AS release_date,
      list_sort(list(DISTINCT CAST(l_suppkey + 1 AS BIGINT)))[1:5] AS cast_ids FROM lineitem GROUP BY l_partkey) ON p_partkey = l_partkey"""),
    "purchases": ((), "SELECT CAST(o_custkey AS BIGINT) AS owner, CAST(l_partkey + 1 AS BIGINT) AS item_id, o_orderdate AS bought, o_orderpriority AS priority, l_returnflag AS flag, l_orderkey AS basket FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "watch_history": (("purchases",), "SELECT owner, context, item_id, count(*) AS episodes_watched, max(bought) AS last_watched_at FROM (SELECT owner, unnest(['global', 'p' || priority[1]]) AS context, item_id, bought FROM purchases) GROUP BY ALL"),
    "similar_items": (("purchases",), """
  SELECT src_id, dst_id, CAST(position AS INTEGER) AS position FROM (
    SELECT a.item_id AS src_id, b.item_id AS dst_id, row_number() OVER (PARTITION BY a.item_id ORDER BY count(*) DESC, b.item_id) AS position
    FROM (SELECT DISTINCT basket, item_id FROM purchases) a JOIN (SELECT DISTINCT basket, item_id FROM purchases) b ON a.basket = b.basket AND a.item_id <> b.item_id GROUP BY a.item_id, b.item_id) WHERE position <= 20"""),
    "impressions": ((), "SELECT CAST(user_id AS BIGINT) AS owner, 'global' AS profile_id, 'c' || CAST(k % 2 AS VARCHAR) AS catalog_id, k % 10 + 1 AS item_id, CAST(ts AS DATE) AS seen_date FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"),
    "loved": (("purchases",), "SELECT owner, item_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY min(bought), item_id) AS INTEGER) AS pos FROM purchases WHERE flag = 'R' GROUP BY owner, item_id"),
    "liked": (("purchases",), "SELECT owner, item_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY min(bought), item_id) AS INTEGER) AS pos FROM purchases WHERE flag = 'A' GROUP BY owner, item_id"),
    "item_traits": ((), """
  SELECT CAST(p_partkey + 1 AS BIGINT) AS item_id, CAST(40 + 2 * p_size AS BIGINT) AS runtime, [CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT)] AS company_ids, [CAST(p_size % 6 + 200 AS BIGINT), CAST(p_partkey % 4 + 300 AS BIGINT)] AS network_ids,
    ['G', 'PG', 'PG-13', 'R', 'NC-17'][CAST((p_partkey + 1) % 5 + 1 AS INTEGER)] AS certificate, p_retailprice AS revenue, [p_size % 5 + 350, p_size % 2 + 118, p_size % 9, p_size % 4 + 336] AS offers_it FROM part"""),
    "community": ((), "SELECT owner, item_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY event_id) AS INTEGER) AS pos FROM (SELECT CAST(user_id AS BIGINT) AS owner, CAST(json_extract_string(props, '$.k') AS BIGINT) * 7 % 150 + 1 AS item_id, min(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL)"),
    "definitions": ((), f"SELECT * FROM (VALUES {_values()}) AS d({', '.join(DEFINITION_COLUMNS)})"),
    "profile_catalogs": ((), f"SELECT CAST(c_custkey AS BIGINT) AS owner, catalog_id FROM customer JOIN (VALUES {', '.join(f'({n!r}, {i % 5})' for i, n in enumerate(_NAMES))}) AS n(catalog_id, slot) ON c_custkey % 5 = slot"),
    "episodes": ((), """
  SELECT CAST(l_orderkey % 997 + 1 AS BIGINT) AS series_id, CAST(l_orderkey // 997 + 1 AS INTEGER) AS season, CAST(l_linenumber AS INTEGER) AS episode, min(CAST(l_shipdate AS DATE)) AS released,
    bool_or(l_linestatus = 'F') AS has_lang, CASE WHEN max(l_returnflag) = 'R' THEN 'told' END AS overview, CASE WHEN max(l_returnflag) = 'N' THEN 'Episode ' || CAST(l_linenumber AS VARCHAR) ELSE 'named' END AS title
  FROM lineitem GROUP BY l_orderkey, l_linenumber"""),
    "crosswalk": ((), "SELECT ['thetvdb', 'thetvdb/series', 'thetvdb/season'][CAST(p_partkey % 3 + 1 AS INTEGER)] AS src_ns, CAST(p_partkey // 2 AS BIGINT) AS src_id, 'alt' AS dst_ns, CAST(p_partkey + 50001 AS BIGINT) AS dst_id, CAST(p_partkey % 3 AS INTEGER) AS priority FROM part WHERE p_partkey % 7 <> 0"),
}
