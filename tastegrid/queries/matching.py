"""Queries of discovery from rows: catalogs that profiles own, merge or ask for, and searches of many texts."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.operators import matching as M
from tastegrid.operators.discovery import CERTIFICATES, PROVIDERS
from tastegrid.operators.scoring import KIDS_GENRES, KIDS_KEYWORDS
from tastegrid.plans import catalogs as C
from tastegrid.queries import query
from tastegrid.sources import domain as D
from tastegrid.sources.domain import BASE_SQL

# Fixed values of the fixture: the queries of the catalogs that profiles own, each key for some of them (k: a number of the query).
OWN_QUERIES = {
    "media_type": "CASE k % 5 WHEN 0 THEN 'tv' WHEN 1 THEN NULL ELSE 'movie' END",
    "with_genres": "CASE k % 7 WHEN 0 THEN '28|12' WHEN 1 THEN '18' WHEN 2 THEN '35, 16' WHEN 3 THEN '27|80|99' WHEN 4 THEN '10751,14' END",
    "without_genres": "CASE k % 11 WHEN 0 THEN '27,53' WHEN 5 THEN '16' END",
    "with_keywords": "CASE k % 13 WHEN 2 THEN '1004|1009|1013' WHEN 7 THEN '1021' END",
    "without_keywords": "CASE WHEN k % 17 = 3 THEN '1001|1002' END",
    "with_cast": "CASE WHEN k % 19 = 4 THEN concat(k % 97 + 1, '|', k % 89 + 1) END",
    "with_crew": "CASE WHEN k % 23 = 6 THEN concat(11 + k % 40, '|13') END",
    "with_people": "CASE k % 29 WHEN 8 THEN concat(k % 97 + 1, '|21|34') WHEN 9 THEN concat(k % 50 + 1, ',', 11 + k % 40) END",
    "with_companies": "CASE WHEN k % 31 = 9 THEN '12|35' END",
    "with_networks": "CASE WHEN k % 37 = 1 THEN '201,302' END",
    "with_origin_country": "CASE k % 12 WHEN 1 THEN 'JP' WHEN 7 THEN 'US|JP' END",
    "original_language": "CASE WHEN k % 9 = 3 THEN 'ja|ko' END",
    "without_language": "CASE WHEN k % 10 = 4 THEN 'en' END",
    "vote_count_gte": "CASE WHEN k % 6 = 1 THEN 20 END", "vote_count_lte": "CASE WHEN k % 25 = 2 THEN 400 END",
    "vote_average_gte": "CASE WHEN k % 8 = 5 THEN 4.5 END", "vote_average_lte": "CASE WHEN k % 27 = 0 THEN 6.0 END",
    "popularity_lte": "CASE WHEN k % 14 = 6 THEN 80 END",
    "year_from": "CASE WHEN k % 15 = 2 THEN 1993 END", "year_to": "CASE WHEN k % 16 = 9 THEN 1992 END",
    "runtime_gte": "CASE WHEN k % 18 = 5 THEN 60 END", "runtime_lte": "CASE WHEN k % 20 = 7 THEN 120 END",
    "certification_lte": "CASE k % 21 WHEN 2 THEN 'PG-13' WHEN 8 THEN 'G' END",
    "watch_provider": "CASE k % 22 WHEN 3 THEN 'Netflix' WHEN 9 THEN 'prime' WHEN 4 THEN 'none' END",
    "watch_region": "CASE WHEN k % 22 = 9 THEN 'IT' END",
    "text_search": "CASE k % 24 WHEN 11 THEN 'Red' WHEN 5 THEN 'an' END",
    "sort_by": "CASE k % 6 WHEN 0 THEN 'popularity.desc' WHEN 1 THEN 'vote_average.desc' WHEN 2 THEN 'date' WHEN 3 THEN 'vote_count.asc' WHEN 4 THEN 'first_air_date.asc' END",
}
_CASES = ", ".join(f"{e} AS {c}" for c, e in OWN_QUERIES.items())
BASE_SQL["own_queries"] = ((), f"SELECT owner, catalog_id, query_idx, {_CASES} FROM (SELECT CAST(c_custkey AS BIGINT) AS owner, 'own' AS catalog_id, CAST(i AS INTEGER) AS query_idx, c_custkey * 3 + i AS k FROM customer, range(3) AS r(i))")


def own_queries(spark: SparkSession, d: str) -> DataFrame:
    """owner, catalog_id, query_idx and the keys of a block: three queries in every profile's own catalog."""
    # customer is a small file of few tasks, and a row of it becomes three wide ones: dealt first
    c = D.read(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("owner")).repartition(D.tasks(spark, d), "owner").select("owner", F.lit("own").alias("catalog_id"), F.explode(F.array(*map(F.lit, range(3)))).alias("query_idx"))
    c = c.withColumn("k", F.col("owner") * 3 + F.col("query_idx"))
    return c.select("owner", "catalog_id", "query_idx", *(F.expr(e).cast(M.KINDS[k]).alias(k) for k, e in OWN_QUERIES.items()))


def whole_items(spark: SparkSession, d: str) -> DataFrame:
    """Items with all that a block can ask for; every ninth film has a keyword that children aren't shown."""
    f = D.item_features(spark, d).join(D.item_traits(spark, d), "item_id")
    return f.withColumn("keyword_ids", F.when(F.col("item_id") % 9 == 4, F.concat("keyword_ids", F.array(F.lit(KIDS_KEYWORDS[1]).cast("long")))).otherwise(F.col("keyword_ids")))


BASE_SQL["whole_items"] = (("item_features", "item_traits"), f"SELECT * REPLACE (CASE WHEN item_id % 9 = 4 THEN keyword_ids || [CAST({KIDS_KEYWORDS[1]} AS BIGINT)] ELSE keyword_ids END AS keyword_ids) FROM item_features JOIN item_traits USING (item_id)")


def found_sql(queries: str, keys: str, n: int) -> str:
    """The first n items of every query by testing each against all items."""
    ids = lambda c: f"[CAST(trim(x) AS BIGINT) FOR x IN string_split_regex({c}, '[,|]')]"
    texts = lambda c: f"[trim(x) FOR x IN string_split_regex({c}, '[,|]')]"
    rank = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CERTIFICATES.items()) + " END"
    lists = [c for c, _, _ in M.LISTS] + ["without_genres", "without_keywords"]
    split = ", ".join([f"{ids(c)} AS _{c}" for c in lists] + [f"{texts(c)} AS _{c}" for c in ("with_origin_country", "original_language", "without_language")])  # once a query
    ids = texts = lambda c: f"_{c.removeprefix('q.')}"
    has = lambda c, own: f"({c} IS NULL OR CASE WHEN contains({c}, '|') THEN list_has_any({own}, {ids(c)}) ELSE list_has_all({own}, {ids(c)}) END)"
    tests = [has(c, own or "(cast_ids || director_ids)") for c, _, own in M.LISTS]
    tests += [f"({c} IS NULL OR NOT list_has_any({own}, {ids(c)}))" for c, own in (("without_genres", "genre_ids"), ("without_keywords", "keyword_ids"))]
    tests += ["(q.media_type IS NULL OR i.media_type = q.media_type)", f"(with_origin_country IS NULL OR list_contains({texts('with_origin_country')}, origin_country))"]
    tests += [f"(q.original_language IS NULL OR list_contains({texts('q.original_language')}, i.original_language))", f"(without_language IS NULL OR NOT list_contains({texts('without_language')}, i.original_language))"]
    tests += [f"({c}_{e} IS NULL OR {c} {o} {c}_{e})" for c in ("vote_count", "vote_average") for e, o in (("gte", ">="), ("lte", "<="))] + ["(popularity_lte IS NULL OR popularity IS NULL OR popularity <= popularity_lte)"]
    tests += [f"({c} IS NULL OR year(release_date) {o} {c})" for c, o in (("year_from", ">="), ("year_to", "<="))] + [f"({c} IS NULL OR q.media_type = 'tv' OR runtime {o} {c})" for c, o in (("runtime_gte", ">="), ("runtime_lte", "<="))]
    pid = "CASE lower(watch_provider) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PROVIDERS.items()) + " END"
    tests += [f"(certification_lte IS NULL OR {rank('certificate')} <= {rank('certification_lte')})", f"({pid} IS NULL OR list_contains(offers_it, {pid}))", "(text_search IS NULL OR contains(lower(name), lower(text_search)))"]
    value = "CASE sort_by WHEN 'vote_average.desc' THEN vote_average WHEN 'date' THEN date_diff('day', DATE '1970-01-01', release_date) WHEN 'vote_count.asc' THEN -vote_count WHEN 'first_air_date.asc' THEN -date_diff('day', DATE '1970-01-01', release_date) ELSE popularity END"
    return f"""SELECT {keys}, item_id, popularity, row_number() OVER (PARTITION BY {keys} ORDER BY {value} DESC NULLS LAST, item_id) AS pos
  FROM (SELECT *, {split} FROM {queries}) q JOIN whole_items i ON {' AND '.join(tests)} QUALIFY pos <= {n}"""


BASE_SQL["own_found"] = (("own_queries", "whole_items"), found_sql("own_queries", "owner, catalog_id, query_idx", 60))
_KIDS = "SELECT * REPLACE (concat_ws(',', without_genres, '{}') AS without_genres, concat_ws(',', without_keywords, '{}') AS without_keywords, CAST(NULL AS DOUBLE) AS vote_average_gte, CAST(NULL AS DOUBLE) AS vote_average_lte) FROM own_queries WHERE owner % 2 = 0 UNION ALL SELECT * FROM own_queries WHERE owner % 2 <> 0"
BASE_SQL["own_queries_kids"] = (("own_queries",), _KIDS.format(",".join(map(str, KIDS_GENRES)), ",".join(map(str, KIDS_KEYWORDS))))
BASE_SQL["own_found_kids"] = (("own_queries_kids", "whole_items"), found_sql("own_queries_kids", "owner, catalog_id, query_idx", 20))


def own_found(spark: SparkSession, d: str, *by: str) -> DataFrame:
    return M.match(whole_items(spark, d), own_queries(spark, d), 60, *by)


@query("r01_rows", "SELECT owner, query_idx, item_id, CAST(pos AS INTEGER) AS pos FROM own_found", ("own_found",))
def r01_rows(spark, d):
    """The first pages of every query of every profile's own catalog."""
    return own_found(spark, d).select("owner", "query_idx", "item_id", "pos")


@query("r18_rows_kids", "SELECT owner, query_idx, item_id, CAST(pos AS INTEGER) AS pos FROM own_found_kids", ("own_found_kids",))
def r18_rows(spark, d):
    """The same with every second profile a child's."""
    return M.match(whole_items(spark, d), M.for_kids(own_queries(spark, d), F.col("owner") % 2 == 0), 20).select("owner", "query_idx", "item_id", "pos")


@query("c01_own_catalogs", """
WITH o AS (SELECT * FROM own_found QUALIFY row_number() OVER (PARTITION BY owner, item_id ORDER BY query_idx, pos) = 1)
SELECT owner, item_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY query_idx, pos) AS INTEGER) AS pos FROM o QUALIFY row_number() OVER (PARTITION BY owner ORDER BY query_idx, pos) <= 100""", ("own_found",))
def c01_own(spark, d):
    """Each profile's own catalog, its queries one after another."""
    return C.preset_catalog(own_found(spark, d, "owner"), keys=("owner", "catalog_id")).select("owner", "item_id", "pos")


@query("c09_own_catalogs", """
WITH o AS (SELECT * FROM own_found QUALIFY row_number() OVER (PARTITION BY owner, item_id ORDER BY pos, query_idx) = 1)
SELECT owner, item_id, CAST(row_number() OVER (PARTITION BY owner ORDER BY pos, query_idx) AS INTEGER) AS pos FROM o QUALIFY row_number() OVER (PARTITION BY owner ORDER BY pos, query_idx) <= 20""", ("own_found",))
def c09_own(spark, d):
    """A page of each profile's own catalog, its queries in turn."""
    return C.multi_query_catalog(own_found(spark, d, "owner"), keys=("owner", "catalog_id")).select("owner", "item_id", "pos")


BASE_SQL["asked_texts"] = ((), "SELECT DISTINCT lower(text) AS text FROM (SELECT split_part(p_name, ' ', CAST(p_partkey % 3 + 1 AS INTEGER)) AS text FROM part UNION ALL SELECT substr(p_name, CAST(p_partkey % 4 + 1 AS INTEGER), CAST(p_partkey % 7 + 1 AS INTEGER)) FROM part UNION ALL SELECT p_name FROM part WHERE p_partkey % 10 = 0) WHERE text <> ''")


@query("r16_many_texts", """
SELECT text, item_id, CAST(row_number() OVER (PARTITION BY text ORDER BY CASE WHEN lower(name) = text THEN 0 WHEN starts_with(lower(name), text) THEN 1 ELSE 2 END, popularity DESC NULLS LAST, item_id) AS INTEGER) AS pos
FROM asked_texts JOIN item_features ON contains(lower(name), text) QUALIFY pos <= 20""", ("asked_texts", "item_features"))
def r16_many(spark, d):
    """Words, pieces and whole names, each looked for in all names."""
    p, k = D.read(spark, d, "part"), F.col("p_partkey")
    texts = p.select(F.explode(F.array(F.split_part("p_name", F.lit(" "), (k % 3 + 1).cast("int")), F.substring("p_name", (k % 4 + 1).cast("int"), (k % 7 + 1).cast("int")), F.when(k % 10 == 0, F.col("p_name")))).alias("text"))
    return M.search_texts(D.item_features(spark, d), texts.select(F.lower("text").alias("text")), 20)
