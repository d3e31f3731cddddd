"""Queries over titles and documents."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.functions import titles as T
from tastegrid.queries import query
from tastegrid.sources import domain as D
from tastegrid.sources.domain import BASE_SQL

_FORMS = ["", " Season 2", " 3rd Season", " II", " Part 4", " s5", " Season 12", " 7", " - Stagione 3", " (Season 4)", " Cour 2", " The Final Season"]
BASE_SQL["titles"] = ((), f"SELECT p_partkey, p_size, p_name || {_FORMS!r}[p_partkey % {len(_FORMS)} + 1] AS title FROM part")


def titles(spark: SparkSession, d: str) -> DataFrame:
    forms = F.array(*map(F.lit, _FORMS))
    return D.read(spark, d, "part").select("p_partkey", "p_size", F.concat("p_name", F.element_at(forms, (F.col("p_partkey") % len(_FORMS) + 1).cast("int"))).alias("title"))


def _season_case() -> str:
    out = []
    for n, (short, word, roman) in T.ORDINALS.items():
        has = [f"season {n}", f"{short} season", f" s{n}", f"{word} season", f"part {n}", f"part {roman}", f" {roman} ", f" {short}"]
        out.append("WHEN " + " OR ".join(f"contains(lower(title), '{x}')" for x in has) + f" OR ends_with(lower(title), ' {roman}') THEN {n}")
    return "CASE " + " ".join(out) + " WHEN TRY_CAST(regexp_extract(title, '(?i)(?:season|part| s| s\\.)\\s*(\\d+)', 1) AS INTEGER) BETWEEN 1 AND 20 THEN TRY_CAST(regexp_extract(title, '(?i)(?:season|part| s| s\\.)\\s*(\\d+)', 1) AS INTEGER) ELSE 1 END"


@query("p12_season_from_title", f"SELECT p_partkey, {_season_case()} AS season FROM titles", ("titles",))
def p12(spark, d):
    return titles(spark, d).select("p_partkey", T.season_from_title(F.col("title")).alias("season"))


@query("p13_search_title", r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '(?i)(?:season|part| s| s\.)\s*\d+', ''), '(?i)\b(?:2nd|3rd|4th|5th|second|third|fourth|fifth)\s+season\b', ''), '(?i)\b(?:i{2,3}|iv|v)\b', ''), '\s+', ' ', 'g')) AS search FROM titles""", ("titles",))
def p13(spark, d):
    return titles(spark, d).select("p_partkey", T.search_title(F.col("title")).alias("search"))


@query("p11_part_and_season", r"""
SELECT p_partkey, season, CASE WHEN part > 1 THEN part END AS part, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 > 0 THEN title WHEN p_partkey % 3 = 0 THEN '東京 ' || title ELSE title END AS shown FROM (SELECT p_partkey, title, coalesce(TRY_CAST(regexp_extract(title, '(?i)Season\s*(\d+)', 1) AS INTEGER), TRY_CAST(regexp_extract(title, '(?i)(\d+)(?:st|nd|rd|th)\s*Season', 1) AS INTEGER)) AS season,
  coalesce(TRY_CAST(regexp_extract(title, '(?i)(?:Part|Cour|Parte)\s*(\d+)', 1) AS INTEGER), CASE WHEN NOT regexp_matches(title, '(?i)(?:Season\s*\d+|\d+(?:st|nd|rd|th)\s*Season)\s*$') AND TRY_CAST(regexp_extract(title, '\s(\d+)$', 1) AS INTEGER) <> p_size % 8 THEN TRY_CAST(regexp_extract(title, '\s(\d+)$', 1) AS INTEGER) END) AS part FROM titles)""", ("titles",))
def p11(spark, d):
    t, k = F.col("title"), F.col("p_partkey")
    new = F.when(k % 3 == 0, F.concat(F.lit("東京 "), t)).otherwise(t)
    old = F.when(k % 2 == 0, F.lit("古い")).otherwise(t)
    return titles(spark, d).select("p_partkey", T.season_number(t).alias("season"), T.part_number(t, F.col("p_size") % 8).alias("part"), T.readable_title(new, old).alias("shown"))


@query("p08_clean_title", r"""
SELECT p_partkey, trim(regexp_replace(title, '(?i)\s*(?:-|–|—)?\s*\(?\s*(Stagione|Season)\s*\d+\s*\)?\s*', '', 'g')) AS clean,
  nullif(concat_ws(' - ', CASE WHEN p_size % 4 > 1 THEN 'S' || (p_size % 4) WHEN p_size % 4 = 1 AND (p_size % 3 > 1 OR p_size + 20 <= 50) THEN 'S1' END, CASE WHEN p_size % 5 > 1 THEN 'Pt' || (p_size % 5) END), '') AS badge FROM titles""", ("titles",))
def p08(spark, d):
    s = F.col("p_size")
    badge = T.season_badge(s % 4, F.when(s % 5 > 1, s % 5), s % 3, s + 20, F.lit("tv"))
    return titles(spark, d).select("p_partkey", T.clean_title(F.col("title")).alias("clean"), badge.alias("badge"))


_STREAMS = ["Film 1080p ITA ENG", "Film [Subs: Eng, Ita] ENG", "Film SUB ITA", "Film Italian DD5.1", "Film (Multi-Subs ita)", "Film ENG\nITA", "Film ita-subs", "Capitan"]
_STRIP = "description"
for _p in T.SUBTITLES:
    _STRIP = f"regexp_replace({_STRIP}, '{_p}', '', 'g')"


@query("p18_classify_audio", f"SELECT series, bool_or(regexp_matches({_STRIP}, '(?i)(?:\\b(?:ITA|ITALIAN|ITALIANO)\\b|\U0001F1EE\U0001F1F9)')) AS has_lang FROM (SELECT p_size AS series, string_split({[x.replace(chr(10), '~') for x in _STREAMS]!r}[p_partkey % 8 + 1], '~')[1] || ' ' || p_name || ' ' AS description FROM part) GROUP BY ALL")
def p18(spark, d):
    t = F.element_at(F.array(*map(F.lit, _STREAMS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return D.read(spark, d, "part").groupBy(F.col("p_size").alias("series")).agg(F.bool_or(T.has_audio(t, F.col("p_name"), F.lit(None).cast("string"))).alias("has_lang"))


@query("p23_query_fingerprint", """
SELECT owner, catalog_id, query_idx, sha256('{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}') AS fingerprint FROM (
  SELECT owner, catalog_id, query_idx, unnest(['type', 'with_genres', 'without_genres', 'with_keywords', 'with_cast', 'with_crew', 'sort_by', 'region']) AS k, unnest([media_type, with_genres, without_genres, with_keywords, with_cast, with_crew, sort_by, CASE WHEN owner % 3 > 0 THEN 'r' || (owner % 3) END]) AS v FROM profile_catalogs JOIN definitions USING (catalog_id)) WHERE v IS NOT NULL AND v <> '' GROUP BY ALL""", ("profile_catalogs", "definitions"))
def p23(spark, d):
    from tastegrid.operators.merging import fingerprint

    keys = ["with_genres", "without_genres", "with_keywords", "with_cast", "with_crew", "sort_by"]
    region = F.when(F.col("owner") % 3 > 0, F.concat(F.lit("r"), (F.col("owner") % 3).cast("string"))).otherwise("")
    m = F.create_map(F.lit("type"), F.col("media_type"), F.lit("api_key"), F.lit("secret"), F.lit("region"), region, *(x for k in keys for x in (F.lit(k), F.col(k))))
    q = D.profile_catalogs(spark, d).join(F.broadcast(D.definitions(spark)), "catalog_id")
    return q.select("owner", "catalog_id", "query_idx", fingerprint(m).alias("fingerprint"))


@query("p21_clamp_filters", "SELECT event_id, greatest(0.0::DOUBLE, least(10.0::DOUBLE, value / 5)) AS vote_average_gte, CAST(greatest(0, floor(value * 3 - 20)) AS BIGINT) AS vote_count_gte FROM events")
def p21(spark, d):
    from tastegrid.operators.merging import clamp_filters

    e = D.read(spark, d, "events")
    m = F.create_map(F.lit("vote_average.gte"), (F.col("value") / 5).cast("string"), F.lit("vote_count.gte"), (F.col("value") * 3 - 20).cast("string"), F.lit("evil"), F.lit("1"))
    c = e.select("event_id", clamp_filters(m).alias("f"))
    return c.select("event_id", F.col("f")["vote_average.gte"].cast("double").alias("vote_average_gte"), F.col("f")["vote_count.gte"].cast("long").alias("vote_count_gte"))
