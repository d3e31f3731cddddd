"""Numeric cases of single operators."""

import pytest
from pyspark.sql import functions as F

from tastegrid.functions import ids as I
from tastegrid.functions import titles as T
from tastegrid.operators import discovery as D
from tastegrid.operators import merging as M
from tastegrid.operators import ranking as R
from tastegrid.operators import scoring as S
from tastegrid.operators import vectors as V


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_item_vector(spark):
    f = spark.createDataFrame([(1, [28], [100], [50], [1, 2, 3, 4, 5, 6], "US")], "item_id long, genre_ids array<long>, keyword_ids array<long>, director_ids array<long>, cast_ids array<long>, origin_country string")
    got = {r.feature: r.weight for r in V.item_vector(f).collect()}
    assert got == {k: 100.0 for k in ("g:28", "k:100", "d:50", "a:1", "a:2", "a:3", "a:4", "a:5", "o:US")}


def test_normalize_and_fuse(spark):
    kind = "p int, feature string, weight double"
    s, a = spark.createDataFrame([(1, "g:1", 100.0), (1, "g:2", 300.0), (2, "g:1", 100.0), (3, "g:9", 700.0)], kind), spark.createDataFrame([(1, "g:1", 500.0), (2, "g:3", 100.0)], kind)
    n = spark.createDataFrame([(1, 50), (2, 1000)], "p int, n long")
    got = {(r.p, r.feature): round(r.weight, 6) for r in V.fuse(s, a, n, "p").collect()}
    assert got == {(1, "g:1"): 85 + 3.75, (1, "g:2"): 11.25, (2, "g:1"): 15.0, (2, "g:3"): 85.0, (3, "g:9"): 700.0}
    assert V.normalize_l1(spark.createDataFrame([(1, "g:1", 0.0)], kind), "p").count() == 0
    cold = V.fuse(s, a, n, "p", cold_start="normalised").filter("p = 3").first()
    assert cold.weight == 100.0


def test_top_features(spark):
    v = spark.createDataFrame([(1, "g:28", 100.0), (1, "g:12", 50.0), (1, "g:16", 200.0), (1, "k:5", 900.0)], "p int, feature string, weight double")
    assert [r.feature for r in V.top_features(v, "g", 2, "p").orderBy("pos").collect()] == ["g:16", "g:28"]


@pytest.mark.parametrize(("place", "n", "genres", "want"), [(1, 1, [], 149), (40, 2, [], 60), (None, 3, [], 25), (50, 1, [28], 130), (50, 1, [12], 115), (50, 1, [16], 105)])
def test_hybrid_score(spark, place, n, genres, want):
    df = spark.createDataFrame([(place, n, genres)], "place int, n int, g array<long>").withColumn("top", S.ids([28, 12, 16]))
    assert df.select(S.hybrid_score(F.col("place"), F.col("n"), F.col("top"), F.col("g")).alias("s")).first().s == want


def test_penalties_and_bonus(spark):
    df = spark.range(1)
    value = lambda c: df.select(c.alias("x")).first().x
    assert [round(value(S.impression_penalty(F.lit(d))), 6) for d in (0, 2, 3, 5, 20)] == [1, 1, 0.8, 0.4, 0.2]
    assert [round(value(S.niche_bonus(F.lit(v))), 6) for v in (5, 20, 500, 1250, 2500)] == [0, 2.5, 1, 0.5, 0]
    assert value(S.bayes(F.lit(0), F.lit(9.0))) == 6.5


def test_map_form_is_long_form(spark):
    f = spark.createDataFrame([(1, [28, 28, 12], [5])], "item_id long, genre_ids array<long>, keyword_ids array<long>")
    v = spark.createDataFrame([("g:28", 1.5), ("g:12", 2.0), ("k:9", 4.0)], "feature string, weight double")
    long = f.select(F.explode(F.concat(V.prefixed("g", "genre_ids"), V.prefixed("k", "keyword_ids"))).alias("feature")).join(v, "feature").agg(F.sum("weight").alias("w")).first().w
    one = V.as_maps(v.withColumn("p", F.lit(1)), "p")
    assert f.crossJoin(one).select(S.thematic(F.col("vector")).alias("w")).first().w == long == 5.0
    many = spark.createDataFrame([(1, list(range(9)), None)], "item_id long, genre_ids array<long>, keyword_ids array<long>")
    w = V.as_maps(spark.createDataFrame([(1, f"g:{i}", 2.0**i) for i in range(12)] + [(1, "k:text", 1.0), (1, "o:US", 1.0)], "p int, feature string, weight double"), "p")
    assert many.crossJoin(w).select(S.thematic(F.col("vector")).alias("w")).first().w == 2.0**9 - 1  # lists beyond the unrolled part


def test_lists(spark):
    lists = spark.createDataFrame([(0, i, x) for i, x in enumerate([1, 3, 5])] + [(1, i, x) for i, x in enumerate([2, 3, 6])], "list_idx int, pos int, item_id int").withColumn("c", F.lit(1))
    order = lambda df: [r.item_id for r in df.orderBy("place").collect()]
    assert order(R.interleave(lists, "c")) == [1, 2, 3, 5, 6]
    assert order(R.interleave(lists, "c", skip=2, limit=3)) == [3, 5, 6]
    assert rows(R.consensus(lists, "c").filter("n > 1"), "item_id", "n", "bonus") == [(3, 2, 3)]


def test_two_tier_keeps_half(spark):
    pool = spark.createDataFrame([(1, i, float(i), float(-i)) for i in range(4)], "p int, item_id int, light double, full double")
    got = R.two_tier(pool, spark.createDataFrame([], "p int, item_id int, days long"), "p")
    assert [r.item_id for r in got.orderBy("pos").collect()] == [2, 3]


def test_diversity(spark):
    kept = R.diversity_caps(spark.createDataFrame([(1, i, i, [28], [i % 2]) for i in range(12)], "c int, item_id int, pos int, genre_ids array<long>, director_ids array<long>"), "c", genre=10, director=3)
    assert rows(kept, "item_id") == [(0,), (1,), (2,), (3,), (4,), (5,)]


@pytest.mark.parametrize(("a", "b", "mode", "want"), [("28", "16", "or", "28|16"), ("28", "16", "and", "28,16"), ("28,16", "16,35", "or", "28|16|35")])
def test_smart_merge(spark, a, b, mode, want):
    m = lambda g, s: F.create_map(F.lit("with_genres"), F.lit(g), F.lit("sort_by"), F.lit(s))
    got = spark.range(1).select(M.smart_merge(m(a, "vote_average.desc"), m(b, "popularity.desc"), mode).alias("m")).first().m
    assert got == {"with_genres": want, "sort_by": "vote_average.desc"}


def test_ids(spark):
    df = spark.createDataFrame([("tmdb:5",), ("kitsu:7:3",), ("tt9:2:4",), ("0",), (None,)], "id string")
    c = F.col("id")
    assert [tuple(r) for r in df.select(I.content_id(c), I.base_id(c), I.rewrite_episode_id(c, F.lit("n:1"))).collect()] == [("5", "tmdb:5", "n:1"), ("3", "kitsu:7", "n:1:1:3"), ("4", "tt9", "n:1:2:4"), ("", "0", None), ("", None, None)]


@pytest.mark.parametrize(("title", "season", "search"), [("Show Season 2", 2, "Show"), ("Show III", 3, "Show"), ("Show 4th Season", 4, "Show"), ("Show part 11", 11, "Show"), ("Show", 1, "Show"), ("", 1, "")])
def test_titles(spark, title, season, search):
    r = spark.createDataFrame([(title,)], "t string").select(T.season_from_title(F.col("t")).alias("a"), T.search_title(F.col("t")).alias("b")).first()
    assert (r.a, r.b) == (season, search)


def test_audio(spark):
    df = spark.createDataFrame([("Film ITA",), ("Film SUB ITA",), ("Film [Subs: Ita] ENG",), ("Film\nITA",), ("capital",)], "t string")
    assert [r[0] for r in df.select(T.has_audio(F.col("t"), F.lit(None), F.lit(""))).collect()] == [True, False, False, False, False]


def test_discovery(spark):
    items = spark.createDataFrame([(1, "movie", [28, 12], 10.0), (2, "movie", [28], 5.0), (3, "tv", [27], None)], "item_id int, media_type string, genre_ids array<long>, popularity double").withColumns({c: F.lit(None).cast("array<long>") for c in ("keyword_ids", "cast_ids", "director_ids")})
    one = lambda **k: rows(items.filter(D.Discovery(**k).predicate()), "item_id")
    assert one(with_genres="28|27") == [(1,), (2,), (3,)] and one(with_genres="28,12") == [(1,)] and one(without_genres="27") == [(1,), (2,)]
    assert one(popularity_lte=6.0) == [(2,), (3,)] and D.Discovery(vote_average_gte=3).for_kids().vote_average_gte is None


def test_saturation(spark):
    df = spark.createDataFrame([(1, i, i, [28]) for i in range(1, 10)], "p int, item_id int, rank int, genre_ids array<long>")
    assert [round(r.penalty, 6) for r in S.genre_saturation(df, "p").orderBy("rank").collect()] == [0, 0, 0, 0, 0, 0, 0.15, 0.3, 0.45]


def test_sums_in_any_order(spark):
    """Weights are summed in whole units: neither the order of ids nor the number of partitions shows."""
    w = spark.createDataFrame([(1, f"g:{i}", 100 / (3 + i)) for i in range(40)], "p int, feature string, weight double")
    ids = list(range(40))
    rows = spark.createDataFrame([(k, ids[k:] + ids[:k], []) for k in range(40)], "k int, genre_ids array<long>, keyword_ids array<long>")
    got = [rows.repartition(n).crossJoin(V.as_maps(w.repartition(n), "p")).select(S.thematic(F.col("vector")).alias("w")).distinct().collect() for n in (1, 7)]
    assert len(got[0]) == 1 and got[0] == got[1]
    assert [r.v for r in spark.createDataFrame([(0.5000005,), (0.50000049999999999,), (-1.0,)], "v double").select(V.rounded(F.col("v"), 6).alias("v")).collect()] == [0.500001, 0.500001, -1.0]
