"""Configurations, details, model answers, providers and per-profile discovery on small cases."""

import random

import pytest
from pyspark.sql import functions as F

from tastegrid.functions import details as X
from tastegrid.operators import configs as G
from tastegrid.operators import discovery as D
from tastegrid.operators import providers as P
from tastegrid.operators import ranking as R
from tastegrid.operators import requests as Q
from tastegrid.operators import vectors as V

CAT = "array<struct<id:string,name:string>>"
PROFILE = f"uuid string, profile_id string, settings map<string,string>, manual_dna array<string>, suggested_dna array<string>, catalogs {CAT}, selected array<string>, catalog_order array<string>, dna map<string,double>"


def test_merge_profiles(spark):
    stored = spark.createDataFrame([("u", "p", {"a": "1", "b": "2"}, ["x"], ["y"], [("c", "old")], ["s"], None, {"g:1": 1.0}), ("u", "gone", None, None, None, None, None, None, None)], PROFILE)
    incoming = spark.createDataFrame([("u", "p", {"b": "3"}, None, ["z"], [("c", "1"), ("d", "2"), ("c", "3"), ("", "4")], ["s", "t", "s"], ["k"], {"g:1": 9.0}), ("u", "new", {"q": "1"}, ["m"], None, [("c", "1"), ("c", "2")], ["t", "t"], None, None)], PROFILE)
    got = {r.profile_id: r for r in G.merge_profiles(stored, incoming).collect()}
    p, new = got["p"], got["new"]
    assert set(got) == {"p", "new"} and p.settings == {"a": "1", "b": "3"} and p.manual_dna == ["x"] and p.suggested_dna == ["z"] and p.dna == {"g:1": 1.0}
    assert [tuple(c) for c in p.catalogs] == [("c", "3"), ("d", "2")] and p.selected == ["s", "t"] and p.catalog_order == ["k"]
    assert [tuple(c) for c in new.catalogs] == [("c", "1"), ("c", "2")] and new.selected == ["t", "t"] and new.dna is None  # a new profile stays as it came


def test_template_and_dna(spark):
    r = spark.range(1).select(G.merge_template(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("x"), G.merge_template(F.lit(None).cast("array<string>"), F.array(F.lit("c"))).alias("y")).first()
    assert r.x == ["a", "b", "c"] and r.y == ["c"]
    kind = "owner long, type string, id string"
    got = G.confirm_dna(spark.createDataFrame([(1, "genre", "28")], kind), spark.createDataFrame([(1, "genre", "28"), (1, "keyword", "5"), (2, "genre", "28")], kind))
    assert sorted(map(tuple, got.collect())) == [(1, "genre", "28"), (1, "keyword", "5"), (2, "genre", "28")]


def test_images_and_badges(spark):
    image = "array<struct<path:string,lang:string>>"
    df = spark.createDataFrame([([("f", "fr"), ("n", None), ("e", "en"), ("i", "it"), ("f", "fr")], "own"), ([("n", None), ("f", "fr")], "own"), ([], "own"), (None, "own")], f"images {image}, own string")
    got = df.select(X.best_poster(F.col("images"), F.col("own")).alias("p"), F.transform(X.rank_images(F.col("images"), 3), lambda x: x["path"]).alias("r")).collect()
    assert [(r.p, r.r) for r in got] == [("i", ["i", "e", "n"]), ("n", ["n", "f"]), ("own", []), ("own", None)]
    n = F.lit(None).cast("int")
    badge = lambda *a: spark.range(1).select(X.episode_badge(*[F.lit(x) if x is not None else n for x in a[:6]], F.lit(a[6]).cast("string"), *[F.lit(x) if x is not None else n for x in a[7:9]], F.lit(a[9])).alias("b")).first().b
    assert badge(2, 5, 1, 9, 1, 8, None, 1, 3, False) == "S2 E5" and badge(None, 5, 1, 9, 1, 8, None, 1, 3, False) == "Ep 5" and badge(None, None, 3, 9, 1, 8, None, 1, 3, False) == "S3 E9"
    assert badge(None, None, None, None, 0, 8, None, 1, 3, False) == "S1 E8" and badge(None, None, None, None, 2, 8, "Ended", 2, 3, False) == "S2 E3" and badge(None, None, None, None, None, None, None, 2, 3, True) == "Ep 3" and badge(None, None, None, None, None, None, None, None, None, False) is None


@pytest.mark.parametrize(("text", "want"), [('```json\n[{"vibe":"a"}]\n```', [("a", None, None)]), ('x {"queries":[{"keyword":"k","genre_ids":[1]}]} y', [(None, [1], "k")]), ('[{"genre_ids":["a"],"keyword":3}]', []), ('[{"keyword":"k",},]// c', [(None, None, "k")]), ("none", []), (None, []), ("", []), ('"text"', [])])
def test_parse_model_queries(spark, text, want):
    got = Q.parse_model_queries(spark.createDataFrame([(1, text)], "k int, content string"), "k").orderBy("pos").collect()
    assert [(r.vibe, r.genre_ids, r.keyword) for r in got] == want


def test_sanitize_falls_back(spark):
    rows = [(1, "p", "[]"), (2, "p", None), (3, "p", '{"queries":[{"strategy":"multi_search"}]}'), (4, "p", '{"static_items":["a","b"]}'), (5, "p", "[1, 2]")]
    got = {r.k: r for r in Q.sanitize_query_rows(spark.createDataFrame(rows, "k int, prompt string, content string"), "k").collect()}
    assert all(got[k].strategy == "multi_search" and got[k].text_search == "p" and got[k].target == "tmdb" for k in (1, 2, 3, 5)) and got[4].static_items == ["a", "b"] and len(got) == 5


def test_blocks_and_presets(spark):
    q = {"keyword": "5|6", "vote_average.gte": "7", "first_air_date.gte": "2001-05-06", "sortBy": "vote_average.desc", "vote_count.gte": "20", "with_people": "3"}
    df = spark.createDataFrame([(q,)], "q map<string,string>").select(Q.query_to_block(F.col("q")).alias("b"))
    r = df.select("b", Q.block_to_query(F.col("b"), F.lit("tv")).alias("q")).first()
    assert r.b["keywords"] == "5|6" and r.b["year_from"] == "2001" and r.b["cast"] == "3" and r.b["vote_max"] == "10" and r.b["vote_count.gte"] == "20"
    assert r.q == {"provider": "tmdb", "strategy": "discovery", "sort_by": "vote_average.desc", "with_keywords": "5|6", "with_cast": "3", "vote_average.gte": "7", "first_air_date.gte": "2001-01-01", "vote_count.gte": "20"}
    j = '{"name":"n","type":"movie","queries":[{"a.lte":"today-14d","b.gte":"today-2m","c":"today","d":"28"}]}'
    p = Q.load_presets(spark.createDataFrame([("x", j)], "id string, json string"), F.lit("2024-04-30").cast("date")).first()
    assert p.queries == [{"a.lte": "2024-04-16", "b.gte": "2024-02-29", "c": "2024-04-30", "d": "28"}]


def test_discover_for_is_brute_force(spark):
    rnd = random.Random(4)
    items = [(i, [rnd.randrange(6) for _ in range(rnd.randrange(3))], [rnd.randrange(9) for _ in range(rnd.randrange(4))], rnd.choice(["JP", "US"]), float(rnd.randrange(40))) for i in range(200)]
    wanted = [(o, [rnd.randrange(6) for _ in range(rnd.randrange(3))], [rnd.randrange(9) for _ in range(rnd.randrange(3))], rnd.choice([[], ["JP"], ["JP", "US"]])) for o in range(40)]
    df = spark.createDataFrame(items, "item_id long, genre_ids array<long>, keyword_ids array<long>, origin_country string, popularity double")
    text = lambda x: [str(y) for y in x]
    got = D.discover_for(df, spark.createDataFrame([(o, text(g), text(k), c) for o, g, k, c in wanted], "owner long, genres array<string>, keywords array<string>, countries array<string>"), 7)
    want = []
    for o, g, k, c in wanted:
        own = [i for i in items if (not g or set(g) & set(i[1])) and (not k or set(k) & set(i[2])) and (not c or i[3] in c)]
        want += [(o, i[0], p + 1) for p, i in enumerate(sorted(own, key=lambda i: (-i[4], i[0]))[:7])]
    assert sorted(map(tuple, got.select("owner", "item_id", "pos").collect())) == sorted(want)


def test_two_tier_scores_the_kept_only(spark):
    pool = spark.createDataFrame([(1, i, float(i)) for i in range(9)], "p int, item_id int, light double")
    seen = []
    full = lambda kept: (seen.append(kept.count()), kept.withColumn("full", -F.col("light")))[1]
    got = R.two_tier(pool, spark.createDataFrame([(1, 8, 5)], "p int, item_id int, days long"), "p", full=full)
    assert seen == [5] and [r.item_id for r in got.orderBy("pos").collect()] == [8, 4, 5, 6, 7]


def test_relaxed_and_horror(spark):
    items = spark.createDataFrame([(1, "movie", [99], [5], 3.0), (2, "movie", [99], [6], 2.0), (3, "movie", [28], [5], 1.0)], "item_id int, media_type string, genre_ids array<long>, keyword_ids array<long>, popularity double").withColumns({c: F.lit(None).cast("double") for c in ("vote_count", "vote_average")})
    block = lambda g, k: D.Discovery(media_type="movie", with_genres=g, with_keywords=k)
    got = D.discover_relaxed(items, [({"c": "hit"}, block("99", "5")), ({"c": "none"}, block("99", "7")), ({"c": "other"}, block("28", "7"))])
    assert sorted((r.c, r.item_id, r.relaxed) for r in got.collect()) == [("hit", 1, 0), ("none", 1, 1), ("none", 2, 1)]
    assert D.Discovery(media_type="tv", with_genres="18|27", with_keywords="5").for_series().with_keywords == f"5,{D.HORROR}" and D.Discovery(media_type="movie", with_genres="27").for_series().with_keywords is None


def test_alt_filters(spark):
    a = P.AltFilter(media_type="movie", certification_lte="PG-13", vote_min=7.0)
    df = spark.createDataFrame([(1, "movie", 80, "R", "1999-01-01"), (2, "movie", 69, "G", "1999-01-01"), (3, "TV", 80, "G", "1999-01-01"), (4, "special", 70, "R18", "1999-01-01"), (5, "special", 70, "PG", "2030-01-01")], "alt_id int, subtype string, rating int, age string, d string").withColumn("start_date", F.col("d").cast("date"))
    assert [r.alt_id for r in df.filter(a.predicate(2024)).collect()] == [1]


def test_static_vector_words(spark):
    q = spark.createDataFrame([(1, "28", "kitsu", "Isekai, Slice Of Life", "War|")], "p int, with_genres string, provider string, keyword_names string, keyword string").withColumns({c: F.lit(None).cast("string") for c in ("with_keywords", "with_cast", "with_crew", "with_origin_country")})
    assert sorted(r.feature for r in V.static_vector(q, "p").collect()) == ["g:16", "g:28", "k:isekai", "k:slice of life", "k:war", "o:JP"]


def test_overlap_by_rare_items(spark):
    """Equal to counting all pairs, with an item in all catalogs, and no pair made by it alone."""
    import random

    from tastegrid.operators.audits import catalog_overlap

    rnd = random.Random(1)
    sets = {f"c{i:02}": {0} | {rnd.randrange(1, 120) for _ in range(rnd.choice([3, 12, 30]))} for i in range(40)} | {"only": {0}, "twin": {0}}
    rows = [(c, "movie", i) for c, s in sets.items() for i in s]
    for share in (0.1, 0.34):
        got = {(r.left_id, r.right_id): (r.shared, r.left_size, r.right_size) for r in catalog_overlap(spark.createDataFrame(rows, "catalog_id string, media_type string, item_id long"), share).collect()}
        want = {(a, b): (len(sets[a] & sets[b]), len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) > share * min(len(sets[a]), len(sets[b]))}
        assert got == want and want


def test_stored_queries(spark):
    from tastegrid.operators.matching import from_maps

    q = spark.createDataFrame([(1, {"with_genres": "28", "vote_count.gte": "50", "primary_release_date.lte": "1999-12-31", "sort_by": "", "with_runtime.gte": "odd", "unknown": "x"})], "owner long, q map<string,string>")
    r = from_maps(q, "q", F.lit("movie")).first()
    assert (r.owner, r.media_type, r.with_genres, r.vote_count_gte, r.year_to, r.sort_by, r.runtime_gte) == (1, "movie", "28", 50.0, 1999, None, None)
