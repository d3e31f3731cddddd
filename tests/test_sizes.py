"""What keeps the vectors, neighbours and items bounded on larger tables: how they are dealt, and what is never broadcast."""

import re

from pyspark.sql import functions as F

from tastegrid.operators import ranking as R
from tastegrid.operators import vectors as V
from tastegrid.sources.tables import tasks_for


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tasks_grow_with_the_files(spark, sf, tmp_path):
    one, mb = f"{sf}/lineitem.parquet", 0.001
    few = tasks_for(spark, one, mb=mb)
    assert few > spark.sparkContext.defaultParallelism and tasks_for(spark, one, one, mb=mb) in (2 * few - 1, 2 * few)
    assert tasks_for(spark, one, mb=1000) == spark.sparkContext.defaultParallelism


def test_fused_vector_is_fuse_in_one_deal(spark):
    history = spark.createDataFrame([(1, "p1", 7), (1, "p1", 7), (1, "p2", 7), (1, "p2", 8), (2, "p1", 8), (2, "p1", 99)], "owner long, context string, item_id long")
    items = spark.createDataFrame([(7, [28, 28], [5]), (8, [12], [5])], "item_id long, genre_ids array<long>, keyword_ids array<long>").withColumns({"director_ids": F.array(F.lit(1)), "cast_ids": F.array(F.lit(2)), "origin_country": F.lit(None).cast("string")})
    static = spark.createDataFrame([(1, "g:28", 100.0), (1, "g:9", 300.0), (3, "g:9", 700.0)], "owner long, feature string, weight double")
    both = history.union(history.withColumn("context", F.lit("global"))).distinct()
    counts = V.interaction_counts(both, "owner", "context")
    got = V.fused_vector(history, items, static, counts, "owner", "context", "global", 3)
    everywhere = counts.select("owner", "context").union(static.select("owner", F.lit("global"))).distinct().join(static, "owner")
    want = V.fuse(everywhere, V.active_vector(both, items, "owner", "context"), counts, "owner", "context")
    rows = lambda df: sorted((r.owner, r.context, r.feature, r.weight) for r in df.collect())
    assert rows(got) == rows(want) and (3, "global", "g:9", 700.0) in rows(got)
    assert not re.search(r"Exchange hashpartitioning\([^)]*(context|feature)#", plan(got.groupBy("owner").count()))
    active = V.context_vectors(history, items, "owner", "context", "global", 3)
    assert rows(active) == rows(V.active_vector(both, items, "owner", "context"))


def test_seeds_take_their_neighbours_along(spark):
    seeds = spark.createDataFrame([(1, 7, 2), (1, 8, 3), (2, 8, 1)], "owner long, src_id long, weight long")
    edges = spark.createDataFrame([(7, 20, 1), (7, 21, 2), (8, 20, 2)], "src_id long, dst_id long, position int")
    got = sorted(tuple(r) for r in R.neighbours(seeds, edges, 3, "owner").collect())
    assert got == [(1, 2, 20, 1), (1, 2, 21, 2), (1, 3, 20, 2), (2, 1, 20, 2)]
    best = R.weighted_neighbours(seeds.withColumnRenamed("src_id", "item_id"), edges, "owner")
    assert sorted(tuple(r) for r in best.collect()) == [(1, 20, 5, 1), (1, 21, 2, 2), (2, 20, 1, 2)]
    assert not re.search(r"Exchange hashpartitioning\([^)]*(dst_id|item_id)#", plan(best))


def test_items_are_never_broadcast_by_the_size_of_their_file(spark, sf):
    from tastegrid import queries as Q

    Q.load()
    assert not re.search(r"BroadcastHashJoin \[item_id#", plan(Q.QUERIES["a18_relevance_audit"](spark, sf)))


def test_fused_vector_reads_its_rows_once(spark):
    history = spark.createDataFrame([(1, "p1", 7), (1, "p1", 7), (1, "p2", 8), (2, "p1", 99), (None, "p1", 7), (4, None, 7), (5, "p1", 9)], "owner long, context string, item_id long")
    items = spark.createDataFrame([(7, [28, 28], [5]), (8, [12], [5]), (9, [None], None)], "item_id long, genre_ids array<long>, keyword_ids array<long>").withColumns({"director_ids": F.array(F.lit(1)), "cast_ids": F.array(F.lit(2)), "origin_country": F.lit(None).cast("string")})
    static = spark.createDataFrame([(1, "g:28", 100.0), (1, "g:9", 300.0), (2, "g:9", 50.0), (3, "g:9", 700.0)], "owner long, feature string, weight double")
    both = history.union(history.withColumn("context", F.lit("global"))).distinct()
    counts = V.interaction_counts(both, "owner", "context")
    got = V.fused_vector(history, items, static, None, "owner", "context", "global", 3)
    everywhere = counts.select("owner", "context").union(static.select("owner", F.lit("global"))).distinct().join(static, "owner")
    want = V.fuse(everywhere, V.active_vector(both, items, "owner", "context"), counts, "owner", "context").filter("owner IS NOT NULL AND context IS NOT NULL")
    rows = lambda df: sorted(((r.owner, r.context, r.feature or "", r.weight) for r in df.collect()), key=str)
    assert rows(got) == rows(want) and (3, "global", "g:9", 700.0) in rows(got)
    assert len(re.findall(r"Exchange hashpartitioning\(owner#\d+L?, 3\)", plan(got.groupBy("owner").count()).replace("\n", " "))) == 1


def test_candidates_are_not_joined_with_their_features_one_by_one(spark, sf):
    from tastegrid import queries as Q

    Q.load()
    for name in ("x02_thematic", "x04_base_match", "x06_item_match", "x10_hybrid_score", "x13_genre_saturation", "j26_blend_profile_scores"):
        text = plan(Q.QUERIES[name](spark, sf))
        assert not re.search(r"SortMergeJoin \[item_id#\d+L?\], \[item_id#\d+L?\], Inner", text), name
        assert not re.search(r"Exchange hashpartitioning\(owner#\d+L?, item_id#", text), name


def test_neighbours_bring_what_the_edges_hold_of_them(spark):
    seeds = spark.createDataFrame([(1, 7), (1, 8), (2, 8)], "owner long, src_id long")
    edges = spark.createDataFrame([(7, 20, 1, [28]), (7, 21, 2, None), (8, 20, 2, [28])], "src_id long, dst_id long, position int, genre_ids array<long>")
    got = sorted(tuple(r) for r in R.neighbours(seeds, edges, 3, "owner").collect())
    assert got == [(1, 20, 1, [28]), (1, 20, 2, [28]), (1, 21, 2, None), (2, 20, 2, [28])]


def test_votes_are_counted_without_making_the_rows(spark):
    q = spark.createDataFrame([(1, 1, 100), (2, 1, 400), (3, 1, 3), (4, 2, 500), (5, 3, 0), (6, 1, None), (7, 4, 9)], "owner long, lane int, floor_ long")
    i = spark.createDataFrame([(1, 1, 150), (2, 1, 5), (3, 1, 4), (4, 2, 500), (5, 2, 7), (6, 2, None), (7, 4, 1)], "item_id long, lane int, vote_count long")
    got = R.relaxed_counts(q, i, "owner", "lane")
    want = R.relax_votes(q, i, "owner", "lane").groupBy("owner", "relaxed").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.schema["n"].dataType == want.schema["n"].dataType
    assert not any("item_id" in line for line in plan(got).splitlines() if "Scan" not in line)


def test_traits_are_dealt_before_they_widen(spark, sf):
    from tastegrid.sources import domain as D

    text = plan(D.item_traits.__wrapped__(spark, sf))
    assert 0 <= text.index("runtime#") < text.index("Exchange hashpartitioning(item_id#")


def test_an_owners_items_are_joined_by_owner_alone(spark, sf):
    from tastegrid import queries as Q

    Q.load()
    for name in ("c02_true_blend", "j02_join_impressions", "j04_hide_watched", "q01_top_items"):
        assert not re.search(r"Exchange hashpartitioning\(owner#\d+L?, (item|profile|catalog)_id#", plan(Q.QUERIES[name](spark, sf))), name


def test_days_and_seen_items_by_owner_are_plain_joins(spark):
    rows = spark.createDataFrame([(1, 7), (1, 8), (2, 7), (None, 7), (2, None), (3, 9)], "owner long, item_id long")
    days = spark.createDataFrame([(1, 7, 3), (2, 9, 4), (2, None, 5), (None, 7, 6)], "owner long, item_id int, days long")
    sort = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert sort(R.with_days(rows, days, "owner")) == sort(rows.join(days, ["owner", "item_id"], "left").select("owner", "item_id", "days"))
    assert sort(R.without_seen(rows, days)) == sort(rows.join(days, ["owner", "item_id"], "left_anti"))


def test_tastes_are_maps_and_tops_in_one_pass(spark):
    vector = spark.createDataFrame([(1, "g:28", 5.0), (1, "g:12", 9.0), (1, "g:16", 9.0), (1, "k:7", 1.0), (1, "g:99", 0.0), (2, "d:1", 2.0), (3, "g:5", 1.0)], "owner long, feature string, weight double")
    filters = spark.createDataFrame([(1, "g:28"), (1, "g:28"), (1, "k:9"), (1, "g:99"), (3, "k:4")], "owner long, feature string")
    got = {r.owner: r for r in V.as_tastes(vector, filters, "owner", 3).collect()}
    assert {o: r.vector for o, r in got.items()} == {r.owner: r.vector for r in V.as_maps(vector, "owner").collect()}
    for p, c in (("g", "genres"), ("k", "keywords")):
        want = {}
        for r in V.top_features(vector, p, 3, "owner", filters=filters).orderBy("owner", "pos").collect():
            want.setdefault(r.owner, []).append(int(r.feature.split(":")[1]))
        assert {o: r[c] for o, r in got.items() if r[c]} == want


def test_pages_are_dealt_by_owner_once(spark, sf):
    from tastegrid import queries as Q

    Q.load()
    text = plan(Q.QUERIES["c16_post_processing"](spark, sf))
    assert not re.search(r"Exchange hashpartitioning\((owner#\d+L?, [a-z]|catalog_id#\d+, owner#)", text)
    assert not re.search(r"Join \[owner#\d+L?, item_id#", text)


def test_hops_are_dealt_to_as_many_tasks_as_asked(spark):
    from tastegrid.operators import xref as X

    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (2, 7, 2), (3, 1, 1), (3, 14, 2)], "src long, dst long, ord int")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node long")
    got = X.franchise_parent(nodes, edges, spark.createDataFrame([(7,), (14,), (7,)], "node long"), 6)
    assert sorted(map(tuple, got.collect())) == [(1, 14, 3), (2, 14, 2), (3, 7, 3)]
    text = plan(got)
    assert len(re.findall(r"Exchange hashpartitioning\(at#\d+L?, 6\)", text)) >= 3 and len(re.findall(r"Exchange hashpartitioning\(node#\d+L?, 6\)", text)) >= 1


def test_catalogs_are_written_by_more_than_one_task(spark, sf, monkeypatch):
    from tastegrid import queries as Q
    from tastegrid.sources import tables as T

    Q.load()
    seen = []
    monkeypatch.setattr(T, "write_catalogs", lambda df, path: (seen.append(plan(df)), df.write.mode("overwrite").partitionBy("catalog_id", "kids").parquet(path)))
    assert Q.QUERIES["s15_write_catalogs"](spark, sf).count() == 20
    assert "Exchange hashpartitioning(owner#" in seen[0] and not re.search(r"SortMergeJoin \[catalog_id#", seen[0])


def test_neighbours_are_counted_and_met_in_as_many_tasks_as_the_purchases(spark, sf, monkeypatch):
    from tastegrid import queries as Q
    from tastegrid.sources import domain as D

    Q.load()
    monkeypatch.setattr(D, "tasks", lambda *_: 37)
    own = lambda name: plan(Q.QUERIES[name](spark, sf)).split("InMemoryRelation")[0]
    assert "Exchange hashpartitioning(dst_id#" in own("a10_similar_counts") and ", 37)" in own("a10_similar_counts")
    assert re.search(r"Exchange hashpartitioning\(src_id#\d+L?, 37\)", own("c11_similar_to"))
    text = plan(D.community(spark, sf))
    assert re.search(r"Exchange hashpartitioning\(owner#\d+L?, 37\)", text) and text.count("Exchange hashpartitioning") == 1


def test_a_network_has_all_its_neighbours(spark):
    from tastegrid.plans import catalogs as C

    n = 90  # the last by hybrid score is the first by match
    neighbours = spark.createDataFrame([(1, i, 1 + i // 20, i, [28], [1001]) for i in range(1, n + 1)], "owner long, item_id long, weight long, place int, genre_ids array<long>, keyword_ids array<long>")
    top = spark.createDataFrame([(1, [12])], "owner long, top array<long>")
    dna = spark.createDataFrame([(1, [], [], 0)], "owner long, genres array<long>, keywords array<long>, filters long")
    days = spark.createDataFrame([], "owner long, item_id long, days long")
    match = lambda rows: rows.withColumn("full", F.when(F.col("item_id") == n, 900.0).otherwise(1.0))
    got = C.seed_network(neighbours, top, dna, match, days).orderBy("pos").collect()
    assert len(got) == n and got[0].item_id == n
    assert len(C.seed_network(neighbours, top, dna, match, days, most=80).collect()) == 80


def test_shares_of_owners_hold_every_row_once(spark, sf, monkeypatch):
    from tastegrid.sources import domain as D

    assert D.shares(spark, sf) == 1
    monkeypatch.setattr(D, "shares", lambda spark, d: 1 if isinstance(d, D.Share) else 3)
    seen = []

    @D.in_shares
    def bought(spark, d):
        seen.append((d.number, D.read(spark, d, "customer").count(), D.read(spark, d, "events").count(), D.read(spark, d, "orders").count()))
        return D.purchases(spark, d).select("owner", "item_id", "basket")

    got, want = bought(spark, sf), D.purchases(spark, sf).select("owner", "item_id", "basket")
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()
    whole = [D.read(spark, sf, t).count() for t in ("customer", "events", "orders")]
    assert [s[0] for s in seen] == [0, 1, 2] and [sum(s[k] for s in seen) for k in (1, 2, 3)] == whole and all(s[1] for s in seen)
    assert spark.conf.get(D.CLEANUP) == "false"


def test_personal_lists_are_the_same_in_shares(spark, sf, monkeypatch):
    from tastegrid import queries as Q
    from tastegrid.sources import domain as D

    Q.load()
    for name in ("x13_genre_saturation", "a20_taste_drift"):
        want = Q.QUERIES[name](spark, sf)
        with monkeypatch.context() as m:
            m.setattr(D, "shares", lambda spark, d: 1 if isinstance(d, D.Share) else 2)
            got = Q.QUERIES[name](spark, sf)
        assert got.columns == want.columns and got.count() == want.count() > 0 and got.exceptAll(want).isEmpty(), name
        assert "Exchange" not in plan(got), name


def test_drift_comes_from_one_pass(spark):
    history = spark.createDataFrame([(1, "p1", 7), (1, "p2", 8), (2, "p1", 99), (5, "p1", 9)], "owner long, context string, item_id long")
    items = spark.createDataFrame([(7, [28, 28], [5]), (8, [12], [5]), (9, [None], None)], "item_id long, genre_ids array<long>, keyword_ids array<long>").withColumns({"director_ids": F.array(F.lit(1)), "cast_ids": F.array(F.lit(2)), "origin_country": F.lit(None).cast("string")})
    static = spark.createDataFrame([(1, "g:28", 100.0), (1, "g:9", 300.0), (2, "g:9", 50.0), (3, "g:9", 700.0), (6, "g:4", 0.0)], "owner long, feature string, weight double")
    args = (history, items, static, None, "owner", "context", "global", 3)
    contexts = history.select("owner", "context").union(history.select("owner", F.lit("global"))).union(static.select("owner", F.lit("global"))).distinct()
    want = V.taste_drift(contexts.join(static, "owner"), V.fused_vector(*args), "owner", "context")
    got = V.drift(V.fused_vector(*args, with_static=True), "owner", "context")
    rows = lambda df: sorted(((r.owner, r.context, r.feature or "", r.static, r.final, r.pos) for r in df.collect()), key=str)
    assert rows(got) == rows(want) and len(rows(got)) > 10


def test_tastes_have_tops_without_filters_too(spark):
    vector = spark.createDataFrame([(1, "a", "g:28", 5.0), (1, "a", "g:12", 9.0), (1, "a", "g:16", 9.0), (1, "b", "k:7", 1.0), (1, "a", "g:99", 0.0), (3, "a", "g:5", 1.0)], "owner long, context string, feature string, weight double")
    filters = spark.createDataFrame([(1, "g:28"), (1, "k:9"), (3, "g:4")], "owner long, feature string")
    got = {(r.owner, r.context): (r.genres, r.keywords, r.own_genres, r.own_keywords) for r in V.as_tastes(vector, filters, "owner", 3, "context").collect()}
    assert got == {(1, "a"): ([28, 12, 16], [9], [12, 16, 28], []), (1, "b"): ([28], [9, 7], [], [7]), (3, "a"): ([4, 5], [], [5], [])}


def test_a_searchs_rows_with_vectors_are_not_dealt_by_item(spark, sf):
    from tastegrid import queries as Q

    Q.load()
    assert not re.search(r"Exchange hashpartitioning\(item_id#\d+L?, \d+\)[^\n]*\n[^\n]*\n?[^\n]*vector", plan(Q.QUERIES["x12_final_search_score"](spark, sf)))
    assert "BroadcastHashJoin [item_id#" in plan(Q.QUERIES["x12_final_search_score"](spark, sf))
