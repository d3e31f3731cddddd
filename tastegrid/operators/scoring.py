"""Scores as columns: Bayesian rating, vector affinity, bonuses and penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastegrid.operators.vectors import SCALE

# Fixed values of the scoring rules.
MIN_VOTES, MEAN_VOTE = 300.0, 6.5
NICHE_REAL, NICHE_TARGET, NICHE_FADE, NICHE_MAX, NICHE_MIN = 20, 500, 2000, 2.5, 1.0
NICHE_GENRES = (99, 10402, 36, 37, 10770)
KIDS_GENRES = (27, 53, 80)
KIDS_KEYWORDS = (195669, 9194, 198385, 356759, 267122, 360629, 281741, 256466, 325693, 155477, 10292, 284439, 312898, 361470, 14964, 9826)
BLOCKED = -9999.0


def ids(values) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), c))


def bayes(votes: Column, average: Column, m: float = MIN_VOTES, mean: float = MEAN_VOTE) -> Column:
    v, r = F.coalesce(votes, F.lit(0)).cast("double"), F.coalesce(average, F.lit(0.0))
    return v / (v + m) * r + m / (v + m) * mean


UNROLLED = 5


def affinity(vector: Column, prefix: str, values: Column) -> Column:
    """Sum of a profile's weights over an item's ids; ids that come twice count twice.

    vector is a profile's struct of maps (vectors.as_maps), in whole units that are converted once, when they are summed. The first ids are looked up one by one, in
    compiled code; only longer lists go on with aggregate(), which is interpreted.
    """
    weight = lambda i: F.coalesce(F.try_element_at(vector[prefix], i), F.lit(0).cast("long"))
    total = weight(F.get(values, F.lit(0)))
    for k in range(1, UNROLLED):
        total = total + weight(F.get(values, F.lit(k)))
    n = F.coalesce(F.size(values), F.lit(0))
    rest = F.aggregate(F.slice(values, UNROLLED + 1, n), F.lit(0).cast("long"), lambda s, i: s + weight(i))
    return (total + F.when(n > UNROLLED, rest).otherwise(0)).cast("double") / float(SCALE)


def thematic(vector: Column) -> Column:
    return affinity(vector, "g", F.col("genre_ids")) + affinity(vector, "k", F.col("keyword_ids"))


def authorial(vector: Column) -> Column:
    return affinity(vector, "d", F.col("director_ids")) + affinity(vector, "a", F.slice("cast_ids", 1, 5))


def unfit_for_kids() -> Column:
    return F.arrays_overlap("genre_ids", ids(KIDS_GENRES)) | F.arrays_overlap("keyword_ids", ids(KIDS_KEYWORDS))


def base_match(vector: Column, taste_weight: float = 1.0, vote_weight: float = 1.0, kids: Column | None = None) -> Column:
    total = taste_weight + vote_weight
    if total == 0:
        score = F.lit(0.0)
    else:
        score = clamp(((0.98 * thematic(vector) + 0.02 * authorial(vector)) * taste_weight + bayes(F.col("vote_count"), F.col("vote_average")) * vote_weight) / total)
    return score if kids is None else F.when(kids & unfit_for_kids(), BLOCKED).otherwise(score)


def dna_multiplier(genres: Column, keywords: Column, filters: Column | None = None) -> Column:
    """1 without filters or with a genre or keyword hit, else 0.1; filters of other kinds alone (their number in `filters`) never hit."""
    none = (F.size(genres) == 0) & (F.size(keywords) == 0) if filters is None else filters == 0
    return F.when(none | F.arrays_overlap("genre_ids", genres) | F.arrays_overlap("keyword_ids", keywords), 1.0).otherwise(0.1)


def item_match(active: Column, overall: Column, multiplier: Column) -> Column:
    """0.8 of the active profile's score and 0.2 of the global one's, or the active one's alone."""
    return clamp(F.when(overall.isNull(), active).otherwise(0.8 * active + 0.2 * overall) * multiplier)


def niche_bonus(votes: Column) -> Column:
    dense = NICHE_MIN + (NICHE_TARGET - votes) / float(NICHE_TARGET - NICHE_REAL) * (NICHE_MAX - NICHE_MIN)
    fade = F.greatest(F.lit(0.0), NICHE_MIN - (votes - NICHE_TARGET) / float(NICHE_FADE - NICHE_TARGET))
    return F.when(votes < NICHE_REAL, 0.0).when(votes <= NICHE_TARGET, dense).when(votes <= NICHE_FADE, fade).otherwise(0.0)


def light_score(vector: Column) -> Column:
    return clamp(0.7 * affinity(vector, "g", F.col("genre_ids")) + 0.3 * bayes(F.col("vote_count"), F.col("vote_average")))


def niche_light_score(vector: Column) -> Column:
    odd = F.size(F.filter("genre_ids", lambda g: F.array_contains(ids(NICHE_GENRES), g)))
    theme = affinity(vector, "g", F.col("genre_ids")) + 0.35 * affinity(vector, "k", F.col("keyword_ids")) + 0.75 * odd
    credit = F.when((F.col("vote_count") > 0) & (F.col("vote_count") < NICHE_REAL), 0.15).otherwise(1.0)
    return clamp((0.8 * theme + 0.2 * niche_bonus(F.col("vote_count"))) * credit)


def hybrid_score(position: Column, n: Column, top_genres: Column, genres: Column) -> Column:
    """Place, number of seeds, and the profile's three top genres (30, 15, 5)."""
    boost = F.lit(0)
    for k, points in enumerate((30, 15, 5)):
        boost = boost + F.when(F.array_contains(genres, F.try_element_at(top_genres, F.lit(k + 1))), points).otherwise(0)
    place = F.when(position.isNull(), 0).otherwise(F.greatest(F.lit(0), 50 - position))
    return place + F.floor(100 / F.pow(F.lit(2.0), n - 1)) + boost


def impression_penalty(days: Column) -> Column:
    d = F.coalesce(days, F.lit(0))
    return F.when(d >= 3, F.greatest(F.lit(0.2), 1 - 0.2 * (d - 2))).otherwise(1.0)


def genre_saturation(ranked: DataFrame, *keys: str, step: float = 0.15, free: int = 5) -> DataFrame:
    """penalty of each row (keys, item_id, rank, genre_ids): step * (c - free) for a genre seen c > free times above. Rows stay where they are dealt by keys."""
    g = ranked.select("*", F.posexplode_outer("genre_ids").alias("_at", "_genre"))
    w = Window.partitionBy(*keys, F.col("_at").isNull(), "_genre").orderBy("rank", "_at")
    seen = F.row_number().over(w) - 1
    step_ = F.when(F.col("_at").isNotNull() & (seen > free), step * (seen - free)).otherwise(0.0)
    return g.withColumn("_step", step_).groupBy(*ranked.columns).agg(F.sum("_step").alias("penalty"))
