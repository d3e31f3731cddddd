"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

Every source has a share s of all tokens and gets the weight s**a / sum(s**a). The exponent a in
[0, 1] is the smallest for which the weights' entropy is at most `entropy_share` of the uniform
one and no source is repeated more than `max_repeat` times within the budget; both fall as a
grows, so a is found by bisection. Five halvings are done in one aggregation over the table of sources
(31 exponents at once), so six small jobs find a to 30 bits however many sources there are.

A source's budget of tokens is whole passes over its documents plus the start of one more pass in a
random order: blocks of 1024 consecutive doc_ids are permuted by a hash, and so are the documents in
each block. With a budget share of None the budget is the least with which every source gets a whole
pass, so that small sources are repeated and no document is left out. Running sums are taken in three levels (256 groups of blocks, blocks, documents), so that
a source of any size never meets in one task.

Tokens are words between ASCII white space. Defined cases: null texts have no tokens; a null source
is a source of its own; rows of one source and doc_id are one document; documents without tokens ride
along where the pass reaches them; a corpus without tokens keeps each document once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastegrid.llm.common import table, written

BLOCK, LEVELS, PASSES = 1024, 5, 6
WORD = r"[^\x20\x09-\x0D]+"


def source_key(source: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def exponent(sources: DataFrame, budget_share: float | None, entropy_share: float | None, max_repeat: float | None) -> float:
    """The smallest exponent that meets the targets, or 1; sources: one row with its tokens `t` > 0 each."""
    n, total, least, most = sources.agg(F.count("*"), F.sum("t"), F.min("t"), F.max("t")).first()
    if not n:
        return 1.0
    share = F.col("t") / F.lit(float(total))
    bound = F.lit(float("inf")) if entropy_share is None else F.lit(entropy_share) * F.log(F.lit(float(n)))
    repeat = F.lit(float("inf")) if max_repeat is None else F.lit(max_repeat)
    small = F.lit(least / total)
    whole = lambda a, z: F.lit(budget_share) if budget_share is not None else z * F.pow(F.lit(most / total), F.lit(1 - a))

    def meets(a: float) -> Column:
        z, zl = F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share))
        return (F.log(z) - F.lit(a) * zl / z <= bound) & (whole(a, z) * F.pow(small, F.lit(a - 1)) / z <= repeat)

    lo, width, parts = 0.0, 1.0, 2**LEVELS
    for _ in range(PASSES):
        grid = [lo + width * j / parts for j in range(1, parts)]
        met = sources.agg(*(meets(a).alias(f"m{j}") for j, a in enumerate(grid))).first()
        at = next((j for j, ok in enumerate(met) if ok), parts - 1)
        lo, width = lo + width * at / parts, width / parts
    return lo + width


def mix(docs: DataFrame, budget_share: float | None = 1.0, entropy_share: float | None = 0.95, max_repeat: float | None = 2.0, seed: str = "mix") -> DataFrame:
    """(src, doc_id, source, n_tokens, copies) of each document: how often the mixture holds it."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    units = docs.select(source_key().alias("src"), F.col("doc_id").cast("long"), "source", tokens.alias("n_tokens"))
    units = units.groupBy("src", "doc_id").agg(F.first("source").alias("source"), F.sum("n_tokens").alias("n_tokens"))
    units = written(units.withColumn("block", F.floor(F.col("doc_id") / BLOCK)), "mix-units")
    blocks = units.groupBy("src", "block").agg(F.sum("n_tokens").alias("t"))
    mark = F.md5(F.concat_ws("|", F.lit(seed), "src", F.coalesce(F.col("block").cast("string"), F.lit(""))).cast("binary"))
    blocks = written(blocks.withColumn("mark", mark).withColumn("part", F.substring("mark", 1, 2)), "mix-blocks")
    parts = written(blocks.groupBy("src", "part").agg(F.sum("t").alias("t")), "mix-parts")
    sources = written(parts.groupBy("src").agg(F.sum("t").alias("t")).filter("t > 0"), "mix-sources")

    total = sources.agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
    a = exponent(sources, budget_share, entropy_share, max_repeat)
    power = F.pow(F.col("t") / F.lit(float(total or 1)), F.lit(a))
    z = sources.agg(F.sum(power)).first()[0] or 1.0
    if budget_share is None:
        most = sources.agg(F.max("t")).first()[0] or 1
        # the largest source's budget is one pass; the others' lie between that and their own tokens
        budget = F.greatest(F.col("t"), F.round(F.lit(float(most)) * F.pow(F.col("t") / F.lit(float(most)), F.lit(a))).cast("long"))
    else:
        budget = F.round(F.floor(F.lit(budget_share * total)) * (power / F.lit(z))).cast("long")
    plan = sources.select("src", F.col("t").alias("whole"), budget.alias("budget"))
    plan = plan.select("src", F.expr("budget div whole").alias("passes"), F.expr("budget % whole").alias("rest"))

    before = lambda w: F.sum("t").over(w) - F.col("t")
    parts = parts.withColumn("p", before(Window.partitionBy("src").orderBy("part"))).drop("t").join(plan, "src", "left")
    blocks = blocks.withColumn("q", before(Window.partitionBy("src", "part").orderBy("mark", F.col("block").asc_nulls_first())))
    blocks = blocks.join(parts, ["src", "part"]).select("src", "block", (F.col("p") + F.col("q")).alias("start"), "passes", "rest")
    own = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    d = units.join(blocks.withColumnsRenamed({"src": "src_", "block": "block_"}), F.expr("src = src_ AND block <=> block_")).drop("src_", "block_")
    w = Window.partitionBy("src", "block").orderBy("own", F.col("doc_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    reached = (F.col("start") + F.sum("n_tokens").over(w) <= F.col("rest")).cast("long")
    copies = F.when(F.col("passes").isNull(), F.lit(1)).otherwise(F.col("passes") + F.col("reached"))
    return d.withColumn("own", own).withColumn("reached", reached).select("src", "doc_id", "source", "n_tokens", copies.cast("long").alias("copies"))


def mixed(docs: DataFrame, **params) -> DataFrame:
    """The documents of the mixture, in docs' columns: a document of several copies comes as so many rows."""
    m = mix(docs.select("doc_id", "source", "text"), **params).filter("copies > 0")
    m = m.select(F.col("src").alias("_src"), F.col("doc_id").alias("_id"), F.col("copies").alias("_copies"))
    j = docs.join(m, (source_key() == F.col("_src")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return j.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(docs.columns)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("src")


def mix_sql(docs: str, budget_share: float = 1.0, entropy_share: float | None = 0.95, max_repeat: float | None = 2.0, seed: str = "mix") -> str:
    """The same in DuckDB's SQL, as common table expressions that end in mix_out; docs: a table's name."""
    bound = "'Infinity'::DOUBLE" if entropy_share is None else f"{entropy_share!r} * ln(n::DOUBLE)"
    repeat = "'Infinity'::DOUBLE" if max_repeat is None else f"{max_repeat!r}"
    return f"""
mix_units AS (
  SELECT *, CAST(floor(doc_id / {BLOCK}.0) AS BIGINT) AS block FROM (
    SELECT coalesce('s' || source, 'n') AS src, doc_id, any_value(source) AS source,
           CAST(sum(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)) AS BIGINT) AS n_tokens
    FROM {docs} GROUP BY 1, 2)
), mix_blocks AS (
  SELECT src, block, sum(n_tokens) AS t, md5(concat_ws('|', '{seed}', src, coalesce(CAST(block AS VARCHAR), ''))) AS mark
  FROM mix_units GROUP BY src, block
), mix_sources AS (SELECT src, CAST(sum(t) AS DOUBLE) AS t FROM mix_blocks GROUP BY src HAVING sum(t) > 0
), mix_total AS (SELECT sum(t) AS total, count(*) AS n, min(t) / sum(t) AS small FROM mix_sources
), mix_search AS (
  SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT k, any_value(lo) AS lo, any_value(hi) AS hi, any_value(mid) AS mid,
           ln(sum(pow(s, mid))) - any_value(mid) * sum(pow(s, mid) * ln(s)) / sum(pow(s, mid)) <= any_value({bound})
           AND {budget_share!r} * any_value(pow(small, mid - 1)) / sum(pow(s, mid)) <= {repeat} AS ok
    FROM (SELECT k, lo, hi, (lo + hi) / 2 AS mid, t / total AS s, n, small FROM mix_search, mix_sources, mix_total WHERE k < {LEVELS * PASSES})
    GROUP BY k)
), mix_power AS (
  SELECT src, t, pow(t / total, (SELECT arg_max(hi, k) FROM mix_search)) AS p, total FROM mix_sources, mix_total
), mix_plan AS (
  SELECT src, budget // whole AS passes, budget % whole AS rest FROM (
    SELECT src, CAST(t AS BIGINT) AS whole, CAST(round(floor({budget_share!r} * total) * (p / sum(p) OVER ())) AS BIGINT) AS budget FROM mix_power)
), mix_starts AS (
  SELECT src, block, sum(t) OVER (PARTITION BY src ORDER BY mark, block NULLS FIRST) - t AS start FROM mix_blocks
), mix_out AS (
  SELECT src, doc_id, source, n_tokens, CAST(CASE WHEN passes IS NULL THEN 1 ELSE passes + CASE WHEN reach <= rest THEN 1 ELSE 0 END END AS BIGINT) AS copies
  FROM (
    SELECT u.*, passes, rest, start + sum(n_tokens) OVER (PARTITION BY u.src, u.block
      ORDER BY md5(concat_ws('|', '{seed}', coalesce(CAST(doc_id AS VARCHAR), ''))), doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) AS reach
    FROM mix_units u JOIN mix_starts b ON u.src = b.src AND u.block IS NOT DISTINCT FROM b.block LEFT JOIN mix_plan p ON u.src = p.src)
)"""


OP3_SQL = f"WITH RECURSIVE {mix_sql('documents')}\nSELECT doc_id, source, n_tokens, copies FROM mix_out"
