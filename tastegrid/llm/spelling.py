"""Spelling variants: words at distance one of a corpus vocabulary, by search schemes over FM-indexes.

`vocabulary` counts the words of all texts, `variants` finds for each word how many others differ from it by one
inserted, deleted or replaced code point (near words), its form (the near word of largest count, if that is at least
`ratio` times its own) and its root (where forms lead in the end).

Two words at distance one share one half of the word exactly: what is before or behind the error. So every word looks
for its near words twice, among the words that share its left and its right half. Words are dealt by a hash of those
halves into blocks of bounded size; a block is a bidirectional FM-index over its words (fm_index.py), which is asked
for all words that have a half in it. Halves that thousands of words share are taken apart: the half in which the
error may lie is halved again, and words meet by what is before and behind that part, until at most the words that
differ in a single place are left. Nothing is cut: a word finds all its near words, each once.

Forms have at least twice the count, so chains are short; roots are found by pointer doubling, in joins.

Defined cases: null and empty texts have no words; a null doc_id counts as an empty string in the hash; repeated rows
count repeatedly; ties of forms go to the smallest word in code-point order; an empty table gives no rows; only the
columns doc_id and text are read. A block's steps are as many as its longest word has code points.
"""

from __future__ import annotations

import string
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastegrid.llm.common import drop, give_back, table, written

LETTERS = "a-zÀ-ÿ"  # after A-Z were lower-cased
#: Code points of a block's index; index rows of one half beyond which it is taken apart: more than three times the words
#: that can differ in one given place (one, or none, or two of 90 letters).
BLOCK_POINTS, HOT = 256_000, 3 * (90 * 90 + 90 + 1) + 1


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3, typo_every: int = 97) -> DataFrame:
    """(word, n) of all texts' runs of letters; of the runs whose hash with the doc_id is divisible by typo_every,
    one code point is gone."""
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    # a run that is too short stays too short
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    cut = F.expr(f"CASE WHEN h % {typo_every} = 0 THEN concat(left(run, int(h % length(run))), substring(run, int(h % length(run)) + 2)) ELSE run END")
    return hashed.select(cut.alias("word")).filter(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _windows(length: str, level: int, part: str) -> tuple[str, str]:
    parts = 2 ** (level + 1)
    return f"int({part} * {length} div {parts})", f"int(({part} + 1) * {length} div {parts})"


def _key(i: str, tail: str) -> str:
    return f"xxhash64(left(word, {i}), right(word, {tail}))"


def _asked(rows: DataFrame, level: int) -> DataFrame:
    """(word, n, part, i, j, key): the parts of each word in which an error may lie; rows has word, n, part."""
    i, j = _windows("length(word)", level, "part")
    out = rows.selectExpr("word", "n", "part", f"{i} AS i", f"{j} AS j").filter("i < j")
    return out.withColumn("key", F.expr(_key("i", "length(word) - j")))


def _indexed(rows: DataFrame, level: int) -> DataFrame:
    """(word, n, part, size, key): what a word of `size` code points at distance one from it would ask for."""
    i, j = _windows("size", level, "part")
    out = rows.selectExpr("word", "n", "part", "size", f"{i} AS i", f"{j} AS j").filter("i < j AND i + size - j <= length(word)")
    return out.withColumn("key", F.expr(_key("i", "size - j"))).drop("i", "j")


def _halved(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The two halves of each part that is hot."""
    return rows.join(hot, "key", "left_semi").withColumn("part", F.explode(F.array(F.col("part") * 2, F.col("part") * 2 + 1)))


def _dealt(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(asked, indexed): every word's questions and places in indexes, by keys none of which is hot."""
    sides = words.withColumn("part", F.explode(F.array(F.lit(0), F.lit(1))))
    asked, level = _asked(sides, 0), 0
    indexed = _indexed(sides.withColumn("size", F.explode(F.expr("array(length(word) - 1, length(word), length(word) + 1)"))), 0)
    longest = words.agg(F.coalesce(F.max(F.length("word")), F.lit(0))).first()[0]
    done_asked, done_indexed = [], []
    while True:
        hot = written(indexed.groupBy("key").count().filter(F.col("count") > HOT).select("key"), "spell-hot")
        if hot.isEmpty() or 2 ** (level + 1) > longest:
            done_asked.append(asked)
            done_indexed.append(indexed)
            break
        done_asked.append(asked.join(hot, "key", "left_anti"))
        done_indexed.append(indexed.join(hot, "key", "left_anti"))
        level += 1
        asked, indexed = _asked(_halved(asked, hot), level), _indexed(_halved(indexed, hot), level)
    union = lambda x, *cols: reduce(DataFrame.union, [d.select(*cols) for d in x])
    return union(done_asked, "key", "word", "n", "i", "j"), union(done_indexed, "key", "word", "n")


def _near_in_block(rows: pa.Table) -> pa.Table:
    from tastegrid.llm.fm_index import FMIndex

    give_back()
    known = rows.filter(pc.is_null(rows["i"])).select(["word", "n"]).group_by("word").aggregate([("n", "max")]).sort_by("word")
    asked = rows.filter(pc.is_valid(rows["i"]))
    words, n = known["word"].to_pylist(), known["n_max"].to_numpy()
    if not words or not asked.num_rows:
        hit = rank = np.empty(0, np.int64)
    else:
        hit, rank = FMIndex(words).near(asked["word"].to_pylist(), asked["i"].to_numpy().astype(np.int64), asked["j"].to_numpy().astype(np.int64))
    order = np.lexsort((rank, -n[rank], hit)) if len(hit) else hit
    hit, rank = hit[order], rank[order]
    first = np.flatnonzero(np.diff(hit, prepend=-1))
    out = {"word": asked["word"].take(pa.array(hit[first])), "n_near": np.diff(np.append(first, len(hit))).astype(np.int64), "form_n": n[rank[first]] if len(hit) else hit, "form": known["word"].take(pa.array(rank[first]))}
    return pa.table({k: v if isinstance(v, pa.ChunkedArray) else pa.array(v, pa.int64()) for k, v in out.items()})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form): of each word and each of its parts that has any, the number of near words and the best."""
    asked, indexed = _dealt(words)
    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    blocks = max(1, -(-total * 5 // BLOCK_POINTS))  # a word stands in about five indexes
    block = F.pmod("key", F.lit(blocks)).cast("int").alias("block")
    rows = asked.select(block, "word", "n", "i", "j").union(indexed.select(block, "word", "n", F.lit(None).cast("int"), F.lit(None).cast("int")))
    return rows.groupBy("block").applyInArrow(_near_in_block, "word string, n_near long, form_n long, form string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links that don't go in circles, by pointer doubling."""
    at = written(forms.select("word", F.col("form").alias("root")), "spell-roots")
    while True:
        far = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(at.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spell-roots")
        drop(at)
        at = step.drop("moved")
        at._written_to = step._written_to
        if step.filter("moved").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words (word, n)."""
    words = written(words, "spell-words")
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"), F.lit(None).cast("string").alias("form"))
    found = near_words(words).select("word", F.lit(None).cast("long").alias("n"), "n_near", "form_n", "form")
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("a"), F.col("form").alias("b"))))
    all_ = none.union(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    enough = -F.col("best.a") >= F.col("n") * ratio
    out = written(all_.select("word", "n", "n_near", F.when(enough, F.col("best.b")).alias("form"), F.when(enough, -F.col("best.a")).alias("form_n")), "spell-forms")
    ends = roots(out.filter("form IS NOT NULL").select("word", "form"))
    return out.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents").select("doc_id", "text")))


#: crc32 of a string's bytes; crc_table has the 256 values of its table.
CRC_TABLE = "crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: xor(a >> 1, 3988292384 * (a & 1)), i)) AS t)"


def crc_sql(text: str) -> str:
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(4294967295, list_reduce({bytes_}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT))"


OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
  FROM documents
), hashed AS (SELECT run, k, {crc_sql("id || ':' || run")} AS h FROM (SELECT id, run, count(*) AS k FROM runs GROUP BY ALL), crc_table
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT k, CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), gaps AS (
  SELECT word, n, p, substr(word, 1, p - 1) AS a, substr(word, p + 1) AS b FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)
), near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM gaps x JOIN gaps y ON x.p = y.p AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM gaps x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM gaps x JOIN words y ON x.a || x.b = y.word
), best AS (
  SELECT word, CAST(count(*) AS BIGINT) AS n_near, arg_max(other, m) FILTER (WHERE rk = 1) AS form, max(m) AS form_n
  FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY m DESC, other) AS rk FROM near) GROUP BY word
), linked AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), walk AS (
  SELECT word, word AS spot, 0 AS k FROM linked
  UNION ALL SELECT walk.word, form, k + 1 FROM walk JOIN linked ON linked.word = spot WHERE form IS NOT NULL
)
SELECT l.word, n, n_near, form, form_n, root FROM linked l JOIN (SELECT word, arg_max(spot, k) AS root FROM walk GROUP BY word) r ON l.word = r.word"""
