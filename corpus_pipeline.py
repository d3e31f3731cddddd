"""A training corpus from raw documents: filter, fold near copies, cut repeats, mix sources, tokenize.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again before
the next one. All but the last keep the columns of documents:

1. toxicity: drops documents scored 0.5 or more by the classifier trained on labels;
2. near_dedup: keeps the document of the smallest doc_id of each group of near copies (five-word
   shingles, similarity 0.8 or more);
3. suffix_dedup: cuts passages of over 50 words that stand earlier in the corpus out of the texts;
4. mixing: takes sources at tempered weights: every document once, those of small sources up to twice;
5. byte_bpe: encodes what is left and decodes it again, as counts and digests.

Defined cases: null texts pass as empty ones and stay null; without labels of both kinds nothing is toxic;
rows without doc_id are never copies of others; repeated rows of one id are one document after near_dedup;
other columns are kept up to the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tastegrid.llm.byte_bpe import token_texts
from tastegrid.llm.common import ship, table, written
from tastegrid.llm.mixing import mixed
from tastegrid.llm.simhash import near_dedup
from tastegrid.llm.suffix_dedup import strip_passages
from tastegrid.llm.toxicity import drop_toxic


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs, similarity=0.8)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return strip_passages(docs, keep="first")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed(docs, budget_share=None, entropy_share=None, max_repeat=2.0)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: No SQL: the classifier and the shingle sets have none. tests/llm/test_stages.py holds run() against plain versions of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
