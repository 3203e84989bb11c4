"""A corpus pipeline of five stages: quality, exact copies, near copies, source mix, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return
the columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads it back, so a
lost executor repeats at most one stage. A stage handles empty tables, null columns and further columns as its
operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trialspan.llm.common import read, stored
from trialspan.llm.exact_dedup import drop_copies
from trialspan.llm.mixing import dimensions, take_mix
from trialspan.llm.near_dedup import drop_near
from trialspan.llm.pieces import encode, model_path
from trialspan.llm.quality import score, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good ones."""
    model = train(docs, read(spark, sf_dir, "labels"))
    return score(docs, model, keep=tuple(docs.columns), at_least=0.5)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose texts are equal without white space."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a similarity of 0.8."""
    return drop_near(docs, words=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose sources, languages and topics have the target weights."""
    return take_mix(docs, dimensions())


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns of the documents with their token ids, their number, and digests of ids and decoded text."""
    return encode(docs, model_path(), keep=tuple(c for c in docs.columns if c != "doc_id"))


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("source_mix", source_mix), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


# The classifier is fitted and token ids follow a model file: no SQL. tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None
