"""From raw documents to token ids; each stage is one corpus operator.

Every stage is written as Parquet and read again as the next one's documents; all but
the last return the columns of ``documents``, with ``n_chars`` following the text.

1. language: documents that language ID rejects go (null, without letters, unlike all it learned).
2. lines: lines that stand on many sites leave their documents.
3. near duplicates: the document of the smallest id of each group stays.
4. decontamination: benchmark passages are cut out; documents that are little else go.
5. tokens: ids of every document that is left.

Stages that hand whole texts to Python lower the session's rows of an Arrow batch.

Null texts go in stage 1; empty tables pass through every stage; repeated rows are
treated alike.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanforge.llm import bpe, decontaminate, language, lines, near
from loanforge.llm.common import short_batches, stored, table
from loanforge.llm.queries import RANKS

#: The fitted language model can't be written as SQL; tests/llm/test_pipeline.py holds run() against plain code.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, where there is such a column."""
    return docs.select(*[F.length("text").cast(t).alias(c) if c == "n_chars" else c for c, t in docs.dtypes])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    judged = language.identify(docs.select("*"), language.fit(docs))
    return judged.where(~F.col("rejected")).select(*docs.columns)


def own_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(lines.remove_boilerplate(docs))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return near.one_of_each(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language", known_language),
    ("lines", own_lines),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmarks),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
